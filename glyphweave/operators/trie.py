"""Longest signs by a trie in arrays, for all places of a batch of words at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Code points fit 21 bits.
BITS = 21


class Trie(NamedTuple):
    """Ways from state to state, sorted by state and code point (keys); whether a sign ends in a state; the longest sign's length."""

    keys: np.ndarray
    to: np.ndarray
    ends: np.ndarray
    depth: int


def build(signs: list[str]) -> Trie:
    """States are the distinct beginnings of the signs; empty signs are none."""
    signs = {s for s in signs if s}
    state = {p: k for k, p in enumerate(sorted({s[:i] for s in signs for i in range(len(s) + 1)} | {""}, key=lambda p: (len(p), p)))}
    ways = sorted((state[p[:-1]] << BITS | ord(p[-1]), k) for p, k in state.items() if p)
    ends = np.zeros(len(state), bool)
    ends[[state[s] for s in signs]] = True
    return Trie(np.array([w for w, _ in ways], np.int64), np.array([k for _, k in ways], np.int64), ends, max(map(len, signs), default=0))


def longest(trie: Trie, words: list[str]) -> np.ndarray:
    """For every place of the words, one after the other, the length of the longest sign that starts there and ends within its word; 0 without one."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    best, state, alive = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.arange(len(codes))
    for d in range(trie.depth):
        alive = alive[left[alive] > d]
        key = state[alive] << BITS | codes[alive + d]
        at = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1)
        hit = trie.keys[at] == key
        alive = alive[hit]
        state[alive] = trie.to[at[hit]]
        done = alive[trie.ends[state[alive]]]
        best[done] = d + 1
    return best


def segments(trie: Trie, words: list[str | None]) -> list[list[dict]]:
    """Each word from its start, the longest sign first; a code point that starts none stands alone."""
    best, at, out = longest(trie, [w or "" for w in words]).tolist(), 0, []
    for w in words:
        parts, i = [], 0
        while w and i < len(w):
            n = best[at + i]
            parts.append({"glyph": w[i : i + max(n, 1)], "known": n > 0})
            i += max(n, 1)
        out.append(parts)
        at += len(w or "")
    return out
