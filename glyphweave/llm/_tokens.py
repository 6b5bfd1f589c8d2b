"""Subword ids of whole texts by a public tokenizer, a white-space word at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import xxhash


def letters_only(stem: bytes) -> bool:
    """Whether the tokenizer sees letters alone, once it has composed and lower-cased them (a capital may turn into a letter and a mark)."""
    return unicodedata.normalize("NFC", stem.decode()).lower().isalpha()


def encoded(encode, words: list[bytes], kind: str) -> list[bytes]:
    """The ids of each word, all in one call: parted by blanks they are encoded as they are alone, and the offsets tell whose ids are whose."""
    texts = [w.decode() for w in words]
    found = encode(" ".join(texts), add_special_tokens=False)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
    edge = np.dtype(kind).itemsize * np.append(np.searchsorted(begins, np.cumsum(size) - size), len(begins))
    flat, edge = np.array(found.ids, kind).tobytes(), edge.tolist()
    return [flat[i:j] for i, j in zip(edge, edge[1:], strict=False)]


_MADE: dict[str, WordIds] = {}
_PARTS: dict[str, dict[bytes, bytes]] = {}


class WordIds(dict):
    """Ids of each word (bytes of little-endian 32-bit numbers), worked out once while it stays in the cache, new words of many texts in one call.

    The tokenizer drops white space and splits there before anything else, so a text's ids are its words' ids in a row
    (tests hold this against whole texts). Words part at the six ASCII spaces only; any other space stays inside its
    word, where the tokenizer handles it. It also lower-cases, and parts letters from marks: so words of letters share the ids of
    those letters whatever the case of A-Z and the marks that follow. The cache is emptied when it holds `most` words: that
    bounds memory and changes no result. A worker process keeps it from task to task.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.encode, self.most = Tokenizer.from_file(path).encode, most

    @staticmethod
    def at(path: str) -> WordIds:
        if path not in _MADE:
            _MADE[path] = WordIds(path)
        return _MADE[path]

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        """The words whose ids are this one's in a row: itself, or its letters in lower case and the marks that follow."""
        stem = word.rstrip(b".,;:!?")
        low = stem.lower()
        if (stem != word or low != stem) and letters_only(stem):
            return (low, word[len(stem) :]) if stem != word else (low,)
        return (word,)

    def learn(self, words: set[bytes]) -> None:
        """Ids of new words, many in one call of the tokenizer."""
        parts = {w: self._parts(w) for w in words}
        unknown = [w for w in set().union(*parts.values()) if w not in self]
        for at in range(0, len(unknown), 1024):
            some = unknown[at : at + 1024]
            self.update(zip(some, encoded(self.encode, some, "<u4"), strict=True))
        for w, p in parts.items():
            if w is not p[0]:
                self[w] = self[p[0]] + self[p[1]] if len(p) > 1 else self[p[0]]

    def of_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts at a time: new words are entered once for all."""
        words = [t.split() for t in texts]
        found = [list(map(self.get, w)) for w in words]
        new = {w for ws, got in zip(words, found, strict=True) if None in got for w, x in zip(ws, got, strict=True) if x is None}
        if len(self) + len(new) > self.most:
            self.clear()
        self.learn(new)
        return [b"".join([self[w] if x is None else x for w, x in zip(ws, got, strict=True)] if None in got else got) for ws, got in zip(words, found, strict=True)]

    def __missing__(self, word: bytes) -> bytes:
        self.learn({word})
        return self[word]

    def of(self, text: bytes) -> bytes:
        return self.of_all([text])[0]


class WordTable:
    """Numbers for lower-case words, with each word's hash, ids (16 bits each) and what else a caller keeps per word; emptied like WordIds."""

    def __init__(self, path: str, keep, most: int = 400_000, most_parts: int = 700_000):
        """keep(hashes) gives a row of numbers for each new word."""
        from tokenizers import Tokenizer

        self.encode, self.keep, self.most, self.most_parts = Tokenizer.from_file(path).encode, keep, most, most_parts
        self.ids = _PARTS.setdefault(path, {})  # a worker process keeps these from task to task
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.start, self.flat, self.kept = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint16), None

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        stem = word.rstrip(b".,;:!?")
        return (stem, word[len(stem) :]) if stem != word and letters_only(stem) else (word,)

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            self.ids.update(zip(some, encoded(self.encode, some, "<u2"), strict=True))

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The word numbers of some texts at a time (small ones together: new words are entered once for all)."""
        if len(self.number) > self.most:
            self.clear()
        words = [t.lower().split() for t in texts]
        new = list(set().union(*words).difference(self.number))
        if new:
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            parts = [self._parts(w) for w in new]
            unknown = set().union(*parts)
            if len(self.ids) > self.most_parts:
                self.ids.clear()
            self._learn(list(unknown.difference(self.ids)))
            known = self.ids.__getitem__
            ids = [known(p[0]) if len(p) == 1 else known(p[0]) + known(p[1]) for p in parts]
            self.hash = np.concatenate((self.hash, h))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum([len(i) // 2 for i in ids])))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u2")))
            more = self.keep(h)
            self.kept = more if self.kept is None else np.concatenate((self.kept, more))
        get = self.number.__getitem__
        return [np.fromiter(map(get, w), np.int64, len(w)) for w in words]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        begin = self.start[numbers]
        n = self.start[numbers + 1] - begin
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(begin - (ends - n), n) + np.arange(total)]
