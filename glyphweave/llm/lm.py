"""Language-model scoring: a causal self-attention model in numpy on subword ids.

A text is its words' subword ids (public tokenizer, path as a parameter) and an end id. The model is one causal
attention layer of width WIDTH over windows of CONTEXT ids, with position vectors and a residual; it gives a distribution over
CLASSES classes of ids, and within its class an id has its corpus frequency: together a proper distribution over
all ids. Windows overlap by CONTEXT - STRIDE ids, which a later window only reads, so each id is scored once and with
context; windows of many texts go through one batched masked attention.

What is learnt from the corpus: word counts (for the base score), id counts and classes, and the weights, from all ids of all
training texts: each is the target of one training window, so that training grows with the input. Every partition of the
ids is a trainer that runs Adagrad over its windows from the common weights, batch by batch; the results are averaged in a tree, ROUNDS times,
each round over its share of the windows. A vector of an id is averaged by how often each trainer met the id, all else by windows.

The base score needs counts of all words, of which there is no bound: the HOT most frequent ones (at most a fixed number, by a threshold from a histogram of counts) go to
the tasks, and only the other words' occurrences meet their counts in a join.

Edge cases: null and blank texts are one end token; repeated rows are scored each; a null doc_id counts as empty text for the
checksum (in training); without training texts all counts are 0 and the model is the untrained one; an empty table gives
an empty result; other columns are not read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphweave.llm._tokens import WordTable
from glyphweave.session import cut

CONTEXT, STRIDE, WIDTH, CLASSES = 16, 12, 16, 64
VOCABULARY, END = 49_408, 49_407
ALONE = 40
HOT = 200_000
ROUNDS, BATCH, RATE = 2, 64, 0.1
#: Stands for the end token among the hashes of words.
END_WORD = 7


def start_weights(share: np.ndarray | None = None, seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights; share: of the classes, so that the untrained model is the ids' frequencies."""
    r = np.random.default_rng(seed)
    normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 and s[0] < 1000 else 1)).astype(np.float32)
    return {"E": normal(VOCABULARY, WIDTH) * np.float32(0.3), "P": normal(CONTEXT, WIDTH) * np.float32(0.1), "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, WIDTH), "O": normal(WIDTH, WIDTH) * np.float32(0.5), "U": normal(WIDTH, CLASSES) * np.float32(0.02), "b": np.zeros(CLASSES, np.float32) if share is None else np.log(share).astype(np.float32)}


def packed(w: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32).tobytes()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    like, flat, at, out = start_weights(), np.frombuffer(data, np.float32), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


_MASK = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))


def row_sums(m: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept as an axis: a product with ones is several times as fast as sum() for short rows."""
    return (m.reshape(-1, m.shape[-1]) @ np.ones((m.shape[-1], 1), m.dtype)).reshape(*m.shape[:-1], 1)


def attend(w: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """For windows of ids: the output of the layer, and what training needs of the way there. Scores are bounded, so no maximum is taken off."""
    x = w["E"][ids] + w["P"]
    q, k, v = np.split(x @ np.hstack((w["Q"], w["K"], w["V"])), 3, -1)
    s = np.matmul(q * np.float32(WIDTH**-0.5), k.transpose(0, 2, 1))
    np.clip(s, -30, 30, out=s)
    np.exp(s, out=s)
    s *= _MASK
    s /= row_sums(s)
    o = np.matmul(s, v)
    return x + o @ w["O"], x, q, k, v, s, o


def class_log(w: dict[str, np.ndarray], y: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the class probability of each target class, for rows of y."""
    z = y @ w["U"]
    z += w["b"]
    np.clip(z, -30, 30, out=z)
    hit = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return hit - np.log(row_sums(z)[:, 0])


class Trainer:
    """Adagrad over windows, whose number need not be known: weights, and how often each id was met."""

    def __init__(self, w: dict[str, np.ndarray], classes: np.ndarray):
        self.w, self.classes = w, classes
        self.grown = {k: np.full(v.shape if k != "E" else (len(v), 1), 1e-3, np.float32) for k, v in w.items()}
        self.met, self.windows = np.zeros(len(w["E"]), np.int64), 0

    def step(self, source: np.ndarray, target: np.ndarray, real: np.ndarray) -> None:
        """One batch: windows of ids, the ids that follow them, and which of these are no padding."""
        w, grown = self.w, self.grown
        y, x, q, k, v, s, o = attend(w, source)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        z = flat(y) @ w["U"]
        z += w["b"]
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        z /= row_sums(z)
        z[np.arange(len(z)), self.classes[target.ravel()]] -= 1
        z *= (real.ravel() / np.float32(max(1, real.sum())))[:, None]
        g = {"U": flat(y).T @ z, "b": z.sum(0)}
        dy = (z @ w["U"].T).reshape(y.shape)
        g["O"] = flat(o).T @ flat(dy)
        do = dy @ w["O"].T
        ds = np.matmul(do, v.transpose(0, 2, 1))
        dv = np.matmul(s.transpose(0, 2, 1), do)
        ds -= row_sums(ds * s)
        ds *= s
        ds *= np.float32(WIDTH**-0.5)
        back = np.concatenate((np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), dv), -1)
        g["Q"], g["K"], g["V"] = np.split(flat(x).T @ flat(back), 3, -1)
        dx = dy + back @ np.hstack((w["Q"], w["K"], w["V"])).T
        g["P"] = dx.sum(0)
        for name, d in g.items():
            grown[name] += d * d
            w[name] -= np.float32(RATE) * d / np.sqrt(grown[name])
        which = source.ravel().astype(np.uint16)
        order = np.argsort(which, kind="stable")
        which = which[order]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        d = np.add.reduceat(flat(dx)[order], first)
        rows = which[first]
        grown["E"][rows] += (d * d).mean(-1, keepdims=True)
        w["E"][rows] -= np.float32(RATE) * d / np.sqrt(grown["E"][rows])
        self.met[rows] += np.diff(np.append(first, len(which)))
        self.windows += len(source)


def windows_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, real) over texts of ids: every id and the end of each text are the target of one window; short windows are padded."""
    n = np.array([len(t) + 1 for t in texts], np.int64)
    line = np.concatenate([np.concatenate((np.array([END]), t)) for t in texts] + [np.full(1, END)]).astype(np.int64)
    begin, parts = np.cumsum(n) - n, -(-n // CONTEXT)
    owner = np.repeat(np.arange(len(n)), parts)
    at = (begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * CONTEXT)[:, None] + np.arange(CONTEXT)
    real = at < (begin + n)[owner][:, None]
    at = np.where(real, at, 0)
    return np.where(real, line[at], END), line[at + 1], real


def train(w: dict[str, np.ndarray], texts: list[np.ndarray], classes: np.ndarray) -> dict[str, np.ndarray]:
    """One pass over the windows of texts."""
    trainer = Trainer(w, classes)
    source, target, real = windows_of(texts)
    for at in range(0, len(source), BATCH):
        part = slice(at, at + BATCH)
        trainer.step(source[part], target[part], real[part])
    return trainer.w


def score_texts(w: dict[str, np.ndarray], classes: np.ndarray, within: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text (ids without the end id)."""
    n = np.array([len(t) + 1 for t in texts], np.int64)  # targets: the ids and the end
    line = np.concatenate([np.concatenate((np.array([END]), t)) for t in texts] + [np.array([END])]).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    # target of the input at i is line[i + 1]: for a text's last input that is the next text's leading end id
    cost = np.zeros(len(line) - 1)
    later = np.maximum(0, -(-(n - CONTEXT) // STRIDE))
    owner = np.repeat(np.arange(len(n)), later)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(later) - later, later) + 1
    for starts, stop, skip in ((begin, begin + n, 0), (begin[owner] + nth * STRIDE, (begin + n)[owner], CONTEXT - STRIDE)):
        for a in range(0, len(starts), 1024):
            pos = starts[a : a + 1024, None] + np.arange(CONTEXT)
            good = pos < stop[a : a + 1024, None]
            pos = np.where(good, pos, 0)
            y = attend(w, np.where(good, line[pos], END))[0][:, skip:]
            at = pos[:, skip:][good[:, skip:]]
            target = line[at + 1]
            cost[at] = class_log(w, y[good[:, skip:]], classes[target])
    cost = cost / np.log(10) + within[line[1:]]
    return np.add.reduceat(cost, begin) if len(n) else np.zeros(0)


def make_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log10 share of the id in its class): the ALONE commonest ids have a class each, the rest share classes of equal weight."""
    order = np.argsort(-counts, kind="stable")
    c = counts[order] + 0.5
    rest = np.cumsum(c[ALONE:])
    cls = np.empty(len(counts), np.int64)
    cls[order[:ALONE]] = np.arange(ALONE)
    cls[order[ALONE:]] = ALONE + np.minimum((rest - c[ALONE:] / 2) / rest[-1] * (CLASSES - ALONE), CLASSES - ALONE - 1).astype(np.int64)
    total = np.bincount(cls, counts + 0.5, CLASSES)
    return cls, np.log10((counts + 0.5) / total[cls])


def _count_words(docs: DataFrame) -> DataFrame:
    """(h, n) over the training texts; the end token under END_WORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        texts = 0

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, tally), np.uint64, len(tally)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, END_WORD)), pa.array(np.append(np.fromiter(tally.values(), np.int64, len(tally)), texts))], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0):
                tally.update((text.as_py() or b"").lower().split())
                texts += 1
                if len(tally) > 600_000:
                    yield out()
                    tally.clear()
                    texts = 0
        yield out()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")).where("c > 0")


def _read(docs: DataFrame, tokenizer: str, hot: bytes) -> DataFrame:
    """A row for each text: its ids, the base score's part from hot words, and its other words; and rows of id counts (row null)."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_hot", "s_hot", "rare", "rare_n", "ids"]
    shape = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_hot long, s_hot double, rare array<long>, rare_n array<int>, ids binary"
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # HOT * 16 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.frombuffer(sent.value, np.int64).reshape(2, -1)
        keys, logs = table[0].view(np.uint64), np.append(np.log10(table[1] + 0.5), np.nan)

        def known(h: np.ndarray) -> np.ndarray:
            """log10 of a hot word's count, nan for others."""
            at = np.searchsorted(keys, h)
            return logs[np.where(np.append(keys, np.uint64(0))[at] == h, at, len(keys))]

        words, row, tally = WordTable(tokenizer, known), TaskContext.get().partitionId() << 36, np.zeros(VOCABULARY, np.int64)
        end = float(known(np.array([END_WORD], np.uint64))[0])
        types = (pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                batch = whole.slice(part, 256)
                rows = []
                raws = [x.as_py() or b"" for x in batch.column(2)]
                for raw, numbers, held in zip(raws, words.numbers(raws), batch.column(1).to_pylist(), strict=True):
                    log = words.kept[numbers] if len(numbers) else np.zeros(0)
                    other = np.isnan(log)
                    rare, n = np.unique(words.hash[numbers[other]] if len(numbers) else np.zeros(0, np.uint64), return_counts=True)
                    n_hot, s_hot = int((~other).sum()), float(log[~other].sum())
                    if np.isnan(end):
                        rare, n = np.append(rare, np.uint64(END_WORD)), np.append(n, 1)
                    else:
                        n_hot, s_hot = n_hot + 1, s_hot + end
                    ids = words.ids_of(numbers)
                    if not held:
                        tally += np.bincount(ids, minlength=VOCABULARY)
                        tally[END] += 1
                    rows.append((row, held, len(numbers) + 1, n_hot, s_hot, rare.view(np.int64), n.astype(np.int32), ids.tobytes()))
                    row += 1
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                arrays = [pa.array(list(c), t) for c, t in zip(cols, [t for i, t in enumerate(types) if i != 1], strict=True)]
                yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), *arrays[1:]], names=names)
        got = np.flatnonzero(tally)
        blank = [pa.nulls(1, t) for t in types if t is not None]
        first = pa.nulls(1, id_type)
        counts = [pa.array([got.tolist()], pa.list_(pa.int64())), pa.array([tally[got].astype(np.int32).tolist()], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([blank[0], first, *blank[1:5], *counts, *blank[7:]], names=names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, shape)


TRAINED = "trainer long, windows long, met binary, weights binary"


def _mean(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    """(windows, met, weights) of several trainers as one; ids that none met keep their vector."""
    total, met, dense, ids = 0, 0, None, 0
    for n, seen, weights in parts:
        w, m = unpacked(weights), np.frombuffer(seen, np.int64)
        ids = ids + w.pop("E").astype(np.float64) * np.maximum(m, 1e-9)[:, None]
        total, met = total + n, met + m
        dense = {k: v.astype(np.float64) * n + (dense[k] if dense else 0) for k, v in w.items()}
    floor = sum(np.maximum(np.frombuffer(seen, np.int64), 1e-9) for _, seen, _ in parts)
    out = {k: v / max(total, 1) for k, v in dense.items()} | {"E": ids / floor[:, None]}
    return total, met.astype(np.int64).tobytes(), packed(out)


def _average(rows: DataFrame, fan: int = 16) -> bytes:
    """The trainers' weights as one, fan rows at a time."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n, met, weights = _mean(list(zip(pdf["windows"].tolist(), pdf["met"], pdf["weights"], strict=True)))
        return pd.DataFrame({"trainer": [int(pdf["trainer"].min()) // fan], "windows": [n], "met": [met], "weights": [weights]})

    left = rows.count()
    while left > 1:
        rows = cut(rows.groupBy(F.floor(F.col("trainer") / fan).alias("g")).applyInPandas(mean, TRAINED))
        left = rows.count()
    found = rows.take(1)
    return bytes(found[0].weights) if found else b""


def fit(seen: DataFrame, classes: np.ndarray, tally: np.ndarray) -> bytes:
    """Weights after ROUNDS of training and averaging over the ids of seen (held_out, ids)."""
    spark = seen.sparkSession
    share = np.bincount(classes, tally + 0.5, CLASSES)
    weights = packed(start_weights(share / share.sum()))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((weights, classes))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            data, cls = sent.value
            trainer = Trainer(unpacked(data), cls)
            for batch in batches:
                ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(0)]
                ends = np.cumsum([len(x) for x in ids]) // 200_000  # some texts at a time, so that memory is bounded by a batch's or a text's ids
                for k in np.unique(ends):
                    source, target, real = windows_of([ids[i] for i in np.flatnonzero(ends == k)])
                    mine = np.random.default_rng(int(k)).permutation(len(source))
                    mine = mine[mine % ROUNDS == turn]
                    for at in range(0, len(mine), BATCH):
                        part = mine[at : at + BATCH]
                        trainer.step(source[part], target[part], real[part])
            if trainer.windows:
                out = [[TaskContext.get().partitionId()], [trainer.windows], [trainer.met.tobytes()], [packed(trainer.w)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["trainer", "windows", "met", "weights"])

        weights = _average(cut(seen.where("not held_out").select("ids").mapInArrow(learn, TRAINED))) or weights
    return weights


def _most_frequent(counts: DataFrame) -> pd.DataFrame:
    """(h, c) of the most frequent words, HOT at most: those above a count that a histogram (exact up to 4096, by sixteenths of a power of two beyond) puts at HOT words."""
    level = F.when(F.col("c") < 4096, F.col("c").cast("int")).otherwise((4096 + F.floor(16 * F.log2(F.col("c") / 4096))).cast("int"))
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).toPandas()  # some thousand rows
    fits = bins[bins["n"].cumsum() <= HOT]
    least = int(fits["least"].min()) if len(fits) else np.iinfo(np.int64).max
    return counts.where(F.col("c") >= least).select("h", "c").toPandas()


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    docs = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = cut(_count_words(docs))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = _most_frequent(counts)
    keys = hot["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    table = np.stack((keys[order].view(np.int64), hot["c"].to_numpy(np.int64)[order]))
    seen = cut(_read(docs, tokenizer, table.tobytes()))
    texts = seen.where("row is not null")
    sums = seen.where("row is null").select(F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).groupBy(F.col("x.rare").alias("id")).agg(F.sum("x.rare_n").alias("n")).toPandas()
    tally = np.zeros(VOCABULARY)
    tally[sums["id"].to_numpy(np.int64)] = sums["n"]
    classes, within = make_classes(tally)
    sent = spark.sparkContext.broadcast((fit(texts, classes, tally), classes, within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cls, inside = sent.value
        w = unpacked(weights)
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)]
            ends = np.cumsum([len(x) for x in ids]) // 200_000  # texts by the batch, so that memory is bounded by a batch's or a text's ids
            got = [score_texts(w, cls, inside, [ids[i] for i in np.flatnonzero(ends == k)]) for k in np.unique(ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["row", "score"])

    scored = texts.select("row", "ids").mapInArrow(run, "row long, score double")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("n"))
    met = rare.join(counts, "h").groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("s_rare"))
    least, room = float(np.log10(0.5)), float(np.log10(total + 0.5 * (kinds + 1)))
    base = F.col("s_hot") + (F.col("n_tokens") - F.col("n_hot")) * least + F.coalesce("s_rare", F.lit(0.0)) - F.col("n_tokens") * room
    done = texts.select("row", "doc_id", "held_out", "n_tokens", "n_hot", "s_hot").join(met, "row", "left").join(scored, "row")
    return done.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
