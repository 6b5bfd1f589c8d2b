"""Secret scans with an incremental blob ledger.

A text is addressed by its SHA-256. The ledger is a table of (blob, rules) pairs that were scanned, and the spans found
in each. A scan lists the paths' blobs, takes those pairs of blob and rule version that the ledger lacks, reads one text of
each such blob, scans it once, and appends; findings are then joined back to every path that has the blob, in
any version. Paths with equal content, however many, cost one scan, and a second run over the same history scans nothing.

Scanning uses regular expressions over whole texts; base rules are fixed, and a rule version adds kinds of its own.

Edge cases: null text is the empty blob; repeated rows are paths of one blob; kinds and spans are in order of start, then
kind as listed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphweave.session import cut, shared_dir

#: Fixed by the contract.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Rule versions: what the method adds to the base rules, by kind.
RULES = {
    "base": (),
    "keys-1": (
        ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
        ("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), 0, 0),
        ("hosted_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 0),
        ("url_login", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"), 0, 0),
        ("upper_hex", re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,}(?![0-9A-Za-z])"), 0, 0),
    ),
}
KINDS = [k for k, *_ in BASE] + [k for rules in RULES.values() for k, *_ in rules]
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:int,kind:int,end:int>>"
EMPTY = hashlib.sha256(b"").hexdigest()


def scan(text: str, rules: tuple) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each match that is long enough, leftmost and non-overlapping per kind."""
    found = []
    for kind, pattern, group, least in rules:
        found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, rules, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            base = scan(text, BASE) if rules == "base" else []
            spans = base + scan(text, RULES[rules])
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            digest = hashlib.sha256(written(base).encode()).hexdigest() if base else EMPTY
            rows.append((blob, rules, *n, digest, [{"start": s, "kind": k, "end": e} for s, k, e in sorted(spans)]))
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=[f.split()[0] for f in LEDGER.replace("struct<start:int,kind:int,end:int>", "").split(", ")])


class BlobLedger:
    """A table of scanned (blob, rules) pairs and their findings, in a folder that all executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else self.spark.createDataFrame([], LEDGER)

    def update(self, history: DataFrame, paths: DataFrame, rules: tuple[str, ...]) -> None:
        """Scan what history (doc_id, text) holds and the ledger lacks; paths: (doc_id, blob) of history."""
        wanted = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")).select("blob", F.col("first.doc_id").alias("__id"))
        wanted = wanted.withColumn("rules", F.explode(F.array(*map(F.lit, rules)))).join(self.table().select("blob", "rules"), ["blob", "rules"], "left_anti")
        wanted = wanted.groupBy("blob", "__id").agg(F.array_sort(F.collect_set("rules")).alias("rules"))  # rule versions are few
        text = F.coalesce("text", F.lit(""))
        texts = history.select("doc_id", text.alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id"))).where(F.sha2("text", 256) == F.col("blob"))
        texts = texts.select("blob", F.explode("rules").alias("rules"), "text")
        texts.mapInArrow(_scan_blobs, LEDGER).write.mode("append").parquet(self.path)


def scan_history(history: DataFrame, ledger: BlobLedger, rules: tuple[str, ...] = ("base", "keys-1")) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob), one row for each row of history."""
    paths = cut(history.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")))
    ledger.update(history, paths, rules)
    known = ledger.table().where(F.col("rules").isin(*rules)).dropDuplicates(["blob", "rules"])
    found = known.groupBy("blob").agg(
        *[F.sum(c).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.max(F.when(F.col("rules") == "base", F.col("base_sha256"))).alias("base_sha256"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    kinds = F.array(*map(F.lit, KINDS))
    line = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    return paths.join(found, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", line.alias("spans"), "blob")


def fresh_ledger(spark) -> BlobLedger:
    import uuid

    return BlobLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
