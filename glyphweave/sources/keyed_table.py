"""K1, K2 at any size: a table of one row a key, in hash buckets under a manifest.

A commit writes the buckets that its keys fall into, beside all others, and then one new manifest, a small file that must not exist yet. So bytes
written follow the batch; a reader sees one version, whole; a writer that dies leaves nothing that a manifest names; and of two writers one
wins, and the other puts its buckets on top of the new version: as they are if the winner left those buckets alone, else worked out
again. Old versions stay readable until vacuum().

Buckets are dealt by xxhash64 of the key. Their number is set when the table is made: take it so that a bucket is some hundred MB.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glyphweave.session import cut, release
from glyphweave.sources import shared_files
from glyphweave.sources.ingest import upsert

BUCKET = "__bucket"


class KeyedTable:
    """A table at path. make() creates it, or opens it if it is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def make(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str], version: str, buckets: int = 64) -> KeyedTable:
        """key: columns that name a row; version: the column that says which row of a key is newest. What is there already keeps its own settings."""
        clash = [c for c in schema.names if c.lower() == BUCKET]
        if clash or missing(schema, [*key, version]):
            raise ValueError(f"columns {clash or missing(schema, [*key, version])} can't be used")
        found = cls(spark, path)
        if not found.versions():
            found._switch({"version": 0, "schema": schema.json(), "key": key, "order": version, "buckets": buckets, "files": {}})
        return found

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in shared_files.names(self.spark, f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"{self.path} has no version {'' if version is None else version}")
        return shared_files.load(self.spark, f"{self.path}/manifest/v{known[-1] if version is None else version}.json")

    def _switch(self, state: dict) -> bool:
        return shared_files.put_new(self.spark, f"{self.path}/manifest/v{state['version']}.json", state)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest or a named version. Every row that append() added stands for itself."""
        state = self.state(version)
        return self._rows(state, list(state["files"]))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        state = self.state()
        wanted = keys.select(*state["key"]).distinct()
        return self._rows(state, self._touched(self._dealt(wanted, state))).join(wanted, state["key"], "left_semi")

    def _rows(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/{p}" for b in buckets for p in state["files"].get(b, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["key"]), F.lit(state["buckets"]))

    def _dealt(self, rows: DataFrame, state: dict) -> DataFrame:
        return rows.withColumn(BUCKET, self._bucket(state))

    @staticmethod
    def _touched(dealt: DataFrame) -> list[str]:
        """Names of buckets, as many as the table has at most."""
        return [str(r[0]) for r in dealt.select(BUCKET).distinct().orderBy(BUCKET).collect()]

    def _write(self, dealt: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        # buckets are cut at the advised size and small ones share a task, by adaptive execution
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, new: DataFrame, attempts: int = 50) -> int:
        """The newest row of each key stays, new ones win ties; the version that has it. A batch put in twice changes nothing."""
        state = self.state()
        rows = new.select(*T.StructType.fromJson(json.loads(state["schema"])).names)
        batch = cut(self._dealt(upsert(rows.limit(0), rows, state["key"], state["order"]), state))
        touched = self._touched(batch)
        folder = base = None
        try:
            for _ in range(attempts if touched else 0):
                if base is None or any(state["files"].get(b) != base["files"].get(b) for b in touched):
                    if folder:
                        shared_files.delete(self.spark, f"{self.path}/{folder}")
                    base = state
                    folder = self._write(self._dealt(upsert(self._rows(base, touched), batch.drop(BUCKET), base["key"], base["order"]), base))
                files = state["files"] | {b: [f"{folder}/{BUCKET}={b}"] for b in touched}
                if self._switch(state | {"version": state["version"] + 1, "files": files}):
                    return state["version"] + 1
                state = self.state()
        finally:
            release(batch)
        if not touched:
            return state["version"]
        shared_files.delete(self.spark, f"{self.path}/{folder}")
        raise RuntimeError(f"lost to other writers {attempts} times")

    def append(self, rows: DataFrame, attempts: int = 50) -> int:
        """K2: rows are added as they are, and nothing is read or rewritten."""
        state = self.state()
        dealt = cut(self._dealt(rows, state))
        touched = self._touched(dealt)
        folder = self._write(dealt) if touched else None
        release(dealt)
        for _ in range(attempts if touched else 0):
            files = state["files"] | {b: [*state["files"].get(b, []), f"{folder}/{BUCKET}={b}"] for b in touched}
            if self._switch(state | {"version": state["version"] + 1, "files": files}):
                return state["version"] + 1
            state = self.state()
        if not touched:
            return state["version"]
        shared_files.delete(self.spark, f"{self.path}/{folder}")
        raise RuntimeError(f"lost to other writers {attempts} times")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the newest `keep` versions, and folders that none of these names; their names. Not for use while others write."""
        known = self.versions()
        for v in known[:-keep]:
            shared_files.delete(self.spark, f"{self.path}/manifest/v{v}.json")
        used = {p.split("/")[1] for v in known[-keep:] for paths in self.state(v)["files"].values() for p in paths}
        lost = [n for n in shared_files.names(self.spark, f"{self.path}/data") if n not in used]
        for n in lost:
            shared_files.delete(self.spark, f"{self.path}/data/{n}")
        return lost


def missing(schema: T.StructType, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in schema.names]
