"""Sessions and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its query's shuffle files go as soon as it has run (the plan runs once), and rows go to Python in batches that
#: stay small where rows are whole texts.
WHILE_CUT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


def local_session(cpus: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is missing, a temporary one on a local master; a cluster must name a folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside, and are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, the plan runs once,
    and lost executors cost no recomputation, since the files are on storage that all executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, WHILE_CUT):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete cut tables of which all readers have run."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        jvm.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal(rows: DataFrame, *by: str, parts: int | None = None, most: int = 20_000) -> DataFrame:
    """Rows dealt anew by the hash of columns, for inputs of few files: into parts, or into as many more as keep a part at some `most` rows, so that no task grows with the input."""
    parts = max(parts or rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(parts, *by)
