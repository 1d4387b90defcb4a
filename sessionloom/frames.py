"""Small DataFrame helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings that results depend on: times are UTC, joins adapt to skew."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data folder; column pruning and filters reach the scan."""
    return prepare(spark).read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs of fewer splits than cores (one small file); larger inputs pass unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Map each Arrow batch to columns named as in the DDL schema; batches that give None are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; without the setting a temporary one, but only where all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where and (context.master != "local" and not context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), f"loom-{uuid.uuid4().hex}"))
    return where or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable, shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_STASHED: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete this session's stashed tables; results that were built on them can no longer be read."""
    jvm, done = spark.sparkContext._jvm, 0
    while _STASHED:
        path = jvm.org.apache.hadoop.fs.Path(_STASHED.pop())
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done


def stash(df: DataFrame) -> DataFrame:
    """Write a result once to the shared checkpoint folder and read it back: no lineage, and read as often as needed."""
    where = f"{checkpoint_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(where)
    _STASHED.append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


BLOCK = 8192


def numbered_in(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... by `order` (whole numbers, each once) inside each group.

    Rows are numbered in blocks of BLOCK values of `order` and offset by the blocks before, so a group of any share of
    the rows is spread over many tasks.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_block").orderBy(order)) - 1)
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(group, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(blocks.drop("_n"), [group, "_block"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_block", "_at", "_before")


UNICODE_SPACE = r"\p{IsWhite_Space}"


def utrim(col):
    """Trim every Unicode blank (Spark's trim strips U+0020 only)."""
    return F.regexp_replace(col, rf"^{UNICODE_SPACE}++|(?<!{UNICODE_SPACE}){UNICODE_SPACE}++$", "")  # linear on long blanks
