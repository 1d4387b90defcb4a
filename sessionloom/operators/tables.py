"""State and registry as tables: a folder of immutable versions and a pointer that is replaced in one step."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from sessionloom.operators.state import atomic_write

CURRENT = "CURRENT"


def _current(folder: str) -> str | None:
    path = os.path.join(folder, CURRENT)
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return f.read().strip() or None


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current version; a missing or blank pointer is an empty table."""
    name = _current(folder)
    return spark.read.schema(schema).parquet(os.path.join(folder, name)) if name else spark.createDataFrame([], schema)


def save(df: DataFrame, folder: str) -> None:
    """Write a new version, then point to it; the version before stays for running readers, older ones go."""
    last, name = _current(folder), f"v-{uuid.uuid4().hex}"
    df.write.parquet(os.path.join(folder, name))
    atomic_write(os.path.join(folder, CURRENT), name.encode())
    for other in os.listdir(folder):
        if other.startswith("v-") and other not in (name, last):
            shutil.rmtree(os.path.join(folder, other), ignore_errors=True)
