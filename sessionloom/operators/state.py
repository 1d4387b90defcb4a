"""Incremental state: freshness by content and configuration, upserts, and safe files."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "session_key"
#: What must be equal for a session to be fresh.
FINGERPRINT = ("file_sha256", "extractor_prompt_sha256", "tokeniser_prompt_sha256", "extractor_backend_signature", "tokeniser_backend_signature", "version")
STATE = "session_key string, file_sha256 string, size_bytes long, mtime string, extractor_prompt_sha256 string, tokeniser_prompt_sha256 string, extractor_backend_signature string, tokeniser_backend_signature string, version string, extracted_entry_files array<string>"


def stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files whose state is missing or differs in any of the six fingerprints; old states lack signatures ('')."""
    known = state.select(KEY, *(F.coalesce(F.col(c), F.lit("")).alias(c) if "signature" in c else F.col(c) for c in FINGERPRINT))
    return files.join(known, [KEY, *FINGERPRINT], "left_anti")


def upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """New records replace those of the same key."""
    return state.join(new.select(KEY), KEY, "left_anti").unionByName(new)


def append_decision(files: DataFrame, state: DataFrame) -> DataFrame:
    """skip, incremental (grown, the old part unchanged) or full, per file with content."""
    old = state.select(KEY, F.col("file_sha256").alias("old_sha"), F.col("size_bytes").alias("old_size"))
    prefix = F.sha2(F.substring(F.encode("content", "UTF-8"), F.lit(1), F.col("old_size").cast("int")), 256)
    decision = F.when(F.col("old_sha") == F.col("file_sha256"), "skip").when((F.octet_length("content") > F.col("old_size")) & (prefix == F.col("old_sha")), "incremental").otherwise("full")
    return files.join(old, KEY, "left").select(KEY, decision.alias("decision"))


def sidecar(path: str) -> str:
    """A temporary name beside the target: at most 200 bytes of the name, whole characters, and a nonce."""
    folder, name = os.path.split(path)
    while len(name.encode()) > 200:
        name = name[:-1]
    return os.path.join(folder, f".{name}.tmp.{os.getpid()}.{uuid.uuid4().hex}")


def atomic_write(path: str, data: bytes) -> None:
    """Write beside, then rename over: readers see the old or the new file, never a part."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    side = sidecar(path)
    try:
        with open(side, "wb") as f:
            f.write(data)
        os.replace(side, path)
    finally:
        if os.path.exists(side):
            os.unlink(side)


def atomic_write_exclusive(path: str, data: bytes) -> bool:
    """As above, but never over an existing file: False if there is one (one of many racing writers wins)."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    side = sidecar(path)
    try:
        with open(side, "wb") as f:
            f.write(data)
        try:
            os.link(side, path)
        except FileExistsError:
            return False
        return True
    finally:
        if os.path.exists(side):
            os.unlink(side)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A state file; missing or blank is empty, bad JSON is an error."""
    text = open(path).read() if os.path.exists(path) else ""
    data = json.loads(text) if text.strip() else {}
    names = [c.split()[0] for c in STATE.split(", ")]
    rows = [tuple(key if c == KEY else record.get(c, [] if c == "extracted_entry_files" else "" if "signature" in c else None) for c in names) for key, record in sorted(data.get("sessions", {}).items())]
    return spark.createDataFrame(rows, STATE)


def save(state: DataFrame, path: str) -> None:
    """Export for the file form; a large state stays a parquet table."""
    sessions = {r[KEY]: {k: v for k, v in r.asDict().items() if k != KEY} for r in state.collect()}
    atomic_write(path, json.dumps({"sessions": dict(sorted(sessions.items()))}, indent=2).encode())
