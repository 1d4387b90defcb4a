"""Published entries: numbering, front matter, markdown files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.frames import stash
from sessionloom.operators.state import atomic_write_exclusive

#: The front matter's fields in their order (fixed values: the order is the contract).
FIELDS = ("id", "title", "project", "category", "source_type", "session_id", "message_range", "source_model", "extracted_at", "needs_manual_review", "review_reason", "tags", "entities")
OPTIONAL = ("session_id", "message_range", "source_model", "review_reason")
RETRIES = 1024


def max_number(names: DataFrame) -> int:
    """The largest N of names N-*.md, 0 if there is none."""
    name = F.col("name")
    number = F.substring_index(name, "-", 1).try_cast("int")
    return names.where(name.endswith(".md") & (F.instr(name, "-") > 0)).agg(F.coalesce(F.max(number), F.lit(0)).alias("n")).first()["n"]


def numbered(entries: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Adds number: consecutive in the given order, after `start`.

    A global row_number would gather every row in one task. Rows are range-partitioned by the order instead, numbered
    inside each partition, and offset by the counts of the partitions before (one small row a partition).
    """
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # written once: the ranges are sampled, so a second evaluation could draw them elsewhere
    inner = stash(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    counts = inner.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return inner.join(before, "_part").withColumn("number", F.col("_at") + F.coalesce("_before", F.lit(0)) + F.lit(start)).drop("_part", "_at", "_before")


def front_matter(entries: DataFrame) -> DataFrame:
    """(id, front matter as JSON in field order); absent options are left out, as are nulls."""
    one = entries.select(
        "id", "title", "project", "category", F.col("source.source_type").alias("source_type"), F.col("source.session_id").alias("session_id"),
        F.when(F.col("source.message_range").isNotNull(), F.array("source.message_range.start", "source.message_range.end")).alias("message_range"),
        F.date_format("source.extracted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"), "needs_manual_review", "review_reason", "tags", "entities",
    )
    return one.select("id", F.to_json(F.struct(*(f for f in FIELDS if f != "source_model"))).alias("front_matter"))


def uuid7() -> str:
    """Time-ordered random identity."""
    raw = (int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10))) & ~(0xF << 76) & ~(0x3 << 62) | 0x7 << 76 | 0x2 << 62
    return str(uuid.UUID(int=raw))


def _yaml(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return value if re.fullmatch(r"[A-Za-z](?:[\w ./-]*[\w.])?", value) and value.lower() not in ("true", "false", "null", "yes", "no", "on", "off", "y", "n") else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False)


def markdown(entry: dict) -> str:
    """The file of an entry: front matter between dashes, a blank line, the body."""
    lines = []
    for field in FIELDS:
        value = entry.get(field)
        if value is None and field in OPTIONAL:
            continue
        if field in ("tags", "message_range") and value:
            lines += [f"{field}:", *(f"- {_yaml(x)}" for x in value)]
        else:
            lines.append(f"{field}: {_yaml(value)}")
    return "---\n" + "\n".join(lines) + f"\n---\n\n{entry['body']}\n"


def slug(title: str) -> str:
    """As functions.text.slug, for the sink."""
    out = re.sub(r"[\W_]+", "-", title.lower()).strip("-")
    while len(out.encode()) > 60:
        out = out[:-1]
    return out.rstrip("-")


def run_id(draft_id: str, run: str, millis: int) -> str:
    """A time-ordered identity that a repeated task gives again."""
    noise = int.from_bytes(hashlib.blake2b(f"{run}/{draft_id}".encode(), digest_size=10).digest())
    raw = (millis << 80 | noise) & ~(0xF << 76) & ~(0x3 << 62) | 0x7 << 76 | 0x2 << 62
    return str(uuid.UUID(int=raw))


def published(entries: DataFrame, folder: str, total: int) -> DataFrame:
    """(draft_id, path): every entry as a file under its number, written where its row is.

    A number that another run has taken is skipped in steps of `total`, so the tasks' numbers never meet; a file that
    holds this entry's id was written by an earlier attempt of the task and counts.
    """
    kinds = dict(entries.dtypes)
    columns = [c for c in ("draft_id", "number", *FIELDS, "body") if c in kinds]

    def run(batches):
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                number = row.pop("number")
                data = markdown(row).encode()
                for k in range(RETRIES):
                    path = os.path.join(folder, f"{number + k * total:03d}-{slug(row['title'])}.md")
                    if atomic_write_exclusive(path, data):
                        break
                    with open(path, "rb") as f:
                        if f.readline() == b"---\n" and f.readline() == f"id: {_yaml(row['id'])}\n".encode():
                            break
                else:
                    raise FileExistsError("no free entry number")
                done.append((row["draft_id"], path))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["draft_id", "path"])

    return entries.select(*columns).mapInArrow(run, "draft_id string, path string")


def publish(entries: list[dict], folder: str, number: int) -> tuple[list[str], int]:
    """Write each entry under the next free number; a taken one is skipped, at most RETRIES times. (paths, last number).

    Files are the sink of small reviewed batches; large outputs are written as a table.
    """
    paths = []
    for entry in entries:
        for _ in range(RETRIES):
            number += 1
            path = os.path.join(folder, f"{number:03d}-{slug(entry['title'])}.md")
            if atomic_write_exclusive(path, markdown(entry).encode()):
                paths.append(path)
                break
        else:
            raise FileExistsError("no free entry number")
    return paths, number
