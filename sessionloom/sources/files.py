"""File sources: session logs, published markdown, hashes and sizes."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.frames import checkpoint_dir, spread
from sessionloom.functions.text import event_project, one_json, path_project, path_session, text_at
from sessionloom.operators.state import atomic_write
from sessionloom.operators.transcript import is_event_session


def _paths(df: DataFrame) -> DataFrame:
    """Order by path components, not by the raw string."""
    return df.orderBy(F.split("path", "/"))


def session_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, size_bytes, mtime[, content]): one file as it is, or every *.jsonl below a folder outside subagents.

    The content column is read only if asked for, so a listing touches no file's bytes.
    """
    if os.path.isfile(path):
        found = spark.read.format("binaryFile").load(path)
    elif "://" not in path and not os.path.isdir(path):
        raise FileNotFoundError("no such file or folder")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).where(~F.contains("path", F.lit("subagents")))
    columns = [F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    return _paths(found.select(*columns, *(["content"] if content else [])))


def session_key(path: str) -> str:
    """One key for a file however it is reached; URIs stay as they are."""
    return path if "://" in path else os.path.realpath(path)


def write(named: DataFrame) -> str:
    """Writes (name, content) rows as files below a new folder of the shared checkpoint folder; the folder."""
    root = checkpoint_dir(named.sparkSession)
    folder = os.path.join(root.removeprefix("file://"), f"files-{uuid.uuid4().hex}")

    def run(batches):
        n = 0
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                atomic_write(os.path.join(folder, name), content.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    os.makedirs(folder, exist_ok=True)
    named.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def read(files: DataFrame) -> DataFrame:
    """Adds content and error: a file that cannot be read has no content and the error's class; the others go on."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file a batch: files may be large
                row = batch.slice(i, 1)
                content, error = None, None
                try:
                    content = _bytes(row["path"][0].as_py())
                except (OSError, pa.ArrowException) as why:
                    error = type(why).__name__
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "error"])

    schema = ", ".join(f"`{k}` {t}" for k, t in files.dtypes) + ", content binary, error string"
    return spread(files).mapInArrow(run, schema)


def _bytes(path: str) -> bytes:
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def hashed(files: DataFrame) -> DataFrame:
    """Files with content -> with file_sha256 and without the content."""
    return files.withColumn("file_sha256", F.sha2("content", 256)).drop("content")


def stats(files: DataFrame) -> DataFrame:
    """(files, bytes) out of the listing alone."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of every *.md below a folder; a missing folder is empty."""
    if "://" not in folder and not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, raw string")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return _paths(read.select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("value").alias("raw")))


def lines(files: DataFrame) -> DataFrame:
    """Files with content -> (path, line_no, line); carriage returns before line breaks and a last empty line go."""
    text = F.decode("content", "UTF-8")
    split = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
    return files.select("path", F.posexplode(split).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def sniff(file_lines: DataFrame) -> DataFrame:
    """(path, dialect, session_id, project_name) from each file's first line; dialect is null if it is no JSON."""
    v = one_json(F.col("line"))
    first = file_lines.where("line_no = 1").select("path", "line", v.alias("v"))
    meta = (text_at(F.col("v"), "$.type") == "session_meta") & is_event_session(text_at(F.col("v"), "$.payload.originator"), text_at(F.col("v"), "$.payload.source"))
    event = F.coalesce(meta, F.lit(False))
    blank = F.trim("line") == ""
    return first.select(
        "path",
        F.when(F.col("v").isNull() & ~blank, F.lit(None)).when(event, "event").otherwise("plain").alias("dialect"),
        F.when(event, F.coalesce(text_at(F.col("v"), "$.payload.id"), path_session(F.col("path")))).otherwise(path_session(F.col("path"))).alias("session_id"),
        F.when(event, event_project(text_at(F.col("v"), "$.payload.git.repository_url"), text_at(F.col("v"), "$.payload.cwd"))).otherwise(path_project(F.col("path"))).alias("project_name"),
    )


def session_lines(file_lines: DataFrame) -> DataFrame:
    """Lines of event-dialect files as (session_id, line_no, type, payload); bad lines are skipped."""
    v = one_json(F.col("line"))
    return file_lines.join(sniff(file_lines).where("dialect = 'event'").select("path", "session_id"), "path").select("session_id", "line_no", F.get_json_object("line", "$.type").alias("type"), F.get_json_object("line", "$.payload").alias("payload"), v.alias("v")).where("v is not null").drop("v")
