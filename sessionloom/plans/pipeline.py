"""The public operations: plan, mine, validate, stats."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import EngineConfig
from sessionloom.frames import stash
from sessionloom.functions.text import scannable
from sessionloom.operators import backends, entries, registry, state, tables, transcript
from sessionloom.sources import files

EXTRACTOR_PROMPT = """Below is a transcript with labelled blocks. Find the moments in it that are worth telling, each once.
Answer with a JSON array and nothing else; an empty array if there is none. Each element has exactly these fields:
title: at most 80 characters, general, without names, places, companies, paths or anything like a credential
category: one of bikeshedding, comedy, dark-comedy, existential, meta, other, rage, role-reversal, spectacular-failure, wholesome
tags: two to five short labels
quote: the blocks word for word with their labels [HUMAN], [ASSISTANT], [THINKING], [TOOL_INPUT:name] or [TOOL_RESULT:name], blank lines
between them; 2 to 10 turns, tool results as short as they can be. Only the value of a credential is replaced, by [REDACTED_SECRET].
why: one sentence
A quote that does not stand in the transcript is wrong: leave such a moment out."""
TOKENISER_PROMPT = """Below is a draft as a JSON object. Replace everything in it that tells who or where: people, places, organisations, hosts, paths,
addresses, numbers, credentials. A placeholder is #TYPE_NNN#, TYPE in capitals, NNN from 001 for each type; the same thing has
the same placeholder in title, category, tags and body. Everything else stays word for word.
Answer with one JSON object and nothing else: title, category, tags (as many as given, in their order), body (from quote),
entities (placeholder to an object with type and, where they hold, in, of, affiliated_with, service or role naming other placeholders),
needs_review (true where you are not sure), review_reason (why, without the value itself; else null)."""


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Every session file under its canonical key, with its hash or the class of the error that kept it from being read."""
    return files.hashed(files.read(files.session_files(spark, files.session_key(path))))


def _marks(config: EngineConfig) -> dict:
    for backend in (config.extractor, config.tokeniser):
        backend.check()
    return {"extractor_prompt_sha256": _sha(EXTRACTOR_PROMPT), "tokeniser_prompt_sha256": _sha(TOKENISER_PROMPT), "extractor_backend_signature": config.extractor.signature, "tokeniser_backend_signature": config.tokeniser.signature, "version": config.version}


def _stale(spark: SparkSession, listed: DataFrame, config: EngineConfig, marks: dict) -> DataFrame:
    keyed = listed.where("error is null").drop("error").withColumnRenamed("path", "session_key").withColumns({k: F.lit(v) for k, v in marks.items()})
    return state.stale(keyed, tables.load(spark, config.state, state.STATE))


def plan(spark: SparkSession, path: str, config: EngineConfig) -> DataFrame:
    """The work list: files whose content or configuration differs from the recorded state. Nothing is written."""
    marks = _marks(config)
    return _stale(spark, _listed(spark, path), config, marks)


@dataclass
class MineResult:
    entries: DataFrame
    counters: dict[str, int]
    paths: DataFrame


def mine(spark: SparkSession, path: str, config: EngineConfig) -> MineResult:
    """Extract, tokenise, learn, scan, publish, record; one failing file, session or draft does not stop the run.

    Every step is a table: numbers come from range partitions, files are written by the tasks that hold their rows, state
    and registry are versions of tables. Only counters come to the driver.
    """
    run, began = uuid.uuid4().hex, spark.range(1).select(F.current_timestamp().alias("t")).select(F.unix_millis("t"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()
    marks = _marks(config)
    listed = stash(_listed(spark, path))
    work = stash(_stale(spark, listed, config, marks).select("session_key", *state.FINGERPRINT, "size_bytes", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime")))
    content = files.read(work.select(F.col("session_key").alias("path"))).where("error is null")
    rows = files.lines(content)
    kinds = stash(files.sniff(rows))
    lines = files.session_lines(rows)
    events = transcript.transcripts(lines).join(kinds.where("dialect = 'event'").select("path", "session_id", "project_name"), "session_id")
    plain = content.join(kinds.where("dialect = 'plain'"), "path").select("session_id", F.decode("content", "UTF-8").alias("transcript"), "path", "project_name")
    models = transcript.source_models(lines)
    prepared = events.select("session_id", "transcript", "path", "project_name").unionByName(plain.select("session_id", "transcript", "path", "project_name")).join(models, "session_id", "left")
    prepared = stash(prepared.withColumn("source_model", F.struct(F.coalesce("family", F.lit("claude")).alias("family"), "model")).drop("family", "model"))
    extracted = stash(backends.extract(prepared.repartition(config.udf_partitions), config.extractor, EXTRACTOR_PROMPT))
    drafts = extracted.where("ok").select("session_id", F.posexplode("drafts").alias("ix", "d")).select(F.concat_ws("/", "session_id", "ix").alias("draft_id"), "session_id", "ix", "d.*")
    done = stash(backends.tokenise(drafts.repartition(config.udf_partitions), config.tokeniser, TOKENISER_PROMPT))
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(config.entries).select(F.element_at(F.split("path", "/"), -1).alias("name")) if os.path.isdir(config.entries) else spark.createDataFrame([], "name string")
    sources = prepared.select("session_id", "path", "project_name", "source_model")
    ordered = done.where("ok").join(drafts.select("draft_id", "session_id", "ix"), "draft_id").join(sources, "session_id").withColumn("parts", F.split("path", "/"))
    good = stash(entries.numbered(ordered, ["parts", "ix", "draft_id"], entries.max_number(names)).drop("parts"))

    old = tables.load(spark, config.registry, registry.SCHEMA)
    literals = registry.draft_literals(drafts, good)
    if config.sequential:
        learnt = registry.first_taught(literals.join(good.select("draft_id", F.col("number").alias("seq")), "draft_id").select("seq", "literal"))
        known = stash(learnt.unionByName(old.select("hash", "length", F.lit(-1).cast("long").alias("first_seq"))))
        hits = registry.field_hits(good.withColumn("seq", F.col("number")), known, since="seq")
    else:
        hits = registry.field_hits(good, stash(registry.merge(old.select("hash", "length"), registry.grow(literals))))
    hits = hits.groupBy("draft_id").agg(F.sum("hits").alias("hits"))
    reason = F.coalesce("review_reason", F.when(F.col("hits").isNotNull(), F.concat(F.col("hits").cast("string"), F.lit(" registry hit(s)"))))
    identity = F.udf(lambda d: entries.run_id(d, run, began[0]), "string")  # one row an entry, beside a model call
    result = stash(good.join(hits, "draft_id", "left").select(
        "draft_id", "session_id", "path", "ix", "number", "title", "category", "tags", "body", "entities", "source_model", F.col("project_name").alias("project"), identity("draft_id").alias("id"),
        F.lit("session").alias("source_type"), F.lit(None).cast("array<int>").alias("message_range"), F.lit(began[1]).alias("extracted_at"),
        (F.coalesce("needs_review", F.lit(False)) | F.col("hits").isNotNull()).alias("needs_manual_review"), reason.alias("review_reason"),
    ))
    written = stash(entries.published(result, config.entries, max(1, result.count())))

    by_session = result.select("draft_id", F.col("path").alias("session_key"), "number").join(written, "draft_id").groupBy("session_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "path"))), lambda x: x["path"]).alias("extracted_entry_files"))
    finished = extracted.where("ok").join(prepared.select("session_id", "path"), "session_id").select(F.col("path").alias("session_key")).distinct()
    record = work.join(finished, "session_key", "left_semi").join(by_session, "session_key", "left").withColumn("extracted_entry_files", F.coalesce("extracted_entry_files", F.array().cast("array<string>")))
    record = stash(record.select(*(c.split()[0] for c in state.STATE.split(", "))))
    tables.save(registry.merge(registry.merge(old, registry.grow(literals)), registry.categories(good)), config.registry)
    tables.save(state.upsert(tables.load(spark, config.state, state.STATE), record), config.state)
    total, todo, ok, unread = listed.count(), work.count(), record.count(), listed.where("error is not null").count()
    return MineResult(result, {"extracted": ok, "skipped": total - todo - unread, "failed": todo - ok + unread}, written.join(result.select("draft_id", "number"), "draft_id").orderBy("number").select("path"))


def validate(spark: SparkSession, folder: str, known: DataFrame, delimiter_free: bool = True) -> DataFrame:
    """(path, hit_count, leaked) of every published file against the registry."""
    texts = files.markdown(spark, folder).select("path", scannable(F.col("raw")).alias("text"))
    hits = registry.leaks(texts, ["path"], "text", known, delimiter_free).groupBy("path").agg(F.count("*").alias("hit_count"))
    return texts.select("path").join(hits, "path", "left").select("path", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.col("hit_count").isNotNull().alias("leaked"))


def validate_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("leaked").agg(F.count("*").alias("n"))


def stats(spark: SparkSession, path: str) -> DataFrame:
    return files.stats(files.session_files(spark, path))
