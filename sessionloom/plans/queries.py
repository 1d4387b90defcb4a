"""The core's queries by name: each runs one operator over its whole tables. Their SQL is in oracles.py."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.config import EngineConfig
from sessionloom.frames import stash, table, utrim
from sessionloom.functions import parsing, text
from sessionloom.operators import backends, entries, mining, redact, registry, review, shred, state, transcript
from sessionloom.plans import oracles, pipeline
from sessionloom.sources import files
from sessionloom.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
#: The categories of the drafts' contract (fixed values).
CATEGORIES = ("bikeshedding", "comedy", "dark-comedy", "existential", "meta", "other", "rage", "role-reversal", "spectacular-failure", "wholesome")


def _on(fn: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, root: fn(*(table(spark, root, n) for n in names))


def _drafts(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["draft_id"])


def _lines(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["session_id", "line_no"])


def _arrived(df: DataFrame) -> DataFrame:
    """Each line once, at its first arrival."""
    return df.groupBy("session_id", "line_no").agg(*(F.min(c).alias(c) for c in ("ingested_at", "project_name", "type")))


# --- sources and scalars ------------------------------------------------------------------------------------------------
def stats_bytes(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def session_stats(lines: DataFrame) -> DataFrame:
    return _lines(lines).groupBy("project_name").agg(F.count("*").alias("lines"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


def dialect_sniff(lines: DataFrame) -> DataFrame:
    """(session_id, is_event, project_name) from each session's first line."""
    v = text.one_json(F.col("payload"))
    first = _lines(lines).where("line_no = 1").select("session_id", "file_path", "type", v.alias("v"))
    event = (F.col("type") == "session_meta") & transcript.is_event_session(text.text_at(F.col("v"), "$.originator"), text.text_at(F.col("v"), "$.source"))
    project = F.when(event, text.event_project(text.text_at(F.col("v"), "$.git.repository_url"), text.text_at(F.col("v"), "$.cwd"))).otherwise(text.path_project(F.col("file_path")))
    return first.select("session_id", F.coalesce(event, F.lit(False)).alias("is_event"), project.alias("project_name"), text.path_session(F.col("file_path")).alias("path_session"))


def repo_names(lines: DataFrame) -> DataFrame:
    url = F.get_json_object("payload", "$.git.repository_url")
    return _lines(lines).where("type = 'session_meta'").select("session_id", "line_no", text.repo_name(url).alias("repo"))


def slug_filename(drafts: DataFrame) -> DataFrame:
    return _drafts(drafts).select("draft_id", text.file_name(F.coalesce("seq_no", F.lit(0)), F.coalesce("title", F.lit(""))).alias("file_name"))


def block_format(drafts: DataFrame) -> DataFrame:
    return _drafts(drafts).where("quote is not null").select("draft_id", text.block(F.lit("HUMAN"), F.col("quote")).alias("block"))


def utc_format(drafts: DataFrame) -> DataFrame:
    return _drafts(drafts).select("draft_id", text.utc(F.col("extracted_at")).alias("extracted"))


def ansi_strip(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select("doc_id", F.sha2(text.strip_ansi(F.col("text")), 256).alias("hash"))


def failure_class(lines: DataFrame) -> DataFrame:
    """Messages of every class, raw, upper-cased or coloured, made from the line number."""
    words = F.array(*(F.lit(w) for _, group in text.FAILURES for w in group), F.lit("all is well"))
    raw = F.element_at(words, (F.col("line_no") % 14 + 1).cast("int"))
    message = F.when(F.col("line_no") % 3 == 0, F.upper(raw)).when(F.col("line_no") % 3 == 1, F.concat(F.lit("\x1b[31m"), raw, F.lit("\x1b[0m"))).otherwise(raw)
    return _lines(lines).select("session_id", "line_no", F.coalesce(text.failure_class(message), F.lit("none")).alias("class"))


def zip_tags(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    both = _drafts(drafts).select("draft_id", F.col("tags").alias("x")).join(_drafts(tokenised).select("draft_id", F.col("tags").alias("y")), "draft_id")
    return both.select("draft_id", F.array_join(F.transform(text.zipped(F.col("x"), F.col("y")), lambda p: F.concat(p["a"], F.lit("="), p["b"])), "|").alias("pairs"))


def explode_tags(drafts: DataFrame) -> DataFrame:
    return _drafts(drafts).select("draft_id", F.posexplode("tags").alias("ix", "tag"))


def scannable_content(published: DataFrame) -> DataFrame:
    return _markdown(published).select("id", text.scannable(F.col("raw")).alias("shown"))


def _markdown(published: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nproject: x\ncategory: "), "category", F.lit("\ntags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), ""), F.lit("---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return published.dropDuplicates(["id"]).select("id", raw.alias("raw"))


# --- transcripts --------------------------------------------------------------------------------------------------------
def event_rows(lines: DataFrame) -> DataFrame:
    return transcript.events(lines).select("session_id", "line_no", "kind", "role", "call_id", "name", F.sha2("text", 256).alias("hash"))


def call_names(lines: DataFrame) -> DataFrame:
    rows = transcript.with_call_names(transcript.events(lines))
    return rows.where(F.col("kind").isin(*transcript.RESULTS)).select("session_id", "line_no", "call_id", "call_name")


def role_classes(lines: DataFrame) -> DataFrame:
    content = F.try_variant_get(text.one_json(F.col("payload")), "$.content", "variant")
    return _lines(lines).where("type in ('user', 'assistant')").select("session_id", "line_no", mining.role_of(F.col("type"), content).alias("role"))


# --- registry and review ------------------------------------------------------------------------------------------------
def masked_literals(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    return registry.draft_literals(drafts, tokenised).groupBy("draft_id", "literal").agg(F.count("*").alias("n"))


def registry_build(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    return registry.grow(registry.draft_literals(drafts, tokenised))


def leak_scan(drafts: DataFrame, tokenised: DataFrame, published: DataFrame) -> DataFrame:
    known = registry.learn(drafts, tokenised)
    return registry.leaks(published.select("id", "body").distinct(), ["id"], "body", known)


def leak_hits(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    return registry.field_hits(tokenised, registry.learn(drafts, tokenised))


def sequential_leaks(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    order = _drafts(drafts).select("draft_id", F.unix_micros("extracted_at").alias("seq"))
    learnt = registry.draft_literals(drafts, tokenised).join(order, "draft_id").select("seq", "literal")
    bodies = _drafts(tokenised).join(order, "draft_id").select("draft_id", "seq", "body")
    return registry.sequential_hits(learnt, bodies)


def validate_counts(drafts: DataFrame, tokenised: DataFrame, published: DataFrame) -> DataFrame:
    known = registry.learn(drafts, tokenised)
    texts = _markdown(published).select("id", text.scannable(F.col("raw")).alias("shown"))
    hits = registry.leaks(texts, ["id"], "shown", known).select("id").distinct().withColumn("leaked", F.lit(True))
    return texts.select("id").join(hits, "id", "left").groupBy(F.coalesce("leaked", F.lit(False)).alias("leaked")).agg(F.count("*").alias("n"))


def _quotes(drafts: DataFrame) -> DataFrame:
    """(draft_id, quote), each draft once; partitions stay apart, as many patterns run over little data."""
    parts = int(drafts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drafts.select("draft_id", "quote").repartition(parts, "draft_id").dropDuplicates(["draft_id"]).where("quote is not null")


def redact_values(drafts: DataFrame) -> DataFrame:
    found = _quotes(drafts).select("draft_id", F.inline_outer(redact.found(F.col("quote"))).alias("type", "value"))  # inline would evaluate it again in a filter
    return found.where("type is not null").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


def redact_default(drafts: DataFrame) -> DataFrame:
    return redact.redact(_quotes(drafts), "quote").select("draft_id", "redacted", F.to_json("entities").alias("entities"))


def draft_contract(drafts: DataFrame, prepared: DataFrame) -> DataFrame:
    """The drafts' contract as predicates: title length, tag count, one of ten categories, the whole quote in the transcript."""
    one = prepared.select("session_id", "transcript").dropDuplicates(["session_id"])
    joined = _drafts(drafts).join(one, "session_id", "left")
    return joined.select("draft_id", (F.length("title") <= 80).alias("title_ok"), F.size("tags").between(2, 5).alias("tags_ok"), F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)).alias("category_ok"), F.coalesce((utrim(F.col("quote")) != "") & F.contains("transcript", "quote"), F.lit(False)).alias("quoted"))


def source_lookup(published: DataFrame, prepared: DataFrame) -> DataFrame:
    one = published.dropDuplicates(["id"]).select("id", F.col("source.session_id").alias("session_id"))
    return one.join(prepared.select("session_id", "extractor_path").distinct(), "session_id").select("id", "session_id", "extractor_path")


# --- state ----------------------------------------------------------------------------------------------------------------
def _files(prepared: DataFrame) -> DataFrame:
    one = prepared.dropDuplicates(["session_id"]).where("transcript is not null")
    return one.select(F.col("path").alias("session_key"), F.col("transcript").alias("content"), F.sha2("transcript", 256).alias("file_sha256"), F.octet_length("transcript").cast("long").alias("size_bytes"), F.lit("e1").alias("extractor_prompt_sha256"), F.lit("t1").alias("tokeniser_prompt_sha256"), F.lit("").alias("extractor_backend_signature"), F.lit("b/m").alias("tokeniser_backend_signature"), F.lit("0.1.0").alias("version"))


def _state(prepared: DataFrame) -> DataFrame:
    """A state of every file: some of other content, some of another version, some never seen."""
    n = F.col("size_bytes")
    files = _files(prepared).where(n % 7 != 0)
    sha = F.when(n % 5 == 0, F.lit("other")).when(n % 3 == 0, F.sha2(F.substring(F.encode("content", "UTF-8"), 1, 100), 256)).otherwise(F.col("file_sha256"))
    return files.withColumns({"file_sha256": sha, "size_bytes": F.when((n % 3 == 0) & (n % 5 != 0), F.lit(100)).otherwise(n), "version": F.when(n % 11 == 0, "0.0.9").otherwise("0.1.0"), "extractor_backend_signature": F.lit(None).cast("string")})


def freshness(prepared: DataFrame) -> DataFrame:
    return state.stale(_files(prepared), _state(prepared)).select("session_key", "file_sha256")


def state_upsert(prepared: DataFrame) -> DataFrame:
    keys = ["session_key", "file_sha256", "version"]
    new = _files(prepared).where("size_bytes % 2 = 0").select(*keys)
    return state.upsert(_state(prepared).select(*keys), new)


def append_decision(prepared: DataFrame) -> DataFrame:
    return state.append_decision(_files(prepared), _state(prepared))


# --- entries ------------------------------------------------------------------------------------------------------------
def entry_numbering(published: DataFrame) -> DataFrame:
    one = published.dropDuplicates(["id"]).select("id", F.col("source.extracted_at").alias("at"))
    return entries.numbered(one, ["at", "id"], start=41).select("id", "number")


def path_order(prepared: DataFrame) -> DataFrame:
    one = prepared.select("path").distinct().withColumn("parts", F.split("path", "/"))
    return entries.numbered(one, ["parts", "path"]).select("path", "number")


def front_matter(published: DataFrame) -> DataFrame:
    return entries.front_matter(published.dropDuplicates(["id"]))


def _complete(drafts: DataFrame) -> DataFrame:
    return _drafts(drafts).where("quote is not null and why is not null and title is not null and category is not null")


def json_candidates(drafts: DataFrame) -> DataFrame:
    """Drafts written as noisy model output and read back: in prose, behind a list that is none, cut short, or twice."""
    good = F.to_json(F.array(F.struct("title", "category", "tags", "quote", "why")))
    kind = F.length("draft_id") + F.length("title")
    noisy = (
        F.when(kind % 4 == 0, F.concat(F.lit("Sure [1], see:\n```json\n"), good, F.lit("\n``` done [2]")))
        .when(kind % 4 == 1, F.concat(F.lit('[{"title": 5}] and '), good))
        .when(kind % 4 == 2, F.substring(good, F.lit(1), F.length(good) - 2))
        .otherwise(F.concat(good, F.lit(" or []")))
    )
    return parsing.parse_drafts(_complete(drafts).select("draft_id", noisy.alias("output")), "output", ["draft_id"]).select("draft_id", "ok", F.size("drafts").alias("n"), F.get("drafts", F.lit(0))["title"].alias("title"))


def entry_objects(tokenised: DataFrame) -> DataFrame:
    """Tokenised entries read back out of prose; null fields make an object that does not fit."""
    one = _drafts(tokenised).select("draft_id", F.concat(F.lit("Here {it} is: "), F.to_json(F.struct("title", "category", "tags", "body", "needs_review", "review_reason")), F.lit(" }")).alias("output"))
    return parsing.parse_tokenised(one, "output", ["draft_id"]).select("draft_id", "ok", F.sha2("body", 256).alias("hash"), "needs_review")


def event_streams(drafts: DataFrame) -> DataFrame:
    """Quotes sent as an event stream and read back; every third stream has a line that is no JSON."""
    one = _complete(drafts)
    event = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), F.struct(F.col(c).alias("text")).alias("part")))
    stream = F.concat_ws("\n", F.lit('{"type": "start"}'), event("title"), F.when(F.length("title") % 3 == 0, "broken {").otherwise(""), event("quote"))
    return parsing.event_texts(one.select("draft_id", stream.alias("output")), "output", ["draft_id"]).select("draft_id", F.sha2("text", 256).alias("hash"), "ok")


def registry_merge(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """Two runs' registries, learnt from overlapping drafts, merged: as one."""
    early, late = drafts.where("seq_no is null or seq_no % 3 < 2"), drafts.where("seq_no is null or seq_no % 3 > 0")
    return registry.merge(registry.grow(registry.draft_literals(early, tokenised)), registry.grow(registry.draft_literals(late, tokenised)))


def max_number(drafts: DataFrame) -> DataFrame:
    """The highest number among published names and others that do not count."""
    name = F.when(F.length("title") % 5 == 0, F.concat(F.lit("x-"), F.lit("999999.md"))).when(F.length("title") % 5 == 1, F.concat(F.lit("888888-"), "draft_id")).otherwise(text.file_name(F.coalesce("seq_no", F.lit(0)) * 7, F.coalesce("title", F.lit(""))))
    return drafts.sparkSession.createDataFrame([(entries.max_number(drafts.select(name.alias("name"))),)], "n int")


# --- files and the whole run ----------------------------------------------------------------------------------------------
def _log_files(lines: DataFrame) -> str:
    """Writes each session as a JSON-lines file below the shared folder; the folder."""
    one = _lines(lines).where("session_id is not null")
    line = F.concat(F.lit('{"type":"'), F.coalesce("type", F.lit("")), F.lit('","payload":'), F.coalesce("payload", F.lit("null")), F.lit("}\n"))
    whole = one.select("session_id", "line_no", line.alias("line")).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("content"))
    return files.write(whole.select(F.concat(F.lit("-home-loom/"), "session_id", F.lit(".jsonl")).alias("name"), "content"))


def files_scan(lines: DataFrame) -> DataFrame:
    """Sessions as files: found, hashed, read line by line, their dialect sniffed."""
    folder = _log_files(lines)
    found = stash(files.read(files.session_files(lines.sparkSession, folder)))
    rows = files.lines(found)
    count = rows.groupBy("path").agg(F.count("*").alias("lines"))
    kinds = files.sniff(rows).select("path", "dialect")
    return files.hashed(found).join(count, "path").join(kinds, "path").select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session"), "file_sha256", "size_bytes", "lines", "dialect")


def files_stats(lines: DataFrame) -> DataFrame:
    return pipeline.stats(lines.sparkSession, _log_files(lines))


def _offline(root: str) -> EngineConfig:
    """The default backends without a model: the first human block as the one draft, the redactor's e-mail rule as tokeniser."""

    def extract(prompt: str) -> str:
        spoken = [b for b in prompt.split("\n\n")[1:] if b.startswith("[HUMAN]: ") and "@" in b]
        return json.dumps([{"title": "A moment", "category": "other", "tags": ["log"], "quote": b, "why": "first"} for b in spoken[:1]])

    def tokenise(prompt: str) -> str:
        d = json.loads(prompt[prompt.index("\n{") + 1 :])
        seen = list(dict.fromkeys(re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", d["quote"])))
        for i, value in enumerate(seen[:1]):  # later addresses stay: the scan must find those taught before
            d["quote"] = d["quote"].replace(value, f"#EMAIL_{i + 1:03d}#")
        return json.dumps({k: d[k] for k in ("title", "category", "tags")} | {"body": d["quote"]})

    return EngineConfig(root, backends.Offline("offline/first", extract), backends.Offline("offline/mail", tokenise))


def mine_run(lines: DataFrame) -> DataFrame:
    """A whole run over the files with offline backends, and what a second one finds to do: (what, n)."""
    spark, folder = lines.sparkSession, _log_files(lines)
    config = _offline(f"{folder}-out")
    first = pipeline.mine(spark, folder, config)
    again = pipeline.plan(spark, folder, config).count()
    rows = [*first.counters.items(), ("entries", first.entries.count()), ("files", first.paths.distinct().count()), ("again", again - first.counters["failed"])]
    return spark.createDataFrame(rows, "what string, n long")


# --- mining ---------------------------------------------------------------------------------------------------------------
def _scored(lines: DataFrame) -> DataFrame:
    return mining.prefilter(mining.window_stats(mining.turns(lines))).select("session_id", "start_turn", "end_turn", (F.col("chars") % 100).alias("score"))


def msg_windows(lines: DataFrame) -> DataFrame:
    return mining.windows(mining.turns(lines)).select("session_id", "start_turn", "turn_no", "role")


def window_prefilter(lines: DataFrame) -> DataFrame:
    return mining.prefilter(mining.window_stats(mining.turns(lines))).select("session_id", "start_turn", "end_turn", "n", "chars")


def score_filter(lines: DataFrame) -> DataFrame:
    stats = mining.window_stats(mining.turns(lines)).withColumns({"a": F.col("users") / F.col("n"), "b": F.col("long_turns") / F.col("n")})
    return mining.any_score(stats, ["a", "b"], 0.6).select("session_id", "start_turn")


def overlap_merge(lines: DataFrame) -> DataFrame:
    return mining.merge_overlaps(_scored(lines))


def overlap_greedy(lines: DataFrame) -> DataFrame:
    return mining.greedy_overlaps(_scored(lines))


def session_cap(lines: DataFrame) -> DataFrame:
    return mining.capped(_scored(lines), mining.turns(lines)).select("session_id", "start_turn", "place")


def same_titles(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """Titles that a draft shares with its tokenised entry or with others."""
    both = drafts.select(F.concat(F.lit("d/"), "draft_id").alias("key"), "title").union(tokenised.select(F.concat(F.lit("t/"), "draft_id"), "title"))
    return mining.same_titles(both, "key")


def version_rescore(drafts: DataFrame) -> DataFrame:
    """Versions that need another scoring, by a small lookup table."""
    versions = drafts.sparkSession.createDataFrame([(0, False), (1, True), (2, False)], "version int, rescore boolean")
    return _drafts(drafts).select("draft_id", (F.coalesce("seq_no", F.lit(0)) % 3).alias("version")).join(F.broadcast(versions), "version").where("rescore").select("draft_id", "version")


def activity(lines: DataFrame) -> DataFrame:
    return arrivals.activity(_arrived(lines)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "project_name", "type", "lines")


def queries() -> dict[str, Query]:
    lines, drafts, tokenised, published, prepared, documents = "session_lines", "drafts", "tokenised_entries", "entries", "prepared_sessions", "documents"
    return {
        "leak_review": _on(review.leak_review, drafts, tokenised),
        "stats_bytes": _on(stats_bytes, documents),
        "session_stats": _on(session_stats, lines),
        "line_counters": _on(review.counters, lines),
        "dialect_sniff": _on(dialect_sniff, lines),
        "repo_names": _on(repo_names, lines),
        "slug_filename": _on(slug_filename, drafts),
        "block_format": _on(block_format, drafts),
        "utc_format": _on(utc_format, drafts),
        "ansi_strip": _on(ansi_strip, documents),
        "failure_class": _on(failure_class, lines),
        "zip_tags": _on(zip_tags, drafts, tokenised),
        "explode_tags": _on(explode_tags, drafts),
        "scannable_content": _on(scannable_content, published),
        "event_rows": _on(event_rows, lines),
        "call_names": _on(call_names, lines),
        "transcripts": _on(transcript.transcripts, lines),
        "role_classes": _on(role_classes, lines),
        "masked_literals": _on(masked_literals, drafts, tokenised),
        "registry_build": _on(registry_build, drafts, tokenised),
        "registry_categories": _on(registry.categories, tokenised),
        "leak_scan": _on(leak_scan, drafts, tokenised, published),
        "leak_hits": _on(leak_hits, drafts, tokenised),
        "sequential_leaks": _on(sequential_leaks, drafts, tokenised),
        "validate_counts": _on(validate_counts, drafts, tokenised, published),
        "redact_values": _on(redact_values, drafts),
        "redact_default": _on(redact_default, drafts),
        "placeholder_integrity": _on(redact.integrity, tokenised),
        "entity_edges": _on(redact.entity_edges, tokenised),
        "draft_contract": _on(draft_contract, drafts, prepared),
        "source_lookup": _on(source_lookup, published, prepared),
        "freshness": _on(freshness, prepared),
        "state_upsert": _on(state_upsert, prepared),
        "append_decision": _on(append_decision, prepared),
        "entry_numbering": _on(entry_numbering, published),
        "path_order": _on(path_order, prepared),
        "front_matter": _on(front_matter, published),
        "json_candidates": _on(json_candidates, drafts),
        "entry_objects": _on(entry_objects, tokenised),
        "event_streams": _on(event_streams, drafts),
        "registry_merge": _on(registry_merge, drafts, tokenised),
        "max_number": _on(max_number, drafts),
        "files_scan": _on(files_scan, lines),
        "files_stats": _on(files_stats, lines),
        "mine_run": _on(mine_run, lines),
        "source_models": _on(transcript.source_models, lines),
        "msg_windows": _on(msg_windows, lines),
        "window_prefilter": _on(window_prefilter, lines),
        "score_filter": _on(score_filter, lines),
        "overlap_merge": _on(overlap_merge, lines),
        "overlap_greedy": _on(overlap_greedy, lines),
        "session_cap": _on(session_cap, lines),
        "content_dedup": _on(lambda d: mining.content_dedup(d, "doc_id", "text"), documents),
        "same_titles": _on(same_titles, drafts, tokenised),
        "label_distribution": _on(lambda d: mining.distribution(_drafts(d), "category"), drafts),
        "version_rescore": _on(version_rescore, drafts),
        "activity": _on(activity, lines),
        "p3_found": _on(shred.object_elements, lines),
        "p3_levels": _on(shred.level_columns, lines),
        "p3_tables": _on(shred.flat_tables, lines),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
