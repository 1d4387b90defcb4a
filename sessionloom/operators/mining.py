"""Window mining of the earlier generation: sliding windows, filters, overlap handling, caps, duplicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.frames import numbered_in, spread, utrim
from sessionloom.functions.text import one_json, text_at
from sessionloom.operators.transcript import RESULTS

WINDOW, STEP = 8, 4


def turns(lines: DataFrame) -> DataFrame:
    """(session_id, turn_no, role, text) of both dialects: what a user or an assistant says, and tool results.

    Roles count without outer blanks and case; blank speech is no turn; a tool's result is one even without a text, which
    is then empty. Unreadable payloads give none; of repeated lines one counts.
    """
    v = F.col("v")
    spoken = spread(lines.select("session_id", "line_no", "type", "payload").where("type in ('user', 'assistant', 'response_item')"))
    base = spoken.select("session_id", "line_no", "type", one_json(F.col("payload")).alias("v")).where("v is not null and session_id is not null and line_no is not null")
    kind = text_at(v, "$.type")
    said = F.lower(utrim(text_at(v, "$.role")))
    speech = F.col("type").isin("user", "assistant") | (kind == "message")
    result = (F.col("type") == "response_item") & kind.isin(*RESULTS)
    role = F.when(speech, F.when((F.col("type") == "user") & (said == "user"), role_of(said, F.try_variant_get(v, "$.content", "variant"))).otherwise(said)).when(result, "tool")
    parts = F.filter(F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda x: text_at(x, "$.text")), lambda t: utrim(t) != "")
    text = F.coalesce(text_at(v, "$.content"), F.array_join(parts, "\n\n"), F.when(result, text_at(v, "$.output")), F.lit(""))
    # read where the lines are: only what is said moves
    rows = base.select("session_id", "line_no", role.alias("role"), text.alias("text")).dropDuplicates(["session_id", "line_no"]).where("role in ('user', 'assistant', 'tool')").where((F.col("role") == "tool") | (utrim(F.col("text")) != ""))
    return numbered_in(rows, "session_id", "line_no", "turn_no").select("session_id", "turn_no", "role", "text")


def windows(turns: DataFrame, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """(session_id, start_turn, turn_no, ...): each turn in every window of `size` turns that holds it.

    A turn knows its windows by arithmetic, so there is no range join: at most ceil(size / step) copies of a row.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("turn_no") - size + 1) / F.lit(step)))
    starts = F.transform(F.sequence(first, F.floor(F.col("turn_no") / F.lit(step))), lambda k: (k * step).cast("long"))
    return turns.withColumn("start_turn", F.explode(starts))


def window_stats(turns: DataFrame) -> DataFrame:
    """Per window: turns, users, assistants, characters, turns of over 20 characters, tools, chatter."""
    one = F.lit(1)
    count = lambda c: F.count(F.when(c, one))
    length = F.length("text")
    return windows(turns).groupBy("session_id", "start_turn").agg(F.max("turn_no").alias("end_turn"), F.count("*").alias("n"), count(F.col("role") == "user").alias("users"), count(F.col("role") == "assistant").alias("assistants"), F.sum(length).alias("chars"), count(length > 20).alias("long_turns"), count(F.col("role") == "tool").alias("tools"), count(length <= 20).alias("chatter"))


def prefilter(stats: DataFrame) -> DataFrame:
    """Windows worth scoring: both roles, two turns of substance, 100 characters, few tools, little chatter."""
    return stats.where("users > 0 and assistants > 0 and long_turns >= 2 and chars >= 100 and tools <= 0.8 * n and chatter <= 0.5 * n")


def any_score(df: DataFrame, scores: list[str], least: float) -> DataFrame:
    """Rows of which any dimension reaches the threshold."""
    return df.where(F.greatest(*(F.coalesce(F.col(c), F.lit(0.0)) for c in scores)) >= least)


def merge_overlaps(ranges: DataFrame, least: int = 3) -> DataFrame:
    """Ranges of a session that share at least `least` turns become one (gaps and islands); the best score stays."""
    before = Window.partitionBy("session_id").orderBy("start_turn", "end_turn").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("session_id").orderBy("start_turn", "end_turn").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end_turn").over(before)
    new = F.when(reach.isNull() | (reach - F.col("start_turn") + 1 < least), 1).otherwise(0)
    islands = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(so_far))
    return islands.groupBy("session_id", "_island").agg(F.min("start_turn").alias("start_turn"), F.max("end_turn").alias("end_turn"), F.max("score").alias("score")).drop("_island")


def greedy_overlaps(ranges: DataFrame, share: float = 0.6) -> DataFrame:
    """Best first: a range that shares more than `share` of the shorter one with a kept range is dropped.

    Order-dependent, so by session in Arrow; overlap never crosses a gap, so a long session is first cut in islands of
    overlapping ranges and each island is a group of its own.
    """
    before = Window.partitionBy("session_id").orderBy("start_turn", "end_turn").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("session_id").orderBy("start_turn", "end_turn").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end_turn").over(before)
    cut = ranges.select("session_id", "start_turn", "end_turn", "score").withColumn("_new", F.when(reach.isNull() | (reach < F.col("start_turn")), 1).otherwise(0)).withColumn("island", F.sum("_new").over(so_far)).drop("_new")

    def keep(group):
        rows = sorted(group.to_pylist(), key=lambda r: (-r["score"], r["start_turn"], r["end_turn"]))
        kept: list[dict] = []
        for r in rows:
            for k in kept:
                common = min(r["end_turn"], k["end_turn"]) - max(r["start_turn"], k["start_turn"]) + 1
                shorter = min(r["end_turn"] - r["start_turn"], k["end_turn"] - k["start_turn"]) + 1
                if common > share * shorter:
                    break
            else:
                kept.append(r)
        return pa.Table.from_pylist(kept, schema=group.schema)

    return cut.groupBy("session_id", "island").applyInArrow(keep, cut.schema).drop("island")


def capped(ranges: DataFrame, turns: DataFrame) -> DataFrame:
    """At most clamp(ceil(turns / 1000), 3, 10) ranges a session, the best first (the cap is the feature)."""
    most = turns.groupBy("session_id").agg(F.least(F.greatest(F.ceil(F.count("*") / 1000), F.lit(3)), F.lit(10)).alias("most"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("score").desc(), "start_turn"))
    return ranges.withColumn("place", place).join(most, "session_id").where("place <= most").drop("most")


def content_dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first key of each distinct text, by content hash."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))


def same_titles(entries: DataFrame, key: str) -> DataFrame:
    """Titles that several entries share, without case."""
    return entries.select(key, F.lower("title").alias("title_key")).distinct().groupBy("title_key").agg(F.count("*").alias("n")).where("n > 1")


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts of each label and their share in hundredths of a percent."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).select(F.col(label).alias("label"), "n", F.floor(F.col("n") * 10_000 / F.col("_total")).cast("long").alias("share_bp"))


def role_of(kind, content):
    """A line of the user's that only carries a tool's result is the tool's."""
    return F.when((kind == "user") & F.exists(F.try_variant_get(content, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "tool_result", F.lit(False))), "tool").otherwise(kind)
