"""Review flags and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import registry


def flags(tokenised: DataFrame, hits: DataFrame) -> DataFrame:
    """(draft_id, hits, needs_manual_review, review_reason): the model's flag or any hit; the model's reason wins."""
    one = tokenised.dropDuplicates(["draft_id"])
    total = hits.groupBy("draft_id").agg(F.sum("hits").alias("hits"))
    joined = one.join(total, "draft_id", "left")
    leak = F.col("hits").isNotNull()
    reason = F.coalesce("review_reason", F.when(leak, F.concat(F.col("hits").cast("string"), F.lit(" registry hit(s)"))))
    return joined.select("draft_id", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("needs_review", F.lit(False)) | leak).alias("needs_manual_review"), reason.alias("review_reason"))


def leak_review(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """Learn what was masked anywhere, scan every field, flag."""
    known = registry.learn(drafts, tokenised)
    return flags(tokenised, registry.field_hits(tokenised, known))


def counters(lines: DataFrame) -> DataFrame:
    """(type, sessions, lines, undated) of the log."""
    one = lines.dropDuplicates(["session_id", "line_no"])
    return one.groupBy("type").agg(F.count("*").alias("lines"), F.count_if(F.col("event_ts").isNull()).alias("undated"), F.countDistinct("session_id").alias("sessions"))
