"""Role-labelled transcripts out of event-dialect lines, all in built-in expressions.

Results on odd input: unreadable payloads and lines of other kinds are skipped; strings are taken only where the JSON
holds strings; a result without a known earlier call is labelled unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.frames import utrim
from sessionloom.functions.text import block, one_json, text_at

CALLS = ("function_call", "custom_tool_call")
RESULTS = ("function_call_output", "custom_tool_call_output")


def is_event_session(originator, source):
    """Whether a session_meta belongs to the event dialect."""
    return F.coalesce(F.lower(utrim(originator)).startswith("codex") & F.lower(utrim(source)).isin("cli", "exec"), F.lit(False))


def _texts(value, path: str, kinds: tuple[str, ...] | None):
    """The string texts of an array's items; with kinds, of items of these types only, else of strings and {text}."""
    items = F.try_variant_get(value, path, "array<variant>")
    if kinds:
        items = F.filter(items, lambda x: text_at(x, "$.type").isin(*kinds))
        found = F.transform(items, lambda x: text_at(x, "$.text"))
    else:
        found = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(text_at(x, "$.text")))
    return F.filter(found, lambda t: t.isNotNull())


def events(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, kind, role, call_id, name, text) of the six kinds of response items; one row per line."""
    v = one_json(F.col("payload"))
    base = lines.where("type = 'response_item'").select("session_id", "line_no", v.alias("v")).dropDuplicates(["session_id", "line_no"]).where("v is not null")
    kind = text_at(F.col("v"), "$.type")
    output = utrim(text_at(F.col("v"), "$.output"))
    inner = utrim(text_at(one_json(output), "$.output"))
    text = (
        F.when(F.col("kind") == "message", F.array_join(_texts(F.col("v"), "$.content", ("input_text", "output_text")), "\n\n"))
        .when(F.col("kind") == "reasoning", F.array_join(_texts(F.col("v"), "$.summary", None), "\n"))
        .when(F.col("kind") == "function_call", text_at(F.col("v"), "$.arguments"))
        .when(F.col("kind") == "custom_tool_call", text_at(F.col("v"), "$.input"))
        .when(F.col("kind") == "function_call_output", output)
        .when(F.col("kind") == "custom_tool_call_output", F.coalesce(F.nullif(inner, F.lit("")), output))
    )
    return (
        base.withColumn("kind", kind)
        .where(F.col("kind").isin("message", "reasoning", *CALLS, *RESULTS))
        .select("session_id", "line_no", "kind", text_at(F.col("v"), "$.role").alias("role"), text_at(F.col("v"), "$.call_id").alias("call_id"), F.coalesce(text_at(F.col("v"), "$.name"), F.lit("unknown")).alias("name"), text.alias("text"))
    )


def with_call_names(rows: DataFrame) -> DataFrame:
    """Adds call_name: of the latest earlier call with the same id, else unknown (an as-of join as a window).

    The window is partitioned by session and call id, and rows without one by line, so a long session does not gather in
    one task.
    """
    named = F.when(F.col("kind").isin(*CALLS) & F.col("call_id").isNotNull(), F.col("name"))
    before = Window.partitionBy("session_id", F.coalesce("call_id", F.concat(F.lit("\0"), F.col("line_no").cast("string")))).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("call_name", F.coalesce(F.last(named, ignorenulls=True).over(before), F.lit("unknown")))


def blocks(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, block) in the transcript's form; blank texts give none."""
    rows = with_call_names(events(lines))
    label = (
        F.when((F.col("kind") == "message") & (F.col("role") == "user"), F.lit("HUMAN"))
        .when((F.col("kind") == "message") & (F.col("role") == "assistant"), F.lit("ASSISTANT"))
        .when(F.col("kind") == "reasoning", F.lit("THINKING"))
        .when(F.col("kind").isin(*CALLS), F.concat(F.lit("TOOL_INPUT:"), "name"))
        .when(F.col("kind").isin(*RESULTS), F.concat(F.lit("TOOL_RESULT:"), "call_name"))
    )
    kept = rows.withColumn("label", label).where(F.col("label").isNotNull() & (utrim(F.col("text")) != ""))
    return kept.select("session_id", "line_no", block(F.col("label"), F.col("text")).alias("block"))


def transcripts(lines: DataFrame) -> DataFrame:
    """(session_id, transcript): a session's blocks in line order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "block")))
    return blocks(lines).groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("transcript"))


def source_models(lines: DataFrame) -> DataFrame:
    """(session_id, family, model): who the conversation was held with; the model is null where the log does not tell.

    Event sessions name it in their turn contexts, plain ones in their assistants' messages; the first by line counts.
    """
    v = one_json(F.col("payload"))
    rows = lines.where("session_id is not null").select("session_id", "line_no", "type", v.alias("v"))
    event = F.coalesce((F.col("type") == "session_meta") & is_event_session(text_at(F.col("v"), "$.originator"), text_at(F.col("v"), "$.source")), F.lit(False))
    model = F.when(F.col("type") == "turn_context", text_at(F.col("v"), "$.model")).when(F.col("type") == "assistant", text_at(F.col("v"), "$.model"))
    one = rows.groupBy("session_id").agg(F.bool_or(event).alias("event"), F.min_by(model, F.when(model.isNotNull(), F.col("line_no"))).alias("model"))
    return one.select("session_id", F.when(F.col("event"), "codex").otherwise("claude").alias("family"), "model")
