"""Conversations out of message rows: secondary sort by line and a finite-state automaton over the lines.

Each line becomes one symbol (u, a: a user's or assistant's speech; -: silent; x: unreadable). The rows of a session
are sorted by line_no inside blocks of BLOCK line numbers, so a session that holds a third of all rows is spread over
many tasks; the automaton runs each block from every start state, and the blocks' transition functions compose into
the session's. A session is kept if it ends in state A.

Results on odd input: rows with a null session_id are left out; a null line_no makes its session broken (its place is
unknown); null, empty or unreadable payloads make it broken; line numbers below 1 are ordered but fill no gap;
repeated rows count once; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread
from sessionloom.functions.jsonx import read_one

BLOCK = 8192
#: Next state by symbol for each of the states S (nothing spoken), U and A (who spoke last), X (broken).
STEP = {"u": "UUUX", "a": "XAAX", "-": "SUAX", "x": "XXXX"}
STATES = "SUAX"


def speech(kind: str | None, value) -> tuple[str, str | None]:
    """The symbol of a line's type and payload, and the text it speaks."""
    if not isinstance(value, dict):
        return "-", None
    if not (kind in ("user", "assistant") or kind == "response_item" and value.get("type") == "message"):
        return "-", None
    role = value.get("role")
    role = role.strip().lower() if isinstance(role, str) else ""
    if role not in ("user", "assistant"):
        return "-", None
    content = value.get("content")
    if isinstance(content, str):
        texts = [content]
    elif isinstance(content, list):
        texts = [p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str)]
    else:
        return "-", None
    texts = [t for t in texts if t.strip()]
    return (role[0], "\n\n".join(texts)) if texts else ("-", None)


def symbols(lines: DataFrame, with_text: bool = False) -> DataFrame:
    """(session_id, line_no, symbol[, text]) of each row."""

    def run(batch: pa.RecordBatch) -> dict:
        out, texts = [], []
        for kind, text in zip(batch["type"].to_pylist(), batch["payload"].to_pylist()):
            ok, value = read_one(text)
            symbol, spoken = speech(kind, value) if ok else ("x", None)
            out.append(symbol)
            texts.append(spoken)
        more = {"text": pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())} if with_text else {}
        return {"session_id": batch["session_id"], "line_no": batch["line_no"], "symbol": pa.array(out, pa.string())} | more

    source = spread(lines.select("session_id", F.col("line_no").cast("int").alias("line_no"), "type", "payload").where(F.col("session_id").isNotNull()))
    return by_batch(source, run, "session_id string, line_no int, symbol string" + ", text string" * with_text)


def _run_blocks(batches):
    """Sorted symbols -> one row per (session, block): the block's transition function, distinct lines and last line."""
    key, states, last, lines = None, "", None, 0

    def row():
        return (key[0], key[1], states, lines, last)

    done = []
    for batch in batches:
        for s, b, n, c in zip(*(batch[k].to_pylist() for k in ("session_id", "block", "line_no", "symbol"))):
            if (s, b) != key:
                if key:
                    done.append(row())
                key, states, last, lines = (s, b), STATES, None, 0
            if n is None:
                states = "XXXX"
                continue
            if n != last and n >= 1:
                lines += 1
            last = n
            step = STEP[c]
            states = "".join([step[STATES.index(x)] for x in states]) if c != "-" else states
        if len(done) >= 10_000:
            yield done
            done = []
    if key:
        done.append(row())
    if done:
        yield done


_BLOCKS = pa.schema([("session_id", pa.string()), ("block", pa.int32()), ("step", pa.string()), ("lines", pa.int64()), ("last_line", pa.int32())])


def sessions(lines: DataFrame) -> DataFrame:
    """(session_id, end state, whether a line is missing, kept) of every session."""

    def run(batches):
        for rows in _run_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)

    blocks = (
        symbols(lines)
        .withColumn("block", F.coalesce(F.floor(F.col("line_no") / BLOCK), F.lit(-1)).cast("int"))
        .repartition("session_id", "block")
        .sortWithinPartitions("session_id", "block", "line_no")
        .mapInArrow(run, "session_id string, block int, step string, lines long, last_line int")
    )
    # compose the blocks' functions in order: state -> its character in the block's step string
    compose = F.aggregate(F.sort_array(F.collect_list(F.struct("block", "step"))), F.lit("S"), lambda state, x: F.substring(x["step"], F.instr(F.lit(STATES), state), F.lit(1)))
    ended = blocks.groupBy("session_id").agg(compose.alias("state"), F.sum("lines").alias("lines"), F.max("last_line").alias("last_line"))
    gap = ~F.coalesce(F.col("lines") == F.col("last_line"), F.lit(False))
    return ended.select("session_id", "state", gap.alias("gap"), ((F.col("state") == "A") & ~gap).alias("kept"))


def broken(lines: DataFrame) -> DataFrame:
    """The sessions to drop."""
    return sessions(lines).where(~F.col("kept")).select("session_id")


def turns(lines: DataFrame) -> DataFrame:
    """The kept sessions' turns in order: consecutive lines of one role, texts joined by a blank line.

    Numbering works by blocks too: role changes are counted inside each block, then offset by the blocks before it.
    """
    kept = sessions(lines).where("kept").select("session_id")
    spoken = symbols(lines, True).where(F.col("symbol").isin("u", "a")).join(kept, "session_id", "left_semi")
    spoken = spoken.withColumn("block", F.floor(F.col("line_no") / BLOCK).cast("int")).dropDuplicates(["session_id", "block", "line_no"])
    inside = Window.partitionBy("session_id", "block").orderBy("line_no")
    spoken = spoken.withColumn("changed", F.coalesce(F.lag("symbol").over(inside) != F.col("symbol"), F.lit(False)).cast("long"))
    blocks = spoken.groupBy("session_id", "block").agg(F.sum("changed").alias("changes"), F.min_by("symbol", "line_no").alias("head"), F.max_by("symbol", "line_no").alias("tail"))
    over = Window.partitionBy("session_id").orderBy("block")
    blocks = blocks.withColumn("own", F.col("changes") + F.coalesce(F.lag("tail").over(over) != F.col("head"), F.lit(False)).cast("long"))
    blocks = blocks.select("session_id", "block", (F.sum("own").over(over) - F.col("changes")).alias("before"))
    numbered = spoken.withColumn("here", F.sum("changed").over(inside)).join(blocks, ["session_id", "block"]).withColumn("turn_no", F.col("before") + F.col("here"))
    return (
        numbered.groupBy("session_id", "turn_no")
        .agg(F.first("symbol").alias("symbol"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("parts"))
        .select("session_id", "turn_no", F.when(F.col("symbol") == "u", "user").otherwise("assistant").alias("role"), "first_line", "last_line", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))
    )
