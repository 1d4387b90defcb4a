"""The registry of masked literals: hashes and byte lengths, never the literals; growth and leak scans.

Scanning splits a text at the delimiters that no learnt literal contains and probes the byte windows inside each run;
literals of unknown origin may hold delimiters, so their lengths are probed over the whole text. A Bloom filter of the
registry, of bounded size, is tested inside the scan: windows that it rejects never become rows, so what is joined and
shuffled is in proportion to the hits. Results on odd input: null texts give no hits; an empty registry gives none; a
registry of hashes without lengths is probed at 8 to 256 bytes.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.frames import stash
from sessionloom.functions.text import MIN_LITERAL_BYTES, masked_literals, runs, zipped
from sessionloom.operators.state import atomic_write

WIDEST, CHUNK = 256, 4096
BLOOM = (6, 23)  # log2 of the least and most bits of the filter (1 MB); 16 bits a hash as far as they reach

SCHEMA = "hash string, length int, category string"


def draft_literals(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(draft_id, literal) of what the tokeniser masked in quote, title, category and (pairwise) tags; not deduplicated."""
    pairs = drafts.dropDuplicates(["draft_id"]).alias("d").join(tokenised.dropDuplicates(["draft_id"]).alias("t"), "draft_id")
    tags = F.flatten(F.transform(zipped(F.col("d.tags"), F.col("t.tags")), lambda p: masked_literals(p["a"], p["b"])))
    parts = [masked_literals(F.col("d.quote"), F.col("t.body")), masked_literals(F.col("d.title"), F.col("t.title")), masked_literals(F.col("d.category"), F.col("t.category")), tags]
    every = F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))
    return pairs.select("draft_id", F.explode(every).alias("literal"))


def grow(literals: DataFrame) -> DataFrame:
    """(hash, length) of distinct literals of at least MIN_LITERAL_BYTES bytes."""
    return literals.where(F.octet_length("literal") >= MIN_LITERAL_BYTES).select(F.sha2("literal", 256).alias("hash"), F.octet_length("literal").alias("length")).distinct()


def learn(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """The registry of a set of drafts, written once: a scan reads it for its lengths and again for its hashes."""
    return stash(grow(draft_literals(drafts, tokenised)))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of hashes, lengths and category labels."""
    return old.unionByName(new, allowMissingColumns=True).distinct()


def categories(tokenised: DataFrame) -> DataFrame:
    """The types of all placeholders in use, as the registry's category labels."""
    marks = F.regexp_extract_all("body", F.lit(r"#([A-Z][A-Z0-9_]*)_[0-9]{3,}#"), F.lit(1))
    return tokenised.select(F.explode(marks).alias("category")).distinct()


def summary(registry: DataFrame) -> tuple[list[int], int]:
    """The lengths to probe, at most one per byte length, and about how many hashes there are; one pass.

    Lengths are 8 to 256 if hashes are there and no length is known.
    """
    found = registry.agg(F.sort_array(F.collect_set("length")).alias("lengths"), F.approx_count_distinct("hash").alias("n")).first()
    return list(found["lengths"]) or (list(range(MIN_LITERAL_BYTES, WIDEST + 1)) if found["n"] else []), found["n"]


def lengths_of(registry: DataFrame) -> list[int]:
    return summary(registry)[0]


def _positions(hash_column, bits: int) -> list:
    """Two bits of the filter for a hash."""
    h = F.xxhash64(hash_column)
    return [h.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(h, 32).bitwiseAND((1 << bits) - 1)]


def bloom(registry: DataFrame, n: int) -> list[int]:
    """The filter for about n hashes as 64-bit words; its bits are set by the executors, at most 2 ** BLOOM[1] of them."""
    hashes = registry.where("hash is not null").select("hash")
    bits = min(BLOOM[1], max(BLOOM[0], (16 * n).bit_length()))
    at = hashes.select(F.explode(F.array(*_positions(F.col("hash"), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = [0] * ((1 << bits) // 64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def _windows(texts: DataFrame, keys: list[str], runs_of, lengths: list[int], words: list[int]) -> DataFrame:
    """(keys, hash) of the byte windows of the given lengths inside each run that the filter lets pass."""
    bits = len(words).bit_length() + 5
    piece = texts.select(*keys, F.explode(F.array_distinct(runs_of)).alias("run")).where(F.octet_length("run") >= min(lengths))
    sized = piece.withColumn("raw", F.encode("run", "UTF-8")).withColumn("n", F.octet_length("run")).withColumn("w", F.explode(F.array(*map(F.lit, lengths)))).where("n >= w")
    # a run of any length makes rows of at most CHUNK windows
    last = F.col("n") - F.col("w") + 1
    parts = sized.withColumn("at", F.explode(F.sequence(F.lit(1), last, F.lit(CHUNK)))).withColumn("to", F.least(F.col("at") + CHUNK - 1, last))
    filter_words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")  # a constant of the plan

    def passes(h):
        tests = [F.get(filter_words, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))) != 0 for p in _positions(h, bits)]
        return tests[0] & tests[1]

    hashes = F.transform(F.sequence("at", "to"), lambda i: F.sha2(F.substring(F.col("raw"), i, F.col("w")), 256))
    return parts.select(*keys, F.explode(F.filter(hashes, passes)).alias("hash"))


def leaks(texts: DataFrame, keys: list[str], column: str, registry: DataFrame, delimiter_free: bool = True, since: str | None = None) -> DataFrame:
    """(keys, hash): the distinct registry hashes whose literals stand in each text.

    delimiter_free tells that all literals were learnt by this library (none holds a delimiter); otherwise whole texts
    are probed. With `since`, one of the keys, a hash counts only if the registry's first_seq is not above it.
    """
    lengths, n = summary(registry)
    if not lengths:
        return texts.select(*keys, F.lit(None).cast("string").alias("hash")).where(F.lit(False))
    source = texts.where(F.col(column).isNotNull())
    split = runs(F.col(column)) if delimiter_free else F.array(F.col(column))
    passed = _windows(source, keys, split, lengths, bloom(registry, n))
    # the registry grows with the data: the join strategy is left to the optimizer's size estimate
    if since is None:
        return passed.join(registry.select("hash").distinct(), "hash", "left_semi").select(*keys, "hash").distinct()
    first = registry.groupBy("hash").agg(F.min("first_seq").alias("first_seq"))
    return passed.join(first, "hash").where(F.col("first_seq") <= F.col(since)).select(*keys, "hash").distinct()


def field_hits(entries: DataFrame, registry: DataFrame, since: str | None = None) -> DataFrame:
    """(draft_id, field, hits): title, category, each tag and body on their own; repeats across fields are kept."""
    one = entries.dropDuplicates(["draft_id"])
    parts = F.concat(
        F.array(*(F.struct(F.lit(f).alias("field"), F.lit(0).alias("ix"), F.col(f).alias("text")) for f in ("title", "category", "body"))),
        F.coalesce(F.transform("tags", lambda t, i: F.struct(F.lit("tag").alias("field"), i.alias("ix"), t.alias("text"))), F.array().cast("array<struct<field:string,ix:int,text:string>>")),
    )
    more = [since] if since else []
    long = one.select("draft_id", *more, F.inline(parts))
    return leaks(long, ["draft_id", *more, "field", "ix"], "text", registry, since=since).groupBy("draft_id", "field").agg(F.count("*").alias("hits"))


def first_taught(learnt: DataFrame) -> DataFrame:
    """(hash, length, first_seq) out of (seq, literal): a literal counts from the draft on that taught it."""
    return learnt.where(F.octet_length("literal") >= MIN_LITERAL_BYTES).groupBy(F.sha2("literal", 256).alias("hash"), F.octet_length("literal").alias("length")).agg(F.min("seq").alias("first_seq"))


def sequential_hits(learnt: DataFrame, bodies: DataFrame) -> DataFrame:
    """Order-dependent scan: (draft_id, hash). learnt: (seq, literal); bodies: (draft_id, seq, body)."""
    return leaks(bodies, ["draft_id", "seq"], "body", stash(first_taught(learnt)), since="seq").select("draft_id", "hash").distinct()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Import of a registry file: three independent lists, any of which may be missing; missing or blank files are empty."""
    text = open(path).read() if os.path.exists(path) else ""
    data = json.loads(text) if text.strip() else {}
    rows = [(h, None, None) for h in data.get("hashes", [])] + [(None, n, None) for n in data.get("lengths", [])] + [(None, None, c) for c in data.get("categories", [])]
    return spark.createDataFrame(rows, SCHEMA)


def save(registry: DataFrame, path: str) -> None:
    """Export of a small registry as a file; the engine itself keeps a table (operators/tables.py)."""
    rows = [r.asDict() for r in registry.collect()]
    names = {"hashes": "hash", "lengths": "length", "categories": "category"}
    atomic_write(path, json.dumps({name: sorted({r[c] for r in rows if r.get(c)}) for name, c in names.items()}, indent=2).encode())
