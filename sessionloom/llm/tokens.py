"""Token ids of whole texts by a public byte-level BPE, exact on texts of any length.

A text is cut in halves down to leaves of LEAF code points, the leaves are encoded on their own (those of a long text
in parallel tasks), and a tree of joins puts them together. A join re-encodes a window around the seam, growing until
its ends agree with both sides: with the pre-split on the left at a place that the seam cannot reach back to, and on
the right where a boundary of the re-split window falls on a boundary of the right half; from there on the right half
holds. Inside one long pre-split run (no boundary within reach) the tokens themselves are joined the same way: two
token lists agree if the tokens that meet at both ends of the re-encoded window are the ones already there.

Results on odd input: null and empty texts give an empty list; no normalisation, no special tokens. doc_id is a key of
the table: should a row be repeated all the same, its ids are, whatever the text's length.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread

FOLDER = os.environ.get("LOOM_TOKENIZERS", "/opt/tokenizers")
LEAF = 262_144  # code points; above it a text is encoded by several tasks
RUN = 4_096  # bytes; longer pre-split runs are encoded by halves
#: The pre-split pattern that belongs to the public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How far before the end of a text its last code points can still change a pre-split boundary.
REACH = 4


class Encoder:
    """One vocabulary file; halves and joins over the plain encoder of runs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {v: k for k, v in ranks.items()}
        self.split = regex.compile(PATTERN)

    def run(self, data: bytes) -> list[int]:
        """One pre-split run: by halves if it is long."""
        if len(data) <= RUN:
            return self.plain._encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.run(data[:half]), self.run(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Two encoded halves of one run: re-encode growing windows of tokens until both ends stay as they were."""
        size = 8
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = b"".join(self.bytes[t] for t in left[a:] + right[:b])
            new = self.plain._encode_single_piece(window)
            if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
                return left[:a] + new + right[b:]
            if a == 0 and b == len(right):
                return new
            size *= 2

    def leaf(self, text: str) -> list[tuple[int, list[int]]]:
        """(end offset, ids) of each pre-split run."""
        return [(m.end(), self.run(m[0].encode())) for m in self.split.finditer(text)]

    def seam(self, left: list[tuple[int, list[int]]], right: list[tuple[int, list[int]]], text: str, at: int) -> list[tuple[int, list[int]]]:
        """Join the runs of text[:at] and text[at:]; offsets count from the text's start."""
        keep = len(left)
        while keep and left[keep - 1][0] > at - REACH:
            keep -= 1
        start = left[keep - 1][0] if keep else 0
        ends = {e: i for i, (e, _) in enumerate(right)}
        new = []
        for m in self.split.finditer(text, start):
            new.append((m.end(), self.run(m[0].encode())))
            if m.end() > at and m.end() in ends:
                return left[:keep] + new + right[ends[m.end()] + 1 :]
        return left[:keep] + new

    def tree(self, text: str, leaf: int) -> list[tuple[int, list[int]]]:
        """Halves down to the leaf size, then joins back up."""
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        right = [(e + half, ids) for e, ids in self.tree(text[half:], leaf)]
        return self.seam(self.tree(text[:half], leaf), right, text, half)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of a whole text; texts without a long run take the vectorised path, which gives the same."""
        if len(text) <= RUN:
            return self.plain.encode_ordinary(text)
        if len(text) <= leaf and not _LONG_RUN.search(text):
            return self.plain.encode_ordinary(text)
        return [t for _, ids in self.tree(text, leaf) for t in ids]


#: A stretch that may be one long pre-split run: letters, digits, other marks or blanks.
_LONG_RUN = regex.compile(rf"\p{{L}}{{{RUN // 4},}}+|\p{{N}}{{{RUN // 4},}}+|[^\s\p{{L}}\p{{N}}]{{{RUN // 4},}}+|\s{{{RUN // 4},}}+")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_IDS = pa.list_(pa.int32())
_KEY = ("doc_id", "hashed", "copies")


def encode(documents: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of every document.

    Texts up to `leaf` code points are encoded where they are read. The leaves of longer ones become rows of their own,
    each with REACH-proof context, and come together by document; only those move through a shuffle.
    """
    path = f"{folder}/{name}"

    def whole(batch: pa.RecordBatch) -> dict:
        e = encoder(path)
        return {"doc_id": batch["doc_id"], "ids": pa.array([e.encode(t) if t else [] for t in batch["text"].to_pylist()], _IDS)}

    def leaves(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for doc, hashed, copies, text in zip(*(batch[c].to_pylist() for c in (*_KEY, "text"))):
            rows += [(doc, hashed, copies, at, text[at : at + leaf]) for at in range(0, len(text), leaf)]
        return dict(zip((*_KEY, "at", "text"), map(pa.array, zip(*rows), (*(pa.int64(),) * 4, pa.string())))) if rows else None

    def encoded(batch: pa.RecordBatch) -> dict:
        e = encoder(path)
        runs = [e.leaf(t) for t in batch["text"].to_pylist()]
        return {
            **{c: batch[c] for c in (*_KEY, "at", "text")},
            "ends": pa.array([[end for end, _ in r] for r in runs], pa.list_(pa.int64())),
            "ids": pa.array([[ids for _, ids in r] for r in runs], pa.list_(_IDS)),
        }

    def joined(key, table):
        e = encoder(path)
        parts = sorted(table.to_pylist(), key=lambda r: r["at"])
        parts = [(r["text"], [(end, ids) for end, ids in zip(r["ends"], r["ids"])]) for r in parts]
        while len(parts) > 1:
            level = []
            for k in range(0, len(parts) - 1, 2):
                (a, x), (b, y) = parts[k], parts[k + 1]
                level.append((a + b, e.seam(x, [(end + len(a), ids) for end, ids in y], a + b, len(a))))
            parts = level + parts[len(parts) - len(parts) % 2 :]
        copies = key[2].as_py()
        return pa.table({"doc_id": pa.array([key[0].as_py()] * copies, pa.int64()), "ids": pa.array([[t for _, ids in parts[0][1] for t in ids]] * copies, _IDS)})

    source = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = by_batch(source.where(~is_long), whole, "doc_id long, ids array<int>")
    longs = source.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("hashed", F.xxhash64("text"))
    columns = "doc_id long, hashed long, copies long, at long, text string"
    pieces = by_batch(longs.select(*_KEY, "text"), leaves, columns)
    parts = by_batch(pieces.repartition("doc_id", "at"), encoded, columns + ", ends array<long>, ids array<array<int>>")
    return short.unionByName(parts.groupBy(*_KEY).applyInArrow(joined, "doc_id long, ids array<int>"))
