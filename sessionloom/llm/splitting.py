"""Cutting oversized texts at topic boundaries, with overlap.

Lexical cohesion: at every natural boundary (paragraph, line or sentence end) the words of the BLOCK words before and
after are compared by cosine; a valley's depth is how far the similarity lies below the peaks on both sides. Each
piece is cut at the deepest valley within the second half of its size window; without such a boundary at the last
blank, and without a blank at the last whole character. The next piece starts `overlap` bytes before the cut, or up to
three bytes later if a character would be split.

Results on odd input: null, empty and small texts give no pieces; unreadable payloads hold no items; repeated rows
count once; a text without any blank is cut between characters. Sizes are UTF-8 bytes.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread
from sessionloom.functions.jsonx import read_one, utf8

CONTENT_LIMIT, TRANSCRIPT_LIMIT, OVERLAP, BLOCK = 4_000, 16_000, 200, 40
_WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")
_EDGE = re.compile(rb"\n[ \t\r]*\n\s*|\n|[.!?](?=[ \t])[ \t]+|\xe3\x80\x82")
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]+")


def _depths(data: bytes) -> list[tuple[int, float, int]]:
    """(byte offset, valley depth, strength) of every natural boundary."""
    words = [(m.start(), m[0].lower()) for m in _WORD.finditer(data)]
    starts = [w[0] for w in words]
    edges, similar = [], []
    left: dict[bytes, int] = {}
    right: dict[bytes, int] = {}
    dot = 0
    k = 0
    for _, w in words[:BLOCK]:
        right[w] = right.get(w, 0) + 1
    square_l, square_r = 0, sum(v * v for v in right.values())

    def shift(k: int) -> None:
        """Move the gap from before word k to after it."""
        nonlocal dot, square_l, square_r
        w = words[k][1]
        c = right[w]
        dot -= left.get(w, 0)
        square_r -= 2 * c - 1
        right[w] = c - 1
        c = left.get(w, 0)
        dot += right[w]
        square_l += 2 * c + 1
        left[w] = c + 1
        if k >= BLOCK:
            w = words[k - BLOCK][1]
            c = left[w]
            dot -= right.get(w, 0)
            square_l -= 2 * c - 1
            left[w] = c - 1
        if k + BLOCK < len(words):
            w = words[k + BLOCK][1]
            c = right.get(w, 0)
            dot += left.get(w, 0)
            square_r += 2 * c + 1
            right[w] = c + 1

    for m in _EDGE.finditer(data):
        at = m.end()
        while k < len(words) and starts[k] < at:
            shift(k)
            k += 1
        edges.append((at, 2 if m[0].count(b"\n") > 1 else 1 if b"\n" in m[0] else 0))
        similar.append(dot / math.sqrt(square_l * square_r) if square_l and square_r else 0.0)
    n = len(similar)
    peak_l, peak_r = similar[:], similar[:]
    # the nearest peak on either side: climb while the similarity does not fall
    for i in range(1, n):
        peak_l[i] = max(similar[i], peak_l[i - 1] if similar[i - 1] >= similar[i] else similar[i])
    for i in range(n - 2, -1, -1):
        peak_r[i] = max(similar[i], peak_r[i + 1] if similar[i + 1] >= similar[i] else similar[i])
    return [(at, peak_l[i] + peak_r[i] - 2 * similar[i], strength) for i, (at, strength) in enumerate(edges)]


def split(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of a text over the limit as byte ranges; nothing for smaller ones."""
    if limit <= overlap + 8:
        raise ValueError("the limit must exceed the overlap")
    data = text.encode("utf-8", "replace")
    size = len(data)
    if size <= limit:
        return []
    valleys = _depths(data)
    pieces, start, cut, k = [], 0, 0, 0
    while size - start > limit:
        low, high = max(cut + 1, start + limit // 2, start + overlap + 4), start + limit
        while k < len(valleys) and valleys[k][0] < low:
            k += 1
        best, j = None, k
        while j < len(valleys) and valleys[j][0] <= high:
            at, depth, strength = valleys[j]
            if best is None or (depth, strength, at) > best:
                best = (depth, strength, at)
            j += 1
        if best:
            cut = best[2]
        else:
            gaps = [m.end() for m in _GAP.finditer(data, low, high)]
            cut = gaps[-1] if gaps else high
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
        pieces.append((start, cut))
        start = cut - overlap
        while data[start] & 0xC0 == 0x80:
            start += 1
    return [*pieces, (start, size)]


def _pieces(items: list[tuple[int, str, str, str, int]], batch: pa.RecordBatch) -> dict | None:
    """Rows out of (row, kind, key, text, limit)."""
    rows = []
    for _, kind, key, text, limit in items:
        data = text.encode("utf-8", "replace")
        rows += [(kind, key, i, a, b, data[a:b].decode()) for i, (a, b) in enumerate(split(text, limit))]
    if not rows:
        return None
    return dict(zip(("item_kind", "item_key", "piece_no", "byte_start", "byte_end", "piece"), map(pa.array, zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))))


_SCHEMA = "item_kind string, item_key string, piece_no int, byte_start long, byte_end long, piece string"


def content_parts(value) -> list[tuple[int, str]]:
    """(part, text) of a payload's content."""
    content = value.get("content") if isinstance(value, dict) else None
    if isinstance(content, str):
        return [(0, content)]
    return [(i, p["text"]) for i, p in enumerate(content) if isinstance(p, dict) and isinstance(p.get("text"), str)] if isinstance(content, list) else []


def pieces(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """The ordered pieces of every content part and transcript over its limit.

    A JSON string is never shorter than its text, so only payloads over the limit leave the scan.
    """

    def of_lines(batch: pa.RecordBatch) -> dict | None:
        items = []
        for i, (s, n, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("session_id", "line_no", "payload")))):
            ok, value = read_one(text)
            if ok:
                items += [(i, "content", f"{s}/{n}/{part}", utf8(t), CONTENT_LIMIT) for part, t in content_parts(value) if len(t) * 4 > CONTENT_LIMIT]
        return _pieces(items, batch)

    def of_sessions(batch: pa.RecordBatch) -> dict | None:
        return _pieces([(i, "transcript", p, t, TRANSCRIPT_LIMIT) for i, (p, t) in enumerate(zip(batch["extractor_path"].to_pylist(), batch["transcript"].to_pylist()))], batch)

    long_lines = lines.select("session_id", "line_no", "payload").where((F.octet_length("payload") > CONTENT_LIMIT) & F.col("session_id").isNotNull() & F.col("line_no").isNotNull())
    long_sessions = sessions.select("extractor_path", "transcript").where((F.octet_length("transcript") > TRANSCRIPT_LIMIT) & F.col("extractor_path").isNotNull())
    both = by_batch(spread(long_lines), of_lines, _SCHEMA).unionByName(by_batch(spread(long_sessions), of_sessions, _SCHEMA))
    return both.dropDuplicates(["item_kind", "item_key", "piece_no"])


def oversized(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """The items that were split."""
    return pieces(lines, sessions).where("piece_no = 0").select("item_kind", "item_key")
