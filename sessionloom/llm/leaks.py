"""Passages of held-out items inside documents: CGK embedding, bit-sampling LSH, exact verification.

Documents and items are read as word sequences. Every window of WINDOW words of an item, and every window of a document
that can match one, is embedded by CGK random walks: in step j the walk emits the word under its pointer and moves on by
a shared random bit of (j, word), so that a small edit distance becomes a small Hamming distance. A band samples a few
of the emitted places; equal samples make a candidate. Equal windows embed equally, so they collide in every band.
Windows with edits may miss each other in all bands, so these meet by segments too: of `edits` + 1 segments of the item's
window one is free of edits and stands in the document's window, moved by edits / 2 words at most as both are of one
length. No window within the allowed edits is lost. Candidates are verified: p8_found by equality of the 13 words,
p8_passages by exact word edit distance.

Only windows in which all words (or all but the allowed edits) are item words are embedded; others cannot match.

The items are a stated query set: they are read in blocks of at most BLOCK_BYTES, one pass over the documents each, so
what goes to the workers has a checked bound. Results on odd input: null and empty texts, and items under 13 words, give
no rows; repeated rows count once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread

WINDOW, BANDS, SAMPLES, SEED = 13, 24, 4, 20_240_501
BLOCK_BYTES = 32_000_000
_WORD = re.compile(r"[^\W_]+")  # letters and digits


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower())


class Index:
    """The windows of one block of items under every band's key."""

    def __init__(self, items: tuple[tuple[int, str], ...], window: int = WINDOW, bands: int = BANDS, edits: int = 0):
        self.window, self.bands, self.edits = window, bands, edits
        texts = [(i, words(t)) for i, t in items if t]
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for _, t in texts for w in t}))}
        rng = np.random.default_rng(SEED)
        self.steps = 3 * window
        self.bits = rng.integers(0, 2, (self.steps, len(self.ids) + 1), dtype=np.uint8)
        # the walk is at word j/2 after j steps on average: sample where it still is inside the window
        self.places = [np.sort(rng.choice(2 * window - 2, SAMPLES, replace=False)) for _ in range(bands)]
        self.weights = rng.integers(1, 2**62, (bands, SAMPLES), dtype=np.int64) | 1
        rows, owner = [], []
        for i, t in texts:
            codes = [self.ids[w] for w in t]
            for k in range(len(codes) - window + 1):
                rows.append(codes[k : k + window])
                owner.append(i)
        self.windows = np.array(rows, np.int32).reshape(-1, window)
        self.owner = np.array(owner, np.int64)
        keys = self.keys(self.windows)
        self.sorted = []
        for b in range(bands):
            order = np.argsort(keys[b], kind="stable")
            self.sorted.append((keys[b][order], order))
        self.segments = []
        for k in range(edits + 1 if edits else 0):
            a, b = window * k // (edits + 1), window * (k + 1) // (edits + 1)
            key = self.segment(self.windows, a, b)
            order = np.argsort(key, kind="stable")
            self.segments.append((a, b, key[order], order))

    @staticmethod
    def segment(windows: np.ndarray, a: int, b: int) -> np.ndarray:
        """A 64-bit key of the windows' words a to b."""
        key = np.zeros(len(windows), np.int64)
        with np.errstate(over="ignore"):
            for j in range(a, b):
                key = (key ^ windows[:, j]) * np.int64(-7046029254386353131)
                key ^= (key >> np.int64(29)) & np.int64(0x7FFFFFFFF)
        return key

    def keys(self, windows: np.ndarray) -> list[np.ndarray]:
        """One 64-bit key a band and window."""
        n = len(windows)
        last = int(max(p[-1] for p in self.places)) + 1
        out = np.zeros((last, n), np.int64)
        at, every = np.zeros(n, np.int64), np.arange(n)
        padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], 1)
        for j in range(last):
            symbol = padded[every, at]
            out[j] = symbol
            at = np.minimum(at + self.bits[j, symbol], self.window)
        keys = []
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                key = np.zeros(n, np.int64)
                for w, p in zip(self.weights[b], self.places[b]):
                    key = (key ^ (out[p] * w)) * np.int64(-7046029254386353131)
                    key ^= (key >> np.int64(29)) & np.int64(0x7FFFFFFFF)
                keys.append(key)
        return keys

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of windows, item window) pairs that agree in at least one band or segment."""
        left, right = [], []
        lookups = [(*x, key) for x, key in zip(self.sorted, self.keys(windows))]
        for a, b, sorted_keys, order in self.segments:
            for shift in range(max(-(self.edits // 2), -a), min(self.edits // 2, self.window - b) + 1):
                lookups.append((sorted_keys, order, self.segment(windows, a + shift, b + shift)))
        for sorted_keys, order, key in lookups:
            a, b = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
            n = b - a
            row = np.repeat(np.arange(len(key)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            left.append(row)
            right.append(order[place])
        pairs = np.unique(np.concatenate(left) * max(1, len(self.windows)) + np.concatenate(right))
        return pairs // max(1, len(self.windows)), pairs % max(1, len(self.windows))

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word of the document's window, word edits) of each verified candidate."""
        get = self.ids.get
        codes = np.array([get(w, 0) for w in words(text)], np.int32)
        n = len(codes) - self.window + 1
        if n <= 0 or not len(self.windows):
            return []
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        at = np.flatnonzero(known[self.window :] - known[: n] >= self.window - self.edits)
        if not len(at):
            return []
        windows = codes[at[:, None] + np.arange(self.window)]
        row, item = self.candidates(windows)
        same = (windows[row] == self.windows[item]).all(1)
        out = {(int(self.owner[i]), int(at[r]), 0) for r, i in zip(row[same], item[same])}
        if self.edits:
            for r, i in zip(row[~same], item[~same]):
                d = edit_distance(windows[r].tolist(), self.windows[i].tolist(), self.edits)
                if d <= self.edits:
                    out.add((int(self.owner[i]), int(at[r]), d))
        return sorted(out)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance over words; more than `most` ends early."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(4)
def _index(items: tuple[tuple[int, str], ...], window: int, bands: int, edits: int) -> Index:
    return Index(items, window, bands, edits)


def _blocks(items: DataFrame) -> list[tuple[tuple[int, str], ...]]:
    """The query set on the driver, in blocks of a bounded size; read one partition at a time."""
    blocks, now, size = [], [], 0
    for r in items.select("item_id", "text").where("text is not null and item_id is not null").distinct().toLocalIterator():
        if now and size + len(r.text) > BLOCK_BYTES // 4:
            blocks, now, size = [*blocks, tuple(sorted(now))], [], 0
        now.append((r.item_id, r.text))
        size += len(r.text)
    return [*blocks, tuple(sorted(now))]


def passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, bands: int = BANDS, edits: int = 0) -> DataFrame:
    """(doc_id, item_id, first word of the window in the document, word edits) of every verified window."""
    source = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    out = None
    for block in _blocks(items):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> dict | None:
            index = _index(shared.value, window, bands, edits)
            rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for hit in index.hits(t)]
            return dict(zip(("doc_id", "item_id", "word_no", "edits"), map(pa.array, zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32())))) if rows else None

        part = by_batch(source, run, "doc_id long, item_id long, word_no long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): at least 13 consecutive words of the item stand in the document."""
    return passages(documents, items).select("doc_id", "item_id").distinct()
