"""Near-duplicate texts: shingle fingerprints, cells of the rarest shingles, segment-count bound, exact verification.

A text is the set of its 3-word shingles, as 32-bit fingerprints. Partners at Jaccard similarity t share at least t of
the larger set, so whatever their length the rarest SHARED shingles that they share are among the (1 - t) * n + SHARED
rarest of each: each of these is a cell. Two texts are candidates if they meet in SHARED cells, or in one if they
need not share so many. No pair is lost. Frequencies come from a sketch over all texts, so the order of shingles is the
same in every text; the sketch grows with the corpus, a bucket for INSTANCES shingles, within fixed bounds. A shingle
alone in its bucket is in no other text and makes no cell. A cell's row carries the text's size and the shingle's place
in that order; a meeting after which too few shingles are left in either text doesn't count (see _pairs).

A bucket's count is an upper bound of its shingles' frequencies. Cells whose bound is over BLOCK are counted exactly, and
those that really have so many texts are split in blocks, so that no task holds more than about 2 * BLOCK of a hot
cell's texts; every two blocks meet in one task. How often a row is copied depends on its own cell alone, not on the
corpus' size.

The fingerprint space is cut into segments; a text's embedding is the count of its shingles in each (its per-segment
popcounts). The Manhattan distance of two embeddings is a lower bound of the symmetric difference of the sets, which at
similarity t is at most (1 - t) / (1 + t) * (|A| + |B|). At t = 0.6 that radius is as wide as the counts' own spread, so
a grid over counts keeps nearly every pair (the README has figures); the bound only filters what met.

Candidates are checked by the Manhattan bound, then exactly. Texts with equal sets form one class with one id; pairs of
classes are found once and expanded by membership at the end.

Results on odd input: null texts and texts under three words are in no pair; repeated rows of a key count once; extra
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread, stash

SHINGLE, THRESHOLD, SHARED, BLOCK = 3, 0.6, 3, 4096
INSTANCES, SKETCHES = 8, (18, 24)  # shingles of the corpus for a bucket of the sketch; log2 of the least and most buckets
MARKS = (16, 28)  # log2 of the least and most bits over the candidates' ids
WIDTH = 1 << 14  # buckets, or bytes of bits, that travel as one row
CELLS = 2_000_000  # cells a task, about
PIECE = 4_000_000  # code points that are read into words at a time, or one text
_SOURCE = {"drafts": 0, "entries": 1}
MOST = 1 << 15  # blocks of a cell: 134 million texts
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.fromiter((c.isalnum() for c in map(chr, range(0x110000))), bool, 0x110000)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2 ** 64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, both = int(_K1), []
        for x in (base, pow(base, -1, 1 << 64)):
            factors = np.full(n + n // 4, x, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, 64-bit hash) of every word, in order: polynomial hashes as differences of running sums."""
    owner, hashes, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < PIECE):
            size += len(texts[end] or "") + 1
            end += 1
        code = np.frombuffer("\n".join((t or "").replace("\n", " ").lower() for t in texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        flag = np.concatenate([[False], _letters()[code], [False]])
        edge = np.flatnonzero(flag[1:] != flag[:-1])
        first, last = edge[::2], edge[1::2]
        power, inverse = _powers(len(code) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)])])
        hashes.append(_mix((total[last] - total[first]) * inverse[first] * _K1 + (last - first).astype(np.uint64)))
        owner.append(at + np.searchsorted(np.flatnonzero(code == 10), first))
        at = end
    return (np.concatenate(owner), np.concatenate(hashes)) if owner else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a list of texts: (index of the text, 32-bit fingerprint), sorted by both, each once."""
    owner, h = _words(texts)
    if len(h) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    s = _mix(h[:-2] * _K1 + ((h[1:-1] << np.uint64(21)) | (h[1:-1] >> np.uint64(43))) * _K2 + ((h[2:] << np.uint64(42)) | (h[2:] >> np.uint64(22))) * _K3)
    inside = owner[:-2] == owner[2:]
    both = np.unique((owner[:-2][inside].astype(np.uint64) << np.uint64(32)) | (s[inside] >> np.uint64(32)))
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """The sorted fingerprints of one text's shingles; none under three words."""
    return fingerprints([text])[1]


def cells(src: str, owner: np.ndarray, sh: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
    """The cells of a batch of texts: (index of the text, key, bound of the shingle's frequency, the text's size, the shingle's place).

    A text's rarest n - ceil(t * n) + SHARED shingles, each a cell of its own; equal frequencies are ordered by fingerprint.
    """
    if not len(sh):
        return owner, np.zeros(0, np.int64), np.zeros(0, np.int64), owner, owner
    number = np.bincount(owner)  # how many shingles a text has
    bound = sketch[sh & np.uint32(len(sketch) - 1)]
    order = np.lexsort((sh, bound, owner)) if len(number) > 1 << 16 else None
    if order is None:  # the same order by one sort
        key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (bound.astype(np.uint64) << np.uint64(32)) | sh)
        sh, bound = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16)
    else:
        sh, bound = sh[order], bound[order]
    first = np.cumsum(number) - number
    place, number = np.arange(len(owner)) - first[owner], number[owner]  # owners ascend in both orders
    take = (place < number - np.ceil(THRESHOLD * number - 1e-9) + SHARED) & (bound > 1)  # 1: in no other text
    # the shingle, then room for two blocks (see _in_blocks), then the source
    return owner[take], sh[take].astype(np.int64) + (_SOURCE[src] << 62), bound[take], number[take], place[take]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def counts_bound(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the embeddings' Manhattan distance allows the threshold."""
    most = (1 - THRESHOLD) / (1 + THRESHOLD) * (len(a) + len(b))
    va, vb = (np.bincount(x >> np.uint32(26), minlength=64) for x in (a, b))
    return np.abs(va - vb).sum() <= most + 1e-9


def _texts(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
    """(src, key, id, text): equal texts of a source share an id and are one class."""
    return df.select(F.lit(src).alias("src"), F.col(key).alias("key"), F.xxhash64(F.lit(src), F.col(text)).alias("id"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())


def _prints(texts: DataFrame) -> DataFrame:
    """(id, sh): each text's fingerprints as bytes; texts under three words are left out."""

    def run(batch: pa.RecordBatch) -> dict | None:
        owner, sh = fingerprints(batch["text"].to_pylist())
        rows, first = np.unique(owner, return_index=True)
        cut = np.append(first, len(sh))
        return {"id": batch["id"].take(pa.array(rows)), "sh": pa.array([sh[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())} if len(rows) else None

    return by_batch(spread(texts.select("id", "text")), run, "id long, sh binary")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, fingerprint) of a batch of _prints."""
    blobs = batch["sh"].to_pylist()
    return np.repeat(np.arange(len(blobs)), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4), np.frombuffer(b"".join(blobs), np.uint32)


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per class of a batch: copies collapse before any shuffle."""
    first = np.unique(batch["id"].to_numpy(zero_copy_only=False), return_index=True)[1]
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def _gather(parts: DataFrame, add: Callable[[np.ndarray, bytes], None], kind: type, done: Callable[[np.ndarray], np.ndarray]) -> list[bytes]:
    """(part, data) rows of any number added up by part: each part's rows stream through one task. Fixed size."""

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist()):
                if part not in own:
                    own[part] = np.zeros(WIDTH, kind)
                add(own[part], data)
        for part, x in own.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([done(x).tobytes()], pa.binary())})

    rows = parts.repartition("part").mapInArrow(run, "part int, data binary").toArrow()
    return [x for _, x in sorted(zip(rows["part"].to_pylist(), rows["data"].to_pylist()))]


def _log2(n: float, bounds: tuple[int, int]) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, n))), *bounds))


def _sketch(prints: DataFrame, instances: int) -> np.ndarray:
    """How many texts have a shingle in each bucket: exact up to 2^15, then in steps of 1/1024 of a power of two."""
    size = 1 << _log2(instances / INSTANCES, SKETCHES)

    def run(batches):
        own = np.zeros(size, np.uint32)
        for batch in batches:
            bucket, n = np.unique(_unpack(batch)[1] & np.uint32(size - 1), return_counts=True)
            own[bucket] += n.astype(np.uint32)
        for part in range(size // WIDTH):  # as byte planes: the upper three are nearly empty
            planes = own[part * WIDTH : (part + 1) * WIDTH].view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([zlib.compress(planes, 1)], pa.binary())})

    def add(own: np.ndarray, data: bytes) -> None:
        own += np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]

    def done(n: np.ndarray) -> np.ndarray:
        return np.where(n < 1 << 15, n, (1 << 15) + 1024 * (np.log2(np.maximum(n, 1)) - 15)).astype(np.uint16)

    parts = _gather(prints.select("sh").mapInArrow(run, "part int, data binary"), add, np.uint64, done)
    return np.frombuffer(b"".join(parts), np.uint16) if parts else np.zeros(size, np.uint16)


def _cell_rows(prints: DataFrame, src: str, sketch, hot: bool, tasks: int | None = None) -> DataFrame:
    """(cell, id, info) of every text's cells whose bound is over BLOCK, or of the others packed for `tasks`; info: see _info."""

    def run(batch: pa.RecordBatch) -> dict:
        batch = _once(batch)
        text, key, bound, number, place = cells(src, *_unpack(batch), sketch.value)
        take = (bound > BLOCK) == hot
        ids = batch["id"].to_numpy(zero_copy_only=False)[text[take]]
        rows = key[take], ids, _info(number[take], place[take])
        return _pack(*rows, tasks) if tasks else dict(zip(("cell", "id", "info"), map(pa.array, rows)))

    return by_batch(prints, run, "task int, cells binary" if tasks else "cell long, id long, info long")


def _pack(cell: np.ndarray, ids: np.ndarray, info: np.ndarray, tasks: int) -> dict | None:
    """One row a task: its cells in order, as byte planes of the steps between them, and each text's id once."""
    if not len(cell):
        return None
    with np.errstate(over="ignore"):
        task = (_mix(cell.view(np.uint64) * _K3) % np.uint64(tasks)).astype(np.int64)
    order = np.lexsort((cell, task))
    at, first = np.unique(task[order], return_index=True)
    blobs = []
    for mine in np.split(order, first[1:]):
        own, text = np.unique(ids[mine], return_inverse=True)
        step = np.diff(cell[mine].view(np.uint64), prepend=np.uint64(0))
        columns = (own, step, text.astype(np.uint32), info[mine])
        blobs.append(b"".join([np.array([len(own), len(mine)], np.int64).tobytes(), *(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns)]))
    return {"task": pa.array(at.astype(np.int32)), "cells": pa.array(blobs, pa.binary())}


def _packed(rows: DataFrame, tasks: int) -> DataFrame:
    return by_batch(rows, lambda b: _pack(*(b[c].to_numpy(zero_copy_only=False) for c in ("cell", "id", "info")), tasks), "task int, cells binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts, n = np.frombuffer(blob, np.int64, 2)
    out, at = [], 16
    for size, kind in ((texts, np.int64), (n, np.uint64), (n, np.uint32), (n, np.int64)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, size * width, at).reshape(width, -1).T).view(kind)[:, 0])
        at += size * width
    return np.cumsum(out[1], dtype=np.uint64).view(np.int64), out[0][out[2]], out[3]


def _info(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The text's size, the shingle's place, and the side: of two blocks in one task 0 or 1; 2 where all texts meet."""
    return (size.astype(np.int64) << 32) + (place.astype(np.int64) << 2) + 2


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The rows of cells that may be hot; a hot cell's texts go to every pair of blocks with their own."""
    number = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = number.select("cell", F.least(F.ceil(F.col("n") / BLOCK), F.lit(MOST)).cast("long").alias("blocks"))
    own = F.pmod("id", "blocks")
    copies = rows.join(hot, "cell", "left").withColumn("own", own).withColumn("other", F.explode(F.coalesce(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array(F.lit(None).cast("long")))))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0)
    meeting = F.shiftleft(F.least("own", "other"), 15) + F.greatest("own", "other")
    split = F.col("other").isNotNull()
    return copies.select(F.when(split, F.col("cell") + F.shiftleft(meeting, 32)).otherwise(F.col("cell")).alias("cell"), "id", F.when(split, F.col("info") - 2 + side).otherwise(F.col("info")).alias("info"))


def _meet(batches):
    """A task's cells, about CELLS: every two different ids of a cell that can be partners, and in how many cells."""
    own: dict[int, list] = {}
    for batch in batches:
        for task, blob in zip(batch["task"].to_pylist(), batch["cells"].to_pylist()):
            own.setdefault(task, []).append(blob)
    while own:
        cell, ids, info = (np.concatenate(x) for x in zip(*map(_unpacked, own.popitem()[1])))
        order = np.lexsort((ids, cell))
        cell, ids, info = cell[order], ids[order], info[order]
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1])])  # copies of a class meet as one
        yield from _pairs(cell[new], ids[new], info[new])


def _pairs(cell: np.ndarray, ids: np.ndarray, info: np.ndarray):
    """Rows sorted by cell and id.

    Partners of sizes m and n share at least t / (1 + t) * (m + n) shingles. At the k-th that they share, all but k - 1 of
    these are still to come, so the first SHARED meetings count; of the others any may be dropped.
    """
    found, rows = [], 0
    size, place, side = info >> 32, (info & 0xFFFFFFFF) >> 2, info & 3
    same, step = np.arange(len(cell)), 0
    while len(same):
        step += 1  # partners `step` rows on, as long as any cell is that long
        same = same[: np.searchsorted(same, len(cell) - step)]
        same = same[cell[same + step] == cell[same]]
        for part in np.array_split(same, max(1, len(same) // 500_000)):
            other = part + step
            least = np.ceil(THRESHOLD / (1 + THRESHOLD) * (size[part] + size[other]) - 1e-6)  # what partners share
            left = np.minimum(size[part] - place[part], size[other] - place[other])  # what is still to come
            take = (left >= least - (SHARED - 1)) & ((side[part] != side[other]) | (side[part] == 2))
            # partners that must share fewer than SHARED meet once at least, and that is enough
            found.append((ids[part[take]], ids[other[take]], np.where(least[take] < SHARED, SHARED, 1)))
            rows += len(found[-1][0])
            if rows > 1_000_000:
                yield _batch(found)
                found, rows = [], 0
    if rows:
        yield _batch(found)


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return pa.RecordBatch.from_pydict({"a": pa.array(a[new]), "b": pa.array(b[new]), "n": pa.array(np.add.reduceat(n[order], new), pa.int64())})


def _marks(found: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over the hashed ids of all candidates, for leaving other texts out before a shuffle."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate([_mark(batch[c].to_numpy(zero_copy_only=False), bits) for c in "ab"]))
            part, first = np.unique(at // (8 * WIDTH), return_index=True)
            rows = [x.tobytes() for x in np.split((at % (8 * WIDTH)).astype(np.uint32), first[1:])]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "data": pa.array(rows, pa.binary())})

    def add(own: np.ndarray, data: bytes) -> None:
        at = np.frombuffer(data, np.uint32)
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def run_parts(batches):  # empty parts too
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"part": batch["id"].cast(pa.int32()), "data": pa.array([b""] * batch.num_rows, pa.binary())})

    every = found.sparkSession.range(max(1, (1 << bits) // (8 * WIDTH)), numPartitions=1).mapInArrow(run_parts, "part int, data binary")
    parts = _gather(found.mapInArrow(run, "part int, data binary").unionByName(every), add, np.uint8, lambda x: x)
    return np.frombuffer(b"".join(parts), np.uint8)


def _mark(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(ids.view(np.uint64) * _K1) & np.uint64((1 << bits) - 1)).astype(np.int64)


def class_pairs(tables: dict[str, DataFrame]) -> DataFrame:
    """(a, b): every two classes of one source whose similarity reaches the threshold, each once, a < b."""
    prints = {src: stash(_prints(texts)) for src, texts in tables.items()}  # every text is read into words once
    instances = {src: (p.agg(F.sum(F.octet_length("sh"))).first()[0] or 0) // 4 for src, p in prints.items()}
    spark = next(iter(prints.values())).sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((1 - THRESHOLD) * sum(instances.values())) // CELLS)
    rows, every = None, None
    for src, own in prints.items():
        sketch = _sketch(own, instances[src])
        shared = spark.sparkContext.broadcast(sketch)
        parts = [_cell_rows(own, src, shared, False, tasks)]
        if (sketch > BLOCK).any():  # else no cell has so many texts
            parts.append(_packed(_in_blocks(stash(_cell_rows(own, src, shared, True))), tasks))
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
        every = own if every is None else every.unionByName(own)
    # ids of a cell come in ascending order, so a < b
    met = rows.repartition(tasks, "task").mapInArrow(_meet, "a long, b long, n long")
    found = stash(met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED).select("a", "b"))
    needed = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
    bits = _log2(16 * found.count(), MARKS)
    marks = spark.sparkContext.broadcast(_marks(found, bits))

    def marked(batch: pa.RecordBatch) -> dict:
        batch = _once(batch)
        at = _mark(batch["id"].to_numpy(zero_copy_only=False), bits)
        take = pa.array(np.flatnonzero(marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1))
        return {"id": batch["id"].take(take), "sh": batch["sh"].take(take)}

    # one set per class; copies collapse before the join
    sets = by_batch(every, marked, "id long, sh binary").groupBy("id").agg(F.first("sh").alias("sh")).join(needed, "id", "left_semi")
    pairs = found.join(sets.withColumnsRenamed({"id": "a", "sh": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "sh": "sb"}), "b")

    def verify(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist()):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            keep.append(counts_bound(p, q) and jaccard(p, q) >= THRESHOLD - 1e-12)
        take = pa.array(np.flatnonzero(keep))
        return {"a": batch["a"].take(take), "b": batch["b"].take(take)}

    return by_batch(pairs.select("a", "b", "sa", "sb"), verify, "a long, b long")


def _tables(drafts: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    return {"drafts": _texts(drafts, "drafts", "draft_id", "quote"), "entries": _texts(entries, "entries", "id", "body")}


def _members(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, src, key) of every text of three words or more, each key once."""
    three = r"^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){2}[\p{L}\p{N}]"  # anchored and possessive: linear
    parts = [t.where(F.col("text").rlike(three)).select("id", "src", "key") for t in tables.values()]
    return parts[0].unionByName(parts[1]).distinct()


def similar_pairs(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, key_a, key_b): the class pairs and the classes themselves, expanded to all their members."""
    tables = _tables(drafts, entries)
    members = _members(tables)
    left, right = (members.withColumnsRenamed({"id": x, "key": f"k{x}"}) for x in "ab")
    across = class_pairs(tables).join(left, "a").join(right.drop("src"), "b")
    inside = left.join(right.withColumnRenamed("b", "a").drop("src"), "a").where("ka < kb")
    both = across.select("src", "ka", "kb").unionByName(inside.select("src", "ka", "kb"))
    return both.where("ka <> kb").select("src", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def groups(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per text: (src, key, class_id: the least key of its class, copies in the class, links to other classes)."""
    tables = _tables(drafts, entries)
    pairs = class_pairs(tables)
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    members = _members(tables)
    classes = members.groupBy("id").agg(F.count("*").alias("copies"), F.min("key").alias("class_id"))
    return members.join(classes, "id").join(links, "id", "left").select("src", "key", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
