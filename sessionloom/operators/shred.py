"""Columnar shredding of nested JSON with repetition and definition levels, and its inverse.

A record is cut into one column per leaf path. Each column is a sequence of (repetition, definition, value): the
repetition level says at which array the value repeats, the definition level how many optional or repeated steps of
the path are present. Every array element that is an object owns a presence column (its path followed by ``{}``), so
the rows of one repeated ancestor come back from that column's level sequence alone.

Path steps: ``.key`` enters an object's field, ``[]`` an array's elements; each is one definition level, ``[]`` also
one repetition level. A field or element may hold an object, an array or a scalar; each kind has its own leaves.

Results on odd input: null, empty and unreadable payloads give no rows; empty arrays and nulls in arrays give no
objects; repeated rows of one (session_id, line_no) count once; records of any depth are read.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread
from sessionloom.functions.jsonx import read_one, utf8

Step = str | None  # None: into an array's elements
Levels = list[tuple[int, int, Any]]


class Node:
    """One step of the schema of a record; children by key, None for array elements."""

    __slots__ = ("children", "definition", "leaf", "presence", "repetition", "step", "up")

    def __init__(self, up: Node | None, step: Step):
        self.up, self.step, self.children = up, step, {}
        self.repetition = (up.repetition if up else 0) + (up is not None and step is None)
        self.definition = up.definition + 1 if up else 0
        self.leaf: Levels | None = None
        self.presence: Levels | None = None

    def child(self, step: Step) -> Node:
        found = self.children.get(step)
        if found is None:
            found = self.children[step] = Node(self, step)
        return found

    def path(self) -> tuple[Step, ...]:
        steps = []
        node = self
        while node.up is not None:
            steps.append(node.step)
            node = node.up
        return tuple(reversed(steps))


def _schema(value: Any) -> Node:
    """The schema of one record: the union of the paths of all its elements."""
    root = Node(None, "")
    todo = [(root, value)]
    while todo:
        node, v = todo.pop()
        if isinstance(v, dict):
            if node.step is None and node.up is not None:
                node.presence = []
            elif not v:
                node.leaf = []
            todo.extend((node.child(k), x) for k, x in v.items())
        elif isinstance(v, list) and v:
            inner = node.child(None)
            todo.extend((inner, x) for x in v)
        else:
            node.leaf = []
    return root


def _absent(node: Node, repetition: int, definition: int) -> None:
    """A missing subtree gives one empty entry in each of its columns."""
    todo = [node]
    while todo:
        at = todo.pop()
        for column in (at.leaf, at.presence):
            if column is not None:
                column.append((repetition, definition, None))
        todo.extend(at.children.values())


def shred(value: Any) -> list[tuple[tuple[Step, ...], bool, Levels]]:
    """The columns of one record: (path, whether it is a presence column, level sequence)."""
    root = _schema(value)
    todo: list[tuple[Node, Any, int]] = [(root, value, 0)]
    while todo:
        node, v, repetition = todo.pop()
        is_object, is_array = isinstance(v, dict), isinstance(v, list)
        if node.presence is not None:
            node.presence.append((repetition, node.definition + is_object, None))
        if node.leaf is not None:
            plain = not is_object and not (is_array and v)
            empty = is_object and not v and node.presence is None
            node.leaf.append((repetition, node.definition + (plain or empty), v if plain and not is_array else None))
        later = []
        for step, inner in node.children.items():
            if step is None:
                if is_array and v:
                    later.append((inner, v[0], repetition))
                    later.extend((inner, x, inner.repetition) for x in v[1:])
                else:
                    _absent(inner, repetition, node.definition)
            elif is_object and step in v:
                later.append((inner, v[step], repetition))
            else:
                _absent(inner, repetition, node.definition)
        todo.extend(reversed(later))
    out = []
    nodes = [root]
    while nodes:
        node = nodes.pop()
        out += [(node.path(), flag, column) for flag, column in ((False, node.leaf), (True, node.presence)) if column is not None]
        nodes.extend(reversed(node.children.values()))
    return out


def name(path: tuple[Step, ...], index: list[int] | None = None) -> str:
    """Keys joined by dots with [i] for each array step ([] without indexes)."""
    parts, k = [], 0
    for step in path:
        if step is None:
            parts.append("[]" if index is None else f"[{index[k]}]")
            k += 1
        else:
            parts.append(f".{step}" if parts else step)
    return "".join(parts)


def positions(path: tuple[Step, ...], levels: Levels):
    """Run a column's level sequence: (index of each array step, definition level, value) of every entry."""
    depth = sum(step is None for step in path)
    index = [-1] * depth
    for repetition, definition, value in levels:
        if repetition == 0:
            index = [0] * depth
        else:
            index[repetition - 1] += 1
            index[repetition:] = [0] * (depth - repetition)
        yield index, definition, value


def elements(columns: list[tuple[tuple[Step, ...], bool, Levels]]) -> list[str]:
    """The paths of all array elements that are objects, out of the presence columns."""
    return [name(path, index) for path, flag, levels in columns if flag for index, definition, _ in positions(path, levels) if definition > len(path)]


def _owner(path: tuple[Step, ...], index: list[int], rows: dict) -> int:
    """How many steps of the path lead to the nearest array element above it that is an object; 0: the record."""
    return next((k for k in range(len(path) - 1, 0, -1) if path[k - 1] is None and name(path[:k], index) in rows), 0)


def tables(columns: list[tuple[tuple[Step, ...], bool, Levels]]) -> list[tuple[str, str, str | None, str]]:
    """Flat rows (table, node, parent node, JSON of the scalar fields) of one record; the root's node is ''."""
    rows: dict[str, list] = {"": ["", None, {}]}
    found = [(path, list(index), flag, value) for path, flag, levels in columns for index, definition, value in positions(path, levels) if definition > len(path)]
    for path, index, flag, _ in found:
        if flag:
            rows[name(path, index)] = [name(path), None, {}]
    for path, index, flag, value in found:
        cut = _owner(path, index, rows)
        owner = name(path[:cut], index)
        if flag:
            rows[name(path, index)][1] = owner
        else:
            rest = index[sum(step is None for step in path[:cut]) :]
            rows[owner][2][name(path[cut:], rest)] = value
    return [(kind, node, up, json.dumps(fields, ensure_ascii=False)) for node, (kind, up, fields) in rows.items()]


def _per_line(lines: DataFrame, fn, columns: str, once: bool = False) -> DataFrame:
    """Run fn over each readable payload; the columns of each result row. With `once`, repeated lines count once before they
    are read: a payload is smaller than all that comes out of it."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batch: pa.RecordBatch) -> dict | None:
        take: list[int] = []
        out: list[list] = [[] for _ in names]
        for i, text in enumerate(batch["payload"].to_pylist()):
            ok, value = read_one(text)
            if ok and isinstance(value, dict | list):
                rows = fn(value)
                take.extend([i] * len(rows))
                for row in rows:
                    for column, x in zip(out, row):
                        column.append(utf8(x) if isinstance(x, str) else x)
        if not take:
            return None
        at = pa.array(take, pa.int64())
        return {"session_id": batch["session_id"].take(at), "line_no": batch["line_no"].take(at)} | {c: pa.array(v, pa.int32() if c.endswith("_level") else pa.string()) for c, v in zip(names, out)}

    source = lines.select("session_id", F.col("line_no").cast("int").alias("line_no"), "payload").where(F.col("session_id").isNotNull() & F.col("line_no").isNotNull())
    return by_batch(source.distinct() if once else spread(source), run, "session_id string, line_no int, " + columns)


def object_elements(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, node_path) of every JSON object that is an element of an array."""
    arrays = lines.where(F.contains("payload", F.lit("[")))  # a payload without a bracket holds no array
    return _per_line(arrays, lambda v: [(x,) for x in elements(shred(v))], "node_path string").distinct()


def level_columns(lines: DataFrame) -> DataFrame:
    """The shredded form itself: one row per entry of each leaf column, in order (entry_level is its place)."""

    def fn(value: Any) -> list[tuple]:
        return [(name(path) + ("{}" if flag else ""), k, r, d, None if v is None else json.dumps(v)) for path, flag, levels in shred(value) for k, (r, d, v) in enumerate(levels)]

    return _per_line(lines, fn, "leaf_path string, entry_level int, repetition_level int, definition_level int, value string", once=True)


def flat_tables(lines: DataFrame) -> DataFrame:
    """Related flat rows: table_path, node_path, parent_path (null for the record) and the scalar fields as JSON."""
    return _per_line(lines, lambda v: tables(shred(v)), "table_path string, node_path string, parent_path string, fields string", once=True)
