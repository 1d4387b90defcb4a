"""Reading JSON out of noisy model output: balanced candidates, first one that parses wins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.frames import by_batch

DRAFT_FIELDS = ("title", "category", "tags", "quote", "why")
TOKENISED_FIELDS = ("title", "category", "tags", "body")


def candidates(text: str, opening: str, closing: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each balanced stretch from every opening bracket; brackets inside strings do not count.

    One backward-looking pass would miss overlapping starts, so ends are matched with a stack in a single pass and
    starts are given in order.
    """
    ends: dict[int, int] = {}
    starts = [i for i, c in enumerate(text) if c == opening]
    done: set[int] = set()
    for start in starts:
        if start in done:
            continue
        stack: list[int] = []
        quoted = escaped = False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == opening:
                stack.append(i)
                done.add(i)
            elif c == closing and stack:
                ends[stack.pop()] = i + 1
                if not stack:
                    break
    yield from sorted(ends.items())


def _strings(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def is_draft(value: Any) -> bool:
    """All five fields, of their types; others may be there."""
    return isinstance(value, dict) and all(k in value for k in DRAFT_FIELDS) and _strings(value["tags"]) and all(isinstance(value[k], str) for k in ("title", "category", "quote", "why"))


def is_tokenised(value: Any) -> bool:
    if not (isinstance(value, dict) and all(k in value for k in TOKENISED_FIELDS) and _strings(value["tags"])):
        return False
    reason = value.get("review_reason")
    return all(isinstance(value[k], str) for k in ("title", "category", "body")) and isinstance(value.get("needs_review", False), bool) and (reason is None or isinstance(reason, str))


def _first(text: str, opening: str, closing: str, good: Callable[[Any], bool]) -> tuple[Any, str | None]:
    """(value, None), or (None, an error that shows positions only)."""
    tried = 0
    for start, end in candidates(text, opening, closing):
        tried += 1
        try:
            value = json.loads(text[start:end])
        except (ValueError, RecursionError):
            continue
        if good(value):
            return value, None
    return None, f"no candidate of {tried} parsed in {len(text.encode('utf-8', 'replace'))} bytes"


def drafts(text: str | None) -> tuple[list[dict] | None, str | None]:
    """The drafts of an extractor's output; blank output is no draft."""
    if not text or not text.strip():
        return [], None
    return _first(text, "[", "]", lambda v: isinstance(v, list) and all(map(is_draft, v)))


def tokenised(text: str | None) -> tuple[dict | None, str | None]:
    """The entry of a tokeniser's output; blank output is an error."""
    if not text or not text.strip():
        return None, "blank output"
    value, error = _first(text, "{", "}", is_tokenised)
    return value and {"entities": None, "needs_review": False, "review_reason": None} | value, error


def event_text(text: str) -> tuple[str | None, str | None]:
    """The text of an event stream: its text events joined by line breaks, or the raw stream if it has none."""
    parts = []
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            event = json.loads(line)
        except ValueError:
            return None, f"line {number} is no JSON"
        if isinstance(event, dict) and event.get("type") == "text":
            body = event.get("part", event)
            found = body.get("text") if isinstance(body, dict) else None
            if isinstance(found, str):
                parts.append(found)
    return ("\n".join(parts) if parts else text), None


def parse_drafts(outputs: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per output: kept columns, ok, error (positions only), and the drafts as an array of structs."""
    names = list(DRAFT_FIELDS)
    kinds = dict(outputs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [drafts(t) for t in batch[column].to_pylist()]
        kind = pa.list_(pa.struct([(k, pa.list_(pa.string()) if k == "tags" else pa.string()) for k in names]))
        values = [None if v is None else [{k: d[k] for k in names} for d in v] for v, _ in rows]
        return {k: batch[k] for k in keep} | {"ok": pa.array([e is None for _, e in rows]), "error": pa.array([e for _, e in rows], pa.string()), "drafts": pa.array(values, kind)}

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", ok boolean, error string, drafts array<struct<title:string,category:string,tags:array<string>,quote:string,why:string>>"
    return by_batch(outputs.select(*dict.fromkeys([*keep, column])), run, schema)


def parse_tokenised(outputs: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per output: kept columns, ok, error, and the fields of the entry."""
    kinds = dict(outputs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(error, value or {}) for value, error in map(tokenised, batch[column].to_pylist())]
        take = lambda k, kind=pa.string(): pa.array([v.get(k) for _, v in rows], kind)
        return {k: batch[k] for k in keep} | {"ok": pa.array([e is None for e, _ in rows]), "error": pa.array([e for e, _ in rows], pa.string()), "title": take("title"), "category": take("category"), "tags": take("tags", pa.list_(pa.string())), "body": take("body"), "needs_review": take("needs_review", pa.bool_()), "review_reason": take("review_reason")}

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", ok boolean, error string, title string, category string, tags array<string>, body string, needs_review boolean, review_reason string"
    return by_batch(outputs.select(*dict.fromkeys([*keep, column])), run, schema)


def event_texts(outputs: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per event stream: kept columns, ok, error, text."""
    kinds = dict(outputs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [event_text(t or "") for t in batch[column].to_pylist()]
        return {k: batch[k] for k in keep} | {"ok": pa.array([e is None for _, e in rows]), "error": pa.array([e for _, e in rows], pa.string()), "text": pa.array([t for t, _ in rows], pa.string())}

    return by_batch(outputs.select(*dict.fromkeys([*keep, column])), run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", ok boolean, error string, text string")
