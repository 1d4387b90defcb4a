"""Strict reading of one JSON value, safe on any depth and any number length."""

from __future__ import annotations

import json
import re
from typing import Any


def _no_constant(name: str) -> Any:
    raise ValueError(f"not JSON: {name}")


_FAST = json.JSONDecoder(parse_constant=_no_constant)
_BIG = json.JSONDecoder(parse_constant=_no_constant, parse_int=float)
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str) -> Any:
    """Parse with an explicit stack: for nesting beyond what the recursive parser takes."""
    at, n = _BLANK.match(text).end(), len(text)
    root: list[Any] = []
    stack: list[tuple[Any, str | None]] = [(root, None)]

    def fail() -> None:
        raise ValueError("not one JSON value")

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    want_value = True
    while True:
        box, key = stack[-1]
        if want_value:
            if at >= n:
                fail()
            ch = text[at]
            if ch in "[{":
                value: Any = [] if ch == "[" else {}
                at = skip(at + 1)
            elif ch == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                value, at = float(m[0]), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    fail()
                value, at = _WORDS[word], at + len(word)
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            if isinstance(value, list | dict):
                close = "]" if isinstance(value, list) else "}"
                if at < n and text[at] == close:
                    at = skip(at + 1)
                    want_value = False
                    continue
                stack.append((value, None))
                if isinstance(value, dict):
                    at = _key(text, at, stack, fail, skip)
                continue
            at = skip(at)
            want_value = False
            continue
        box, _ = stack[-1]
        if box is root:
            if at != n:
                fail()
            return root[0]
        if at >= n:
            fail()
        ch = text[at]
        at = skip(at + 1)
        if ch == ",":
            if isinstance(box, dict):
                at = _key(text, at, stack, fail, skip)
            want_value = True
        elif ch == ("]" if isinstance(box, list) else "}"):
            stack.pop()
        else:
            fail()


def _key(text: str, at: int, stack: list, fail, skip) -> int:
    if at >= len(text) or text[at] != '"':
        fail()
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = skip(at)
    if at >= len(text) or text[at] != ":":
        fail()
    stack[-1] = (stack[-1][0], key)
    return skip(at + 1)


def read_one(text: str | None) -> tuple[bool, Any]:
    """(True, value) if text is exactly one complete JSON value (blanks around it allowed), else (False, None).

    null and empty texts are unreadable. NaN and Infinity are no JSON. Any depth and any number length is read.
    """
    if not text:
        return False, None
    try:
        at = _BLANK.match(text).end()
        value, end = _FAST.raw_decode(text, at)
    except json.JSONDecodeError:
        return False, None
    except ValueError as why:
        if "not JSON" in str(why):
            return False, None
        try:
            value, end = _BIG.raw_decode(text, at)
        except (ValueError, RecursionError):
            return False, None
    except RecursionError:
        try:
            return True, _deep(text)
        except ValueError:
            return False, None
    return (True, value) if _BLANK.match(text, end).end() == len(text) else (False, None)


def utf8(text: str) -> str:
    """A text that UTF-8 can carry: a lone surrogate becomes the replacement character."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text
