"""Model stages as pluggable backends behind Arrow batches; errors carry classes and sizes, never text."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.config import Stage
from sessionloom.frames import by_batch
from sessionloom.functions import parsing
from sessionloom.functions.text import FAILURES


class ModelBackend(Protocol):
    """What a stage needs: answers for a list of prompts, a signature, and an early check."""

    signature: str

    def check(self) -> None: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class Offline:
    """A deterministic backend: a function from prompt to answer; for tests and for runs without a model."""

    def __init__(self, signature: str, answer: Callable[[str], str]):
        self.signature, self.answer = signature, answer

    def check(self) -> None:
        pass

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


@dataclass(frozen=True)
class Call:
    """One call of a model program: its arguments, what it reads on standard input, where it runs, what it prints."""

    argv: list[str]
    stdin: str | None = None
    folder: str | None = None
    events: bool = False  # an event stream instead of plain text


#: Effort levels as each program spells them (fixed values).
EFFORTS = {"claude-code": {"min": "low", "medium": "medium", "high": "high"}, "codex": {"min": "minimal", "medium": "medium", "high": "high"}, "opencode": {"min": "minimal", "medium": "medium", "high": "high"}}


def call(stage: Stage, prompt: str, folder: str | None = None) -> Call:
    """How a stage's program is called; with a folder it may read files there (the extractor's case)."""
    effort = EFFORTS.get(stage.provider, {}).get(stage.effort or "")

    def given(flag: str, value: str | None) -> list[str]:
        return [flag, value] if value else []

    model = ["--model", stage.model]
    match stage.provider:
        case "claude-code":
            return Call(["claude", "-p", *model, *given("--effort", effort), *given("--add-dir", folder), *(["--allowedTools=Read"] if folder else [])], stdin=prompt)
        case "codex":
            return Call(["codex", "exec", "-", *model, "--sandbox", "read-only", "--skip-git-repo-check", *given("-c", effort and f'model_reasoning_effort="{effort}"'), *given("-C", folder)], stdin=prompt)
        case "gemini":
            return Call(["gemini", "-p", prompt, *model, "--sandbox", "-o", "text", *given("--include-directories", folder)])
        case "opencode":
            return Call(["opencode", "run", *model, "--format", "json", *given("--variant", effort), *given("--dir", folder), prompt], events=True)
        case "pi":
            upstream, _, inner = stage.model.partition("/")
            return Call(["pi", "--provider", upstream, "--model", inner, "-p", prompt], folder=folder)
    raise ValueError(f"unknown provider {stage.provider}")


class Program:
    """A command-line model of one of the five providers; a call that hangs is ended after `timeout` seconds."""

    def __init__(self, stage: Stage, timeout: float = 1800.0, folder: str | None = None):
        self.stage, self.timeout, self.folder = stage, timeout, folder
        self.signature = stage.signature

    def check(self) -> None:
        self.stage.check()

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            one = call(self.stage, prompt, self.folder)
            try:
                done = subprocess.run(one.argv, input=one.stdin, cwd=one.folder, capture_output=True, text=True, timeout=self.timeout)
            except subprocess.TimeoutExpired:
                raise RuntimeError(f"{one.argv[0]} gave no answer in {self.timeout:.0f} s") from None
            if done.returncode:
                raise RuntimeError(safe_error(one.argv[0], done.returncode, done.stdout, done.stderr))
            text, error = parsing.event_text(done.stdout) if one.events else (done.stdout, None)
            if error:
                raise RuntimeError(error)
            out.append(text)
        return out


def classify(message: str) -> str | None:
    """As functions.text.failure_class, for one message."""
    low = message.lower()
    return next((name for name, words in FAILURES if any(w in low for w in words)), None)


def safe_error(program: str, code: int, stdout: str, stderr: str) -> str:
    kind = classify(f"{stderr}\n{stdout}")
    return f"{program} exited with {code}: {kind}" if kind else f"{program} exited with {code}; stdout {len(stdout.encode())} bytes, stderr {len(stderr.encode())} bytes"


#: What a second attempt adds to the prompt after an answer that could not be read.
STRICT = "Your last answer could not be read. Answer with the JSON array and nothing else: no words around it, no code fence."


def extract(sessions: DataFrame, backend: ModelBackend, prompt: str) -> DataFrame:
    """session_id, transcript -> session_id, ok, error, drafts. A failing session fails alone.

    An answer that cannot be read is asked for once more, with a strict reminder; a backend's failure is not repeated.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch["transcript"].to_pylist():
            value, error = None, "blank transcript"
            if text and text.strip():
                try:
                    asked = f"{prompt}\n\n{text}"
                    value, error = parsing.drafts(backend.generate([asked])[0])
                    if error is not None:
                        value, error = parsing.drafts(backend.generate([f"{asked}\n\n{STRICT}"])[0])
                except Exception as why:
                    value, error = None, f"{type(why).__name__}: {classify(str(why)) or 'unclassified'}"
            rows.append((error is None, error, None if value is None else [{k: d[k] for k in parsing.DRAFT_FIELDS} for d in value]))
        kind = pa.list_(pa.struct([(k, pa.list_(pa.string()) if k == "tags" else pa.string()) for k in parsing.DRAFT_FIELDS]))
        return {"session_id": batch["session_id"], "ok": pa.array([r[0] for r in rows]), "error": pa.array([r[1] for r in rows], pa.string()), "drafts": pa.array([r[2] for r in rows], kind)}

    return by_batch(sessions.select("session_id", "transcript"), run, "session_id string, ok boolean, error string, drafts array<struct<title:string,category:string,tags:array<string>,quote:string,why:string>>")


def tokenise(drafts: DataFrame, backend: ModelBackend, prompt: str) -> DataFrame:
    """draft_id, title, category, tags, quote (never why) -> the tokenised entry, or ok = false; a bad draft is dropped alone."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for title, category, tags, quote in zip(*(batch[c].to_pylist() for c in ("title", "category", "tags", "quote"))):
            try:
                value, error = parsing.tokenised(backend.generate([prompt + "\n" + json.dumps({"title": title, "category": category, "tags": tags, "quote": quote})])[0])
            except Exception as why:
                value, error = None, f"{type(why).__name__}: {classify(str(why)) or 'unclassified'}"
            value = value or {}
            rows.append((error is None, error, value.get("title"), value.get("category"), value.get("tags"), value.get("body"), json.dumps(value["entities"]) if value.get("entities") is not None else None, value.get("needs_review"), value.get("review_reason")))
        kinds = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.string())
        names = ("ok", "error", "title", "category", "tags", "body", "entities", "needs_review", "review_reason")
        return {"draft_id": batch["draft_id"]} | {n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)}

    return by_batch(drafts.select("draft_id", "title", "category", "tags", "quote"), run, "draft_id string, ok boolean, error string, title string, category string, tags array<string>, body string, entities string, needs_review boolean, review_reason string")
