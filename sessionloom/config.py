"""Configuration: stages, signatures, data folders."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

#: Providers by accepted name, those with an effort level, and effort levels by accepted name (fixed values).
PROVIDERS = {"claude": "claude-code", "claude-code": "claude-code", "codex": "codex", "gemini": "gemini", "opencode": "opencode", "pi": "pi"}
PROGRAMS = {"claude-code": "claude"}
WITH_EFFORT = ("claude-code", "codex", "opencode")
EFFORTS = {"min": "min", "minimal": "min", "low": "min", "medium": "medium", "med": "medium", "high": "high"}


@dataclass(frozen=True)
class Stage:
    """One model stage: who answers, with which model, how hard."""

    provider: str
    model: str
    effort: str | None = None

    @staticmethod
    def parse(model: str, effort: str | None = None) -> Stage:
        name = model.strip()
        if not name:
            raise ValueError("the model is empty")
        head, slash, rest = name.partition("/")
        provider = PROVIDERS.get(head.strip().lower()) if slash else "claude-code"
        if provider is None:
            raise ValueError(f"unknown provider; known: {', '.join(sorted(set(PROVIDERS.values())))}")
        chosen = rest.strip() if slash else name
        if not chosen:
            raise ValueError("no model after the provider")
        level = None
        if effort is not None:
            level = EFFORTS.get(effort.strip().lower())
            if level is None:
                raise ValueError("effort is min, medium or high")
            if provider not in WITH_EFFORT:
                raise ValueError(f"{provider} takes no effort")
        if provider == "pi" and "/" not in chosen:
            raise ValueError("pi models keep their upstream path")
        return Stage(provider, chosen, level)

    @property
    def signature(self) -> str:
        return f"{self.provider}/{self.model}" + (f"#{self.effort}" if self.effort else "")

    def check(self) -> None:
        """Fail early if the provider's program is missing."""
        if not shutil.which(PROGRAMS.get(self.provider, self.provider)):
            raise FileNotFoundError(f"no program for {self.provider}")


def data_root(system: str, home: str, xdg: str | None, app: str = "sessionloom") -> str:
    """The folder of state and entries: XDG only on Linux and only if it is an absolute path."""
    base = xdg if system == "Linux" and xdg and os.path.isabs(xdg) else os.path.join(home, ".local/share")
    return os.path.join(base, app)


@dataclass
class EngineConfig:
    """Everything a run depends on; the prompts' hashes and signatures are part of a session's freshness."""

    root: str
    extractor: object = None
    tokeniser: object = None
    version: str = "0.1.0"
    udf_partitions: int = 2
    sequential: bool = True  # a literal counts from the draft on that taught it, in the order of publishing; else at once
    output: str | None = None

    @property
    def entries(self) -> str:
        return self.output or os.path.join(self.root, "entries")

    @property
    def state(self) -> str:
        """A table (operators/tables.py), as is the registry."""
        return os.path.join(self.root, "state")

    @property
    def registry(self) -> str:
        return os.path.join(self.root, "registry")
