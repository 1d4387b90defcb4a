"""Credentials in code, configuration and notes: automata over overlapping chunks, spliced placeholders.

Token formats, key armour and connection strings are grammars of one deterministic automaton (automaton.py). What a match
can begin with, and the names and phrases that introduce a value, are anchors of an Aho-Corasick automaton, which reads a
text once in overlapping chunks; at each anchor the grammars run in place on the whole text, so a secret that crosses a
chunk's edge is found whole. Spans are absolute and deduplicated. A value must then look like a live secret: references
(variables, calls, vault paths), masks, placeholders, plain words and numbers, checksums and public certificates are none.

Results on odd input: null and empty texts give no rows and stay as they are; repeated rows of a draft_id count once.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread
from sessionloom.llm.automaton import Automaton

CHUNK, OVERLAP = 65_536, 256

# --- token formats, key armour and connection strings: one automaton (fixed values of the public formats) ---------------
GRAMMARS = {
    "aws": r"A[KS]IA[A-Z0-9]{12,}",
    "github": r"(gh[pousr]_\w{16,}|github_pat_\w{20,})",
    "gitlab": r"glpat-[\w-]{16,}",
    "slack": r"xox[abprs]-[\w-]{12,}",
    "stripe": r"[sr]k_(live|test)_\w{12,}",
    "model": r"sk-[\w-]{20,}",
    "npm": r"npm_\w{20,}",
    "hub": r"hf_\w{20,}",
    "google": r"AIza[\w-]{20,}",
    "jwt": r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "armour": r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----(-?-?-?-?[^-])*(-----END ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----)?",
    "connection": r"://[^\s:/@'\"]*:[^\s/'\"]+@",
}
#: What a match can begin with.
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "sk-", "npm_", "hf_", "AIza", "eyJ", "-----BEGIN ", "://")
_HOST = re.compile(r"[\w\[]")

# --- names and phrases that introduce a value --------------------------------------------------------------------------
_NAMED = ("password", "passwd", "passphrase", "pwd", "_pw", "_pass", "secret", "token", "apikey", "_key", "-key", "accesskey", "credential", "credentials", "privatekey", "secretkey", "signingkey", "passcode")
_VALUE = r"[^\s\"'`<>;,&()\[\]{}]"
_ASSIGN = re.compile(
    r"(?P<k>[\"']?)\]?(?:\s*(?:=>|:=|=|:)\s*|\s+value\s*=\s*|\s*\{\s*default\s*=\s*)(?:(?P<q>[\"'`]{1,3})(?P<v>[^\"'`\n]+)|(?P<w>" + _VALUE + r"+))",
)
#: An anchor, the grammar that must hold at its start, and how the value is checked: any live value (1, 2), no plain word (3),
#: decodes from base64 (4), a manifest's data (5), random characters (6).
_PHRASES = (
    ("password", r"password (?:is |was )?[\"']?(?P<v>" + _VALUE + r"{6,})", 3),
    ("passphrase", r"passphrase (?:is |was )?[\"']?(?P<v>" + _VALUE + r"{6,})", 3),
    ("secret", r"secret (?:is |was )[\"']?(?P<v>" + _VALUE + r"{6,})", 3),
    *((w, w + r" [\"']?(?P<v>[\w+/=-]{20,})(?![\w+/=-])", 6) for w in ("credential", "token", "key", "secret", "value", "about")),
    ("bearer ", r"bearer (?P<v>[\w.~+/=-]{8,})", 1),
    ("basic ", r"basic (?P<v>[A-Za-z0-9+/_-]{8,}={0,2})", 4),
    ("-u", r"(?<![\w-])-u ?[\"']?[\w.-]+:(?P<v>[^\s\"']{6,})", 2),
    ("--user", r"--user[= ][\"']?[\w.-]+:(?P<v>[^\s\"']{6,})", 2),
    (" -p", r" -p ?[\"']?(?P<v>[^\s\"'-][^\s\"']{5,})", 2),
    ("cookie:", r"cookie:[^\n]*?\b(?:session|sessionid|sid|auth|token|jwt)=(?P<v>[^\s;\"']{12,})", 1),
    ("kind: secret", r"kind: secret\b(?:\n(?!---)[^\n]*)*?\n(?:data|stringdata):(?:\n[ \t]+[\w.-]+: *[^\n]*)*", 5),
    ("\n  ", r"\n {2,}[\w.-]+: *[\"']?(?P<v>[A-Za-z0-9+/]{12,}={0,2})[\"']?(?=\s|$)", 4),
)
_DATA_LINE = re.compile(r"\n[ \t]+[\w.-]+: *[\"']?(?P<v>[A-Za-z0-9+/_-]{6,}={0,2})[\"']?(?=\n|$)")
_PIECE = re.compile(r"[\"']\s*(?:\+|\.|\\\n|&)\s*\n?\s*[\"'](?P<v>[^\"'\n]+)")

# --- what is no live value ----------------------------------------------------------------------------------------------
_REFERENCE = re.compile(
    r"\$\{?[A-Za-z_]|\$\(|%[A-Z_]+%|\{\{|<|\[?redacted|\[[A-Z_]+\]|#[A-Z][A-Z0-9_]*_\d+#|[*xX.•]{4,}|\*{2,}|os\.|process\.|env[.\[(]|getenv|vault:|ssm:|arn:|sops:|file:|https?://|[A-Za-z_][\w.]*\(|your[-_ ]|example\b|changeme|placeholder|dummy|sha(?:1|256|384|512)[:-]|md5[:-]|-----",
    re.IGNORECASE,
)
_WORD = re.compile(r"[a-z]+(?:[-_.][a-z]+)*\.?|[A-Z][a-z]+\.?|[A-Z_]+|\d[\d.,:_-]*", re.ASCII)
_IDENTIFIER = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")


def _live(value: str, strict: int) -> bool:
    """Whether a value looks like a secret and not like a reference, a mask, a word or a number."""
    if len(value) < 6 or _REFERENCE.match(value) or _WORD.fullmatch(value) or _IDENTIFIER.fullmatch(value):
        return False
    if strict == 3:
        return any(c.isdigit() for c in value) or sum(not c.isalnum() and c not in ".:-'" for c in value) > 0 or value.lower() != value and value[1:].lower() != value[1:]
    return True


def _random(value: str) -> bool:
    """Whether a long value is random characters: digits, small and capital letters that change places often."""
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in value if c.isalnum()]
    return kinds.count(0) >= 2 and len(kinds) - kinds.count(0) >= 3 and sum(a != b for a, b in zip(kinds, kinds[1:])) * 5 >= len(kinds)


def _decodes(value: str) -> bool:
    """Base64 that decodes to printable text (as of Basic headers and secret manifests)."""
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").isprintable()
    except ValueError:
        return False


@cache
def _automaton():
    """All anchors in one automaton; the payload lists (anchor length, kind, grammar, strictness)."""
    anchors: dict[str, list] = {}
    for prefix in STARTS:
        anchors.setdefault(prefix.lower(), []).append(("grammar", None, 0))
    for name in _NAMED:
        anchors.setdefault(name, []).append(("name", None, 2))
    for anchor, grammar, strict in _PHRASES:
        anchors.setdefault(anchor, []).append(("phrase", re.compile(grammar, re.IGNORECASE), strict))
    out = ahocorasick.Automaton()
    for anchor, rules in anchors.items():
        out.add_word(anchor, (len(anchor), tuple(rules)))
    out.make_automaton()
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def _hits(text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """(start, end, rules) of every anchor; chunks overlap, so some come twice."""
    machine = _automaton()
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    for base in range(0, max(1, len(low)), chunk):
        for end, (size, rules) in machine.iter(low[base : base + chunk + overlap]):
            yield base + end + 1 - size, base + end + 1, rules


def _edge(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_-")


@cache
def _grammars() -> Automaton:
    return Automaton(GRAMMARS)


#: Lines of a key block: base64 in full or closing lines, with the quotes, escapes and marks of the code around it; headers; blanks.
_LINE_END = r"(?:[\s\"'`,;+>#*|&]|\\[nr])*"
_BODY = re.compile(rf"{_LINE_END}(?:(?:[A-Za-z0-9+/]{{16,}}={{0,2}}|[A-Za-z0-9+/]{{2,}}={{1,2}}|[A-Z][A-Za-z]+-[A-Za-z]+: [^\n\\]*)(?=[\s\"'`,;+\\]|-----|$){_LINE_END})*")
_TAIL = re.compile(r"[A-Za-z0-9+/]*=*(?:[\s\"'`,;+>#*|&]|\\[nr])*(-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?")


def _block(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A key block: to its END line, or without one to the last line of base64; other text stays out. A header alone is none."""
    head = text.index("-----", start + 10) + 5
    body = _BODY.match(text, head, end)
    if not re.search(r"[A-Za-z0-9+/]{16}", body[0]):
        return None
    tail = _TAIL.match(text, body.end(), end)  # a short last line counts only before END
    if tail[1]:
        return start, tail.end(1)
    return start, body.end() - (len(body[0]) - len(re.sub(rf"{_LINE_END}\Z", "", body[0])))


def _formatted(text: str, start: int) -> tuple[int, int] | None:
    """The span of a token, a key block or a connection string's password that starts at an anchor."""
    m = _grammars().match(text, start)
    if not m:
        return None
    end, name = m
    if name == "armour":
        return _block(text, start, end)
    if name == "connection":
        a, b = text.index(":", start + 3) + 1, end - 1
        return (a, b) if _HOST.match(text, end) and _live(text[a:b], 2) else None
    return (start, end) if _edge(text, start) and (name != "model" or any(c.isdigit() for c in text[start:end])) else None


def _named(text: str, start: int, end: int) -> tuple[int, int] | None:
    m = _ASSIGN.match(text, end)
    if not m or start >= 7 and text[max(0, start - 8) : start].lower().endswith(("public_", "public-", "public")):
        return None
    a, b = m.span("v" if m["q"] else "w")
    value = text[a:b]
    if not m["q"]:
        while b > a and text[b - 1] in ".,:;":
            b -= 1
        value = text[a:b]
    elif " " in value.strip():
        return None
    pieces = bool(m["q"]) and _PIECE.match(text, b) is not None and not _REFERENCE.match(value)
    return (a, b) if _live(value, 2) or pieces and len(value) >= 6 else None


def spans(text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of every secret value, in order, without overlaps."""
    if not text:
        return []
    found: set[tuple[int, int]] = set()
    for start, end, rules in _hits(text, chunk, overlap):
        for kind, grammar, strict in rules:
            if kind == "grammar":
                if span := _formatted(text, start):
                    found.add(span)
            elif kind == "name":
                if span := _named(text, start, end):
                    found.add(span)
            elif m := grammar.match(text, start):
                if strict == 5:
                    data = text.find("data:", *m.span())
                    found.update(x.span("v") for x in _DATA_LINE.finditer(text, data, m.end()) if _decodes(x["v"]))
                elif strict == 4:
                    if _decodes(m["v"]):
                        found.add(m.span("v"))
                else:
                    a, b = m.span("v")
                    while b > a and text[b - 1] in ".,:;":
                        b -= 1
                    if _live(text[a:b], strict) and (strict != 6 or _random(text[a:b])):
                        found.add((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


_MASK = re.compile(r"#CRED_(\d+)#")


def redact(text: str | None) -> str | None:
    """The text with #CRED_NNN# for each distinct secret; later pieces of a secret become empty strings."""
    if not text:
        return text
    number = max((int(n) for n in _MASK.findall(text)), default=0)
    names: dict[str, str] = {}
    out, at = [], 0
    for a, b in spans(text):
        if a < at:
            continue
        value = text[a:b]
        if value not in names:
            number += 1
            names[value] = f"#CRED_{number:03d}#"
        out += [text[at:a], names[value]]
        at = b
        while text[at : at + 1] in ("'", '"') and (m := _PIECE.match(text, at)):
            out.append(text[at : m.start("v")])
            at = m.end("v")
    return "".join([*out, text[at:]])


def _texts(drafts: DataFrame, tokenised: DataFrame) -> list[tuple[DataFrame, str, str]]:
    return [(drafts, "drafts", "quote"), (tokenised, "tokenised_entries", "review_reason")]


def found(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(src, draft_id, start_pos) of every secret."""
    out = None
    for df, src, field in _texts(drafts, tokenised):

        def run(batch: pa.RecordBatch, src=src, field=field) -> dict | None:
            rows = [(src, d, a) for d, t in zip(batch["draft_id"].to_pylist(), batch[field].to_pylist()) for a, _ in spans(t)]
            return dict(zip(("src", "draft_id", "start_pos"), map(pa.array, zip(*rows), (pa.string(), pa.string(), pa.int32())))) if rows else None

        part = by_batch(spread(df.select("draft_id", field).where(F.col(field).isNotNull())), run, "src string, draft_id string, start_pos int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def redacted(drafts: DataFrame, tokenised: DataFrame) -> DataFrame:
    """(src, draft_id, text) with the secrets masked; one row per distinct text of a draft."""
    out = None
    for df, src, field in _texts(drafts, tokenised):

        def run(batch: pa.RecordBatch, src=src, field=field) -> dict:
            return {"src": pa.array([src] * batch.num_rows), "draft_id": batch["draft_id"], "text": pa.array([redact(t) for t in batch[field].to_pylist()], pa.string())}

        part = by_batch(spread(df.select("draft_id", field)), run, "src string, draft_id string, text string")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
