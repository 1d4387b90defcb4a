"""Column functions over text, paths and JSON; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.frames import utrim

MIN_LITERAL_BYTES = 8
SLUG_BYTES = 60
#: Characters that end a literal, besides Unicode white space (fixed values).
DELIMITERS = "'\"`,;()[]{}"
_SPLIT = r"[\p{IsWhite_Space}'\"`,;()\[\]{}]"
_EDGE = r"[^\p{IsAlphabetic}\p{N}.\-_/@]"


def block(label: Column, text: Column) -> Column:
    """A labelled transcript block: one line, or the label above a text of several lines."""
    body = utrim(text)
    return F.concat(F.lit("["), label, F.when(F.contains(body, F.lit("\n")), F.lit("]:\n")).otherwise(F.lit("]: ")), body)


def repo_name(url: Column) -> Column:
    """The tail of a repository URL without its .git endings; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"([^/:]*)$", 1), r"(\.git)+$", ""), F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def event_project(url: Column, cwd: Column) -> Column:
    """Project of the event dialect: the repository, else the working folder, else unknown."""
    return F.coalesce(repo_name(url), F.nullif(base_name(cwd), F.lit("")), F.lit("unknown"))


def path_project(path: Column) -> Column:
    """Project of the plain dialect: the last two dash-separated parts of the parent folder's name."""
    return F.substring_index(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), "-", -2)


def path_session(path: Column) -> Column:
    """File name without its last extension."""
    name = base_name(path)
    return F.coalesce(F.nullif(F.when(name.rlike(r"^[^.]+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.lit("")), F.lit("unknown"))


def slug(title: Column) -> Column:
    """Lower case, other than letters and digits to single dashes, at most SLUG_BYTES bytes of whole characters."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{IsAlphabetic}\p{N}]+", "-"), r"^-+|-+$", "")
    whole = F.octet_length(dashed) <= SLUG_BYTES
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, c: Column) -> Column:
        full = acc["full"] | (F.octet_length(acc["s"]) + F.octet_length(c) > SLUG_BYTES)
        return F.struct(F.when(full, acc["s"]).otherwise(F.concat(acc["s"], c)).alias("s"), full.alias("full"))

    cut = F.aggregate(F.split(dashed, ""), start, add, lambda acc: acc["s"])
    return F.when(whole, dashed).otherwise(F.regexp_replace(cut, r"-+$", ""))


def file_name(number: Column, title: Column) -> Column:
    return F.concat(F.format_string("%03d", number), F.lit("-"), slug(title), F.lit(".md"))


def strip_ansi(text: Column) -> Column:
    """Without terminal escapes: ESC [ up to a final character of A..z; other escapes lose the ESC alone."""
    return F.regexp_replace(F.regexp_replace(text, "\\x1b\\[[^A-z]*[A-z]", ""), "\\x1b", "")


#: Failure classes in the order they are tried (fixed values: what the message must contain).
FAILURES = (
    ("quota", ("you've hit your limit", "rate limit", "quota")),
    ("auth", ("not authenticated", "please run `claude auth", "claude auth")),
    ("api_key", ("invalid api key", "api key invalid")),
    ("flag", ("unsupported flag", "unknown flag")),
    ("permission", ("permission denied", "permission_error")),
    ("connection", ("econnrefused", "connection refused")),
)


def failure_class(message: Column) -> Column:
    """The first class whose words stand in the message, raw or without escapes; null if none."""
    low = F.lower(F.concat(message, F.lit("\n"), strip_ansi(message)))
    out = F.lit(None).cast("string")
    for name, words in reversed(FAILURES):
        hit = None
        for w in words:
            hit = F.contains(low, F.lit(w)) if hit is None else hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def utc(ts: Column) -> Column:
    """Second precision, UTC (the session's time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def scannable(raw: Column) -> Column:
    """What a published entry shows: its body, then title, category and list values of the front matter.

    Without front matter, or with one that never ends, everything.
    """
    inner = F.substring(raw, 5, 2_000_000_000)
    end = F.instr(inner, "\n---")
    head = F.substring(inner, F.lit(1), end - 1)
    body = F.regexp_replace(F.substring(inner, end + 4, F.lit(2_000_000_000)), r"^\n+", "")
    shown = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike("^(title:|category:|tags:|- )"))
    values = F.transform(shown, lambda x: utrim(F.regexp_replace(x, "^(title:|category:|tags:|(- )+)", "")))
    text = F.concat(body, F.array_join(F.transform(values, lambda v: F.concat(F.lit("\n"), v)), ""))
    return F.when(raw.startswith("---\n") & (end > 0), text).otherwise(raw)


def runs(text: Column) -> Column:
    """The stretches between delimiters."""
    return F.split(text, _SPLIT)


def literals(text: Column) -> Column:
    """The tokens of a text that are long enough to be learnt; order and repetitions kept."""
    trimmed = F.transform(runs(text), lambda t: F.regexp_replace(t, f"^{_EDGE}++|(?<!{_EDGE}){_EDGE}++$", ""))
    return F.filter(trimmed, lambda t: F.octet_length(t) >= MIN_LITERAL_BYTES)


def masked_literals(original: Column, tokenised: Column) -> Column:
    """The tokens of the original that no longer stand in the tokenised text."""
    return F.filter(literals(original), lambda t: ~F.contains(tokenised, t))


def zipped(left: Column, right: Column) -> Column:
    """Pairs up to the shorter list's length (arrays_zip would pad)."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, F.lit(1), n).alias("a"), F.slice(right, F.lit(1), n).alias("b"))


def text_at(value: Column, path: str) -> Column:
    """A string leaf of a VARIANT: null for numbers, objects and arrays, which a cast would stringify."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string"))


def one_json(text: Column) -> Column:
    """A text as VARIANT if it is exactly one JSON value, else null.

    Spark's parser stops after the first value; inside a list with a known end, anything further shows.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))
    alone = (F.try_variant_get(listed, "$[1]", "int") == 0) & F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))
