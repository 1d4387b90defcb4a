"""The default tokeniser: an ordered table of patterns, placeholders by first appearance, and an entity map.

All in built-in expressions. Its table's hash is part of a session's freshness, as a prompt's would be.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (type, pattern, the group that is the value, a check) in order of precedence (fixed values: public token and identifier
#: formats): key blocks, provider tokens, web tokens, headers, URLs, named values, then identifiers.
PATTERNS = (
    ("CRED", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----", 0, None),
    ("CRED", r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{82}|glpat-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|[spr]k_(?:live|test)_[A-Za-z0-9]{24,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{34,}|sk-[A-Za-z0-9_-]{20,}|dp\.(?:sa|st|pt|ct|scim|audit|gw)\.[A-Za-z0-9_-]{20,}|lin_(?:api|oauth)_[A-Za-z0-9]{40}|pypi-[A-Za-z0-9_-]{50,})", 0, None),
    ("CRED", r"https://[a-f0-9]+@[^/\s]+/[0-9]+", 0, None),
    ("CRED", r"ssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/=]{16,}", 0, None),
    ("CRED", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, None),
    ("CRED", r"(?i)\bauthorization:\s*bearer\s+([A-Za-z0-9._~+/=-]{8,})", 1, None),
    ("CRED", r"\bhttps?://[^\s:/@]+:([^\s@/]+)@", 1, None),
    ("CRED", r"(?i)\b(?:aws_?secret|cf_api_token|cloudflare)[a-z_]*[\"']?\s*[:=]?\s*[\"']?([A-Za-z0-9/+=_-]{40})(?:[^A-Za-z0-9/+=_-]|$)", 1, None),
    ("CRED", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_.~-]{8,})", 1, "digit"),
    ("ARN", r"\barn:aws[a-zA-Z-]*:[a-z0-9-]+:[a-z0-9-]*:[0-9]{12}:[A-Za-z0-9:_/.+=@-]+", 0, None),
    ("ACCOUNT", r"(?i)\b(?:aws|account)[ _-]?(?:id|number|no)?[\"']?[ :=#]+[\"']?([0-9]{12})\b", 1, None),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,}\b", 0, None),
    ("UUID", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", 0, None),
    ("IP", r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b", 0, None),
    ("IP", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b", 0, None),
    ("MAC", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", 0, None),
    ("CARD", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", 0, "luhn"),
    ("HOST", r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:internal|lan|local|tailnet|ts\.net)\b", 0, None),
    ("PHONE", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{1,5}){2,6}\b", 0, None),
)
SIGNATURE = hashlib.sha256(repr(PATTERNS).encode()).hexdigest()


def found(text):
    """An array of (type, value) in table order; each distinct value once, under its first type.

    A value around one of an earlier type (an address made of a URL's password and host) gives way to it.
    """
    parts = [F.transform(_checked(F.regexp_extract_all(text, F.lit(p), F.lit(group)), check), _tag(kind)) for kind, p, group, check in PATTERNS]
    every = F.filter(F.concat(*parts), lambda x: x["value"] != "")

    def chosen(all_found):
        def first(x, i):
            around = F.exists(F.slice(all_found, F.lit(1), i), lambda y: (y["type"] != x["type"]) & F.contains(x["value"], y["value"]))
            return (F.array_position(F.transform(all_found, lambda y: y["value"]), x["value"]) == i + 1) & ~around

        return F.filter(all_found, first)

    return F.transform(F.array(every), chosen)[0]  # bound to a name, the patterns run once


def _checked(values, check: str | None):
    if check == "digit":
        return F.filter(values, lambda v: v.rlike("[0-9]"))
    if check == "luhn":
        return F.filter(values, lambda v: F.call_function("luhn_check", F.regexp_replace(v, "[ -]", "")))
    return values


def _tag(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def redact(df: DataFrame, column: str) -> DataFrame:
    """Adds `redacted` and `entities` (placeholder -> type); numbers run per type in order of first appearance.

    Spellings of a value that differ in case only share a number.
    """
    text = F.col(column)
    rows = df.withColumn("_found", found(text))
    # by place of first appearance in any case; of values at one place the longer counts first
    placed = F.transform("_found", lambda x: F.struct(F.instr(F.lower(text), F.lower(x["value"])).alias("at"), (-F.octet_length(x["value"])).alias("n"), x["type"].alias("type"), x["value"].alias("value")))
    rows = rows.withColumn("_found", F.array_sort(placed))

    def number(x):
        before = F.filter("_found", lambda y: (y["type"] == x["type"]) & ((y["at"] < x["at"]) | ((y["at"] == x["at"]) & (y["n"] < x["n"]))))
        return F.size(F.array_distinct(F.transform(before, lambda y: F.struct(y["at"], y["n"])))) + 1

    ranked = F.transform("_found", lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value"), F.concat(F.lit("#"), x["type"], F.lit("_"), F.lpad(number(x).cast("string"), 3, "0"), F.lit("#")).alias("ph"), x["type"].alias("type")))
    rows = rows.withColumn("_ranked", F.array_sort(ranked))  # longest first
    out = F.aggregate("_ranked", text, lambda acc, y: F.replace(acc, y["value"], y["ph"]))
    used = F.array_distinct(F.transform(F.filter("_ranked", lambda y: F.contains(F.col("redacted"), y["ph"])), lambda y: F.struct(y["ph"], y["type"])))
    return rows.withColumn("redacted", out).withColumn("entities", F.map_from_entries(used)).drop("_found", "_ranked")


PLACEHOLDER = r"#[A-Z][A-Z0-9_]*_[0-9]{3,}#"


def integrity(tokenised: DataFrame) -> DataFrame:
    """(draft_id, unlisted, unused): placeholders used in title or body but no key of the entity map, and the reverse."""
    one = tokenised.dropDuplicates(["draft_id"])
    text = F.concat_ws("\n", "title", "category", F.array_join("tags", "\n"), "body")
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))
    keys = F.coalesce(F.json_object_keys("entities"), F.array().cast("array<string>"))
    rows = one.select("draft_id", used.alias("used"), keys.alias("keys"))
    gaps = rows.select("draft_id", F.array_join(F.array_sort(F.array_except("used", "keys")), ",").alias("unlisted"), F.array_join(F.array_sort(F.array_except("keys", "used")), ",").alias("unused"))
    return gaps.where("unlisted <> '' or unused <> ''")


def entity_edges(tokenised: DataFrame) -> DataFrame:
    """(draft_id, placeholder, type) of every entity."""
    one = tokenised.dropDuplicates(["draft_id"]).where("entities is not null")
    return one.select("draft_id", F.explode(F.from_json("entities", "map<string,struct<type:string>>")).alias("placeholder", "v")).select("draft_id", "placeholder", F.col("v.type").alias("type"))
