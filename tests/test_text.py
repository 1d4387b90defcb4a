import pytest
from pyspark.sql import functions as F

from sessionloom.config import Stage, data_root
from sessionloom.functions import parsing, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


def test_blocks_and_names(spark):
    f = lambda t: one(spark, text.block(F.lit("L"), F.col("t")), t=t)
    assert f(" \t a ") == "[L]: a" and f("a\nb\n") == "[L]:\na\nb"
    repo = lambda u: one(spark, text.repo_name(F.col("u")), u=u)
    assert repo("git@h.test:team/x.git") == "x" and repo("https://h.test/a/b.git.git") == "b" and repo("h/") is None and repo(".git") is None
    project = lambda p: one(spark, text.path_project(F.col("p")), p=p)
    assert project("/l/-home-dev-my-tool/a.jsonl") == "my-tool" and project("/l/single/a.jsonl") == "single"
    assert one(spark, text.path_session(F.col("p")), p="/a/b.c.jsonl") == "b.c" and one(spark, text.path_session(F.col("p")), p="/a/.hidden") == ".hidden"


def test_slugs(spark):
    slug = lambda t: one(spark, text.slug(F.col("t")), t=t)
    assert slug("Per your OWN rule!") == "per-your-own-rule" and slug("--") == "" and slug("½ Ⅷ") == "½-ⅷ"
    long = slug("é" * 50)
    assert long == "é" * 30 and len(slug("a" * 59 + " b").encode()) == 59
    assert one(spark, text.file_name(F.lit(7), F.col("t")), t="") == "007-.md"


def test_ansi_and_failures(spark):
    assert one(spark, text.strip_ansi(F.col("t")), t="a\x1b[31mred\x1b[0m\x1bz") == "aredz"
    kind = lambda t: one(spark, text.failure_class(F.col("t")), t=t)
    assert kind("a \x1b[1mrate\x1b[0m limit") == "quota" and kind("some quotation") == "quota" and kind("fine") is None
    assert kind("connection refused; permission denied") == "permission" and kind("Invalid API key") == "api_key"


def test_scannable(spark):
    f = lambda t: one(spark, text.scannable(F.col("t")), t=t)
    assert f("---\ntitle: T\nproject: P\ntags: [a]\n- b\n---\n\nbody\n") == "body\n\nT\n[a]\nb"
    assert f("no front") == "no front" and f("---\ntitle: x\n") == "---\ntitle: x\n"
    assert f("---\ntitle: x\n----\nrest") == "-\nrest\nx"


def test_literals(spark):
    column = F.array_join(text.masked_literals(F.col("a"), F.col("b")), "|")
    assert one(spark, column, a="call secret-token-1, (user@host.test) short secret-token-1", b="call #X# short") == "secret-token-1|user@host.test|secret-token-1"
    assert one(spark, column, a="tiny words only", b="") == ""


def test_one_json(spark):
    f = lambda t: one(spark, text.one_json(F.col("t")).isNotNull(), t=t)
    assert f('{"a": 1}') and not f("{} {}") and not f("{}, {}") and not f("{") and not f("{}] x")


def test_json_candidates():
    draft = '{"title":"t","category":"c","tags":[],"quote":"q [","why":"w"}'
    assert parsing.drafts("") == ([], None) and parsing.drafts("[]") == ([], None)
    assert len(parsing.drafts(f"see [3] ```[{draft},{draft}]```")[0]) == 2
    assert parsing.drafts(f"[{draft} oops] \"tags\":[]")[0] == []  # an empty inner list parses as no draft
    value, error = parsing.drafts('[{"title": "secret-value"}')
    assert value is None and "secret-value" not in error
    assert parsing.tokenised(" ")[1] and parsing.tokenised('x {"title":"t","category":"c","tags":["a"],"body":"b"} y')[0]["entities"] is None
    assert parsing.event_text('{"type":"text","text":"a"}\n{"type":"x"}\n{"type":"text","text":"b"}') == ("a\nb", None)
    assert parsing.event_text("plain")[1] == "line 1 is no JSON" and parsing.event_text("{}") == ("{}", None)
    assert list(parsing.candidates('[["]"], [1', "[", "]")) == [(1, 6)]


def test_stages_and_folders():
    assert Stage.parse("sonnet").signature == "claude-code/sonnet" and Stage.parse("Claude/x", "LOW").signature == "claude-code/x#min"
    assert Stage.parse("pi/up/model").signature == "pi/up/model"
    for bad in ("", "nope/x", "codex/", "pi/bare"):
        with pytest.raises(ValueError):
            Stage.parse(bad)
    with pytest.raises(ValueError):
        Stage.parse("gemini/x", "high")
    assert data_root("Linux", "/h", "/x", "a") == "/x/a" and data_root("Linux", "/h", "rel", "a") == "/h/.local/share/a" == data_root("Darwin", "/h", "/x", "a") == data_root("Linux", "/h", "", "a")
