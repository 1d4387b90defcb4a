import json
import os
import threading

import pytest

from sessionloom.operators import entries, state

FILE = "session_key string, file_sha256 string, extractor_prompt_sha256 string, tokeniser_prompt_sha256 string, extractor_backend_signature string, tokeniser_backend_signature string, version string"


def test_freshness_flips_on_each_field(spark):
    base = ["k", "f", "e", "t", "x", "y", "1"]
    files = [["k0", *base[1:]]] + [[f"k{i}", *(v if j != i else v + "'" for j, v in enumerate(base[1:], 1))] for i in range(1, 7)]
    known = spark.createDataFrame([[f"k{i}", *base[1:]] for i in range(7)], FILE)
    assert {r.session_key for r in state.stale(spark.createDataFrame(files, FILE), known).collect()} == {f"k{i}" for i in range(1, 7)}
    old = spark.createDataFrame([["k0", "f", "e", "t", None, None, "1"]], FILE)
    assert state.stale(spark.createDataFrame([["k0", "f", "e", "t", "", "", "1"]], FILE), old).count() == 0


def test_upsert_is_idempotent(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "session_key string, v int"), spark.createDataFrame([("y", 2), ("z", 2)], "session_key string, v int")
    once = state.upsert(a, b)
    assert sorted(map(tuple, once.collect())) == [("x", 1), ("y", 2), ("z", 2)] == sorted(map(tuple, state.upsert(once, b).collect()))


def test_append_decisions(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([(k, c, sha(c)) for k, c in (("same", "abc"), ("grown", "abcdef"), ("changed", "xbcdef"), ("new", "q"))], "session_key string, content string, file_sha256 string")
    old = spark.createDataFrame([(k, sha("abc"), 3) for k in ("same", "grown", "changed")], "session_key string, file_sha256 string, size_bytes long")
    assert {r.session_key: r.decision for r in state.append_decision(files, old).collect()} == {"same": "skip", "grown": "incremental", "changed": "full", "new": "full"}


def test_files(tmp_path, spark):
    path = str(tmp_path / "deep" / ("é" * 110 + ".json"))
    state.atomic_write(path, b"1")
    state.atomic_write(path, b"2")
    assert open(path, "rb").read() == b"2" and len(os.listdir(os.path.dirname(path))) == 1
    target, won = str(tmp_path / "t" / "x.md"), []
    threads = [threading.Thread(target=lambda i=i: won.append(state.atomic_write_exclusive(target, b"%d" % i))) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won.count(True) == 1 and os.listdir(tmp_path / "t") == ["x.md"]
    where = str(tmp_path / "state.json")
    assert state.load(spark, where).count() == 0
    open(where, "w").write(json.dumps({"sessions": {"k": {"file_sha256": "a", "version": "1"}}}))
    row = state.load(spark, where).first()
    assert row.extractor_backend_signature == "" and row.extracted_entry_files == []
    state.save(state.load(spark, where), where)
    assert state.load(spark, where).count() == 1
    open(where, "w").write("{")
    with pytest.raises(ValueError):
        state.load(spark, where)


def test_markdown_and_publishing(tmp_path):
    entry = {"id": "i", "title": "Per your own rule", "project": "p", "category": "c", "source_type": "s", "session_id": None, "message_range": [42, 51], "extracted_at": "2026-01-01T00:00:00Z", "needs_manual_review": False, "review_reason": None, "tags": ["a", "true"], "entities": None, "body": "B"}
    text = entries.markdown(entry)
    assert text.startswith("---\nid: i\ntitle: Per your own rule\n") and text.endswith("\n---\n\nB\n") and '- "true"' in text and "session_id" not in text and "entities: null" in text
    folder = str(tmp_path)
    paths, number = entries.publish([entry, entry], folder, 311)
    assert [os.path.basename(p) for p in paths] == ["312-per-your-own-rule.md", "313-per-your-own-rule.md"] and number == 313
    assert os.path.basename(entries.publish([entry], folder, 311)[0][0]) == "314-per-your-own-rule.md"
    assert entries.uuid7()[14] == "7" and entries.slug("a" * 59 + " b") == "a" * 59


def test_numbers(spark):
    names = spark.createDataFrame([("007-a.md",), ("12-b.md",), ("x-1.md",), ("99.md",), ("500-c.txt",)], "name string")
    assert entries.max_number(names) == 12 and entries.max_number(names.limit(0)) == 0
    rows = spark.range(1000).selectExpr("id % 10 as a", "id as b").repartition(7)
    got = sorted((r.a, r.b, r.number) for r in entries.numbered(rows, ["a", "b"], 5).collect())
    assert [n for _, _, n in got] == list(range(6, 1006))
