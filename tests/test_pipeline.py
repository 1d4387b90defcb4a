import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom import __main__ as command
from sessionloom.config import EngineConfig, Stage
from sessionloom.operators import backends, entries, registry, tables
from sessionloom.plans import pipeline
from sessionloom.sources import files
from sessionloom.streaming import arrivals

META = {"type": "session_meta", "payload": {"id": "s-1", "originator": "codex-tui", "source": "cli", "cwd": "/w/x", "git": {"repository_url": "git@h.test:t/repo.git"}}}


def item(**payload):
    return {"type": "response_item", "payload": payload}


@pytest.fixture
def logs(tmp_path):
    def write(name, rows, end="\n"):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(end.join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)

    write("e/one.jsonl", [META, item(type="message", role="user", content=[{"type": "input_text", "text": "mail me at someone.private@host.test"}]), "{bad", item(type="function_call", name="bash", call_id="c", arguments=" "), item(type="function_call_output", call_id="c", output="done\nwell"), item(type="custom_tool_call_output", call_id="zz", output='{"output": " in ", "n": 1}'), item(type="reasoning", summary=["first", {"text": "second"}, 3]), item(type="message", role="developer", content=[]), item(type="function_call_output", call_id="c", output=5)], "\r\n")
    write("p/-home-my-tool/two.jsonl", [{"type": "summary"}, {"type": "user"}])
    write("p/subagents/three.jsonl", [{"type": "user"}])
    write("bad.jsonl", ["no json", {"type": "user"}])
    (tmp_path / "logs" / "x.txt").write_text("no")
    return str(tmp_path / "logs")


def config(root, answer=None):
    draft = [{"title": "A title", "category": "c", "tags": ["tag"], "quote": "mail someone.private@host.test", "why": "w"}]

    def extract(prompt):
        if "my-tool" in prompt or '"summary"' in prompt:
            return "[]"
        return "noise " + json.dumps(draft)

    def tokenise(prompt):
        d = json.loads(prompt[prompt.index("\n{") + 1 :])
        return json.dumps({"title": d["title"], "category": d["category"], "tags": d["tags"], "body": d["quote"].replace("someone.private@host.test", "#EMAIL_001#"), "entities": {"#EMAIL_001#": {"type": "EMAIL"}}})

    return EngineConfig(root, backends.Offline("off/x", answer or extract), backends.Offline("off/t", tokenise))


def test_sources(spark, logs):
    found = files.session_files(spark, logs)
    assert [os.path.basename(r.path) for r in found.collect()] == ["bad.jsonl", "one.jsonl", "two.jsonl"]
    assert files.session_files(spark, f"{logs}/x.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        files.session_files(spark, f"{logs}/none")
    kinds = {os.path.basename(r.path): r for r in files.sniff(files.lines(files.session_files(spark, logs, True))).collect()}
    assert kinds["bad.jsonl"].dialect is None and kinds["one.jsonl"].session_id == "s-1" and kinds["one.jsonl"].project_name == "repo" and kinds["two.jsonl"].project_name == "my-tool"
    assert pipeline.stats(spark, logs).first().files == 3 and files.markdown(spark, f"{logs}/none").count() == 0


def names(result):
    return [os.path.basename(r.path) for r in result.paths.collect()]


def test_mine_is_incremental_and_validates(spark, logs, tmp_path):
    cfg = config(str(tmp_path / "out"))
    assert pipeline.plan(spark, logs, cfg).count() == 3 and not os.path.exists(cfg.root)
    result = pipeline.mine(spark, logs, cfg)
    assert result.counters == {"extracted": 2, "skipped": 0, "failed": 1} and names(result) == ["001-a-title.md"]
    text = open(result.paths.first().path).read()
    assert "#EMAIL_001#" in text and "someone.private" not in text and "project: repo" in text and '"family": "codex"' in text
    assert pipeline.plan(spark, logs, cfg).count() == 1  # only the file that failed
    os.symlink(logs, tmp_path / "again")
    assert pipeline.plan(spark, str(tmp_path / "again"), cfg).count() == 1  # one key however a file is reached
    assert pipeline.mine(spark, logs, cfg).counters == {"extracted": 0, "skipped": 2, "failed": 1}
    known = tables.load(spark, cfg.registry, registry.SCHEMA)
    assert {r.category for r in known.collect() if r.category} == {"EMAIL"}
    assert pipeline.validate(spark, cfg.entries, known).first().leaked is False
    with open(os.path.join(cfg.entries, "002-x.md"), "w") as f:
        f.write("---\ntitle: x\nproject: someone.private@host.test\n---\n\nfine\n")
    assert not any(r.leaked for r in pipeline.validate(spark, cfg.entries, known).collect())  # the project is not scanned
    with open(os.path.join(cfg.entries, "003-x.md"), "w") as f:
        f.write("---\ntitle: someone.private@host.test\n---\n\nfine\n")
    assert {(r.leaked, r.n) for r in pipeline.validate_counts(pipeline.validate(spark, cfg.entries, known)).collect()} == {(False, 2), (True, 1)}


def test_a_literal_counts_from_the_draft_that_taught_it(spark, tmp_path):
    for k, name in enumerate(("a", "b", "c")):
        folder = tmp_path / "logs" / name
        folder.mkdir(parents=True)
        rows = [META | {"payload": META["payload"] | {"id": f"s-{name}"}}, item(type="message", role="user", content=[{"type": "input_text", "text": f"{name} taught.later@host.test"}])]
        (folder / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    def extract(prompt):
        name = prompt[prompt.index("[HUMAN]: ") + 9]
        return json.dumps([{"title": name, "category": "c", "tags": [], "quote": f"{name} taught.later@host.test", "why": "w"}])

    def tokenise(prompt):
        d = json.loads(prompt[prompt.index("\n{") + 1 :])
        body = d["quote"].replace("taught.later@host.test", "#EMAIL_001#") if d["title"] == "b" else d["quote"]
        return json.dumps({k: d[k] for k in ("title", "category", "tags")} | {"body": body})

    for sequential, flagged in ((True, {"c"}), (False, {"a", "c"})):
        cfg = EngineConfig(str(tmp_path / f"out-{sequential}"), backends.Offline("x", extract), backends.Offline("t", tokenise), sequential=sequential)
        result = pipeline.mine(spark, str(tmp_path / "logs"), cfg)
        assert {r.title for r in result.entries.collect() if r.needs_manual_review} == flagged
        assert names(result) == ["001-a.md", "002-b.md", "003-c.md"]


def test_unreadable_files_and_taken_numbers(spark, logs, tmp_path):
    listed = spark.createDataFrame([(f"{logs}/bad.jsonl", 1), (f"{logs}/gone.jsonl", 1)], "path string, size_bytes long")
    assert {(r.content is None, r.error) for r in files.read(listed).collect()} == {(False, None), (True, "FileNotFoundError")}
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"d{i}", i, f"id-{i}", "T", "B") for i in (1, 2)], "draft_id string, number int, id string, title string, body string")
    os.makedirs(folder)
    open(os.path.join(folder, "001-t.md"), "w").write("other")
    for _ in range(2):  # a repeated task finds its own files
        assert {(r.draft_id, os.path.basename(r.path)) for r in entries.published(rows, folder, 2).collect()} == {("d1", "003-t.md"), ("d2", "002-t.md")}
    table = str(tmp_path / "table")
    for n in (1, 2, 3):
        tables.save(spark.range(n), table)
    assert tables.load(spark, table, "id long").count() == 3 and len([x for x in os.listdir(table) if x.startswith("v-")]) == 2


@pytest.mark.parametrize("model", ["sonnet", "codex/m", "gemini/m", "opencode/a/m", "pi/up/m"])
def test_calls_of_the_five_providers(model):
    stage = Stage.parse(model, "min" if model.split("/")[0] in ("sonnet", "codex", "opencode") else None)
    one = backends.call(stage, "PROMPT", "/read")
    assert (one.stdin == "PROMPT") != ("PROMPT" in one.argv) and one.events == (stage.provider == "opencode")
    assert "/read" in [*one.argv, one.folder] and one.argv[0] == {"claude-code": "claude"}.get(stage.provider, stage.provider)
    assert any(x in " ".join(one.argv) for x in ("--effort low", 'model_reasoning_effort="minimal"', "--variant minimal")) == bool(stage.effort)
    assert stage.provider != "pi" or one.argv[1:5] == ["--provider", "up", "--model", "m"]


def test_a_bad_answer_is_asked_for_again_and_a_failure_is_not(spark):
    seen = []

    def answer(prompt):
        return "[]" if prompt.endswith(backends.STRICT) else "prose"

    def fail(prompt):
        raise RuntimeError("again" if prompt.endswith(backends.STRICT) else "permission denied")

    df = spark.createDataFrame([("a", "text")], "session_id string, transcript string")
    assert backends.extract(df, backends.Offline("x", answer), "p").first().ok
    assert backends.extract(df, backends.Offline("x", fail), "p").first().error == "RuntimeError: permission"
    with pytest.raises(RuntimeError, match="no answer"):
        program = backends.Program(Stage.parse("pi/a/b"), timeout=0.2)
        backends.call, kept = (lambda *a: backends.Call(["sleep", "5"])), backends.call
        try:
            program.generate(["x"])
        finally:
            backends.call = kept
    assert not seen


def test_command_line(spark, logs, tmp_path, monkeypatch):
    said = []
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "xdg"))
    run = lambda *argv: command.main(list(argv), spark, said.append)
    assert run() == 2 and run("mine") == 2 and run("--nonsense") == 2 and run(logs, "--extractor-model", "none/x") == 2
    assert run("stats", logs) == 0 and said[-1].startswith("3 files")
    assert run("validate") == 0 and "empty" in said[-1]
    cfg = config(str(tmp_path / "out"))
    pipeline.mine(spark, logs, cfg)
    assert run("validate", cfg.entries, "--content-root", cfg.root) == 0
    open(os.path.join(cfg.entries, "9-x.md"), "w").write("someone.private@host.test")
    assert run("validate", cfg.entries, "--content-root", cfg.root) == 1 and said[-1] == "1 clean, 1 leaked"


def test_failures_stay_apart_and_safe(spark):
    def answer(prompt):
        raise RuntimeError("rate limit for token secret-abc")

    rows = backends.extract(spark.createDataFrame([("a", "text"), ("b", " "), ("c", None)], "session_id string, transcript string"), backends.Offline("x", answer), "p").collect()
    assert [r.ok for r in rows] == [False] * 3 and {r.error for r in rows} == {"RuntimeError: quota", "blank transcript"}
    assert "secret" not in backends.safe_error("p", 1, "secret", "") and backends.safe_error("p", 1, "", "api key invalid").endswith("api_key")


def test_stream_counts_redelivered_lines_once(spark, tmp_path):
    schema = "session_id string, line_no int, project_name string, type string, ingested_at timestamp"
    rows = spark.sql("select 's' session_id, cast(id % 5 as int) line_no, 'p' project_name, 'user' type, timestamp'2026-01-01 10:00:00' + make_interval(0,0,0,0,0,id) ingested_at from range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    query = arrivals.run(arrivals.deduplicated(arrivals.stream(spark, str(tmp_path / "in"), schema)), lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sum(seen) == 5
    assert arrivals.activity(rows).agg(F.sum("lines")).first()[0] == 20
