"""The core stands without the optional subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_core_does_not_import_the_optional_subpackage():
    for path in (ROOT / "sessionloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"sessionloom\.llm|from sessionloom import llm", path.read_text()), path


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "leak_review" in names
    folder = Path("/root/testdata/sf0.001")
    if folder.is_dir():
        assert entry.entry(spark).columns == ["draft_id", "hits", "needs_manual_review", "review_reason"]


def test_stashed_tables_can_be_released(spark):
    from sessionloom import frames

    frames.release(spark)
    df = frames.stash(spark.range(10))
    assert df.count() == 10 and frames.release(spark) == 1 and frames.release(spark) == 0
    assert frames.cut(spark.range(5)).count() == 5 and frames.spread(spark.range(5).coalesce(1)).count() == 5
