"""What jobs leave on disk: shuffles that are asked for, and shuffle files that nothing reads again."""

from __future__ import annotations

from drawkit import fixtures as X
from drawkit.operators import bom, match, verdict
from drawkit.queries import kit
from drawkit.shared import FREED, settled
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan_without_broadcasts(spark, make) -> str:
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sources_meet_where_their_drawing_is(spark):
    """rows are dealt by part and by drawing; filling cells shuffles them no more."""
    plan = plan_without_broadcasts(spark, lambda: kit.j13_row_source_coalesce(spark, DATA))
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(drawing_id" not in plan


def test_shuffle_by_drawing_has_no_texts_twice(spark):
    """BOM rows are named after they are numbered, so what is shuffled by drawing is the line and the part's name."""
    plan = plan_without_broadcasts(spark, lambda: X.bom_rows(spark, DATA))
    below = plan[plan.index("hashpartitioning(l_orderkey") :]
    assert "PT." not in below


def test_cells_by_code_before_name(spark):
    """null drawings and empty keys fill nothing; of several base rows the last counts; code goes before name."""
    row = "drawing_id long, page_number int, pos long, sequence_no string, code string, name string, note string, quantity string, more string"
    base = [(1, 1, 1, "1", "A-10", "bolt", "n1", "1", "x"), (1, 2, 1, "2", "a-10", "bolt", "n2", "2", "x"), (1, 1, 9, "3", "B-20", "nut", "n3", "3", "x"), (1, 1, 3, "4", "", "", "n4", "4", "x"), (None, 1, 1, "5", "A-10", "bolt", "n5", "5", "x")]
    own = [(1, 1, 1, "", "A-10", "nut", "", "", "p"), (1, 1, 2, "7", "C-30", "nut", " ", "", "q"), (1, 1, 3, "", "", "", "", "", "r"), (None, 1, 4, "", "A-10", "bolt", "", "", "s"), (2, 1, 5, "", "A-10", "bolt", "", "", "t")]
    got = bom.coalesce_sources(spark.createDataFrame(own, row), spark.createDataFrame(base, row))
    assert got.columns == spark.createDataFrame(own, row).columns
    assert sorted((r.more, r.sequence_no, r.note, r.quantity) for r in got.collect()) == [("p", "2", "n2", "2"), ("q", "7", "n3", "3"), ("r", "", "", ""), ("s", "", "", ""), ("t", "", "", "")]


def test_settled_leaves_no_shuffle_files(spark):
    """what is settled has been read from its shuffles; they go, and the setting is as before."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    kept = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert spark.conf.get(FREED, "false") == "false"
    assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6


def test_items_are_not_dealt_by_check(spark, monkeypatch):
    """the reasons of ignored files are settled, so that Spark sees one small row per check."""
    seen = []
    monkeypatch.setattr(match, "settled", lambda df: seen.append(df.columns) or settled(df))
    kit.items(spark, DATA)
    assert ["check_id", "ignored_reasons"] in seen


def test_summary_counts_items_once(spark, monkeypatch):
    """items are counted by drawing once; repeated visits count a group twice, its items once."""
    seen = []
    monkeypatch.setattr(verdict, "settled", lambda df: seen.append(df.columns) or settled(df), raising=False)
    checks = spark.createDataFrame([(1, "completed", "all", [10, 11, 12]), (2, "completed", "all", [10])], "check_id long, status string, mode string, drawing_ids array<long>")
    visits = spark.createDataFrame([(1, 10, "processed"), (1, 10, "partial"), (1, 11, "no_table"), (1, 12, "processed")], "check_id long, drawing_id long, status string")
    items = spark.createDataFrame([(1, 10, None, "ok", "exists"), (1, 10, None, "ok", "missing"), (1, 10, "x", "ok", "exempt"), (1, 11, None, "ok", "exists"), (2, 10, None, "ok", "exists")], "check_id long, drawing_id long, exempt_reason string, extraction_status string, match_status string")
    drawings = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "id long, filename string")
    got = {r.check_id: r for r in verdict.check_summary(checks, visits, items, drawings, drawings).collect()}
    r = got[1]
    assert (r.exists, r.missing, r.exempt, r.assemblies, r.empty_processed_drawings, r.issue_drawings) == (1, 1, 1, 2, 1, 2)
    assert (got[2].exists, got[2].assemblies, got[2].all_present) == (0, 0, False)
    assert len(seen) == 2 and seen[0][:2] == ["check_id", "drawing_id"]
