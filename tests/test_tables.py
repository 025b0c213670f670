"""Tables of pages: how blocks come to the tasks, and what batches cut."""

from __future__ import annotations

import random

from drawkit.operators import geometry
from drawkit.queries import pages

DATA = "/root/testdata/sf0.001"
BLOCK = "drawing_id long, page int, pos int, text string, x double, y double, w double, h double, confidence double"


def test_blocks_dealt_by_drawing_are_not_shuffled(spark):
    """laid-out rows come with their header in one pass, and pages are read where their drawing is, many at a time."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = geometry.table_pages(pages.table_blocks(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "MapInArrow" in plan and "Union" not in plan and plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(drawing_id" not in plan


def test_pages_that_batches_cut(spark):
    """a page may reach over any number of batches; nulls and full-width texts too."""
    rng, rows = random.Random(4), []
    words = ["PT.0001", "盖 板", "ＡＢ.１", "x  y", "3", "-2.5", "约4件", "标准件", "", None, "比例"]
    for d in range(30):
        head = rng.sample(["序号", "代号", "名称", "数量", "备注", "材料"], 6)
        rows += [(d or None, 1, i, t, 0.1 + 0.1 * i, 0.6, 0.04, 0.01, 0.9) for i, t in enumerate(head[: rng.randint(2, 6)])]
        rows += [(d or None, 1, 10 + i, rng.choice(words), round(rng.random(), 2), rng.choice([None, 0.58, 0.56, 0.5]), 0.04, 0.01, 0.9) for i in range(rng.choice([2, 20, 60]))]
    got = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = geometry.tables(spark.createDataFrame(rows, BLOCK))
        got.append([sorted(map(repr, x.collect())) for x in out])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0][0]) > 15 and 15 < len(got[0][1]) <= 30


def test_cells_and_their_columns(spark):
    cells = [("序号", 0.1, 0.6), ("代号", 0.25, 0.6), ("名称", 0.4, 0.6), ("材料", 0.5, 0.6), ("1", 0.1, 0.58), ("A-\t10", 0.25, 0.58), ("盖", 0.4, 0.581), (None, 0.4, 0.58), ("板", 0.41, 0.58), ("far", 0.9, 0.58), ("图号", 0.25, 0.56), ("low", 0.25, 0.7), ("2", 0.1, 0.5), ("O1O2", 0.25, 0.5)]
    blocks = spark.createDataFrame([(7, 2, i, t, x, y, 0.04, 0.01, 0.9) for i, (t, x, y) in enumerate(cells)] + [(8, 1, 0, "序号代号名称", 0.1, 0.1, 0.1, 0.1, 0.9), (9, 1, 0, "代号", 0.1, 0.1, 0.1, 0.1, 0.9)], BLOCK)
    rows, found = geometry.tables(blocks)
    got = sorted((r.pos, r.sequence_no, r.code, r.name, r.raw_text, r.x, r.y, r.w, r.h, r.issues) for r in rows.collect())
    assert got == [(0, "2", "O102", "", "2 O1O2", 0.1, 0.5, 0.19, 0.01, ["名称缺失", "数量缺失"]), (1, "1", "A-10", "板 盖", "1 A-\t10 板 盖", 0.1, 0.58, 0.35, 0.011, ["数量缺失"])]
    assert sorted((r.drawing_id, r.page, r.x, r.y, r.w, r.h, r.complete) for r in found.collect()) == [(7, 2, 0.1, 0.5, 0.44, 0.11, False), (8, 1, 0.1, 0.1, 0.1, 0.1, False)]
