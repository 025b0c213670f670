"""Merging BOM rows: what it says of repeats and clashes, and how often it sorts."""

from __future__ import annotations

import re

from drawkit.functions import text as T
from drawkit.operators import bom
from pyspark.sql import functions as F

ROW = "drawing_id long, pos long, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string, extraction_issue string, extraction_status string"


def test_merge_is_one_sort_for_repeats_and_clashes(spark):
    """no aggregate of whole rows, whose two steps would each sort them; one sort for repeats and clashes, one for the order."""
    rows = [
        (1, 3, 2, "1", "A-10", "bolt", "", "2", "r3", "", "ok"), (1, 1, 1, "1", "a-10", "bolt", "", "2", "r1", "", "ok"), (1, 2, 0, "1", "A-10", "bolt", "", "2", "r0", "", "ok"),
        (1, 4, 1, "2", "B-20", "nut", "", "1", "r4", "", "ok"), (1, 5, 1, "2", "B-21", "nut", "", "1", "r5", "", "ok"), (1, 6, 1, "", "C-30", "pin", "", "1", "r6", "", "ok"), (2, 1, None, "1", "D-40", "cap", "", "1", "r7", "", "ok"),
    ]
    out = bom.merge_and_validate(spark.createDataFrame(rows, ROW))
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.drawing_id, r.row_index, r.code, r.raw_text, r.pages, r.extraction_status, r.extraction_issue) for r in out.collect())
    assert got == [
        (1, 1, "A-10", "r0", [1, 2], "ok", ""), (1, 2, "B-20", "r4", [1], "review", bom.CONFLICT), (1, 3, "B-21", "r5", [1], "review", bom.CONFLICT), (1, 4, "C-30", "r6", [1], "ok", ""), (2, 1, "D-40", "r7", [], "ok", ""),
    ]
    assert "Aggregate" not in plan and len(re.findall(r"[-+ ]Sort \[", plan)) == 2


def test_clean_texts(spark):
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\n", "ＡＢ", "中 文", "中　文", "a\x7f", "é", "a b c d", "㐀", "\x00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", T.clean_text("t").alias("c"), F.lit(0)).collect()}
    wide = str.maketrans(T.WIDE, T.NARROW)
    assert got == {i: re.sub(r"\s+", " ", t.translate(wide)).strip(" ") for i, t in enumerate(texts)} | {99: ""}
