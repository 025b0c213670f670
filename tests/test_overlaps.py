"""Overlap removal on crowded pages against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from drawkit.operators import geometry, layout

DDL = "drawing_id long, page int, pos int, text string, x double, y double, w double, h double"


def shared(a, b):
    side = lambda p, n: max(0.0, min(a[p] + a[n], b[p] + b[n]) - max(a[p], b[p]))
    return side(0, 2) * side(1, 3)


def plain(rows, measure, least, order):
    kept = []
    for r in sorted(rows, key=order):
        box = r[4:]
        for k in kept:
            if k[3] == r[3]:
                s = shared(k[4:], box)
                a, b = k[6] * k[7], box[2] * box[3]
                whole = a + b - s if measure == "iou" else min(a, b)
                if whole > 0 and s / whole >= least:
                    break
        else:
            kept.append(r)
    return sorted(r[2] for r in kept)


def page_of(n, seed):
    rng = random.Random(seed)
    return [(1, 1, i, rng.choice("ab"), rng.randrange(40) / 40, rng.randrange(40) / 40, rng.choice([0.0, 0.05, 0.1, 0.3]), rng.choice([0.05, 0.1])) for i in range(n)]


@pytest.mark.parametrize("n", [40, 700])
def test_greedy_unique_either_way(spark, n):
    rows = page_of(n, n)
    df = spark.createDataFrame(rows, DDL)
    assert sorted(r.pos for r in geometry.iou_dedup(df).collect()) == plain(rows, "iou", 0.8, lambda r: (r[5], r[4], r[2]))
    assert sorted(r.pos for r in geometry.overlap_dedup(df).collect()) == plain(rows, "smaller", 0.6, lambda r: r[2])


def test_blocks_without_a_box_stay_folded(spark):
    rows = page_of(100, 3) + [(1, 1, 1000 + i, "a", 0.1 * i, 0.5, None, 0.1) for i in range(3)]
    got = {r.pos for r in geometry.overlap_dedup(spark.createDataFrame(rows, DDL)).collect()}
    assert {1000, 1001, 1002} <= got


def test_twenty_thousand_boxes_of_one_text(spark):
    df = spark.range(20_000).select(
        F.lit(1).cast("long").alias("drawing_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("pos"), F.lit("a").alias("text"),
        (F.col("id") % 200 / 200).alias("x"), (F.floor(F.col("id") / 200) / 100).alias("y"), F.lit(0.006).alias("w"), F.lit(0.011).alias("h"),
    )
    began = time.time()
    assert geometry.iou_dedup(df).count() == 20_000
    assert time.time() - began < 60


def test_title_tables_of_a_crowded_page(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.uniform(-0.1, 0.9), rng.uniform(-0.1, 0.9)
        box = (x, y, x + rng.choice([0.0, 0.1, 0.5]), y + rng.choice([0.05, 0.2])) if i % 20 else (None,) * 4
        rows.append((i % 2, 0, i, "table", "材料 | 比例 | 图号" + " | 设计" * rng.randrange(3), *box))
    ddl = "drawing_id long, page_idx int, pos int, type string, content string, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(rows, ddl)
    ranks = {r.pos: (r.score, len(r.text), -r.pos) for r in layout.title_tables(df.withColumns({c: F.lit(None).cast("double") for c in ("x0", "y0", "x1", "y1")})).collect()}
    want = []
    for r in rows:
        if r[5] is None:
            want.append(r[2])
            continue
        box = lambda q: (q[5], q[6], q[7] - q[5], q[8] - q[6])
        area = lambda q: (q[7] - q[5]) * (q[8] - q[6])
        beaten = any(q[0] == r[0] and q[5] is not None and min(area(q), area(r)) > 0 and shared(box(q), box(r)) >= 0.45 * min(area(q), area(r)) and ranks[r[2]] < ranks[q[2]] for q in rows)
        if not beaten:
            want.append(r[2])
    assert sorted(r.pos for r in layout.title_tables(df).collect()) == sorted(want)
