"""Places and rolling means against plain loops, over groups that span many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from drawkit.operators import catalog
from drawkit.operators.ordering import mean_of_last, placed

DDL = "g string, t long, id long, v double"


def made(n):
    rng = random.Random(8)
    # One group holds most rows, one is null, and some rows have no time.
    return [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None, *range(50)]), i, rng.choice([None, 0.25, 1.5, 3.0])) for i in range(n)]


def by_group(rows, key):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(key(r), []).append(r)
    return groups.values()


@pytest.mark.parametrize("within", [["g"], []])
def test_places(spark, within):
    rows = made(700)
    want = {r[2]: n for group in by_group(rows, lambda r: r[0] if within else 0) for n, r in enumerate(group, 1)}
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert {r.id: r.n for r in placed(df, within, ["t", "id"], "n").collect()} == want


@pytest.mark.parametrize("block", [5, 7, 100_000])
def test_means_of_last_rows(spark, block):
    rows = made(400)
    want = {}
    for group in by_group(rows, lambda r: r[0]):
        for at, r in enumerate(group):
            last = [x[3] for x in group[max(0, at - 4) : at + 1] if x[3] is not None]
            want[r[2]] = sum(last) / len(last) if last else None
    df = mean_of_last(spark.createDataFrame(rows, DDL), ["g"], ["t", "id"], F.col("v"), 5, "m", block)
    assert {r.id: r.m for r in df.collect()} == want
    assert df.columns == ["g", "t", "id", "v", "m"]


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DDL)
    assert placed(empty, ["g"], ["t", "id"], "n").count() == 0
    assert mean_of_last(empty, ["g"], ["t", "id"], F.col("v"), 5, "m").count() == 0
    same = spark.createDataFrame([("a", 1, 1, 2.0)] * 9, DDL)
    assert sorted(r.n for r in placed(same, ["g"], ["t", "id"], "n").collect()) == list(range(1, 10))
    with pytest.raises(ValueError):
        mean_of_last(empty, ["g"], ["t", "id"], F.col("v"), 0, "m")


def test_no_window_holds_a_whole_group(spark):
    df = catalog.numbered(spark.createDataFrame(made(50), DDL).select("id", F.col("t").alias("upload_time")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The one window without a key is over one row per range.
    assert plan.count("Window ") <= 1 and "HashAggregate" in plan
