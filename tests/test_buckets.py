"""Tables in buckets: a change writes the buckets it touches, and readers see all of it or nothing."""

import os
import random

import pytest
from drawkit.operators import buckets
from pyspark.sql import functions as F

DDL = "k long, v long, s string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_changes_against_plain_dictionaries(spark, tmp_path):
    rng, path = random.Random(3), f"{tmp_path}/t"
    held = {k: (k, rng.randint(0, 9), "old") for k in range(60)}
    buckets.create(spark.createDataFrame(list(held.values()), DDL), path, ["k"], n=8)
    new = {k: (k, rng.randint(0, 9), "new") for k in range(50, 75)}
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame(list(new.values()), DDL), buckets.upsert(["k"], "v"))
    held = held | {k: r for k, r in new.items() if k not in held or r[1] >= held[k][1]}
    assert rows_of(buckets.read(spark, path, DDL)) == sorted(held.values(), key=repr)
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(3,), (4,), (999,)], "k long"), buckets.delete)
    held = {k: r for k, r in held.items() if k not in (3, 4)}
    assert rows_of(buckets.read(spark, path, DDL)) == sorted(held.values(), key=repr)
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(5, "patched"), (3, "no such row")], "k long, s string"), buckets.update(["k"], ["s"]))
    held[5] = (5, held[5][1], "patched")
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(5, 1, "ignored"), (3, 1, "taken")], DDL), buckets.insert_ignore(["k"]))
    held[3] = (3, 1, "taken")
    assert rows_of(buckets.read(spark, path, DDL)) == sorted(held.values(), key=repr)
    several = [(7, 1, "a"), (7, 2, "b")]
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame(several, DDL), buckets.replace(["k"]))
    assert rows_of(buckets.read(spark, path, DDL)) == sorted([*(r for k, r in held.items() if k != 7), *several], key=repr)


def test_untouched_buckets_keep_their_files_and_old_versions_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(spark.createDataFrame([(k, 0, "x") for k in range(200)], DDL), path, ["k"], n=16)
    first = files(f"{path}/data")
    number = buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(5, 1, "y")], DDL), buckets.upsert(["k"], "v"))
    added = files(f"{path}/data") - first
    assert number == 1 and first <= files(f"{path}/data") and len({os.path.dirname(f) for f in added}) == 1
    assert buckets.read(spark, path, DDL, version=0).where("v > 0").count() == 0
    assert rows_of(buckets.read(spark, path, DDL).where("v > 0")) == [(5, 1, "y")] and buckets.read(spark, path, DDL).count() == 200
    used = {f.split("/data/")[1] for f in buckets.read(spark, path, DDL).inputFiles()}
    assert len([f for f in used if f.startswith("version=0/")]) == len({os.path.dirname(f) for f in first}) - 1


def test_a_change_with_a_number_can_be_done_again(spark, tmp_path):
    path, add = f"{tmp_path}/t", lambda old, new: old.unionByName(new)
    for number, rows in ((0, [(1, 0, "a")]), (1, [(1, 1, "b"), (2, 1, "c")]), (1, [(1, 1, "b"), (2, 1, "c")]), (4, [(9, 2, "d")])):
        assert buckets.change(spark, path, DDL, ["k"], spark.createDataFrame(rows, DDL), add, number=number, n=4) == number
    assert rows_of(buckets.read(spark, path, DDL)) == [(1, 0, "a"), (1, 1, "b"), (2, 1, "c"), (9, 2, "d")]


def test_tables_without_rows(spark, tmp_path):
    path, none = f"{tmp_path}/t", spark.createDataFrame([], DDL)
    assert buckets.read(spark, path, DDL).count() == 0
    buckets.create(none, path, ["k"])
    assert buckets.read(spark, path, DDL).count() == 0
    buckets.change(spark, path, DDL, ["k"], none, buckets.upsert(["k"], "v"))
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(None, 1, "null key"), (1, 1, "a")], DDL), buckets.upsert(["k"], "v"))
    assert rows_of(buckets.read(spark, path, DDL)) == [(1, 1, "a"), (None, 1, "null key")]
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(1,)], "k long"), buckets.delete)
    buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(None, 2, "again")], DDL), buckets.upsert(["k"], "v"))
    assert rows_of(buckets.read(spark, path, DDL)) == [(None, 2, "again")]


def test_a_broken_change_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(spark.createDataFrame([(1, 0, "a")], DDL), path, ["k"], n=2)
    bad = lambda old, new: old.withColumn("s", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        buckets.change(spark, path, DDL, ["k"], spark.createDataFrame([(1, 1, "b")], DDL), bad)
    assert rows_of(buckets.read(spark, path, DDL)) == [(1, 0, "a")]
