"""What the corpus operators share: the shared folder, Arrow batches and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: White space of the contracts, for Java and RE2 patterns: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where a local session names none, as in tests, a temporary one is set for it. On a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            base = at.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/drawkit-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hashes that are sent to every task.
SENT = 2_000_000


def keep_rows(docs: DataFrame, gone: DataFrame, twice: DataFrame, key: dict[str, Column]) -> DataFrame:
    """The rows of docs whose key is not in gone; of those with one key in twice a single one. Same columns, of any names.

    key: expressions over docs by name; gone and twice have these columns, and may hold nulls in them. Only 64-bit hashes
    of the keys in gone meet all rows, by broadcast up to SENT of them (16 MB), so that texts stay where they are; rows
    that such a hash points at are few, and are held against the keys themselves. twice is empty unless rows repeat; only
    such rows are dealt by their key, and they are folded in the map tasks first.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in key.items()))
    held = held.withColumn("_h", F.xxhash64(*key))
    gone, twice = stored(gone.distinct().withColumn("_h", F.xxhash64(*key))), stored(twice.distinct())
    hashes = gone.select("_h").distinct()
    hashes = F.broadcast(hashes) if gone.count() <= SENT else hashes
    same = lambda other: reduce(lambda a, b: a & b, (held[k].eqNullSafe(other[k]) for k in key))
    kept = held.join(hashes, "_h", "left_anti").select("row", *key)
    met = held.join(hashes, "_h", "left_semi").select("row", *key)
    met_stays = met.join(gone.drop("_h"), reduce(lambda a, b: a & b, (met[k].eqNullSafe(gone[k]) for k in key)), "left_anti")
    stays = kept.unionByName(met_stays)
    if twice.isEmpty():
        return stays.select("row.*")
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    order = F.xxhash64(*(F.col(f"row.`{c}`") for c in plain))
    one = held.join(twice, same(twice), "left_semi").groupBy(*key).agg(F.min_by("row", order).alias("row"))
    same_stays = reduce(lambda a, b: a & b, (stays[k].eqNullSafe(twice[k]) for k in key))
    return stays.join(twice, same_stays, "left_anti").select("row.*").unionByName(one.select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column without nulls."""
    return column.cast(pa.binary()).to_pylist()


def rebatch(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of a bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_group(rows: DataFrame, groups: DataFrame, key: list[str], size: str, most: int = 100_000, listed: int = 100_000) -> DataFrame:
    """rows with the columns of their group; no task gets all rows of a large one. groups: stored, one row per key.

    size: the column of groups that says how many rows a group has. Groups beyond `most` rows, and beyond a `listed`-th
    of all rows, are broadcast: they are at most `listed`, however many rows there are. The others are joined by the key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(most, total // listed)
    large = F.broadcast(groups.where(F.col(size) > limit))
    small = rows.join(large.select(*key), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return rows.join(large, key).unionByName(small)
