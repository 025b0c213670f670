"""Keeping tables: inserts, upserts, patches, deletes and replacements as DataFrames, and their publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. order: what is newest first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and those rows of new whose key is new, once each."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, that of the highest version; of equal ones the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, key, [F.desc(version), F.desc("_new")]).drop("_new")


def keyed_update(rows: DataFrame, patch: DataFrame, key: list[str], allowed: list[str]) -> DataFrame:
    """U4: rows with the patch's values in allowed columns where it has any; other columns of the patch are refused."""
    if extra := set(patch.columns) - set(key) - set(allowed):
        raise ValueError(f"not to be changed: {sorted(extra)}")
    names = [c for c in allowed if c in patch.columns]
    own = patch.select(*key, *(F.col(c).alias(f"_p_{c}") for c in names))
    out = rows.join(own, key, "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in names})
    return out.select(*rows.columns)


def keyed_delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among the keys."""
    return rows.join(keys, keys.columns, "left_anti")


def replace_group(rows: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """The groups that new has rows of are new's, the others stay."""
    return keyed_delete(rows, new.select(*group).distinct()).unionByName(new.select(*rows.columns))


def append_with_id(rows: DataFrame, new: DataFrame, natural_key: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Rows and new with an id made of its natural key, and defaults for what it lacks."""
    filled = new.withColumns({c: F.coalesce(c, d) if c in new.columns else d for c, d in defaults.items()})
    filled = filled.withColumn("id", F.xxhash64(*natural_key))
    return rows.unionByName(filled.select(*rows.columns))


def append_to_arrays(rows: DataFrame, additions: DataFrame, key: list[str], array: str) -> DataFrame:
    """Rows with the additions behind their array, each element once. additions: key, pos, value."""
    more = additions.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_more"))
    out = rows.join(more, key, "left")
    return out.withColumn(array, F.array_distinct(F.concat(F.col(array), F.coalesce("_more", F.array().cast(rows.schema[array].dataType))))).select(*rows.columns)


def merge_visits(rows: DataFrame, new: DataFrame, key: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Rows merged with new: new's values where it has any, else the old ones, else the defaults."""
    names = [c for c in rows.columns if c not in key]
    o, n = (df.select(*key, *((F.col(c) if c in df.columns else F.lit(None).cast(rows.schema[c].dataType)).alias(f"_{t}_{c}") for c in names)) for df, t in ((rows, "o"), (new, "n")))
    both = o.join(n, key, "full")
    return both.select(*key, *(F.coalesce(f"_n_{c}", f"_o_{c}", *([defaults[c]] if c in defaults else [])).alias(c) for c in names)).select(*rows.columns)


def ordered_distinct(ids: Column) -> Column:
    """Each id once, in order."""
    return F.array_distinct(ids)


def cache_lookup(wanted: DataFrame, cache: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cached, work): what has an entry of the same signature and isn't forced, and the rest. wanted: drawing_id, signature."""
    asked = wanted if forced is None else wanted.join(forced.select("drawing_id"), "drawing_id", "left_anti")
    hits = asked.join(cache, ["drawing_id", "signature"])
    return hits, wanted.join(hits.select("drawing_id"), "drawing_id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to deleted drawings; translations go with their segments. deleted: drawing_id."""
    out = {n: (t.join(deleted, "drawing_id", "left_anti") if "drawing_id" in t.columns else t) for n, t in tables.items()}
    if {"segments", "translations"} <= set(tables):
        gone = tables["segments"].join(deleted, "drawing_id", "left_semi").select(F.col("id").alias("segment_id"))
        out["translations"] = tables["translations"].join(gone, "segment_id", "left_anti")
    if "drawings" in tables:
        out["drawings"] = tables["drawings"].join(deleted.withColumnRenamed("drawing_id", "id"), "id", "left_anti")
    return out


def publish(df: DataFrame, root: str, name: str, version: int) -> str:
    """Writes df as a version of a table of its own folder; readers that hold an older version are not disturbed."""
    path = f"{root}/{name}/v={version:010d}"
    df.write.mode("errorifexists").parquet(path)
    return path
