"""The library of drawings: listings, search, counts and upload batches."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import mean_of_last, placed

SEARCHED = ["filename", "title_text", "tech_text", "all_text"]
PAGE_SIZE = 10


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def keyword_filter(drawings: DataFrame, keyword: str, *, escape: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Drawings of which a searched column holds the keyword; only ASCII letters match in either case.

    % and _ are wildcards unless escape is set.
    """
    word = keyword.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    if escape:
        word = word.replace("%", r"\%").replace("_", r"\_")
    hit = F.lit(False)
    for c in columns or [c for c in SEARCHED if c in drawings.columns]:
        hit = hit | F.coalesce(ascii_lower(F.col(c)).like(f"%{word}%"), F.lit(False))
    return drawings.where(hit)


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE, *, newest_first: bool = True, time: str = "upload_time") -> DataFrame:
    """One page by time, ties by id."""
    order = [F.desc(time), F.desc("id")] if newest_first else [F.asc(time), F.asc("id")]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def search(drawings: DataFrame, keyword: str, number: int = 1, **how) -> DataFrame:
    """T2 of P1."""
    return page(keyword_filter(drawings, keyword), number, **how)


def lookup(rows: DataFrame, key: int, column: str = "id") -> DataFrame:
    """P2."""
    return rows.where(F.col(column) == key)


def recent(checks: DataFrame, n: int = 8) -> DataFrame:
    """T3."""
    return checks.orderBy(F.desc("id")).limit(n)


def numbered(drawings: DataFrame, within: list[str] | None = None) -> DataFrame:
    """list_number 1.. by upload time, ties by id. within names what to number apart; neither takes one task."""
    return placed(drawings, within or [], ["upload_time", "id"], "list_number")


def catalog(drawings: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Number within its batch, id, shown name, title, type, size and time of each drawing."""
    shown = ["batch_id", "id", "filename", "original_filename", "file_type", "file_size", "upload_time"]
    rows = numbered(drawings.select(*shown), ["batch_id"])
    title = F.lit("")
    if titles is not None:
        rows = rows.join(titles.select(F.col("drawing_id").alias("id"), "title"), "id", "left")
        title = T.text("title")
    return rows.select("batch_id", "list_number", "id", T.display_filename("original_filename", "filename").alias("name"), title.alias("title"), "file_type", "file_size", "upload_time")


def checkable(drawings: DataFrame) -> DataFrame:
    """Drawings of a format that can be checked, and whether they hold text."""
    return drawings.where(F.lower("file_type").isin(T.DRAWING_SUFFIXES)).select("id", T.display_filename("original_filename", "filename").alias("name"), (F.length(T.strip(T.text("all_text"))) > 0).alias("has_ocr"), "upload_time")


def ocr_sections(drawings: DataFrame) -> DataFrame:
    """P17."""
    return drawings.select("id", "filename", *(T.text(c).alias(c) for c in ("title_text", "tech_text", "all_text")))


def latest_batch(drawings: DataFrame) -> DataFrame:
    """The batch of the highest id that has one."""
    return drawings.where(T.text("batch_id") != "").agg(F.max_by("batch_id", "id").alias("batch_id"))


def count_rows(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A6."""
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"))


def batch_status(outcomes: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per batch its progress in per cent and its status. outcomes: batch_id, ok. totals: batch_id, total, if more are to come."""
    rows = outcomes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("completed"), F.count_if("ok").alias("good"))
    rows = rows.withColumn("total", F.col("completed")) if totals is None else rows.join(totals, "batch_id")
    status = F.when(F.col("completed") < F.col("total"), "running").when(F.col("good") == F.col("completed"), "completed").when(F.col("good") > 0, "partial").otherwise("failed")
    return rows.select("batch_id", "total", "completed", F.bround(100 * F.col("completed") / F.col("total")).cast("int").alias("progress"), status.alias("status"))


def rolling_mean(durations: DataFrame, n: int = 5) -> DataFrame:
    """The mean of a mode's last n durations, each to milliseconds. durations: mode, seconds, ts, id."""
    return mean_of_last(durations, ["mode"], ["ts", "id"], F.round("seconds", 3), n, "estimate")


def run_tool(drawings: DataFrame, tool: str, **parameters) -> DataFrame:
    """The named tools list, detail, count and search; another name gives one row that says so."""
    match tool:
        case "list":
            return page(drawings, parameters.get("page", 1), parameters.get("size", PAGE_SIZE))
        case "detail":
            return lookup(drawings, int(parameters["id"]))
        case "count":
            return count_rows(drawings)
        case "search":
            return search(drawings, parameters["keyword"], parameters.get("page", 1))
    return drawings.sparkSession.createDataFrame([(False, f"unknown tool: {tool}")], "success boolean, error string")
