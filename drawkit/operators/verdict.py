"""Verdicts on checks: counts, completeness, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import label
from ..shared import settled
from .match import needs_review

#: Request errors.
MOST_DRAWINGS = 200


def item_counts():
    """The counts of A1 and A2 over item rows."""
    open_ = F.col("exempt_reason").isNull()
    by = [F.count_if(open_ & (F.col("match_status") == s)).alias(n) for s, n in (("exists", "exists"), ("missing", "missing"), ("candidate", "candidates"), ("unchecked", "unchecked"))]
    return [*by, F.count_if(~open_).alias("exempt"), F.count_if(needs_review()).alias("review_items")]


def group_counts(items: DataFrame) -> DataFrame:
    """A2: counts per (check_id, drawing_id)."""
    return items.groupBy("check_id", "drawing_id").agg(F.count(F.lit(1)).alias("items"), *item_counts())


def missing_selected(checks: DataFrame, drawings: DataFrame) -> DataFrame:
    """(check_id, drawing_id) selected, but gone from the drawings."""
    return checks.select("check_id", F.explode("drawing_ids").alias("drawing_id")).join(drawings.select(F.col("id").alias("drawing_id")), "drawing_id", "left_anti").select("check_id", "drawing_id")


def missing_files(checks: DataFrame, drawings: DataFrame, stored: DataFrame) -> DataFrame:
    """(check_id, drawing_id) whose row is there and whose file is not. stored: filename of S1."""
    lost = drawings.join(stored.select("filename"), "filename", "left_anti").select(F.col("id").alias("drawing_id"))
    return checks.select("check_id", F.explode("drawing_ids").alias("drawing_id")).join(lost, "drawing_id").select("check_id", "drawing_id")


def unprocessed_selected(checks: DataFrame, check_drawings: DataFrame) -> DataFrame:
    """(check_id, drawing_id) selected by a finished check of all drawings, but without a result."""
    done = checks.where("mode = 'all' and status in ('completed', 'partial', 'failed')")
    return done.select("check_id", F.explode("drawing_ids").alias("drawing_id")).join(check_drawings.select("check_id", "drawing_id"), ["check_id", "drawing_id"], "left_anti")


def relevant_ids(checks: DataFrame, check_drawings: DataFrame) -> DataFrame:
    """What is reconciled: all selected drawings, or for a manual check its roots and what it recorded."""
    own = checks.where("mode <> 'manual'").select("check_id", F.explode("drawing_ids").alias("drawing_id"))
    roots = checks.where("mode = 'manual'").select("check_id", F.explode("root_drawing_ids").alias("drawing_id"))
    recorded = check_drawings.join(checks.where("mode = 'manual'").select("check_id"), "check_id", "left_semi").select("check_id", "drawing_id")
    return own.unionByName(roots).unionByName(recorded).distinct()


def visible_groups(check_drawings: DataFrame, items: DataFrame, drawings: DataFrame) -> DataFrame:
    """P10: groups whose drawing is still there, with a usable status and items."""
    kept = check_drawings.where(F.col("status").isin("processed", "partial", "failed"))
    return kept.join(drawings.select(F.col("id").alias("drawing_id")), "drawing_id", "left_semi").join(items.select("check_id", "drawing_id"), ["check_id", "drawing_id"], "left_semi")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("check_id").agg(F.count(F.lit(1)).alias(name))


def check_summary(checks: DataFrame, check_drawings: DataFrame, items: DataFrame, drawings: DataFrame, stored: DataFrame) -> DataFrame:
    """A1 and A3: one row per check with all counts, complete and all_present.

    Items are counted by drawing once; what is shown of a check is the sum over its groups.
    """
    counted = settled(items.groupBy("check_id", "drawing_id").agg(*item_counts()))
    groups = settled(visible_groups(check_drawings, counted, drawings))
    shown = counted.join(groups.select("check_id", "drawing_id"), ["check_id", "drawing_id"], "left_semi")
    empty = check_drawings.where("status = 'processed'").join(groups, ["check_id", "drawing_id"], "left_anti")
    counts = [
        shown.groupBy("check_id").agg(*(F.sum(c).alias(c) for c in shown.columns if c not in ("check_id", "drawing_id"))),
        _count(groups, "assemblies"),
        _count(check_drawings.where("status in ('failed', 'partial')"), "_bad"),
        _count(empty, "empty_processed_drawings"),
        _count(check_drawings.where("status = 'no_table'"), "no_table_drawings"),
        _count(missing_selected(checks, drawings), "missing_selected_files"),
        _count(missing_files(checks, drawings, stored), "missing_files"),
        _count(unprocessed_selected(checks, check_drawings), "unprocessed_selected_drawings"),
    ]
    out = checks.select("check_id", "status", F.size("drawing_ids").cast("long").alias("selected_files"))
    for c in counts:
        out = out.join(c, "check_id", "left")
    out = out.fillna(0)
    out = out.withColumn("issue_drawings", F.col("_bad") + F.col("empty_processed_drawings")).drop("_bad")
    out = out.withColumn("review_total", F.col("review_items") + F.col("issue_drawings") + F.col("missing_selected_files") + F.col("missing_files") + F.col("unprocessed_selected_drawings"))
    whole = (F.col("missing_selected_files") + F.col("missing_files") + F.col("unprocessed_selected_drawings") + F.col("empty_processed_drawings")) == 0
    out = out.withColumn("complete", (F.col("status") == "completed") & whole)
    clear = (F.col("missing") + F.col("candidates") + F.col("unchecked") + F.col("review_items") + F.col("issue_drawings")) == 0
    return out.withColumn("all_present", F.col("complete") & (F.col("assemblies") > 0) & clear)


def run_status(checks: DataFrame, check_drawings: DataFrame, items: DataFrame) -> DataFrame:
    """A4: (check_id, run_status): failed with a fatal error and no group; partial with any trouble; else completed."""
    groups = _count(items.select("check_id", "drawing_id").distinct(), "groups")
    bad = check_drawings.groupBy("check_id").agg(F.bool_or(F.col("status").isin("failed", "partial")).alias("bad"))
    roots = checks.where("mode = 'manual'").select("check_id", F.explode("root_drawing_ids").alias("drawing_id"))
    seen = check_drawings.where("status = 'processed'").select("check_id", "drawing_id")
    unseen = _count(roots.join(seen, ["check_id", "drawing_id"], "left_anti"), "unseen")
    out = checks.join(groups, "check_id", "left").join(bad, "check_id", "left").join(unseen, "check_id", "left")
    fatal = T.text("error") != ""
    status = F.when(fatal & F.col("groups").isNull(), "failed").when(fatal | F.coalesce("bad", F.lit(False)) | F.col("unseen").isNotNull(), "partial").otherwise("completed")
    return out.select("check_id", status.alias("run_status"))


#: Producers of drawing issues, the more important first.
ISSUE_ORDER = ["failed", "partial", "root_no_table", "empty", "file_missing", "unprocessed", "deleted"]


def merge_drawing_issues(issues: DataFrame) -> DataFrame:
    """One row per (check_id, drawing_id): the kind of the first producer, and the distinct messages in order.

    issues: check_id, drawing_id, kind, messages.
    """
    rank = F.array_position(F.array(*map(F.lit, ISSUE_ORDER)), F.col("kind"))
    rows = issues.withColumn("rank", rank)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "messages")))
    return rows.groupBy("check_id", "drawing_id").agg(F.min_by("kind", "rank").alias("kind"), F.array_join(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["messages"]))), "；").alias("issues"))


def parent_references(check_drawings: DataFrame, items: DataFrame) -> DataFrame:
    """Per (check_id, drawing_id) the items and drawings that refer to it, in order. items: id, drawing_id, code."""
    refs = check_drawings.select("check_id", "drawing_id", F.posexplode("parent_item_ids").alias("pos", "item_id"))
    named = refs.join(items.select(F.col("id").alias("item_id"), F.col("drawing_id").alias("parent_id"), "code"), "item_id")
    return named.groupBy("check_id", "drawing_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "parent_id", "code"))).alias("parents"))


def retry_plan(checks: DataFrame, check_drawings: DataFrame, items: DataFrame) -> DataFrame:
    """Per finished check the drawings to extract anew, or why it can't be retried."""
    edited = items.groupBy("check_id").agg(F.bool_or("edited").alias("edited"))
    bad = check_drawings.groupBy("check_id").agg(F.array_sort(F.collect_list(F.when(F.col("status").isin("failed", "partial"), F.col("drawing_id")))).alias("force_ids"))
    out = checks.join(edited, "check_id", "left").join(bad, "check_id", "left").withColumn("force_ids", F.coalesce("force_ids", F.array().cast("array<bigint>")))
    why = F.when(~F.col("status").isin("completed", "partial", "failed"), "running").when(F.coalesce("edited", F.lit(False)), "edited").when(F.size("force_ids") == 0, "nothing to retry")
    return out.select("check_id", why.alias("blocked"), F.when(why.isNull(), F.col("force_ids")).alias("force_ids"))


def validate_requests(requests: DataFrame, drawings: DataFrame) -> DataFrame:
    """(check_id, drawing_ids, root_drawing_ids, error): ids once each in order; error of the first broken rule.

    requests: check_id, mode, drawing_ids, root_drawing_ids. drawings: id, file_type.
    """
    ids, roots = F.array_distinct(F.coalesce("drawing_ids", F.array().cast("array<bigint>"))), F.array_distinct(F.coalesce("root_drawing_ids", F.array().cast("array<bigint>")))
    rows = requests.select("check_id", "mode", ids.alias("drawing_ids"), roots.alias("root_drawing_ids"))
    each = rows.select("check_id", F.explode("drawing_ids").alias("drawing_id")).join(drawings.select(F.col("id").alias("drawing_id"), "file_type"), "drawing_id", "left")
    state = each.groupBy("check_id").agg(F.array_sort(F.collect_list(F.when(F.col("file_type").isNull(), F.col("drawing_id")))).alias("gone"), F.array_sort(F.collect_list(F.when(~F.lower("file_type").isin(T.DRAWING_SUFFIXES), F.col("drawing_id")))).alias("odd"))
    out = rows.join(state, "check_id", "left")
    error = (
        F.when(~F.coalesce(F.col("mode").isin("all", "manual"), F.lit(False)), "mode")
        .when(F.size("drawing_ids") == 0, "empty")
        .when(F.size("drawing_ids") > MOST_DRAWINGS, "too many")
        .when((F.col("mode") == "manual") & (F.size("root_drawing_ids") == 0), "no root")
        .when(F.size(F.array_except("root_drawing_ids", "drawing_ids")) > 0, "root outside")
        .when(F.size("gone") > 0, F.concat(F.lit("deleted: "), F.array_join("gone", ", ")))
        .when(F.size("odd") > 0, F.concat(F.lit("unsupported: "), F.array_join("odd", ", ")))
    )
    return out.select("check_id", "drawing_ids", "root_drawing_ids", error.alias("error"))


def run_progress(checks: DataFrame, visits: DataFrame) -> DataFrame:
    """(check_id, processed_drawings, current_step)."""
    seen = visits.groupBy("check_id").agg(F.count_distinct("drawing_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return checks.join(seen, "check_id", "left").select("check_id", F.least(n, F.size("drawing_ids")).cast("long").alias("processed_drawings"), F.concat(F.lit("已检查 "), n.cast("string"), F.lit(" 张图纸")).alias("current_step"))


def status_view(checks: DataFrame) -> DataFrame:
    """Check headers with labels and no null in what is shown."""
    return checks.select("check_id", "mode", label("mode", F.col("mode")).alias("mode_label"), "status", F.coalesce("processed_drawings", F.lit(0)).alias("processed_drawings"), F.size("drawing_ids").alias("total_drawings"), T.text("current_step").alias("current_step"), T.text("error").alias("error"))


def recorded_status(extractions: DataFrame) -> DataFrame:
    """Section 2.11: what a drawing's extraction is recorded as. extractions: check_id, drawing_id, status, rows_count, issues."""
    blank = (F.col("status") == "ok") & (F.col("rows_count") == 0)
    status = F.when(blank, "failed").when(F.col("status") == "ok", "processed").otherwise(F.coalesce("status", F.lit("failed")))
    return extractions.withColumn("issues", F.when(blank, F.concat("issues", F.array(F.lit("提取标记成功但没有明细表行，未形成检查结果")))).otherwise(F.col("issues"))).withColumn("status", status)
