"""The jobs that a user runs, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bom, catalog, geometry, graph, layout, match, segments, tables, translate, verdict
from ..shared import settled


def prepare_rows(rows: DataFrame) -> DataFrame:
    """BOM rows filtered, merged, checked for conflicts and numbered. rows: check_id, drawing_id, pos, page_number, ...

    A drawing belongs to one check here; check_id is carried as part of the row.
    """
    rows = T.nfkc_rows(rows, "sequence_no", "code", "name", "note", "quantity", "raw_text")
    return bom.merge_and_validate(bom.filter_rows(rows.withColumn("issues", F.array().cast("array<string>"))))


def kit_check_all(rows: DataFrame, files: DataFrame) -> DataFrame:
    """K1: item rows of all drawings of all checks."""
    return match.build_items(prepare_rows(rows), files)


def kit_check_manual(rows: DataFrame, files: DataFrame, roots: DataFrame, extractions: DataFrame | None = None, most_depth: int = graph.MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(items, reached): items of the drawings that the roots reach by files that exist, and those drawings with their depth.

    Matching is done once for all drawings; the expansion restricts it. Items at which the expansion ends for a reason
    (a cycle, the depth limit, a table that couldn't be read) are for review and say so. Depths and marks are those of a
    walk that enters each drawing once, from the roots by id along the rows. roots: check_id, drawing_id.
    extractions: drawing_id, status, rows_count; without them every table counts as read.
    """
    items = settled(kit_check_all(rows, files).withColumn("_item", F.xxhash64("check_id", "drawing_id", "row_index")))
    exists = items.where("match_status = 'exists'").select("check_id", F.col("drawing_id").alias("parent"), F.col("_item").alias("item_id"), "row_index", F.posexplode("matches.drawing_id").alias("pos", "child"))
    # A drawing's references are followed in the order of its rows, and of the files of a row.
    matched = exists.select("check_id", "parent", "item_id", "child", (F.col("row_index").cast("long") * (1 << 20) + F.col("pos")).alias("ord"))
    own = rows.select("check_id", F.col("drawing_id").alias("child")).distinct()
    edges = settled(matched.join(own, ["check_id", "child"], "left_semi"))
    failed = None
    if extractions is not None:
        failed = graph.child_failures(matched, extractions).select("check_id", "item_id", F.lit("failed").alias("mark"))
        read = extractions.where("status in ('ok', 'partial') and rows_count > 0").select(F.col("drawing_id").alias("child"))
        edges = edges.join(read, "child", "left_semi")
    reached, marks = graph.walk(edges, roots, most_depth)
    marks = edges.join(marks, ["check_id", "parent", "child"]).select("check_id", "item_id", "mark")
    deepest = items.join(reached.where(F.col("depth") >= most_depth), ["check_id", "drawing_id"], "left_semi")
    marks = marks.unionByName(deepest.select("check_id", F.col("_item").alias("item_id"), F.lit("depth").alias("mark")))
    marks = marks if failed is None else marks.unionByName(failed)
    order = F.array(*map(F.lit, graph.MARKS))
    said = marks.groupBy("check_id", F.col("item_id").alias("_item")).agg(F.array_sort(F.collect_set(F.array_position(order, F.col("mark")))).alias("_marks"))
    names = F.array(*map(F.lit, graph.MARKS.values()))
    out = items.join(reached.select("check_id", "drawing_id"), ["check_id", "drawing_id"], "left_semi").join(said, ["check_id", "_item"], "left")
    marked = F.col("_marks").isNotNull()
    issue = T.join_issues(F.col("extraction_issue"), F.array_join(F.transform("_marks", lambda k: F.element_at(names, k.cast("int"))), "；"))
    out = out.withColumns({"extraction_issue": F.when(marked, issue).otherwise(F.col("extraction_issue")), "extraction_status": F.when(marked, "review").otherwise(F.col("extraction_status"))})
    return out.drop("_item", "_marks"), reached.withColumn("discovery", F.when(F.col("depth") == 0, "root").otherwise("reference"))


def rematch_edited(items: DataFrame, patch: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: (items, refused): items with the patch's cells, matched anew; what a row first held is kept in original.

    items: id, check_id, ... original. patch: id and any of code, name, note, quantity. Patches with an unclear code are refused.
    """
    cells = ["code", "name", "note", "quantity"]
    bad = patch.where(F.col("code").isNotNull() & ~T.is_valid_code("code")) if "code" in patch.columns else patch.limit(0)
    good = patch.join(bad.select("id"), "id", "left_anti")
    edited = items.join(good.select("id"), "id", "left_semi")
    edited = edited.withColumn("original", F.coalesce("original", F.struct(*cells)))
    edited = tables.keyed_update(edited, good, ["id"], cells)
    fresh = match.build_items(edited.drop("match_status", "matches", "candidates", "match_reason", "exempt_reason").withColumns({"extraction_status": F.lit("ok"), "extraction_issue": F.lit(""), "edited": F.lit(True)}), files)
    return items.join(good.select("id"), "id", "left_anti").unionByName(fresh.select(*items.columns)), bad


def bom_from_text(drawings: DataFrame, limit: int = 10) -> DataFrame:
    """K5: BOM rows of the drawings' full texts. drawings: id, all_text, title_text, filename."""
    lines = T.nfkc_split(bom.table_pages(settled(bom.page_lines(drawings, most_sections=limit))), "line")
    codes = drawings.select(F.col("id").alias("drawing_id"), T.drawing_code("title_text", T.display_filename("original_filename", "filename"), F.lit("")).alias("title_code"))
    return bom.merge_and_validate(bom.filter_rows(bom.lines_to_rows(lines), codes))


def bom_from_text_status(drawings: DataFrame, rows: DataFrame, pages: DataFrame, limit: int = 10) -> DataFrame:
    """F52 at the end of K5: (drawing_id, rows, valid, status). rows: bom_from_text(). pages: drawing_id, pages_total, pages_processed, focused, pages_read, issues.

    A drawing has a table if one of its pages names a column.
    """
    tables = bom.table_pages(bom.page_lines(drawings, most_sections=limit)).select("drawing_id").distinct().withColumn("has_table", F.lit(True))
    return bom.drawing_status(rows, pages.join(tables, "drawing_id", "left").fillna(False, ["has_table"]), limit)


def bom_from_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: (rows, titles) from the places of the blocks."""
    rows, heads = geometry.scan_to_bom(blocks, nfkc=True)
    codes = heads.select("drawing_id", "title_code")
    return bom.merge_and_validate(bom.filter_rows(rows.drop("x", "y", "w", "h"), codes)), heads


def segment_job(drawings: DataFrame) -> DataFrame:
    """K7."""
    return segments.segments(drawings)


def translation_queue(rows: DataFrame, translations: DataFrame, glossary: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """K8."""
    return translate.queue(rows, translations, glossary, **how)


def translation_merge(results: DataFrame, rows: DataFrame) -> DataFrame:
    """K9. rows: segments; those that mask_tokens() has masked already aren't masked anew."""
    return translate.merge_results(results, rows if "tokens" in rows.columns else translate.mask_tokens(rows))


def translation_report(rows: DataFrame, translations: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(segments with status, counts per drawing)."""
    report = translate.report(rows, translations, **how)
    return report, translate.summary(report)


def library(drawings: DataFrame, keyword: str | None = None) -> DataFrame:
    """K11."""
    return catalog.catalog(drawings if keyword is None else catalog.keyword_filter(drawings, keyword))


def layout_ingest(payloads: DataFrame, markdown: DataFrame) -> DataFrame:
    """(drawing_id, title_text, tech_text, all_text) of layout payloads and their Markdown."""
    blocks = settled(layout.layout_blocks(payloads))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "pos", "text"))), lambda x: x["text"]), "\n\n")
    titles = layout.title_tables(blocks).groupBy("drawing_id").agg(ordered.alias("title_text"))
    regions = layout.tech_regions(blocks).groupBy("drawing_id").agg(ordered.alias("_region"))
    sections = layout.tech_sections(markdown)
    out = markdown.select("drawing_id", layout.title_lines("markdown").alias("_lines"))
    for other in (titles, regions, sections, layout.all_text(blocks, markdown)):
        out = out.join(other, "drawing_id", "left")
    return out.select("drawing_id", F.coalesce("title_text", "_lines").alias("title_text"), T.text(F.coalesce("tech_text", "_region")).alias("tech_text"), "all_text")


def scan_ingest(blocks: DataFrame) -> DataFrame:
    """(drawing_id, title_text, tech_text, all_text, ...) of scanned blocks, doubles removed."""
    rows = geometry.iou_dedup(blocks)
    titles = geometry.title_regions(rows).select("drawing_id", "page", F.concat_ws("\n", "code", F.nullif("name", F.lit(""))).alias("title_text"))
    techs = geometry.tech_regions(rows).select("drawing_id", "page", F.col("text").alias("tech_text"))
    pages = geometry.reading_order(rows).select("drawing_id", "page", F.regexp_replace("text", r"^第 \d+ 页\n", "").alias("all_text"))
    pages = pages.join(titles, ["drawing_id", "page"], "left").join(techs, ["drawing_id", "page"], "left").withColumns({"layout": F.lit("unknown"), "warnings": F.array().cast("array<string>")})
    return layout.page_rollup(pages)


def kit_verdict(checks: DataFrame, check_drawings: DataFrame, items: DataFrame, drawings: DataFrame, stored: DataFrame) -> DataFrame:
    """A1 to A4 of a finished K1 or K2."""
    return verdict.check_summary(checks, check_drawings, items, drawings, stored).join(verdict.run_status(checks, check_drawings, items), "check_id")
