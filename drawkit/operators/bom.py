"""BOM rows: from text lines and model output, filtered, merged and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import once

#: Header words, patterns of header lines and page markers, and issues.
HEADER_WORDS = ["序号", "代号", "名称", "备注", "数量", "图号", "零件号", "件号", "明细", "BOM"]
HEADER_NAMES = ["序号代号名称备注数量", "序号", "代号", "名称", "备注", "数量"]
HEADER_LINE = r"^\s*(?:序号|序号\s*代号|代号|名称|备注|数量|图号)(?:\s+|$)"
PAGE_MARKER = r"(?i)^第\s*(\d+)\s*页(?:\s*/?\s*共\s*\d+\s*页)?$"
NO_CODE, BAD_CODE, NO_NAME = "代号缺失", "代号格式无法确认", "名称缺失"
INFERRED, CONFLICT = "由PDF文字层/已有OCR文本推断，备注与数量需复核", "同一序号提取到冲突内容，需人工复核"
CONTRADICTION = "模型返回了明细表行但 has_table=false，内容存在矛盾"


def page_lines(drawings: DataFrame, id_col: str = "id", text_col: str = "all_text", most_sections: int = 10) -> DataFrame:
    """(drawing_id, pos, line, page_number): a line's page is that of the last marker; page 1 before any.

    At most most_sections sections (what markers part, whatever their numbers) are kept; marker lines are not.
    """
    rows = drawings.select(F.col(id_col).alias("drawing_id"), F.posexplode(F.split(T.text(text_col), "\r\n|\r|\n")).alias("pos", "raw"))
    rows = rows.select("drawing_id", "pos", T.squeeze(F.col("raw")).alias("line"))
    rows = rows.where("line <> ''").withColumn("marker", F.nullif(F.regexp_extract("line", PAGE_MARKER, 1), F.lit("")).cast("int"))
    so_far = Window.partitionBy("drawing_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("page_number", F.coalesce(F.last("marker", ignorenulls=True).over(so_far), F.lit(1))).withColumn("section", F.count("marker").over(so_far))
    first = F.min("section").over(Window.partitionBy("drawing_id"))
    rows = rows.withColumn("first", first)
    return rows.where(F.col("marker").isNull() & (F.col("section") - F.col("first") < most_sections)).select("drawing_id", "pos", "line", "page_number")


def table_pages(lines: DataFrame) -> DataFrame:
    """The lines of pages on which some line names a column."""
    pages = lines.groupBy("drawing_id", "page_number").agg(F.bool_or(F.col("line").rlike("序号|代号|名称")).alias("has")).where("has").select("drawing_id", "page_number")
    return lines.join(pages, ["drawing_id", "page_number"], "left_semi")


def lines_to_rows(lines: DataFrame, source: str = "ocr_text") -> DataFrame:
    """BOM rows of the lines that hold a code: what stands before it is the sequence, behind it name, note and quantity.

    lines: drawing_id, pos, line, page_number. Whatever didn't come from a model is marked for review.
    """
    clean = T.clean_text("line")
    rows = lines.select("drawing_id", "pos", "page_number", clean.alias("raw_text")).where((F.col("raw_text") != "") & ~F.col("raw_text").rlike(HEADER_LINE))
    rows = once(rows.withColumn("code", F.get(T.code_tokens(F.col("raw_text")), F.lit(0)))).where(F.col("code").isNotNull())
    # The first whole run of code characters that is this token, not one inside another run.
    runs = F.concat(F.lit(" "), F.regexp_replace("raw_text", r"[^A-Za-z0-9._/\-]", " "), F.lit(" "))
    at = F.call_function("instr", runs, F.concat(F.lit(" "), F.col("code"), F.lit(" ")))
    rows = once(rows.withColumn("at", at))
    rows = rows.withColumn("before", F.btrim(F.substring("raw_text", F.lit(1), F.col("at") - 1))).withColumn("after", F.btrim(F.substring("raw_text", F.col("at") + F.length("code"), F.length("raw_text"))))
    cells = F.filter(F.transform(F.split("after", r"\t+|\s{2,}|\s*\|\s*"), lambda x: F.btrim(x)), lambda x: x != "")
    rows = once(rows.withColumn("cells", cells)).withColumn("cells", F.when(F.size("cells") == 1, F.split(F.get("cells", F.lit(0)), r"\s+")).otherwise(F.col("cells")))
    last = F.try_element_at("cells", F.lit(-1))
    counted = (F.size("cells") >= 2) & last.rlike(r"^\d+(?:\.\d+)?$")
    rows = rows.withColumn("quantity", F.when(counted, last).otherwise("")).withColumn("cells", F.when(counted, F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")))
    last = F.try_element_at("cells", F.lit(-1))
    noted = (F.size("cells") >= 1) & last.rlike("标准件|外购件|无图|备注")
    rows = rows.withColumn("note", F.when(noted, last).otherwise("")).withColumn("cells", F.when(noted, F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")))
    issues = F.array() if source == "vision" else F.array(F.lit(INFERRED))
    return once(rows).select("drawing_id", "pos", "page_number", F.regexp_extract("before", r"(\d{1,4})\s*$", 1).alias("sequence_no"), "code", F.btrim(F.array_join("cells", " ")).alias("name"), "note", "quantity", "raw_text", issues.cast("array<string>").alias("issues"))


MODEL_PAGE = "struct<has_table:string,table_kind:string,title_block_code:string,title_block_name:string,rows:array<map<string,string>>,issues:array<string>>"


def model_pages_to_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, per-page report) of the JSON that a model gave for each page.

    pages: drawing_id, page_number, payload. Tables of parts and title blocks are left out; Chinese keys count as the
    English ones; rows of a page that claims to have no table are kept and reported, rows that aren't objects reported.
    """
    page = F.from_json("payload", "has_table string, table_kind string, title_block_code string, title_block_name string, rows array<string>, issues array<string>")
    parsed = pages.select("drawing_id", "page_number", page.alias("p")).where(F.col("p").isNotNull())
    parsed = parsed.where(~F.lower(T.clean_text("p.table_kind")).isin("part_table", "title_block"))
    each = parsed.select("drawing_id", "page_number", F.posexplode_outer("p.rows").alias("pos", "raw"), F.lower(T.text("p.has_table")).alias("has_table"), "p.issues", "p.title_block_code", "p.title_block_name")
    each = each.withColumn("m", F.when(F.col("raw").rlike(r"^\s*\{"), F.from_json("raw", S.MapType(S.StringType(), S.StringType()))))
    pick = lambda *keys: T.clean_text(F.coalesce(*(F.nullif(F.element_at("m", k), F.lit("")) for k in keys)))
    rows = each.where(F.col("m").isNotNull()).select(
        "drawing_id", "page_number", (F.col("pos") + 1).alias("pos"), pick("seq", "序号").alias("sequence_no"), pick("code", "代号").alias("code"), pick("name", "名称").alias("name"),
        pick("note", "备注").alias("note"), pick("qty", "数量").alias("quantity"), pick("raw_text", "原始行文字").alias("raw_text"), F.array().cast("array<string>").alias("issues"),
    )
    report = each.groupBy("drawing_id", "page_number").agg(
        F.count("m").alias("rows"), F.count_if(F.col("raw").isNotNull() & F.col("m").isNull()).alias("bad_rows"),
        F.bool_or((F.col("has_table") == "true") | F.col("m").isNotNull()).alias("has_table"),
        F.bool_and(F.col("has_table") != "true").alias("_said_no"), F.first("issues").alias("issues"), F.first("title_block_code").alias("title_code"), F.first("title_block_name").alias("title_name"),
    )
    bad = F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.when(F.col("_said_no") & (F.col("rows") > 0), F.array(F.lit(CONTRADICTION))).otherwise(F.array().cast("array<string>")))
    return rows, report.withColumn("issues", bad).drop("_said_no")


def filter_rows(rows: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """BOM rows without headers, empty ones and the drawing's own number; status and issue of the others.

    rows: drawing_id, pos, code, name, note, quantity, raw_text, issues. codes: (drawing_id, title_code).
    """
    rows = once(rows.withColumns({c: T.clean_text(c) for c in ("code", "name", "note", "quantity", "raw_text")}))
    rows = rows.where((F.col("code") != "") | (F.col("name") != "") | (F.col("note") != ""))
    tight = F.replace("name", F.lit(" "), F.lit(""))  # cleaned texts have no other white space
    heading = F.upper(F.replace("code", F.lit(" "), F.lit(""))).isin(HEADER_WORDS) | (tight.isin(HEADER_WORDS) & (F.col("code") == "")) | (tight.isin(HEADER_NAMES) & ~T.is_valid_code("code"))
    rows = rows.where(~heading)
    if codes is not None:
        rows = rows.join(codes.select("drawing_id", T.normalize_code("title_code").alias("_own")), "drawing_id", "left")
        rows = rows.where(~((T.text("_own") != "") & (T.normalize_code("code") == F.col("_own")))).drop("_own")
    said = [F.nullif(F.col(c), F.lit("")) for c in ("code", "name", "note", "quantity")]
    found = F.array_compact(F.array(F.when(F.col("code") == "", NO_CODE).when(~T.is_valid_code("code"), BAD_CODE), F.when(F.col("name") == "", NO_NAME)))
    given = F.coalesce("issues", F.array().cast("array<string>"))
    fine = (F.size(given) == 0) & (F.col("name") != "") & T.is_valid_code("code")
    issue = F.when(fine, "").otherwise(T.distinct_issues(F.concat(given, found)))
    rows = rows.withColumn("raw_text", F.when(F.col("raw_text") == "", F.concat_ws(" ", *said)).otherwise(F.col("raw_text")))
    rows = rows.withColumn("extraction_issue", issue)
    return rows.withColumn("extraction_status", F.when(F.col("extraction_issue") == "", "ok").otherwise("review")).drop("issues")


KEY = ["sequence_no", "_code", "name", "note", "quantity"]


def merge_duplicates(rows: DataFrame) -> DataFrame:
    """Rows that say the same become the first of them, with the pages of all (page 0 left out)."""
    keyed = rows.withColumn("sequence_no", T.clean_text("sequence_no")).withColumn("_code", T.normalize_code("code"))
    rest = [c for c in rows.columns if c not in ("drawing_id", "sequence_no", "name", "note", "quantity")]
    # Aggregates of whole rows would sort them for each of two steps; both windows and flag_conflicts() share one sort.
    same = Window.partitionBy("drawing_id", *KEY)
    first = keyed.withColumn("_n", F.row_number().over(same.orderBy("page_number", "pos")))
    out = first.withColumn("pages", F.sort_array(F.collect_set(F.when(F.col("page_number") > 0, F.col("page_number"))).over(same))).where("_n = 1")
    return out.select("drawing_id", "sequence_no", "name", "note", "quantity", *rest, "pages")


def flag_conflicts(rows: DataFrame) -> DataFrame:
    """Rows of one sequence number that name different things are all for review."""
    same = Window.partitionBy("drawing_id", "sequence_no")
    what = F.struct(T.normalize_code("code"), F.col("name"))
    rows = rows.withColumn("_what", what)
    clash = (F.col("sequence_no") != "") & (F.min("_what").over(same) != F.max("_what").over(same))
    rows = rows.withColumn("_clash", clash)
    rows = rows.withColumn("extraction_status", F.when(F.col("_clash"), "review").otherwise(F.col("extraction_status")))
    return rows.withColumn("extraction_issue", F.when(F.col("_clash"), T.join_issues(F.col("extraction_issue"), F.lit(CONFLICT))).otherwise(F.col("extraction_issue"))).drop("_what", "_clash")


def reindex(rows: DataFrame) -> DataFrame:
    """row_index 1..n in the order of page and position."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy("drawing_id").orderBy("page_number", "pos")))


def merge_and_validate(rows: DataFrame) -> DataFrame:
    """A8, A9 and W3. All three are per drawing, so the rows are dealt by their drawing once."""
    return reindex(flag_conflicts(merge_duplicates(rows.repartition("drawing_id"))))


def coalesce_sources(primary: DataFrame, base: DataFrame) -> DataFrame:
    """Primary rows with their empty cells filled from the base row of the same code, else of the same name.

    Of base rows with one key the last counts. Both tables go side by side through windows within their drawing, so rows
    that come dealt by drawing aren't shuffled again.
    """
    fields = ["sequence_no", "name", "note", "quantity"]
    keyed = lambda rows: rows.withColumns({"_code": T.normalize_code("code"), "_name": T.clean_text("name")})
    given = keyed(base).select("drawing_id", "_code", "_name", F.struct("page_number", "pos").alias("_at"), F.struct(*fields).alias("_cells"))
    both = keyed(primary).withColumn("_own", F.lit(True)).unionByName(given, allowMissingColumns=True)
    last = lambda key: F.when(F.col("drawing_id").isNotNull() & (F.col(key) != ""), F.max_by("_cells", "_at").over(Window.partitionBy("drawing_id", key)))
    rows = both.withColumns({"_code_row": last("_code"), "_name_row": last("_name")}).where("_own")
    found = F.coalesce("_code_row", "_name_row")
    filled = {f: F.coalesce(F.nullif(T.clean_text(f), F.lit("")), found[f], F.lit("")) for f in fields}
    return rows.withColumns(filled).select(*primary.columns)


def prefer_first_source(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """U8: per drawing the rows of the best-ranked source that has any. rows: drawing_id, source."""
    rank = F.coalesce(*(F.when(F.col("source") == s, r) for s, r in ranks.items()), F.lit(len(ranks) + 1))
    rows = rows.withColumn("_rank", rank)
    best = rows.groupBy("drawing_id").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["drawing_id", "_rank"], "left_semi").drop("_rank")


def extraction_status(rows: Column, valid: Column, has_table: Column, total: Column, processed: Column, limit: Column, focused: Column, read: Column, issues: Column) -> Column:
    """ok, partial, no_table or failed; the first rule that holds. rows, valid, issues, read: counts; focused: a model is set up."""
    short = (total > processed) | (issues > 0)
    base = F.when(valid > 0, F.when(short, "partial").otherwise("ok")).when(has_table, "failed").when(short, "partial").otherwise("no_table")
    base = F.when((base == "ok") & (rows > valid), "partial").otherwise(base)
    base = F.when((base == "no_table") & (total > limit), "partial").when((base == "ok") & (total > processed), "partial").otherwise(base)
    return F.when((rows > 0) & (valid == 0), "failed").when((valid == 0) & focused & (read == 0), "failed").when((valid == 0) & ~focused, "failed").otherwise(base)


def drawing_status(rows: DataFrame, pages: DataFrame, limit: int = 10) -> DataFrame:
    """F52 per drawing. rows: merged BOM rows. pages: drawing_id, pages_total, pages_processed, has_table, focused, pages_read, issues (count)."""
    counts = rows.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(T.is_valid_code("code")).alias("valid"))
    out = pages.join(counts, "drawing_id", "left").fillna(0, ["rows", "valid"])
    status = extraction_status(F.col("rows"), F.col("valid"), F.col("has_table"), F.col("pages_total"), F.least("pages_total", "pages_processed"), F.lit(limit), F.col("focused"), F.col("pages_read"), F.col("issues"))
    return out.select("drawing_id", "rows", "valid", status.alias("status"))
