"""Matching BOM rows with the files of a check's selection.

A row matches a file by its whole stem, so the match is an equi-join on (check, key form), and a candidate is an
equi-join on (check, a prefix of the stem). No row meets a file that it has no key in common with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import settled

#: Reasons.
REASONS = {
    "exists": "匹配到完整代号/代号-名称文件名", "candidate": "只找到同代号但名称不一致的文件，需人工复核", "missing": "本次导入集合中没有符合命名规则的文件",
    "unchecked": "代号缺失或格式无法确认", "temp": "临时文件", "model": "模型文件，不作为工程图", "native": "SolidWorks/DWG 原生图纸未导入，当前版本不参与匹配", "other": "非工程图文件",
    "note": "备注含豁免关键词但语义不明确，需人工确认", "code": "代号不可确认，未执行存在/不存在判定",
}
SEPARATORS = ["-", "_", " "]


def file_view(files: DataFrame, name: str = "original_filename") -> DataFrame:
    """Files (check_id, drawing_id, name) with stem, suffix, kind and, for files that can't match, the reason."""
    files = T.nfkc_rows(files.withColumn("_shown", F.col(name)), name)
    clean = T.clean_text(name)
    view = files.where(clean != "").select("check_id", "drawing_id", F.col("_shown").alias("original_filename"), clean.alias("matched_filename"), T.is_temp_file(name).alias("temp"), T.casefold(T.clean_text(T.file_stem(name))).alias("stem"), T.file_suffix(name).alias("suffix"))
    kind = F.when(F.col("temp"), "temp").otherwise(T.suffix_class(F.col("suffix")))
    reason = F.coalesce(*(F.when(F.col("kind") == k, REASONS[k]) for k in ("temp", "model", "native", "other")))
    return view.withColumn("kind", kind).withColumn("ignored_reason", reason)


def code_keys(rows: DataFrame) -> DataFrame:
    """The distinct (check_id, code_cmp, name_cmp) that rows ask for; many rows ask for the same part."""
    return rows.select("check_id", "code_cmp", "name_cmp").where("code_cmp <> ''").distinct()


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with checked_code and checked_name, and both in the form that is compared."""
    rows = rows.withColumns({"checked_code": T.normalize_code("code"), "checked_name": T.normalize_name("name")})
    return rows.withColumns({"code_cmp": T.casefold(F.col("checked_code")), "name_cmp": T.casefold(F.col("checked_name"))})


def exact_matches(keys: DataFrame, view: DataFrame) -> DataFrame:
    """(check_id, code_cmp, name_cmp, drawing_id, matched_filename, match_form). keys: code_keys()."""
    named = F.when(F.col("name_cmp") != "", F.array(*(F.struct(F.concat("code_cmp", F.lit(s), "name_cmp").alias("stem"), F.lit(f"code{s}name").alias("match_form")) for s in SEPARATORS)))
    forms = F.concat(F.array(F.struct(F.col("code_cmp").alias("stem"), F.lit("code").alias("match_form"))), F.coalesce(named, F.array().cast("array<struct<stem:string,match_form:string>>")))
    asked = keys.select("*", F.inline(forms))
    return asked.join(view.where("kind = 'drawing'"), ["check_id", "stem"]).select("check_id", "code_cmp", "name_cmp", "drawing_id", "matched_filename", "match_form")


def stem_prefixes(stem: Column) -> Column:
    """The parts of a stem before each separator that has something behind it."""
    at = F.filter(F.sequence(F.lit(1), F.length(stem)), lambda i: F.substring(stem, i, F.lit(1)).isin(SEPARATORS) & (i < F.length(stem)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(stem, F.lit(1), i - 1)))


def candidate_matches(keys: DataFrame, view: DataFrame, exact: DataFrame) -> DataFrame:
    """(check_id, code_cmp, name_cmp, drawing_id, matched_filename): same code, another name."""
    prefixed = view.where("kind = 'drawing'").select("check_id", "drawing_id", "matched_filename", F.explode(stem_prefixes(F.col("stem"))).alias("code_cmp"))
    pairs = keys.join(prefixed, ["check_id", "code_cmp"])
    return pairs.join(exact, ["check_id", "code_cmp", "name_cmp", "drawing_id", "matched_filename"], "left_anti").select("check_id", "code_cmp", "name_cmp", "drawing_id", "matched_filename")


def ignored_files(view: DataFrame) -> DataFrame:
    """One row per check: ignored, array of (drawing_id, matched_filename, reason), and ignored_reasons."""
    rows = view.where("kind <> 'drawing'")
    listed = F.array_sort(F.collect_list(F.struct("drawing_id", "matched_filename", F.col("ignored_reason").alias("reason"))))
    return rows.groupBy("check_id").agg(listed.alias("ignored"), F.array_join(F.array_sort(F.collect_set("ignored_reason")), "；").alias("ignored_reasons"))


def match_status(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (check_id, code, name, ...) with match_status, matches, candidates and match_reason.

    Lists are in the order of (drawing_id, file name) (T9). Rows without a code are unchecked. The rows are settled before
    they are matched, so that what they come from is worked out once.
    """
    view = file_view(files)
    rows = settled(with_keys(rows))
    keys = settled(code_keys(rows))
    exact = settled(exact_matches(keys, view))
    candidates = candidate_matches(keys, view, exact)
    found = exact.groupBy("check_id", "code_cmp", "name_cmp").agg(F.array_sort(F.collect_list(F.struct("drawing_id", "matched_filename", "match_form"))).alias("matches"))
    maybe = candidates.groupBy("check_id", "code_cmp", "name_cmp").agg(F.array_sort(F.collect_list(F.struct("drawing_id", "matched_filename"))).alias("candidates"))
    on = ["check_id", "code_cmp", "name_cmp"]
    verdict = keys.join(found, on, "left").join(maybe, on, "left")
    out = rows.join(verdict, on, "left")
    status = F.when(F.col("code_cmp") == "", "unchecked").when(F.col("matches").isNotNull(), "exists").when(F.col("candidates").isNotNull(), "candidate").otherwise("missing")
    out = out.withColumn("match_status", status)
    more = F.when(F.col("matches").isNotNull() & F.col("candidates").isNotNull(), "；另有候选文件").otherwise("")
    reason = F.coalesce(*(F.when(F.col("match_status") == k, REASONS[k]) for k in ("exists", "candidate", "missing", "unchecked")))
    return out.withColumn("match_reason", F.concat(reason, more)).drop("code_cmp", "name_cmp")


def build_items(rows: DataFrame, files: DataFrame) -> DataFrame:
    """item rows. An unclear code beats an exemption, and only a clean extraction can be exempt.

    rows: check_id, drawing_id, code, name, note, extraction_status, extraction_issue and what else they have.
    """
    note = T.classify_note("note")
    rows = rows.withColumn("_note", note).withColumn("_valid", T.is_valid_code("code"))
    status = F.when(F.col("_note.review") | ~F.col("_valid"), "review").otherwise(F.coalesce("extraction_status", F.lit("ok")))
    rows = rows.withColumn("extraction_status", status)
    issue = T.join_issues(T.text("extraction_issue"), F.when(F.col("_note.review"), REASONS["note"]), F.when(~F.col("_valid"), REASONS["code"]))
    rows = rows.withColumn("extraction_issue", issue).withColumn("_exempt", F.col("_valid") & F.col("_note.exempt") & (F.col("extraction_status") == "ok"))
    # Only rows that are looked up take part in the joins' keys.
    looked = F.col("_valid") & ~F.col("_exempt")
    keyed = rows.withColumn("_code", F.col("code")).withColumn("code", F.when(looked, F.col("code")).otherwise(""))
    out = match_status(keyed, files).withColumn("code", F.col("_code")).drop("_code")
    out = out.withColumn("match_status", F.when(F.col("_exempt"), "exempt").otherwise(F.col("match_status")))
    out = out.withColumn("match_reason", F.when(F.col("_exempt"), F.col("_note.reason")).otherwise(F.col("match_reason")))
    out = out.withColumn("exempt_reason", F.when(F.col("_exempt"), F.col("_note.reason")))
    is_candidate = F.col("match_status") == "candidate"
    # One row per check: the list of ignored files is joined, not crossed with the items. Settled, Spark sees how small it
    # is and doesn't shuffle the items by their check.
    out = out.join(settled(ignored_files(file_view(files)).select("check_id", "ignored_reasons")), "check_id", "left")
    shown = (F.col("match_status") == "missing") & ~F.col("_note.exempt")
    out = out.withColumn("extraction_issue", T.join_issues(F.col("extraction_issue"), F.when(is_candidate, REASONS["candidate"]), F.when(shown, F.col("ignored_reasons"))))
    out = out.withColumn("extraction_status", F.when(is_candidate, "review").otherwise(F.col("extraction_status")))
    return out.drop("_note", "_valid", "_exempt", "ignored_reasons", "checked_code", "checked_name")


def candidate_display(candidates: Column) -> Column:
    """F53."""
    return F.array_join(F.transform(candidates, lambda c: c["matched_filename"]), "；")


def match_links(matches: Column) -> Column:
    """matches with preview and file addresses."""
    return F.transform(matches, lambda m: F.struct(m["drawing_id"].alias("drawing_id"), m["matched_filename"].alias("matched_filename"), F.concat(F.lit("/drawings/"), m["drawing_id"].cast("string"), F.lit("/preview")).alias("preview_url"), F.concat(F.lit("/uploads/"), T.url_quote(m["matched_filename"])).alias("file_url")))


def needs_review() -> Column:
    """Not exempt, and the extraction or the match is unclear."""
    return F.col("exempt_reason").isNull() & ((F.col("extraction_status") != "ok") | F.col("match_status").isin("candidate", "unchecked"))
