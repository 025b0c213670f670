"""Files, scans, glossaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import label

MOST_BYTES = 50 << 20
PNG_MAGIC = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
BLOCKS = "array<struct<page:int,text:string,bbox:array<double>,confidence:double,orientation:int>>"


def file_catalog(spark: SparkSession, path: str, *, content: bool = False) -> DataFrame:
    """Path, filename, suffix, length and time of the files below path; their bytes only on request."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", name.alias("filename"), T.file_suffix(name).alias("suffix"), "length", "modificationTime", *(["content"] if content else []))


def reject_reason() -> Column:
    """Why a row (filename, length, content) is not admitted; null if it is."""
    suffix = T.file_suffix("filename")
    return (
        F.when(~suffix.isin(T.DRAWING_SUFFIXES), "unsupported type")
        .when(F.col("length") > MOST_BYTES, "too large")
        .when(F.col("length") == 0, "empty")
        .when((suffix == ".pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF")), "not a PDF")
        .when((suffix == ".png") & (F.substring("content", 1, 8) != F.lit(PNG_MAGIC)), "not a PNG")
    )


def admission(files: DataFrame) -> DataFrame:
    """(path, accepted, reject_reason). files: path, filename, length, content."""
    return files.select("path", reject_reason().isNull().alias("accepted"), reject_reason().alias("reject_reason"))


def signature_of(version: str, model: str, page_limit: int) -> Column:
    """S4 of a row (filename, original_filename, title_text, all_text, content)."""
    nul = F.unhex(F.lit("00"))
    parts = [F.lit(version), F.lit(model), F.lit(str(page_limit)), T.text("title_text"), T.text("all_text"), T.display_filename("original_filename", "filename")]
    body = F.coalesce("content", F.encode(T.text("filename"), "UTF-8"))
    return F.sha2(F.concat(body, *(x for p in parts for x in (nul, F.encode(p, "UTF-8")))), 256)


def content_signature(drawings: DataFrame, files: DataFrame, version: str, model: str, page_limit: int) -> DataFrame:
    """(drawing_id, signature) of a drawing's bytes, texts and settings; without a file its name stands for the bytes.

    drawings: id, filename, original_filename, title_text, all_text. files: filename, content.
    """
    rows = drawings.join(files.select("filename", "content"), "filename", "left")
    return rows.select(F.col("id").alias("drawing_id"), signature_of(version, model, page_limit).alias("signature"))


def scan_signature(files: DataFrame, version: str, dpi: int, pages: int, scanner: str) -> DataFrame:
    """(filename, signature)."""
    nul = F.unhex(F.lit("00"))
    parts = [F.encode(F.lit(str(p)), "UTF-8") for p in (version, dpi, pages, scanner)]
    return files.select("filename", F.sha2(F.concat(F.encode(F.sha2("content", 256), "UTF-8"), *(x for p in parts for x in (nul, p))), 256).alias("signature"))


def glossary(spark: SparkSession, path: str, source_lang: str = "zh", target_lang: str = "en") -> DataFrame:
    """Terms of a CSV file with source, target, note; without those that lack one of the first two."""
    rows = spark.read.csv(path, header=True, schema="source string, target string, note string", enforceSchema=True, multiLine=True, escape='"')
    trimmed = rows.select(*(T.strip(T.text(c)).alias(c) for c in ("source", "target", "note"))).where("source <> '' and target <> ''")
    return trimmed.withColumns({"source_lang": F.lit(source_lang), "target_lang": F.lit(target_lang), "enabled": F.lit(True)})


def scan_blocks(scans: DataFrame) -> DataFrame:
    """One row per block of the JSON of scans (drawing_id, blocks_json); what is no JSON gives no block."""
    blocks = F.coalesce(F.from_json("blocks_json", BLOCKS), F.array().cast(BLOCKS))
    rows = scans.select("drawing_id", F.posexplode(blocks).alias("pos", "b"))
    at = lambda i: F.get("b.bbox", F.lit(i))
    return rows.select("drawing_id", F.coalesce("b.page", F.lit(1)).alias("page"), "pos", T.text("b.text").alias("text"), at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def layout_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of JSON files, each as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def save_layouts(payloads: DataFrame, path: str) -> None:
    """Raw payloads by backend. payloads: drawing_id, backend, payload."""
    payloads.write.partitionBy("backend").mode("overwrite").json(path)


def drawing_scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of drawings in the order of upload."""
    return spark.read.parquet(path).select(*columns).orderBy("upload_time", "id")


#: The header of the check's table.
KIT_HEADER = ["总成图号", "总成名称", "页码", "行号", "序号", "代号", "名称", "备注", "数量", "匹配状态", "匹配文件", "候选文件", "提取状态", "问题", "原文", "已编辑"]


def _line(*cells: Column) -> Column:
    """A CSV line; every cell safe for spreadsheets, quoted where it must be."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.array(*(quoted(T.csv_safe_strict(c)) for c in cells)), ",")


def kit_csv_lines(summary: DataFrame, items: DataFrame, issues: DataFrame) -> DataFrame:
    """(check_id, part, ord, line): header, one summary line, item lines, issue lines.

    summary: check_id and counts. items: build_items(). issues: check_id, drawing_id, issues.
    """
    blank = F.lit("")
    head = summary.select("check_id", F.lit(0).alias("part"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), F.concat(F.lit("﻿"), _line(*map(F.lit, KIT_HEADER))).alias("line"))
    said = F.concat_ws("；", *(F.concat(F.lit(n + " "), F.coalesce(c, F.lit(0)).cast("string")) for n, c in (("存在", "exists"), ("不存在", "missing"), ("待复核", "candidates"), ("免查", "exempt"))))
    total = summary.select("check_id", F.lit(1).alias("part"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), _line(F.lit("汇总"), said, *[blank] * 14).alias("line"))
    names = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast(items.schema[c].dataType)), lambda m: m["matched_filename"]), "；")
    cells = [F.col("drawing_id").cast("string"), blank, F.col("page_number").cast("string"), F.col("row_index").cast("string"), *(T.text(c) for c in ("sequence_no", "code", "name", "note", "quantity")), label("match", F.col("match_status")), names("matches"), names("candidates"), label("extraction", F.col("extraction_status")), T.text("extraction_issue"), T.text("raw_text"), F.lit("否")]
    body = items.select("check_id", F.lit(2).alias("part"), F.struct(F.col("drawing_id").cast("long").alias("a"), F.col("page_number").cast("int").alias("b"), F.col("row_index").cast("int").alias("c")).alias("ord"), _line(*cells).alias("line"))
    tail = issues.select("check_id", F.lit(3).alias("part"), F.struct(F.col("drawing_id").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), _line(F.col("drawing_id").cast("string"), *[blank] * 12, T.text("issues"), blank, blank).alias("line"))
    return head.unionByName(total).unionByName(body).unionByName(tail)


def save_lines(lines: DataFrame, path: str, key: str = "check_id") -> None:
    """Lines of each key in order as text files with CRLF ends, in a folder of its own."""
    lines.repartition(key).sortWithinPartitions(key, "part", "ord").select(key, F.col("line").alias("value")).write.partitionBy(key).mode("overwrite").option("lineSep", "\r\n").text(path)


def save_translations(rows: DataFrame, path: str) -> None:
    """Translate.csv_rows() as CSV by drawing."""
    rows.repartition("drawing_id").sortWithinPartitions("drawing_id", "序号").write.partitionBy("drawing_id").mode("overwrite").csv(path, header=True)


def ocr_text(drawings: DataFrame) -> DataFrame:
    """(drawing_id, value): the three texts of a drawing under their labels."""
    part = lambda name, c: F.concat(F.lit(f"【{name}】\n"), T.text(c))
    return drawings.select(F.col("id").alias("drawing_id"), F.concat_ws("\n\n", part("标题栏", "title_text"), part("技术要求", "tech_text"), part("全文", "all_text")).alias("value"))


def save_ocr_text(drawings: DataFrame, path: str) -> None:
    ocr_text(drawings).write.partitionBy("drawing_id").mode("overwrite").text(path)
