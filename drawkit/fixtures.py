"""Drawing tables derived from the generic test tables, in Spark and (SQL below) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECKS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_code(key) -> F.Column:
    return F.concat(F.lit("PT."), F.lpad(key.cast("string"), 7, "0"))


def bom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, drawing_id, pos, page_number, sequence_no, code, name, note, quantity, raw_text."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    note = F.when(F.col("l_returnflag") == "R", "标准件").when(F.col("l_returnflag") == "A", "非标准件").otherwise("")
    # Numbered before anything is named: else the window's shuffle has the texts too, and isn't seen as one by drawing.
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("pos", F.row_number().over(order))
    return rows.select(
        (F.col("l_orderkey") % CHECKS).alias("check_id"),
        F.col("l_orderkey").alias("drawing_id"),
        "pos",
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("page_number"),
        F.col("l_linenumber").cast("string").alias("sequence_no"),
        part_code(F.col("l_partkey")).alias("code"),
        F.col("p_name").alias("name"),
        note.alias("note"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.lit("").alias("raw_text"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, drawing_id, original_filename: every part's file in the selection of each check."""
    k, code, name = F.col("p_partkey"), part_code(F.col("p_partkey")), F.col("p_name")
    filename = (
        F.when(k % 7 == 0, F.concat(code, F.lit(".pdf")))
        .when(k % 7 == 1, F.concat(code, F.lit("-"), name, F.lit(".PDF")))
        .when(k % 7 == 2, F.concat(code, F.lit("_"), name, F.lit(".tif")))
        .when(k % 7 == 3, F.concat(code, F.lit(" other.png")))
        .when(k % 7 == 4, F.concat(code, F.lit("-"), name, F.lit(".sldprt")))
        .when(k % 7 == 5, F.concat(F.lit("~$"), code, F.lit(".pdf")))
    )
    own = table(spark, sf_dir, "part").select(k.alias("drawing_id"), filename.alias("original_filename")).where(F.col("original_filename").isNotNull())
    return own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CHECKS - 1).cast("long"))).alias("check_id"), "drawing_id", "original_filename")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, parent, child: a binary tree of parts with back edges at every eleventh."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    n = parts.agg((F.max("k") + 1).alias("n"))
    kids = parts.crossJoin(F.broadcast(n)).select("k", F.explode(F.filter(F.array(F.col("k") * 2 + 1, F.col("k") * 2 + 2), lambda c: c < F.col("n"))).alias("child"))
    back = parts.where("k % 11 = 0 and k > 0").select("k", F.floor(F.col("k") / 3).cast("long").alias("child"))
    return kids.unionByName(back).select(F.lit(0).cast("long").alias("check_id"), F.col("k").alias("parent"), "child")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, filename, original_filename, file_type, file_size, upload_time, title_text, tech_text, all_text, batch_id."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id % 1000 as int))")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("20240101000000_000000_doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("original_filename"),
        F.lit(".pdf").alias("file_type"), F.col("n_chars").alias("file_size"), at.alias("upload_time"),
        F.lit("").alias("title_text"), F.lit("").alias("tech_text"), F.col("text").alias("all_text"), F.col("source").alias("batch_id"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, drawing_id, ordinal, source_text, source_hash: the lines of each document that hold anything."""
    line = F.btrim("line", F.lit(" \t\r\n"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("drawing_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return rows.where(line != "").select((F.col("drawing_id") * 100_000 + F.col("ordinal")).alias("id"), "drawing_id", "ordinal", line.alias("source_text"), F.sha2(line, 256).alias("source_hash"), (F.col("ordinal") % 4 > 0).alias("translatable"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, target_lang, provider, model, translated_text, status, source_hash, glossary_hash, input_tokens, output_tokens."""
    own = segments(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("drawing_id") == F.col("doc_id"))
    status = F.when(F.col("ordinal") % 5 == 0, "failed").when(F.col("quality") == 1, "translated").otherwise("needs_review")
    return own.select(
        F.col("id").alias("segment_id"), F.lit("en").alias("target_lang"), F.lit("p").alias("provider"), F.lit("m1").alias("model"), F.upper("source_text").alias("translated_text"),
        status.alias("status"), F.when(F.col("toxic") == 1, "changed").otherwise(F.col("source_hash")).alias("source_hash"), F.lit("g1").alias("glossary_hash"),
        F.length("source_text").alias("input_tokens"), (F.col("ordinal") + 1).alias("output_tokens"),
    )


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: the first two words of each benchmark item."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("source"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("target"), F.lit(True).alias("enabled"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, filename, ok, error, ts."""
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), ok.alias("ok"), F.when(~ok, "bad file").alias("error"), "ts")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, text, x, y, w, h, confidence, from events."""
    m = F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"),
        (m % 40 / 50).alias("x"), (F.floor(m / 40) / 30).alias("y"), F.lit(0.04).alias("w"), F.lit(0.05).alias("h"), (m / 1000).alias("confidence"),
    )


#: The same tables as DuckDB common table expressions, each built on the raw tables alone.
SQL = {
    "bom_rows": f"""bom_rows as (select l_orderkey % {CHECKS} as check_id, l_orderkey as drawing_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as pos,
  l_linenumber % 2 + 1 as page_number, cast(l_linenumber as varchar) as sequence_no, 'PT.' || lpad(cast(l_partkey as varchar), 7, '0') as code, p_name as name,
  case l_returnflag when 'R' then '标准件' when 'A' then '非标准件' else '' end as note, cast(cast(trunc(l_quantity) as int) as varchar) as quantity
  from lineitem join part on l_partkey = p_partkey)""",
    "files": f"""files as (select check_id, drawing_id, original_filename from (select p_partkey as drawing_id, 'PT.' || lpad(cast(p_partkey as varchar), 7, '0') as c, case p_partkey % 7
  when 0 then c || '.pdf' when 1 then c || '-' || p_name || '.PDF' when 2 then c || '_' || p_name || '.tif' when 3 then c || ' other.png' when 4 then c || '-' || p_name || '.sldprt' when 5 then '~$' || c || '.pdf' end as original_filename
  from part), (select unnest(range(0, {CHECKS})) as check_id) where original_filename is not null)""",
    "edges": """edges as (select 0::bigint as check_id, k as parent, child from (select p_partkey as k, unnest([2 * p_partkey + 1, 2 * p_partkey + 2]) as child from part) where child < (select max(p_partkey) + 1 from part)
  union all select 0, p_partkey, p_partkey // 3 from part where p_partkey % 11 = 0 and p_partkey > 0)""",
    "drawings": """drawings as (select doc_id as id, '20240101000000_000000_doc_' || doc_id || '.pdf' as filename, case when doc_id % 3 > 0 then 'doc-' || doc_id || '.pdf' end as original_filename,
  '.pdf' as file_type, n_chars as file_size, timestamp '2024-01-01' + interval 1 second * (doc_id % 1000) as upload_time, text as all_text, source as batch_id from documents)""",
    "segments": """segments as (select drawing_id * 100000 + ordinal as id, drawing_id, ordinal, trim(line, E' \\t\\r\\n') as source_text, sha256(trim(line, E' \\t\\r\\n')) as source_hash, ordinal % 4 > 0 as translatable
  from (select doc_id as drawing_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ordinal from documents) where trim(line, E' \\t\\r\\n') <> '')""",
    "translations": """translations as (select id as segment_id, 'en' as target_lang, 'p' as provider, 'm1' as model, case when ordinal % 5 = 0 then 'failed' when quality = 1 then 'translated' else 'needs_review' end as status,
  case when toxic = 1 then 'changed' else source_hash end as source_hash, 'g1' as glossary_hash, length(source_text) as input_tokens, ordinal + 1 as output_tokens from segments join labels on drawing_id = doc_id)""",
    "glossary": """glossary as (select string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] as source, 'T' || item_id as target from benchmark)""",
    "outcomes": """outcomes as (select user_id as batch_id, 'f' || event_id as filename, event_type <> 'error' as ok, case when event_type = 'error' then 'bad file' end as error, ts from events)""",
    "boxes": """boxes as (select user_id as page, event_id as pos, event_type as text, (event_id % 1000) % 40 / 50.0::double as x, floor((event_id % 1000) / 40.0) / 30 as y, 0.04::double as w, 0.05::double as h, (event_id % 1000) / 1000.0::double as confidence from events)""",
}


def ctes(*names: str) -> str:
    return "with recursive " + ",\n".join(SQL[n] for n in names)
