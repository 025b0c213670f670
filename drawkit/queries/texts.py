"""Text functions, lines, segments, tokens and chunks over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..functions import tokens as E
from ..operators import bom, layout, segments, translate
from ..plans import jobs
from ..shared import settled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


P = "select p_partkey as id, 'PT.' || lpad(cast(p_partkey as varchar), 7, '0') as code, p_name as name from part"


def parts(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), X.part_code(F.col("p_partkey")).alias("code"), F.col("p_name").alias("name"))


@query(f"with p as ({P}) select id, code as bare, upper(code) as upper, name as clean, true as valid from p")
def f2_strip_code_boundary(spark, sf_dir):
    """Codes with wide letters, punctuation and a suffix around them."""
    dirty = F.concat(F.lit("【"), F.translate("code", T.NARROW[:94], T.WIDE[:94]), F.lit(".PDF）"))
    rows = parts(spark, sf_dir).withColumn("dirty", dirty)
    return rows.select("id", T.strip_code_boundary("dirty").alias("bare"), T.normalize_code("dirty").alias("upper"), T.normalize_name(F.concat(F.lit("　 "), F.replace("name", F.lit(" "), F.lit(" \t ")), F.lit(" "))).alias("clean"), T.is_valid_code("dirty").alias("valid"))


@query(f"with p as ({P}) select id, code as token, code as labelled, case when id % 2 = 0 then '' else string_split(name, ' ')[2] end as rest from p")
def f9_code_tokens(spark, sf_dir):
    """F9 to F12. A token runs on over the hyphen, so the first word of the name goes with it."""
    rows = parts(spark, sf_dir).withColumn("file", F.concat("code", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("-"), "name")), F.lit(".pdf")))
    return rows.select("id", F.get(T.code_tokens(F.concat(F.lit("ab 12 "), "code", F.lit(" x"))), F.lit(0)).alias("token"), T.code_from_text(F.concat(F.lit("A1B2\n图号："), "code")).alias("labelled"), T.drawing_name(F.lit(""), F.lit(""), F.col("file"), F.col("code")).alias("rest"))


@query(f"with p as ({P}) select id, 'PT.101' || lpad(cast(id as varchar), 6, '0') as fixed, 'PT.1O1' || lpad(cast(id as varchar), 6, '0') || '-AB' as tight from p")
def f14_ocr_code_fix(spark, sf_dir):
    """a code with a letter O between digits, spaces and a short tail."""
    code = F.concat(F.lit(" pt.1 O1"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" -ab\t"))
    return parts(spark, sf_dir).select("id", T.block_code(code).alias("fixed"), T.compact(code).alias("tight"))


@query("select doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '', 'g')) as letters from documents")
def f18_match_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.match_text("text").alias("letters"))


@query(SQL["f18_match_text"])
def f18_match_text_all(spark, sf_dir):
    """F18 over all documents, whatever their characters. Tested against brute force."""
    return X.table(spark, sf_dir, "documents").select("doc_id", T.match_text("text").alias("letters"))


@query("select event_id, case when event_id % 4 = 0 then '''=' || event_type when event_id % 4 = 1 then '-' || value when event_id % 4 = 2 then '''-' || event_type || '()' else event_type end as cell, case when event_id % 4 = 1 then '''-' || value when event_id % 4 = 0 then '''=' || event_type when event_id % 4 = 2 then '''-' || event_type || '()' else event_type end as strict from (select event_id, event_type, printf('%.2f', value) as value from events)")
def f33_csv_safe(spark, sf_dir):
    """F32, F33."""
    k = F.col("event_id")
    cell = F.when(k % 4 == 0, F.concat(F.lit("="), "event_type")).when(k % 4 == 1, F.concat(F.lit("-"), F.format_string("%.2f", "value"))).when(k % 4 == 2, F.concat(F.lit("-"), "event_type", F.lit("()"))).otherwise(F.col("event_type"))
    return X.table(spark, sf_dir, "events").select("event_id", T.csv_safe_signed(cell).alias("cell"), T.csv_safe_strict(cell).alias("strict"))


@query("select doc_id as drawing_id, pos - 1 as pos, case when pos > 2 and doc_id % 2 = 0 then 7 else 1 end as page_number from (select doc_id, unnest(string_split(case when doc_id % 2 = 0 then list_reduce(list_concat([string_split(text, chr(10))[1], '第 7 页'], string_split(text, chr(10))[2:]), lambda a, b: a || chr(10) || b) else text end, chr(10))) as line, generate_subscripts(string_split(case when doc_id % 2 = 0 then list_reduce(list_concat([string_split(text, chr(10))[1], '第 7 页'], string_split(text, chr(10))[2:]), lambda a, b: a || chr(10) || b) else text end, chr(10)), 1) as pos from documents where not contains(text, chr(13))) where trim(line, E' \\t') <> '' and line <> '第 7 页'")
def w4_page_marker_fill(spark, sf_dir):
    """A marker behind the first line of every other document."""
    docs = X.table(spark, sf_dir, "documents").where("not contains(text, '\r')")
    lines = F.split("text", "\n")
    marked = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.lit("第 7 页")), F.slice(lines, 2, 1_000_000)), "\n")).otherwise(F.col("text"))
    return bom.page_lines(docs.select(F.col("doc_id").alias("id"), marked.alias("all_text"))).select("drawing_id", F.col("pos").cast("long").alias("pos"), "page_number")


@query(X.ctes("bom_rows") + """ select drawing_id, pos, sequence_no, code, name, case when note = '' then '' else note end as note, quantity, page_number from bom_rows""")
def f13_bom_lines_to_rows(spark, sf_dir):
    """text lines made of BOM rows, and read back."""
    cells = F.concat_ws(" | ", "name", F.nullif("note", F.lit("")), "quantity")
    lines = X.bom_rows(spark, sf_dir).withColumn("line", F.concat("sequence_no", F.lit(" "), "code", F.lit(" | "), cells))
    got = bom.lines_to_rows(lines)
    return got.select("drawing_id", F.col("pos").cast("long").alias("pos"), "sequence_no", "code", "name", "note", "quantity", F.col("page_number").cast("long").alias("page_number"))


@query(X.ctes("bom_rows") + """, m as (select drawing_id, sequence_no, code, name, note, quantity, min(pos) as pos from bom_rows group by all) select drawing_id, row_number() over (partition by drawing_id order by pos) as row_index, code, quantity, 'review' as extraction_status from m""")
def k5_bom_from_text(spark, sf_dir):
    """A text per order with a header line, one page."""
    cells = F.concat_ws(" | ", "name", F.nullif("note", F.lit("")), "quantity")
    line = F.concat("sequence_no", F.lit(" "), "code", F.lit(" | "), cells)
    text = F.concat(F.lit("序号 | 代号 | 名称\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n"))
    drawings = X.bom_rows(spark, sf_dir).groupBy(F.col("drawing_id").alias("id")).agg(text.alias("all_text"))
    drawings = drawings.withColumns({"title_text": F.lit(""), "original_filename": F.lit("x.pdf"), "filename": F.lit("x.pdf")})
    got = jobs.bom_from_text(drawings)
    return got.select("drawing_id", F.col("row_index").cast("long").alias("row_index"), "code", "quantity", "extraction_status")


@query(X.ctes("bom_rows") + """ select drawing_id, pos, sequence_no, code, name, quantity from bom_rows where drawing_id % 5 > 0""")
def f43_bom_json_to_rows(spark, sf_dir):
    """pages of model JSON made of BOM rows; every fifth is a table of parts and left out."""
    row = F.struct(F.col("sequence_no").alias("seq"), F.col("code").alias("代号"), "name", F.col("quantity").alias("qty"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"])
    pages = X.bom_rows(spark, sf_dir).groupBy("drawing_id").agg(F.to_json(F.struct(F.lit(True).alias("has_table"), F.when(F.col("drawing_id") % 5 == 0, "part_table").otherwise("bom").alias("table_kind"), listed.alias("rows"))).alias("payload"))
    rows, _ = bom.model_pages_to_rows(pages.withColumn("page_number", F.lit(1)))
    return rows.select("drawing_id", F.col("pos").cast("long").alias("pos"), "sequence_no", "code", "name", "quantity")


@query("select event_id, json_extract(props, '$.k')::int as k from events where event_id % 7 > 0 union all select event_id, null from events where event_id % 7 = 0")
def f42_tolerant_json(spark, sf_dir):
    """JSON as it is, in a code fence, behind a word, or cut off."""
    k, p = F.col("event_id"), F.col("props")
    answer = F.when(k % 7 == 0, F.substring("props", 1, 5)).when(k % 5 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k % 3 == 0, F.concat(F.lit("Here: "), p, F.lit(" done"))).otherwise(p)
    return X.table(spark, sf_dir, "events").select("event_id", layout.tolerant_json(answer, "k int")["k"].alias("k"))


@query(r"""with a as (select conv_id, turn, '## ' || text || chr(10) || chr(10) || chr(10) || '---' || chr(10) || '- *' || role || '*  ' || chr(10) || '```sql' || chr(10) || 'x|y_z `' || turn || '`' || chr(10) || '```' as t from conversations),
l as (select conv_id, turn, list_transform(list_filter(string_split(regexp_replace(t, '```[A-Za-z]*', '', 'g'), chr(10)), lambda x: not regexp_matches(x, '^\s*(?:[-*_]\s*){3,}$')), lambda x: rtrim(regexp_replace(regexp_replace(regexp_replace(x, '^\s*#{1,6}\s*', ''), '^\s*[-*+]\s+', ''), '[*#`|_]', '', 'g'))) as ls from a)
select conv_id, turn, trim(regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) as answer from l""")
def f45_answer_clean(spark, sf_dir):
    """answers with a heading, a rule, a list, emphasis, a fence and blank lines."""
    rows = X.table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit("## "), "text", F.lit("\n\n\n---\n- *"), "role", F.lit("*  \n```sql\nx|y_z `"), F.col("turn").cast("string"), F.lit("`\n```"))
    return rows.select("conv_id", "turn", T.answer_clean(marked).alias("answer"))


@query()
def f45_answer_clean_all(spark, sf_dir):
    """F45 over all answers, Markdown and blank lines included. Tested against brute force."""
    return X.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.answer_clean("text").alias("answer"))


@query("select doc_id, sha256('标题栏：' || chr(10) || source || chr(10) || chr(10) || '技术要求：' || chr(10) || lang || chr(10) || chr(10) || '全文：' || chr(10) || text) as context from documents")
def f46_qa_context(spark, sf_dir):
    """the whole text, by its digest."""
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.qa_context("source", "lang", "text"), 256).alias("context"))


@query("select p_partkey as id, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_name else '' end as hint from part")
def f47_filename_title_hint(spark, sf_dir):
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a-"), "name", F.lit(".pdf"))).when(F.col("id") % 3 == 1, F.concat(F.lit("a_"), "name", F.lit(".pdf"))).otherwise(F.concat(F.lit("a-"), F.col("id").cast("string"), F.lit(".pdf")))
    return parts(spark, sf_dir).select("id", T.filename_title_hint(name).alias("hint"))


@query("select o_orderkey as id, case when o_orderkey % 3 > 0 then least(o_orderkey % 5, o_orderkey % 4) when o_orderkey % 4 = 1 and o_orderkey % 2 = 1 then 1 else 0 end as n, case when o_orderkey % 7 >= o_orderkey % 5 then 'horizontal' else 'vertical' end as layout from orders")
def f48_pages_processed_rule(spark, sf_dir):
    """F48, F49."""
    k = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select(k.alias("id"), T.pages_processed(k % 4, F.when(k % 3 > 0, k % 5), k % 2 == 1).alias("n"), T.layout_orientation(k % 7, k % 5).alias("layout"))


@query("select doc_id, left(replace(text, 'the', '[已隐藏]'), 500) as message from documents")
def f51_secret_redact(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.secret_redact("text", "the").alias("message"))


@query(X.ctes("segments") + " select drawing_id, md5(string_agg(line, chr(10) order by o)) as digest from (select drawing_id, source_text as line, min(ordinal) as o from segments group by all) group by all")
def w10_keep_first_lines(spark, sf_dir):
    rows = X.segments(spark, sf_dir).groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_text"))), lambda x: x["source_text"]), "\n").alias("text"))
    twice = rows.withColumn("view", F.lit(0)).unionByName(rows.withColumn("view", F.lit(1)))
    return segments.keep_first_lines(twice).select("drawing_id", F.md5("text").alias("digest"))


@query("select doc_id as drawing_id, '第 ' || n || ' 条' as label, 'item ' || doc_id || ' ' || n || case when n = 2 then ' more' else '' end as source_text from documents, (select unnest([1, 2, 3]) as n)")
def f23_tech_rows(spark, sf_dir):
    """Three requirements, one with a second line, and a list that begins anew."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("技术要求：\n1. item "), k, F.lit(" 1\n2、item "), k, F.lit(" 2\n more\n3) item "), k, F.lit(" 3\n\n1. again\n\nlater"))
    rows = segments.tech_rows(X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("drawing_id"), text.alias("tech_text")))
    return rows.select("drawing_id", "label", "source_text")


@query("select p_partkey as drawing_id, unnest(['图名', '图号', '材料', '比例']) as label, unnest(['面板' || p_partkey, 'AB' || lpad(cast(p_partkey as varchar), 7, '0'), '45', '1:5']) as source_text from part")
def f21_title_rows(spark, sf_dir):
    """a pipe-separated title table per part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("图名DRAWING NAME | 面板"), k, F.lit(" | 图号 | AB"), F.lpad(k, 7, "0"), F.lit("\n版次 | 状态 | 说明\n材料：45\n1:5 | 比例\n版权所有"))
    return segments.title_rows(X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), text.alias("title_text"))).select("drawing_id", "label", "source_text")


@query("select p_partkey as drawing_id, unnest(['主视图', '局部放大图']) as source_text from part")
def f24_extra_rows(spark, sf_dir):
    """F24, J19, T6, P9."""
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), F.concat(F.lit("第 1 页\n# 主视图\nA\n"), "p_name", F.lit("\n局部放大图\n技术要求图样\n主视图\n[图]\n12. 剖视图")).alias("all_text"))
    covered = rows.select("drawing_id", F.lit("按技术要求图样加工").alias("source_text"))
    return segments.extra_rows(rows, covered).select("drawing_id", "source_text")


@query("select p_partkey as drawing_id, '图号 | AB' || p_partkey || chr(10) || '某某机械厂' || chr(10) || '图名 | 外框' as title_text, '倒角' || p_partkey as tech_text from part")
def f25_region_fallback(spark, sf_dir):
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), F.concat(F.lit("图号 | AB"), F.col("p_partkey").cast("string"), F.lit("\n某某机械厂\n外框\n技术要求：\n倒角"), F.col("p_partkey").cast("string"), F.lit("\n设计 张三")).alias("all_text"))
    full = segments.fallback_title(rows.withColumn("all_text", F.regexp_replace("all_text", "\n设计 张三$", "")))
    return full.join(segments.fallback_tech(rows), "drawing_id").select("drawing_id", "title_text", "tech_text")


@query("select p_partkey as drawing_id, unnest(['title:001', 'title:002', 'tech:001', 'extra:001']) as segment_key, unnest([1, 2, 3, 4]) as ordinal, unnest(['图名', '图号', '第 1 条', '全文补充']) as label, unnest([true, false, true, true]) as translatable from part")
def k7_segments(spark, sf_dir):
    """K7, U7, W2, F30."""
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), F.lit("图名 | 外框\n图号 | AB001").alias("title_text"), F.concat(F.lit("技术要求\n1. 未注倒角"), F.col("p_partkey").cast("string")).alias("tech_text"), F.lit("后视图").alias("all_text"))
    return segments.segments(rows).select("drawing_id", "segment_key", F.col("ordinal").cast("int").alias("ordinal"), "label", "translatable")


@query("select p_partkey as drawing_id, '外框' || p_partkey as title from part")
def f31_title_extract(spark, sf_dir):
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), F.concat(F.lit("比例 | 1:2\n零件名称 | 外框"), F.col("p_partkey").cast("string")).alias("title_text"), F.lit("").alias("tech_text"), F.lit("").alias("all_text"))
    return segments.extract_titles(rows)


@query()
def f27_engineering_tokens(spark, sf_dir):
    """F27, F28, W8 over all lines. Tested: masking and restoring is the identity, and against a plain scan."""
    rows = translate.mask_tokens(X.segments(spark, sf_dir))
    back = E.unmask(F.col("masked"), F.col("tokens"))
    return rows.select("id", F.array_join("tokens", "|").alias("tokens"), "masked", (back["text"] == F.col("source_text")).alias("restored"))


@query(X.ctes("bom_rows") + " select drawing_id, pos, case when pos % 3 = 0 then '工程数据未原样保留：' || 'M' || quantity else '' end as issues from bom_rows")
def f26_translation_validate(spark, sf_dir):
    """A thread is lost in every third translation."""
    rows = X.bom_rows(spark, sf_dir).select("drawing_id", "pos", F.concat(F.lit("螺纹 M"), "quantity", F.lit(" 深")).alias("source_text"), F.when(F.col("pos") % 3 == 0, "thread deep").otherwise(F.concat(F.lit("thread M"), "quantity", F.lit(" deep"))).alias("translated"))
    rows = translate.mask_tokens(rows)
    return rows.select("drawing_id", F.col("pos").cast("long").alias("pos"), F.array_join(E.translation_issues(F.col("source_text"), F.col("translated"), F.col("tokens")), "；").alias("issues"))


@query("select doc_id, length(text) <= 3000 as whole, regexp_replace(text, '[ \\n\\t\\r\\x0b\\x0c]+', '', 'g') as letters from documents where regexp_full_match(text, '[\\x00-\\x7f]*')")
def f29_text_chunks(spark, sf_dir):
    """chunks of whole texts; together they hold the text, and only long ones are cut."""
    rows = X.table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.col("text").alias("masked"))
    got = translate.chunks(rows).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), " ").alias("t"), F.max(F.length("masked")).alias("n"))
    return got.select("doc_id", (F.col("n") <= translate.MOST_CHARS).alias("whole"), F.regexp_replace("t", r"\s+", "").alias("letters"))


@query()
def f29_text_chunks_all(spark, sf_dir):
    """F29 over all documents: every chunk. Tested against brute force."""
    rows = X.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("masked"))
    return translate.chunks(rows).select("doc_id", "chunk_no", "chunk")


@query(X.ctes("bom_rows") + """, r as (select drawing_id, pos, 'M' || quantity as m, pos % 4 as k from bom_rows)
select drawing_id, pos, case k when 0 then 'thread ' || m || ' deep' when 1 then 'thread deep' when 2 then '螺纹 ' || m || ' 深' else '' end as translated_text,
  case k when 0 then 'translated' when 3 then 'failed' else 'needs_review' end as status,
  case k when 0 then '' when 1 then '占位符丢失：' || m || '；工程数据未原样保留：' || m when 2 then '译文与原文相同；译文不含目标语言文字' else '占位符丢失：' || m || '；工程数据未原样保留：' || m || '；译文不含目标语言文字' end as issues, case k when 3 then 'timeout' end as error from r""")
def k9_translation_merge(spark, sf_dir):
    """Threads in two chunks each: translated; without the marker; as they were; or lost with the call."""
    rows = X.bom_rows(spark, sf_dir).select("drawing_id", "pos", F.xxhash64("drawing_id", "pos").alias("id"), F.concat(F.lit("螺纹 M"), "quantity", F.lit(" 深")).alias("source_text"), F.lit("h").alias("source_hash"))
    k = F.col("pos") % 4
    texts = F.array(F.when(k == 0, "thread SCGPH0001").when(k == 1, "thread").when(k == 2, "螺纹 SCGPH0001").otherwise(""), F.when(k < 2, "deep").when(k == 2, "深"))
    results = rows.select(F.col("id").alias("segment_id"), F.posexplode(texts).alias("chunk_no", "translated"), F.when(k == 3, "timeout").alias("error")).where("translated is not null")
    got = jobs.translation_merge(results, rows)
    return rows.select(F.col("id").alias("segment_id"), "drawing_id", F.col("pos").cast("long").alias("pos")).join(got, "segment_id").select("drawing_id", "pos", "translated_text", "status", "issues", "error")


@query()
def k9_translation_merge_all(spark, sf_dir):
    """K9 over every segment: all its chunks come back translated, and of some the markers, the new text or the call are lost. Tested by cases."""
    rows = settled(translate.mask_tokens(X.segments(spark, sf_dir)))  # chunks and audit need the same tokens
    k, c = F.col("id"), F.col("chunk")
    clean = F.concat(F.lit("new text "), F.regexp_replace(c, "[㐀-鿿]+", " "))
    text = F.when(k % 7 == 0, F.lit("lost text")).when(k % 11 == 0, c).otherwise(clean)
    results = translate.chunks(rows).select(k.alias("segment_id"), "chunk_no", text.alias("translated"), F.when(k % 13 == 0, "timeout").alias("error"))
    got = jobs.translation_merge(results, rows)
    return rows.select(k.alias("segment_id"), "drawing_id", F.col("ordinal").cast("long").alias("ordinal")).join(got, "segment_id", "left").select("drawing_id", "ordinal", "translated_text", "status", "issues", "error")


@query(X.ctes("segments", "translations") + " select s.id, s.translatable from segments s anti join (select segment_id as id, source_hash from translations where status <> 'failed') t using (id, source_hash)")
def k8_translation_queue(spark, sf_dir):
    """K8: ids to translate (one chunk each here) and to skip."""
    ready, skipped = jobs.translation_queue(X.segments(spark, sf_dir), X.translations(spark, sf_dir), X.glossary(spark, sf_dir), target_lang="en", provider="p", model="m1", glossary_sha="g1")
    return ready.select("id", F.lit(True).alias("translatable")).distinct().unionByName(skipped.select(F.col("segment_id").alias("id"), F.lit(False).alias("translatable")))
