"""The library of drawings: listings, search, batches, maintenance of tables, segments' translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..operators import buckets, catalog, segments, tables, translate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


D = X.ctes("drawings")
S = X.ctes("segments")
ST = X.ctes("segments", "translations")
SHOWN = "coalesce(original_filename, 'doc_' || id || '.pdf')"


@query(D + " select id from drawings where lower(filename) like '%the%' or translate(all_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the_and%'")
def p1_keyword_search(spark, sf_dir):
    """P1: "The_AND", of which _ is a wildcard."""
    return catalog.keyword_filter(X.drawings(spark, sf_dir), "The_AND").select("id")


@query(D + " select id from drawings where translate(all_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the%' order by upload_time desc, id desc limit 10 offset 10")
def t2_search_page(spark, sf_dir):
    """The second page."""
    return catalog.search(X.drawings(spark, sf_dir), "THE", 2).select("id")


@query(D + " select id, upload_time from drawings order by upload_time desc, id desc limit 10 offset 20")
def t1_list_page(spark, sf_dir):
    return catalog.page(X.drawings(spark, sf_dir), 3).select("id", "upload_time")


@query("select o_orderkey as id from orders order by 1 desc limit 8")
def t3_recent_checks(spark, sf_dir):
    return catalog.recent(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query(D + " select id, file_size from drawings where id = 7")
def p2_point_lookup(spark, sf_dir):
    return catalog.lookup(X.drawings(spark, sf_dir), 7).select("id", "file_size")


@query(D + f" select batch_id, row_number() over (partition by batch_id order by upload_time, id) as list_number, id, {SHOWN} as name, file_type, file_size from drawings")
def p12_catalog(spark, sf_dir):
    """P12, W1, F6, K11."""
    return catalog.catalog(X.drawings(spark, sf_dir)).select("batch_id", "list_number", "id", "name", "file_type", "file_size")


@query(D + f" select id, {SHOWN} as name, true as has_ocr from drawings where trim(all_text, E' \\t\\n') <> ''")
def p13_checkable_listing(spark, sf_dir):
    return catalog.checkable(X.drawings(spark, sf_dir)).where("has_ocr").select("id", "name", "has_ocr")


@query(D + " select id, filename, '' as title_text, '' as tech_text, sha256(all_text) as all_text from drawings")
def p17_ocr_sections_view(spark, sf_dir):
    got = catalog.ocr_sections(X.drawings(spark, sf_dir))
    return got.select("id", "filename", "title_text", "tech_text", F.sha2("all_text", 256).alias("all_text"))


@query(D + """, newest as (select id, row_number() over (order by upload_time desc, id desc) as r from drawings), hits as (select id, row_number() over (order by upload_time desc, id desc) as r from drawings where translate(all_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the%')
 select 'count' as tool, count(*) as n from drawings union all select 'detail', id from drawings where id = 7 union all select 'list', id from newest where r between 11 and 20 union all select 'search', id from hits where r <= 10""")
def p14_named_tool_queries(spark, sf_dir):
    """The tools count, detail, list and search."""
    rows = X.drawings(spark, sf_dir)
    out = catalog.run_tool(rows, "count").select(F.lit("count").alias("tool"), "n")
    for tool, parameters in (("detail", {"id": 7}), ("list", {"page": 2}), ("search", {"keyword": "THE"})):
        out = out.unionByName(catalog.run_tool(rows, tool, **parameters).select(F.lit(tool).alias("tool"), F.col("id").alias("n")))
    return out


@query(S + " select drawing_id, count(*) as n from segments group by all")
def a6_counts(spark, sf_dir):
    return catalog.count_rows(X.segments(spark, sf_dir), ["drawing_id"])


@query(D + " select arg_max(batch_id, id) as batch_id from drawings where batch_id <> ''")
def a16_latest_batch(spark, sf_dir):
    return catalog.latest_batch(X.drawings(spark, sf_dir))


@query(X.ctes("outcomes") + " select batch_id, count(*) as total, count(*) as completed, 100 as progress, case when bool_and(ok) then 'completed' when bool_or(ok) then 'partial' else 'failed' end as status from outcomes group by all")
def a7_batch_status(spark, sf_dir):
    return catalog.batch_status(X.outcomes(spark, sf_dir))


@query(D + " select id, row_number() over (order by upload_time, id) as list_number from drawings")
def w1_list_number(spark, sf_dir):
    """The whole library in one order."""
    return catalog.numbered(X.drawings(spark, sf_dir).select("id", "upload_time")).select("id", F.col("list_number"))


@query("select event_id as id, row_number() over (order by ts, event_id) as list_number, round(avg(round(value, 3)) over (order by ts, event_id rows between 4 preceding and current row), 4) as estimate from events")
def w7_one_mode(spark, sf_dir):
    """All events as one mode, numbered and averaged."""
    rows = X.table(spark, sf_dir, "events").select(F.lit("all").alias("mode"), F.col("value").alias("seconds"), "ts", F.col("event_id").alias("id"))
    means = catalog.rolling_mean(rows)
    return catalog.numbered(means.withColumnRenamed("ts", "upload_time")).select("id", "list_number", F.round("estimate", 4).alias("estimate"))


@query("select event_id as id, round(avg(round(value, 3)) over (partition by event_type order by ts, event_id rows between 4 preceding and current row), 4) as estimate from events")
def w7_rolling_mean_5(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds"), "ts", F.col("event_id").alias("id"))
    return catalog.rolling_mean(rows).select("id", F.round("estimate", 4).alias("estimate"))


@query("select user_id as key, max(event_id) as event_id from events group by all")
def w12_latest_wins(spark, sf_dir):
    return tables.latest_wins(X.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id"), ["key"], [F.desc("event_id")])


EVENTS = "o as (select user_id as key, max(event_id) as v from events where event_id % 3 = 0 group by all), n as (select user_id as key, max(event_id) as v from events where event_id % 3 > 0 group by all)"


def old_new(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("v"))
    return rows.where("v % 3 = 0").groupBy("key").agg(F.max("v").alias("v")), rows.where("v % 3 > 0").groupBy("key").agg(F.max("v").alias("v"))


def changed(spark, old, changes, how):
    """A table of old in buckets by key, changed and read again."""
    from ..shared import shared_path

    path = shared_path(spark)
    buckets.create(old, path, ["key"])
    buckets.change(spark, path, old.schema, ["key"], changes, how)
    return buckets.read(spark, path, old.schema)


@query(f"with {EVENTS} select key, v from o union all select key, v from n where key not in (select key from o)")
def u2_insert_ignore(spark, sf_dir):
    return changed(spark, *old_new(spark, sf_dir), buckets.insert_ignore(["key"]))


@query(f"with {EVENTS} select coalesce(o.key, n.key) as key, greatest(o.v, n.v) as v from o full join n on o.key = n.key")
def u3_upsert(spark, sf_dir):
    """U3, S14, as a change of a bucketed table."""
    return changed(spark, *old_new(spark, sf_dir), buckets.upsert(["key"], "v"))


@query(f"with {EVENTS} select o.key, coalesce(n.v, o.v) as v from o left join n on o.key = n.key")
def u4_keyed_update(spark, sf_dir):
    return changed(spark, *old_new(spark, sf_dir), buckets.update(["key"], ["v"]))


@query(f"with {EVENTS} select key, v from o where key not in (select key from n where v % 2 = 0)")
def u5_keyed_delete(spark, sf_dir):
    """U5, U9."""
    old, new = old_new(spark, sf_dir)
    return changed(spark, old, new.where("v % 2 = 0").select("key"), buckets.delete)


@query("select cast(o_orderkey as varchar) as filename, o_custkey as customer, '.pdf' as file_type, 1 as rows_of_id from orders")
def u11_append_with_id(spark, sf_dir):
    """Whole rows, with the number of rows that share an id."""
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("filename"), F.col("o_custkey").alias("customer"))
    old = rows.where("customer % 2 = 0").select(F.xxhash64("filename").alias("id"), "filename", "customer", F.lit(".pdf").alias("file_type"))
    got = tables.append_with_id(old, rows.where("customer % 2 = 1"), ["filename"], {"file_type": F.lit(".pdf")})
    ids = got.groupBy("id").agg(F.count(F.lit(1)).alias("rows_of_id"))
    return got.join(ids, "id").select("filename", "customer", "file_type", "rows_of_id")


@query("select o_custkey as key, string_agg(o_orderkey, ',' order by o_orderkey) as ids from orders group by all")
def u12_append_distinct_to_array(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    first = o.groupBy("key").agg(F.array(F.min("value")).alias("ids"))
    return tables.append_to_arrays(first, o.withColumn("pos", F.col("value")), ["key"], "ids").select("key", F.array_join("ids", ",").alias("ids"))


@query(f"with {EVENTS} select coalesce(o.key, n.key) as key, coalesce(n.v, o.v) as v, case when o.key is null then 'new' else 'old' end as state from o full join n on o.key = n.key")
def u13_merge_visit_row(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    return tables.merge_visits(old.withColumn("state", F.lit("old")), new, ["key"], {"state": F.lit("new")})


@query("select o_custkey as key, string_agg(o_orderkey % 5, ',' order by f) as ids from (select o_custkey, o_orderkey % 5 as o_orderkey, min(o_orderkey) as f from orders group by 1, 2) group by all")
def u6_ordered_distinct_ids(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return o.select("key", F.array_join(tables.ordered_distinct(F.transform("ids", lambda x: x % 5)), ",").alias("ids"))


@query("select doc_id as drawing_id from documents where not (doc_id % 3 = 0 and doc_id % 4 > 0)")
def j7_extraction_cache_lookup(spark, sf_dir):
    """What is left to do of a cache in which every third is, a quarter of it out of date."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("drawing_id"), F.sha2("text", 256).alias("signature"))
    cache = docs.where("drawing_id % 3 = 0").select("drawing_id", F.when(F.col("drawing_id") % 4 == 0, "old").otherwise(F.col("signature")).alias("signature"))
    return tables.cache_lookup(docs, cache)[1].select("drawing_id")


@query(ST + " select segment_id from translations join segments on segment_id = id where drawing_id % 7 > 0")
def j24_cascade_delete(spark, sf_dir):
    own = {"segments": X.segments(spark, sf_dir), "translations": X.translations(spark, sf_dir)}
    gone = X.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("drawing_id"))
    return tables.cascade_delete(own, gone)["translations"].select("segment_id")


@query(ST + " select s.id, t.status, t.output_tokens from segments s left join translations t on s.id = t.segment_id and target_lang = 'en' and provider = 'p'")
def j5_segment_translation_join(spark, sf_dir):
    got = translate.segment_translations(X.segments(spark, sf_dir), X.translations(spark, sf_dir), "en", "p")
    return got.select("id", F.col("t_status").alias("status"), F.col("t_output_tokens").cast("long").alias("output_tokens"))


HOW = {"target_lang": "en", "provider": "p", "model": "m1", "glossary_sha": "g1"}


@query(ST + " select s.id from segments s anti join (select segment_id as id, source_hash from translations where status in ('translated', 'skipped', 'needs_review')) t using (id, source_hash)")
def j6_translation_work_queue(spark, sf_dir):
    return translate.work_queue(X.segments(spark, sf_dir), X.translations(spark, sf_dir), **HOW).select("id")


STATUS = "case when t.status is null or t.source_hash <> s.source_hash then 'missing' when t.status = 'translated' then 'cached' else t.status end"


@query(ST + f""" select drawing_id, count(*) as total, count(*) filter (st = 'translated') as translated, count(*) filter (st = 'cached') as cached, count(*) filter (st = 'skipped') as skipped, count(*) filter (st = 'needs_review') as needs_review,
 count(*) filter (st = 'failed') as failed, count(*) filter (st = 'missing') as missing, sum(coalesce(i, 0))::bigint as input_tokens, sum(coalesce(o, 0))::bigint as output_tokens
 from (select s.drawing_id, {STATUS} as st, t.input_tokens as i, t.output_tokens as o from segments s left join translations t on s.id = t.segment_id) group by all""")
def a5_translation_summary(spark, sf_dir):
    """A5, K10, F7."""
    return translate.summary(translate.report(X.segments(spark, sf_dir), X.translations(spark, sf_dir), **HOW))


@query(ST + f""" select drawing_id, row_number() over (partition by drawing_id order by ordinal) as n, case st when 'missing' then '未翻译' when 'cached' then '缓存' when 'failed' then '失败' when 'needs_review' then '待复核' end as status
 from (select s.drawing_id, s.ordinal, {STATUS} as st from segments s left join translations t on s.id = t.segment_id)""")
def s12_translation_csv_export(spark, sf_dir):
    """S12, F33."""
    rows = translate.report(X.segments(spark, sf_dir), X.translations(spark, sf_dir), **HOW).withColumns({"section": F.lit("extra"), "label": F.lit("全文补充")})
    got = translate.csv_rows(rows)
    return got.select("drawing_id", F.col("序号").cast("long").alias("n"), F.col("状态").alias("status"))


@query(X.ctes("segments", "glossary") + """, m as (select s.id, g.source, g.target, row_number() over (partition by s.id order by length(source) desc, source, target) as r from segments s join glossary g on contains(s.source_text, g.source) where g.source <> '')
 select id, string_agg(source || '=' || target, '|' order by r) as terms from m where r <= 30 group by all""")
def j11_glossary_term_match(spark, sf_dir):
    """J11, T5."""
    got = translate.glossary_terms(X.segments(spark, sf_dir), X.glossary(spark, sf_dir))
    return got.select("id", F.array_join(F.transform("terms", lambda t: F.concat(t["source"], F.lit("="), t["target"])), "|").alias("terms"))


@query(X.ctes("glossary") + r""", q as (select source, target, replace(replace(source, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as s, replace(replace(target, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as t from glossary)
 select sha256('[' || string_agg('["' || s || '", "' || t || '"]', ', ' order by source, target) || ']') as glossary_hash from q""")
def a14_glossary_hash(spark, sf_dir):
    return translate.glossary_hash(X.glossary(spark, sf_dir))


@query(SQL["a14_glossary_hash"])
def a14_glossary_hash_all(spark, sf_dir):
    """A14 over all terms, those with quotes and backslashes included. Tested against Python's JSON."""
    return translate.glossary_hash(X.glossary(spark, sf_dir))


@query(S + " select id, source_text, source_hash from segments")
def f16_source_hash(spark, sf_dir):
    return X.segments(spark, sf_dir).select("id", "source_text", T.source_hash(F.concat(F.lit("  "), "source_text", F.lit("\t"))).alias("source_hash"))


@query(S + """, o as (select drawing_id, 'extra:' || ordinal as segment_key, source_hash from segments where ordinal % 5 > 0), n as (select drawing_id, 'extra:' || ordinal as segment_key, case when ordinal % 3 = 0 then 'x' else source_hash end as source_hash from segments where ordinal % 4 > 0)
 select coalesce(o.drawing_id, n.drawing_id) as drawing_id, coalesce(o.segment_key, n.segment_key) as segment_key, case when o.drawing_id is null then 'insert' when n.drawing_id is null then 'delete' when o.source_hash = n.source_hash then 'keep' else 'update' end as action,
 o.drawing_id is not null and (n.drawing_id is null or o.source_hash <> n.source_hash) as invalidated from o full join n on o.drawing_id = n.drawing_id and o.segment_key = n.segment_key""")
def j23_segment_sync(spark, sf_dir):
    rows = X.segments(spark, sf_dir).withColumns({"segment_key": F.concat(F.lit("extra:"), F.col("ordinal").cast("string")), "section": F.lit("extra"), "label": F.lit("l")})
    new = rows.where("ordinal % 4 > 0").withColumn("source_hash", F.when(F.col("ordinal") % 3 == 0, "x").otherwise(F.col("source_hash")))
    return segments.diff_segments(rows.where("ordinal % 5 > 0"), new)


@query(S + """, k as (select drawing_id, row_number() over (partition by drawing_id order by ordinal) as ordinal, source_hash from segments) select drawing_id, 'extra:' || format('{:03d}', ordinal) as segment_key, ordinal, source_hash from k""")
def w2_segment_ordinal(spark, sf_dir):
    rows = X.segments(spark, sf_dir).select("drawing_id", F.lit("extra").alias("section"), F.col("ordinal").alias("pos"), F.lit(0).alias("sub"), F.lit("l").alias("label"), "source_text")
    return segments.number_segments(rows).select("drawing_id", "segment_key", F.col("ordinal").cast("long").alias("ordinal"), "source_hash")


@query(SQL["w2_segment_ordinal"])
def w2_segment_ordinal_all(spark, sf_dir):
    """W2 over all segments, from the 1,000th of a drawing on too. Tested against brute force."""
    rows = X.segments(spark, sf_dir).select("drawing_id", F.lit("extra").alias("section"), F.col("ordinal").alias("pos"), F.lit(0).alias("sub"), F.lit("l").alias("label"), "source_text")
    return segments.number_segments(rows).select("drawing_id", "segment_key", F.col("ordinal").cast("long").alias("ordinal"), "source_hash")


@query("select doc_id as drawing_id, sha256('【标题栏】' || chr(10) || source || chr(10) || chr(10) || '【技术要求】' || chr(10) || lang || chr(10) || chr(10) || '【全文】' || chr(10) || text) as value from documents")
def s13_ocr_text_export(spark, sf_dir):
    from ..sources.files import ocr_text

    rows = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title_text"), F.col("lang").alias("tech_text"), F.col("text").alias("all_text"))
    return ocr_text(rows).select("drawing_id", F.sha2("value", 256).alias("value"))


@query("""select doc_id as drawing_id, sha256(case when doc_id % 3 > 0 then '%PDF-' || source || text else 'doc_' || doc_id || '.pdf' end || chr(0) || 'v1' || chr(0) || 'm' || chr(0) || '10' || chr(0) || chr(0) || text || chr(0) || 'd.pdf') as signature from documents""")
def s4_content_signature(spark, sf_dir):
    """S4 of a file for each document but every third; there its name stands for the bytes."""
    from ..sources.files import content_signature

    name = lambda c: F.concat(F.lit("doc_"), F.col(c).cast("string"), F.lit(".pdf"))
    rows = X.drawings(spark, sf_dir).withColumns({"filename": name("id"), "original_filename": F.lit("d.pdf")})
    files = X.table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(name("doc_id").alias("filename"), F.concat(F.lit("%PDF-"), "source", "text").cast("binary").alias("content"))
    return content_signature(rows, files, "v1", "m", 10)


@query("select 'p' || page_id as filename, sha256(sha256(html) || chr(0) || 'v' || chr(0) || '300' || chr(0) || '10' || chr(0) || 's') as signature from pages")
def s5_scan_signature(spark, sf_dir):
    from ..sources.files import scan_signature

    files = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return scan_signature(files, "v", 300, 10, "s")


@query("""select doc_id as path, reason is null as accepted, reason as reject_reason from (select doc_id, case when doc_id % 5 = 3 then 'unsupported type' when n_chars > 52428800 then 'too large' when n_chars = 0 then 'empty' when doc_id % 5 = 1 then 'not a PDF' when doc_id % 5 = 2 then 'not a PNG' end as reason from documents)""")
def s2_upload_admission(spark, sf_dir):
    """Every document as an upload: PDF and PNG with and without their first bytes, other types, empty ones."""
    from ..sources.files import admission

    kind = F.col("doc_id") % 5
    name = F.when(kind == 3, "x.docx").when(kind.isin(2, 4), "x.png").otherwise("x.PDF")
    magic = F.when(kind == 0, F.lit(b"%PDF-")).when(kind == 4, F.lit(b"\x89PNG\r\n\x1a\n")).otherwise(F.lit(b"junk"))
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), name.alias("filename"), F.col("n_chars").alias("length"), F.concat(magic, F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("content"))
    return admission(files)


@query("""select event_id, strftime(ts, '%Y%m%d%H%M%S') || '_' || lpad(cast(extract(microsecond from ts) % 1000000 as varchar), 6, '0') || '_' || event_type || event_id || '.pdf' as name from events""")
def s3_storage_name(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events")
    return rows.select("event_id", T.storage_name(F.concat("event_type", F.lit(" ("), F.col("event_id").cast("string"), F.lit(")/.pdf")), F.col("ts")).alias("name"))


@query("select source as source_text, 'en' as target_lang, count(*) as n from (select string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] as source from benchmark) where trim(source) <> '' group by all")
def s6_glossary_source(spark, sf_dir):
    """A glossary written as CSV to the shared folder, and read."""
    from ..shared import shared_path
    from ..sources.files import glossary

    path = shared_path(spark)
    X.glossary(spark, sf_dir).select(F.concat(F.lit(" "), "source").alias("source"), "target", F.lit("").alias("note")).write.csv(path, header=True, escape='"')
    got = glossary(spark, path)
    return got.groupBy(F.col("source").alias("source_text"), "target_lang").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id as drawing_id, count(*) as blocks, round(sum((event_id % 1000) / 1000.0::double), 6) as confidence from events group by all")
def s7_scan_blocks_source(spark, sf_dir):
    from ..sources.files import scan_blocks

    boxes = X.boxes(spark, sf_dir)
    block = F.struct(F.lit(1).alias("page"), "text", F.array("x", "y", "w", "h").alias("bbox"), "confidence")
    scans = boxes.groupBy(F.col("page").alias("drawing_id")).agg(F.to_json(F.collect_list(block)).alias("blocks_json"))
    return scan_blocks(scans).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query("select doc_id as id, source as batch_id from documents")
def s10_drawing_table_scan(spark, sf_dir):
    from ..shared import shared_path
    from ..sources.files import drawing_scan

    path = shared_path(spark)
    X.drawings(spark, sf_dir).write.parquet(path)
    return drawing_scan(spark, path, ["id", "batch_id", "upload_time"]).select("id", "batch_id")


@query("select page_id as drawing_id, 'b' || page_id % 2 as backend, sha256(html) as digest from pages")
def s9_layout_json_sink(spark, sf_dir):
    from ..shared import shared_path
    from ..sources.files import save_layouts

    path = shared_path(spark)
    rows = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("drawing_id"), F.concat(F.lit("b"), (F.col("page_id") % 2).cast("string")).alias("backend"), F.col("html").alias("payload"))
    save_layouts(rows, path)
    back = spark.read.schema("drawing_id long, payload string, backend string").json(path)
    return back.select("drawing_id", "backend", F.sha2("payload", 256).alias("digest"))


@query("select doc_id % 20 as bucket, count(*) as n from documents group by all")
def s1_file_catalog(spark, sf_dir):
    """A file per twentieth of the documents in the shared folder, listed with its content."""
    from ..shared import shared_path
    from ..sources.files import file_catalog

    path = shared_path(spark)
    X.table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("bucket"), F.lit("x").alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)
    files = file_catalog(spark, path, content=True)
    return files.groupBy(F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long").alias("bucket")).agg(F.sum(F.col("length") / 2).cast("long").alias("n"))


@query(S + " select id, drawing_id, ordinal from segments")
def t11_segment_order(spark, sf_dir):
    return segments.in_order(X.segments(spark, sf_dir)).select("id", "drawing_id", F.col("ordinal").cast("long").alias("ordinal"))


@query(S + " select id from segments where ordinal % 3 < 2")
def p5_section_filter(spark, sf_dir):
    section = F.element_at(F.array(F.lit("title"), F.lit("tech"), F.lit("extra")), (F.col("ordinal") % 3 + 1).cast("int"))
    return translate.section_filter(X.segments(spark, sf_dir).withColumn("section", section), ["title", "tech"]).select("id")


@query(S + r""" select id, regexp_replace(regexp_replace(regexp_replace('| \(' || source_text || '\) |' || chr(9), '\\\((.*?)\\\)', '\1', 'g'), '\\\[(.*?)\\\]', '\1', 'g'), '^[ \t|]+|[ \t|]+$', '', 'g') as text from segments""")
def f54_latex_strip(spark, sf_dir):
    return X.segments(spark, sf_dir).select("id", T.latex_strip(F.concat(F.lit("| \\("), "source_text", F.lit("\\) |\t"))).alias("text"))


@query(SQL["f54_latex_strip"])
def f54_latex_strip_all(spark, sf_dir):
    """F54 over all lines, with pipes and backslashes of their own. Tested against brute force."""
    return X.segments(spark, sf_dir).select("id", T.latex_strip(F.concat(F.lit("| \\("), "source_text", F.lit("\\) |\t"))).alias("text"))


def uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of every document as a drawing: in the second each third comes again as it was and each fifth changed; every seventh and eleventh is no PDF."""
    k = F.col("doc_id").cast("string")

    def delivery(rows: DataFrame, name: str, at: str, mark) -> DataFrame:
        return rows.select(
            F.col("doc_id").alias("drawing_id"), F.concat(F.lit(name + "/"), k).alias("path"), F.concat(F.lit("d"), k, F.when(F.col("doc_id") % 7 == 0, ".docx").otherwise(".PDF")).alias("filename"), F.lit(None).cast("string").alias("original_filename"),
            F.lit(at).cast("timestamp").alias("uploaded"), F.concat(F.when(F.col("doc_id") % 11 == 0, "junk").otherwise("%PDF-"), mark, F.coalesce("text", F.lit(""))).cast("binary").alias("content"),
            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("零件名称 | 外框"), k)).otherwise("").alias("title_text"), F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("技术要求：\n1. item "), k, F.lit(" "), mark)).otherwise("").alias("tech_text"), F.concat(F.lit("视图"), k, mark).alias("all_text"),
        )

    docs = X.table(spark, sf_dir, "documents")
    again = docs.where("doc_id % 3 = 0 or doc_id % 5 = 0")
    return delivery(docs, "a", "2024-01-01", F.lit("")), delivery(again, "b", "2024-01-02", F.when(F.col("doc_id") % 5 == 0, "two").otherwise(""))


@query("""with d as (select doc_id as k, doc_id % 7 > 0 and doc_id % 11 > 0 as good, doc_id % 3 = 0 or doc_id % 5 = 0 as again, case when doc_id % 5 = 0 then 'two' else '' end as mark from documents)
select k as drawing_id, 'title:001' as what, '外框' || k as said from d where good and k % 2 = 0
union all select k, 'tech:001', trim('item ' || k || ' ' || mark) from d where good and k % 4 < 2
union all select k, 'extra:001', '视图' || k || mark from d where good
union all select k, case when good then 'new' else 'rejected' end, case when good then null when k % 7 = 0 then 'unsupported type' else 'not a PDF' end from d
union all select k, case when not good then 'rejected' when mark = '' then 'known' else 'changed' end, case when good then null when k % 7 = 0 then 'unsupported type' else 'not a PDF' end from d where again""")
def x1_incremental_ingest(spark, sf_dir):
    """Two deliveries of drawings as a stream: what was decided of each upload, and the segments that hold in the end."""
    from ..shared import shared_path
    from ..streaming import ingest as I

    root = shared_path(spark)
    for name, rows in zip("ab", uploads(spark, sf_dir), strict=True):
        rows.write.parquet(f"{root}/in/{name}")
        I.ingest(spark, f"{root}/in/*", f"{root}/out", f"{root}/cp").awaitTermination()
    decided = spark.read.parquet(f"{root}/out/uploads").select("drawing_id", F.col("action").alias("what"), F.col("reject_reason").alias("said"))
    return I.current(spark, f"{root}/out").select("drawing_id", F.col("segment_key").alias("what"), F.col("source_text").alias("said")).unionByName(decided)


@query(X.ctes("outcomes") + " select batch_id::varchar as batch_id, count(*) as completed, case when bool_and(ok) then 'completed' when bool_or(ok) then 'partial' else 'failed' end as status from outcomes group by all")
def x2_batch_progress(spark, sf_dir):
    """The live status of upload batches, in the bucketed table that the stream keeps, once it has run dry. Outcomes come in three deliveries."""
    from ..shared import shared_path
    from ..streaming import ingest as I

    root = shared_path(spark)
    rows = X.outcomes(spark, sf_dir).select("batch_id", "ok", F.pmod(F.xxhash64("filename"), F.lit(3)).alias("part"))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{root}/in/{part}")
        stream = spark.readStream.schema("batch_id long, ok boolean").parquet(f"{root}/in/*")
        I.batch_progress(stream, f"{root}/status", f"{root}/cp").awaitTermination()
    return I.progress(spark, f"{root}/status").select("batch_id", "completed", "status")
