"""Kit checks: matching, items, verdicts, BOM rows, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..functions.labels import label
from ..operators import bom, graph, match, tables, verdict
from ..plans import jobs
from ..shared import settled
from ..sources import files as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Item rows in SQL. Codes and names of the derived tables are ASCII and clean, so that lower() is what is compared.
MERGED = """merged as (select check_id, drawing_id, sequence_no, code, name, note, quantity, min(pos) as pos, min(page_number) as page_number from bom_rows group by all),
clash as (select drawing_id, sequence_no from merged group by all having count(distinct (code, name)) > 1),
rows0 as (select m.*, c.drawing_id is not null as clash, note = '非标准件' as odd, row_number() over (partition by m.drawing_id order by page_number, pos) as row_index
  from merged m left join clash c on m.drawing_id = c.drawing_id and m.sequence_no = c.sequence_no)"""
VIEW = """view as (select check_id, drawing_id, original_filename as f, case when original_filename like '~%' then 'temp' when lower(original_filename) like '%.sldprt' then 'model' else 'drawing' end as kind,
  lower(regexp_replace(original_filename, '[.][^.]*$', '')) as stem from files)"""
MATCHES = """keys as (select distinct check_id, code, name from rows0 where not (note = '标准件' and not clash)),
exact as (select k.check_id, k.code, k.name, v.drawing_id, f, case when stem = lower(k.code) then 'code' when stem = lower(k.code || '-' || k.name) then 'code-name' when stem = lower(k.code || '_' || k.name) then 'code_name' else 'code name' end as form
  from keys k join view v on k.check_id = v.check_id and kind = 'drawing' and stem in (lower(k.code), lower(k.code || '-' || k.name), lower(k.code || '_' || k.name), lower(k.code || ' ' || k.name))),
cand as (select k.check_id, k.code, k.name, v.drawing_id, f from keys k join view v on k.check_id = v.check_id and kind = 'drawing' and split_part(replace(replace(stem, '-', ' '), '_', ' '), ' ', 1) = lower(k.code) and length(stem) > length(k.code) + 1
  where not exists (from exact e where e.check_id = k.check_id and e.code = k.code and e.name = k.name and e.drawing_id = v.drawing_id)),
e1 as (select check_id, code, name, string_agg(f, '；' order by drawing_id) as matched from exact group by all),
c1 as (select check_id, code, name, string_agg(f, '；' order by drawing_id) as maybe from cand group by all),
items as (select r.*, matched, maybe, case when note = '标准件' and not clash then 'exempt' when matched is not null then 'exists' when maybe is not null then 'candidate' else 'missing' end as match_status
  from rows0 r left join e1 on not (r.note = '标准件' and not clash) and r.check_id = e1.check_id and r.code = e1.code and r.name = e1.name
  left join c1 on not (r.note = '标准件' and not clash) and r.check_id = c1.check_id and r.code = c1.code and r.name = c1.name),
judged as (select *, case when clash or odd or match_status = 'candidate' then 'review' else 'ok' end as extraction_status, match_status = 'exempt' as is_exempt from items)"""
ITEMS = X.ctes("bom_rows", "files") + ",\n" + ",\n".join([MERGED, VIEW, MATCHES])
COUNTS = """count(*) filter (not is_exempt and match_status = 'exists') as exists, count(*) filter (not is_exempt and match_status = 'missing') as missing, count(*) filter (match_status = 'candidate') as candidates,
  count(*) filter (match_status = 'unchecked') as unchecked, count(*) filter (is_exempt) as exempt, count(*) filter (not is_exempt and (extraction_status <> 'ok' or match_status in ('candidate', 'unchecked'))) as review_items"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.kit_check_all(X.bom_rows(spark, sf_dir), X.files(spark, sf_dir))


def names(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda m: m["matched_filename"]), "；")


@query(ITEMS + " select check_id, drawing_id, row_index, code, match_status, extraction_status, coalesce(matched, '') as matched, coalesce(maybe, '') as maybe from judged")
def kit_items(spark, sf_dir):
    """K1, F56, J4, T9, F53."""
    return items(spark, sf_dir).select("check_id", "drawing_id", "row_index", "code", "match_status", "extraction_status", F.coalesce(names("matches"), F.lit("")).alias("matched"), F.coalesce(match.candidate_display(F.col("candidates")), F.lit("")).alias("maybe"))


@query(ITEMS + f" select check_id, drawing_id, count(*) as items, {COUNTS} from judged group by all")
def kit_group_counts(spark, sf_dir):
    """A2."""
    return verdict.group_counts(items(spark, sf_dir))


@query(ITEMS + " select check_id, code, name, drawing_id, f as matched_filename, form as match_form from exact")
def j1_kit_exact_match(spark, sf_dir):
    rows = match.with_keys(jobs.prepare_rows(X.bom_rows(spark, sf_dir)).where("not (note = '标准件' and extraction_status = 'ok')"))
    got = match.exact_matches(match.code_keys(rows), match.file_view(X.files(spark, sf_dir)))
    return got.select("check_id", F.upper("code_cmp").alias("code"), F.col("name_cmp").alias("name"), "drawing_id", "matched_filename", "match_form")


@query(ITEMS + " select check_id, code, name, drawing_id, f as matched_filename from cand")
def j2_kit_candidate_match(spark, sf_dir):
    rows = match.with_keys(jobs.prepare_rows(X.bom_rows(spark, sf_dir)).where("not (note = '标准件' and extraction_status = 'ok')"))
    keys, view = match.code_keys(rows), match.file_view(X.files(spark, sf_dir))
    got = match.candidate_matches(keys, view, match.exact_matches(keys, view))
    return got.select("check_id", F.upper("code_cmp").alias("code"), F.col("name_cmp").alias("name"), "drawing_id", "matched_filename")


@query(X.ctes("files") + ",\n" + VIEW + """ select check_id, count(*) as files, string_agg(distinct case kind when 'temp' then '临时文件' else '模型文件，不作为工程图' end, '；' order by case kind when 'temp' then '临时文件' else '模型文件，不作为工程图' end) as reasons, md5(string_agg(f, '|' order by drawing_id, f)) as listed
 from view where kind <> 'drawing' group by all""")
def j3_ignored_attach(spark, sf_dir):
    """J3, A17."""
    got = match.ignored_files(match.file_view(X.files(spark, sf_dir)))
    return got.select("check_id", F.size("ignored").cast("long").alias("files"), F.col("ignored_reasons").alias("reasons"), F.md5(F.array_join(F.transform("ignored", lambda x: x["matched_filename"]), "|")).alias("listed"))


@query(X.ctes("files") + """ select check_id, drawing_id, regexp_extract(original_filename, '^(.+)[.]([^.]+)$', 1) as stem, lower(regexp_extract(original_filename, '[.][^.]+$')) as suffix,
 case when lower(original_filename) like '%.sldprt' then 'model' else 'drawing' end as kind, original_filename like '~%' as temp from files""")
def p3_suffix_class(spark, sf_dir):
    """F5, P3, P4, P18."""
    rows = X.files(spark, sf_dir)
    return rows.select("check_id", "drawing_id", T.file_stem("original_filename").alias("stem"), T.file_suffix("original_filename").alias("suffix"), T.suffix_class(T.file_suffix("original_filename")).alias("kind"), T.is_temp_file("original_filename").alias("temp"))


@query(X.ctes("bom_rows") + """ select note, count(*) as n, note = '标准件' as exempt, note = '非标准件' as review, case when note = '标准件' then note end as reason from bom_rows group by note""")
def f8_classify_note(spark, sf_dir):
    rows = X.bom_rows(spark, sf_dir).withColumn("c", T.classify_note("note"))
    return rows.groupBy("note", "c.exempt", "c.review", "c.reason").agg(F.count(F.lit(1)).alias("n"))


@query(X.ctes("bom_rows") + ",\n" + """g as (select drawing_id, sequence_no, code, name, note, quantity, string_agg(distinct cast(page_number as varchar), ',' order by cast(page_number as varchar)) as pages, min(pos) as pos from bom_rows group by all)
 select drawing_id, sequence_no, code, name, note, quantity, pages, pos from g""")
def a8_bom_merge_duplicates(spark, sf_dir):
    got = bom.merge_duplicates(X.bom_rows(spark, sf_dir))
    return got.select("drawing_id", "sequence_no", "code", "name", "note", "quantity", F.array_join("pages", ",").alias("pages"), F.col("pos").cast("long").alias("pos"))


@query(X.ctes("bom_rows") + ",\n" + MERGED + " select drawing_id, row_index, sequence_no, code, case when clash then 'review' else 'ok' end as extraction_status from rows0")
def a9_sequence_conflict(spark, sf_dir):
    """P7, A8, A9, W3."""
    got = jobs.prepare_rows(X.bom_rows(spark, sf_dir))
    return got.select("drawing_id", F.col("row_index").cast("long").alias("row_index"), "sequence_no", "code", "extraction_status")


CHECKS = """checks as (select o_custkey as check_id, list(o_orderkey order by o_orderkey) as drawing_ids, case when o_custkey % 3 = 0 then 'manual' else 'all' end as mode, case when o_custkey % 5 = 0 then 'partial' else 'completed' end as status from orders group by o_custkey),
visits as (select o_custkey as check_id, o_orderkey as drawing_id, case o_orderstatus when 'F' then 'processed' when 'O' then 'partial' else 'no_table' end as status from orders where o_orderkey % 6 > 0),
alive as (select o_orderkey as id, 'f' || o_orderkey as filename from orders where o_orderkey % 17 > 0),
kept as (select 'f' || o_orderkey as filename from orders where o_orderkey % 13 > 0),
sel as (select check_id, mode, status, unnest(drawing_ids) as drawing_id from checks)"""


def check_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """checks, check_drawings, drawings, stored files, from orders: a check per customer."""
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mode = F.when(F.col("check_id") % 3 == 0, "manual").otherwise("all")
    checks = o.groupBy(F.col("o_custkey").alias("check_id")).agg(F.array_sort(F.collect_list(k)).alias("drawing_ids"))
    checks = checks.withColumns({"mode": mode, "status": F.when(F.col("check_id") % 5 == 0, "partial").otherwise("completed"), "root_drawing_ids": F.when(mode == "manual", F.slice("drawing_ids", 1, 1)).otherwise(F.array().cast("array<bigint>")), "error": F.lit(None).cast("string"), "current_step": F.lit(None).cast("string")})
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "partial").otherwise("no_table")
    visits = o.where(k % 6 > 0).select(F.col("o_custkey").alias("check_id"), k.alias("drawing_id"), status.alias("status"))
    name = F.concat(F.lit("f"), k.cast("string")).alias("filename")
    return checks, visits, o.where(k % 17 > 0).select(k.alias("id"), name), o.where(k % 13 > 0).select(name)


@query(f"with {CHECKS} select check_id, drawing_id from sel anti join alive on drawing_id = id")
def j8_missing_selected(spark, sf_dir):
    checks, _, drawings, _ = check_tables(spark, sf_dir)
    return verdict.missing_selected(checks, drawings)


@query(f"with {CHECKS} select check_id, drawing_id from sel join alive on drawing_id = id anti join kept on alive.filename = kept.filename")
def j9_missing_files(spark, sf_dir):
    checks, _, drawings, stored = check_tables(spark, sf_dir)
    return verdict.missing_files(checks, drawings, stored)


@query(f"with {CHECKS} select check_id, drawing_id from sel anti join visits using (check_id, drawing_id) where mode = 'all'")
def j10_unprocessed_selected(spark, sf_dir):
    checks, visits, _, _ = check_tables(spark, sf_dir)
    return verdict.unprocessed_selected(checks, visits)


@query(f"with {CHECKS} select distinct check_id, drawing_id from (select check_id, drawing_id from sel where mode = 'all' union all select check_id, drawing_ids[1] from checks where mode = 'manual' union all select check_id, v.drawing_id from visits v semi join (select check_id from checks where mode = 'manual') m using (check_id))")
def j25_relevant_ids(spark, sf_dir):
    checks, visits, _, _ = check_tables(spark, sf_dir)
    return verdict.relevant_ids(checks, visits)


def order_items(spark, sf_dir) -> DataFrame:
    """Item rows keyed by the checks of orders."""
    owner = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("drawing_id"), F.col("o_custkey").alias("own"))
    return items(spark, sf_dir).join(owner, "drawing_id").withColumn("check_id", F.col("own")).drop("own")


OWNED = "owned as (select o_custkey as own, j.* from judged j join orders on j.drawing_id = o_orderkey), grp as (select v.* from visits v semi join alive on v.drawing_id = id semi join owned w on v.check_id = w.own and v.drawing_id = w.drawing_id where v.status in ('processed', 'partial', 'failed'))"


@query(ITEMS + f""", {CHECKS}, {OWNED},
s as (select own as check_id, {COUNTS} from owned semi join grp on owned.own = grp.check_id and owned.drawing_id = grp.drawing_id group by own),
n as (select c.check_id, c.status, len(drawing_ids) as selected_files, (select count(*) from grp where grp.check_id = c.check_id) as assemblies, (select count(*) from visits v where v.check_id = c.check_id and v.status = 'partial') as bad,
  (select count(*) from visits v anti join grp using (check_id, drawing_id) where v.check_id = c.check_id and v.status = 'processed') as empty_processed_drawings, (select count(*) from visits v where v.check_id = c.check_id and v.status = 'no_table') as no_table_drawings,
  (select count(*) from sel anti join alive on drawing_id = id where sel.check_id = c.check_id) as missing_selected_files, (select count(*) from sel join alive on drawing_id = id anti join kept on alive.filename = kept.filename where sel.check_id = c.check_id) as missing_files,
  (select count(*) from sel anti join visits using (check_id, drawing_id) where sel.check_id = c.check_id and mode = 'all') as unprocessed_selected_drawings from checks c),
t as (select n.*, coalesce(exists, 0) as exists, coalesce(missing, 0) as missing, coalesce(candidates, 0) as candidates, coalesce(unchecked, 0) as unchecked, coalesce(exempt, 0) as exempt, coalesce(review_items, 0) as review_items, bad + empty_processed_drawings as issue_drawings from n left join s on n.check_id = s.check_id)
select check_id, status, selected_files, assemblies, exists, missing, candidates, unchecked, exempt, review_items, issue_drawings, no_table_drawings, missing_selected_files, missing_files, unprocessed_selected_drawings, empty_processed_drawings,
  review_items + issue_drawings + missing_selected_files + missing_files + unprocessed_selected_drawings as review_total,
  status = 'completed' and missing_selected_files + missing_files + unprocessed_selected_drawings + empty_processed_drawings = 0 as complete,
  status = 'completed' and missing_selected_files + missing_files + unprocessed_selected_drawings + empty_processed_drawings = 0 and assemblies > 0 and missing + candidates + unchecked + review_items + issue_drawings = 0 as all_present from t""")
def a1_check_summary(spark, sf_dir):
    """A1, A3, P10."""
    checks, visits, drawings, stored = check_tables(spark, sf_dir)
    return verdict.check_summary(checks, visits, order_items(spark, sf_dir), drawings, stored)


@query(f"""with {CHECKS}, its as (select distinct o_custkey as check_id from orders join lineitem on o_orderkey = l_orderkey)
select c.check_id, case when bool_or(v.status = 'partial') or (c.mode = 'manual' and count(*) filter (v.drawing_id = drawing_ids[1] and v.status = 'processed') = 0) then 'partial' else 'completed' end as run_status
from checks c left join visits v on c.check_id = v.check_id group by c.check_id, c.mode, c.drawing_ids""")
def a4_check_run_status(spark, sf_dir):
    checks, visits, _, _ = check_tables(spark, sf_dir)
    own = X.bom_rows(spark, sf_dir).join(X.table(spark, sf_dir, "orders"), F.col("drawing_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("check_id"), "drawing_id")
    return verdict.run_status(checks, visits, own)


@query(f"with {CHECKS}, v as (select check_id, count(distinct drawing_id) as n from visits group by check_id) select c.check_id, least(coalesce(n, 0), len(drawing_ids)) as processed_drawings, '已检查 ' || coalesce(n, 0) || ' 张图纸' as current_step from checks c left join v on c.check_id = v.check_id")
def a20_run_progress(spark, sf_dir):
    checks, visits, _, _ = check_tables(spark, sf_dir)
    return verdict.run_progress(checks, visits)


@query(f"with {CHECKS} select check_id, mode, case mode when 'all' then '全部图纸' else '手动指定总成图' end as mode_label, status, 0 as processed_drawings, len(drawing_ids)::int as total_drawings, '' as current_step, '' as error from checks")
def p16_check_status_view(spark, sf_dir):
    checks, _, _, _ = check_tables(spark, sf_dir)
    return verdict.status_view(checks.withColumn("processed_drawings", F.lit(None).cast("int")))


@query(f"""with {CHECKS}, k as (select check_id, kind, drawing_id, msg, r from (
  select check_id, 'partial' as kind, drawing_id, 'table partial' as msg, 2 as r from visits where status = 'partial' union all
  select check_id, 'file_missing', drawing_id, 'file gone', 5 from sel join alive on drawing_id = id anti join kept on alive.filename = kept.filename union all
  select check_id, 'unprocessed', drawing_id, 'no result', 6 from sel anti join visits using (check_id, drawing_id) where mode = 'all' union all
  select check_id, 'deleted', drawing_id, 'row gone', 7 from sel anti join alive on drawing_id = id))
select check_id, drawing_id, arg_min(kind, r) as kind, string_agg(msg, '；' order by r) as issues from k group by all""")
def a13_drawing_issue_merge(spark, sf_dir):
    checks, visits, drawings, stored = check_tables(spark, sf_dir)
    each = [("partial", visits.where("status = 'partial'").select("check_id", "drawing_id"), "table partial"), ("file_missing", verdict.missing_files(checks, drawings, stored), "file gone"), ("unprocessed", verdict.unprocessed_selected(checks, visits), "no result"), ("deleted", verdict.missing_selected(checks, drawings), "row gone")]
    rows = None
    for kind, df, text in each:
        one = df.select("check_id", "drawing_id", F.lit(kind).alias("kind"), F.array(F.lit(text)).alias("messages"))
        rows = one if rows is None else rows.unionByName(one)
    return verdict.merge_drawing_issues(rows)


@query(f"""with {CHECKS}, p as (select check_id, unnest(drawing_ids) as d, generate_subscripts(drawing_ids, 1) as i, drawing_ids from checks),
r as (select p.check_id, p.d as drawing_id, i - 1 as pos, p.drawing_ids[1] as item_id from p)
select check_id, drawing_id, cast(item_id as varchar) || '@' || cast(item_id // 7 as varchar) as parents from r""")
def j12_parent_reference_join(spark, sf_dir):
    checks, _, _, _ = check_tables(spark, sf_dir)
    visits = checks.select("check_id", F.explode("drawing_ids").alias("drawing_id"), F.slice("drawing_ids", 1, 1).alias("parent_item_ids"))
    its = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 7).alias("drawing_id"), F.lit("c").alias("code"))
    got = verdict.parent_references(visits, its)
    return got.select("check_id", "drawing_id", F.array_join(F.transform("parents", lambda x: F.concat(x["item_id"].cast("string"), F.lit("@"), x["parent_id"].cast("string"))), ",").alias("parents"))


@query(f"""with {CHECKS}, e as (select o_custkey as check_id, bool_or(o_orderpriority like '1%' and o_orderkey % 10 = 0) as edited from orders group by all),
b as (select check_id, string_agg(drawing_id, ',' order by drawing_id) as ids from visits where status = 'partial' group by all)
select c.check_id, case when edited then 'edited' when ids is null then 'nothing to retry' end as blocked, case when not edited then ids end as force_ids from checks c left join e on c.check_id = e.check_id left join b on c.check_id = b.check_id""")
def p11_retry_eligibility(spark, sf_dir):
    """P11, K4."""
    checks, visits, _, _ = check_tables(spark, sf_dir)
    its = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("check_id"), (F.startswith("o_orderpriority", F.lit("1")) & (F.col("o_orderkey") % 10 == 0)).alias("edited"))
    return verdict.retry_plan(checks, visits, its).select("check_id", "blocked", F.array_join("force_ids", ",").alias("force_ids"))


@query(f"""with {CHECKS}, q as (select check_id, mode, list_concat(drawing_ids, drawing_ids) as d, drawing_ids as ids from checks),
x as (select check_id, string_agg(drawing_id, ', ' order by drawing_id) filter (id is null) as gone from sel left join alive on drawing_id = id group by check_id)
select q.check_id, array_to_string(ids, ',') as drawing_ids, case when mode = 'manual' then case when q.check_id % 2 = 0 then 'no root' else case when gone is not null then 'deleted: ' || gone end end when gone is not null then 'deleted: ' || gone end as error from q join x on q.check_id = x.check_id""")
def p6_check_request_validation(spark, sf_dir):
    """P6, U6."""
    checks, _, drawings, _ = check_tables(spark, sf_dir)
    none = F.array().cast("array<bigint>")
    asked = checks.select("check_id", "mode", F.concat("drawing_ids", "drawing_ids").alias("drawing_ids"), F.when((F.col("mode") == "manual") & (F.col("check_id") % 2 > 0), F.slice("drawing_ids", 1, 1)).otherwise(none).alias("root_drawing_ids"))
    return verdict.validate_requests(asked, drawings.withColumn("file_type", F.lit(".PDF"))).select("check_id", F.array_join("drawing_ids", ",").alias("drawing_ids"), "error")


@query(X.ctes("edges") + """, reach(check_id, drawing_id, depth) as (select 0::bigint, 1::bigint, 0 union select e.check_id, e.child, r.depth + 1 from reach r join edges e on r.drawing_id = e.parent and e.child <> e.parent where r.depth < 50)
select check_id, drawing_id, min(depth) as depth, case when min(depth) = 0 then 'root' else 'reference' end as discovery from reach group by all""")
def j20_assembly_expansion(spark, sf_dir):
    """J20, K2's expansion, from part 1 on, references back up the tree included."""
    roots = spark.range(1).select(F.lit(0).cast("long").alias("check_id"), F.lit(1).cast("long").alias("drawing_id"))
    return graph.expand(roots, X.edges(spark, sf_dir))


@query(X.ctes("edges") + """, reach(start, node) as (select child, child from edges union select r.start, e.child from reach r join edges e on r.node = e.parent)
select check_id, parent, child, parent = child or exists (from reach where start = child and node = parent) as in_cycle from edges""")
def j21_cycle_flag(spark, sf_dir):
    """Which references lie on a cycle."""
    return graph.in_cycle(X.edges(spark, sf_dir))


#: A walk as a state for each check and step: what is still to be looked at, the path, and what was entered. Needs e(check_id, parent,
#: child, ord) and roots(check_id, drawing_id); a row of walk is one reference looked at, d the depth of its drawing.
WALK = """adj as (select check_id, parent, list(child order by ord, child) as kids from (select check_id, parent, child, min(ord) as ord from e group by all) group by all),
walk as (select check_id, list({'p': null::bigint, 'c': drawing_id::bigint, 'd': -1::bigint} order by drawing_id) as todo, []::bigint[] as path, []::bigint[] as seen, null::bigint as p, null::bigint as c, null::bigint as d, null::varchar as mark, false as entered from roots group by check_id
 union all select x.check_id, case when fresh and t.d + 1 < 50 then list_concat(list_transform(coalesce(kids, []::bigint[]), lambda k: {'p': t.c, 'c': k, 'd': t.d + 1}), rest) else rest end, case when fresh then list_append(up, t.c) else up end,
  case when fresh then list_append(seen, t.c) else seen end, t.p, t.c, t.d, case when t.c = t.p then 'self' when list_contains(up, t.c) then 'path' end, fresh
 from (select check_id, todo[1] as t, todo[2:] as rest, path[1:todo[1].d + 1] as up, seen, not list_contains(seen, todo[1].c) as fresh from walk where len(todo) > 0) x left join adj on adj.check_id = x.check_id and adj.parent = x.t.c)"""


@query(X.ctes("edges") + ", f as (select parent // 60 as check_id, parent, parent // 60 * 60 + child % 60 as child from edges), " + f"""e as (select check_id, parent, child, parent * 1000000 + child as ord from f), roots as (select check_id, min(parent) as drawing_id from e group by all), {WALK},
visits as (select check_id, c as parent, d + 1 as depth from walk where entered)
select e.check_id, e.ord as item_id, case when depth < 50 then mark is not null end as on_path, depth::int as depth from (select distinct check_id, parent, child, ord from e) e join visits v on e.check_id = v.check_id and e.parent = v.parent
 left join (select distinct check_id, p, c, mark from walk where mark is not null) m on m.check_id = e.check_id and m.p = e.parent and m.c = e.child""")
def j21_walk_flags(spark, sf_dir):
    """J21, J22 as the walk of each check sees them, in checks of 60 drawings."""
    e = X.edges(spark, sf_dir).withColumn("check_id", F.floor(F.col("parent") / 60))
    e = e.withColumn("child", F.col("check_id") * 60 + F.col("child") % 60).withColumn("item_id", F.col("parent") * 1_000_000 + F.col("child")).distinct()
    return graph.walk_flags(e, e.groupBy("check_id").agg(F.min("parent").alias("drawing_id")))


@query(X.ctes("edges") + " select distinct check_id, parent * 1000000 + child as item_id from edges join (select distinct l_orderkey as d from lineitem where l_orderkey % 9 = 0) on child = d")
def j22_child_failure_flag(spark, sf_dir):
    e = X.edges(spark, sf_dir).withColumn("item_id", F.col("parent") * 1_000_000 + F.col("child"))
    states = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("drawing_id")).agg(F.count(F.lit(1)).alias("rows_count")).withColumn("status", F.when(F.col("drawing_id") % 9 == 0, "failed").otherwise("ok"))
    return graph.child_failures(e, states)


@query(ITEMS + f""", e as (select i.check_id, i.drawing_id as parent, x.drawing_id as child, row_index * 1048576 + row_number() over (partition by i.check_id, i.drawing_id, row_index order by x.drawing_id) as ord, row_index
  from items i join exact x on i.check_id = x.check_id and i.code = x.code and i.name = x.name where match_status = 'exists' and (i.check_id, x.drawing_id) in (select (check_id, drawing_id) from bom_rows)),
roots as (select distinct check_id, drawing_id from bom_rows where drawing_id < 400 or drawing_id % 40 = 0), {WALK},
visits as (select check_id, c as drawing_id, d + 1 as depth from walk where entered),
marked as (select e.check_id, parent as drawing_id, row_index, bool_or(mark = 'self') as is_self, bool_or(mark = 'path') as is_path from e join walk w on e.check_id = w.check_id and parent = p and child = c and mark is not null group by all)
select j.check_id, j.drawing_id, j.row_index, j.code, j.match_status, depth::int as depth, coalesce(is_self, false) as is_self, coalesce(is_path, false) as is_path, depth >= 50 as is_deep,
  case when depth >= 50 or is_self or is_path then 'review' else extraction_status end as extraction_status
from judged j join visits v on j.check_id = v.check_id and j.drawing_id = v.drawing_id left join marked m on m.check_id = j.check_id and m.drawing_id = j.drawing_id and m.row_index = j.row_index""")
def k2_kit_check_manual(spark, sf_dir):
    """K2: items of what the first orders and every fortieth reach in each check, with their marks."""
    rows = X.bom_rows(spark, sf_dir)
    roots = rows.where("drawing_id < 400 or drawing_id % 40 = 0").select("check_id", "drawing_id").distinct()
    got, reached = jobs.kit_check_manual(rows, X.files(spark, sf_dir), roots)
    says = lambda mark: F.contains("extraction_issue", F.lit(graph.MARKS[mark]))
    got = got.join(reached, ["check_id", "drawing_id"])
    return got.select("check_id", "drawing_id", "row_index", "code", "match_status", "depth", says("self").alias("is_self"), says("path").alias("is_path"), says("depth").alias("is_deep"), "extraction_status")


@query(ITEMS + """, ed as (select check_id, drawing_id, row_index, code, name from judged where drawing_id % 5 = 0 and row_index = 1),
hit as (select distinct ed.drawing_id, ed.check_id from ed join view v on ed.check_id = v.check_id and kind = 'drawing' and stem in (lower(code), lower(code || '-' || name), lower(code || '_' || name), lower(code || ' ' || name))),
near as (select distinct ed.drawing_id, ed.check_id from ed join view v on ed.check_id = v.check_id and kind = 'drawing' and split_part(replace(replace(stem, '-', ' '), '_', ' '), ' ', 1) = lower(code) and length(stem) > length(code) + 1)
select j.check_id, j.drawing_id, j.row_index, case when ed.code is null then note else '' end as note, case when ed.code is null then '-' else note end as original,
  case when ed.code is null then match_status when hit.drawing_id is not null then 'exists' when near.drawing_id is not null then 'candidate' else 'missing' end as match_status
from judged j left join ed on j.check_id = ed.check_id and j.drawing_id = ed.drawing_id and j.row_index = ed.row_index left join hit on ed.check_id = hit.check_id and ed.drawing_id = hit.drawing_id left join near on ed.check_id = near.check_id and ed.drawing_id = near.drawing_id""")
def k3_rematch_edited(spark, sf_dir):
    """K3, U4: the first row of every fifth drawing without its note, matched anew."""
    own = items(spark, sf_dir).withColumns({"id": F.xxhash64("drawing_id", "row_index"), "edited": F.lit(False), "original": F.lit(None).cast("struct<code:string,name:string,note:string,quantity:string>")})
    patch = own.where("drawing_id % 5 = 0 and row_index = 1").select("id", F.lit("").alias("note"))
    got, _ = jobs.rematch_edited(own, patch, X.files(spark, sf_dir))
    return got.select("check_id", "drawing_id", F.col("row_index").cast("long").alias("row_index"), "note", F.when(F.col("original").isNull(), "-").otherwise(F.col("original.note")).alias("original"), "match_status")


@query(X.ctes("bom_rows") + ",\n" + """base as (select drawing_id, code, arg_max(quantity, (page_number, pos)) as q, arg_max(note, (page_number, pos)) as n from bom_rows group by all)
select b.drawing_id, b.pos, b.code, case when b.pos % 2 = 0 then q else b.quantity end as quantity, case when b.pos % 2 = 0 then n else b.note end as note from bom_rows b join base on b.drawing_id = base.drawing_id and b.code = base.code where not (b.pos % 2 = 1 and (b.note = '')) or true""")
def j13_row_source_coalesce(spark, sf_dir):
    rows = X.bom_rows(spark, sf_dir)
    blanked = rows.withColumns({c: F.when(F.col("pos") % 2 == 0, "").otherwise(F.col(c)) for c in ("quantity", "note")})
    got = bom.coalesce_sources(blanked.withColumn("note", F.when((F.col("pos") % 2 == 1) & (F.col("note") == ""), F.lit("-")).otherwise(F.col("note"))), rows)
    return got.select("drawing_id", F.col("pos").cast("long").alias("pos"), "code", "quantity", F.when(F.col("note") == "-", "").otherwise(F.col("note")).alias("note"))


@query(X.ctes("bom_rows") + ",\n" + """r as (select *, case when page_number = 1 then 'pdf_text' else 'ocr_text' end as source from bom_rows), b as (select drawing_id, max(source) as best from r group by all)
select r.drawing_id, pos, source from r join b on r.drawing_id = b.drawing_id and source = best""")
def u8_prefer_first_source(spark, sf_dir):
    rows = X.bom_rows(spark, sf_dir).withColumn("source", F.when(F.col("page_number") == 1, "pdf_text").otherwise("ocr_text"))
    return bom.prefer_first_source(rows, {"pdf_text": 1, "ocr_text": 2}).select("drawing_id", F.col("pos").cast("long").alias("pos"), "source")


@query(X.ctes("bom_rows") + ",\n" + """m as (select drawing_id, count(distinct (sequence_no, code, name, note, quantity)) as n from bom_rows group by all),
o as (select o_orderkey as drawing_id, 1 + o_orderkey % 12 as t, least(1 + o_orderkey % 12, o_orderkey % 11) as p, o_orderkey % 3 = 0 as h, o_orderkey % 2 = 0 as f, o_orderkey % 7 as r, (o_orderkey % 4 = 0)::int as i from orders),
x as (select o.*, coalesce(n, 0) as n from o left join m on o.drawing_id = m.drawing_id),
y as (select *, case when n > 0 then case when t > p or i > 0 then 'partial' else 'ok' end when h then 'failed' when t > p or i > 0 then 'partial' else 'no_table' end as base from x)
select drawing_id, n as rows, n as valid, case when n = 0 and f and r = 0 then 'failed' when n = 0 and not f then 'failed' when base = 'no_table' and t > 10 then 'partial' when base = 'ok' and t > p then 'partial' else base end as status from y""")
def f52_extraction_status(spark, sf_dir):
    k = F.col("o_orderkey")
    pages = X.table(spark, sf_dir, "orders").select(k.alias("drawing_id"), (1 + k % 12).alias("pages_total"), (k % 11).alias("pages_processed"), (k % 3 == 0).alias("has_table"), (k % 2 == 0).alias("focused"), (k % 7).alias("pages_read"), (k % 4 == 0).cast("int").alias("issues"))
    return bom.drawing_status(bom.merge_duplicates(X.bom_rows(spark, sf_dir)), pages)


@query(f"""with {CHECKS}, e as (select check_id, drawing_id, status from visits) select check_id, drawing_id, case when status = 'processed' and drawing_id % 3 = 0 then 'failed' else status end as status, case when status = 'processed' and drawing_id % 3 = 0 then 1 else 0 end as issues from e""")
def a3_recorded_status(spark, sf_dir):
    """Section 2.11: the recorded status of an extraction."""
    _, visits, _, _ = check_tables(spark, sf_dir)
    rows = visits.withColumns({"status": F.when(F.col("status") == "processed", "ok").otherwise(F.col("status")), "rows_count": F.when(F.col("drawing_id") % 3 == 0, 0).otherwise(2), "issues": F.array().cast("array<string>")})
    return verdict.recorded_status(rows).select("check_id", "drawing_id", "status", F.size("issues").alias("issues"))


REASONS = {k: v for k, v in match.REASONS.items()}
LABELLED = "case match_status when 'exists' then '存在' when 'missing' then '不存在' when 'candidate' then '待复核' when 'exempt' then '免查' else '未检查' end"


@query(ITEMS + f""", gone as (select check_id, string_agg(distinct case kind when 'temp' then '{REASONS["temp"]}' else '{REASONS["model"]}' end, '；' order by case kind when 'temp' then '{REASONS["temp"]}' else '{REASONS["model"]}' end) as reasons from view where kind <> 'drawing' group by all),
said as (select j.*, concat_ws('；', case when clash then '{bom.CONFLICT}' end, case when odd then '{REASONS["note"]}' end, case when match_status = 'candidate' then '{REASONS["candidate"]}' end, case when match_status = 'missing' and note <> '标准件' then reasons end) as issue from judged j left join gone g on j.check_id = g.check_id),
cells as (select check_id, 2 as part, drawing_id, page_number, row_index, concat_ws(',', cast(drawing_id as varchar), '', cast(page_number as varchar), cast(row_index as varchar), sequence_no, code, name, note, quantity, {LABELLED}, coalesce(matched, ''), coalesce(maybe, ''), case extraction_status when 'ok' then '正常' else '待复核' end, issue, concat_ws(' ', code, name, nullif(note, ''), quantity), '否') as line from said),
tail as (select distinct check_id, 3 as part, drawing_id, 0 as page_number, 0 as row_index, cast(drawing_id as varchar) || ',,,,,,,,,,,,,open,,' as line from said where match_status = 'missing')
select check_id, part, drawing_id, row_number() over (partition by check_id, part, drawing_id order by page_number, row_index) as n, line from (select * from cells union all select * from tail)""")
def s11_kit_csv_export(spark, sf_dir):
    """Every line of items and issues, in its place."""
    from pyspark.sql.window import Window

    own = settled(items(spark, sf_dir))
    sums = own.groupBy("check_id").agg(*verdict.item_counts())
    issues = own.where("match_status = 'missing'").select("check_id", "drawing_id", F.lit("open").alias("issues")).distinct()
    lines = S.kit_csv_lines(sums, own, issues).where("part >= 2")
    place = F.row_number().over(Window.partitionBy("check_id", "part", "ord.a").orderBy("ord"))
    return lines.select("check_id", "part", F.col("ord.a").alias("drawing_id"), place.cast("long").alias("n"), "line")


@query(ITEMS + " select match_status, case match_status when 'exists' then '存在' when 'missing' then '不存在' when 'candidate' then '待复核' when 'exempt' then '免查' end as label, count(*) as n from judged group by all")
def f7_status_labels(spark, sf_dir):
    return items(spark, sf_dir).groupBy("match_status", label("match", F.col("match_status")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(ITEMS + " select check_id, drawing_id, row_index from judged where not is_exempt and (extraction_status <> 'ok' or match_status = 'candidate')")
def p8_review_predicate(spark, sf_dir):
    return items(spark, sf_dir).where(match.needs_review()).select("check_id", "drawing_id", F.col("row_index").cast("long").alias("row_index"))


@query(ITEMS + " select check_id, code, name, '/drawings/' || drawing_id || '/preview' as preview_url, '/uploads/' || replace(f, ' ', '%20') as file_url from exact")
def f50_match_links(spark, sf_dir):
    rows = match.match_status(jobs.prepare_rows(X.bom_rows(spark, sf_dir)).where("not (note = '标准件' and extraction_status = 'ok')"), X.files(spark, sf_dir)).where("matches is not null")
    got = rows.select("check_id", F.upper("code").alias("code"), "name", F.inline(match.match_links(F.col("matches")))).distinct()
    return got.select("check_id", "code", "name", "preview_url", "file_url")


@query(X.ctes("bom_rows") + """ select drawing_id, pos, code, quantity from bom_rows where drawing_id % 10 > 0 union all select drawing_id, 1, min(code), cast(count(*) as varchar) from bom_rows where drawing_id % 10 = 0 group by all""")
def u10_replace_group(spark, sf_dir):
    """The rows of every tenth drawing give way to a single one, in a table with buckets by drawing."""
    from ..operators import buckets
    from ..shared import shared_path

    path, key = shared_path(spark), ["drawing_id"]
    rows = X.bom_rows(spark, sf_dir).select("drawing_id", F.col("pos").cast("long").alias("pos"), "code", "quantity")
    new = rows.where("drawing_id % 10 = 0").groupBy("drawing_id").agg(F.lit(1).cast("long").alias("pos"), F.min("code").alias("code"), F.count(F.lit(1)).cast("string").alias("quantity"))
    buckets.create(rows, path, key)
    buckets.change(spark, path, rows.schema, key, new, buckets.replace(key))
    return buckets.read(spark, path, rows.schema)
