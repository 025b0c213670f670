"""Geometry of blocks and what layout models give, over derived boxes, BOM tables laid out as blocks, and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import boxes as B
from ..operators import geometry, layout
from ..plans import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def blocks(spark, sf_dir):
    """boxes as blocks: drawing_id is the page."""
    return X.boxes(spark, sf_dir).select(F.col("page").alias("drawing_id"), F.lit(1).alias("page"), F.col("pos").cast("int").alias("pos"), "text", "x", "y", "w", "h", "confidence")


COLUMNS = ["序号", "代号", "名称", "数量", "备注"]


PAGE_ROWS = 15
LAID = f"laid as (select *, (pos - 1) // {PAGE_ROWS} + 1 as page, (pos - 1) % {PAGE_ROWS} + 1 as r from bom_rows)"


def table_blocks(spark, sf_dir):
    """The BOM rows of an order, laid out above a header, 15 to a page: columns 0.15 apart, rows 0.02 apart."""
    rows = X.bom_rows(spark, sf_dir).withColumns({"page": F.floor((F.col("pos") - 1) / PAGE_ROWS).cast("int") + 1, "r": (F.col("pos") - 1) % PAGE_ROWS + 1})
    cell = lambda r, i, text: F.struct(r.cast("long").alias("r"), F.lit(i).alias("c"), text.alias("t"))
    body = F.array(*(cell(F.col("r"), i, F.col(n)) for i, n in enumerate(["sequence_no", "code", "name", "quantity", "note"])))
    # The header comes with the first row, which each page has.
    head = F.when(F.col("r") == 1, F.array(*(cell(F.lit(0), i, F.lit(n)) for i, n in enumerate(COLUMNS))))
    both = rows.select("drawing_id", "page", F.inline(F.concat(F.coalesce(head, F.array().cast("array<struct<r:bigint,c:int,t:string>>")), body))).where("t <> ''")
    return both.select("drawing_id", "page", (F.col("r") * 10 + F.col("c")).cast("int").alias("pos"), F.col("t").alias("text"), (F.col("c") * 0.15 + 0.1).alias("x"), (0.6 - F.col("r") * 0.02).alias("y"), F.lit(0.04).alias("w"), F.lit(0.01).alias("h"), F.lit(0.9).alias("confidence"))


@query(X.ctes("bom_rows") + " select drawing_id, pos, sequence_no, code, name, quantity, note from bom_rows")
def g3_table_reconstruct(spark, sf_dir):
    """Rows laid out as blocks and read back. Row 1 of a page is the lowest, so it comes last."""
    rows, _ = geometry.tables(table_blocks(spark, sf_dir))
    r = F.round((0.6 - F.col("y")) / 0.02).cast("long")
    return rows.select("drawing_id", ((F.col("page_number") - 1) * PAGE_ROWS + r).alias("pos"), "sequence_no", "code", "name", "quantity", "note")


@query(X.ctes("bom_rows") + f", {LAID}, m as (select drawing_id, sequence_no, code, name, note, quantity, min(page * 100 - r) as o from laid group by all) select drawing_id, row_number() over (partition by drawing_id order by o) as row_index, code from m")
def k6_bom_from_blocks(spark, sf_dir):
    """K6, G7, W3, P7, A8, A9."""
    rows, _ = jobs.bom_from_blocks(table_blocks(spark, sf_dir))
    return rows.select("drawing_id", F.col("row_index").cast("long").alias("row_index"), "code")


@query(X.ctes("boxes") + " select page as drawing_id, round(min(x), 6) as x, round(min(y), 6) as y, round(max(x + w) - min(x), 6) as w, round(max(y + h) - min(y), 6) as h from boxes group by all")
def a10_bbox_union(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("drawing_id").agg(*B.union_box())


@query(X.ctes("boxes") + """ select page as drawing_id, '第 1 页' || chr(10) || string_agg(text, chr(10) order by y + h / 2, x + w / 2, pos) as text from boxes group by all""")
def t10_reading_order(spark, sf_dir):
    return geometry.reading_order(blocks(spark, sf_dir)).select("drawing_id", "text")


BLOCKS_IN_ORDER = "b as (select page, pos, text, x, y, w, h, row_number() over (partition by page order by y + h / 2, x + w / 2, pos) as i, y + h / 2 as cy from boxes)"


@query(X.ctes("boxes") + f""", {BLOCKS_IN_ORDER},
f as (select page, pos, i, 0 as g, 1::bigint as n, cy as t from b where i = 1 union all
  select b.page, b.pos, b.i, case when abs(b.cy - f.t / f.n) <= 0.014 then f.g else f.g + 1 end, case when abs(b.cy - f.t / f.n) <= 0.014 then f.n + 1 else 1 end, case when abs(b.cy - f.t / f.n) <= 0.014 then f.t + b.cy else b.cy end
  from f join b on b.page = f.page and b.i = f.i + 1)
select page as drawing_id, pos::int as pos, g as group_id from f""")
def w6_y_clustering(spark, sf_dir):
    """W6."""
    return geometry.y_clusters(blocks(spark, sf_dir), 0.014).select("drawing_id", "pos", "group_id")


def greedy_sql(order: str, by: str, least: float) -> str:
    """J16, J17 block by block: the list of what stayed goes along."""
    shared = "greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))"
    ratio = by.format(s=shared)
    return f"""{X.ctes("boxes")}, b as (select *, row_number() over (partition by page, text order by {order}) as i from boxes),
f as (select page, text, i, pos, true as stays, [{{'x': x, 'y': y, 'w': w, 'h': h}}] as kept from b where i = 1 union all
  select b.page, b.text, b.i, b.pos, len(list_filter(f.kept, lambda k: {ratio} >= {least})) = 0, case when len(list_filter(f.kept, lambda k: {ratio} >= {least})) = 0 then list_append(f.kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) else f.kept end
  from f join b on b.page = f.page and b.text = f.text and b.i = f.i + 1)
select page as drawing_id, pos::int as pos, text from f where stays"""


@query(greedy_sql("y, x, pos", "{s} / (k.w * k.h + b.w * b.h - {s})", 0.8))
def j16_iou_dedup(spark, sf_dir):
    """J16."""
    return geometry.iou_dedup(blocks(spark, sf_dir)).select("drawing_id", "pos", "text")


@query(greedy_sql("pos", "{s} / least(k.w * k.h, b.w * b.h)", 0.6))
def j17_overlap_dedup(spark, sf_dir):
    """J17."""
    return geometry.overlap_dedup(blocks(spark, sf_dir)).select("drawing_id", "pos", "text")


@query("select user_id as drawing_id, 'AB.' || lpad(cast(max(event_id) as varchar), 6, '0') as code, case when max(event_id) % 10 >= 5 then '外框' else '' end as name from events group by all")
def g5_title_region(spark, sf_dir):
    """A page per user with codes at the bottom and a name above the lowest, sure in half of the cases."""
    users = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("drawing_id")).agg(F.max("event_id").alias("k"))
    code = F.concat(F.lit("AB."), F.lpad(F.col("k").cast("string"), 6, "0"))
    cells = [("code", code, 0.90, 0.92, F.lit(0.9)), ("other", F.lit("CD.0001"), 0.60, 0.80, F.lit(0.9)), ("name", F.lit("外框"), 0.90, 0.88, F.when(F.col("k") % 10 >= 5, 0.9).otherwise(0.5)), ("label", F.lit("材料"), 0.90, 0.90, F.lit(0.99)), ("far", F.lit("远处"), 0.60, 0.88, F.lit(0.99))]
    own = F.array(*(F.struct(F.lit(i).alias("pos"), t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.04).alias("w"), F.lit(0.02).alias("h"), c.cast("double").alias("confidence")) for i, (_, t, x, y, c) in enumerate(cells)))
    return geometry.title_regions(users.select("drawing_id", F.lit(1).alias("page"), F.inline(own))).select("drawing_id", "code", "name")


@query("select user_id as drawing_id, '技术要求 ' || min(event_id) as text, 0.1::double as x, 0.2::double as y from events group by all")
def g6_tech_region(spark, sf_dir):
    users = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("drawing_id")).agg(F.min("event_id").alias("k"))
    own = users.select("drawing_id", F.lit(1).alias("page"), F.lit(0).alias("pos"), F.concat(F.lit("技术要求 "), F.col("k").cast("string")).alias("text"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("w"), F.lit(0.1).alias("h"), F.lit(1.0).alias("confidence"))
    return geometry.tech_regions(own).select("drawing_id", "text", "x", "y")


SIZED = "p as (select o_orderkey as k, (1000 + o_orderkey % 9 * 700)::int as w, (900 + o_orderkey % 40 * 120)::int as h from orders)"


def sized_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select(k.alias("drawing_id"), (1000 + k % 9 * 700).cast("int").alias("width"), (900 + k % 40 * 120).cast("int").alias("height"))


@query(f"""with {SIZED}, xs as (select k, unnest(list_distinct(list_append(range(0, greatest(w - 2000, 0) + 1, 1680), greatest(w - 2000, 0)))) as x0 from p), ys as (select k, unnest(list_distinct(list_append(range(0, greatest(h - 2000, 0) + 1, 1680), greatest(h - 2000, 0)))) as y0 from p)
select p.k as drawing_id, x0::int as x0, y0::int as y0, least(x0 + 2000, w)::int as x1, least(y0 + 2000, h)::int as y1 from p join xs on p.k = xs.k join ys on p.k = ys.k""")
def g8_tile_grid(spark, sf_dir):
    """Every tile."""
    return geometry.tile_grid(sized_pages(spark, sf_dir), 2000).select("drawing_id", "x0", "y0", "x1", "y1")


@query(f"""with {SIZED}, z as (select * from (values ('title', 0.55, 0.7, 1.0, 1.0, true, true), ('tech_left', 0.0, 0.45, 0.5, 1.0, false, true), ('tech_right', 0.5, 0.0, 1.0, 0.6, true, false), ('tech_top', 0.0, 0.0, 0.5, 0.55, false, false)) t(zone, a, b, c, d, r, u)),
q as (select k, zone, r, u, round(a * w)::int as x0, round(b * h)::int as y0, round(c * w)::int as x1, round(d * h)::int as y1 from p cross join z)
select k as drawing_id, zone, case when r then greatest(x0, x1 - 2200) else x0 end as x0, case when u then greatest(y0, y1 - 2200) else y0 end as y0, case when r then x1 else least(x1, x0 + 2200) end as x1, case when u then y1 else least(y1, y0 + 2200) end as y1 from q""")
def g9_candidate_zones(spark, sf_dir):
    """Every zone's box."""
    return geometry.candidate_zones(sized_pages(spark, sf_dir)).select("drawing_id", "zone", "x0", "y0", "x1", "y1")


@query(X.ctes("boxes") + " select page as drawing_id, pos, round((1000 + x * 500) / 4000, 8) as px0, round((200 + y * 400) / 3000, 8) as py0 from boxes where text <> 'click'")
def g10_tile_to_page(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumns({"tile_id": F.lit(1), "x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h"), "text": F.when(F.col("text") == "click", "[no text]").otherwise(F.col("text"))})
    tiles = X.table(spark, sf_dir, "region").limit(1).select(F.lit(1).alias("tile_id"), F.lit(1000).alias("tx0"), F.lit(200).alias("ty0"), F.lit(1500).alias("tx1"), F.lit(600).alias("ty1"), F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    return geometry.tiles_to_page(rows, tiles).select("drawing_id", F.col("pos").cast("long").alias("pos"), "px0", "py0")


@query(X.ctes("boxes") + " select page as drawing_id, pos, round(x, 8) as x, round(y, 8) as y, round(x + w - x, 8) as w from boxes")
def g1_polygon_to_bbox(spark, sf_dir):
    point = lambda x, y: F.struct((x * 1000).alias("px"), (y * 800).alias("py"))
    x, y, w, h = (F.col(c) for c in "xywh")
    rows = blocks(spark, sf_dir).withColumns({"points": F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)), "page_width": F.lit(1000.0), "page_height": F.lit(800.0)}).drop("x", "y", "w", "h")
    return geometry.polygons_to_blocks(rows).select("drawing_id", F.col("pos").cast("long").alias("pos"), F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), F.round("w", 8).alias("w"))


@query(X.ctes("boxes") + """, s as (select page as drawing_id, event_id % 2 as orientation, round(sum(confidence), 6) as score from (select *, pos as event_id from boxes) group by all),
f as (select *, case when orientation = 0 and score >= 8 then 1e9 else score end as k from s)
select drawing_id, arg_max(orientation, (k, -orientation)) as orientation, max(score) filter (k = mk) as score from (select *, max(k) over (partition by drawing_id) as mk from f) group by drawing_id""")
def a15_block_quality_score(spark, sf_dir):
    scans = blocks(spark, sf_dir).withColumn("orientation", F.col("pos") % 2)
    return geometry.best_orientation(scans).select("drawing_id", F.col("orientation").cast("long").alias("orientation"), "score")


@query("select event_id, 'T' || event_id || ' | ' || event_type || chr(10) || 'a<b | ' || user_id as text from events")
def f34_html_table_text(spark, sf_dir):
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    table = F.concat(F.lit("<table><tr><th>T"), k, F.lit("</th><td>"), "event_type", F.lit("</td></tr><TR><td>a&lt;b</td><td> "), u, F.lit("</td></tr></table>"))
    return X.table(spark, sf_dir, "events").select("event_id", layout.html_table_text(table).alias("text"))


@query("select event_id, event_type || chr(10) || '正常 ' || event_id as text from events")
def f35_plain_markdown(spark, sf_dir):
    md = F.concat(F.lit("## "), "event_type", F.lit("\n![x](y.png)\n\n\n- 正常 "), F.col("event_id").cast("string"))
    return X.table(spark, sf_dir, "events").select("event_id", layout.plain_markdown(md).alias("text"))


def payloads(spark, sf_dir):
    """A layout payload per web page: a title, its address as text, a table, requirements and an item."""
    k = F.col("page_id").cast("string")
    item = lambda kind, text, y, page: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.array(F.lit(0.1), F.lit(y), F.lit(0.5), F.lit(y + 0.05)).alias("bbox"), F.lit(page).alias("page_idx"))
    own = F.array(item("title", F.concat(F.lit("T"), k), 0.05, 0), item("text", F.col("url"), 0.1, 0), item("table", F.concat(F.lit("图号 A-1-"), k, F.lit(" 材料 45")), 0.8, 0), item("text", F.lit("技术要求："), 0.2, 1), item("text", F.concat(F.lit("1. 倒角 "), k), 0.26, 1), item("image", F.lit(""), 0.4, 1))
    body = F.to_json(F.struct(F.struct(F.struct(own.alias("content_list")).alias("doc")).alias("results")))
    return X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("drawing_id"), body.alias("payload"))


@query("select page_id as drawing_id, unnest([0, 0, 0, 1, 1, 1]) as page_idx, unnest(['title', 'text', 'table', 'text', 'text', 'image']) as type, unnest(['T' || page_id, trim(url), '图号 A-1-' || page_id || ' 材料 45', '技术要求：', '1. 倒角 ' || page_id, '']) as content, unnest([0.05, 0.1, 0.8, 0.2, 0.26, 0.4]::double[]) as y0 from pages")
def s8_layout_json_source(spark, sf_dir):
    """S8, F36, F37, G12."""
    return layout.layout_blocks(payloads(spark, sf_dir)).select("drawing_id", "page_idx", "type", "content", "y0")


@query("select page_id as drawing_id, '图号 A-1-' || page_id || ' 材料 45' as title_text, '1. 倒角 ' || page_id as tech_text, 'head' || chr(10) || chr(10) || 'T' || page_id || chr(10) || chr(10) || trim(url) || chr(10) || chr(10) || '图号 A-1-' || page_id || ' 材料 45' || chr(10) || chr(10) || '技术要求：' || chr(10) || chr(10) || '1. 倒角 ' || page_id as all_text from pages")
def k12_layout_ingest(spark, sf_dir):
    """K12, J18, A19, F38, F39, F40, F41."""
    own = payloads(spark, sf_dir)
    return jobs.layout_ingest(own, own.select("drawing_id", F.lit("head").alias("markdown")))


@query("select page_id as drawing_id, '# T' || page_id || chr(10) || chr(10) || trim(url) || chr(10) || chr(10) || '图号 A-1-' || page_id || ' 材料 45' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '技术要求：' || chr(10) || chr(10) || '1. 倒角 ' || page_id as markdown from pages")
def f55_block_markdown(spark, sf_dir):
    return layout.block_markdown(layout.layout_blocks(payloads(spark, sf_dir)))


@query("select page_id as drawing_id, 'a ' || page_id || chr(10) || chr(10) || '2. b' as tech_text from pages")
def f39_tech_section(spark, sf_dir):
    k = F.col("page_id").cast("string")
    md = F.concat(F.lit("# x\n## 技术要求 a "), k, F.lit("\n\n2. b\n\nother\n3. c\n## y\nz"))
    return layout.tech_sections(X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("drawing_id"), md.alias("markdown")))


@query("select conv_id as drawing_id, string_agg('第 ' || turn || ' 页' || chr(10) || trim(text, E' \\n\\t\\r'), chr(10) || chr(10) order by turn) as all_text, count(*) as pages_processed from conversations where trim(text, E' \\n\\t\\r') <> '' group by all")
def a11_page_rollup(spark, sf_dir):
    pages = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("drawing_id"), F.col("turn").cast("int").alias("page"), F.lit("").alias("title_text"), F.lit("").alias("tech_text"), F.col("text").alias("all_text"), F.lit("h").alias("layout"), F.array().cast("array<string>").alias("warnings"))
    return layout.page_rollup(pages).select("drawing_id", "all_text", F.col("pages_processed").cast("long").alias("pages_processed"))


@query("select conv_id as drawing_id, string_agg(case when turn = 0 then '[整页]' else '[局部 ' || turn || '_1]' end || chr(10) || trim(text, E' \\n\\t\\r'), chr(10) || chr(10) order by turn) as text from conversations where trim(text, E' \\n\\t\\r') <> '' group by all")
def f44_view_text_labels(spark, sf_dir):
    views = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("drawing_id"), F.lit(1).alias("page"), F.col("turn").alias("view"), F.when(F.col("turn") > 0, F.col("turn").cast("int")).alias("x"), F.lit(1).alias("y"), "text")
    return layout.view_labels(views).select("drawing_id", "text")


@query()
def k13_scan_ingest(spark, sf_dir):
    """K13. Tested on a small page."""
    return jobs.scan_ingest(blocks(spark, sf_dir)).select("drawing_id", "title_text", "tech_text", "all_text")


@query(X.ctes("bom_rows") + f", {LAID} select drawing_id, count(distinct page)::int as tables, '' as title_code, '' as issues from laid group by all")
def g7_scan_to_bom(spark, sf_dir):
    """What the pages of each drawing say of its table."""
    _, heads = geometry.scan_to_bom(table_blocks(spark, sf_dir))
    return heads.select("drawing_id", F.col("tables").cast("int").alias("tables"), "title_code", "issues")


@query(X.ctes("bom_rows") + f", {LAID} select drawing_id, (5 * count(distinct page))::int as headers, sum(4 + (note <> '')::int) + 5 * count(distinct page) as blocks from laid group by all")
def g4_is_header_block(spark, sf_dir):
    return table_blocks(spark, sf_dir).groupBy("drawing_id").agg(F.count_if(geometry.is_header_block()).cast("int").alias("headers"), F.count(F.lit(1)).alias("blocks"))


@query(X.ctes("boxes") + """, p as (select a.pos, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as s, a.w * a.h as aa, b.w * b.h as bb from boxes a join boxes b on b.pos = a.pos + 1)
 select pos, round(s / (aa + bb - s), 6) as iou, round(s / least(aa, bb), 6) as ratio from p""")
def g11_iou(spark, sf_dir):
    """Each box against the next one."""
    a, b = blocks(spark, sf_dir).alias("a"), blocks(spark, sf_dir).alias("b")
    pairs = a.join(b, F.col("b.pos") == F.col("a.pos") + 1)
    return pairs.select(F.col("a.pos").cast("long").alias("pos"), F.round(B.iou(B.box("a"), B.box("b")), 6).alias("iou"), F.round(B.overlap_ratio(B.box("a"), B.box("b")), 6).alias("ratio"))
