"""Blocks on pages: tables, titles and requirements from where texts stand.

blocks: drawing_id, page, pos, text, x, y, w, h, confidence. A page's blocks are put in the order of their centres by one
shuffle; headers, columns and cells are then worked out for many pages at a time, from numbers. A page is small, and pages
are spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes as B
from ..functions import text as T
from ..shared import once, settled

#: Columns, labels and words of title blocks.
HEADER_KEYS = ["序号", "代号", "名称", "数量", "备注"]
OPTIONAL_COLUMNS = ["材料", "单重", "总重"]
HEADER_LABELS = [*HEADER_KEYS, *OPTIONAL_COLUMNS, "比例", "重量", "图号"]
NOT_NAMES = ["装配件", "阶段标记", "更改文件号 签名", "年月日", "处数", "分区", "标记", "设计", "校核", "工艺", "审核", "批准", "标准化", "替代", "共张第张版本", "主管设计", "比例", "重量", "签字", "日期", "材料", "单重", "总重", "签名", "标记处数"]
NUMERIC = r"^-?\d+(?:\.\d+)?$"
PAGE = ["drawing_id", "page"]


def with_centers(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"cx": B.center(F.col("x"), F.col("w")), "cy": B.center(F.col("y"), F.col("h"))})


def page_arrays(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """(drawing_id, page, bs): the page's blocks in the order of (cy, cx, pos), as structs of these and the columns."""
    each = F.struct("cy", "cx", "pos", *(c for c in columns if c not in ("cy", "cx", "pos")))
    return with_centers(blocks).groupBy(*PAGE).agg(F.array_sort(F.collect_list(each)).alias("bs"))


def row_starts(bs: Column, tolerance: float) -> Column:
    """Where the rows of blocks begin, counted from 1.

    In the order of centres a block joins the open row if it is within the tolerance of that row's mean so far; so rows
    are runs. The mean moves with each block, which makes this a fold and not a window's frame.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("t"), F.array().cast("array<int>").alias("at"))

    def add(acc: Column, y: Column) -> Column:
        joins = (acc["n"] > 0) & (F.abs(y - acc["t"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        i = acc["i"] + 1
        return F.when(joins, F.struct(i.alias("i"), (acc["n"] + 1).alias("n"), (acc["t"] + y).alias("t"), acc["at"].alias("at"))).otherwise(F.struct(i.alias("i"), F.lit(1).alias("n"), (F.lit(0.0) + y).alias("t"), F.concat(acc["at"], F.array(i)).alias("at")))

    return F.aggregate(F.transform(bs, lambda b: b["cy"]), start, add, lambda acc: acc["at"])


def runs(bs: Column, starts: Column) -> Column:
    """The rows of blocks that begin where starts says, as an array of arrays."""
    return F.transform(starts, lambda at, i: F.slice(bs, at, F.coalesce(F.get(starts, i + 1), F.size(bs) + 1) - at))


def y_clusters(blocks: DataFrame, tolerance: float, out: str = "group_id") -> DataFrame:
    """Blocks with the number of their row on the page."""
    pages = page_arrays(blocks, [c for c in blocks.columns if c not in PAGE])
    rows = pages.withColumn("starts", row_starts(F.col("bs"), tolerance)).select(*PAGE, F.posexplode(runs(F.col("bs"), F.col("starts"))).alias(out, "r"))
    return rows.select(*PAGE, out, F.inline("r")).select(*blocks.columns, "cx", "cy", out)


def header_groups(blocks: DataFrame) -> DataFrame:
    """Per page the row with most column names, at least three; ties go to the first."""
    rows = y_clusters(blocks, 0.018)
    named = F.array_compact(F.array(*(F.when(F.col("text").contains(k), F.lit(k)) for k in HEADER_KEYS)))
    keys = rows.select(*PAGE, "group_id", F.explode(named).alias("key")).groupBy(*PAGE, "group_id").agg(F.count_distinct("key").alias("n"))
    best = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "group_id"))
    return keys.where("n >= 3").withColumn("rank", best).where("rank = 1").select(*PAGE, "group_id", "n")


def is_header_block(c: Column | str = "text") -> Column:
    """G4. Most blocks hold no character of a label, which one look tells."""
    some = "[" + "".join(sorted(set("".join(HEADER_LABELS)))) + "]"
    return F.when(T.text(c).rlike(some), T.clean_text(c).isin(HEADER_LABELS)).otherwise(F.lit(False))


def tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, tables). rows: drawing_id, page_number, pos, sequence_no, code, name, note, quantity, raw_text, x, y, w, h, issues.

    tables: drawing_id, page, x, y, w, h, complete: the envelope of each table, and whether all columns have names.
    """
    found = settled(table_pages(blocks))
    box = [F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in "xywh"]
    code = T.ocr_code_fix(T.normalize_code("code"))
    note = F.when(F.col("备注").rlike("[一-鿿]"), F.btrim("备注")).otherwise("")
    # The tight code has a name before it is looked at: only then no lambda binds it.
    rows = once(found.where("row_id >= 0").withColumn("code", F.regexp_replace("代号", r"\s+", "")))
    rows = rows.select("drawing_id", F.col("page").alias("page_number"), F.col("row_id").alias("pos"), F.btrim("序号").alias("sequence_no"), code.alias("code"), F.btrim("名称").alias("name"), note.alias("note"), F.btrim("数量").alias("quantity"), F.btrim("raw_text").alias("raw_text"), *box)
    rows = once(rows).where((F.col("code") != "") | ((F.col("name") != "") & F.col("quantity").rlike(NUMERIC)))
    rows = rows.withColumn("quantity", F.when(F.col("quantity").rlike(NUMERIC), F.col("quantity")).otherwise(F.regexp_extract("quantity", r"-?\d+(?:\.\d+)?", 0)))
    issues = F.array_compact(F.array(F.when(F.col("code") == "", "代号缺失").when(~T.is_valid_code("code"), "代号格式无法确认"), F.when(F.col("name") == "", "名称缺失"), F.when(F.col("quantity") == "", "数量缺失")))
    fine = (F.col("name") != "") & (F.col("quantity") != "") & T.is_valid_code("code")
    return once(rows.withColumn("issues", F.when(fine, F.array().cast("array<string>")).otherwise(issues))), found.where("row_id < 0").select(*PAGE, *box, "complete")


def table_pages(blocks: DataFrame) -> DataFrame:
    """Of each page with a table one row for the table (row_id -1: its envelope, complete) and one for each row of cells.

    Columns: drawing_id, page, row_id, raw_text, the texts under each of HEADER_KEYS, x, y, w, h, complete. Pages are dealt
    and put in the order of centres by a window, so blocks that come dealt by drawing aren't shuffled; tasks then read
    many pages at a time.
    """
    order = Window.partitionBy(*PAGE).orderBy("cy", "cx", "pos", "text", "x", "y", "w", "h")
    placed = with_centers(blocks.select(*PAGE, "pos", "text", *(F.col(c).cast("double") for c in "xywh"))).withColumn("at", F.row_number().over(order))
    odd = F.when(~F.col("text").rlike(T.CLEAN), T.clean_text("text"))
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema if f.name in PAGE}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in PAGE] + ["row_id int", "raw_text string"] + [f"`{k}` string" for k in HEADER_KEYS] + [f"{c} double" for c in "xywh"] + ["complete boolean"])
    return placed.select(*PAGE, "at", F.col("pos").cast("long").alias("pos"), "text", odd.alias("odd"), *"xywh").mapInArrow(read_tables(PAGE, HEADER_KEYS, OPTIONAL_COLUMNS, HEADER_LABELS), ddl)


def read_tables(page_key: list[str], header_keys: list[str], more_keys: list[str], labels: list[str]):
    """A function of batches of placed blocks, for table_pages(): all pages of a batch at once, as arrays.

    A18: a page's header is its row with most column names, at least three, the first of equal ones. Its window reaches
    from 0.35 above the header to 0.08 below it, and 0.07 beyond the outer columns. J14: a cell belongs to the column
    whose middle is nearest, ties by order, up to 0.075 away.
    """

    keys = [*header_keys, *more_keys]
    n_keys = len(keys)

    def starts(y: np.ndarray, first: np.ndarray, tolerance: float) -> np.ndarray:
        """W6, as row_starts(): whether each block begins a row; first: whether it begins a page."""
        out, n, t = [], 1, 0.0
        for v, f in zip(y.tolist(), first.tolist(), strict=True):
            joins = not f and abs(v - t / n) <= tolerance
            n, t = (n + 1, t + v) if joins else (1, v)
            out.append(not joins)
        return np.array(out, dtype=bool)

    def changes(x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]))

    def joined(texts: pa.Array, row: np.ndarray, n: int) -> pa.Array:
        at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), texts), " ")

    def records(t: pa.Table, at: np.ndarray, member: np.ndarray, group: np.ndarray, sides: dict, texts: list, complete: np.ndarray, row_id: np.ndarray) -> pa.RecordBatch:
        """One record for each group of the members; at: where the groups' first blocks are."""
        begin = np.flatnonzero(changes(group))
        low = {c: np.fmin.reduceat(sides[c][member], begin) for c in "xy"}
        size = {n: np.fmax.reduceat((sides[c] + sides[n])[member], begin) - low[c] for c, n in ("xw", "yh")}
        box = [pa.array(v, pa.float64(), from_pandas=True) for v in (low["x"], low["y"], size["w"], size["h"])]
        ids = [t[c].take(pa.array(at)).combine_chunks() for c in page_key]
        return pa.RecordBatch.from_arrays([*ids, pa.array(row_id, pa.int32()), *texts, *box, pa.array(complete)], [*page_key, "row_id", "raw_text", *header_keys, "x", "y", "w", "h", "complete"])

    def read(t: pa.Table):
        get = lambda c: t[c].to_numpy()
        sides, text = {c: get(c) for c in "xywh"}, t["text"].combine_chunks()
        cx, cy = sides["x"] + sides["w"] / 2, sides["y"] + sides["h"] / 2
        clean = pc.fill_null(pc.coalesce(t["odd"].combine_chunks(), text), "")
        told = lambda a: a.fill_null(False).to_numpy(zero_copy_only=False)
        names = sum(told(pc.match_substring(text, k)).astype(np.int32) << i for i, k in enumerate(keys))
        label = told(pc.is_in(clean, value_set=pa.array(labels)))
        first = get("at") == 1
        page = np.cumsum(first) - 1
        # The header of each page.
        begins = starts(cy, first, 0.018)
        row, at = np.cumsum(begins) - 1, np.flatnonzero(begins)
        held = np.bitwise_or.reduceat(names, at)
        count = sum((held >> k) & 1 for k in range(len(header_keys)))
        order = np.lexsort((-count, page[at]))
        best = order[changes(page[at][order])]
        best = best[count[best] >= 3]
        if not len(best):
            return
        header = np.isin(row, best)
        own = np.flatnonzero(header)
        n = page[-1] + 1
        columns = np.full((n, n_keys), np.nan)
        for k in range(n_keys):
            named = own[(names[own] >> k) & 1 == 1][::-1]  # backwards, so that the first stays
            columns[page[named], k] = cx[named]
        middle = np.full(n, np.nan)
        has = page[at[best]]
        middle[has] = (np.bincount(page[own], cy[own], n) / np.maximum(np.bincount(page[own], minlength=n), 1))[has]
        x0, x1 = np.fmin.reduce(columns, axis=1) - 0.07, np.fmax.reduce(columns, axis=1) + 0.07
        # The cells around it.
        pos = t["pos"].fill_null(-1).to_numpy()
        place = page * (pos.max() - pos.min() + 1) + (pos - pos.min())
        inside = (cy >= (middle - 0.35)[page]) & (cy <= (middle + 0.08)[page]) & (cx >= x0[page]) & (cx <= x1[page]) & ~label
        inside[inside] = ~np.isin(place[inside], place[own])
        cell = np.flatnonzero(inside)
        complete = ~np.isnan(columns[:, : len(header_keys)]).any(axis=1)
        member = np.flatnonzero(header | inside)
        at = member[changes(page[member])]
        nothing = pa.nulls(len(at), pa.string())
        yield records(t, at, member, page[member], sides, [nothing] * (1 + len(header_keys)), complete[page[at]], np.full(len(at), -1))
        if not len(cell):
            return
        away = np.abs(cx[cell, None] - columns[page[cell]])
        away[np.isnan(away)] = np.inf
        key = away.argmin(axis=1)
        key[away[np.arange(len(cell)), key] > 0.075] = n_keys
        turns = changes(page[cell])
        begins = starts(cy[cell], turns, 0.013)
        row, at = np.cumsum(begins) - 1, cell[begins]
        index = np.arange(len(at))
        row_id = index - np.maximum.accumulate(np.where(turns[begins], index, 0))
        under = lambda k: joined(clean.take(pa.array(cell[key == k])), row[key == k], len(at))
        there = text.is_valid().to_numpy(zero_copy_only=False)[cell]
        raw = joined(text.take(pa.array(cell[there])), row[there], len(at))
        yield records(t, at, cell, row, sides, [raw, *map(under, range(len(header_keys)))], complete[page[at]], row_id)

    def each(batches):
        held = []
        for batch in batches:
            turns = np.flatnonzero(batch["at"].to_numpy() == 1)
            if len(turns) and (held or turns[-1]):  # up to the last page, which may go on in the next batch
                yield from read(pa.Table.from_batches([*held, batch.slice(0, turns[-1])]))
                held = [batch.slice(turns[-1])]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield from read(pa.Table.from_batches(held))

    return each


def title_regions(blocks: DataFrame) -> DataFrame:
    """G5 = T8 + J15: (drawing_id, page, code, name, x, y, w, h) of pages with a code low on the right.

    The name is the nearest Chinese block around it that is no label; a weak nearest block means no name.
    """
    rows = with_centers(blocks)
    picked = rows.where((F.col("cy") > 0.7) & (F.col("cx") > 0.5)).withColumn("code", T.block_code("text")).where("code <> ''").groupBy(*PAGE).agg(F.max_by(F.struct("pos", "code", "cx", "cy", "x", "y", "w", "h"), F.struct("cy", "cx", -F.col("pos"))).alias("c"))
    near = rows.join(picked, PAGE).where((F.col("pos") != F.col("c.pos")) & (F.abs(F.col("cx") - F.col("c.cx")) < 0.2) & (F.abs(F.col("cy") - F.col("c.cy")) < 0.12) & F.col("text").rlike("[一-鿿]") & ~T.clean_text("text").isin(NOT_NAMES) & ~is_header_block())
    distance = F.abs(F.col("cx") - F.col("c.cx")) + F.abs(F.col("cy") - F.col("c.cy"))
    best = near.groupBy(*PAGE).agg(F.min_by(F.struct("text", "confidence"), F.struct(distance, -F.coalesce("confidence", F.lit(0.0)), "pos")).alias("n"))
    name = F.when(F.coalesce("n.confidence", F.lit(0.0)) >= 0.8, T.clean_text("n.text")).otherwise("")
    return picked.join(best, PAGE, "left").select(*PAGE, "c.code", name.alias("name"), "c.x", "c.y", "c.w", "c.h")


def reading_order(blocks: DataFrame) -> DataFrame:
    """(drawing_id, page, text): the page's texts by centre, one per line, behind the page's marker."""
    rows = with_centers(blocks).where(F.btrim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "pos", "text"))), lambda b: b["text"]), "\n")
    return rows.groupBy(*PAGE).agg(text.alias("t")).select(*PAGE, F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页\n"), F.col("t")).alias("text"))


def tech_regions(blocks: DataFrame) -> DataFrame:
    """(drawing_id, page, text, x, y, w, h) of the blocks that hold a heading of requirements."""
    rows = with_centers(blocks).where(F.col("text").rlike("技术要求|工艺要求"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "pos", "text"))), lambda b: b["text"]), "\n")
    return rows.groupBy(*PAGE).agg(text.alias("text"), *B.union_box())


def scan_to_bom(blocks: DataFrame, nfkc: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of all pages, per drawing the first title code and name and the distinct issues).

    Tables, titles and names around titles each look at all blocks, which are settled first.
    """
    blocks = T.nfkc_split(settled(blocks), "text") if nfkc else settled(blocks)
    rows, found = tables(blocks)
    titles = title_regions(blocks)
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("page")))
    heads = titles.groupBy("drawing_id").agg(T.text(first("code")).alias("title_code"), T.text(first("name")).alias("title_name"))
    gaps = found.groupBy("drawing_id").agg(F.bool_or(~F.col("complete")).alias("gap"), F.count(F.lit(1)).alias("tables"))
    out = gaps.join(heads, "drawing_id", "full").select("drawing_id", F.coalesce("tables", F.lit(0)).alias("tables"), T.text("title_code").alias("title_code"), T.text("title_name").alias("title_name"), F.when(F.col("gap"), "明细表表头不完整，列关系需复核").otherwise("").alias("issues"))
    return rows, out


#: Blocks of one text on one page that are folded by expressions. It changes the plan only.
FEW = 64


def greedy_unique(blocks: DataFrame, measure: str, least: float, order: list[str]) -> DataFrame:
    """In the given order, a block stays unless it overlaps one of the same text that stayed.

    measure: "iou", or "smaller" for the share of the smaller area. Up to FEW blocks of one text on one page are folded
    by expressions; more of them are compared as arrays of numbers, each with all that stayed at once. Where a
    block has no finite box all go the first way, however many they are; one without a box overlaps nothing and stays.
    """
    rest = [c for c in blocks.columns if c not in (*PAGE, "text")]
    each = F.struct(*order, F.struct(*rest).alias("b"))
    texts = blocks.groupBy(*PAGE, "text").agg(F.array_sort(F.collect_list(each)).alias("bs")).withColumn("bs", F.transform("bs", lambda x: x["b"]))
    ratio = B.iou if measure == "iou" else B.overlap_ratio
    side = lambda b: {k: b[k] for k in ("x", "y", "w", "h")}
    whole = lambda b: (b["x"] + b["y"] + b["w"] + b["h"]).isNotNull()
    none = F.filter("bs", lambda _: F.lit(False))
    kept = F.aggregate("bs", none, lambda acc, b: F.when(F.exists(acc, lambda k: whole(k) & whole(b) & (ratio(side(k), side(b)) >= least)), acc).otherwise(F.concat(acc, F.array(b))))
    finite = F.forall("bs", lambda b: F.coalesce(F.abs(b["x"] * b["y"] * b["w"] * b["h"]) < float("inf"), F.lit(False)))
    texts = texts.withColumn("_many", (F.size("bs") > FEW) & finite)
    sides = [F.when(F.col("_many"), F.col(f"bs.{k}").cast("array<double>")) for k in ("x", "y", "w", "h")]
    texts = texts.withColumn("_stay", stays_of_many(measure, least)(*sides))
    many = F.transform("_stay", lambda i: F.get("bs", i))
    several = F.when(F.col("_many"), many).when(F.size("bs") > 1, kept).otherwise(F.col("bs"))
    return texts.withColumn("bs", several).select(*PAGE, "text", F.inline("bs")).select(*blocks.columns)


def stays_of_many(measure: str, least: float):
    """A function of columns (x, y, w, h), arrays in order: the indexes of the boxes that stay; null for null."""

    def stay(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = len(x)
        x1, y1, area = x + w, y + h, w * h
        # Rows: the boxes that stayed so far, from the left: x, x1, y, y1, area.
        held = np.empty((5, n))
        index = np.empty(n, dtype=np.int32)
        size = 0
        for i in range(n):
            kx, kx1, ky, ky1, ka = held[:, :size]
            shared = np.maximum(0.0, np.minimum(kx1, x1[i]) - np.maximum(kx, x[i])) * np.maximum(0.0, np.minimum(ky1, y1[i]) - np.maximum(ky, y[i]))
            whole = ka + area[i] - shared if measure == "iou" else np.minimum(ka, area[i])
            some = whole > 0
            if not (shared[some] / whole[some] >= least).any():
                held[:, size] = x[i], x1[i], y[i], y1[i], area[i]
                index[size] = i
                size += 1
        return index[:size]

    @F.pandas_udf("array<int>")
    def stays(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else stay(a, b, c, d) for a, b, c, d in zip(x, y, w, h, strict=True)], dtype=object)

    return stays


def iou_dedup(blocks: DataFrame) -> DataFrame:
    """Same text and IoU of 0.8 or more: the first by (y, x) stays."""
    return greedy_unique(blocks, "iou", 0.8, ["y", "x", "pos"])


def overlap_dedup(blocks: DataFrame) -> DataFrame:
    """Same text and 0.6 of the smaller area shared: the first in the tiles' order stays."""
    return greedy_unique(blocks, "smaller", 0.6, ["pos"])


def best_orientation(scans: DataFrame) -> DataFrame:
    """(drawing_id, page, orientation, score): the better of a page's scans; the first is kept from a score of 8 on.

    scans: blocks with orientation.
    """
    codes = F.sum(F.when(T.block_code("text") != "", 1).otherwise(0))
    chinese = F.sum(F.regexp_count("text", F.lit("[一-鿿]")))
    junk = F.sum(F.regexp_count("text", F.lit("[?�]")))
    score = 8.0 * codes + 0.15 * chinese + F.sum(F.coalesce("confidence", F.lit(0.0))) - 4.0 * junk
    each = scans.groupBy(*PAGE, "orientation").agg(F.round(score, 6).alias("score"))
    first = F.when((F.col("orientation") == 0) & (F.col("score") >= 8), 1e9).otherwise(F.col("score"))
    return each.groupBy(*PAGE).agg(F.max_by(F.struct("orientation", "score"), F.struct(first, -F.col("orientation"))).alias("b")).select(*PAGE, "b.orientation", "b.score")


def tile_grid(pages: DataFrame, size: int = 2200, overlap: float = 0.16) -> DataFrame:
    """(page keys, x0, y0, x1, y1): tiles that cover each page, the last ones moved back to the edge. pages: width, height."""
    step = int(size * (1 - overlap))

    def starts(n: str) -> Column:
        last = F.greatest(F.col(n) - size, F.lit(0))
        return F.array_distinct(F.filter(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(last)), lambda s: s <= last))

    rows = pages.withColumn("x0", F.explode(starts("width"))).withColumn("y0", F.explode(starts("height")))
    return rows.withColumns({"x1": F.least(F.col("x0") + size, "width"), "y1": F.least(F.col("y0") + size, "height")})


#: Zones of a page (name, x0, y0, x1, y1) and the corner that a bounded zone keeps.
ZONES = [("title", 0.55, 0.70, 1.0, 1.0, "right", "bottom"), ("tech_left", 0.0, 0.45, 0.5, 1.0, "left", "bottom"), ("tech_right", 0.5, 0.0, 1.0, 0.6, "right", "top"), ("tech_top", 0.0, 0.0, 0.5, 0.55, "left", "top")]


def candidate_zones(pages: DataFrame, size: int = 2200) -> DataFrame:
    """(page keys, zone, x0, y0, x1, y1) in pixels; a zone larger than a tile keeps the tile at its corner."""
    zones = F.array(*(F.struct(F.lit(n).alias("zone"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d"), F.lit(h == "right").alias("r"), F.lit(v == "bottom").alias("u")) for n, a, b, c, d, h, v in ZONES))
    rows = pages.withColumn("z", F.explode(zones))
    px = lambda k, n: F.round(F.col(f"z.{k}") * F.col(n)).cast("int")
    x0, y0, x1, y1 = px("a", "width"), px("b", "height"), px("c", "width"), px("d", "height")
    return rows.select(*pages.columns, "z.zone", F.when(F.col("z.r"), F.greatest(x0, x1 - size)).otherwise(x0).alias("x0"), F.when(F.col("z.u"), F.greatest(y0, y1 - size)).otherwise(y0).alias("y0"), F.when(F.col("z.r"), x1).otherwise(F.least(x1, x0 + size)).alias("x1"), F.when(F.col("z.u"), y1).otherwise(F.least(y1, y0 + size)).alias("y1"))


def tiles_to_page(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Blocks in tile units (corner boxes) as page units; texts that say there is none are dropped. tiles: tile_id, tx0, ty0, tx1, ty1, width, height."""
    rows = blocks.where(~F.upper(F.btrim("text")).isin("[NO TEXT]", "NO TEXT", "")).join(tiles, "tile_id")
    place = lambda v, lo, hi, n: F.round((F.col(lo) + F.col(v) * (F.col(hi) - F.col(lo))) / F.col(n), 8)
    return rows.withColumns({"px0": place("x0", "tx0", "tx1", "width"), "py0": place("y0", "ty0", "ty1", "height"), "px1": place("x1", "tx0", "tx1", "width"), "py1": place("y1", "ty0", "ty1", "height")})


def polygons_to_blocks(polygons: DataFrame) -> DataFrame:
    """G1: blocks of polygon readings; without empty texts and boxes. polygons: page keys, pos, points, text, confidence, page_width, page_height."""
    rows = polygons.withColumn("b", B.polygon_box(F.col("points"), F.col("page_width"), F.col("page_height")))
    return rows.where((F.btrim(T.text("text")) != "") & (F.col("b.w") > 0) & (F.col("b.h") > 0)).select(*PAGE, "pos", F.btrim("text").alias("text"), "b.*", "confidence")
