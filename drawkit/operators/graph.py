"""Expanding assemblies through their sub-assemblies.

What is reached, at which depth, and which references lie on a cycle doesn't depend on an order. A check of up to
MOST_EDGES edges is worked out by one task in time linear in them, however deep it is; a larger one by loops of joins
that end each round in the shared folder, until what is left of it fits a task. Both give the same rows, so the limit
changes the plan only.

Marks of a walk depend on its order: each drawing is entered once, by the first reference to it that the walk meets, and
what lies on the path from the root at that moment decides. Such an order can't be split (depth-first order is a
sequential problem), so a check is one group at any size. Its task gets each pair of drawings once, as numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled

MOST_DEPTH = 50
#: Edges of a check that one task works through.
MOST_EDGES = 1_000_000
#: What marked items say.
MARKS = {
    "self": "循环引用：明细表指向图纸自身，未继续展开", "path": "循环引用：该子装配已在上层展开，未重复提取", "depth": "达到子装配展开深度上限，未继续展开",
    "failed": "匹配文件可能为子装配，但明细表识别失败，未继续展开",
}
#: Rounds of peeling that are one job.
STEPS = 4


class Links:
    """The edges of one check by parent: children of node i are heads[first[i]:first[i + 1]], in the order of `order`."""

    def __init__(self, parent: np.ndarray, child: np.ndarray, order: np.ndarray | None = None, others: np.ndarray | None = None) -> None:
        extra = np.empty(0, np.int64) if others is None else others
        self.nodes, place = np.unique(np.concatenate((parent, child, extra)), return_inverse=True)
        self.tails, self.ends, self.others = place[: len(parent)], place[len(parent) : 2 * len(parent)], place[2 * len(parent) :]
        sort = np.lexsort((self.ends if order is None else order, self.tails))
        self.heads = self.ends[sort]
        self.first = np.searchsorted(self.tails[sort], np.arange(len(self.nodes) + 1))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _levels(links: Links, most_depth: int) -> np.ndarray:
    """Least number of steps from links.others to each node; -1 where they don't lead within most_depth."""
    depth = np.full(len(links.nodes), -1, np.int64)
    frontier = np.unique(links.others)
    depth[frontier] = 0
    for step in range(1, most_depth + 1):
        counts = links.first[frontier + 1] - links.first[frontier]
        at = np.repeat(links.first[frontier] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        reached = np.unique(links.heads[at])
        frontier = reached[depth[reached] < 0]
        if not len(frontier):
            break
        depth[frontier] = step
    return depth


def _strong(links: Links) -> np.ndarray:
    """The number of each node's strong component, found in one walk that keeps the lowest entry point of each subtree."""
    n, first, heads = len(links.nodes), links.first.tolist(), links.heads.tolist()
    entered, low, component = [0] * n, [0] * n, [-1] * n
    at, held, clock, found = first[:n], [], 0, 0
    for root in range(n):
        if entered[root]:
            continue
        path = [root]
        while path:
            u = path[-1]
            if not entered[u]:
                clock += 1
                entered[u] = low[u] = clock
                held.append(u)
            if at[u] < first[u + 1]:
                v = heads[at[u]]
                at[u] += 1
                if not entered[v]:
                    path.append(v)
                elif component[v] < 0:
                    low[u] = min(low[u], entered[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            if low[u] == entered[u]:
                while True:
                    v = held.pop()
                    component[v] = found
                    if v == u:
                        break
                found += 1
    return np.array(component, np.int64)


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges of the checks of up to MOST_EDGES edges, and those of the others, whose list is a millionth of the edges at most; None without any."""
    big = settled(edges.groupBy("check_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_EDGES).select("check_id"))
    if big.isEmpty():
        return edges, None
    return edges.join(F.broadcast(big), "check_id", "left_anti"), settled(edges.join(F.broadcast(big), "check_id", "left_semi"))


def _by_size(edges: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """small() of the checks that fit a task, large() of the others."""
    few, many = _split(edges)
    return small(few) if many is None else small(few).unionByName(large(many))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles: a side small enough to be broadcast would go through the driver, in each round of a loop anew."""
    return left.join(right.hint("merge"), on, how)


def expand(roots: DataFrame, edges: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(check_id, drawing_id, depth, discovery) of everything that roots reach over edges within most_depth steps.

    roots: check_id, drawing_id. edges: check_id, parent, child. Depth is the least number of steps.
    """
    starts = roots.select("check_id", "drawing_id").distinct().toDF("check_id", "drawing_id")
    links = settled(edges.select("check_id", "parent", "child").where("parent <> child").distinct())

    def levels(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table({"check_id": pa.array([], pa.int64()), "drawing_id": pa.array([], pa.int64()), "depth": pa.array([], pa.int32())})
        own = Links(_column(left, "parent"), _column(left, "child"), others=_column(right, "drawing_id"))
        depth = _levels(own, most_depth)
        at = np.flatnonzero(depth >= 0)
        check = right.column("check_id")[0].as_py()
        return pa.table({"check_id": pa.array(np.full(len(at), check)), "drawing_id": pa.array(own.nodes[at]), "depth": pa.array(depth[at].astype(np.int32))})

    def small(own: DataFrame) -> DataFrame:
        big = own.groupBy("check_id").agg(F.lit(1).alias("_has"))
        alone = starts.join(big, "check_id", "left_anti").join(links.select("check_id").distinct(), "check_id", "left_anti").withColumn("depth", F.lit(0))
        ours = own.groupBy("check_id").cogroup(starts.join(big.select("check_id"), "check_id", "left_semi").groupBy("check_id"))
        return ours.applyInArrow(levels, "check_id long, drawing_id long, depth int").unionByName(alone)

    def large(own: DataFrame) -> DataFrame:
        seen = frontier = settled(starts.join(own.select("check_id").distinct(), "check_id", "left_semi").withColumn("depth", F.lit(0)))
        for depth in range(1, most_depth + 1):
            found = _met(own, frontier.select("check_id", F.col("drawing_id").alias("parent")), ["check_id", "parent"]).select("check_id", F.col("child").alias("drawing_id")).distinct()
            frontier = settled(_met(found, seen, ["check_id", "drawing_id"], "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if depth % 8 == 0:
                seen = settled(seen)
        return seen

    return _by_size(links, small, large).withColumn("discovery", F.when(F.col("depth") == 0, "root").otherwise("reference"))


def parents(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Per reached drawing the reached drawings that refer to it, in order."""
    at = reached.select("check_id", F.col("drawing_id").alias("parent"))
    refs = edges.join(at, ["check_id", "parent"], "left_semi").groupBy("check_id", F.col("child").alias("drawing_id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return reached.join(refs, ["check_id", "drawing_id"], "left")


def peel(edges: DataFrame, most: int = 0) -> DataFrame:
    """edges without those that lead from a node nothing leads to, or to one that leads nowhere, until none does, or no check
    has more than `most` of them left. STEPS layers are one job."""
    size = lambda df: df.groupBy("check_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n, widest = size(edges)
    while widest > most:
        kept = edges
        for _ in range(STEPS):
            led, leads = kept.select("check_id", F.col("child").alias("parent")).distinct(), kept.select("check_id", F.col("parent").alias("child")).distinct()
            kept = _met(_met(kept, led, ["check_id", "parent"], "left_semi"), leads, ["check_id", "child"], "left_semi").select("check_id", "parent", "child")
        edges = settled(kept)
        m, widest = size(edges)
        if m == n:
            break
        n = m
    return edges


def in_cycle(edges: DataFrame) -> DataFrame:
    """Edges with in_cycle: whether the edge lies on a directed cycle; a reference to itself does.

    An edge is on a cycle if both ends are in one strong component.
    """
    links = settled(edges.select("check_id", "parent", "child").where("parent <> child").distinct())
    on = _by_size(links, _within, _on_cycles)
    out = _met(edges, on.withColumn("_on", F.lit(True)), ["check_id", "parent", "child"], "left")
    return out.withColumn("in_cycle", F.coalesce("_on", F.lit(False)) | (F.col("parent") == F.col("child"))).drop("_on")


def _within(edges: DataFrame) -> DataFrame:
    """(check_id, parent, child) of the edges on a cycle, each check in one task."""

    def whole(table: pa.Table) -> pa.Table:
        own = Links(_column(table, "parent"), _column(table, "child"))
        component = _strong(own)
        return table.filter(pa.array(component[own.tails] == component[own.ends]))

    return edges.groupBy("check_id").applyInArrow(whole, "check_id long, parent long, child long")


def _on_cycles(edges: DataFrame) -> DataFrame:
    """(check_id, parent, child) of the edges on a cycle, by loops of joins as long as a check has more than MOST_EDGES edges.

    Strong components are found by colours: every node takes the largest node that reaches it; what reaches the node that
    gave the colour, within the colour, is its component. Found components are taken out and the rest goes on; neither
    that nor peeling breaks a cycle of the rest. Each step keeps one row per node or edge.
    """
    key = ["check_id", "node"]
    found, rest = None, edges
    while rest is not None:
        few, rest = _split(peel(rest, MOST_EDGES))
        found = _within(few) if found is None else found.unionByName(_within(few))
        if rest is None:
            break
        colors = settled(rest.select("check_id", F.col("parent").alias("node")).unionByName(rest.select("check_id", F.col("child").alias("node"))).distinct().withColumn("color", F.col("node")))
        while True:
            given = _met(rest, colors.withColumnRenamed("node", "parent"), ["check_id", "parent"]).groupBy("check_id", F.col("child").alias("node")).agg(F.max("color").alias("given"))
            wider = settled(_met(colors, given, key, "left").select(*key, F.greatest("color", "given").alias("color"), (F.col("given") > F.col("color")).alias("moved")))
            colors = wider.select(*key, "color")
            if wider.where("moved").isEmpty():
                break
        own = lambda end: colors.select("check_id", F.col("node").alias(end), F.col("color").alias(f"{end}_color"))
        inside = settled(_met(_met(rest, own("parent"), ["check_id", "parent"]), own("child"), ["check_id", "child"]).where("parent_color = child_color").select("check_id", "parent", "child", F.col("parent_color").alias("color")))
        seen = frontier = settled(colors.where("node = color").select(*key))
        while True:
            back = _met(inside, frontier.withColumnRenamed("node", "child"), ["check_id", "child"], "left_semi").select("check_id", F.col("parent").alias("node")).distinct()
            frontier = settled(_met(back, seen, key, "left_anti"))
            if frontier.isEmpty():
                break
            seen = settled(seen.unionByName(frontier))
        at = lambda df, how: _met(_met(df, seen.withColumnRenamed("node", "parent"), ["check_id", "parent"], how), seen.withColumnRenamed("node", "child"), ["check_id", "child"], how)
        found = found.unionByName(at(inside, "left_semi").select("check_id", "parent", "child"))
        rest = settled(at(rest, "left_anti"))
    return found


def walk(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """J20, J21 in the order of the walk: (visits, marks).

    visits: check_id, drawing_id, depth: every drawing that is entered, and how deep; roots have depth 0. Nothing is entered
    from a drawing at most_depth. marks: check_id, parent, child, mark: references of entered drawings above that depth to
    the drawing itself ("self") or to one that is being expanded ("path"). edges: check_id, parent, child, ord, a number;
    a drawing's references go by it, ties by child. roots: check_id, drawing_id, entered by id.
    """
    once = edges.groupBy("check_id", "parent", "child").agg(F.min("ord").alias("ord"))  # repeats see the same path and enter nothing new
    none = {"check_id": pa.int64(), "drawing_id": pa.int64(), "depth": pa.int32(), "parent": pa.int64(), "child": pa.int64(), "mark": pa.string()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.schema(list(none.items())).empty_table()
        order = np.lexsort((_column(left, "child"), _column(left, "ord")))
        links = Links(_column(left, "parent")[order], _column(left, "child")[order], np.arange(len(order)), _column(right, "drawing_id"))
        first, heads = links.first.tolist(), links.heads.tolist()
        at, state = first[: len(links.nodes)], bytearray(len(links.nodes))  # 1: being expanded, 2: done
        entered, depths, marks = [], [], []
        for root in np.unique(links.others).tolist():
            if state[root]:
                continue
            path = [root]
            while path:
                u, depth = path[-1], len(path) - 1
                if not state[u]:
                    state[u] = 1
                    entered.append(u)
                    depths.append(depth)
                if depth >= most_depth or at[u] == first[u + 1]:
                    state[u] = 2
                    path.pop()
                    continue
                v = heads[at[u]]
                at[u] += 1
                if state[v] == 0:
                    path.append(v)
                elif state[v] == 1:
                    marks.append((u, v))
        check, n, m = right.column("check_id")[0].as_py(), len(entered), len(marks)
        pairs = links.nodes[np.array(marks, np.int64).reshape(-1, 2)]
        columns = [
            pa.array([check] * (n + m), pa.int64()), pa.array([*links.nodes[np.array(entered, np.int64)].tolist(), *[None] * m], pa.int64()), pa.array([*depths, *[None] * m], pa.int32()),
            pa.array([*[None] * n, *pairs[:, 0].tolist()], pa.int64()), pa.array([*[None] * n, *pairs[:, 1].tolist()], pa.int64()),
            pa.array([*[None] * n, *("self" if u == v else "path" for u, v in marks)], pa.string()),
        ]
        return pa.table(dict(zip(none, columns, strict=True)))

    got = settled(once.groupBy("check_id").cogroup(roots.select("check_id", "drawing_id").toDF("check_id", "drawing_id").groupBy("check_id")).applyInArrow(run, "check_id long, drawing_id long, depth int, parent long, child long, mark string"))
    return got.where("mark is null").select("check_id", "drawing_id", "depth"), got.where("mark is not null").select("check_id", "parent", "child", "mark")


def walk_flags(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """J21, path-exact: (check_id, item_id, on_path, depth): items of entered drawings whose file is the drawing itself or one on the path to it.

    edges: check_id, item_id, parent, child; a drawing's references go by item_id. At most_depth on_path is null.
    """
    visits, marks = walk(edges.withColumn("ord", F.col("item_id")), roots, most_depth)
    of = edges.join(visits.withColumnRenamed("drawing_id", "parent"), ["check_id", "parent"]).join(marks, ["check_id", "parent", "child"], "left")
    return of.select("check_id", "item_id", F.when(F.col("depth") < most_depth, F.col("mark").isNotNull()).alias("on_path"), "depth")


def child_failures(edges: DataFrame, extractions: DataFrame) -> DataFrame:
    """(check_id, item_id) of items whose file is a table that couldn't be read. extractions: drawing_id, status, rows_count."""
    bad = extractions.where((F.col("status") == "failed") | ((F.col("status") == "partial") & (F.col("rows_count") == 0))).select(F.col("drawing_id").alias("child"))
    return edges.join(bad, "child", "left_semi").select("check_id", "item_id").distinct()
