"""Embedding near-duplicates: cells of spherical k-means, blocked cosine products within cells, one vector kept per group.

The join is exact. Equal vectors are one node with a weight. Centres are fitted on a bounded sample; each node has a home
cell, that of its nearest centre. Of a cell, the nodes within half the linking angle of its centre are its core: they all
link with one another, and need no product at all, however many they are. The others are its shell. Core and shell are
each compared within the cell, and with guests: a node goes as guest to another core or shell if, by the angles, it may
have a link there. It must lie within the linking angle of the ring that the members fill around their centre, and
within that angle of the plane that parts the two cells. Members beyond a task's share are cut into chunks that are
guests of one another. So each pair that can link meets once.

How many guests there are depends on the data. Where vectors form clusters narrower than the distances between them,
few nodes are guests; of vectors without any structure nearly all pairs of cells meet, and the work grows as the square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ._common import rebatch, stored, with_group
from .simhash import components

#: Nodes for each centre, centres at most, nodes of the fit's sample for each centre (its expected size; it is the one bound).
PER_CELL, MOST_CELLS, FITTED = 4096, 256, 128
#: Bytes of member vectors that a task holds, and guests compared with them at once.
MEMBER_BYTES, BLOCK = 16 << 20, 512
#: Radians by which every bound is widened, far beyond the error of an angle worked out in doubles.
SLACK = 1e-6
CORE, SHELL = 0, 1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, at any magnitude."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centres of unit vectors. Starts are drawn by their distance from those drawn before."""
    rng = np.random.default_rng(13)
    centres = [vectors[rng.integers(len(vectors))]]
    nearest = vectors @ centres[0]
    while len(centres) < k:
        share = np.clip(1 - nearest, 0, None)
        if share.sum() <= 1e-9 * len(vectors):
            break
        centres.append(vectors[rng.choice(len(vectors), p=share / share.sum())])
        nearest = np.maximum(nearest, vectors @ centres[-1])
    found = np.array(centres)
    for _ in range(rounds):
        home = (vectors @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, vectors)
        length = np.linalg.norm(sums, axis=1)
        new = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-300)[:, None], found)
        if np.abs(new - found).max() < 1e-6:
            break
        found = new
    return found


class Cells:
    """Centres by length of vector. Cells of all lengths are numbered together."""

    def __init__(self, centres: dict[int, np.ndarray], alpha: float) -> None:
        self.alpha, self.centres, self.first, at = alpha, centres, {}, 0
        for d, c in sorted(centres.items()):
            self.first[d], at = at, at + len(c)
        self.n = at

    def home(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: the home cell within its length, the angle to that centre, and its cosines with all centres."""
        cosines = units @ self.centres[units.shape[1]].T
        home = cosines.argmax(axis=1)
        return home, np.arccos(np.clip(cosines[np.arange(len(units)), home], -1, 1)), cosines

    def kind(self, angle: np.ndarray) -> np.ndarray:
        return np.where(angle <= self.alpha / 2 - SLACK, CORE, SHELL)

    def guests(self, units: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, kind, positions of the vectors to compare there). low, high: least and largest angle of (cell, kind).

        Of two cores or two shells one sends guests, by the parity of their numbers; a shell sends guests to cores.
        """
        d = units.shape[1]
        centres, first = self.centres[d], self.first[d]
        home, angle, cosines = self.home(units)
        kind = self.kind(angle)
        angles = np.arccos(np.clip(cosines, -1, 1))
        for b in range(len(centres)):
            apart = np.linalg.norm(centres - centres[b], axis=1)
            plane = (cosines[np.arange(len(units)), home] - cosines[:, b]) / np.maximum(apart[home], 1e-12)
            near = (home == b) | (plane <= math.sin(self.alpha) + SLACK)
            sends = (home != b) & (((home + b) % 2 == 1) == (home < b))
            for to in (CORE, SHELL):
                lo, hi = low[first + b, to], high[first + b, to]
                if hi < 0:  # nobody is there
                    continue
                ring = (angles[:, b] <= hi + self.alpha + SLACK) & (angles[:, b] >= lo - self.alpha - SLACK)
                goes = near & ring & (((kind == SHELL) if to == CORE else np.zeros(len(units), bool)) | (sends & (kind == to)))
                if goes.any():
                    yield first + b, to, np.flatnonzero(goes)


def exact_cosine(u: np.ndarray, v: np.ndarray) -> float:
    """The cosine of two vectors from sums without rounding, the same in whatever order and block they meet."""
    u, v = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (u, v))  # by powers of two, which round nothing
    return math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))


def near_pairs(a: np.ndarray, b: np.ndarray, units_a: np.ndarray, units_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs with a cosine of at least `least`; those within 1e-9 of it are worked out again."""
    cosines = units_a @ units_b.T
    x, y = np.nonzero(cosines >= least - 1e-9)
    close = np.flatnonzero(np.abs(cosines[x, y] - least) <= 1e-9)
    gone = [i for i in close.tolist() if exact_cosine(a[x[i]], b[y[i]]) < least]
    return (np.delete(x, gone), np.delete(y, gone)) if gone else (x, y)


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root: the smallest position known to be linked with each; the links (x, y) are added."""
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return root
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        np.minimum.at(root, high, low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _by_length(batch: pa.RecordBatch, at: int, most: int = 4096):
    """Parts of a batch whose vectors (column `at`) have one length."""
    lengths = np.asarray(batch.column(at).value_lengths())
    for d in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == d)
        for i in range(0, len(where), most):
            yield batch.take(pa.array(where[i : i + most]))


STATS = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("nodes", pa.int64()), ("weight", pa.int64()), ("hub", pa.int64())])
STATS_DDL = "cell int, kind int, low double, high double, nodes long, weight long, hub long"


def _stats(sent):
    """A row for each core and shell that a task has met."""

    def run(batches):
        cells = sent.value
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in _by_length(batch, 2):
                units = unit(_matrix(part.column(2)))
                node, weight = (part.column(i).to_numpy() for i in (0, 1))
                home, angle, _ = cells.home(units)
                key = 2 * (home + cells.first[units.shape[1]]) + cells.kind(angle)
                for k in np.unique(key).tolist():
                    own = key == k
                    low, high, nodes, total, hub = found.get(k, (math.inf, -math.inf, 0, 0, 1 << 62))
                    found[k] = [min(low, float(angle[own].min())), max(high, float(angle[own].max())), nodes + int(own.sum()), total + int(weight[own].sum()), min(hub, int(node[own].min()))]
        return rebatch(((k // 2, k % 2, *x) for k, x in found.items()), STATS)

    return run


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(3)


def _deal(sent):
    """Each node as member of its own chunk and as guest of the chunks where it may have links."""

    def run(batches):
        cells, low, high, chunks = sent.value
        for batch in batches:
            for part in _by_length(batch, 2, 1024):
                units = unit(_matrix(part.column(2)))
                first = cells.first[units.shape[1]]
                home, angle, _ = cells.home(units)
                kind, node = cells.kind(angle), part.column(0).to_numpy()
                n = chunks[home + first, kind]
                own = (_scatter(node) % n.astype(np.uint64)).astype(np.int64)
                sent_to = [(home + first, kind, own, np.arange(len(node)), 0)]
                for b, to, who in cells.guests(units, low, high):
                    for c in range(int(chunks[b, to])):
                        sent_to.append((np.full(len(who), b), np.full(len(who), to), np.full(len(who), c), who, 1))
                for c in range(int(n.max())):  # within a shell of several chunks; nodes of a core link with all of it
                    who = np.flatnonzero((kind == SHELL) & (n > c) & (own != c) & (((own + c) % 2 == 1) == (own < c)))
                    sent_to.append((home[who] + first, kind[who], np.full(len(who), c), who, 1))
                for b, to, c, who, side in sent_to:
                    if len(who):
                        key = ((b * 2 + to) << 32 | c).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(who), side, np.int32)), *(part.column(i).take(pa.array(who)) for i in range(3))], names=["chunk", "side", "node", "weight", "v"])

    return run


LINKS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _compare(sent, least: float):
    """Rows sorted by chunk, members before guests: (node, weight of the nodes linked with it, a node linked with it).

    Weights of one node add up over its rows; the named nodes link what a chunk's links connect, as a forest.
    """

    def run(batches):
        weights, hubs = sent.value

        def finish(key, members):
            node, weight, v, u, count, root = members
            if key >> 32 & 1 == CORE:  # all link with each other: the hub names them
                total, hub = int(weights[key >> 33]), int(hubs[key >> 33])
                yield from ((int(i), total - int(w) + int(c), hub if i != hub else None) for i, w, c in zip(node, weight, count, strict=True))
            else:
                at = np.flatnonzero((count > 0) | (root != np.arange(len(node))))
                yield from ((int(node[i]), int(count[i]), int(node[root[i]]) if root[i] != i else None) for i in at)

        def start(key, node, weight, v):
            u, count, root = unit(v), np.zeros(len(node), np.int64), np.arange(len(node))
            if key >> 32 & 1 == SHELL:
                for lo in range(0, len(node), BLOCK):
                    x, y = near_pairs(v[lo : lo + BLOCK], v[lo:], u[lo : lo + BLOCK], u[lo:], least)
                    x, y = x[y > x] + lo, y[y > x] + lo
                    np.add.at(count, x, weight[y])
                    np.add.at(count, y, weight[x])
                    root = unite(root, x, y)
            return [node, weight, v, u, count, root]

        def guests(members, node, weight, v):
            own, own_weight, own_v, own_u, count, root = members
            u = unit(v)
            for lo in range(0, len(node), BLOCK):
                x, y = near_pairs(v[lo : lo + BLOCK], own_v, u[lo : lo + BLOCK], own_u, least)
                if not len(x):
                    continue
                x += lo
                np.add.at(count, y, weight[x])
                guest, at, which = np.unique(x, return_index=True, return_inverse=True)
                got = np.zeros(len(guest), np.int64)
                np.add.at(got, which, own_weight[y])
                members[5] = root = unite(root, y, y[at][which])  # what one guest links with is linked through it
                yield from zip(node[guest].tolist(), got.tolist(), own[y[at]].tolist(), strict=True)

        def rows():
            now, held, members = None, [], None
            for batch in batches:
                key, side = (batch.column(i).to_numpy() for i in (0, 1))
                edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (side[1:] != side[:-1]), [True])))
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    part = batch.slice(lo, hi - lo)
                    node, weight = (part.column(i).to_numpy() for i in (2, 3))
                    if key[lo] != now:
                        if members is None and held:
                            members = start(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                        if members is not None:
                            yield from finish(now, members)
                        now, held, members = int(key[lo]), [], None
                    if side[lo] == 0:
                        held.append((node, weight, _matrix(part.column(4))))
                        continue
                    if members is None:
                        if not held:  # a chunk that no member was dealt to
                            continue
                        members = start(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield from guests(members, node, weight, _matrix(part.column(4)))
            if members is None and held:
                members = start(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
            if members is not None:
                yield from finish(now, members)

        return rebatch(rows(), LINKS, most=1 << 16)

    return run


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_links(nodes: DataFrame, least: float = 0.9, *, per_cell: int = PER_CELL, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(node, n, other): weights of linked nodes, to be added up, and a forest of the links. nodes: stored (node, weight, v)."""
    spark = nodes.sparkSession
    lengths = {r.d: r.n for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(lengths.values())
    k = min(MOST_CELLS, max(1, math.ceil(total / per_cell)))
    share = F.pmod(F.xxhash64("node", F.lit(13)), F.lit(1 << 40)) < int(min(1.0, k * FITTED / max(total, 1)) * (1 << 40))
    sample: dict[int, list] = {}
    for r in nodes.where(share).select("v").toLocalIterator():
        sample.setdefault(len(r.v), []).append(r.v)
    centres = {d: spherical_kmeans(unit(np.array(sample[d], np.float64)), max(1, math.ceil(k * n / total))) if d in sample else np.eye(1, d) for d, n in lengths.items()}
    cells = Cells(centres, math.acos(least))
    # At most two rows for each cell and task, and two for each cell when added up.
    stats = nodes.mapInArrow(_stats(spark.sparkContext.broadcast(cells)), STATS_DDL)
    stats = stats.groupBy("cell", "kind").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nodes").alias("nodes"), F.sum("weight").alias("weight"), F.min("hub").alias("hub")).collect()
    low, high, chunks = np.zeros((cells.n, 2)), np.full((cells.n, 2), -1.0), np.ones((cells.n, 2), np.int64)
    weights, hubs = np.zeros(cells.n, np.int64), np.full(cells.n, -1, np.int64)
    of = {first + i: d for d, first in cells.first.items() for i in range(len(centres[d]))}
    for r in stats:
        low[r.cell, r.kind], high[r.cell, r.kind] = r.low, r.high
        chunks[r.cell, r.kind] = math.ceil(r.nodes / max(64, member_bytes // (16 * of[r.cell])))
        if r.kind == CORE:
            weights[r.cell], hubs[r.cell] = r.weight, r.hub
    typed = f"array<{nodes.schema['v'].dataType.elementType.simpleString()}>"
    dealt = nodes.mapInArrow(_deal(spark.sparkContext.broadcast((cells, low, high, chunks))), f"chunk long, side int, node long, weight long, v {typed}")
    dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", "side")
    return dealt.mapInArrow(_compare(spark.sparkContext.broadcast((weights, hubs)), least), "node long, n long, other long")


def vector_dedup(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """(id, n_links, component_id, kept) per row: rows whose vectors have a cosine of `least` or more are linked.

    Vectors that are null, empty or zero or hold null or non-finite entries link with nothing, nor do vectors of
    different length. Equal vectors link like any other; n_links counts rows. component_id is the smallest id that links
    reach, its own included; null ids name a component only if it has no other. kept is whether the id is that of the
    component, so of rows that repeat an id all or none stay. An empty table gives an empty one; other columns are not
    read. Ids are cast to long. Two vectors count as equal if they agree in two 64-bit hashes.
    """
    spark, kind = vectors.sparkSession, vectors.schema[vector_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    v = F.col(f"`{vector_col}`") if plain else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")]
    usable = rows.where(_usable(F.col("v")))
    nodes = usable.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "weight", "least", "v", *keys))
    links = stored(vector_links(nodes.select("node", "weight", "v"), least, **how))
    roots = components(links.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.drop("v").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("h1", "h2", "weight", "least", "root", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    least_id = named.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(named.join(least_id, "root").select("h1", "h2", "weight", "n_links", "component"))
    linked = with_group(usable.select("id", *keys), named, ["h1", "h2"], "weight")
    alone = rows.where(~_usable(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    both = linked.select("id", "n_links", "component").unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as component_id from reach group by x),
n as (select x, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least on vec_id = least.x left join n on vec_id = n.x
"""
