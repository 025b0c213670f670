"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join, then connected components.

Two fingerprints that differ in at most 3 bits agree on at least one of their four 16-bit blocks, and on at least three
of six blocks of 10 or 11 bits. Each distinct fingerprint goes to the bucket of each of its four blocks, or, where
these would grow large, of each of the twenty choices of three blocks, whose buckets are 65,536 times as many. Within
a bucket the trie of the fingerprints is joined with itself: pairs of nodes descend together, their differing bits add
up, and a pair beyond the budget is dropped with all below it. A bucket of more than `most` fingerprints is cut into
chunks, and each pair of chunks is a cell of its own: no link is lost, and no task holds more than two chunks of a
bucket. A cell sends on a spanning forest of its links, not the links, so that thousands of near copies cost a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, keep_rows, rebatch, stored, text_or_empty

BITS, BUDGET = 64, 3
#: Fingerprints of one bucket that a task joins at once. Their trie takes a few MB.
MOST = 1 << 16
#: Distinct fingerprints from which on three of six blocks make the buckets; one of four then has 64 of them or more.
MANY = 1 << 22


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the text's word shingles, repeats included; 0 if it has no word."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - words_each + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words_each - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(n_blocks: int, n_equal: int) -> list[int]:
    """The bits of each choice of n_equal of n_blocks blocks, as signed numbers."""
    edge = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in pairwise(edge)]
    return [signed(sum(choice)) for choice in combinations(each, n_equal)]


def _fingerprints(batches):
    """Batches whose last column is the text; it gives way to the fingerprint."""
    for batch in batches:
        fp = pa.array([signed(fingerprint(x)) for x in as_bytes(batch.columns[-1])], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"])


def trie_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, budget: int = BUDGET, most_pairs: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose values differ in at most budget bits.

    values: uint64, ascending within each node. left, right: (nodes, 2) position ranges of the root pairs; a root paired
    with itself gives each pair once. A trie node is a range of the sorted values that share their leading bits.
    """
    todo = [(left, right, np.zeros(len(left), np.int64), np.full(len(left), BITS - 1, np.int64))]
    while todo:
        a, b, spent, bit = todo.pop()
        if len(a) > most_pairs:
            half = len(a) // 2
            todo += [(a[:half], b[:half], spent[:half], bit[:half]), (a[half:], b[half:], spent[half:], bit[half:])]
            continue
        one = (a[:, 1] - a[:, 0] == 1) & (b[:, 1] - b[:, 0] == 1)
        if one.any():  # two leaves: the rest of both paths at once
            x, y = a[one, 0], b[one, 0]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            rest = ~one
            a, b, spent, bit = a[rest], b[rest], spent[rest], bit[rest]
        same = (a == b).all(axis=1)
        bit = np.minimum(bit, BITS - 1)
        if not len(a):
            continue
        cut_a, cut_b = _cut(values, a, bit), _cut(values, b, bit)
        low_a, high_a = np.stack((a[:, 0], cut_a), 1), np.stack((cut_a, a[:, 1]), 1)
        low_b, high_b = np.stack((b[:, 0], cut_b), 1), np.stack((cut_b, b[:, 1]), 1)
        new = [
            (low_a, low_b, spent, np.ones(len(a), bool)),
            (high_a, high_b, spent, np.ones(len(a), bool)),
            (low_a, high_b, spent + 1, np.ones(len(a), bool)),
            (high_a, low_b, spent + 1, ~same),  # of a node with itself, one of the two mixed pairs
        ]
        na, nb, ns, nd = (np.concatenate([x[i] for x in new]) for i in range(4))
        nbit = np.tile(bit - 1, 4)
        keep = nd & (ns <= budget) & (na[:, 1] > na[:, 0]) & (nb[:, 1] > nb[:, 0]) & ~((na == nb).all(axis=1) & (na[:, 1] - na[:, 0] == 1))
        if keep.any():
            todo.append((na[keep], nb[keep], ns[keep], nbit[keep]))


def _cut(values: np.ndarray, ranges: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the values of each range begin to have the bit set: a binary search of all ranges at once."""
    low, high = ranges[:, 0].copy(), ranges[:, 1].copy()
    shift = bit.astype(np.uint64)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        is_set = (values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1) == 1
        high = np.where(open_ & is_set, mid, high)
        low = np.where(open_ & ~is_set, mid + 1, low)
    return low


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions is linked to, over any number of links."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            if (rx == ry).all():
                break
            low, high = np.minimum(rx, ry), np.maximum(rx, ry)
            np.minimum.at(root, high, low)
            while not np.array_equal(nxt := root[root], root):
                root = nxt
    return root


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _cells(most_rows: int):
    """Rows (bucket, cell, side, fp) sorted by all: links within each cell as a forest over its fingerprints."""

    def links(cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        values = fp.view(np.uint64)
        edge = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]), [True])))
        node = np.stack((edge[:-1], edge[1:]), 1)
        which, of = side[node[:, 0]], cell[node[:, 0]]
        # Side 2 is a chunk joined with itself; sides 0 and 1 of a cell are joined with each other.
        # A chunk of one fingerprint has no link with itself, but two such chunks may have one with each other.
        own = node[(which == 2) & (node[:, 1] - node[:, 0] > 1)]
        first = np.flatnonzero((which[:-1] == 0) & (which[1:] == 1) & (of[:-1] == of[1:])) if len(which) > 1 else np.empty(0, np.int64)
        left, right = np.concatenate((own, node[first])), np.concatenate((own, node[first + 1]))
        root = forest(len(fp), trie_links(values, left, right))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return list(zip(fp[at].tolist(), fp[root[at]].tolist(), strict=True))

    def run(batches):
        def rows():
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                size += len(held[-1][0])
                if size >= most_rows:
                    all_ = np.concatenate(held, axis=1)
                    cut = int(np.flatnonzero(np.concatenate(([True], all_[0, 1:] != all_[0, :-1])))[-1])  # where its last cell begins
                    if cut:
                        yield from links(*all_[:, :cut])
                    held, size = [all_[:, cut:]], all_.shape[1] - cut
            if size:
                yield from links(*np.concatenate(held, axis=1))

        return rebatch(rows(), LINK, most=65536)

    return run


def fingerprint_links(prints: DataFrame, most: int = MOST, many: int = MANY) -> DataFrame:
    """Links (u > v by their order as found) that connect what Hamming distance 3 connects. prints: distinct fp."""
    chosen = masks(4, 1) if prints.count() < many else masks(6, 3)
    block = F.explode(F.array(*map(F.lit, chosen))).alias("mask")
    # Buckets are numbered by a hash; two that meet are one bucket, which costs time only.
    rows = prints.select("fp", block).select("fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask").alias("bucket"))
    # Only buckets beyond `most` are listed; with so many fingerprints each, they are few beside the rows.
    large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("g"))
    rows = rows.join(large, "bucket", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int")
    # The chunk pairs that a fingerprint takes part in: itself (side 2), and with each other chunk as side 0 or 1.
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("i"), F.greatest(o, F.col("c")).alias("j"), F.when(o == F.col("c"), 2).when(F.col("c") < o, 0).otherwise(1).alias("side"))))
    cells = rows.withColumn("c", chunk).select("fp", "bucket", cell.alias("x"))
    cells = cells.select(F.xxhash64("bucket", "x.i", "x.j").alias("cell"), F.col("x.side").cast("long").alias("side"), "fp", F.when(F.col("fp") < 0, 1).otherwise(0).alias("sign"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "side", "sign", "fp").select("cell", "side", "fp")
    return dealt.mapInArrow(_cells(1 << 20), "u long, v long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. links: (u, v).

    Alternates large-star and small-star steps: in each, every node points its neighbours to the smallest one it
    knows. Rounds grow with the logarithm of a component's size; each ends in the shared folder.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now[0] == now[2] and now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components didn't settle")


def _groups(rows: DataFrame, first: Column, **how) -> DataFrame:
    """(fp, component): the least `first` of the rows that links reach. rows: stored, with fp."""
    prints = stored(rows.groupBy("fp").agg(F.min(first).alias("least")))
    roots = components(fingerprint_links(prints.select("fp"), **how))
    # Only linked fingerprints have a root; each of the others is a component of its own.
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(least, "root").select("fp", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id that links reach.

    A null text counts as empty; texts without words have fingerprint 0 and are linked like any other. Rows of equal
    fingerprint are one node, however many they are. Null ids never name a component unless it has no other. Repeated
    rows give repeated rows, an empty table an empty one; other columns are not read.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = stored(texts.mapInArrow(_fingerprints, "id long, fp long"))
    return rows.join(_groups(rows, F.col("id"), **how), "fp").select("id", "fp", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay: of each component one row, that with the smallest id. Same columns, of any names.

    Rows without an id come last, and of one id the text with the smaller SHA-256 stays; rows that agree in id and text
    are one, so ids may repeat or be null. A null text counts as empty. An empty table gives an empty one.
    """
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("sha"), text_or_empty(text_col).alias("text"))
    rows = stored(texts.mapInArrow(_fingerprints, "id long, sha binary, fp long"))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("sha"))
    judged = rows.join(_groups(rows, place, **how), "fp").withColumn("stays", place.eqNullSafe(F.col("component")))
    gone = judged.where("not stays").select("id", "sha")
    twice = judged.where("stays").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "sha")
    return keep_rows(docs, gone, twice, {"id": F.col(f"`{id_col}`").cast("long"), "sha": digest})
