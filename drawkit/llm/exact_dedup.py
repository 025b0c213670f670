"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after deleting white space. The work is two kinds of pass:

1. Each map task folds its own equal texts together in an open-addressing table of bounded size, so that a
   group of copies that holds a third of all rows leaves a task as a few records.
2. Records are dealt by a hash of their content. Each bucket fills an open-addressing table that compares whole
   contents. A bucket that outgrows the table's memory keeps what it has (every later copy of a resident text is
   still absorbed) and passes all other records on; these go to spill files in the shared folder and are dealt
   again by another hash, until every bucket fits.

The groups are then joined to a thin (id, digest) table; no text takes part in that join.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, keep_rows, rebatch, shared_folder, stored, text_or_empty

BLANKS = b" \t\n\x0b\x0c\r"


class ContentTable:
    """Open addressing with linear probing; two contents are one entry only if all their bytes agree."""

    def __init__(self, most_bytes: int) -> None:
        self.most_bytes, self.used = most_bytes, 0
        self.slots = array("q", [-1]) * 1024
        self.keys: list[int] = []
        self.contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self.contents)

    def _slot(self, key: int, content: bytes) -> int:
        """The slot of content, or the free one where it belongs."""
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def find(self, content: bytes) -> int | None:
        entry = self.slots[self._slot(xxhash.xxh3_64_intdigest(content), content)]
        return entry if entry >= 0 else None

    def add(self, content: bytes) -> tuple[int | None, bool]:
        """Its entry and whether it is new; no entry if the content is new and the table is full."""
        key = xxhash.xxh3_64_intdigest(content)
        at = self._slot(key, content)
        if (entry := self.slots[at]) >= 0:
            return entry, False
        if self.contents and self.used + len(content) > self.most_bytes:
            return None, True
        self.slots[at] = entry = len(self.contents)
        self.keys.append(key)
        self.contents.append(content)
        self.used += len(content) + 200
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.keys):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


RECORD = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("n_cp", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("ties", pa.int64()), ("spilled", pa.bool_())])
RECORD_DDL = "sha binary, content binary, n_cp long, id long, size long, ties long, spilled boolean"


def better(a: tuple, b: tuple) -> bool:
    """Whether row (code points, id) a stays rather than b: more code points, then the smaller id, then null ids last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


class _Groups:
    """A table with the row that stays, the count of each entry, and how many rows are as good as the one that stays."""

    def __init__(self, most_bytes: int) -> None:
        self.table = ContentTable(most_bytes)
        self.rows: list[list] = []

    def put(self, content: bytes, n_cp: int, row_id: int | None, size: int, ties: int) -> bool:
        entry, new = self.table.add(content)
        if entry is None:
            return False
        if new:
            self.rows.append([n_cp, row_id, size, ties])
        else:
            row = self.rows[entry]
            row[2] += size
            if better((n_cp, row_id), (row[0], row[1])):
                row[0], row[1], row[3] = n_cp, row_id, ties
            elif (n_cp, row_id) == (row[0], row[1]):
                row[3] += ties
        return True

    def records(self, with_content: bool) -> Iterator[tuple]:
        for content, (n_cp, row_id, size, ties) in zip(self.table.contents, self.rows, strict=True):
            yield hashlib.sha256(content).digest(), content if with_content else None, n_cp, row_id, size, ties, False


def _fold(most_bytes: int):
    def fold(batches):
        def rows():
            held = _Groups(most_bytes)
            for batch in batches:
                for row_id, text, n_cp in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), pc.utf8_length(batch.column(1)).to_pylist(), strict=True):
                    content = text.translate(None, BLANKS)
                    if not held.put(content, n_cp, row_id, 1, 1):
                        yield from held.records(True)
                        held = _Groups(most_bytes)
                        held.put(content, n_cp, row_id, 1, 1)
            yield from held.records(True)

        return rebatch(rows(), RECORD)

    return fold


def _bucket(most_bytes: int):
    def bucket(batches):
        def rows():
            held = _Groups(most_bytes)
            for batch in batches:
                for sha, content, n_cp, row_id, size, ties, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not held.put(content, n_cp, row_id, size, ties):
                        yield sha, content, n_cp, row_id, size, ties, True
            yield from held.records(False)

        return rebatch(rows(), RECORD)

    return bucket


def _digests(batches):
    schema = pa.schema([("id", pa.int64()), ("sha", pa.binary()), ("n_cp", pa.int64())])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(x.translate(None, BLANKS)).digest() for x in as_bytes(batch.column(1))], pa.binary()), pc.utf8_length(batch.column(1)).cast(pa.int64())], schema=schema)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_bytes: int = 64 << 20, fold_bytes: int = 16 << 20) -> DataFrame:
    """(sha, keep_id, keep_cp, size, ties) of every group of equal texts.

    ties: rows that have the id and code points of the one that stays. most_bytes: contents that a bucket's table holds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_fold(fold_bytes), RECORD_DDL)
    groups = None
    for level in count():  # each level ends: a bucket always takes in one content at least
        path = shared_folder(spark)
        # Another hash at each level deals anew what met in one bucket; the number of buckets is the session's.
        rows.repartition(F.xxhash64("sha", F.lit(level))).mapInArrow(_bucket(most_bytes), RECORD_DDL).write.parquet(path)
        out = spark.read.schema(RECORD_DDL).parquet(path)
        done = out.where(~F.col("spilled")).select("sha", F.col("id").alias("keep_id"), F.col("n_cp").alias("keep_cp"), "size", "ties")
        groups = done if groups is None else groups.unionByName(done)
        rows = out.where("spilled")
        if rows.isEmpty():
            return groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_bytes: int = 64 << 20, fold_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: the input's columns, then keep_id, group_size, kept and text_sha256.

    Input columns of these four names are replaced. A null text counts as empty, and empty texts are one group. Of
    equal texts the row with the most code points stays, then the smallest id; rows without an id come last. Of rows
    with one id, text and length exactly one is kept. An empty table gives an empty one.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), *_key_columns(text_col))
    return _judged(rows, content_groups(docs, id_col, text_col, most_bytes=most_bytes, fold_bytes=fold_bytes)).select("row.*", *names)


def _key_columns(text_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    return [F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256)).alias("sha"), F.char_length(text).cast("long").alias("n_cp")]


def _judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (id, sha, n_cp, ...) with keep_id, group_size, kept and text_sha256.

    Only where rows tie for staying are rows numbered, and kept in the shared folder for that, so that one of them is chosen.
    """
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    ties = groups.where("ties > 1").select(F.col("sha").alias("tied"))
    if ties.isEmpty():
        out = rows.join(groups, "sha", "left").withColumn("kept", best)
    else:
        rows = stored(rows.withColumn("_nth", F.monotonically_increasing_id()))
        out = rows.join(groups, "sha", "left").withColumn("kept", best)
        first = stored(out.where("kept and ties > 1").groupBy(F.col("sha").alias("tied")).agg(F.min("_nth").alias("_first")))
        out = out.join(first, F.col("sha") == F.col("tied"), "left").withColumn("kept", F.col("kept") & (F.col("_first").isNull() | (F.col("_nth") == F.col("_first"))))
    return out.withColumn("group_size", F.col("size")).withColumn("text_sha256", F.lower(F.hex("sha")))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """exact_dedup without the input's other columns: (id, keep_id, group_size, kept, text_sha256); no text is shuffled twice."""
    groups = content_groups(docs, id_col, text_col, **limits)
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_digests, "id long, sha binary, n_cp long")
    return _judged(thin, groups).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with the columns of docs, of any names.

    Rows go by id, text and length, not by id: ids may repeat or be null. Of rows that agree in these three one stays.
    Null and empty texts are one group. An empty table gives an empty one.
    """
    groups = content_groups(docs, id_col, text_col, **limits)
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_digests, "id long, sha binary, n_cp long")
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    gone = thin.join(groups.where("size > 1"), "sha").where(~best).select("id", "sha", "n_cp")
    twice = groups.where("ties > 1").select(F.col("keep_id").alias("id"), "sha", F.col("keep_cp").alias("n_cp"))
    sha, n_cp = _key_columns(text_col)
    return keep_rows(docs, gone, twice, {"id": F.col(f"`{id_col}`").cast("long"), "sha": sha, "n_cp": n_cp})
