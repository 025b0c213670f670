"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a text piece has exactly one token that can stand last in its encoding: a token that ends there
and that is compatible with the last token of the prefix before it. Storing that token for each prefix gives the
encoding of the whole piece by walking back, makes appends exact (the stored prefixes never change), and confines the
work after an edit to the bytes from the edit on, up to where the new last tokens meet the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rebatch, text_or_empty

NONE = 1 << 60


class Vocabulary:
    """Ranks of byte strings, with the two parts that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens that merging their own bytes yields. Others are only met as whole pieces.
        self.whole: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.whole[token] = rank
            elif parts := self._last_merge(token, rank):
                self.whole[token], self.parts[rank] = rank, parts
        #: By three bytes, how long tokens that end with them can be, longest first; two bytes and one are always tried.
        found: dict[bytes, set[int]] = {}
        for token in self.whole:
            if len(token) > 2:
                found.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in found.items()}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        seq = [token[i : i + 1] for i in range(len(token))]
        while len(seq) > 2:
            best = min(range(len(seq) - 1), key=lambda i: self.ranks.get(seq[i] + seq[i + 1], NONE))
            if self.ranks.get(seq[best] + seq[best + 1], NONE) >= rank:
                return None
            seq[best : best + 2] = [seq[best] + seq[best + 1]]
        return (self.ranks[seq[0]], self.ranks[seq[1]]) if all(x in self.ranks for x in seq) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay as they are side by side.

        The merges that made both are undone along the seam, latest first. They stay apart unless, at some point,
        the two that touch would have merged before the merge that was undone last.
        """
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        before = NONE
        while True:
            if ranks.get(tokens[left] + tokens[right], NONE) < before:
                return False
            made_left, made_right = parts.get(left), parts.get(right)
            if made_left is None and made_right is None:
                return True
            # A byte was there from the start. Of two equal merges the one further left came first.
            if made_right is None or (made_left is not None and left > right):
                before, left = left, made_left[1]
            else:
                before, right = right + 1, made_right[0]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


class Encoder:
    """Encodings under one vocabulary, with bounded memories of token pairs and of short pieces."""

    def __init__(self, words: Vocabulary, most_pairs: int = 1 << 20, most_pieces: int = 1 << 19) -> None:
        self.words, self.most_pairs, self.most_pieces = words, most_pairs, most_pieces
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def extend(self, data: bytes | bytearray, last: list[int], upto: int, stop=None) -> None:
        """Appends the last token of each prefix beyond those in last, whose entry 0 stands for the empty prefix."""
        whole, longest, pairs, compatible = self.words.whole, self.words.longest, self.pairs, self.words.compatible
        lengths = self.words.lengths
        base = max(0, len(last) - longest)  # no token that ends beyond the known prefixes begins before
        data = bytes(data[base:upto])
        for end in range(len(last), upto + 1):
            at = end - base
            for n in lengths.get(data[at - 3 : at], (2, 1)) if at > 2 else (2, 1):
                start = end - n
                if start < 0:
                    continue
                token = whole.get(data[at - n : at])
                if token is None:
                    continue
                if start:
                    key = last[start] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= self.most_pairs:
                            pairs.clear()
                        fits = pairs[key] = compatible(last[start], token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends at byte {end}")
            if stop is not None and stop(end):
                return

    def walk(self, last: list[int], end: int) -> list[int]:
        tokens, out = self.words.tokens, []
        while end:
            out.append(last[end])
            end -= len(tokens[last[end]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token is that token, whether or not merges would make it."""
        if (rank := self.words.ranks.get(data)) is not None:
            return [rank]
        last = [-1]
        self.extend(data, last, len(data))
        return self.walk(last, len(data))

    def packed(self, piece: str) -> bytes:
        """The piece's ids as little-endian 32-bit integers."""
        if (got := self.pieces.get(piece)) is None:
            got = array("I", self.piece(piece.encode())).tobytes()
            if len(piece) <= 40:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got


class EditableEncoding:
    """The encoding of one piece of bytes that grows and changes."""

    def __init__(self, encoder: Encoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of data[start:end]; gives the number of prefixes that were worked out anew."""
        old = self.last
        self.data[start:end] = new
        shift = len(new) - (end - start)
        self.last = old[: start + 1]
        after, same = start + len(new), 0

        def met(at: int) -> bool:
            # Beyond the edit a last token depends on at most the `longest` prefixes before it, and on those bytes.
            nonlocal same
            beyond = at - after
            if beyond > 0 and self.last[at] == old[at - shift]:
                same += 1
            else:
                same = 0
            return same >= self.encoder.words.longest and beyond >= self.encoder.words.longest

        self.encoder.extend(self.data, self.last, len(self.data), met)
        done = len(self.last) - 1 - start
        self.last += old[len(self.last) - shift :]
        return done

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last, len(self.data))


_encoders: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, n_tokens, ids, round_trip) per row: ids as an array, round_trip whether they decode to the text.

    With digests, instead of the last two: ids_sha256 of the ids as little-endian 32-bit integers, and decoded_sha256 of
    the bytes that they decode to. A null text counts as empty: no ids, no bytes. Repeated rows give repeated rows, an
    empty table an empty one. keep: string columns to pass through; others are not read, so they can have any name. The vocabulary is read by
    the driver and sent to the workers (a fixed few MB).
    """
    spark, keep = docs.sparkSession, keep or []
    sent = spark.sparkContext.broadcast(vocabulary(ranks_path))
    results = [("n_tokens", pa.int64(), "long"), *([("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] if digests else [("ids", pa.list_(pa.int32()), "array<int>"), ("round_trip", pa.bool_(), "boolean")])]
    schema = pa.schema([(id_col, pa.int64()), *((k, pa.string()) for k in keep), *((n, t) for n, t, _ in results)])

    def run(batches):
        if (encoder := _encoders.get(ranks_path)) is None:
            encoder = _encoders[ranks_path] = Encoder(sent.value)
        split, known, packed, tokens = regex.compile(pattern).findall, encoder.pieces, encoder.packed, encoder.words.tokens

        def rows():
            for batch in batches:
                for row_id, text, *kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed_ids = b"".join([known.get(p) or packed(p) for p in split(text)])
                    ids = memoryview(packed_ids).cast("I").tolist()
                    decoded = b"".join(map(tokens.__getitem__, ids))
                    if digests:
                        yield row_id, *kept, len(ids), hashlib.sha256(packed_ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
                    else:
                        yield row_id, *kept, len(ids), ids, decoded == text.encode()

        return rebatch(rows(), schema, most=512)

    ddl = ", ".join([f"`{id_col}` long", *(f"`{k}` string" for k in keep), *(f"{n} {d}" for n, _, d in results)])
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("_text"), *(F.col(k).cast("string").alias(k) for k in keep)).mapInArrow(run, ddl)
