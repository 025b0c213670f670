"""Alignment of two tokenizers over the bytes of each text.

Two encodings of one text end tokens at byte offsets. The shorter list of ends drives an exponential and then a binary
search into the longer one (a galloping intersection). The ends that both have cut the text into groups; a token's rank
in the other list tells which tokens there share bytes with it. Texts are aligned many at a time: all ends of a block of
texts are one ascending list, in which the end of a text is always common, so that no group reaches beyond its text.

What the corpus holds is counted in two steps. A task numbers the distinct id pairs of a few megabytes of text, a chunk,
and sends on each pair once with its count; a text's links are numbers within its chunk. Corpus-wide counts go back to
the chunks, a row for each pair and chunk, and meet the texts there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rebatch, stored

#: UTF-8 of the texts whose pairs are numbered together, and of those aligned at once.
CHUNK, BLOCK = 8 << 20, 1 << 20
#: Pieces of text that a worker remembers for each tokenizer; longer ones than this many characters are not remembered.
REMEMBERED, LONGEST = 1 << 19, 40
#: Texts with other characters go to the library whole: there Unicode versions may cut words differently.
SETTLED = re.compile("[\0-ԯḀ-⃏℀-⯿　-ヿ一-龥가-힣︀-️＀-￯\U0001f300-\U0001f64f]*")
BLANK = "▁"


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value of short, the number of values in long below it. Both ascend; start: where each search begins.

    Steps away from the start double until they pass the value; a binary search ends between the last two. All values
    of short go on together; each round looks only at those still under way.
    """
    n = len(long)
    low, high = np.full(len(short), -1, np.int64), np.full(len(short), n, np.int64)  # long[low] < value <= long[high]
    open_, at, step = np.arange(len(short)), np.clip(start, 0, n - 1), 1
    while len(open_):
        less = long[at] < short[open_]
        low[open_[less]], high[open_[~less]] = at[less], at[~less]
        at = np.where(less, at + step, at - step)
        met = (at <= low[open_]) | (at >= high[open_])
        open_, at, step = open_[~met], at[~met], step * 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = long[mid] < short[open_]
        low[open_[less]], high[open_[~less]] = mid[less], mid[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray, text_a: np.ndarray, text_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a and in b of the ends that both have, and for each token of the shorter list how many it overlaps.

    a, b: ascending ends. text_a, text_b: the same texts' first tokens in each, and the number of tokens at last; a
    search begins at the same share of its text.
    """
    if len(a) > len(b):
        ib, ia, over = common_ends(b, a, text_b, text_a)
        return ia, ib, over
    n_a, n_b = np.diff(text_a), np.diff(text_b)
    text = np.repeat(np.arange(len(n_a)), n_a)
    rank = gallop(a, b, text_b[text] + (np.arange(len(a)) - text_a[text]) * n_b[text] // np.maximum(n_a[text], 1))
    same = (rank < len(b)) & (b[np.minimum(rank, len(b) - 1)] == a)
    # A token's first partner is the one that ends first beyond where the token begins: a rank, or the one after it.
    first = np.concatenate(([0], (rank + same)[:-1]))
    return np.flatnonzero(same), rank[same], rank - first + 1


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int]]:
    """For each token of one text's encoding A, the first and the last token of B that share a byte with it."""
    rank = gallop(ends_a, ends_b, np.arange(len(ends_a)))
    first = np.concatenate(([0], (rank + (ends_b[rank] == ends_a))[:-1]))
    return list(zip(first.tolist(), rank.tolist(), strict=True))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Side:
    """One tokenizer with the pieces it has encoded. Pieces are parts of a text that it encodes independently."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.token_bytes = token_bytes
        self.lengths = np.array([len(x) for x in token_bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # pieces whose tokens don't give their bytes

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after the other, and the number of ids of each."""
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """The 32-bit ids of each text (with its leading space); None where their bytes are not the text's."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.wrong.clear()
        new = list(set().union(*cut).difference(self.known))
        ids, counts = self.encode(new)
        packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update((p, packed[lo:hi]) for p, lo, hi in zip(new, [0, *ends], ends, strict=False))
        token_bytes = self.token_bytes.__getitem__
        if b"".join(map(token_bytes, ids.tolist())) != "".join(new).encode():
            self.wrong.update(p for p in new if b"".join(map(token_bytes, memoryview(self.known[p]).cast("I"))) != p.encode())
        look, wrong = self.known.__getitem__, self.wrong
        out = [None if wrong and not wrong.isdisjoint(c) else b"".join(map(look, c)) for c in cut]
        for piece in [p for p in new if len(p) > LONGEST]:
            del self.known[piece]
            self.wrong.discard(piece)
        return out


class ByteLevel(Side):
    def __init__(self, model: bytes, pattern: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        letters, entries = byte_letters(), [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.split = regex.compile(pattern).findall
        super().__init__(entries)

    def pieces(self, text: str) -> list[str]:
        return self.split(text) if SETTLED.fullmatch(text) else [text]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int64), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))


class PieceModel(Side):
    """A piece model whose pieces hold blanks at their beginning only and no line feed (checked): words part there."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.apart = not any(re.search(f"[^{BLANK}]{BLANK}|\n", x) for x in names)
        self.split, self.feed = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall, m.encode("\n")[-1]
        super().__init__([bytes([int(x[3:5], 16)]) if m.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)])

    def pieces(self, text: str) -> list[str]:
        return self.split(text) if self.apart else [text]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that part at line feeds are one text, a line each; a line feed first takes the space that the model adds."""
        if not self.apart:
            ids = [self.model.encode(p[1:]) for p in pieces]
            return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)
        lines = [p for p in pieces if p != "\n"]
        ids = np.array(self.model.encode("\n" + "".join(p + "\n" for p in lines)), np.int64)[1:]
        feed = ids == self.feed
        counts = np.diff(np.flatnonzero(feed)) - 1
        if len(lines) == len(pieces):
            return ids[~feed], counts
        at = pieces.index("\n")  # a piece of its own, one token
        return np.insert(ids[~feed], counts[:at].sum(), self.feed), np.insert(counts, at, 1)


def _names(n: int, after: str) -> list[str]:
    return [f"{i}{after}" for i in range(n)]


class Aligner:
    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        n_a, n_b = len(a.lengths), len(b.lengths)
        # The written form of each id with what follows it: A , | then B , ; and B with nothing at a text's end.
        self.base = np.cumsum([0, n_a, n_a, n_b, n_b])
        self.written = [*_names(n_a, ","), *_names(n_a, "|"), *_names(n_b, ","), *_names(n_b, ";"), *_names(n_b, "")]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """Of each text: tokens of A and of B, groups, overlapping pairs, the digest of the groups, linked id pairs.

        A pair is a number, A's id times 2^32 plus B's.
        """
        spaced = [" " + t if t else "" for t in texts]
        ids = [(x, y) if t and x is not None and y is not None else (b"", b"") for t, x, y in zip(spaced, self.a.ids(spaced), self.b.ids(spaced), strict=True)]
        a, b = (np.frombuffer(b"".join(x[i] for x in ids), "<u4").astype(np.int64) for i in (0, 1))
        text_a, text_b = (np.concatenate(([0], np.cumsum([len(x[i]) // 4 for x in ids]))) for i in (0, 1))
        if not len(a):
            yield from ((0, 0, 0, 0, "", np.empty(0, np.int64)) for _ in texts)
            return
        ia, ib, over = common_ends(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), text_a, text_b)
        # Places in the written groups: a token of A comes after the B tokens of earlier groups, one of B after its group's A.
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ia], last_b[ib] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate(([0], ib + 1))[group_a]] = a + self.base[np.where(last_a, 1, 0)]
        end = np.zeros(len(b), bool)
        end[text_b[1:][np.diff(text_b) > 0] - 1] = True
        code[np.arange(len(b)) + (ia + 1)[group_b]] = b + self.base[np.where(end, 4, np.where(last_b, 3, 2))]
        written = self.written.__getitem__
        pairs = a[ia] << 32 | b[ib]
        cut = np.searchsorted(ia, text_a)
        sums = np.concatenate(([0], np.cumsum(over)))
        shorter = text_a if len(a) <= len(b) else text_b
        at, code = (text_a + text_b).tolist(), code.tolist()
        for i in range(len(texts)):
            n_a, n_b = int(text_a[i + 1] - text_a[i]), int(text_b[i + 1] - text_b[i])
            digest = hashlib.sha256("".join(map(written, code[at[i] : at[i + 1]])).encode()).hexdigest() if n_a else ""
            yield n_a, n_b, int(cut[i + 1] - cut[i]), int(sums[shorter[i + 1]] - sums[shorter[i]]), digest, pairs[cut[i] : cut[i + 1]]


ROWS = [("chunk", pa.int64()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())]
ROWS_DDL = "chunk long, pair int, a int, b int, n long, id long, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, links binary"
RESULT = [("id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_best", "long"), ("count_sum", "long"), ("groups_sha256", "string"), ("n_overlaps", "long")]

_aligners: dict[bytes, Aligner] = {}


def _chunk_rows(sent, pattern: str):
    def run(batches):
        key = hashlib.sha256(sent.value[0] + sent.value[1]).digest()
        if (aligner := _aligners.get(key)) is None:
            aligner = _aligners[key] = Aligner(ByteLevel(sent.value[0], pattern), PieceModel(sent.value[1]))
        pack, first = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 32

        def chunk(number: int, held: list[tuple]):
            pairs = np.concatenate([x[-1] for x in held])
            found, place, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            for i, (pair, n) in enumerate(zip(found.tolist(), counts.tolist(), strict=True)):
                yield number, i, pair >> 32, pair & 0xFFFFFFFF, n, *[None] * 7
            at = 0
            for row_id, n_a, n_b, n_groups, over, digest, own in held:
                links = np.sort(place[at : at + len(own)]).astype("<u4")
                at += len(own)
                yield number, None, None, None, None, row_id, n_a, n_b, n_groups, over, digest, pack(np.diff(links, prepend=links[:1] * 0).astype("<u4").tobytes())

        def rows():
            number, held, size, block, block_size = first, [], 0, [], 0
            for batch in batches:
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    block.append((row_id, text))
                    block_size += len(text or "")
                    if block_size >= BLOCK or len(block) >= 4096:
                        held += [(i, *x) for (i, _), x in zip(block, aligner.align([t for _, t in block]), strict=True)]
                        size, block, block_size = size + block_size, [], 0
                        if size >= CHUNK or len(held) >= 1 << 17:
                            yield from chunk(number, held)
                            number, held, size = number + 1, [], 0
            held += [(i, *x) for (i, _), x in zip(block, aligner.align([t for _, t in block]), strict=True)]
            if held:
                yield from chunk(number, held)

        return rebatch(rows(), pa.schema(ROWS))

    return run


def _scores(batches):
    """Rows sorted by chunk, pairs before texts: each text with its links' counts."""
    unpack = zstandard.ZstdDecompressor().decompress

    def rows():
        now, counts, best = None, [], []
        for batch in batches:
            chunk, pair, count, is_best = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            texts = batch.select(range(4, batch.num_columns))
            is_text = np.isnan(pair) if pair.dtype.kind == "f" else np.zeros(len(pair), bool)
            edge = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (is_text[1:] != is_text[:-1]), [True])))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if chunk[lo] != now:
                    now, counts, best = chunk[lo], [], []
                if not is_text[lo]:
                    counts.append(count[lo:hi].astype(np.int64))
                    best.append(is_best[lo:hi].astype(np.int64))
                    continue
                n, top = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, best))
                counts, best = [n], [top]
                for row_id, n_a, n_b, n_groups, over, digest, links in zip(*(c.to_pylist() for c in texts.slice(lo, hi - lo).columns), strict=True):
                    at = np.cumsum(np.frombuffer(unpack(links), "<u4").astype(np.int64)) if n_a else np.empty(0, np.int64)
                    yield row_id, n_a, n_b, n_groups, len(at), int(top[at].sum()), int(n[at].sum()), digest, over

    kinds = {"long": pa.int64(), "string": pa.string()}
    return rebatch(rows(), pa.schema([(n, kinds[t]) for n, t in RESULT]))


def align_tokenizers(docs: DataFrame, byte_level_path: str, piece_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, tokens of A and B, groups, links, links that are their B id's most frequent, sum of the links' counts, digest.

    A (byte-level JSON) encodes a space and the text, B (piece model) the text, to which it adds that space. A link is a
    token of A and one of B that end at the same byte; a pair's count is over all rows. n_overlaps counts the pairs of
    tokens that share a byte. Null and empty texts, and those whose tokens don't give the text's bytes back in either
    encoding (as with U+2581 in it), have zeros and an empty digest. Repeated rows count and come back as often as they
    stand there; null ids stay; an empty table gives an empty one; other columns are not read. Ids are cast to long.
    Ties for the most frequent partner all count. Vocabularies are read by the driver and sent to the workers.
    """
    spark = docs.sparkSession
    with open(byte_level_path, "rb") as f, open(piece_path, "rb") as g:
        sent = spark.sparkContext.broadcast((f.read(), g.read()))
    if json.loads(sent.value[0])["model"]["type"] != "BPE":
        raise ValueError("not a BPE vocabulary: " + byte_level_path)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_chunk_rows(sent, pattern), ROWS_DDL))
    pairs = rows.where("pair is not null").select("chunk", "pair", "a", "b", "n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # One row for each id of B at most: bounded by its vocabulary.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    counts = counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    # A pair stands once in a chunk, so no key of this join has more rows than there are chunks.
    scored = pairs.join(counts, ["a", "b"]).select("chunk", "pair", "count", "best")
    held = ["id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "links"]
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in held]
    of_texts = rows.where("pair is null").select("chunk", F.lit(None).cast("int").alias("pair"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), *held)
    both = scored.select("chunk", "pair", "count", "best", *empty).unionByName(of_texts)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.col("pair").asc_nulls_last())
    return dealt.mapInArrow(_scores, ", ".join(f"{n} {t}" for n, t in RESULT)).withColumnRenamed("id", id_col)
