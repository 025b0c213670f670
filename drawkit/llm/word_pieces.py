"""Token counts by a linear longest-match automaton.

Greedy word pieces take, at each place of a word, the longest piece of the vocabulary. A trie of the pieces with
failure links does that without ever going back: when the word leaves the trie, the link leads to the node for what
the greedy pieces leave over, and a number stored with it says how many pieces were taken off. Only numbers are
added up; no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, rebatch, text_or_empty

#: Begins every word, as in the vocabulary's pieces that begin one.
MARK = "▁"


class LongestMatch:
    """Trie over the pieces; fail[v] and popped[v] are the link of node v and the pieces taken off along it."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        ends = {0: False}
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.step[at].get(c)
                if nxt is None:
                    nxt = self.step[at][c] = len(self.step)
                    self.step.append({})
                    ends[nxt] = False
                at = nxt
            ends[at] = at != 0
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        queue = deque((0, c, v) for c, v in self.step[0].items())
        while queue:
            parent, c, v = queue.popleft()
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
            else:
                link, taken = self.fail[parent], self.popped[parent]
                while link >= 0 and c not in self.step[link]:
                    taken += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[v], self.popped[v] = self.step[link][c], taken
            queue.extend((v, x, y) for x, y in self.step[v].items())

    def count(self, word: str) -> int | None:
        """The number of greedy pieces of the word; None if pieces don't cover it."""
        step, fail, popped = self.step, self.fail, self.popped
        at = taken = 0
        for c in word:
            while (nxt := step[at].get(c)) is None:
                taken += popped[at]
                at = fail[at]
                if at < 0:
                    return None
            at = nxt
        while at:
            taken += popped[at]
            at = fail[at]
            if at < 0:
                return None
        return taken


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=4)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(load_pieces(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, most_words: int = 1 << 19) -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) per row, over the words between ASCII white space.

    A word that pieces don't cover is one token and counts as unknown. A null text counts as empty: zeros. Repeated
    rows give repeated rows, an empty table an empty one; other columns are not read. Each worker remembers up to
    most_words words; words beyond 60 bytes are not remembered.
    """
    sent = docs.sparkSession.sparkContext.broadcast(automaton(model_path))
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches):
        known: dict[bytes, int] = {}
        count = sent.value.count

        def look(word: bytes) -> int:
            got = count(MARK + word.decode())
            got = -1 if got is None else got
            if len(word) <= 60:
                if len(known) >= most_words:
                    known.clear()
                known[word] = got
            return got

        def rows():
            for batch in batches:
                for row_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    words = text.split()
                    counts = [known.get(w) or look(w) for w in words]
                    unknown = counts.count(-1)
                    yield row_id, len(words), sum(counts) + 2 * unknown, unknown

        return rebatch(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, n_words long, n_tokens long, n_unknown long")
