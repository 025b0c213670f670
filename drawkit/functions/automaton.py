"""All terms of a list that a text holds, in one pass over the text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class TermAutomaton:
    """A trie of the terms with failure links; `ends` names the term that ends at a node, `shorter` the next node down the links where one ends."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = sorted({t for t in terms if t})
        self.step: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for i, term in enumerate(self.terms):
            at = 0
            for c in term:
                if (nxt := self.step[at].get(c)) is None:
                    nxt = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self.fail, self.shorter = [0] * len(self.step), [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for c, nxt in self.step[at].items():
                link = self.fail[at]
                while link and c not in self.step[link]:
                    link = self.fail[link]
                self.fail[nxt] = self.step[link].get(c, 0)
                todo.append(nxt)
            link = self.fail[at]
            self.shorter[at] = link if self.ends[link] >= 0 else self.shorter[link]

    def found(self, text: str) -> set[int]:
        """The numbers of the terms in the text."""
        step, fail, ends, shorter = self.step, self.fail, self.ends, self.shorter
        out: set[int] = set()
        at = 0
        for c in text:
            while (nxt := step[at].get(c)) is None and at:
                at = fail[at]
            at = nxt or 0
            node = at if ends[at] >= 0 else shorter[at]
            while node and ends[node] not in out:  # what is known was followed down before
                out.add(ends[node])
                node = shorter[node]
        return out
