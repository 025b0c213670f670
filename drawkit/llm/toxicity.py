"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector w for all thresholds theta_0 < theta_1 < ...; the
expected severity is the sum of P(grade > k). Features are words (letters, lower case) and their first letters,
as 1 + log(count). Those that say something about the labels are chosen by how unlikely their share of positive rows
is (Chernoff's bound, over all features that were seen); their number is bounded, and so is the model that goes to the workers.

Labels may carry ordered grades, and then the model learns these. Where they are only 0 and 1 there is nothing to learn
an order from: the positive rows get the grades 1..n by the number of features in them that speak for toxicity, cut at
equal parts of the labelled positives. Such grades, and the expected severity made of them, say how much of what marks
toxic texts a text holds, not how an annotator would grade it. The bound on labelled rows is the one limit of the fit.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rebatch, stored, text_or_empty

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
#: The feature of a word that has any feature which speaks for toxicity without exception so far.
ANY = "+"


def value_of(count):
    """A feature's value: one for its presence, and the logarithm of how often it comes."""
    return 1 + np.log(count)


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def chosen_of(word: str, known, pure: frozenset[str]) -> tuple[str, ...]:
    """The word's features among the known ones, with ANY if one of them is pure."""
    found = tuple(f for f in features_of(word) if f in known)
    return (*found, ANY) if any(f in pure for f in found) else found


@dataclass
class OrdinalModel:
    """Weights by feature and the ascending thresholds; grades are 0..len(thresholds). pure: features that bring ANY."""

    weights: dict[str, float]
    thresholds: list[float]
    pure: frozenset[str] = frozenset()

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each k."""
        return [1 / (1 + np.exp(min(700.0, t - score))) for t in self.thresholds]


def fit_ordinal(rows: list[dict[str, int]], grades: np.ndarray, n_grades: int, *, rounds: int = 1500, rate: float = 0.05, decay: float = 1e-3) -> OrdinalModel:
    """Full-gradient Adam on the ordinal log likelihood. rows: counts by feature; their number is bounded by the caller."""
    names = sorted({f for r in rows for f in r})
    index = {f: i for i, f in enumerate(names)}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([index[f] for r in rows for f in r], np.int64)
    val = value_of(np.array([n for r in rows for n in r.values()], float))
    w = np.zeros(len(names))
    # theta_0 and positive gaps keep the thresholds in order.
    share = np.array([max(1e-3, min(1 - 1e-3, (grades <= k).mean())) for k in range(n_grades - 1)])
    theta = np.log(share / (1 - share))
    base, gaps = theta[0], np.log(np.maximum(0.1, np.diff(theta)))
    drift, spread = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for turn in range(1, rounds + 1):
        theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(at, w[col] * val, len(rows))
        cdf = np.hstack((np.zeros((len(rows), 1)), sigmoid(theta[None, :] - score[:, None]), np.ones((len(rows), 1))))
        slope = cdf * (1 - cdf)
        i = np.arange(len(rows))
        p = np.maximum(cdf[i, grades + 1] - cdf[i, grades], 1e-9)
        d_score = (slope[i, grades + 1] - slope[i, grades]) / p / len(rows)  # of the negative log likelihood
        d_theta = np.array([(-slope[grades == k, k + 1] / p[grades == k]).sum() + (slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum() for k in range(len(theta))]) / len(rows)
        d_w = np.bincount(col, d_score[at] * val, len(w)) + decay * w / max(1, len(rows)) ** 0.5
        d_gap = np.array([d_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
        grad = np.concatenate((d_w, [d_theta.sum()], d_gap))
        drift, spread = 0.9 * drift + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        step = rate * drift / (1 - 0.9**turn) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        w -= step[: len(w)]
        base -= step[len(w)]
        gaps -= step[len(w) + 1 :]
    theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return OrdinalModel(dict(zip(names, w.tolist(), strict=True)), theta.tolist())


def _feature_counts(batches):
    """Per task: (feature, rows with it, positive rows with it) over rows (text, label)."""
    rows_with, positive_with = Counter(), Counter()
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("pos", pa.int64())])

    def out():
        yield from ((f, n, positive_with[f]) for f, n in rows_with.items())
        rows_with.clear()
        positive_with.clear()

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for word in set(WORDS.findall(text.lower())) for f in features_of(word)}
            rows_with.update(found)
            if label > 0:
                positive_with.update(found)
        if len(rows_with) > 500_000:
            yield from rebatch(out(), schema)
    yield from rebatch(out(), schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, most_labelled: int = 20_000, n_grades: int = 4) -> OrdinalModel:
    """A model from at most most_labelled labelled rows (those of the smallest hashed ids), over their whole texts.

    Features are all those whose share of positive rows is too far from the whole's to be chance among as many as were
    seen; the driver holds their counts in the labelled rows. Labels that are null count as unlabelled, of a repeated id
    the highest counts, and a document that repeats is as many rows. Labels without a document say nothing. With no
    positive or no negative row among the labelled documents the model says grade 0 for all.
    """
    of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    of = of.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(of), "_id").select("_text", "_label")
    rows = stored(rows)  # the labelled texts alone: documents are read once
    n, positive = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_label") > 0)).first()
    if not positive or positive == n:
        return OrdinalModel({}, [50.0 + k for k in range(n_grades - 1)])
    share = positive / n
    counts = rows.mapInArrow(_feature_counts, "feature string, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    q = F.col("pos") / F.col("n")
    surprise = F.col("n") * (F.when(q > 0, q * F.ln(q / share)).otherwise(0.0) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - share))).otherwise(0.0))
    counts = stored(counts.select("feature", surprise.alias("surprise"), F.when(q > share, 1).otherwise(-1).alias("sign"), (F.col("pos") == F.col("n")).alias("pure")))
    seen = counts.count()
    chosen = counts.where(F.col("surprise") > float(np.log(max(1, seen)))).collect()
    signs = {r.feature: r.sign for r in chosen}
    pure = frozenset(r.feature for r in chosen if r.pure)
    if not signs:
        return OrdinalModel({}, [50.0 + k for k in range(n_grades - 1)])

    def sparse(batches):
        schema = pa.schema([("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("label", pa.int32())])

        def out():
            for batch in batches:
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = Counter(f for word, n in Counter(WORDS.findall(text.lower())).items() for f in chosen_of(word, signs, pure) for _ in range(n))
                    yield list(found), list(found.values()), label

        return rebatch(out(), schema)

    found = rows.mapInArrow(sparse, "names array<string>, counts array<long>, label int").collect()
    xs, given = [dict(zip(r.names, r.counts, strict=True)) for r in found], np.array([r.label for r in found])
    if given.max() > 1:
        grades, n_grades = np.minimum(given, n_grades - 1), n_grades
    else:
        hits = np.array([sum(c for f, c in x.items() if signs.get(f, 0) > 0) for x in xs])
        cuts = np.quantile(hits[given > 0], np.arange(1, n_grades - 1) / (n_grades - 1))
        grades = np.where(given > 0, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    model = fit_ordinal(xs, grades, n_grades)
    model.pure = pure
    return model


class Scorer:
    """Severities of texts; remembers the features of up to most_words words."""

    def __init__(self, model: OrdinalModel, most_words: int = 1 << 19) -> None:
        self.model, self.most_words = model, most_words
        self.known: dict[str, tuple[str, ...]] = {}

    def _look(self, word: str) -> tuple[str, ...]:
        got = chosen_of(word, self.model.weights, self.model.pure)
        if len(self.known) >= self.most_words:
            self.known.clear()
        self.known[word] = got
        return got

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each k."""
        known, look, counts = self.known, self._look, Counter()
        for word in WORDS.findall(text.lower()):
            if found := known[word] if word in known else look(word):
                counts.update(found)
        return self.model.above(sum(self.model.weights[f] * value_of(n) for f, n in counts.items()))


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", *, cut: float = 0.4) -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic) per row; toxic: P(grade > 0) is over cut, grade: how many are.

    What grades mean is what they meant in fit_toxicity().

    A null or empty text has no feature and gets the model's prior. Repeated rows give repeated rows, an empty table an
    empty one; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(id_col, pa.int64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def run(batches):
        scorer = Scorer(sent.value)

        def rows():
            for batch in batches:
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    above = scorer.above(text)
                    yield row_id, round(float(sum(above)), 9), sum(p > cut for p in above), round(float(above[0]), 9), bool(above[0] > cut)

        return rebatch(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", *, cut: float = 0.4) -> DataFrame:
    """The rows of docs that the model does not reject, with the columns of docs.

    Each row is judged where it is read, so no join by id is needed and repeated or missing ids do no harm.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for series in texts:
            yield pd.Series([scorer.above(text)[0] > cut for text in series], dtype=bool)

    return docs.where(~F.pandas_udf(toxic, "boolean")(text_or_empty(text_col)))
