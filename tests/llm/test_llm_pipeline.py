"""The pipeline and the registered queries."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from drawkit.llm import byte_bpe, mixing, queries, toxicity
from pyspark.sql import functions as F

from test_llm_text import slow_near_dedup, slow_severity

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty(), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count()
    assert sorted(map(tuple, last.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()))


def slow_stage(name, rows, model):
    """A stage by its definition, over (doc_id, text, lang, source, n_chars) tuples; None for the sample."""
    if name == "toxicity":
        return [r for r in rows if slow_severity(model, r[1])[0] <= 0.4]
    if name == "near_dedup":
        stay = Counter(slow_near_dedup([r[:2] for r in rows]))
    else:
        best = {}
        for r in rows:
            text = r[1] or ""
            rank = (-len(text), r[0] is None, r[0] or 0)
            group = re.sub(r"[\x20\x09-\x0D]", "", text)
            if group not in best or rank < best[group][0]:
                best[group] = rank, r
        stay = Counter(r[:2] for _, r in best.values())
    out = []
    for r in rows:
        if stay[r[:2]]:
            stay[r[:2]] -= 1
            out.append(r)
    return out


def test_each_stage_against_its_definition(spark):
    """With null and repeated ids, repeated rows, null, empty and very long texts, and columns of clashing names."""
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    odd = [(None, "x y z", "en", "a", 5), (None, "x y z", "en", "a", 5), (1, base[7][1], "en", "b", 9), (1, base[7][1], "en", "b", 9), (5, None, None, None, None), (5, "", "de", "b", 0), (10**6, long, "fr", "hot", len(long)), (10**6 + 1, long + " ", "fr", "hot", len(long) + 1), *base[:5]]
    rows = base + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clashes = ["_gone", "_row", "_cell", "_text", "id", "sha", "row", "fp", "n_tokens", "weight"]
    for c in clashes:
        docs = docs.withColumn(c, F.lit("kept"))
    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name == "byte_bpe":
            tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            got = sorted(((r.doc_id, r.n_tokens, tuple(r.ids)) for r in made.collect()), key=repr)
            assert got == sorted(((r[0], len(ids), tuple(ids)) for r in rows for ids in [tik.encode_ordinary(r[1] or "")]), key=repr)
            continue
        assert made.columns == docs.columns, name
        assert made.where(" or ".join(f"`{c}` <> 'kept'" for c in clashes)).isEmpty()
        got = Counter(tuple(r) for r in made.select("doc_id", "text", "lang", "source", "n_chars").collect())
        if name == "mixing":
            chosen = {(r.doc_id, r.source, r.lang) for r in mixing.mix(docs).where("sampled").collect()}
            want = Counter(r for r in rows if (r[0], r[3], r[2]) in chosen)
            assert got and not got - Counter(rows) and all((r[0], r[3], r[2]) in chosen for r in got) and sum(got.values()) <= sum(want.values())
        else:
            short = lambda counts: Counter((r[0], r[1]) for r in counts.elements())
            assert short(got) == short(Counter(slow_stage(name, rows, model))), name


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        done = con.execute(sql)
        names = [c[0] for c in done.description]
        want = [dict(zip(names, row, strict=True)) for row in done.fetchall()]
        got = [r.asDict() for r in made[name](spark, SF).collect()]
        key = lambda r: repr(sorted(r.items()))
        assert sorted(map(key, got)) == sorted(map(key, want)), name
