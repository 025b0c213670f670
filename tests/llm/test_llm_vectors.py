"""Token alignment, whitening and embedding near-duplicates against brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from drawkit.llm import token_alignment, vector_dedup, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- token alignment


@pytest.fixture(scope="module")
def aligner():
    with open(JSON, "rb") as f, open(MODEL, "rb") as g:
        return token_alignment.Aligner(token_alignment.ByteLevel(f.read(), public_tokenizers.PATTERN), token_alignment.PieceModel(g.read()))


def aligned_by_hand(aligner, text):
    """(tokens of A, tokens of B, groups, overlaps, digest, links) by comparing every end with every end."""
    none = (0, 0, 0, 0, "", [])
    if not text:
        return none
    a = aligner.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.model.encode(text)
    bytes_a, bytes_b = ([side.token_bytes[i] for i in ids] for side, ids in ((aligner.a, a), (aligner.b, b)))
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return none
    ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b))
    both = sorted({*ends_a} & {*ends_b})
    links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f]
    groups = []
    for low, high in zip([0, *both], both, strict=False):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b))))
    over = sum((ends_a[i - 1] if i else 0) < ends_b[j] and (ends_b[j - 1] if j else 0) < ends_a[i] for i in range(len(a)) for j in range(len(b)))
    return len(a), len(b), len(both), over, hashlib.sha256(";".join(groups).encode()).hexdigest(), sorted(links)


PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "▁", "<s>", "<|endoftext|>", "'s", "'S", " '", "1", "23", "\x00", "\x85", "\x1c", " ", " ", "　", ".", ",", "ﬁ", "ß", "\r", "​", "क", "ा", "\U0001f9ff", "\U00010400", "ࡰ", "<0x0A>", "½", "́"]
EDGES = [None, "", " ", "\n", "  ", "a", "▁", "\n\na", " a ", "a  ", "<|endoftext|>", "x" * 3000, "日" * 500, " \n" * 400]


def test_alignment_of_texts_made_of_awkward_parts(aligner):
    rng = random.Random(11)
    texts = EDGES + ["".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(1500)]
    for text, got in zip(texts, aligner.align(texts), strict=True):
        want = aligned_by_hand(aligner, text) if len(text or "") < 1000 else None
        if want:
            assert (*got[:5], sorted((int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got[5])) == want, repr(text)
        elif text:
            assert got[0] and got[1] and got[2] == len(got[5]), repr(text[:20])


def test_gallop_is_a_search_for_ranks():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (7, 400), (300, 301), (50, 50)):
        short, long = (np.sort(rng.choice(1000, size=k, replace=False)) for k in (n, m))
        for start in (np.zeros(n, int), np.full(n, 10**6), rng.integers(-5, m + 5, n)):
            assert token_alignment.gallop(short, long, start).tolist() == np.searchsorted(long, short).tolist()
    a, b = np.array([2, 5, 9]), np.array([1, 2, 6, 7, 9])
    assert token_alignment.overlaps(a, b) == [(0, 1), (2, 2), (2, 4)]


def test_a_piece_model_whose_pieces_cross_words_gets_whole_texts(aligner):
    assert aligner.b.apart
    whole = token_alignment.PieceModel(open(MODEL, "rb").read())
    whole.apart = False
    texts = [" two  words\nand a line", " x"]
    assert whole.ids(texts) == aligner.b.ids(texts)


def test_align_tokenizers_counts_over_the_whole_table(spark, aligner, monkeypatch):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "the same text"), (None, "the same text"), (5, "a"), (5, "the a")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = [r for r in rows if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_a", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("id", F.lit("x"))
    by_hand = [(i, aligned_by_hand(aligner, t)) for i, t in rows]
    count, most = {}, {}
    for _, x in by_hand:
        for link in x[5]:
            count[link] = count.get(link, 0) + 1
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    want = [(i, x[0], x[1], x[2], len(x[5]), sum(count[p] == most[p[1]] for p in x[5]), sum(count[p] for p in x[5]), x[4], x[3]) for i, x in by_hand]
    got = token_alignment.align_tokenizers(docs, JSON, MODEL, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    nothing = token_alignment.align_tokenizers(docs.limit(0), JSON, MODEL, public_tokenizers.PATTERN)
    assert nothing.count() == 0 and nothing.columns == got.columns


# --- whitening


def whitened_by_numpy(rows, most=16):
    kept = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([np.floor(64 * v) for _, v in kept]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    v = np.cov((fit - s // n).T, bias=True)
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    return [i for i, _ in kept], n, deviation, ((x - s // n) - (s / n - s // n)) @ c / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("v", [np.eye(6), np.zeros((4, 4)), np.array([[3.0]]), np.array([[2.0, 1], [1, 2]]), np.outer(np.arange(9.0), np.arange(9.0)), np.kron(np.eye(6), [[2.0, 1], [1, 2]]), np.diag([1.0, 5, 3, 3, 3, 2]), 1e-200 * np.eye(4) + 1e-201, np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)], ids=range(9))
def test_leading_components_of_hard_matrices(v):
    k = min(16, len(v))
    values, components = whitening.leading_components(v, k)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() <= 1e-13 * size
    assert np.abs(components @ components.T - np.eye(k)).max() < 1e-13
    assert np.abs(v @ components.T - components.T * values).max() <= 1e-13 * size


def test_sturm_counts_are_numbers_of_smaller_eigenvalues():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(12), rng.standard_normal(11)
    e[4] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.concatenate((rng.uniform(-4, 4, 50), [-99, 99]))
    assert whitening.sturm_counts(d, e, at).tolist() == [int((values < x).sum()) for x in at]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((200, 20)) * np.linspace(0.1, 1, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(None, base[0].tolist()), (3, base[0].tolist()), (3, base[0].tolist())]
    rows += [(900, None), (901, []), (902, [None] * 20), (903, [math.nan] * 20), (904, [math.inf] * 20), (905, [1.0] * 19)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("n", F.lit("clash")).withColumn("y", F.lit(0)).withColumn("id", F.lit(""))
    got = whitening.whiten(df)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids, n, deviation, whitened, explained = whitened_by_numpy([r for r in rows if r[0] != 905])
    found = got.collect()
    assert len(found) == 16 * len(ids) == 16 * 203 and {r.n for r in found} == {n} == {200}
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = np.zeros(16)
    for i, d, w in zip(ids, deviation, whitened, strict=True):
        own = by_row[i, d]
        for c in range(16):
            x = own[c + 1][0]
            signs[c] = signs[c] or np.sign(w[c] * x.whitened)
            assert x.whitened == pytest.approx(signs[c] * w[c], abs=1e-8) and x.explained == pytest.approx(explained[c], rel=1e-9)
    assert max(r.identity_error for r in found) < 1e-9 and len({r.identity_error for r in found}) == 1


def test_whitening_where_little_varies(spark):
    ddl = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], ddl)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0, 1.0]), (2, [0.5, 2.0, 1.0])], ddl)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], ddl)).collect()
    assert len(line) == 8 and {r.component for r in line if r.whitened is None} == {2}
    assert {round(r.explained, 9) for r in line} == {0.0, 1.0} and max(r.identity_error for r in line) < 1e-12
    large = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0]), (4, [1e30, 0.0])], ddl)).collect()
    assert {r.vec_id for r in large} == {1, 2, 3} and {r.deviation is None for r in large} == {True, False}


# --- embedding near-duplicates


def links_by_hand(rows, least=0.9):
    """[(id, links, component)] by comparing all with all."""
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if usable[i] and usable[j] and len(a) == len(b):
                a, b = ([math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for v in (rows[i][1], b))
                cosine = math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))
                if cosine >= least:
                    near[i].append(j)
                    near[j].append(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = [j for j in near[todo.pop()] if j not in group]
                group.update(new)
                todo += new
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], len(near[j]), min(ids) if ids else None)
    return sorted(out, key=repr)


def clustered(seed, n, d, spread):
    """Groups of very different sizes and widths, some overlapping, and vectors of no group."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    out = [centres[rng.integers(6) if i % 3 else 0] * rng.uniform(0.1, 9) + spread * rng.standard_normal(d) * rng.choice([0.05, 0.3, 1.0]) for i in range(n)]
    return [v.tolist() for v in out] + rng.standard_normal((n // 4, d)).tolist()


@pytest.mark.parametrize(("d", "spread", "how"), [(3, 0.5, {"per_cell": 20, "member_bytes": 1}), (8, 0.6, {"per_cell": 30}), (16, 0.5, {"per_cell": 60, "member_bytes": 1}), (2, 1.0, {})])
def test_vector_dedup_against_all_pairs(spark, d, spread, how, monkeypatch):
    vectors = clustered(d, 320, d, spread)
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[1]], [-x for x in vectors[2]]]
    rows = list(enumerate(vectors, start=10))
    random.Random(d).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = vector_dedup.vector_dedup(df, **how).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == links_by_hand(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_dedup_edge_rows(spark):
    tiny, huge = 1e-160, 1e200
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0])]
    rows += [(11, [tiny, tiny]), (12, [huge, huge]), (13, [1.0, 1.0, 0.0]), (14, [2.0, 2.0, 0.0]), (15, [-1.0]), (16, [-2.0]), (17, [-0.0, 1.0]), (18, [0.0, 1.0]), (None, [0.0, -1.0])]
    # A cosine of 0.9 to the last bit links, one just below doesn't.
    rows += [(20, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (21, [9.0, 3.0, 3.0, 1.0, 0.0, 0.0]), (22, [8.999999999, 3.0, 3.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumn("n", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("weight", F.lit(1)).withColumn("id", F.lit("x"))
    got = [(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.vector_dedup(df).collect()]
    assert sorted(got, key=repr) == links_by_hand(rows)
    assert (20, 1, 20) in got and (21, 2, 20) in got and (22, 1, 20) in got
    assert vector_dedup.vector_dedup(df.limit(0)).collect() == []


def test_a_core_needs_no_products_and_chunks_lose_no_link(spark, monkeypatch):
    """2,000 close vectors in one cell, far more than a chunk: all are linked though none are multiplied with each other."""
    rng = np.random.default_rng(2)
    vectors = (np.eye(8)[0] + 0.02 * rng.standard_normal((2000, 8))).tolist() + np.eye(8)[1:].tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = vector_dedup.vector_dedup(df, member_bytes=1, per_cell=700).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 2000} == {(1999, 0)}
    assert {r.n_links for r in got if r.vec_id >= 2000} == {0}


def test_op13_agrees_with_its_sql(spark):
    import duckdb
    from drawkit.llm import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(vector_dedup.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op13_vector_dedup(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()) == want
