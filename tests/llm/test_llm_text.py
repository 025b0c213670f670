"""Operators on documents against brute force: quality, BPE, word pieces, toxicity, SimHash, exact dedup, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from drawkit.llm import byte_bpe, exact_dedup, mixing, quality, simhash, toxicity, word_pieces
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "xx", "a"),
    (4, "The same text\nThe same text", "en", "a"),
    (5, "Thesame  text\nThe same text ", "en", "b"),
    (5, "Thesame  text\nThe same text ", "en", "b"),
    (None, "The same text\nThe same text\n\n", "de", None),
    (7, "one two three one two three one two three four" + " x" * 60, "fr", "a"),
    (8, "日本語 テキスト 😀 á b \x85 \x1c" + "#$*" * 30, "es", "c"),
    (9, "the of and to in is it was " * 4000, "en", "hot"),
]


def edge(spark, extra=True):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in EDGE]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    return df.withColumn("keep_id", F.lit("clash")).withColumn("n_words", F.lit(-1)).withColumn("windows", F.lit(0)).withColumn("_row", F.lit(1)).withColumn("key", F.lit("k")) if extra else df


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], DDL)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- quality


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    k, r = len(words), len(covered)
    return k, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, k < 50 or 100 * r > 50 * k


@pytest.mark.parametrize("make", [edge, documents])
def test_quality_base(spark, make):
    df = make(spark)
    got = rows_of(quality.quality(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *base(t)) for i, t in texts(df)), key=repr)


def test_quality_sorts_structs_when_hash_bits_meet(spark, monkeypatch):
    df = documents(spark)
    want = rows_of(quality.base_features(df), "doc_id", "n_repeat_words")
    monkeypatch.setattr(quality, "POSITION_BITS", 58)
    assert rows_of(quality.base_features(df), "doc_id", "n_repeat_words") == want


def histograms(text, lang):
    """Counts of character classes, and of common and other words, of a text."""
    words = WORD.findall(text)
    chars = [len(re.findall(c, text)) for c in quality.CLASSES]
    chars.append(sum(map(len, words)) - sum(chars))
    if lang not in quality.WORD_SHARES:
        return chars, None
    bare = [w[:-1] if w[-1] in ".,;:!?" else w for w in words]
    commons = [sum(w in quality.forms(c) for w in bare) for c in quality.WORD_SHARES[lang]]
    return chars, [len(words) - sum(commons), *commons]


def distance(counts, reference):
    h = lambda p: -sum(x * np.log2(x) for x in p if x > 0)
    p, q = np.array(counts) / sum(counts), np.array(reference) / sum(reference)
    return np.sqrt(max(0, h((p + q) / 2) - (h(p) + h(q)) / 2))


@pytest.mark.parametrize("make", [edge, documents])
def test_quality_distances(spark, make):
    df = make(spark)
    out = quality.quality(df, least_chars=50, least_words=20)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = []
    for r in df.select("doc_id", "text", "lang").collect():
        chars, commons = histograms(r.text or "", r.lang)
        refs = quality.WORD_SHARES.get(r.lang)
        c = round(distance(chars, quality.CHAR_SHARES[r.lang]), 5) if refs and sum(chars) >= 50 else None
        w = round(distance(commons, [100 - sum(refs.values()), *refs.values()]), 5) if refs and sum(commons) >= 20 else None
        want.append((r.doc_id, c, w, bool(not base(r.text or "")[5] and (c or 0) <= 0.24 and (w or 0) <= 0.33)))
    got = [(r.doc_id, *(None if x is None else round(x, 5) for x in (r.char_distance, r.word_distance)), r.kept) for r in out.collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[0] == w[0] and g[3] == w[3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 3e-5) for x, y in zip(g[1:3], w[1:3], strict=True))


def test_quality_of_junk_and_prose(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rng = random.Random(3)
    junk = [(10**6, " ".join("9$%" + str(i) for i in range(400)), "en"), (10**6 + 1, " ".join(f"menu{chr(97 + rng.randrange(26))}" for _ in range(300)), "en"), (10**6 + 2, "日本語 テキスト " * 400 + " ".join(map(chr, range(0x4E00, 0x4F00))), "de")]
    made = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in quality.quality(made).collect()}
    assert not any(out[i].kept for i, _, _ in junk)
    good = [out[r.doc_id] for r in labels.where("quality = 1").collect()]
    assert all(r.kept for r in good if not r.base_failed) and sum(not r.base_failed for r in good) > 100
    alone = quality.quality(docs.where("doc_id = 5")).first()
    assert alone == out[5]
    assert quality.quality(empty(spark)).count() == 0


def test_quality_by_corpus(spark):
    rng = random.Random(3)
    junk = {i: " ".join(f"menu{chr(97 + rng.randrange(26))}" for _ in range(300)) for i in (10**6, 10**6 + 1)}
    df = documents(spark).unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in junk.items()], DDL))
    got = {r.doc_id: r for r in quality.quality_by_corpus(df).collect()}
    hist, refs = {}, defaultdict(lambda: np.zeros(21))
    for r in df.collect():
        _, commons = histograms(r.text or "", r.lang)
        if commons and sum(commons) >= 50:
            hist[r.doc_id] = r.lang, np.array(commons)
            if not got[r.doc_id].base_failed:
                refs[r.lang] += hist[r.doc_id][1]
    near = defaultdict(list)
    for i, (of, n) in hist.items():
        assert got[i].word_distance == pytest.approx(distance(n, refs[of]), abs=2e-6)
        if not got[i].base_failed:
            near[of].append(round(got[i].word_distance, 3))
    limits = {k: np.percentile(v, 75) + 1.5 * (np.percentile(v, 75) - np.percentile(v, 25)) for k, v in near.items()}
    assert all((r.word_distance is None) == (i not in hist) for i, r in got.items())
    assert all(got[i].word_limit == pytest.approx(limits[of], abs=2e-6) for i, (of, _) in hist.items())
    assert all(r.kept == (not r.base_failed and (r.char_distance or 0) <= 0.36 and (r.word_distance or 0) <= (r.word_limit or 1)) for r in got.values())
    assert not any(got[i].kept or got[i].base_failed for i in junk)
    assert quality.quality_by_corpus(empty(spark)).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("make", [edge, documents])
def test_bpe_documents(spark, tik, make):
    df = make(spark)
    got = rows_of(byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in texts(df):
        ids = tik.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    ids = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, keep=["source"]).collect()
    assert all(r.round_trip for r in ids)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in ids), key=repr) == sorted(((i, tuple(tik.encode_ordinary(t))) for i, t in texts(df)), key=repr)
    assert byte_bpe.encode_documents(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_and_edits(tik):
    rng = random.Random(3)
    encoder = byte_bpe.Encoder(byte_bpe.vocabulary(RANKS), most_pairs=5000)
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüßéèñ日本語の "
    for _ in range(1500):
        data = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))).encode()
        assert encoder.piece(data) == tik._encode_single_piece(data)
    for _ in range(100):
        data = bytearray("".join(rng.choice(alphabet) for _ in range(300)).encode())
        now = byte_bpe.EditableEncoding(encoder, bytes(data))
        for _ in range(4):
            a = rng.randint(0, len(data))
            b = min(len(data), a + rng.randint(0, 9))
            new = bytes(rng.choice(b"abcdet ") for _ in range(rng.randint(0, 9)))
            now.replace(a, b, new)
            data[a:b] = new
            more = bytes(rng.choice(b"entsr") for _ in range(rng.randint(0, 5)))
            now.append(more)
            data += more
            assert bytes(now.data) == bytes(data)
            whole = byte_bpe.EditableEncoding(encoder, bytes(data))
            assert now.last == whole.last
            assert now.ids() == tik._encode_single_piece(bytes(data))
    long = byte_bpe.EditableEncoding(encoder, b"abcdefgh" * 2000)
    assert long.replace(5, 6, b"x") < 2000


# --- word pieces


def greedy(word, pieces, longest):
    at, n = 0, 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return None
        at, n = end, n + 1
    return n


def test_word_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(word_pieces.load_pieces(path))
    longest = max(map(len, pieces))
    for df in (edge(spark), documents(spark)):
        got = rows_of(word_pieces.count_tokens(df, path), "doc_id", "n_words", "n_tokens", "n_unknown")
        want = []
        for i, t in texts(df):
            counts = [greedy("▁" + w, pieces, longest) for w in WORD.findall(t)]
            want.append((i, len(counts), sum(1 if c is None else c for c in counts), counts.count(None)))
        assert got == sorted(want, key=repr)
    assert word_pieces.count_tokens(empty(spark), path).count() == 0


def test_longest_match_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 14))}
        own = word_pieces.LongestMatch(pieces)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert own.count(word) == greedy(word, pieces, 6)


# --- toxicity


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.where("pmod(xxhash64(doc_id), 4) > 0")
    model = toxicity.fit_toxicity(docs, fit)
    assert model.thresholds == sorted(model.thresholds)
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0")
    out = toxicity.score_toxicity(docs, model).join(held.withColumnRenamed("toxic", "was"), "doc_id").collect()
    right = sum(r.toxic == (r.was == 1) for r in out)
    assert right >= 0.97 * len(out)
    assert sum(r.toxic for r in out if r.was == 0) <= 0.01 * len(out)
    assert all(0 <= r.expected_severity <= 3 for r in out)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score_toxicity(docs, model).where("not toxic").count()
    odd = toxicity.score_toxicity(edge(spark), model)
    assert odd.count() == len(EDGE) and toxicity.score_toxicity(empty(spark), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("toxic").count() == 0


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 800)
    rows = [{"bad": int(3 * g) + 1} if g else {"fine": 1} for g in grades]
    model = toxicity.fit_ordinal(rows, grades, 4)
    expected = [sum(model.above(model.weights["bad"] * toxicity.value_of(3 * g + 1))) for g in (1, 2, 3)]
    assert expected == sorted(expected) and expected[2] - expected[0] > 1
    assert sum(model.above(model.weights["fine"])) < 0.5


def test_ordinal_fit_is_where_the_likelihood_is_flat():
    """At the fitted weights no small step, in any direction, makes the penalised likelihood better by more than its square."""
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 4, 400)
    rows = [{f"w{k}": int(rng.poisson(0.3 + (k == 0) * g + (k == 1) * (3 - g))) for k in range(4)} for g in grades]
    rows = [{f: n for f, n in r.items() if n} for r in rows]
    model = toxicity.fit_ordinal(rows, grades, 4, rounds=4000, rate=0.02)
    names, decay = sorted(model.weights), 1e-3

    def loss(w, theta):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            score = sum(w[f] * toxicity.value_of(n) for f, n in r.items())
            cdf = [0.0, *(1 / (1 + np.exp(-(t - score))) for t in theta), 1.0]
            total -= np.log(max(cdf[g + 1] - cdf[g], 1e-9))
        return total / len(rows) + decay / 2 / len(rows) ** 0.5 * sum(x * x for x in w.values())

    at = loss(model.weights, model.thresholds)
    for step in (1e-2, -1e-2):
        for f in names:
            assert loss({**model.weights, f: model.weights[f] + step}, model.thresholds) > at - 1e-5
        for k in range(3):
            assert loss(model.weights, [t + step * (i == k) for i, t in enumerate(model.thresholds)]) > at - 1e-5


def slow_severity(model, text):
    """P(grade > k) straight from the model's words and thresholds."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found = [f for f in (word, *("^" + word[:n] for n in (4, 5) if len(word) > n)) if f in model.weights]
        counts.update(found + ["+"] * any(f in model.pure for f in found))
    score = sum(model.weights[f] * (1 + np.log(n)) for f, n in counts.items())
    return [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def test_toxicity_where_no_positive_label_has_a_document(spark):
    docs = spark.createDataFrame([(i, "some plain text") for i in range(5)], "doc_id long, text string")
    for given in ([(i, i > 4) for i in range(9)], [(i, i < 5) for i in range(9)], [(99, True), (98, False)]):
        labels = spark.createDataFrame([(i, int(t)) for i, t in given], "doc_id long, toxic int")
        out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
        assert len(out) == 5 and {r.grade for r in out} == {0}


def test_toxicity_fit_is_linear_in_long_texts(spark):
    import time

    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"{'bad' if i % 2 else 'good'}{rng.randrange(3000)}" for _ in range(6000))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    began = time.time()
    model = toxicity.fit_toxicity(docs, labels)
    assert model.weights and time.time() - began < 60


@pytest.mark.parametrize("graded", [False, True])
def test_toxicity_against_plain_scores(spark, graded):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        g = rng.randrange(4)
        rows.append((i, " ".join(rng.choice(["stone", "river", "cloud", "field"]) for _ in range(20)) + " vile" * g + (" Vileness!" if g else ""), "en", "s", 0))
        marks.append((i, g if graded else int(g > 0)))
    df, labels = spark.createDataFrame(rows, DDL), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    assert "vile" in model.weights and model.weights["vile"] > 0
    for made in (df, edge(spark)):
        text = {}
        for r in made.select("doc_id", "text").collect():
            text.setdefault(r.doc_id, []).append(slow_severity(model, r.text))
        for r in toxicity.score_toxicity(made, model).collect():
            above = next(a for a in text[r.doc_id] if abs(sum(a) - r.expected_severity) < 1e-6)
            assert (r.grade, r.toxic) == (sum(p > 0.4 for p in above), above[0] > 0.4) and r.p_toxic == pytest.approx(above[0], abs=1e-8)
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all(out[i].toxic == (m > 0) for i, m in marks)
    if graded:
        means = [np.mean([out[i].expected_severity for i, m in marks if m == g]) for g in range(4)]
        assert means == sorted(means)


# --- SimHash


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        r = find(p)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in prints]


def simhash_rows(df, most):
    g = simhash.simhash_groups(df, most=most)
    return sorted(((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in g.collect()), key=repr)


@pytest.mark.parametrize(("make", "most"), [(edge, 4096), (documents, 4096), (documents, 2)])
def test_simhash(spark, make, most):
    df = make(spark)
    want = slow_components([(i, slow_fingerprint(t)) for i, t in texts(df)])
    assert simhash_rows(df, most) == sorted(want, key=repr)
    stay = simhash.near_dedup(df)
    assert stay.columns == df.columns
    assert rows_of(stay, "doc_id", "text") == slow_near_dedup([(r.doc_id, r.text) for r in df.collect()])


def slow_near_dedup(rows):
    """One row of each component: the smallest id, nulls last, then the smaller digest."""
    comps = component_of([slow_fingerprint(t or "") for _, t in rows])
    best = {}
    for (i, t), c in zip(rows, comps, strict=True):
        rank = (i is None, i or 0, hashlib.sha256((t or "").encode()).digest())
        if c not in best or rank < best[c][0]:
            best[c] = rank, (i, t)
    return sorted((x for _, x in best.values()), key=repr)


def component_of(values):
    distinct = sorted(set(values))
    root = {v: v for v in distinct}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return [find(v) for v in values]


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.near_dedup])
def test_copies_go_by_rows(spark, drop):
    """Rows without an id, rows that repeat, and columns of any name."""
    rows = [(None, "x y z", "a"), (None, "x y z", "b"), (1, "a", "a"), (1, "a", "a"), (1, "q r s t", "c"), (2, "q r s t", "c"), (None, None, "d"), (7, "", "d"), (7, "", None), (8, "entirely other words here", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for c in ("_gone", "id", "sha", "row", "n_cp", "fp", "stays", "a.b"):
        df = df.withColumn(c, F.lit("clash"))
    got = drop(df)
    assert got.columns == df.columns
    assert rows_of(got, "doc_id", "text") == sorted([(None, "x y z"), (1, "a"), (1, "q r s t"), (7, ""), (8, "entirely other words here")], key=repr)
    assert drop(df.limit(0)).count() == 0
    for report in (exact_dedup.dedup_report(df), exact_dedup.exact_dedup(df)):
        kept = Counter(r.text_sha256 for r in report.where("kept").collect())
        assert report.count() == len(rows) and set(kept.values()) == {1} and len(kept) == 5


def test_simhash_with_three_of_six_blocks(spark):
    assert len(simhash.masks(4, 1)) == 4 and len(simhash.masks(6, 3)) == 20
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in sorted(values)[:200]:
        for b in rng.sample(range(64), rng.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    values = sorted(values)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(prints, many=1)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[roots.get(simhash.signed(v), simhash.signed(v))].add(v)
    want = defaultdict(set)
    for v, c in zip(values, component_of(values), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_links_of_dense_balls(spark):
    rng = random.Random(9)
    values = set()
    for center in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(150):
            v = center
            for b in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << b
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(400)}
    values = sorted(values)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for most in (16, 4096):
        roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(prints, most)).collect()}
        groups = defaultdict(set)
        for v in values:
            s = simhash.signed(v)
            groups[roots.get(s, s)].add(v)
        want = defaultdict(set)
        for v, (_, _, c) in zip(values, slow_components([(i, v) for i, v in enumerate(values)]), strict=True):
            want[c].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("most", [1, 2])
def test_simhash_links_of_single_chunks(spark, most):
    base = [0x0123456789ABCDEF, 0xFEDCBA9876543210, 0x5555AAAA0F0F3333]
    values = [v ^ m for v in base for m in (0, 1, 1 << 17, 1 << 40 | 1 << 63)]
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(prints, most)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[roots.get(simhash.signed(v), simhash.signed(v))].add(v)
    want = defaultdict(set)
    for v, (_, _, c) in zip(values, slow_components([(i, v) for i, v in enumerate(values)]), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_empty(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 199)] + [(300, 301 + i) for i in range(30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100 and got[200] == 199 and got[330] == 300


# --- exact dedup


def slow_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = defaultdict(list)
    for i, t in docs:
        groups[norm(t)].append((-len(t), i is None, i))
    out = []
    for i, t in docs:
        g = groups[norm(t)]
        n, _, keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, keep, len(g), i == keep and -len(t) == n, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [edge, documents])
@pytest.mark.parametrize("limits", [{}, {"most_bytes": 60_000, "fold_bytes": 500}])
def test_exact_dedup(spark, make, limits):
    df = make(spark)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = slow_dedup(texts(df))
    assert rows_of(exact_dedup.dedup_report(df, **limits), *cols) == want
    assert rows_of(exact_dedup.exact_dedup(df, **limits), *cols) == want


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_content_table():
    t = exact_dedup.ContentTable(1 << 20)
    for i in range(3000):
        assert t.add(str(i % 1500).encode()) == (i % 1500, i < 1500)
    assert t.find(b"7") == 7 and t.find(b"x") is None and len(t) == 1500


# --- mixing


def test_mixing_marginals(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = mixing.mix(df, power=0.7).cache()
    slow = [(r.doc_id, len(WORD.findall(r.text))) for r in df.collect()]
    assert rows_of(m, "doc_id", "n_tokens") == sorted(slow, key=repr)
    for d in mixing.DIMENSIONS:
        got = {r[0]: (r.w, r.n) for r in m.groupBy(d).agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w"), F.sum("n_tokens").alias("n")).collect()}
        power = sum(n**0.7 for _, n in got.values() if n)
        total = sum(n for _, n in got.values())
        for w, n in got.values():
            assert w / total == pytest.approx(n**0.7 / power if n else 0, abs=2e-4)
    assert m.agg(F.max("probability")).first()[0] == pytest.approx(1)
    expected, kept = m.agg(F.sum("probability"), F.count_if("sampled")).first()
    assert abs(expected - kept) < 5 * expected**0.5
    s = mixing.sample(df, power=0.7)
    assert s.columns == df.columns
    assert rows_of(s, "doc_id") == rows_of(m.where("sampled"), "doc_id")


def test_mixing_edges(spark):
    m = mixing.mix(edge(spark))
    assert m.count() == len(EDGE)
    assert {r.weight for r in m.where("n_tokens = 0 and lang is null").collect()} == {0.0}
    assert mixing.mix(empty(spark)).count() == 0
    given = {"source": spark.createDataFrame([("a", 0.5), ("hot", 0.5)], "value string, share double")}
    cells = spark.createDataFrame([("a", "en", "x", 10), ("hot", "en", "x", 30), ("b", "en", "x", 60)], "source string, lang string, topic string, n long")
    given |= {"lang": spark.createDataFrame([("en", 1.0)], "value string, share double"), "topic": spark.createDataFrame([("x", 1.0)], "value string, share double")}
    got = {r.source: r.weight for r in mixing.rake(cells, given).collect()}
    assert got == pytest.approx({"a": 5.0, "hot": 100 * 0.5 / 30, "b": 0.0})


def test_mixing_rows_without_ids_go_by_their_text(spark):
    rows = spark.createDataFrame([(None, f"text number {i} of many", "en", "a", 1) for i in range(200)] + [(7, "same id", "en", "a", 1)] * 3, DDL)
    out = mixing.mix(rows, rate=0.5).where("doc_id is null")
    assert 70 <= out.where("sampled").count() <= 130
    kept = mixing.sample(rows, rate=0.5)
    assert kept.where("doc_id is null").count() == out.where("sampled").count() and kept.where("doc_id = 7").count() in (0, 3)


def test_mixing_small_cell(spark):
    """A rare cell is taken whole and cuts nothing else; the expected tokens are the rate's."""
    make = lambda *rows: spark.createDataFrame(list(rows), "source string, n long, weight double")
    chances = lambda cells, rate: [r.probability for r in mixing._probabilities(cells, rate).orderBy("source").collect()]
    large = [("a", 600, 0.9), ("b", 400, 1.15)]
    alone, beside = chances(make(*large), mixing.RATE), chances(make(*large, ("c", 1, 40.0)), mixing.RATE)
    assert alone == pytest.approx([0.45, 0.575]) and beside[2] == 1
    assert all(x > 0.99 * y for x, y in zip(beside, alone, strict=False))
    cells = make(("a", 10, 8.0), ("b", 100, 2.0), ("c", 1000, 0.72), ("d", 50, 0.0))
    for rate, factor in [(0.5, 0.47 / 0.72), (0.05, 0.05)]:
        got = chances(cells, rate)
        assert sum(p * n for p, n in zip(got, (10, 100, 1000, 50), strict=True)) == pytest.approx(rate * 1160, rel=0.15 if rate < 0.1 else 1e-9)
        assert got[2] == pytest.approx(0.72 * factor, rel=1e-9) if rate == 0.5 else got[2] > 0
    assert chances(cells, 1.0) == [1, 1, 1, 0]
    assert chances(make(), 0.5) == []


def plain_rake(n, wants, rounds=500):
    """Proportional fitting of an array (source, language, topic) to its three marginals."""
    w = np.where(n > 0, 1.0, 0.0)
    for _ in range(rounds):
        for axis, want in enumerate(wants):
            sums = (n * w).sum(axis=tuple(i for i in range(3) if i != axis))
            f = np.divide(want * n.sum(), sums, out=np.zeros_like(sums), where=sums > 0)
            w = w * f.reshape([-1 if i == axis else 1 for i in range(3)])
    return w


def test_mixing_weights_against_plain_fit(spark):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 500, (4, 3, 2)) * (rng.random((4, 3, 2)) > 0.15)
    wants = [x / x.sum() for x in (n.sum((1, 2)) ** 0.6, n.sum((0, 2)) ** 0.6, n.sum((0, 1)) ** 0.6)]
    cells = spark.createDataFrame([(f"s{i}" if i else None, f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, n long")
    names = {"source": [None, "s1", "s2", "s3"], "lang": ["l0", "l1", "l2"], "topic": ["t0", "t1"]}
    targets = {d: spark.createDataFrame(list(zip(names[d], map(float, w), strict=True)), "value string, share double") for d, w in zip(names, wants, strict=True)}
    got = mixing.rake(cells, targets, tolerance=1e-9).collect()
    want = plain_rake(n, wants)
    for r in got:
        at = names["source"].index(r.source), names["lang"].index(r.lang), names["topic"].index(r.topic)
        assert r.weight == pytest.approx(want[at], rel=1e-5) and r.off <= 1e-9
    torn = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, n long")
    unmet = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("x", 0.1), ("y", 0.9)], "topic": [("t", 1.0)]}
    assert mixing.rake(torn, {d: spark.createDataFrame(v, "value string, share double") for d, v in unmet.items()}).first().off > 0.1
