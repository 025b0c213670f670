"""Places of engineering tokens against Python's own matches, and time on hostile texts."""

import random
import re
import time

from pyspark.sql import functions as F

from drawkit.functions import tokens as E
from drawkit.operators import layout, translate

PIECES = (
    "1 2 45 304 12.5 0.02 ± + - – × x : . / # Φ ⌀ Ra HRC hb HV M8 G1 SR C A3 A4 mm MM kg µm μm °C ℃ % MPa in inch GB/T ISO jis EN Q235 Q345B 45# HT200 QT400-15 40Cr 1Cr18Ni9Ti "
    "AB-CD-12 A-B-C ABC12.3-4 XY99 \u0661\u0662 \u212a \u0130 \u017f 中文 技术 的 a Z 😀 \u0001 \u0002 \u0003 \u001c \u3000 \t \n"
).split(" ") + [" "] * 12


def plain_spans(t):
    return sorted((m.start(), m.end()) for p, fold in E.PATTERNS for m in re.finditer(p, t or "", re.I if fold else 0))


def test_spans_are_those_of_the_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(6000)] + ["", None, "AB-CD-EF-GHIJKLMNOPQRSTU", "AB12-34-56x", "45#", "±", "no token"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    wrong = [(texts[r.i], r.s) for r in df.select("i", E.raw_spans(F.col("t")).alias("s")).collect() if sorted((x.start, x.end) for x in r.s) != plain_spans(texts[r.i])]
    assert not wrong, wrong[:3]


def test_no_python_worker(spark):
    plan = translate.mask_tokens(spark.createDataFrame([("Φ20±0.1 mm",)], "source_text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_codes_take_no_stack(spark):
    t = "A" + "-B1" * 100_000
    df = spark.createDataFrame([(t,), ("AB12" + ".34" * 100_000 + "x",)], "t string")
    got = [sorted(map(tuple, r.s)) for r in df.select(E.raw_spans(F.col("t")).alias("s")).collect()]
    assert (0, len(t)) in got[0] and (0, 4 + 3 * 99_999) in got[1]


def plain_marks(t):
    """plain_markdown() of a text without tables."""
    t = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", t)
    t = re.sub(r"(?m)^\s*[-*+]\s+", "", re.sub(r"(?m)^\s{0,3}#{1,6}\s*", "", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}\n", "\n", t)).strip()


def plain_table(t):
    """html_table_text() of a text without character references."""
    t = re.sub(r"(?s)<!--.*?-->", "\3", t)
    t = re.sub(r"(?i)<t[dh]\b[^>]*>", "\2", re.sub(r"(?i)<(?:tr|br)\b[^>]*>", "\1", t))
    t = re.sub("<(?![A-Za-z/!?])", "\3<\3", re.sub(r"</?[A-Za-z!?][^>]*>", "\3", t))
    t = re.sub("\\s*([\1-\3])\\s*", r"\1", t).strip().replace("\3", "")
    t = re.sub("(^|\1)\2", r"\1", re.sub("\2+", "\2", t))
    t = re.sub(r"[ \t]*\|[ \t]*", " | ", t.replace("\2", " | ").replace("\1", "\n"))
    return re.sub(r"^[ \n|]+|[ \n|]+$", "", re.sub(r"\n{2,}", "\n", t))


def test_markup_as_the_plain_patterns_have_it(spark):
    rng = random.Random(8)
    marks = ["![", "]", "(", ")", "](", "#", "##", "- ", "-", "* ", "+", "\n", "\n", "\n\n", " ", "  ", "a", "b"]
    tags = ["<tr>", "<td>", "<TH a=1>", "</td>", "<br/>", "<", ">", "<!--", "-->", "<b", "<tr", "|", " ", "  ", "\n", "\t", "x", "y", "<?p", "</"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(16))), "".join(rng.choice(tags) for _ in range(rng.randrange(16)))) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, m string, h string").repartition(4)
    got = {r.i: (r.a, r.b) for r in df.select("i", layout.plain_markdown("m").alias("a"), layout.html_table_text(F.col("h")).alias("b")).collect()}
    wrong = [(m, h, got[i]) for i, m, h in rows if got[i] != (plain_marks(m), plain_table(h))]
    assert not wrong, wrong[:3]


def test_a_megabyte_of_anything(spark):
    hostile = ["<", "<a", "<!--", "<tr", "<table", "![", "![a] ", " ", "\n", "\t\n", "| ", "< >", "&", "- "]
    df = spark.createDataFrame([(h * (1_000_000 // len(h)) + "x",) for h in hostile], "t string").repartition(4).cache()
    df.count()
    began = time.time()
    df.select(F.length(layout.html_table_text(F.col("t"))), F.length(layout.plain_markdown("t"))).collect()
    assert time.time() - began < 60


def test_sets_are_worked_out_once(spark):
    """each set of units and standards has one place in the expression, and the issues are those of the whole sets."""
    rows = [
        ("5 mm", "0.2 in", ["5 mm"], ["工程数据未原样保留：5 mm", "译文疑似把毫米换算成了英寸"]), ("5 MM", "5 MM inch", ["5 MM"], ["译文疑似把毫米换算成了英寸"]), ("2 kg", "4 LBS", [], ["译文疑似把千克换算成了磅"]),
        ("3 MPa", "3 psi", [], ["译文疑似把兆帕换算成了 psi"]), ("GB/T 1", "iso 1", [], ["译文疑似替换了标准体系"]), ("gb 1", "GB 1", [], []), ("1", "ISO 1", [], []), ("mm", "mind", [], []), (None, None, [], []), ("5 mm", None, ["5 mm"], ["工程数据未原样保留：5 mm"]),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, s string, t string, k array<string>").repartition(2)
    out = df.select("i", E.translation_issues(F.col("s"), F.col("t"), F.col("k")).alias("issues"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 4
    assert {r.i: r.issues for r in out.collect()} == {i: r[3] for i, r in enumerate(rows)}


def test_places_only_where_something_matched(spark):
    """a pattern that can't match is passed over, and its places aren't worked out."""
    analyzed = spark.createDataFrame([("x",)], "t string").select(E.pattern_spans(F.col("t"), "±", "±"))._jdf.queryExecution().analyzed().toString()
    assert "contains(t" in analyzed.lower()
    assert len(E.NEEDS) == len(E.PATTERNS)


def test_merge_takes_masked_rows_as_they_are(spark, monkeypatch):
    """rows that are masked already aren't masked anew for the audit."""
    from drawkit.plans import jobs

    rows = translate.mask_tokens(spark.createDataFrame([(1, "螺纹 M6 深", "h")], "id long, source_text string, source_hash string"))
    results = spark.createDataFrame([(1, 0, "thread SCGPH0001", None), (1, 1, "deep", None)], "segment_id long, chunk_no int, translated string, error string")
    monkeypatch.setattr(translate, "mask_tokens", lambda *_: 1 / 0)
    got = jobs.translation_merge(results, rows).first()
    assert (got.translated_text, got.status, got.issues) == ("thread M6 deep", "translated", "")
