"""Golden cases of rules, geometry, segments, tokens and graphs."""

import random

import pytest
from drawkit import schemas
from drawkit.functions.automaton import TermAutomaton
from drawkit.functions import text as T
from drawkit.functions import tokens as E
from drawkit.operators import bom, catalog, geometry, graph, layout, match, segments, tables, translate, verdict
from drawkit.plans import jobs
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def kit(spark, code, name, files, note=""):
    rows = spark.createDataFrame([(1, 1, 1, 1, "1", code, name, note, "1", "")], "check_id long, drawing_id long, pos int, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string")
    fs = spark.createDataFrame([(1, i, f) for i, f in files], "check_id long, drawing_id long, original_filename string")
    rows = rows.withColumns({"extraction_status": F.lit("ok"), "extraction_issue": F.lit("")})
    return match.build_items(rows, fs).first()


@pytest.mark.parametrize("files,status,n", [
    (["SK.CNC.0003-外框.pdf", "SK.CNC.0003_外框.pdf", "SK.CNC.0003 外框.pdf"], "exists", 3),
    (["SK.CNC.00030-外框.pdf"], "missing", 0),
    (["SK.CNC.0003-内框.pdf"], "candidate", 0),
    (["sk.cnc.0003.PDF"], "exists", 1),
    (["SK.CNC.0003.SLDPRT", "SK.CNC.0003.sldasm", "~$SK.CNC.0003.pdf"], "missing", 0),
    (["SK.CNC.0003-外框.pdf", "SK.CNC.0003-内框.pdf"], "exists", 1),
])
def test_matching(spark, files, status, n):
    got = kit(spark, "SK.CNC.0003", "外框", list(enumerate(files, 1)))
    assert got.match_status == status and len(got.matches or []) == n
    if "SLDPRT" in files[0]:
        assert "模型文件" in got.extraction_issue and "临时文件" in got.extraction_issue
    if status == "candidate":
        assert got.extraction_status == "review" and got.candidates[0].matched_filename == files[0]


def test_matching_wide_codes_and_order(spark):
    got = kit(spark, "ＳＫ．ＣＮＣ．０００３", "　外框　", [(9, "SK.CNC.0003-外框.pdf"), (3, "SK.CNC.0003-外框.pdf")])
    assert got.match_status == "exists" and [m.drawing_id for m in got.matches] == [3, 9]


@pytest.mark.parametrize("name,file", [("Ⅱ型板", "AB.0001-II型板.pdf"), ("㎜尺", "AB.0001-mm尺.pdf"), ("ｶﾞｲﾄﾞ", "AB.0001-ガイド.pdf"), ("mm尺", "AB.0001_㎜尺.pdf"), ("①型", "ＡＢ．０００１ 1型.pdf")])
def test_matching_compatibility_forms(spark, name, file):
    ddl = "check_id long, drawing_id long, pos int, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string"
    rows = spark.createDataFrame([(1, 1, 1, 1, "1", "AB.0001", name, "", "1", "")], ddl)
    got = jobs.kit_check_all(rows, spark.createDataFrame([(1, 5, file)], "check_id long, drawing_id long, original_filename string")).first()
    assert got.match_status == "exists"


def test_items_order_of_rules(spark):
    assert kit(spark, "SK.CNC.0003", "外框", [(1, "x.pdf")], "标准件").match_status == "exempt"
    odd = kit(spark, "$$", "外框", [(1, "x.pdf")], "标准件")
    assert odd.match_status == "unchecked" and odd.exempt_reason is None and odd.extraction_status == "review"
    assert kit(spark, "SK.CNC.0003", "外框", [(1, "x.pdf")], "非标准件").extraction_status == "review"


@pytest.mark.parametrize("note,exempt,review", [("标准件", True, False), ("【备注：标准件】", True, False), ("标准件、外购件", True, False), ("标准件。", True, False), ("（（无图））", True, False), ("非标准件", False, True), ("标准件；表面处理", False, True), ("", False, False), (None, False, False), ("表面处理", False, False)])
def test_notes(spark, note, exempt, review):
    got = one(spark, T.classify_note("n"), n=note)
    assert (got.exempt, got.review) == (exempt, review)
    if note == "标准件、外购件":
        assert got.reason == "标准件+外购件"


def test_text_functions(spark):
    cases = [
        (T.strip_code_boundary("c"), "【SK.CNC.0003.pdf】", "SK.CNC.0003"), (T.normalize_code("c"), "sk-1/2._", "SK-1/2"), (T.file_stem("c"), "a.b.pdf", "a.b"), (T.file_suffix("c"), "a.b.PDF", ".pdf"), (T.file_suffix("c"), ".hidden", ""),
        (T.file_suffix("c"), "a.b c", ""), (T.block_code("c"), "图号 SK.CNC.1O01-SK", "SK.CNC.1001"), (T.code_from_text("c"), "x A1B2\n图号：SK-77", "SK-77"),
        (T.latex_strip("c"), r"| \(a\) \[b\] |", "a b"), (T.csv_safe_signed("c"), "-0.2 mm 公差", "-0.2 mm 公差"), (T.csv_safe_signed("c"), "-2+cmd|' /C calc'!A0", "'-2+cmd|' /C calc'!A0"), (T.csv_safe_strict("c"), " =1", "' =1"),
        (T.answer_clean("c"), "## 结果\n---\n- 正常", "结果\n正常"), (T.filename_title_hint("c"), "AB-外框.pdf", "外框"), (T.filename_title_hint("c"), "AB-12.pdf", ""), (T.url_quote("c"), "a b/é.pdf", "a%20b/%C3%A9.pdf"),
        (T.drawing_code("c", F.lit("SK.9-外.pdf"), F.lit("")), "", "SK.9"), (T.source_lang("c"), "外", "zh"), (T.compact("c"), " a　b ", "AB"), (T.match_text("c"), "A-外 框!", "a外框"), (T.clean_text("c"), None, ""),
        (segments.field_label(F.col("c")), "图名DRAWING NAME", "图名"), (segments.field_label(F.col("c")), "检测项目", None), (segments.standalone_label(F.col("c")), "某某机械厂", "单位"), (segments.standalone_label(F.col("c")), "06Cr19Ni10", "材料"),
    ]
    for column, value, want in cases:
        assert one(spark, column, c=value) == want, (value, want)


def test_nfkc_rows(spark):
    df = spark.createDataFrame([(1, "a㎜①"), (2, "plain"), (3, None)], "id int, s string")
    assert {r.id: r.s for r in T.nfkc_rows(df, "s").collect()} == {1: "amm1", 2: "plain", 3: None}


@pytest.mark.parametrize("text,tokens", [("硬度241～286HBW", ["241～286HBW"]), ("φ25 +0.021", ["φ25", "+0.021"]), ("按 GB/T 3480.5—2008 执行", ["GB/T 3480.5—2008"]), ("M12×1.5 深 3 mm", ["M12×1.5", "3 mm"]), ("无", [])])
def test_tokens(spark, text, tokens):
    df = spark.createDataFrame([(1, text)], "id int, source_text string")
    got = translate.mask_tokens(df).withColumn("back", E.unmask(F.col("masked"), F.col("tokens"))).first()
    assert list(got.tokens) == tokens if text != "φ25 +0.021" else "".join(got.tokens).replace(" ", "") == "φ25+0.021"
    assert got.back.text == text and not got.back.missing
    assert len(got.tokens) == 0 or "SCGPH0001" in got.masked


def test_union_spans_keeps_touching_spans_apart(spark):
    df = spark.sql("select array(named_struct('start', 5, 'end', 8), named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 4), named_struct('start', 1, 'end', 2), named_struct('start', 7, 'end', 9)) as s")
    assert [tuple(x) for x in df.select(E.union_spans(F.col("s"))).first()[0]] == [(0, 3), (3, 4), (5, 9)]


def test_issues(spark):
    issue = lambda a, b, **k: one(spark, F.array_join(E.translation_issues(F.col("a"), F.col("b"), F.array().cast("array<string>"), **k), "|"), a=a, b=b)
    assert "英寸" in issue("3 mm", "0.1 inch") and issue("3 mm", "3 mm in the hole") == "" and "英寸" in issue("3 mm", "3 mm in the hole", strict_in=True)
    assert "psi" in issue("5 MPa", "700 psi") and "磅" in issue("5 kg", "11 lb") and "标准体系" in issue("GB 1", "ISO 1")


def test_quick_ways_of_cells(spark):
    """Rows go to Python without lists, and bare codes and plain notes are judged as the others are."""
    df = spark.createDataFrame([(1, "ａ㎜①", None), (2, "plain", 'q"\\ㅤ'), (3, None, "㎜")], "id int, s string, t string")
    got = T.nfkc_rows(df, "s", "t")
    assert "StructsToJson" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.s, r.t) for r in got.collect()} == {1: ("amm1", None), 2: ("plain", 'q"\\\u1160'), 3: (None, "mm")}
    codes = ["PT.0001", "a1", "ab1", "123", "A" * 39 + "1", "A" * 40 + "1", "A-1.pdf", "A1\n", "A.1)", "（A.12）", "_A1", "Ａ1２", "", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    slow = rows.select("i", T.strip_code_boundary(F.concat(T.text("c"), F.lit(" "))).alias("b"), T.is_valid_code(F.concat(T.text("c"), F.lit(" "))).alias("v"))
    quick = rows.select("i", T.strip_code_boundary("c").alias("b"), T.is_valid_code("c").alias("v"))
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, slow.collect()))
    notes = ["", "标准件", "非标准件", "无图外购件", "标准件2", "abc"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(notes)], "i int, c string")
    both = rows.select(T.classify_note("c").alias("a"), T.classify_note(F.concat("c", F.lit(" "))).alias("b")).collect()
    assert all(r.a == r.b for r in both) and [r.a.exempt for r in both] == [False, True, False, False, False, False]


def test_blocks_are_settled_before_they_are_looked_at(spark, monkeypatch):
    """what the blocks come from is worked out once, and only texts that need it meet Python."""
    calls, settled = [], geometry.settled
    monkeypatch.setattr(geometry, "settled", lambda df: calls.append(df.columns) or settled(df))
    cells = [("序号", 0.1, 0.6), ("代号", 0.25, 0.6), ("名称", 0.4, 0.6), ("1", 0.1, 0.58), ("ＡB.㎜01", 0.25, 0.58), ("盖", 0.4, 0.58)]
    blocks = spark.createDataFrame([(1, 1, i, t, x, y, 0.04, 0.01, 0.9) for i, (t, x, y) in enumerate(cells)], "drawing_id long, page int, pos int, text string, x double, y double, w double, h double, confidence double")
    rows, heads = jobs.bom_from_blocks(blocks)
    assert calls[0] == blocks.columns
    assert [(r.sequence_no, r.code, r.name) for r in rows.collect()] == [("1", "AB.MM01", "盖")] and heads.first().tables == 1
    df = spark.createDataFrame([(1, "㎜"), (2, "plain"), (3, None), (4, "外框")], "id int, s string")
    assert sorted(map(tuple, T.nfkc_split(df, "s").collect())) == sorted(map(tuple, T.nfkc_rows(df, "s").collect()))
    labels = ["序号", " 代　号", "名 称", "数量 ", "单重x", "", "PT.1"]
    df = spark.createDataFrame([(x,) for x in labels], "text string")
    assert [r.h for r in df.select(geometry.is_header_block().alias("h")).collect()] == [True, False, False, True, False, False, False]


def test_chunks(spark):
    cut = lambda x, limit=3000: spark.createDataFrame([(x,)], "x string").select(translate.split_chunks(F.col("x"), limit).alias("c")).first().c
    assert cut("短") == ["短"] and cut("") == [""]
    parts = cut("一二三。" * 30, 20)
    assert "".join(p.replace(" ", "") for p in parts) == "一二三。" * 30 and max(map(len, parts)) <= 20
    assert cut("a" * 17 + "12345" + "b" * 10, 20)[0] == "a" * 17
    assert "SCGPH0001" in cut("a" * 15 + "SCGPH0001" + "b" * 20, 20)[1]
    assert cut("a" * 18 + "1.5" + "b" * 10, 20)[0] == "a" * 18 and cut("7" * 50, 20) == ["7" * 20, "7" * 20, "7" * 10]
    rng = random.Random(12)
    for _ in range(15):
        text = "".join(rng.choice(["一二。", "ab. ", "123", "4.5", "SCGPH0007", "x" * 9, "！", "\n"]) for _ in range(40))
        parts = cut(text, 25)
        assert max(map(len, parts)) <= 25 and sorted("".join(parts).replace(" ", "")) == sorted("".join(text.split()))
        assert sum(p.count("SCGPH0007") for p in parts) == text.count("SCGPH0007")


def test_chunks_keep_the_order_of_the_text(spark):
    """what was being packed stood behind the pieces of a long sentence that follows it."""
    cut = lambda x: spark.createDataFrame([(x,)], "x string").select(translate.split_chunks(F.col("x"), 20).alias("c")).first().c
    assert cut("ab. " + "c" * 50 + ". de.") == ["ab.", "c" * 20, "c" * 20, "c" * 10 + ". de."]
    rng = random.Random(5)
    for _ in range(5):
        text = "".join(rng.choice(["ab. ", "x" * 30, "！", "\n", "1.5 "]) for _ in range(20))
        assert "".join("".join(cut(text)).split()) == "".join(text.split())


def test_bom_rows(spark):
    lines = spark.createDataFrame([(1, 0, "1 SK.CNC.0003 外框 2", 1), (1, 1, "序号 代号 名称", 1), (1, 2, "2 | SK.CNC.0004 | 内框 | 标准件 | 3", 1), (1, 3, "没有代号", 1)], "drawing_id long, pos int, line string, page_number int")
    rows = {r.pos: r for r in bom.lines_to_rows(lines).collect()}
    assert (rows[0].name, rows[0].quantity, rows[0].sequence_no) == ("外框", "2", "1") and rows[0].issues
    assert (rows[2].name, rows[2].note, rows[2].quantity) == ("内框", "标准件", "3") and set(rows) == {0, 2}


def test_merge_and_conflicts(spark):
    ddl = "drawing_id long, pos int, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string, issues array<string>"
    rows = [(1, 0, 1, "1", "SK.1A", "外框", "", "1", "", []), (1, 1, 2, "1", "sk.1a", "外框", "", "1", "", []), (2, 0, 1, "1", "SK.003", "a", "", "1", "", []), (2, 1, 1, "1", "SK.004", "b", "", "1", "", []), (3, 0, 1, "", "代号", "名称", "", "", "", []), (3, 1, 1, "", "", "", "", "5", "", []), (3, 2, 1, "9", "OWN.1", "x", "", "", "", []), (3, 3, 1, "", "$$", "", "", "", "", [])]
    codes = spark.createDataFrame([(3, "own.1")], "drawing_id long, title_code string")
    got = bom.merge_and_validate(bom.filter_rows(spark.createDataFrame(rows, ddl), codes)).collect()
    by = {}
    for r in got:
        by.setdefault(r.drawing_id, []).append(r)
    assert len(by[1]) == 1 and by[1][0].pages == [1, 2]
    assert [r.extraction_status for r in by[2]] == ["review", "review"]
    assert [r.code for r in by[3]] == ["$$"] and by[3][0].extraction_issue == "代号格式无法确认；名称缺失"


def test_extraction_status(spark):
    def status(rows, valid, has, total, done, focused=True, read=1, issues=0, limit=10):
        args = [F.lit(x) for x in (rows, valid, has, total, done, limit, focused, read, issues)]
        return spark.range(1).select(bom.extraction_status(*args)).first()[0]

    assert status(0, 0, False, 1, 1) == "no_table" and status(0, 0, True, 1, 1) == "failed" and status(2, 2, True, 3, 1) == "partial" and status(1, 0, True, 1, 1) == "failed"
    assert status(2, 2, True, 1, 1) == "ok" and status(3, 2, True, 1, 1) == "partial" and status(0, 0, False, 1, 1, focused=False) == "failed" and status(0, 0, False, 1, 1, read=0) == "failed"


def test_segments(spark):
    ddl = "drawing_id long, title_text string, tech_text string, all_text string"
    title = "图名 | 面板8 | 图号 | BJ-SG2-1-09A-12\n材料 | 06Cr19Ni10 | 1:5 | 比例\n版次 | 状态 | 说明"
    got = segments.title_rows(spark.createDataFrame([(1, title, "", "")], ddl)).collect()
    assert {(r.label, r.source_text) for r in got} == {("图名", "面板8"), ("图号", "BJ-SG2-1-09A-12"), ("材料", "06Cr19Ni10"), ("比例", "1:5")}
    full = "图名：外框\n\n主视图\n技术要求\n1. 去毛刺\n2. 发黑"
    rows = segments.segments(spark.createDataFrame([(1, "", "", full), (2, None, None, None)], ddl)).orderBy("ordinal").collect()
    assert [r.section for r in rows] == ["title", "tech", "tech", "extra"] and rows[0].segment_key == "title:001"
    assert [r.source_text for r in rows[1:3]] == ["去毛刺", "发黑"]


def test_segment_sync(spark):
    ddl = schemas.DDL["segments"]
    row = lambda i, k, t: (i, 1, k, "tech", 1, "l", t, t, True)
    old = spark.createDataFrame([row(1, "a", "x"), row(2, "b", "y"), row(3, "c", "z")], ddl)
    new = spark.createDataFrame([row(None, "a", "x"), row(None, "b", "changed"), row(None, "d", "w")], ddl).drop("id")
    tr = spark.createDataFrame([(1,), (2,), (3,)], "segment_id long")
    now, kept = segments.sync_segments(old, new, tr)
    assert {r.segment_key: r.id for r in now.where("id < 10").collect() if r.id and r.id > 0}.items() >= {("a", 1), ("b", 2)} and [r.segment_id for r in kept.collect()] == [1]


def test_merge_results(spark):
    own = translate.mask_tokens(spark.createDataFrame([(1, "螺纹 M12 深", "h1"), (2, "外框", "h2"), (3, "外框", "h3")], "id long, source_text string, source_hash string"))
    results = spark.createDataFrame([(1, 0, "thread SCGPH0001 deep", None), (2, 0, "外框", None), (3, 0, "", "timeout")], "segment_id long, chunk_no int, translated string, error string")
    got = {r.segment_id: r for r in translate.merge_results(results, own).collect()}
    assert (got[1].status, got[1].translated_text) == ("translated", "thread M12 deep") and got[2].status == "needs_review" and got[3].status == "failed"


BLOCK = "drawing_id long, page int, pos int, text string, x double, y double, w double, h double, confidence double"


def random_blocks(seed, n=60):
    rng = random.Random(seed)
    return [(1, 1, i, rng.choice(["a", "b"]), round(rng.random(), 3), round(rng.random(), 3), round(0.05 + rng.random() / 4, 3), round(0.05 + rng.random() / 4, 3), 0.9) for i in range(n)]


def test_y_clusters(spark):
    rows = random_blocks(1)
    got = {r.pos: r.group_id for r in geometry.y_clusters(spark.createDataFrame(rows, BLOCK), 0.02).collect()}
    groups = []
    for r in sorted(rows, key=lambda r: (r[5] + r[7] / 2, r[4] + r[6] / 2, r[2])):
        y = r[5] + r[7] / 2
        if groups and abs(y - sum(g[1] for g in groups[-1]) / len(groups[-1])) <= 0.02:
            groups[-1].append((r[2], y))
        else:
            groups.append([(r[2], y)])
    assert got == {p: i for i, g in enumerate(groups) for p, _ in g}


@pytest.mark.parametrize("measure,least", [("iou", 0.3), ("smaller", 0.6)])
def test_greedy_unique(spark, measure, least):
    rows = random_blocks(2, 80)
    got = {r.pos for r in geometry.greedy_unique(spark.createDataFrame(rows, BLOCK), measure, least, ["y", "x", "pos"]).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (r[5], r[4], r[2])):
        def share(k, r=r):
            s = max(0, min(k[4] + k[6], r[4] + r[6]) - max(k[4], r[4])) * max(0, min(k[5] + k[7], r[5] + r[7]) - max(k[5], r[5]))
            a, b = k[6] * k[7], r[6] * r[7]
            return s / (a + b - s if measure == "iou" else min(a, b))

        if not any(k[3] == r[3] and share(k) >= least for k in kept):
            kept.append(r)
    assert got == {k[2] for k in kept}


def test_title_region_and_ingest(spark):
    rows = [(1, 1, 0, "SK.CNC.0001", 0.89, 0.91, 0.02, 0.02, 0.9), (1, 1, 1, "工作台框", 0.89, 0.87, 0.02, 0.02, 0.95), (1, 1, 2, "技术要求 1. 发黑", 0.1, 0.1, 0.2, 0.1, 0.9), (1, 1, 3, "技术要求 1. 发黑", 0.1, 0.1, 0.2, 0.1, 0.9)]
    df = spark.createDataFrame(rows, BLOCK)
    got = geometry.title_regions(df).first()
    assert (got.code, got.name) == ("SK.CNC.0001", "工作台框")
    doc = jobs.scan_ingest(df).first()
    assert doc.title_text == "SK.CNC.0001\n工作台框" and doc.tech_text == "技术要求 1. 发黑" and doc.all_text.count("技术要求") == 1


def test_tables_as_text(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        parts: list

        def handle_starttag(self, tag, attrs):
            if tag in ("tr", "br"):
                self.parts.append("\n")
            elif tag in ("td", "th") and self.parts and self.parts[-1] not in ("\n", " | "):
                self.parts.append(" | ")

        def handle_data(self, data):
            self.parts += [data.strip()] if data.strip() else []

    import re

    rng = random.Random(3)
    texts = ["<table>" + "".join(rng.choice(["<tr>", "</tr>", "<td>", "</td>", "<th class='a'>", "<br/>", "<b>", "</b>", " x ", "a|b", "&deg;C", "&#177;0.1", "&times;", "&lt;td&gt;", "\n", "1 < 2", " "]) for _ in range(rng.randint(1, 12))) + "</table>" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", layout.html_table_text(F.col("t")).alias("a"), layout.plain_markdown(F.concat(F.lit("# h\n"), "t", F.lit(" &deg;\n- i"))).alias("b")).collect():
        p = Plain()
        p.parts = []
        p.feed(r.t)
        p.close()
        want = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]*\|[ \t]*", " | ", "".join(p.parts))).strip(" \n|")
        assert r.a == want
        assert r.b == re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}\n", "\n", f"h\n\n{want}\n &deg;\ni"))


def test_unescape(spark):
    import html

    rng = random.Random(2)
    texts = ["".join(rng.choice(["&deg;", "&#177;", "&amp;lt;", "&lt", "&copy2", "&#x41;", "&#128;", "&bogus;", "& ", "&", "a", "&#0;", "&notit;", "&nbsp;", "&#55296;", "&#x1F600;"]) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.u == html.unescape(r.t) for r in df.select("t", T.unescape(F.col("t")).alias("u")).collect())


def test_requirement_regions(spark):
    ddl = "drawing_id long, page_idx int, pos int, type string, content string, x0 double, y0 double, x1 double, y1 double"
    row = lambda d, k, kind, text, x=None, y=None: (d, 0, k, kind, text, x, y, None if x is None else x + 0.3, None if y is None else y + 0.05)
    rows = [
        row(1, 0, "text", "技术要求：", 0.1, 0.2), row(1, 1, "text", "1. a", 0.12, 0.26), row(1, 2, "image", "no", 0.1, 0.3), row(1, 3, "text", "b", 0.1, 0.32), row(1, 4, "text", "other column", 0.6, 0.4), row(1, 5, "text", "c", 0.1, 0.5),
        row(2, 0, "text", "技术条件 x", 0.1, 0.2), row(2, 1, "text", "above", 0.1, 0.1), row(2, 2, "text", "below", 0.1, 0.3),
        row(3, 0, "text", "技术要求", 0.5, 0.5), row(3, 1, "text", "left", 0.1, 0.6), row(3, 2, "text", "1. a", 0.5, 0.6), row(3, 3, "text", "low", 0.5, 0.96), row(3, 4, "text", "b", 0.5, 0.7),
        row(4, 0, "text", "工艺要求"), row(4, 1, "text", "a"), row(4, 2, "text", "2、b"), row(4, 3, "text", "c"),
    ]
    got = {r.drawing_id: r.text for r in layout.tech_regions(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: "1. a\nb", 2: "x", 3: "1. a", 4: "a\n2、b"}


def test_title_lines(spark):
    cases = [
        ("图名DRAWING NAME | 面板 | 图号 | AB01", [("图名", "面板"), ("图号", "AB01")]), ("1:5 | 比例", [("比例", "1:5")]), ("版次 | 状态 | 说明", []), ("齿数 | 20", []), ("材料：45", [("材料", "45")]), ("图名 外框 | x", [("图名", "外框")]),
        ("制图 | AB12.3", [("图号", "AB12.3")]), ("标记 | 比例", []), ("12 | 单位 | 某某机械厂", [("单位", "某某机械厂")]), ("a | b | 材料", [("材料", "b")]), ("a | b | 材料 | 图名", [("材料", "b"), ("图名", "a")]), ("第 2 页 共 3 页 | x", [("页码", "第 2 页 共 3 页")]),
        ("初版 | x", [("版次记录", "初版 | x")]), ("REV A | x", [("版次", "A")]), ("某某大学", []), ("Q235", [("材料", "Q235")]), ("外框体", [("图名", "外框体")]), ("scale 1:2", [("比例", "2")]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: [(p.label, p.text) for p in r.p if p.label] for r in df.select("i", segments.title_pairs(F.col("t")).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_title_rows_are_spread(spark):
    """Drawings read by one task are worked on by all; a leading grade stands in for the material that a drawing doesn't name."""
    cases = [(1, "Q235-A | x", [(-1, "材料", "Q235-A")]), (2, "Q235-A | x\n材料：45", [(1, "材料", "45")]), (None, "HT200 | x", [(-1, "材料", "HT200")]), (None, "材料：45", [(0, "材料", "45")]), (3, None, []), (4, "版权\r\n图名 | 面板\r1:5 | 比例", [(1, "图名", "面板"), (2, "比例", "1:5")])]
    drawings = spark.createDataFrame([(d, t) for d, t, _ in cases], "drawing_id long, title_text string").coalesce(1)
    rows = segments.title_rows(drawings)
    assert sorted(((r.drawing_id, r.pos, r.label, r.source_text) for r in rows.collect()), key=repr) == sorted(((d, *row) for d, _, found in cases for row in found), key=repr)
    many = spark.range(400).coalesce(1).select(F.col("id").alias("drawing_id"), F.lit("图名 | 面板").alias("title_text"))
    assert segments.title_rows(many).select(F.spark_partition_id().alias("task")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate ") == 2 and "Join" not in plan  # each text is worked out once, where it was spread to


def test_title_tables(spark):
    ddl = "drawing_id long, page_idx int, pos int, type string, content string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, 0, "table", "图号 A 材料 45", 0.5, 0.7, 0.9, 0.9), (1, 0, 1, "table", "图号 A 材料 45 比例 1:2 图名 框", 0.5, 0.7, 0.9, 0.95), (1, 0, 2, "table", "图号 B 材料 50", 0.0, 0.0, 0.3, 0.3), (1, 0, 3, "table", "齿数 12", 0.0, 0.5, 0.2, 0.6), (1, 0, 4, "table", "图号 C 比例 1", None, None, None, None)]
    assert sorted(r.pos for r in layout.title_tables(spark.createDataFrame(rows, ddl)).collect()) == [1, 2, 4]


@pytest.mark.parametrize("most", [graph.MOST_EDGES, 0])
def test_graph(spark, monkeypatch, most):
    """Reach and cycles by one task for each check, and by loops of joins, give the same."""
    monkeypatch.setattr(graph, "MOST_EDGES", most)
    rng = random.Random(7)
    pairs = sorted({(rng.randint(0, 29), rng.randint(0, 29)) for _ in range(55)})
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs] + [(2, 5, 6), (2, 6, 5), (2, 6, 7)], "check_id long, parent long, child long")
    kids = {}
    for a, b in pairs:
        kids.setdefault(a, []).append(b)

    def depths(roots):
        seen, todo = dict.fromkeys(roots, 0), list(roots)
        for a in todo:
            for b in kids.get(a, ()):
                if b not in seen:
                    seen[b] = seen[a] + 1
                    todo.append(b)
        return seen

    got = {(r.check_id, r.parent, r.child): r.in_cycle for r in graph.in_cycle(edges).collect()}
    assert got == {(1, a, b): a in depths([b]) for a, b in pairs} | {(2, 5, 6): True, (2, 6, 5): True, (2, 6, 7): False}
    roots = spark.createDataFrame([(1, 0), (1, 0), (2, 6), (3, 99)], "check_id long, drawing_id long")
    found = {(r.check_id, r.drawing_id, r.depth, r.discovery) for r in graph.expand(roots, edges).collect()}
    assert found == {(1, n, d, "reference" if d else "root") for n, d in depths([0]).items()} | {(2, 6, 0, "root"), (2, 5, 1, "reference"), (2, 7, 1, "reference"), (3, 99, 0, "root")}
    near = {r.drawing_id for r in graph.expand(roots, edges, most_depth=2).where("check_id = 1").collect()}
    assert near == {n for n, d in depths([0]).items() if d <= 2}


def walked(pairs, roots, most_depth):
    """What a plain recursive walk enters and marks. pairs: (parent, child) in order."""
    kids, depth, marks = {}, {}, set()
    for a, b in pairs:
        kids.setdefault(a, []).append(b)

    def enter(node, path):
        depth[node] = len(path) - 1
        if len(path) > most_depth:
            return
        for b in kids.get(node, ()):
            if b in path:
                marks.add((node, b, "self" if b == node else "path"))
            elif b not in depth:
                enter(b, [*path, b])

    for root in sorted(roots):
        if root not in depth:
            enter(root, [root])
    return depth, marks


@pytest.mark.parametrize("most_depth", [50, 3])
def test_walk_goes_by_order(spark, most_depth):
    rng = random.Random(most_depth)
    want_visits, want_marks, rows, starts = set(), set(), [], []
    for check in range(12):
        pairs = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(rng.choice([3, 20, 40]))]
        roots = [rng.randint(0, 14) for _ in range(2)]
        depth, marks = walked(pairs, roots, most_depth)
        want_visits |= {(check, n, d) for n, d in depth.items() if n in {x for p in pairs for x in p} | {*roots}}
        want_marks |= {(check, *m) for m in marks}
        rows += [(check, a, b, i) for i, (a, b) in enumerate(pairs)]
        starts += [(check, r) for r in roots]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "check_id long, parent long, child long, ord long")
    visits, marks = graph.walk(edges, spark.createDataFrame(starts, "check_id long, drawing_id long"), most_depth)
    assert {tuple(r) for r in visits.collect()} == want_visits and {tuple(r) for r in marks.collect()} == want_marks


def test_walk_of_199_and_201_drawings_and_of_a_long_chain(spark):
    """A chain with one reference back, whatever its length: no mark but that one, and the depth limit."""
    rows = [(n, i, i + 1, i) for n in (30, 199, 201) for i in range(n)] + [(n, n, 0, 0) for n in (30, 199, 201)] + [(9, i, i + 1, i) for i in range(10_000)]
    edges = spark.createDataFrame(rows, "check_id long, parent long, child long, ord long")
    roots = spark.createDataFrame([(n, 0) for n in (30, 199, 201, 9)], "check_id long, drawing_id long")
    visits, marks = graph.walk(edges, roots, 10_000)
    assert {tuple(r) for r in marks.collect()} == {(n, n, 0, "path") for n in (30, 199, 201)}
    assert visits.where("check_id = 9").count() == 10_001
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert graph.in_cycle(edges).where("in_cycle").groupBy("check_id").count().count() == 3
    assert graph.expand(roots, edges, 1000).agg({"depth": "max"}).first()[0] == 1000
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) < 40


def test_manual_check(spark):
    ddl = "check_id long, drawing_id long, pos int, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string"
    rows = spark.createDataFrame([(1, 10, 1, 1, "1", "AA.002", "b", "", "1", ""), (1, 20, 1, 1, "1", "AA.001", "a", "", "1", ""), (1, 30, 1, 1, "1", "ZZ.999", "z", "", "1", "")], ddl)
    files = spark.createDataFrame([(1, 10, "AA.001.pdf"), (1, 20, "AA.002-b.pdf"), (1, 30, "AA.003.pdf")], "check_id long, drawing_id long, original_filename string")
    items, reached = jobs.kit_check_manual(rows, files, spark.createDataFrame([(1, 10)], "check_id long, drawing_id long"))
    assert {r.drawing_id for r in items.collect()} == {10, 20} and {(r.drawing_id, r.depth) for r in reached.collect()} == {(10, 0), (20, 1)}


def test_manual_check_marks(spark):
    """Cycles, references to a drawing itself, tables that weren't read and the depth limit."""
    ddl = "check_id long, drawing_id long, pos int, page_number int, sequence_no string, code string, name string, note string, quantity string, raw_text string"
    code = lambda d: f"AA.{d:03d}"
    refs = [(1, 2), (1, 1), (2, 3), (3, 1), (2, 9), (3, 4), (4, 5)]
    rows = spark.createDataFrame([(1, a, k, 1, str(k), code(b), "b", "", "1", "") for k, (a, b) in enumerate(refs)] + [(1, 5, 50, 1, "1", "ZZ.9", "z", "", "1", ""), (1, 9, 90, 1, "1", "ZZ.9", "z", "", "1", "")], ddl)
    files = spark.createDataFrame([(1, d, code(d) + ".pdf") for d in (1, 2, 3, 4, 5, 9)], "check_id long, drawing_id long, original_filename string")
    extractions = spark.createDataFrame([(d, "failed" if d == 9 else "ok", 0 if d == 9 else 2) for d in (1, 2, 3, 4, 5, 9)], "drawing_id long, status string, rows_count long")
    roots = spark.createDataFrame([(1, 1)], "check_id long, drawing_id long")
    items, reached = jobs.kit_check_manual(rows, files, roots, extractions)
    got = {(r.drawing_id, r.code): (r.extraction_status, r.extraction_issue) for r in items.collect()}
    assert {(r.drawing_id, r.depth) for r in reached.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert got[1, code(1)] == ("review", graph.MARKS["self"]) and got[3, code(1)] == ("review", graph.MARKS["path"]) and got[2, code(9)] == ("review", graph.MARKS["failed"])
    assert got[4, code(5)] == ("ok", "") and got[1, code(2)] == ("ok", "")
    items, reached = jobs.kit_check_manual(rows, files, roots, most_depth=2)
    got = {(r.drawing_id, r.code): r.extraction_issue for r in items.collect()}
    assert got[3, code(4)] == graph.MARKS["depth"] and {r.drawing_id for r in reached.collect()} == {1, 2, 3, 9}


def test_text_status(spark):
    drawings = spark.createDataFrame([(1, "序号 代号 名称\n1 AB.001 框 2"), (2, "nothing"), (3, "代号\nno code here")], "id long, all_text string").withColumns({"title_text": F.lit(""), "original_filename": F.lit("x.pdf"), "filename": F.lit("x.pdf")})
    pages = spark.createDataFrame([(i, 1, 1, True, 1, 0) for i in (1, 2, 3)], "drawing_id long, pages_total int, pages_processed int, focused boolean, pages_read int, issues int")
    got = {r.drawing_id: (r.rows, r.valid, r.status) for r in jobs.bom_from_text_status(drawings, jobs.bom_from_text(drawings), pages).collect()}
    assert got == {1: (1, 1, "ok"), 2: (0, 0, "no_table"), 3: (0, 0, "failed")}


def test_requests(spark):
    drawings = spark.createDataFrame([(1, ".pdf"), (2, ".sldprt")], "id long, file_type string")
    asked = [(1, "all", [1, 1], []), (2, "none", [1], []), (3, "all", [], []), (4, "manual", [1], []), (5, "manual", [1], [9]), (6, "all", [1, 7], []), (7, "all", [2], []), (8, "all", list(range(300)), []), (9, "all", None, None)]
    got = {r.check_id: r.error for r in verdict.validate_requests(spark.createDataFrame(asked, "check_id long, mode string, drawing_ids array<long>, root_drawing_ids array<long>"), drawings).collect()}
    assert got == {1: None, 2: "mode", 3: "empty", 4: "no root", 5: "root outside", 6: "deleted: 7", 7: "unsupported: 2", 8: "too many", 9: "empty"}


def test_term_automaton_finds_what_is_in_the_text():
    rng = random.Random(5)
    for _ in range(300):
        terms = {"".join(rng.choices("abc框", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 30))}
        automaton = TermAutomaton(terms)
        text = "".join(rng.choices("abc框面", k=rng.randint(0, 60)))
        assert {automaton.terms[i] for i in automaton.found(text)} == {t for t in terms if t in text}


@pytest.mark.parametrize("most", [translate.SENT_TERMS, 0])
def test_glossary_terms(spark, monkeypatch, most):
    monkeypatch.setattr(translate, "SENT_TERMS", most)
    texts = {1: "abc cab a", 2: "", 3: "xyz", 4: "c" * 50 + "abcd", 5: "外框 面板", 6: None}
    names = ["a", "ab", "cab", "zz", "c a", "bcd", "外", "框 面", "x" * 4, "", "cccc", *("c" * n for n in range(5, 45))]
    rows = spark.createDataFrame(list(texts.items()), "id long, source_text string")
    terms = spark.createDataFrame([(s, s.upper(), True) for s in names] + [("abc", "-", False)], "source string, target string, enabled boolean")
    got = {r.id: [t.source for t in r.terms] for r in translate.glossary_terms(rows, terms).collect()}
    want = {i: sorted({s for s in names if s and s in (t or "")}, key=lambda s: (-len(s), s))[:30] for i, t in texts.items()}
    assert got == {i: t for i, t in want.items() if t} and len(got[4]) == 30


def test_tables_refuse_unknown_columns(spark):
    rows = spark.createDataFrame([(1, 2)], "id int, v int")
    with pytest.raises(ValueError, match="not to be changed"):
        tables.keyed_update(rows, rows.withColumnRenamed("v", "w"), ["id"], ["v"])
    with pytest.raises(ValueError, match="no such"):
        translate.validate_request("xx", None)
    assert catalog.run_tool(rows, "nothing").first().success is False
    assert all(schemas.schema(n) for n in schemas.DDL)


def given(spark, path, texts):
    """A folder with a table documents of these texts."""
    spark.createDataFrame([(i, x, "zh", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_texts_beyond_ascii(spark, tmp_path):
    from drawkit.queries import QUERIES

    texts = ["plain A_1!", "外框 é-Ü", "未注倒角。" * 1500, "Größe à côté！" * 600 + "完？", "a b. " * 1500, "𠮷 ① x" * 900]
    folder = given(spark, tmp_path / "t", texts)
    got = {r.doc_id: r.letters for r in QUERIES["f18_match_text_all"](spark, folder).collect()}
    assert {i: got[i] for i in (0, 1, 2, 3, 4)} == {i: "".join(c for c in x if c.isalnum() or c == "_").lower() for i, x in enumerate(texts) if i < 5}
    assert len(got) == len(texts)
    parts = {}
    for r in QUERIES["f29_text_chunks_all"](spark, folder).orderBy("doc_id", "chunk_no").collect():
        parts.setdefault(r.doc_id, []).append(r.chunk)
    assert sorted(parts) == list(range(len(texts)))
    for i, x in enumerate(texts):
        assert "".join("".join(parts[i]).split()) == "".join(x.split())
        assert all(len(c) <= translate.MOST_CHARS for c in parts[i]) and (len(parts[i]) == 1) == (len(x) <= translate.MOST_CHARS)
    assert all(c.endswith("。") for c in parts[2])


def test_rows_to_be_changed_are_kept(spark, tmp_path):
    import hashlib
    import json
    import re

    from drawkit import fixtures as X
    from drawkit.queries import QUERIES

    folder = given(spark, tmp_path / "t", ["\n".join(f"line {i}" for i in range(1, 1203)), "a | b\nx \\\\(y\\\\) z\n\\\\[q\\\\] | r\nc:\\\\d"])
    own = {r.id: r for r in X.segments(spark, folder).collect()}
    strip = lambda x: re.sub(r"^[ \t|]+|[ \t|]+$", "", re.sub(r"\\\[(.*?)\\\]", r"\1", re.sub(r"\\\((.*?)\\\)", r"\1", x)))
    got = {r.id: r.text for r in QUERIES["f54_latex_strip_all"](spark, folder).collect()}
    assert got == {i: strip("| \\(" + r.source_text + "\\) |\t") for i, r in own.items()}
    assert any("|" in r.source_text for r in own.values()) and any("\\" in r.source_text for r in own.values())
    keys = {(r.drawing_id, r.ordinal): r.segment_key for r in QUERIES["w2_segment_ordinal_all"](spark, folder).collect()}
    assert len(keys) == len(own) and "extra:1202" in keys.values()
    assert all(k == f"extra:{o:03d}" for (_, o), k in keys.items())
    answers = [(1, 0, "user", "# no"), (1, 1, "assistant", "## Head\n\n\n\n- **bold** `x`\n---\nend"), (2, 1, "assistant", "```sql\na|b_c\n```"), (3, 1, "assistant", "plain")]
    spark.createDataFrame(answers, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: r.answer for r in QUERIES["f45_answer_clean_all"](spark, folder).collect()}
    assert {k: v.strip() for k, v in got.items()} == {1: "Head\n\nbold x\nend", 2: "abc", 3: "plain"}
    terms = [('a"b', "c\\d"), ("x", 'y"'), ("é", "z")]
    rows = spark.createDataFrame([(s, t, True) for s, t in terms], "source string, target string, enabled boolean")
    want = hashlib.sha256(json.dumps(sorted(map(list, terms)), ensure_ascii=False).encode()).hexdigest()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(X, "glossary", lambda *_: rows)
        assert QUERIES["a14_glossary_hash_all"](spark, folder).first().glossary_hash == want


def test_translation_merge_of_all_segments(spark, tmp_path):
    from drawkit.queries import QUERIES

    # Drawing 0: ids are ordinals. Two texts of several chunks, one of them with tokens in each.
    lines = ["line one", "bolt M12x1.5 deep", "plain words", "words; " * 900, "hole 25 mm; " * 500, "螺纹 M6 深", "six", "seam M8", "eight", "nine", "ten", "same words", "twelve", "thirteen M10"]
    folder = given(spark, tmp_path / "t", ["\n".join(lines)])
    got = {r.ordinal: r for r in QUERIES["k9_translation_merge_all"](spark, folder).collect()}
    assert len(got) == len(lines)
    assert {i for i, r in got.items() if r.status == "failed"} == {0, 13}
    assert {i: got[i].status for i in range(1, 6)} == dict.fromkeys(range(1, 6), "translated")
    assert got[1].translated_text == "new text bolt M12x1.5 deep" and got[5].translated_text.split() == "new text M6".split()
    for i in (3, 4):
        n = got[i].translated_text.count("new text ")
        assert n > 1 and got[i].translated_text.replace("new text ", "").split() == lines[i].split()
    assert got[7].status == "needs_review" and "占位符丢失：M8" in got[7].issues and got[7].translated_text == "lost text"
    assert got[11].status == "needs_review" and "译文与原文相同" in got[11].issues
