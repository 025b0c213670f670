"""Operators on pages: WARC, HTML extraction, line dedup."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from drawkit.llm import html_extract, line_dedup, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DDL = "page_id long, url string, html string"
BIG = "<p>" + "same words, again. " * 100 + "</p>"
EDGE = [(1, "http://A.example.com/x", BIG), (2, "http://a.example.com/y", BIG), (3, None, BIG), (None, "x", BIG), (3, None, BIG), (5, "u\r\nv", None), (6, "", ""), (-7, "http://b/é", "<p>ü 😀</p>"), (8, "http://c", "y" * 999), (9, "http://c", "y" * 999), (10, "http://d", "z" * 300_000)]


def edge(spark):
    return spark.createDataFrame(EDGE, DDL).repartition(2).withColumn("text", F.lit("clash")).withColumn("host", F.lit(0)).withColumn("key", F.lit(1)).withColumn("lines", F.lit("l"))


def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def empty(spark):
    return spark.createDataFrame([], DDL)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- WARC


def slow_archive(rows):
    latest = defaultdict(list)
    for i, _, h in rows:
        latest[h or ""].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [x for x in latest[h or ""] if x is not None]
        to = max(ids) if len(p) >= 1000 and ids and i is not None and i != max(ids) else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [edge, pages])
def test_warc_round_trip(spark, make):
    df = make(spark)
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    back = warc.archive_pages(df).cache()
    assert tuples(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == slow_archive(rows)
    whole = Counter((i, (h or "").encode()) for i, _, h in rows)
    for r in back.where("record_type = 'response'").collect():
        assert whole[r.page_id, bytes(r.payload)] >= 1
    assert {r.url for r in back.collect()} == {u if u is None else u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in rows}


def test_warc_revisit_of_a_copy(spark):
    df = pages(spark).where("length(html) > 2000").limit(5)
    both = df.unionByName(df.withColumn("page_id", F.col("page_id") + 100_000))
    got = warc.archive_pages(both)
    assert got.where("record_type = 'revisit'").count() == df.count()
    assert got.where("record_type = 'revisit' and refers_to <> page_id + 100000").count() == 0


def test_warc_files(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    df = pages(spark)
    warc.write_archives(warc.with_revisits(df.repartition(2)), path, dictionary_bytes=4096, archive_bytes=10_000)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 6
    total = 0
    for f in files:
        data = f.read_bytes()
        assert data[:4] == bytes.fromhex("5d2a4d18") and data[8:12] == bytes.fromhex("37a430ec") and len(data) < 30_000
        records = [warc.parse_record(x) for x in warc.read_archive(data)]
        assert all(r["Content-Type"] == "application/http; msgtype=response" for r, _, _ in records)
        total += len(records)
        with pytest.raises(ValueError, match="ends inside|no frame"):
            list(warc.read_archive(data[:-11]))
    assert total == df.count()
    assert warc.archive_pages(empty(spark)).count() == 0


@pytest.mark.parametrize("payloads", [[b""], [b"z" * 300_000], [b""] * 1000, [b"x"] * 3, [bytes(range(256)) * 20_000, b"y"]])
def test_warc_dictionaries_are_real(payloads):
    records = [warc.warc_record(i, None, p, hashlib.sha1(p).digest(), None) for i, p in enumerate(payloads)]
    made = list(warc.archives(iter(records)))
    assert all(a[8:12] == bytes.fromhex("37a430ec") for a in made)
    assert [x for a in made for x in warc.read_archive(a)] == records


def test_warc_many_groups(spark):
    """Beyond what is broadcast the same records are revisits."""
    df = edge(spark).unionByName(pages(spark).limit(20).withColumns({"text": F.lit(""), "host": F.lit(0), "key": F.lit(1), "lines": F.lit("")}))
    cols = ["page_id", "url", "payload", "refers_to"]
    assert tuples(warc.with_revisits(df, most_broadcast=0), *cols) == tuples(warc.with_revisits(df), *cols)


def test_warc_ids():
    for i in (0, 1, 2**63 - 1, -1, -(2**63), 123456789):
        assert warc.page_of(warc.record_id(i)) == (i or None) or i == 0
    assert warc.page_of(warc.record_id(None)) is None and warc.page_of(warc.record_id(0)) == 0


# --- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two <b>bold</b> &amp; more<br>line</p>", "one\ntwo bold & more line"),
        ("<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>Some, long text.</p><ul><li>a<li>b</ul></article><footer>f</footer></body></html>", "T\nSome, long text.\na\nb"),
        ("<div id=sidebar><p>side, side, side</p></div><div class='content'><h2>H</h2><p>It is, well, text.</p><p>More of it, here.</p></div><div class='comments'><p>first, comment, by, me</p></div>", "H\nIt is, well, text.\nMore of it, here."),
        ("<article><p>a<script>var t='</p><p>x';</script>b</p><form><p>mail, us</p></form><div class='cookie-notice'>ok, ok</div><p>c&nbsp;&lt;d&#x41;</p></article>", "ab\nc <dA"),
        ("<main><p>kept, text</p><aside><p>not, this</p></aside><style>p{}</style><!-- c <p>no</p> --></main>", "kept, text"),
        ("<p>unclosed <b>bold<p>next</b></p></i></div>end", "unclosed bold\nnext\nend"),
        ("<article><h1>T</h1><div class='article-header-menu'></div><p>x</p></article><div class=ad>Buy, now, here</div>", "T\nx"),
        ("<article><h1>T</h1><p>Body, of it.</p><section class=comments><article><p>a, comment, that, is, long</p></article></section></article><article class='comment'><p>b, c, d</p></article>", "T\nBody, of it."),
        ("<form action=x><div class=menu><a href=/>m</a></div><div><p>All of, the page, is a form.</p></div></form>", "All of, the page, is a form."),
        ("<div class='widget'><article><p>Only, here.</p></article></div>", "Only, here."),
        ("<div><div><div><p>" + "deep, text. " * 30 + "</p></div></div></div>", ("deep, text. " * 30).strip()),
    ],
)
def test_extract(page, text):
    assert html_extract.extract(page) == text


def test_extract_deep_and_broken():
    assert html_extract.extract("<div>" * 20_000 + "text, here" + "</div>" * 20_000) == "text, here"
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<div class=x>", "</div>", "<b>", "</b>", "<table><tr><td>", "</table>", "<li>", "<ul>", "a, b", "<", ">", "&lt;", "<!--", "-->", "<script>", "</script>", "<a href='", "'>"]) for _ in range(30))
        html_extract.extract(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content has-sidebar'><p>It is, well, text.</p><p>More.</p></div>", "It is, well, text.\nMore."),
        ("<div id='page-with-menu'><p>It is, well, text.</p><p>More.</p></div>", "It is, well, text.\nMore."),
        ("<div class='sidebar-right'><div><p>It is, well, text.</p><p>More.</p></div><div class='sidebar'><p>Side, side.</p></div></div>", "It is, well, text.\nMore."),
        ("<article><h1>T</h1><p>Some, text.</p><h2>References</h2><ul><li><a href=1>First one</a></li><li><a href=2>Second one</a></li><li><a href=3>Third one</a></li></ul></article>", "T\nSome, text.\nReferences\nFirst one\nSecond one\nThird one"),
        ("<body><ul><li><a href=1>Home page</a><li><a href=2>About us</a><li><a href=3>Contact us</a></ul><p>Text, and text.</p></body>", "Text, and text."),
        ("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, it holds.</p></article>", "Where x=1, it holds."),
        ("<div class=c><p>Main, text here.</p></div><div class=comments><article><p>First, long, long, long, comment.</p></article><article><p>Me, too.</p></article></div>", "Main, text here."),
        ("<div>" * 300 + "<p>one, two</p><p>three</p><div class=siteMenu><a href=1>m</a></div><div class=comments>first!</div>" + "</div>" * 300, "one, two\nthree"),
        ("<article><b><p>one</b> two</p><p>a < b</p><p title='x > y'>three</article>", "one two\na < b\nthree"),
        ("<p>one &#65;&#" + "9" * 5000 + "; two", "one A\ufffd two"),
    ],
)
def test_extract_whole_articles(page, text):
    assert html_extract.extract(page) == text


PROSE = "".join(f"<p>Paragraph {n}, of the story, with some more words in it, as stories have.</p>" for n in range(4))
PROSE_TEXT = "\n".join(f"Paragraph {n}, of the story, with some more words in it, as stories have." for n in range(4))


@pytest.mark.parametrize(
    "part",
    [
        "<div class='comment-thread'><div class='comment-body'><p>First, I say, and say, and say it.</p></div></div>",
        "<div class='user-comments'>" + "<p>Long, long, long comment, of somebody, on it.</p>" * 40 + "</div>",
        "<section id='readerComments'><h3>What readers say</h3><p>I, for one, agree.</p></section>",
        "<div class='newsletter-signup-inline'>Get the letter, every week. <input name=m></div>",
        "<div class='google-ad'>Buy it now, and save.</div>",
        "<div class='dfp__ad ad-728x90'>Buy it now, and save.</div>",
        "<div class='socialShareTools'><span>Tell</span> <span>your friends</span></div>",
        "<div class='tale-menu'><a href=1>One</a> <a href=2>Two</a></div>",
        "<div class='comment-list-x'><article class='c1'><p>A, b.</p></article><article class='c2'><p>C, d.</p></article></div>",
    ],
)
@pytest.mark.parametrize("inside", [True, False])
def test_extract_leaves_out_comments_and_adverts_by_longer_names(part, inside):
    page = f"<article><h1>T</h1>{PROSE}{part if inside else ''}</article>{'' if inside else part}"
    assert html_extract.extract(page) == "T\n" + PROSE_TEXT


@pytest.mark.parametrize(
    "tag",
    [
        "div class='with-comments'",
        "div class='comments-open post'",
        "div class='tag-newsletter story'",
        "div class='layout-sidebar story-x'",
        "div class='menu-planning-tips'",
        "div class='sidebar-story-body'",
        "section id='reply-to-critics'",
        "section class='share-prices'",
    ],
)
def test_extract_keeps_articles_under_longer_names(tag):
    name = tag.split()[0]
    assert html_extract.extract(f"<article><h1>T</h1><{tag}>{PROSE}</{name}></article>") == "T\n" + PROSE_TEXT
    assert html_extract.extract(f"<body><{tag}><h1>T</h1>{PROSE}</{name}></body>") == "T\n" + PROSE_TEXT


def test_extract_takes_an_id_made_of_a_heading_for_a_section():
    page = f"<article>{PROSE}<section id='comments-received-then'><h2>Comments received then</h2><p>Some were kind, some not.</p></section></article>"
    assert html_extract.extract(page) == PROSE_TEXT + "\nComments received then\nSome were kind, some not."


def test_extract_takes_time_in_proportion():
    import time

    n = 400_000
    for part, tail in [("<a ", ""), ("<b>", "</i>" * (n // 8)), ("<div>", "x"), ("<", ""), ('<a x="', ""), ("<!--", ""), ("<b><div>", "</b>" * 1000 + "x"), ("<ul><li>", "t"), ("<table><tr><td>", "t"), ("<p><button>", "<div>" * (n // 8)), ("<div></p></b></div>", "x"), ("<a>", "x"), ("<div><a href=x>link</a>", ""), ("<h2><div id=comments-x>", "x"), ("<div class=x-ad>", "x")]:
        began = time.process_time()
        html_extract.extract(part * (n // len(part)) + tail)
        assert time.process_time() - began < 12, part


def test_tree_scores_against_plain_definition():
    """Scores of random pages, each block and each element above it looked at anew."""
    rng = random.Random(11)
    H = html_extract
    for _ in range(150):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<section>", "</section>", "<article>", "</article>", "<td>", "<ul><li>", "</ul>", "<h2>", "</h2>", "<a href=x>", "</a>", "<b>", "</b>", "some, words, here ", "text " * 40, "<nav>menu</nav>"]) for _ in range(40))
        items, nodes = H.parse(page)
        H.prune(items, nodes)
        H.score(nodes)
        want = {id(n): 0.0 for n in nodes}
        own = {id(n): [0, 0, 0] for n in nodes}
        stack = []
        for x in items:
            if isinstance(x, str):
                if any(n.cut for n in stack):
                    continue
                b = next(n for n in reversed(stack) if n.tag in H.BLOCK)
                k = len(x.strip())
                own[id(b)][0] += k
                own[id(b)][1] += k * any(n.tag == "a" for n in stack)
                own[id(b)][2] += x.count(",")
            elif stack and stack[-1] is x:
                stack.pop()
            else:
                stack.append(x)
        for n in nodes:
            k, links, commas = own[id(n)]
            if not k or n.tag in H.HEADINGS:
                continue
            worth = (1 + commas + min(3, k / 100)) * (1 - links / k)
            above = []
            up = n
            while up is not None:
                above.append(up)
                up = up.parent
            article = next((x for x in above if x.tag in ("article", "main")), None)
            chain = [x for x in above if x.tag in H.BLOCK][n.tag in ("p", "li") :]
            for share, x in zip((1, 0.5, 0.25, 0.125), chain, strict=False):
                if x is not article:
                    want[id(x)] += worth * share
            if article is not None:
                want[id(article)] += worth
        assert all(n.score == pytest.approx(want[id(n)]) for n in nodes)
        best = max((n for n in nodes if n.tag in H.BLOCK and not n.cut and n.tag not in H.HEADINGS and n.tag not in ("p", "li", "#root")), key=lambda n: want[id(n)] * (1 - n.density), default=None)
        if best is not None and want[id(best)] * (1 - best.density) > 0:
            if best.article is not None and 4 * best.article.worth >= best.worth:
                best = best.article
            assert best in H.choose(items, nodes)


def test_extract_pages(spark):
    df = pages(spark)
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    import html
    import re

    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert html_extract.extract_pages(edge(spark)).count() == len(EDGE)
    assert html_extract.extract_pages(empty(spark)).count() == 0


# --- lines


def test_line_dedup(spark):
    body = lambda i: f"<p>own {i}</p><p>also {i % 3}</p>\n\n<nav>menu</nav><p> tail </p><p>tail</p>"
    rows = [(i, f"http://user@Site.example.com:80/{i}", body(i)) for i in range(9)] + [(100 + i, f"https://small.example/{i}", body(0)) for i in range(4)] + [(200, None, body(0)), (201, "http://site.example.com", None)]
    got = {r.page_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DDL).repartition(3), ratio=0.4).collect()}
    assert got[1].text == "own 1\nalso 1" and (got[1].n_lines, got[1].n_dropped, got[1].host) == (5, 3, "site.example.com")
    assert got[100].text == "" and got[200].n_dropped == 0 and got[200].host is None
    assert got[201].text == "" and got[201].n_lines == 0
    assert {r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows[:9], DDL), ratio=0.2).where("page_id < 3").collect()} == {"own 0", "own 1", "own 2"}
    assert line_dedup.line_dedup(edge(spark)).count() == len(EDGE) and line_dedup.line_dedup(empty(spark)).count() == 0


def slow_line_dedup(rows, ratio):
    import re

    host = {}
    cut = []
    for i, url, page in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
        text = re.sub(r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", "\n", page or "")
        lines = [x for x in (y.strip(" \t\n\v\f\r") for y in re.split("[\r\n]", text)) if x]
        cut.append((i, m[1].lower() if m else None, lines))
        if m:
            host.setdefault(m[1].lower(), []).append(set(lines))
    out = []
    for i, h, lines in cut:
        n = Counter(x for s in host.get(h, []) for x in s)
        kept = [x for x in lines if not (n[x] > 1 and n[x] > ratio * len(host[h]))]
        out.append((i, h, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"most_broadcast": 0, "pages_each": 2}])
def test_line_dedup_against_plain_counts(spark, how):
    rng = random.Random(8)
    more = [(1000 + i, f"http://h{rng.randrange(6)}.example/{i}", "\n".join(f"<p>line {rng.randrange(9)}</p>" for _ in range(rng.randrange(8)))) for i in range(150)]
    rows = EDGE + more + [(r.page_id, r.url, r.html) for r in pages(spark).collect()]
    df = spark.createDataFrame(rows, DDL).repartition(3).withColumn("digests", F.lit(1)).withColumn("host", F.lit("x"))
    assert tuples(line_dedup.line_dedup(df, **how), "page_id", "host", "n_lines", "n_dropped", "text") == slow_line_dedup(rows, 0.3)


def test_markup_is_cut_as_the_pattern_says_in_linear_time():
    import re
    import time

    pattern = re.compile(r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", re.ASCII)
    rng = random.Random(4)
    parts = ["<", ">", "<script", "<script>", "</script>", "<style x>", "</style>", "<!--", "-->", "<!-->", "<p>", "a", " ", "\n", "<scripty>", "<scripté>"]
    for _ in range(3000):
        html = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert line_dedup.without_markup(html) == pattern.sub("\n", html), html
    began = time.time()
    for hostile in ("<", "<!--", "<!-- >", "<script>", "<style", " ", "<a "):
        line_dedup.without_markup(hostile * (1_000_000 // len(hostile)))
    assert time.time() - began < 10


def test_line_dedup_of_long_hostile_pages(spark):
    pages = [(i, "http://h/x", x) for i, x in enumerate(["<" * 1_000_000, " " * 1_000_000 + "x", "<!-- >" * 150_000, "<script>" * 120_000])]
    got = {r.page_id: (r.n_lines, len(r.text)) for r in line_dedup.line_dedup(spark.createDataFrame(pages, DDL)).collect()}
    assert got == {0: (1, 1_000_000), 1: (1, 1), 2: (0, 0), 3: (0, 0)}
