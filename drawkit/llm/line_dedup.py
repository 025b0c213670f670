"""Line deduplication by a line's frequency within its site.

A line that stands in more than `ratio` of a host's pages, and in two pages at least, is boilerplate there and is
dropped from all of that host's pages. A host has few such lines: their shares add up to at most the mean number of
distinct lines of its pages, so there are at most that mean divided by `ratio`. They fit in one array per host.

Pages are cut into lines once and kept in the shared folder with their lines' digests. Counts are aggregated in the map
tasks before they are dealt by host and digest. The arrays are joined to the pages without moving these while there are
few such lines; beyond that, pages are dealt by host and a number below the host's size, so that a host that holds
a third of all pages is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored, text_or_empty

#: What begins a part that is dropped with all it holds, and what ends it. Anything else between < and > is a tag.
PARTS = ((re.compile(r"<script\b", re.ASCII), "</script>"), (re.compile(r"<style\b", re.ASCII), "</style>"), (re.compile("<!--"), "-->"))


def without_markup(html: str) -> str:
    """The text with a line feed for each script, style, comment and tag. An end that isn't there is looked for once, so time is linear."""
    out, at, absent = [], 0, set()
    while (begin := html.find("<", at)) >= 0:
        end = -1
        for opens, closes in PARTS:
            if closes not in absent and (m := opens.match(html, begin)):
                if (end := html.find(closes, m.end())) >= 0:
                    end += len(closes)
                    break
                absent.add(closes)
        if end < 0:
            end = html.find(">", begin) + 1
            if not end:  # no tag ends from here on
                break
        out.append(html[at:begin])
        at = end
    out.append(html[at:])
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The host of an absolute address in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def _without_markup(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in pages:
        yield html.map(without_markup)


def lines_of(html: Column) -> Column:
    """Trimmed lines that hold anything, with tags, comments, scripts and styles as line ends."""
    lines = F.split(F.pandas_udf(_without_markup, "string")(html), "[\r\n]+")
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), lambda x: x != "")


#: Digests of boilerplate lines up to this many are known to every task: 32 bytes each, 6 MB.
MOST_BROADCAST = 200_000
#: Pages of a host that go to one task.
PAGES_EACH = 20_000


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, ratio: float = 0.3, lines: Column | None = None, most_broadcast: int = MOST_BROADCAST, pages_each: int = PAGES_EACH) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text): text is what stays, one line each, in page order.

    Pages without a host lose nothing, nor does a host of one page. A null page counts as empty. Repeated rows count as
    pages of their own. An empty table gives an empty one; columns besides the three are not read. Lines are compared by
    SHA-256. lines: another way to cut html_col into an array of lines. most_broadcast and pages_each choose among equal
    ways.
    """
    lines = lines_of(text_or_empty(html_col)) if lines is None else lines
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines.alias("lines"))
    rows = stored(rows.withColumn("digests", F.when(F.col("host").isNotNull(), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))))))
    hosted = rows.where(F.col("host").isNotNull())
    totals = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    each = hosted.select("host", F.explode(F.array_distinct("digests")).alias("digest"))
    counts = each.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    dropped = stored(often.groupBy("host").agg(F.collect_list("digest").alias("bad"), F.max("pages").alias("pages")))
    if (dropped.agg(F.sum(F.size("bad"))).first()[0] or 0) <= most_broadcast:
        out = rows.join(F.broadcast(dropped), "host", "left")
    else:
        salts = F.ceil(F.col("pages") / pages_each).cast("int")
        dealt = rows.join(dropped.where(F.col("pages") > pages_each).select("host", salts.alias("g")), "host", "left")
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.coalesce("g", F.lit(1))).cast("int"))
        parts = dropped.select("host", "bad", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        out = dealt.where(F.col("host").isNotNull()).join(parts, ["host", "salt"], "left").unionByName(dealt.where(F.col("host").isNull()), allowMissingColumns=True)
    # The page's own bad lines first, by hashing; then each line is looked for among these alone.
    own = out.withColumn("bad", F.array_intersect("digests", "bad"))
    kept = F.transform(F.filter(F.arrays_zip("lines", "digests"), lambda x: ~F.array_contains("bad", x["digests"])), lambda x: x["lines"])
    own = own.withColumn("kept", F.when(F.coalesce(F.size("bad") > 0, F.lit(False)), kept).otherwise(F.col("lines")))
    return own.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


ORACLE_SQL = r"""
with cut as (
  select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host,
         list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', chr(10), 'g'), '[\r\n]'),
                     lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') as lines
  from pages),
totals as (select host, count(*) as pages from cut where host is not null group by host),
counts as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from cut where host is not null) group by host, line),
dropped as (select host, list(line) as bad from counts join totals using (host) where n > 1 and n > 0.3 * pages group by host)
select page_id, cut.host as host, len(lines)::bigint as n_lines,
       (len(lines) - len(list_filter(lines, lambda x: bad is null or not list_contains(bad, x))))::bigint as n_dropped,
       coalesce(array_to_string(list_filter(lines, lambda x: bad is null or not list_contains(bad, x)), chr(10)), '') as text
from cut left join dropped on cut.host = dropped.host
"""
