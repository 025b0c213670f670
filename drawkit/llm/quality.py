"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters by class, and its words by the common words of its language, with a bin
for all other words. Both are compared with the language's reference by the Jensen-Shannon distance (base 2, so 0 to 1).
The references are fixed tables of the language at large, a parameter, and not taken from the documents that are judged:
what else the corpus holds moves no verdict, and one document is judged like a thousand. They are literals of the plan,
so a document is judged where it is read. Documents below the minimum lengths, and those of a language without a
reference, are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, stored, text_or_empty

#: Common words of four languages, lower case, with their share of all words in per cent, as word counts
#: of general prose give it.
WORD_SHARES = {
    "en": {"the": 6.9, "of": 3.6, "and": 2.9, "to": 2.6, "a": 2.3, "in": 2.1, "that": 1.1, "is": 1.0, "was": 1.0, "for": 0.9, "it": 0.9, "with": 0.7, "as": 0.7, "on": 0.7, "be": 0.6, "by": 0.5, "at": 0.5, "this": 0.5, "are": 0.4, "from": 0.4},
    "de": {"der": 3.5, "die": 3.5, "und": 2.8, "in": 1.9, "den": 1.2, "zu": 1.2, "das": 1.1, "von": 1.0, "nicht": 1.0, "ist": 0.9, "mit": 0.8, "sich": 0.7, "des": 0.7, "auf": 0.7, "dem": 0.7, "ein": 0.7, "eine": 0.7, "im": 0.6, "als": 0.6, "für": 0.6},
    "fr": {"de": 5.5, "la": 3.2, "le": 2.5, "et": 2.5, "les": 2.3, "des": 2.0, "en": 1.5, "du": 1.5, "un": 1.4, "que": 1.3, "une": 1.2, "est": 1.2, "qui": 1.0, "pour": 0.9, "dans": 0.9, "par": 0.8, "au": 0.8, "sur": 0.6, "pas": 0.6, "avec": 0.5},
    "es": {"de": 6.0, "la": 3.7, "que": 2.8, "el": 2.8, "en": 2.6, "y": 2.5, "a": 2.0, "los": 1.7, "se": 1.2, "del": 1.2, "las": 1.1, "un": 1.0, "por": 0.9, "con": 0.9, "no": 0.8, "una": 0.8, "su": 0.8, "para": 0.6, "es": 0.6, "al": 0.6},
}
SYMBOLS = "[#*$%&|<>]"
#: Character classes besides white space: capitals, digits, stops, quotation and brackets, symbols, vowels, consonants,
#: Latin letters with marks, Greek and Cyrillic, East Asian scripts, other scripts and signs. What none takes is the last bin.
CLASSES = ["[A-Z]", "[0-9]", "[.,;:!?]", r"['\x22()\-]", SYMBOLS, "[aeiou]", "[b-df-hj-np-tv-z]", "[À-ɏ]", "[Ͱ-ԯ]", "[぀-ヿ㐀-鿿가-힣]", r"[^\x00-ɏͰ-ԯ぀-ヿ㐀-鿿가-힣]"]
#: Those that a text of ASCII letters only has none of.
BEYOND_ASCII = 7
#: Shares of the classes in general prose, in per cent of all characters but white space.
CHAR_SHARES = {
    "en": [2.5, 0.8, 2.7, 0.7, 0.1, 36.0, 57.0, 0.05, 0.01, 0.01, 0.03, 0.1],
    "de": [5.0, 0.8, 2.5, 0.7, 0.1, 35.0, 54.0, 1.8, 0.01, 0.01, 0.03, 0.1],
    "fr": [2.5, 0.8, 2.7, 1.5, 0.1, 41.0, 47.5, 3.8, 0.01, 0.01, 0.03, 0.1],
    "es": [2.5, 0.8, 2.5, 0.7, 0.1, 43.0, 47.5, 2.8, 0.01, 0.01, 0.03, 0.1],
}
#: What may end a common word in a text.
ENDINGS = ["", *".,;:!?"]
POSITION_BITS = 21


def forms(word: str) -> list[str]:
    """A common word as it is, capitalised and in capitals."""
    return sorted({word, word.capitalize(), word.upper()})


def _lists(by_lang: dict[str, list]) -> Column:
    return F.create_map(*(x for k, v in sorted(by_lang.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))))


def _windows(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", word_shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms chars, commons.

    commons: words that aren't common, then each common word; null for a language without a list.

    Repeated windows are found by sorting, per document, numbers of a window's hash bits and position. If cutting the
    64-bit hashes to the bits that leave room makes two of them equal, or the text is too long, structs are sorted.
    Windows count as equal if their 64-bit hashes are: in a document of a million words two different ones meet with a
    probability of 3e-8.
    """
    word_shares = WORD_SHARES if word_shares is None else word_shares
    every = sorted({f + e for ws in word_shares.values() for w in ws for f in forms(w) for e in ENDINGS})
    lists = _lists({k: list(ws) for k, ws in word_shares.items()})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    rows = rows.select("doc_id", "lang", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    dup_lines = F.when(F.instr("text", "\n") > 0, lines).otherwise(F.array().cast("array<string>"))
    rows = rows.select(
        "doc_id", "lang", "words", F.char_length("text").cast("long").alias("n_chars"), F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.array(*(_class_count(i, c) for i, c in enumerate(CLASSES))).alias("classes"),
        dup_lines.alias("lines"), F.element_at(lists, F.col("lang")).alias("common"),
        F.filter("words", lambda w: w.isin(every)).alias("hits"), _windows(F.col("words")).alias("windows"),
    )
    rows = rows.select("*", F.size(F.array_distinct("windows")).alias("n_distinct"))
    repeats = F.col("n_distinct") < F.size("windows")
    mask = (1 << POSITION_BITS) - 1
    cut = F.size(F.array_distinct(F.transform("windows", lambda h: F.shiftright(h, POSITION_BITS)))) == F.col("n_distinct")
    exact = repeats & (F.size("windows") <= mask)
    none = F.array().cast("array<bigint>")
    rows = rows.select("*", F.when(exact, F.when(cut, F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))))).otherwise(none).alias("packed"))
    pairs = F.when(repeats & (F.col("packed").isNull() | (F.size("windows") > mask)), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", pairs.alias("pairs"))
    near = lambda x, other: F.coalesce(F.shiftright(x.bitwiseXOR(other), POSITION_BITS) == 0, F.lit(False))
    of_packed = F.transform(F.filter("packed", lambda x, i: near(x, F.get("packed", i - 1)) | near(x, F.get("packed", i + 1))), lambda x: x.bitwiseAND(F.lit(mask)))
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    of_pairs = F.transform(F.filter("pairs", lambda x, i: same(x, F.get("pairs", i - 1)) | same(x, F.get("pairs", i + 1))), lambda x: x["i"].cast("long"))
    at = F.sort_array(F.when(F.col("pairs").isNotNull(), of_pairs).otherwise(F.coalesce(of_packed, none)))
    rows = rows.select("*", at.alias("at"))
    # A word is covered by the windows that begin at it or up to two words before.
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("p")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["p"])).alias("n"), p.alias("p")), lambda s: s["n"])
    n_symbols = F.get("classes", F.lit(CLASSES.index(SYMBOLS)))
    lower_hits = F.transform("hits", lambda w: F.lower(F.rtrim(w, F.lit("".join(ENDINGS)))))
    rows = rows.select(
        "doc_id", "lang", "n_words", "word_chars", n_symbols.alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"), "classes", "common", lower_hits.alias("hits"),
    )
    chars = F.concat("classes", F.array(F.col("word_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)))
    commons = F.transform("common", lambda w: (F.size("hits") - F.size(F.array_remove("hits", w))).cast("long"))
    commons = let(commons, lambda c: F.concat(F.array(F.col("n_words") - _total(c)), c))
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), commons.alias("commons"))


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def let(c: Column, use) -> Column:
    """use(c) with c worked out once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _class_count(i: int, pattern: str) -> Column:
    n = F.regexp_count("text", F.lit(pattern)).cast("long")
    return n if i < BEYOND_ASCII else F.when(F.octet_length("text") == F.char_length("text"), F.lit(0).cast("long")).otherwise(n)


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two histograms (base 2); null if either is empty or null."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    a, b = total(counts), total(reference)
    shares = F.zip_with(counts, reference, lambda x, y: F.struct((x / a).alias("p"), (y / b).alias("q")))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    mid = lambda s: (s["p"] + s["q"]) / 2
    div = F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + (part(s["p"], mid(s)) + part(s["q"], mid(s))) / 2)
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(F.lit(0.0), div)))


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, most_chars: float = 0.24, most_words: float = 0.33, least_chars: int = 400, least_words: int = 80, word_shares: dict[str, dict[str, float]] | None = None, char_shares: dict[str, list[float]] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    kept: not base_failed, and no distance over its limit. A distance is null, and no reason to reject, if the document
    has fewer than least_chars word characters or least_words words, or its language has no reference. A null
    text has no words and fails the base rules; a null language is not judged. Repeated rows give repeated rows, an
    empty table an empty one; other columns are not read, of whatever name. word_shares and char_shares: references by
    language, the latter in the order of CLASSES with the share of all other characters last.
    """
    word_shares, char_shares = WORD_SHARES if word_shares is None else word_shares, CHAR_SHARES if char_shares is None else char_shares
    rows = base_features(docs, id_col, text_col, lang_col, word_shares).withColumn("base_failed", failed_base())
    word_refs = _lists({k: [100 - sum(ws.values()), *ws.values()] for k, ws in word_shares.items()})
    char_refs = _lists({k: [float(x) for x in v] for k, v in char_shares.items()})
    distance = lambda c, refs, guard: F.round(F.when(guard, js_distance(F.col(c), F.element_at(refs, F.col("lang")))), 6)
    rows = rows.select(*BASE, distance("chars", char_refs, F.col("word_chars") >= least_chars).alias("char_distance"), distance("commons", word_refs, F.col("n_words") >= least_words).alias("word_distance"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("char_distance") <= most_chars, F.lit(True)) & F.coalesce(F.col("word_distance") <= most_words, F.lit(True))
    return rows.select(*BASE, kept.alias("kept"), "char_distance", "word_distance")


def _references(features: DataFrame, bins: int, column: str, guard: Column) -> DataFrame:
    """One row per language: the summed histogram."""
    judged = features.where(guard & ~F.col("base_failed") & F.col("lang").isNotNull())
    sums = judged.groupBy("lang").agg(*(F.sum(F.get(column, F.lit(i))).alias(f"b{i}") for i in range(bins)))
    return sums.select("lang", F.array(*(F.col(f"b{i}") for i in range(bins))).alias(f"ref_{column}"))


def quality_by_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, most_chars: float = 0.36, least_chars: int = 200, least_words: int = 50, fence: float = 1.5, word_shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """quality() for a corpus whose languages have no fixed reference: the references are the corpus's own.

    They are summed over each language's documents that pass the base rules and the guards. A language's word_limit is
    the upper fence of their distances: third quartile plus `fence` times the distance of the quartiles, which are taken
    of distances in thousandths, so that no more than 1,001 values are held per language.
    """
    word_shares = WORD_SHARES if word_shares is None else word_shares
    bins = max(map(len, word_shares.values())) + 1
    rows = stored(base_features(docs, id_col, text_col, lang_col, word_shares).withColumn("base_failed", failed_base()))
    long_enough, enough = F.col("word_chars") >= least_chars, (F.col("n_words") >= least_words) & F.col("commons").isNotNull()
    refs = _references(rows, len(CLASSES) + 1, "chars", long_enough).join(_references(rows, bins, "commons", enough), "lang", "full")
    rows = rows.join(refs, "lang", "left")
    rows = stored(rows.select(*BASE, "lang", F.round(F.when(long_enough, js_distance(F.col("chars"), F.col("ref_chars"))), 6).alias("char_distance"), F.round(F.when(enough, js_distance(F.col("commons"), F.slice("ref_commons", 1, F.size("commons")))), 6).alias("word_distance")))
    quartiles = rows.where(~F.col("base_failed") & F.col("word_distance").isNotNull()).groupBy("lang").agg(F.percentile(F.round("word_distance", 3), [0.25, 0.75]).alias("q"))
    limits = quartiles.select("lang", F.round(F.get("q", F.lit(1)) + fence * (F.get("q", F.lit(1)) - F.get("q", F.lit(0))), 6).alias("word_limit"))
    rows = rows.join(limits, "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("char_distance") <= most_chars, F.lit(True)) & F.coalesce(F.col("word_distance") <= F.col("word_limit"), F.lit(True))
    return rows.select(*BASE, kept.alias("kept"), "char_distance", "word_distance", "word_limit")


def oracle_sql(most_chars: float = 0.24, most_words: float = 0.33, least_chars: int = 400, least_words: int = 80) -> str:
    """quality() over the table documents in DuckDB's SQL."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    lists = " ".join(f"when '{k}' then [{', '.join(f'[{quoted(forms(w))}]' for w in ws)}]" for k, ws in sorted(WORD_SHARES.items()))
    word_refs = " ".join(f"when '{k}' then {[100 - sum(ws.values()), *ws.values()]}" for k, ws in sorted(WORD_SHARES.items()))
    char_refs = " ".join(f"when '{k}' then {v}" for k, v in sorted(CHAR_SHARES.items()))
    classes = ", ".join("len(regexp_extract_all(t, '" + c.replace("'", "''") + "'))" for c in CLASSES)

    def distance(x: str, ref: str, guard: str) -> str:
        a, b = f"list_sum({x})::double", f"list_sum({ref})"
        p, q = f"({x}[i]::double / {a})", f"({ref}[i]::double / {b})"
        part = lambda y: f"case when {y} > 0 then {y} * log2({y} / (({p} + {q}) / 2)) else 0.0 end"
        return f"case when {guard} and {a} > 0 and {b} > 0 then round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({x}) + 1), lambda i: ({part(p)} + {part(q)}) / 2)))), 6) end"

    return rf"""
with w as (
  select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
tri as (select doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
cov as (select doc_id, count(distinct j) as r from (select doc_id, unnest([i, i + 1, i + 2]) as j from rep) group by doc_id),
f as (
  select w.doc_id, lang, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '{SYMBOLS}'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words,
         [{classes}] as cl, list_transform(ws, lambda x: regexp_replace(x, '[.,;:!?]$', '')) as bare
  from w left join cov on w.doc_id = cov.doc_id),
g as (select *, list_transform(case lang {lists} end, lambda c: len(list_filter(bare, lambda x: list_contains(c, x)))) as found from f),
d as (select *, list_concat(cl, [word_chars - list_sum(cl)]) as chars, list_concat([n_words - list_sum(found)], found) as commons,
             case lang {char_refs} end as ref_c, case lang {word_refs} end as ref_w,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from g),
e as (select *, {distance("chars", "ref_c", f"word_chars >= {least_chars}")} as char_distance, {distance("commons", "ref_w", f"n_words >= {least_words}")} as word_distance from d)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(char_distance <= {most_chars}, true) and coalesce(word_distance <= {most_words}, true) as kept, char_distance, word_distance
from e
"""
