"""Engineering tokens: dimensions, tolerances, grades, standards and numbers that a translation must keep.

Spark's regular expressions give matches, not their places. So each pattern puts marks around its matches, and the
lengths of what lies between the marks are the places. All of it is expressions; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text

#: Units, scales of hardness and bodies of standards.
UNITS = r"mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi"
HARDNESS = "HRC|HRA|HRB|HBW|HBS|HB|HV"
STANDARDS = "GB|JB|ISO|DIN|ASTM|ANSI|JIS|EN"
#: The patterns of tokens, and whether case counts for nothing.
PATTERNS = [
    (r"(?:⌀|Φ|φ|Ø)\s*\d+(?:\.\d+)?", False),
    (r"±\s*\d+(?:\.\d+)?\s*(?:mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi)?", False),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*±\s*\d+(?:\.\d+)?\s*(?:mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi)?(?![A-Za-z0-9])", False),
    (r"(?<![A-Za-z0-9])(?:Ra|Rz)\s*\d+(?:\.\d+)?(?![A-Za-z0-9])", True),
    (r"(?<![A-Za-z0-9])(?:HRC|HRA|HRB|HBW|HBS|HB|HV)\s*\d+(?:\.\d+)?(?![A-Za-z0-9])", True),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*(?:HRC|HRA|HRB|HBW|HBS|HB|HV)(?![A-Za-z0-9])", True),
    (r"(?<![A-Za-z0-9])(?:M|G|R|SR|C)\s*\d+(?:\.\d+)?(?:\s*[x×]\s*\d+(?:\.\d+)?)?(?![A-Za-z0-9])", False),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*[～~\-—–]\s*\d+(?:\.\d+)?\s*(?:mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi|HRC|HRA|HRB|HBW|HBS|HB|HV)(?![A-Za-z0-9])", True),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*(?:mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi|HRC|HRA|HRB|HBW|HBS|HB|HV)(?![A-Za-z0-9])", True),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*[+-]\s*\d+(?:\.\d+)?(?:\s*(?:mm|cm|m|in|inch|inches|kg|g|mg|t|MPa|kPa|Pa|N|kN|rpm|min|s|h|L|mL|ml|°C|℃|°|%|μm|um|lb|lbs|psi))?(?![A-Za-z0-9])", True),
    (r"(?<![\d.])[+-]\s*\d+(?:\.\d+)?(?![.\d])", False),
    (r"(?<![A-Za-z0-9])(?:GB|JB|ISO|DIN|ASTM|ANSI|JIS|EN)\s*(?:/\s*T)?\s*[A-Z0-9][A-Z0-9.\-—–]*(?![A-Za-z0-9])", True),
    (r"(?<![A-Za-z0-9])(?:Q\d+[A-Z]?|\d{2,3}(?:Cr|Mn|Ni|Mo|Si|Ti|V|W|B|Al|Cu)[A-Za-z0-9]*|\dA\d{2}|H62|1Cr18Ni9Ti|40Cr|20CrMnTi|45#|06Cr19Ni10|304|316L|6061|7075|HT200|QT\d+-\d+)(?![A-Za-z0-9])", True),
    (r"(?<![A-Za-z0-9])[A-Z]{1,8}(?:-[A-Z0-9]{1,12}){2,}(?![A-Za-z0-9])", False),
    (r"(?<![A-Za-z0-9])[A-Z]{2,8}\d{2,}(?:[.-]\d+)*(?![A-Za-z0-9])", False),
    (r"(?<![\d.])\d+(?:\.\d+)?\s*[×x]\s*\d+(?:\.\d+)?(?![\d.])", False),
    (r"(?<![\d.])\d+:\d+(?![\d.])", False),
    (r"(?<![A-Za-z0-9])A[0-4](?![A-Za-z0-9])", False),
]
#: What each match of a pattern holds, where that is quicker to look for than the match; none of these letters has other cases.
SPACE = r"[\s\x1c-\x1f]*"
NEEDS = [
    "[⌀ΦφØ]", "±", "±", rf"(?U)[Rr][AaZz]{SPACE}\d", "[Hh][BRVbrv]", rf"(?U)\d{SPACE}[Hh][BRVbrv]", rf"(?U)[MGRC]{SPACE}\d", rf"(?U)\d{SPACE}[～~—–-]", None, rf"(?U)\d{SPACE}[+-]",
    rf"(?U)[+-]{SPACE}\d", None, None, "[A-Z]-[A-Z0-9]", r"(?U)[A-Z]{2}\d", rf"(?U)\d{SPACE}[x×]", r"(?U)\d:\d", "A[0-4]",
]
#: Patterns (standards, part numbers) that match without a digit; the others don't.
DIGITLESS = (11, 13)
#: No text without one of these holds a token.
MAYBE = r"(?U)\d|[⌀ΦφØ±]|(?i)(?:GB|JB|ISO|DIN|ASTM|ANSI|JIS|EN)|[A-Z]-[A-Z]"
#: Repeated parts that Java would match by recursion, and the same without giving anything back.
LOOPS = {
    r"(?:-[A-Z0-9]{1,12}){2,}": r"(?:-[A-Z0-9]{1,12}(?![A-Za-z0-9])){2,}+",
    r"\d{2,}(?:[.-]\d+)*": r"\d{2,}(?![A-Za-z0-9])(?:[.-]\d+(?![A-Za-z0-9]))*+",
}
#: Marks around a match, and what stands for them where a text holds them itself; no pattern looks at any of the three.
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
SPANS = "array<struct<start:int,end:int>>"


def java_pattern(pattern: str, fold: bool) -> str:
    """A pattern for Spark: Unicode's digits, cases and white space, the separators U+001C to U+001F included."""
    for plain, steady in LOOPS.items():
        pattern = pattern.replace(plain, steady)
    pattern = pattern.replace(r"\s", r"[\s\x1c-\x1f]")
    return "(?iU)" + pattern.replace("A-Z", "A-Z\u0130\u212a") if fold else "(?U)" + pattern


def pattern_spans(c: Column, pattern: str, needs: str | None = None) -> Column:
    """Where a pattern matches, in characters. c: a text without marks. needs: what every match holds. Most patterns match
    nothing in a text, so its places are worked out only if there is a mark."""
    empty = F.array().cast(SPANS)

    def step(acc: Column, piece: Column) -> Column:
        n = F.instr(piece, CLOSE) - 1
        span = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans(pieces: Column) -> Column:
        start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda acc: acc["out"])

    found = let(F.regexp_replace(c, pattern, f"{OPEN}$0{CLOSE}"), lambda m: F.when(F.contains(m, F.lit(OPEN)), let(F.split(m, OPEN), spans)).otherwise(empty))
    return found if needs is None else F.when(F.contains(c, F.lit(needs)) if len(needs) == 1 else c.rlike(needs), found).otherwise(empty)


def _all_spans(t: Column, digit: Column) -> Column:
    """The spans of all patterns in t. digit: whether t has one."""
    found = [pattern_spans(t, java_pattern(*p), needs) for p, needs in zip(PATTERNS, NEEDS, strict=True)]
    return F.flatten(F.array(*(x if i in DIGITLESS else F.when(digit, x).otherwise(F.array().cast(SPANS)) for i, x in enumerate(found))))


def raw_spans(c: Column) -> Column:
    """Spans of all patterns, pattern by pattern; they may overlap. A null has none."""
    found = let(F.translate(text(c), OPEN + CLOSE, OTHER * 2), lambda t: let(t.rlike(r"(?U)\d"), lambda digit: _all_spans(t, digit)))
    return F.when(text(c).rlike(MAYBE), found).otherwise(F.array().cast(SPANS))


def union_spans(spans: Column) -> Column:
    """Overlapping spans joined, in order; spans that only touch stay apart."""
    ordered = F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end")))), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end")))
    empty = F.array().cast(SPANS)

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(spans) <= 1, spans).otherwise(F.aggregate(ordered, empty, fold))


def span_texts(c: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.substring(c, s["start"] + 1, s["end"] - s["start"]))


def marker(index: Column) -> Column:
    return F.concat(F.lit("SCGPH"), F.lpad(index.cast("string"), 4, "0"))


def mask(c: Column, spans: Column) -> Column:
    """the text with a numbered placeholder for each span."""
    n = F.size(spans)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(c, F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])), marker(i + 1)))
    tail = F.substring(c, F.get(spans, n - 1)["end"] + 1, F.length(c))
    return F.when(n > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(c)


def unmask(c: Column, tokens: Column) -> Column:
    """struct (text, missing): placeholders as their tokens again, and the tokens whose placeholder is gone."""
    numbered = F.transform(tokens, lambda t, i: F.struct(marker(i + 1).alias("m"), t.alias("t")))
    restored = F.aggregate(numbered, c, lambda acc, x: F.replace(acc, x["m"], x["t"]))
    missing = F.transform(F.filter(numbered, lambda x: ~F.contains(c, x["m"])), lambda x: x["t"])
    return F.struct(restored.alias("text"), missing.alias("missing"))


def unit_set(c: Column, *, numbered_in: bool = True) -> Column:
    """Units in a text, in lower case. With numbered_in the word "in" is a unit only behind a number."""
    units = UNITS.replace("in|inch|inches|", "inch|inches|", 1) if numbered_in else UNITS
    found = F.regexp_extract_all(text(c), F.lit(rf"(?i)(?<![A-Za-z])(?:{units})(?![A-Za-z])|(?<=\d)\s*in\b"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.btrim(x))))


def standard_set(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(rf"(?i)(?<![A-Za-z0-9])(?:{STANDARDS})(?![A-Za-z0-9])"), 0), F.upper))


def translation_issues(source: Column, translated: Column, tokens: Column, *, strict_in: bool = False) -> Column:
    """tokens that are gone, units that were converted, standards that were replaced."""
    gone = F.transform(F.filter(tokens, lambda t: ~F.contains(text(translated), t)), lambda t: F.concat(F.lit("工程数据未原样保留："), t))
    has = lambda s, *names: F.arrays_overlap(s, F.array(*map(F.lit, names)))
    none = F.array().cast("array<string>")

    def converted(units: Column, got: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(has(units, "mm") & has(got, "in", "inch", "inches"), "译文疑似把毫米换算成了英寸"),
                F.when(has(units, "kg") & has(got, "lb", "lbs"), "译文疑似把千克换算成了磅"),
                F.when(has(units, "mpa") & has(got, "psi"), "译文疑似把兆帕换算成了 psi"),
            )
        )

    # Each set is worked out once, and only for texts that may hold what is looked for.
    metric, imperial = text(source).rlike("(?i)mm|kg|mpa"), text(translated).rlike("(?i)in|lb|psi")
    sets = F.struct(unit_set(source, numbered_in=not strict_in).alias("own"), unit_set(translated, numbered_in=not strict_in).alias("got"))
    units = F.when(metric & imperial, let(sets, lambda x: converted(x["own"], x["got"]))).otherwise(none)
    replaced = lambda own: F.when((F.size(own) > 0) & (F.size(F.array_except(standard_set(translated), own)) > 0), F.array(F.lit("译文疑似替换了标准体系"))).otherwise(none)
    return F.concat(gone, units, F.when(text(source).rlike(f"(?i){STANDARDS}"), let(standard_set(source), replaced)).otherwise(none))


def has_target_text(translated: Column, tokens: Column) -> Column:
    """a translation holds words besides the tokens, and no Chinese."""
    rest = F.aggregate(tokens, text(translated), lambda acc, t: F.replace(acc, t, F.lit(" ")))
    return ~text(translated).rlike(r"[㐀-鿿]") & rest.rlike(r"[A-Za-z]{2,}")
