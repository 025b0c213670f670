"""Text, codes, file names and notes as column expressions.

All of it stays in the JVM except nfkc(), which Spark has no function for; nfkc_rows() sends only those rows through
Python that hold other compatibility forms than wide ASCII. Jobs call it where texts come in.
"""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: File suffixes by class.
DRAWING_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
MODEL_SUFFIXES = [".sldprt", ".sldasm"]
NATIVE_SUFFIXES = [".slddrw", ".dwg", ".dxf"]
#: What stands around a code without being part of it.
BOUNDARY = ".,;:，。；：()（）[]【】"
BOUNDARY_CLASS = r"[.,;:，。；：()（）\[\]【】]"
#: Notes that exempt a row, and the labels that may stand before them.
EXEMPT = ["标准件", "外购件", "无图"]
NOTE_LABEL = r"^(?:备注|类型|说明|材料类型|物料类型)\s*[:：]\s*"
NOTE_BREAK, NOTE_TAIL = r"[；;，,、/|\s]+", r"[。；;，,、/|\s]+$"
PLAIN_NOTE = r"^[A-Za-z0-9\u4E00-\u9FFF]*\z"
WRAPPED = r"^(?:（(.*)）|\((.*)\)|【(.*)】|\[(.*)\]|\{(.*)\}|《(.*)》)$"
#: Full-width ASCII and the ideographic space, by rule: U+FF01..U+FF5E stand for U+0021..U+007E.
WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　 "
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "

CJK = r"[㐀-鿿]"


def let(c: Column, use) -> Column:
    """use(c) with c worked out once, however often use refers to it; else the expression grows with each reference."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def text(c: Column | str) -> Column:
    """The column as text; null counts as empty, as everywhere in this library."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def fold_width(c: Column) -> Column:
    """Full-width ASCII as ASCII; the part of NFKC that drawings need, without Python. Refers to c three times."""
    return F.when(c.rlike(r"[！-～\u3000\u00A0]"), F.translate(c, WIDE, NARROW)).otherwise(c)


#: Characters that NFKC leaves alone, or that fold_width() does: ASCII, CJK ideographs and punctuation, wide ASCII, no-break space.
SETTLED = r"^[\x00-\x7E\u00A0\u00B0\u00B1\u00D7\u2014\u2300\u3000-\u3002\u3010\u3011\u4E00-\u9FFF\uFF01-\uFF5E]*$"


@F.pandas_udf(ArrayType(StringType()))
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form NFKC of each text of an array, given as JSON; a null is none.

    Arrays themselves would be slow: Spark measures a batch row by row, and each time walks all nulls of a list.
    """
    return s.map(lambda xs: None if xs is None else [x if x is None else unicodedata.normalize("NFKC", x) for x in json.loads(xs)])


def nfkc_rows(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns in NFKC, as far as fold_width() doesn't do that. One pass: of rows that hold nothing else only
    a null leaves the JVM."""
    plain = _settled_form(*columns)
    texts = F.array(*(F.col(c).cast("string") for c in columns))
    rows = df.withColumn("_nfkc", nfkc(F.when(~plain, F.to_json(texts))))
    return rows.withColumns({c: F.when(F.col("_nfkc").isNotNull(), F.get("_nfkc", F.lit(i))).otherwise(F.col(c)) for i, c in enumerate(columns)}).drop("_nfkc")


def _settled_form(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, ((F.octet_length(text(c)) == F.length(text(c))) | text(c).rlike(SETTLED) for c in columns))


def nfkc_split(df: DataFrame, *columns: str) -> DataFrame:
    """nfkc_rows() of a df that is cheap to read twice, as settled() makes it: rows that need no Python don't meet it."""
    plain = _settled_form(*columns)
    return df.where(plain).unionByName(nfkc_rows(df.where(~plain), *columns))


#: HTML's named references, with and without a semicolon behind them, as Python's library lists them.
_NAMED = json.dumps(html5)
_LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: What references to 128..159 stand for.
_HIGH = [bytes([n]).decode("cp1252", "replace") for n in range(128, 160)]


def unescape(c: Column) -> Column:
    """A text with its HTML character references decoded: numbers, names, and old names without a semicolon."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def character(n: Column) -> Column:
        ok = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
        return F.when(n.between(128, 159), F.get(F.array(*map(F.lit, _HIGH)), (n - 128).cast("int"))).when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def decoded(piece: Column) -> Column:
        """What follows an &."""
        digits, hexes = F.regexp_extract(piece, r"^#(\d+);?", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        name, old = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(piece, f"^({_LEGACY})", 1)
        number = F.coalesce(digits.try_cast("long"), F.lit(-1).cast("long"))
        by_hex = F.coalesce(F.conv(F.right(hexes, F.lit(8)), 16, 10).try_cast("long"), F.lit(-1).cast("long"))
        rest = lambda pattern: F.regexp_replace(piece, pattern, "")
        after = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
        return (
            F.when(digits != "", F.concat(character(number), rest(r"^#\d+;?")))
            .when(hexes != "", F.concat(character(by_hex), rest(r"^#[xX][0-9a-fA-F]+;?")))
            .when((name != "") & F.element_at(named, name).isNotNull(), F.concat(F.element_at(named, name), after(name)))
            .when(old != "", F.concat(F.element_at(named, old), after(old)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(decoded(piece))), "")).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Clean texts: printable ASCII and Chinese characters, single spaces inside only. One pass that takes nothing back.
CLEAN = r"\A(?:[\x21-\x7E\u4E00-\u9FFF]++(?: [\x21-\x7E\u4E00-\u9FFF]++)*+)?\z"


def clean_text(c: Column | str) -> Column:
    """widths folded, white space squeezed. Run nfkc_rows() before where other compatibility forms occur.

    Nearly all cells are clean, which one look tells; only the others are worked on.
    """

    def clean(v: Column) -> Column:
        return F.when(v.rlike(CLEAN), v).otherwise(squeeze(fold_width(v)))

    return clean(text(c)) if isinstance(c, str) else let(text(c), clean)


SUFFIXES = "|".join(s[1:] for s in sorted(DRAWING_SUFFIXES + MODEL_SUFFIXES + NATIVE_SUFFIXES, key=len, reverse=True))
#: Only texts with a match have anything around a code; one look tells, and most codes are bare.
EDGED = rf"^{BOUNDARY_CLASS}|{BOUNDARY_CLASS}$|[._\-/ ]$|(?i)\.(?:{SUFFIXES})$"
#: Most codes: valid as they stand, with nothing around them.
BARE = r"^(?=[0-9._/\-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9._/\-]{1,38}[0-9]\z"
CODE = r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9._/\-]{2,39}$"


def strip_code_boundary(c: Column | str) -> Column:
    """a code without the punctuation and the file suffix around it."""
    edges = rf"^{BOUNDARY_CLASS}+|{BOUNDARY_CLASS}+$"

    def strip_edges(v: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(v, edges, ""), rf"(?i)\.(?:{SUFFIXES})$", "")
        return F.when(v.rlike(EDGED), F.btrim(F.regexp_replace(F.regexp_replace(bare, edges, ""), r"[._\-/ ]+$", ""))).otherwise(v)

    return _or_bare(c, lambda v: v, lambda v: let(clean_text(v), strip_edges))


def _or_bare(c: Column | str, bare, other) -> Column:
    """bare() of a BARE code, other() of the rest: one look tells."""
    look = lambda v: F.when(text(v).rlike(BARE), bare(v)).otherwise(other(v))
    return look(F.col(c)) if isinstance(c, str) else let(c, look)


def is_valid_code(c: Column | str) -> Column:
    """3 to 40 characters of a code, with a letter and a digit among them."""
    return _or_bare(c, lambda _: F.lit(True), lambda v: strip_code_boundary(v).rlike(CODE))


def normalize_code(c: Column | str) -> Column:
    """F4."""
    return F.upper(strip_code_boundary(c))


def normalize_name(c: Column | str) -> Column:
    """F4."""
    return clean_text(c)


def casefold(c: Column) -> Column:
    """Lower case with ß as ss; what comparing names without case needs."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


SPLIT_NAME = r"^(.+)\.([^.\s]+)$"


def file_stem(c: Column | str) -> Column:
    """the name without its last extension; without a proper one, the whole name."""
    return F.regexp_replace(clean_text(c), SPLIT_NAME, "$1")


def file_suffix(c: Column | str) -> Column:
    """the last extension in lower case with its dot, or nothing."""
    return F.lower(F.regexp_extract(clean_text(c), r"^.+(\.[^.\s]+)$", 1))


def display_filename(original: Column | str, stored: Column | str) -> Column:
    """the original name, else the stored one without its time stamp."""
    return F.coalesce(F.nullif(F.btrim(text(original)), F.lit("")), F.regexp_replace(text(stored), r"^\d{14}_\d{6}_", ""))


def suffix_class(suffix: Column) -> Column:
    """Drawing, model, native or other."""
    return F.when(suffix.isin(DRAWING_SUFFIXES), "drawing").when(suffix.isin(MODEL_SUFFIXES), "model").when(suffix.isin(NATIVE_SUFFIXES), "native").otherwise("other")


def is_temp_file(c: Column | str) -> Column:
    """The base name begins with a tilde."""
    return F.regexp_extract(clean_text(c), r"([^/]*)/*$", 1).startswith("~")


def storage_name(name: Column | str, at: Column) -> Column:
    """S3: letters, digits and _ - . of the name behind a time stamp."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMddHHmmss"), F.date_format(at, "SSSSSS"), F.regexp_replace(text(name), r"[^\p{L}\p{N}_.\-]", ""))


def unwrap(c: Column, levels: int = 4) -> Column:
    """The inside of matching brackets, up to so many levels."""
    for _ in range(levels):
        c = F.btrim(F.regexp_replace(c, WRAPPED, "$1$2$3$4$5$6"))
    return c


def classify_note(c: Column | str) -> Column:
    """F8: struct (exempt, reason, review, normalized). Only a whole value exempts, or a list of nothing but such values."""
    if isinstance(c, str):
        c = F.col(c)
    raw, note = c, clean_text(c)
    for _ in range(3):
        note = F.btrim(F.regexp_replace(unwrap(note, 2), NOTE_LABEL, ""))
    note = F.btrim(F.regexp_replace(unwrap(note, 2), NOTE_TAIL, ""))

    def judge(note: Column) -> Column:
        tokens = F.transform(F.filter(F.split(note, NOTE_BREAK), lambda t: t != ""), lambda t: unwrap(F.btrim(F.regexp_replace(t, NOTE_LABEL, "")), 2))
        listed = F.when(note.rlike(NOTE_BREAK), let(tokens, lambda ts: F.when((F.size(ts) > 1) & F.forall(ts, lambda t: t.isin(EXEMPT)), F.array_join(F.array_distinct(ts), "+"))))
        some = reduce(lambda a, b: a | b, (note.contains(w) for w in EXEMPT))
        return let(F.when(note.isin(EXEMPT), note).otherwise(listed), lambda reason: F.struct(reason.isNotNull().alias("exempt"), reason.alias("reason"), (reason.isNull() & some).alias("review"), note.alias("normalized")))

    # A word without anything around or inside it, or nothing, is a whole value as it stands.
    some = reduce(lambda a, b: a | b, (F.contains(raw, F.lit(w)) for w in EXEMPT))
    exempt = raw.isin(EXEMPT)
    plain = F.struct(exempt.alias("exempt"), F.when(exempt, raw).alias("reason"), (~exempt & some).alias("review"), raw.alias("normalized"))
    return F.when(raw.rlike(PLAIN_NOTE), plain).otherwise(let(note, judge))


def code_tokens(c: Column) -> Column:
    """the code-like tokens of a text that are valid codes, in order."""
    return F.filter(F.split(c, r"[^A-Za-z0-9._/\-]+"), lambda t: t.rlike(CODE) & (~t.rlike(EDGED) | is_valid_code(t)))


def code_from_text(c: Column | str) -> Column:
    """the first labelled code of a line, else the first code."""
    label = r"(?:图号|代号|图纸编号|零件号|件号)\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9._/\-]{2,39})"
    per_line = F.transform(F.split(text(c), "\r\n|\r|\n"), lambda line: F.regexp_extract(line, label, 1))
    found = F.get(F.filter(per_line, lambda t: (t != "") & is_valid_code(t)), F.lit(0))
    return strip_code_boundary(F.coalesce(found, F.get(code_tokens(text(c)), F.lit(0)), F.lit("")))


def known_stem(c: Column | str) -> Column:
    """The stem of a drawing, model or native file; other names as they are."""
    suffixes = "|".join(x[1:] for x in DRAWING_SUFFIXES + MODEL_SUFFIXES + NATIVE_SUFFIXES)
    return F.regexp_replace(clean_text(c), rf"(?i)^(.+)\.(?:{suffixes})$", "$1")


def drawing_code(title_text: Column | str, filename: Column | str, model_code: Column | str) -> Column:
    """a drawing's own code from its title text, its file name or what a model read."""
    model = F.when(is_valid_code(model_code), strip_code_boundary(model_code))
    return F.coalesce(F.nullif(code_from_text(title_text), F.lit("")), strip_code_boundary(F.get(code_tokens(known_stem(filename)), F.lit(0))), model, F.lit(""))


def strip_own_code(title: Column, code: Column) -> Column:
    """A title without the drawing's code in front, unless nothing is left."""

    def cut(title: Column, code: Column) -> Column:
        rest = clean_text(F.regexp_replace(F.substring(title, F.length(code) + 1, F.length(title)), r"^[-_ ]+", ""))
        return let(rest, lambda r: F.when((title != "") & (code != "") & F.startswith(normalize_code(title), normalize_code(code)) & (r != ""), r).otherwise(title))

    return let(clean_text(title), lambda t: let(clean_text(code), lambda c: cut(t, c)))


def drawing_name(title: Column | str, model_name: Column | str, filename: Column | str, code: Column) -> Column:
    """the extracted title, what a model read, or what follows the code in the file name."""

    def rest(stem: Column) -> Column:
        behind = lambda token: F.when(token.isNotNull(), clean_text(F.regexp_replace(F.substring(stem, F.instr(stem, token) + F.length(token), F.length(stem)), r"^[-_ ]+", "")))
        return let(F.get(code_tokens(stem), F.lit(0)), behind)

    blank = F.lit("")
    return F.coalesce(F.nullif(strip_own_code(text(title), code), blank), F.nullif(strip_own_code(text(model_name), code), blank), F.nullif(let(known_stem(filename), rest), blank), blank)


def ocr_code_fix(c: Column) -> Column:
    """a letter O that must be a zero."""
    return F.regexp_replace(c, r"(?<=[A-Z])O(?=\d{2,})|(?<=\d)O(?=\d)", "0")


def block_code(c: Column | str) -> Column:
    """the code in an OCR block, without a short alphabetic tail."""
    found = F.regexp_extract_all(F.regexp_replace(text(c), r"(?U)\s+", ""), F.lit(r"[A-Za-z][A-Za-z0-9._\-]{2,}"), 0)
    tried = F.transform(found, lambda t: ocr_code_fix(F.regexp_replace(normalize_code(t), r"-[A-Za-z]{1,4}$", "")))
    return F.coalesce(F.get(F.filter(tried, is_valid_code), F.lit(0)), F.lit(""))


def strip(c: Column) -> Column:
    """White space, in Unicode's sense, off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")  # tried once per run of white space


def source_hash(c: Column | str) -> Column:
    """F16."""
    return F.sha2(strip(text(c)), 256)


def compact(c: Column | str) -> Column:
    """upper case without white space."""
    return F.upper(F.regexp_replace(text(c), r"(?U)\s+", ""))


def match_text(c: Column | str) -> Column:
    """word characters in lower case."""
    return F.lower(F.regexp_replace(text(c), r"(?U)[^\w㐀-鿿]+", ""))


def latex_strip(c: Column | str) -> Column:
    r"""what stands in \( \) and \[ \]."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"\\\((.*?)\\\)", "$1"), r"\\\[(.*?)\\\]", "$1"), r"^[ \t|]+|[ \t|]+$", "")


def csv_safe_strict(c: Column | str) -> Column:
    """F32: a quote before what a spreadsheet would take for a formula."""
    return F.when(text(c).rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), text(c))).otherwise(text(c))


def csv_safe_signed(c: Column | str) -> Column:
    """as F32, but signed numbers with a harmless rest pass, and blanks count."""
    harmless = text(c).rlike(r"^[+\-]\d+(?:\.\d+)?(?:\z|[^=+@()|'\"!\\\-]*\z)")
    return F.when(text(c).rlike(r"^[=+\-@\t\r]") & ~harmless, F.concat(F.lit("'"), text(c))).otherwise(text(c))


def join_issues(*parts: Column) -> Column:
    """What is not blank, joined by ；."""
    return F.concat_ws("；", *(F.nullif(F.btrim(text(p)), F.lit("")) for p in parts))


def distinct_issues(parts: Column) -> Column:
    """Of an array, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: F.btrim(p) != "")), "；")


def answer_clean(c: Column | str) -> Column:
    """an answer without Markdown marks."""
    line = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*#{1,6}\s*", ""), r"^\s*[-*+]\s+", ""), r"[*#`|_]", "")
    lines = F.filter(F.split(F.regexp_replace(text(c), r"```[A-Za-z]*", ""), "\n"), lambda x: ~x.rlike(r"^\s*(?:[-*_]\s*){3,}$"))
    return F.btrim(F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.rtrim(line(x))), "\n"), r"\n{3,}", "\n\n"))


def qa_context(title: Column | str, tech: Column | str, full: Column | str) -> Column:
    """the three texts of a drawing under their labels."""
    return F.concat_ws("\n\n", F.concat(F.lit("标题栏：\n"), text(title)), F.concat(F.lit("技术要求：\n"), text(tech)), F.concat(F.lit("全文：\n"), text(full)))


def filename_title_hint(c: Column | str) -> Column:
    """what follows the first - (else _) of the stem, unless it is a number."""
    def hint(stem: Column) -> Column:
        rest = F.btrim(F.when(F.instr(stem, "-") > 0, F.regexp_extract(stem, r"^[^\-]*-(.*)$", 1)).otherwise(F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)))
        return let(rest, lambda r: F.when(r.rlike(r"^\d*$"), "").otherwise(r))

    return let(file_stem(c), hint)


def pages_processed(total: Column, processed: Column, has_text: Column) -> Column:
    """never more than there are; an unknown single page with text counts as one."""
    return F.when(processed.isNotNull(), F.least(processed, total)).when((total == 1) & has_text, 1).otherwise(0)


def layout_orientation(width: Column, height: Column) -> Column:
    """F49."""
    return F.when(width.isNull() | height.isNull(), "unknown").when(width >= height, "horizontal").otherwise("vertical")


def secret_redact(c: Column | str, key: str) -> Column:
    """an error text without the key, at most 500 characters."""
    return F.left(F.replace(text(c), F.lit(key), F.lit("[已隐藏]")) if key else text(c), F.lit(500))


def url_quote(c: Column | str) -> Column:
    """Percent encoding with spaces as %20 and slashes kept."""
    return F.replace(F.replace(F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def source_lang(c: Column | str) -> Column:
    """F30."""
    return F.when(text(c).rlike(CJK), "zh").otherwise("auto")


def is_translatable(label: Column, c: Column | str) -> Column:
    """neither a drawing number nor a page, and with Chinese in it."""
    return ~text(label).isin("图号", "页码") & text(c).rlike(CJK)
