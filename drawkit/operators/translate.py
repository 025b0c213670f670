"""Translation state: work queues, chunks, merging of results, audits and reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import tokens as E
from ..functions.automaton import TermAutomaton
from ..functions.labels import label

MOST_CHARS, MOST_TERMS = 3000, 30
#: Characters by which terms are met.
KEY = 3
#: Terms, and characters of all of them, up to which a glossary is sent to every task: some 30 MB there.
SENT_TERMS, SENT_CHARS = 200_000, 8_000_000
DONE = ["translated", "skipped", "needs_review"]
STATUSES = ["translated", "cached", "skipped", "needs_review", "failed", "missing"]
TARGET_LANGS = ["en"]
SECTIONS = ["title", "tech", "extra"]


def validate_request(target_lang: str, sections: list[str] | None) -> None:
    """P5: raises for a language or section that there isn't."""
    if target_lang not in TARGET_LANGS:
        raise ValueError(f"no such target language: {target_lang}")
    if unknown := set(sections or ()) - set(SECTIONS):
        raise ValueError(f"no such section: {sorted(unknown)}")


def section_filter(segments: DataFrame, sections: list[str] | None) -> DataFrame:
    """P5."""
    validate_request(TARGET_LANGS[0], sections)
    return segments.where(F.col("section").isin(sections)) if sections else segments


def glossary_hash(terms: DataFrame) -> DataFrame:
    """One row (glossary_hash): SHA-256 of the sorted (source, target) pairs as JSON, as Python would write it."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("source", "target"))), lambda p: F.concat(F.lit("["), quoted(p["source"]), F.lit(", "), quoted(p["target"]), F.lit("]")))
    return terms.where("enabled").agg(F.sha2(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")), 256).alias("glossary_hash"))


def segment_translations(segments: DataFrame, translations: DataFrame, target_lang: str, provider: str) -> DataFrame:
    """Every segment, with its translation for the language and provider if there is one."""
    own = translations.where((F.col("target_lang") == target_lang) & (F.col("provider") == provider))
    own = own.select("segment_id", *(F.col(c).alias(f"t_{c}") for c in own.columns if c not in ("segment_id", "target_lang", "provider")))
    return segments.join(own, segments["id"] == own["segment_id"], "left").drop("segment_id")


def work_queue(segments: DataFrame, translations: DataFrame, *, target_lang: str, provider: str, model: str, glossary_sha: str, force: bool = False) -> DataFrame:
    """Segments without a translation that still holds. With force all of them."""
    if force:
        return segments
    own = translations.where((F.col("target_lang") == target_lang) & (F.col("provider") == provider) & (F.col("model") == model) & (F.col("glossary_hash") == glossary_sha) & F.col("status").isin(DONE))
    return segments.join(own.select(F.col("segment_id").alias("id"), "source_hash").distinct(), ["id", "source_hash"], "left_anti")


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    run = lambda chars, x, i: F.concat(x, *(F.get(chars, i + k) for k in range(1, n)))
    return F.array_distinct(T.let(F.split(c, ""), lambda chars: F.array_compact(F.transform(chars, lambda x, i: run(chars, x, i)))))


def glossary_terms(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, terms): of the enabled terms in a segment's text the 30 longest, ties by the source.

    A glossary of up to SENT_TERMS terms and SENT_CHARS characters is sent to the tasks, which find all terms of a text in
    one pass over it; texts stay where they are, and only found terms are dealt by id. A larger one meets the texts through
    the first characters of its terms. Both give the same rows. Ids are unique.
    """
    terms = glossary.where("enabled and source <> ''").select("source", F.coalesce("target", F.lit("")).alias("target"))
    n, size = terms.agg(F.count(F.lit(1)), F.sum(F.length("source") + F.length("target"))).first()
    found = _terms_sent(segments, terms) if n <= SENT_TERMS and (size or 0) <= SENT_CHARS else _terms_joined(segments, terms)
    ranked = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), "source", "target"))).alias("ts"))
    return ranked.select("id", F.transform(F.slice("ts", 1, MOST_TERMS), lambda t: F.struct(t["source"].alias("source"), t["target"].alias("target"))).alias("terms"))


def _terms_sent(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, source, target) of terms in each text, the MOST_TERMS first ones. The list is within the bounds that were checked."""
    spark, by_source = segments.sparkSession, {}
    for r in terms.collect():
        by_source.setdefault(r.source, []).append(r.target)
    sent = spark.sparkContext.broadcast(by_source)
    rows = segments.select("id", T.text("source_text").alias("source_text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        automaton = TermAutomaton(sent.value)
        order = sorted(range(len(automaton.terms)), key=lambda i: (-len(automaton.terms[i]), automaton.terms[i]))
        rank = dict(zip(order, range(len(order)), strict=True))
        targets = [sorted(sent.value[t]) for t in automaton.terms]
        for batch in batches:
            at, source, target = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pairs = [(t, x) for t in sorted(automaton.found(text), key=rank.__getitem__)[:MOST_TERMS] for x in targets[t]][:MOST_TERMS]
                at += [i] * len(pairs)
                source += [automaton.terms[t] for t, _ in pairs]
                target += [x for _, x in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(source, pa.string()), pa.array(target, pa.string())], names=["id", "source", "target"])

    return rows.mapInArrow(run, f"id {kind}, source string, target string")


def _terms_joined(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, source, target) of all terms in each text, for glossaries of any size.

    A term is met through its first KEY characters (shorter ones through all they have), which are joined with the runs of
    as many characters of each text, each once. Only ids go with the runs; longer terms are then tested on the texts of
    those ids that have met one.
    """
    keyed = terms.withColumn("_k", F.left("source", F.lit(KEY)))
    runs = segments.select("id", F.explode(F.concat(*(_grams(F.col("source_text"), n) for n in range(1, KEY + 1)))).alias("_k")).distinct()
    met = runs.join(keyed, "_k").select("id", "source", "target")
    tested = met.where(F.length("source") > KEY).join(segments.select("id", "source_text"), "id").where(F.contains("source_text", F.col("source")))
    return met.where(F.length("source") <= KEY).unionByName(tested.select("id", "source", "target"))


def hard_cut(c: Column, limit: int) -> Column:
    """where to cut a text longer than the limit: at the limit, or before a number or placeholder that stands there.

    Digits that go on beyond the cut are left to the next piece; then the cut lies neither before nor behind a full stop.
    If that leaves nothing the cut is at the limit.
    """
    digits = F.when(F.substring(c, limit + 1, 1).rlike(r"(?U)\d"), F.regexp_replace(F.left(c, F.lit(limit)), r"(?U)\d+$", "")).otherwise(F.left(c, F.lit(limit)))

    def before_marker(cut: Column) -> Column:
        ahead = F.length(F.regexp_extract(F.left(c, cut + 8), r"(?s)^(.*)SCGPH[0-9]{4}", 1))
        holds = F.left(c, cut + 8).rlike(r"SCGPH[0-9]{4}") & (ahead < cut) & (cut < ahead + 9)
        at = F.when(holds, ahead).otherwise(cut)
        return F.when(at > 0, at).otherwise(limit)

    clear = lambda n: F.length(F.regexp_extract(F.left(c, n + 1), r"(?s)^(.*[^.])[^.]", 1))
    return T.let(T.let(F.length(digits), clear), before_marker)


def hard_pieces(c: Column, limit: int) -> Column:
    """pieces of a sentence, each but the last cut where hard_cut() says. Two cuts take a limit's worth, which bounds their number."""
    start = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        cut = lambda at: F.struct(T.strip(F.substring(acc["rest"], at + 1, F.length(acc["rest"]))).alias("rest"), F.concat(acc["out"], F.array(T.strip(F.left(acc["rest"], at)))).alias("out"))
        return F.when(F.length(acc["rest"]) > limit, T.let(hard_cut(acc["rest"], limit), cut)).otherwise(acc)

    most = (2 * F.ceil(F.length(c) / max(1, limit - 10)) + 2).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: F.concat(acc["out"], F.array(acc["rest"])))


def split_chunks(c: Column, limit: int = MOST_CHARS) -> Column:
    """array of pieces of at most `limit` characters: sentences packed in order, longer ones cut.

    Sentences end behind 。！？；;!? and line ends, and behind a full stop with a space. What was being packed goes before the
    cut pieces of a long sentence, so that the pieces are in the order of the text; its last piece is packed on.
    """
    sentences = F.filter(F.transform(F.split(c, r"(?U)(?<=[。！？；;!?])\s*|(?<=\.)\s+|\n+"), T.strip), lambda x: x != "")
    pieces = F.transform(sentences, lambda x: F.when(F.length(x) > limit, hard_pieces(x, limit)).otherwise(F.array(x)))
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def pack(acc: Column, parts: Column) -> Column:
        last, cut = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
        held = F.filter(F.array(acc["held"]), lambda x: x != "")
        full = (F.size(parts) > 1) | ((acc["held"] != "") & (last != "") & (F.length(acc["held"]) + F.length(last) + 1 > limit))
        return F.when(full, F.struct(last.alias("held"), F.concat(acc["out"], held, cut).alias("out"))).otherwise(F.struct(T.strip(F.concat_ws(" ", acc["held"], last)).alias("held"), acc["out"].alias("out")))

    packed = F.aggregate(pieces, start, pack, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(T.let(packed, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(c))))


def chunks(rows: DataFrame, text_col: str = "masked", limit: int = MOST_CHARS) -> DataFrame:
    """rows with chunk_no and chunk."""
    return rows.select("*", F.posexplode(split_chunks(F.col(text_col), limit)).alias("chunk_no", "chunk"))


def mask_tokens(rows: DataFrame, text_col: str = "source_text") -> DataFrame:
    """Rows with spans, tokens and masked."""
    spanned = rows.withColumn("spans", E.raw_spans(F.col(text_col))).withColumn("spans", E.union_spans(F.col("spans")))
    return spanned.withColumns({"tokens": E.span_texts(F.col(text_col), F.col("spans")), "masked": E.mask(F.col(text_col), F.col("spans"))})


def queue(segments: DataFrame, translations: DataFrame, glossary: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """K8: (chunks to translate with tokens and terms, rows that need no translation)."""
    work = work_queue(segments, translations, **how)
    todo = mask_tokens(work.where("translatable"))
    ready = chunks(todo).join(glossary_terms(todo, glossary), "id", "left").withColumn("source_lang", T.source_lang("source_text"))
    skipped = work.where(~F.col("translatable")).select(F.col("id").alias("segment_id"), F.col("source_text").alias("translated_text"), F.lit("skipped").alias("status"), "source_hash")
    return ready, skipped


def merge_results(results: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, translated_text, status, issues): chunks joined in order, tokens put back, and the audit.

    results: segment_id, chunk_no, translated, error. segments: mask_tokens() of the segments.
    """
    whole = results.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "translated"))), lambda c: c["translated"]), " ").alias("joined"), F.max("error").alias("error"))
    rows = whole.join(segments.select(F.col("id").alias("segment_id"), "source_text", "source_hash", "tokens"), "segment_id")
    rows = rows.withColumn("back", E.unmask(F.col("joined"), F.col("tokens")))
    lost = F.transform("back.missing", lambda t: F.concat(F.lit("占位符丢失："), t))
    text = F.col("back.text")
    other = F.array_compact(F.array(F.when(T.strip(text) == T.strip(F.col("source_text")), "译文与原文相同"), F.when(~E.has_target_text(text, F.col("tokens")), "译文不含目标语言文字")))
    issues = F.array_distinct(F.concat(lost, E.translation_issues(F.col("source_text"), text, F.col("tokens")), other))
    rows = rows.withColumn("issues", issues)
    status = F.when(F.col("error").isNotNull(), "failed").when(F.size("issues") > 0, "needs_review").otherwise("translated")
    return rows.select("segment_id", text.alias("translated_text"), status.alias("status"), F.array_join("issues", "；").alias("issues"), "source_hash", "error")


def derived_status(glossary_sha: str, model: str, new: Column | None = None) -> Column:
    """Section 2.11: missing if the translation is none or out of date; translated and not new in this run is cached."""
    stale = F.col("t_status").isNull() | ~((F.col("t_source_hash") == F.col("source_hash")) & (F.col("t_glossary_hash") == glossary_sha) & (F.col("t_model") == model))
    old = F.lit(True) if new is None else ~new
    return F.when(F.coalesce(stale, F.lit(True)), "missing").when((F.col("t_status") == "translated") & old, "cached").otherwise(F.col("t_status"))


def report(segments: DataFrame, translations: DataFrame, *, target_lang: str, provider: str, model: str, glossary_sha: str) -> DataFrame:
    """Segments with status; translated_text is empty where the status is missing."""
    rows = segment_translations(segments, translations, target_lang, provider)
    return rows.withColumn("status", derived_status(glossary_sha, model))


def summary(rows: DataFrame) -> DataFrame:
    """A5: per drawing the counts by status and the tokens, those of rows out of date included. rows: report()."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    sums = [F.sum(F.coalesce(f"t_{c}", F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("total"), *counts, *sums)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The rows of each drawing's table of translations, numbered, labelled and safe for spreadsheets. rows: report()."""
    number = F.row_number().over(Window.partitionBy("drawing_id").orderBy("ordinal"))
    shown = F.when(F.col("status") == "missing", "").otherwise(T.text("t_translated_text"))
    return rows.select("drawing_id", number.alias("序号"), label("section", F.col("section")).alias("区域"), F.col("label").alias("位置/字段"), T.csv_safe_signed("source_text").alias("原文"), T.csv_safe_signed(shown).alias("译文"), label("translation", F.col("status")).alias("状态"))
