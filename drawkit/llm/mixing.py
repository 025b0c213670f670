"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to the target share of each source, language and topic
in turn, until all three marginals agree. A document is then sampled, by a hash of its id, with its cell's weight times
a sampling rate as probability; cells that reach 1 are taken whole and the others share what these lack, so that the
expected tokens of the sample are the rate's and have the targets' shares as far as the cells' tokens reach.

The text is read once, to count its words. The rounds work on the table of cells, which is aggregated in the map tasks
first and grows with the number of different cells only. Totals and the factors of languages and topics are one row,
and reach the other rows as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, stored, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens in the sample.
RATE = 0.5


def topic_of(text: Column, n_words: Column) -> Column:
    """A topic by form: numbers, lists, long prose, short notes, prose."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    digits = F.regexp_count(text, F.lit("[0-9]+"))
    return F.when(10 * digits > n_words, "figures").when((lines > 3) & (n_words < 8 * lines), "list").when(n_words > 2000, "long").when(n_words < 50, "note").otherwise("prose")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n"))


def smoothed_targets(cells: DataFrame, dimension: str, power: float = 0.9) -> DataFrame:
    """(value, share): each value's share of the tokens to a power, made to add up to 1; below 1 it evens out."""
    sums = cells.groupBy(dimension).agg(F.sum("n").cast("double").alias("n")).where("n > 0").select(F.col(dimension).alias("value"), F.pow("n", F.lit(power)).alias("s"))
    return sums.withColumn("all", sums.agg(F.sum("s")).scalar()).select("value", (F.col("s") / F.col("all")).alias("share"))


def _key(c: Column) -> Column:
    """A value as a string that no null and no other value shares."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("~"))


def _target_map(target: DataFrame) -> DataFrame:
    return target.where("share > 0").agg(F.map_from_entries(F.collect_list(F.struct(_key(F.col("value")).alias("k"), F.col("share").alias("v")))).alias("m"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, most_rounds: int = 40, tolerance: float = 1e-4, step: int = 4) -> DataFrame:
    """cells with weight, the factor of each cell's tokens, and off, how far a share is from its target at the end.

    cells: the dimensions and n. targets: by dimension (value, share). A value without a target gets weight 0, and so
    does a cell without tokens. Runs until no share is off by more than tolerance, or most_rounds: targets that no
    weights meet, as where a value stands in one cell only, leave off above the tolerance. `step` rounds are one job.

    Sources may be many, languages and topics are few: a source is one row with the tokens of its languages and topics.
    A round rakes every source where it is, sums up (language, topic) over the sources, and rakes the languages and the
    topics in that one small row, which is what goes back to the sources.
    """
    keyed = cells.select(_key(F.col("lang")).alias("l"), _key(F.col("topic")).alias("t"), "source", F.col("n").cast("double").alias("n")).where("n > 0")
    dims = keyed.agg(F.sort_array(F.collect_set("l")).alias("ls"), F.sort_array(F.collect_set("t")).alias("ts"), F.sum("n").alias("total"))
    dims = dims.withColumns({f"of_{d}": _target_map(targets[d]).scalar() for d in ("lang", "topic")})
    shares = lambda names, of: F.transform(names, lambda k: F.coalesce(F.element_at(of, k), F.lit(0.0)))
    dims = stored(dims.select(F.struct("ls", "ts", "total", shares("ls", F.col("of_lang")).alias("want_l"), shares("ts", F.col("of_topic")).alias("want_t")).alias("d")))
    place = F.struct((F.array_position("d.ls", F.col("l")).cast("int") - 1).alias("l"), (F.array_position("d.ts", F.col("t")).cast("int") - 1).alias("t"), F.col("n"))
    rows = keyed.withColumn("d", dims.scalar()).groupBy(_key(F.col("source")).alias("s")).agg(F.collect_list(place).alias("own"))
    rows = stored(rows.join(targets["source"].select(_key(F.col("value")).alias("s"), "share"), "s", "left").select("s", "own", (F.coalesce("share", F.lit(0.0)) * dims.select("d.total").scalar()).alias("want"), dims.select("d.total").scalar().alias("total")))

    def reach(b: str, c: str) -> Column:
        return F.aggregate("own", F.lit(0.0), lambda acc, x: acc + x["n"] * F.get(b, x["l"]) * F.get(c, x["t"]))

    def factor(b: str, c: str) -> Column:
        """What brings a source to its target."""
        return F.when(reach(b, c) > 0, F.col("want") / reach(b, c)).otherwise(0.0)

    def over(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    state = dims.select(F.struct(F.transform("d.ls", lambda _: F.lit(1.0)).alias("b"), F.transform("d.ts", lambda _: F.lit(1.0)).alias("c"), F.transform("d.ls", lambda _: F.lit(1.0)).alias("b_old"), F.transform("d.ts", lambda _: F.lit(1.0)).alias("c_old")).alias("f"))
    for _ in range(0, most_rounds, step):
        for _ in range(step):
            raked = rows.withColumn("f", state.scalar()).select(factor("f.b", "f.c").alias("a"), "own", "f").select("a", "f", F.inline("own"))
            sums = raked.groupBy("l", "t").agg(F.sum(F.col("n") * F.col("a")).alias("m"), F.first("f").alias("f"))
            at = sums.agg(F.collect_list(F.struct("l", "t", "m")).alias("ms"), F.first("f").alias("f")).withColumn("d", dims.scalar())
            b = F.transform("d.want_l", lambda w, i: over(w * F.col("d.total"), F.aggregate(F.filter("ms", lambda x: x["l"] == i), F.lit(0.0), lambda acc, x: acc + x["m"] * F.get("f.c", x["t"]))))
            at = at.withColumn("b_new", b)
            c = F.transform("d.want_t", lambda w, i: over(w * F.col("d.total"), F.aggregate(F.filter("ms", lambda x: x["t"] == i), F.lit(0.0), lambda acc, x: acc + x["m"] * F.get("b_new", x["l"]))))
            state = at.select(F.struct(F.col("b_new").alias("b"), c.alias("c"), F.col("f.b").alias("b_old"), F.col("f.c").alias("c_old")).alias("f"))
        state = stored(state)
        # Languages and topics agree as they were raked last, sources by what the last step took them from.
        gap = F.abs(factor("f.b_old", "f.c_old") * reach("f.b", "f.c") - F.col("want")) / F.col("total")
        off = rows.withColumn("f", state.scalar()).agg(F.max(gap)).first()[0] or 0.0
        if off <= tolerance:
            break
    found = rows.withColumns({"f": state.scalar(), "d": dims.scalar()}).withColumn("a", factor("f.b", "f.c"))
    each = F.transform("own", lambda x: F.struct(F.get("d.ls", x["l"]).alias("l"), F.get("d.ts", x["t"]).alias("t"), (F.col("a") * F.get("f.b", x["l"]) * F.get("f.c", x["t"])).alias("weight")))
    found = found.select("s", F.inline(each))
    out = cells.withColumns({"s": _key(F.col("source")), "l": _key(F.col("lang")), "t": _key(F.col("topic"))}).join(found, ["s", "l", "t"], "left")
    return out.select(*DIMENSIONS, "n", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(float(off)).alias("off"))


def uniform_hash(column: Column, seed: int) -> Column:
    """A number in [0, 1) from the value."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11).cast("double") * 2.0**-53


def _chance(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text of a row that has none."""
    return F.when(F.col(id_col).isNotNull(), uniform_hash(F.col(id_col), seed)).otherwise(uniform_hash(text_or_empty(text_col), seed))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, seed: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), _chance(id_col, text_col, seed).alias("_u"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("_text"), *([] if topic is None else [topic.cast("string").alias("topic")]))
    rows = rows.withColumn("n_tokens", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    return rows if topic is not None else rows.withColumn("topic", topic_of(F.col("_text"), F.col("n_tokens")))


def _probabilities(cells: DataFrame, rate: float) -> DataFrame:
    """The raked cells with their sampling probabilities, by which `rate` of all tokens are expected in the sample.

    A cell's probability is its weight times one factor, and at most 1. Tokens that full cells don't have are shared by
    the others in proportion to their weights, so that a small cell never lowers what the others get.
    """
    rows = stored(cells)
    n, w = F.col("n").cast("double"), F.col("weight")
    total, reach = rows.agg(F.sum(n), F.sum(F.when(w > 0, n))).first()
    budget, factor, full = rate * (total or 0.0), rate, -1
    if budget >= (reach or 0.0) * (1 - 1e-9):
        return rows.withColumn("probability", F.when(w > 0, 1.0).otherwise(0.0))
    while True:  # the factor only grows, so cells only become full; it ends when no further one does
        now, taken, rest = rows.agg(F.count_if(w * factor >= 1), F.sum(F.when(w * factor >= 1, n)), F.sum(F.when(w * factor < 1, n * w))).first()
        if now == full or not rest:
            break
        full, factor = now, max(factor, (budget - (taken or 0.0)) / rest)
    return rows.withColumn("probability", F.least(F.lit(1.0), w * factor))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, power: float = 0.9, rate: float = RATE, seed: int = 17, **how) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled, off) per row.

    off: how far, at the end of raking, a source's share of the tokens is from its target; more than the tolerance only
    if no weights meet all targets.

    Without targets, each marginal's target is the corpus's own shares to the given power. The sample holds `rate`
    of all tokens in expectation; cells that would need more than all their tokens are taken whole. Null sources and languages are values
    of their own. A null text has no tokens; documents in a cell without tokens have weight 0 and are not sampled.
    Rows of one id share their fate; rows without an id go by their text. An empty table gives an empty one.
    """
    rows = stored(_rows(docs, id_col, text_col, source_col, lang_col, topic, seed).drop("_text"))
    cells = stored(_cells(rows))
    targets = {d: smoothed_targets(cells, d, power) for d in DIMENSIONS} if targets is None else targets
    weights = _probabilities(rake(cells, targets, **how), rate).select(F.struct(*DIMENSIONS).alias("_cell"), "weight", "probability", "off")
    out = rows.withColumn("_cell", F.struct(*DIMENSIONS)).join(weights, "_cell", "left")
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.lit(0.0)).alias("probability"), (F.col("_u") < F.coalesce("probability", F.lit(0.0))).alias("sampled"), F.coalesce("off", F.lit(0.0)).alias("off"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, power: float = 0.9, rate: float = RATE, seed: int = 17, **how) -> DataFrame:
    """The sampled rows of docs, with the columns of docs, of any names.

    Cells are looked up by their values, so ids may repeat or be null; rows of one id share their fate, rows without one go by their text. Null and empty
    texts have no tokens; they are sampled like the others of their cell, and not at all if it has none. An empty table
    gives an empty one.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = _rows(docs, id_col, text_col, source_col, lang_col, topic, seed)
    cells = stored(_cells(rows.drop("_text")))
    targets = {d: smoothed_targets(cells, d, power) for d in DIMENSIONS} if targets is None else targets
    # Written first, so that Spark knows its size and needn't move the texts to join it.
    weights = stored(_probabilities(rake(cells, targets, **how), rate).select(F.struct(*DIMENSIONS).alias("_cell"), "probability"))
    text = text_or_empty(text_col)
    n = F.regexp_count(text, F.lit(WORD)).cast("long")
    cell = F.struct(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), (topic_of(text, n) if topic is None else topic.cast("string")).alias("topic"))
    out = docs.select(whole.alias("_row"), cell.alias("_cell"), _chance(id_col, text_col, seed).alias("_u")).join(weights, "_cell")
    return out.where(F.col("_u") < F.col("probability")).select("_row.*")
