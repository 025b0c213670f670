"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame. run() applies them to
the table documents; between two stages the rows are written to the shared folder and read again. All stages but the
last return the columns of docs; the last gives each document's tokens.

Every stage works on all rows it is given, by rows: ids may be null or repeat, and columns may have any name. Null texts
count as empty throughout. An empty table runs through and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from drawkit.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from drawkit.llm._common import stored, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model of severity does not reject. It is fitted on the labelled rows of sf_dir.

    Each row is judged where it is read, so repeated rows share their fate. Null and empty texts have no feature; the
    model's prior keeps them.
    """
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts (white space aside) one row: the longest, then the smallest id, rows without one last.

    Null and empty texts are one group. Of rows that agree in id, text and length one stays.
    """
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row: the smallest id, rows without one last, ties by the text's digest.

    Texts without words (null and empty ones too) are one component with what lies near fingerprint zero. Of rows that
    agree in id and text one stays.
    """
    return simhash.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens have the target shares of source, language and topic.

    Null sources and languages are values of their own. Rows of one id share their fate; texts without words are sampled
    like the others of their cell.
    """
    return mixing.sample(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each row; a null or empty text has none.

    Every row is decoded again; one that doesn't give its text back is an error, and not left out.
    """
    ids = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["lang", "source"])
    checked = F.when(F.col("round_trip"), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("not the text again: document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long"))
    return ids.withColumn("n_tokens", checked).drop("round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", tokenized),
]

#: Models, near copies and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
