"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, html_extract, line_dedup, mixing, quality, simhash, token_alignment, toxicity, vector_dedup, warc, whitening, word_pieces
from ._common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op1_quality_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_quality with the corpus's own references and limits. Tested against brute force."""
    return quality.quality_by_corpus(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_dedup(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = [op1_quality, op1_quality_words, op2_byte_bpe, op3_warc, op4_toxicity, op5_word_pieces, op6_html, op7_simhash, op8_mixing, op9_exact_dedup, op10_line_dedup]
    own += [op11_token_alignment, op12_whitening, op13_vector_dedup]
    return {f.__name__: f for f in own}


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
latest as (select h, max(page_id) as latest from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h)::bigint as payload_bytes, sha1(p.h) as payload_digest,
       case when latest <> page_id then 'revisit' else 'response' end as record_type,
       case when latest <> page_id then latest end as refers_to
from p left join latest on p.h = latest.h
"""

OP9_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents),
g as (select t, arg_min(doc_id, (-n_cp, doc_id)) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""


def oracle_sql() -> dict[str, str]:
    """Models (4), tokenizers (2, 5, 11), tree scoring (6), fingerprints (7), raking (8) and eigenvectors (12) have no SQL form."""
    return {"op1_quality": quality.oracle_sql(), "op3_warc": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op13_vector_dedup": vector_dedup.ORACLE_SQL}
