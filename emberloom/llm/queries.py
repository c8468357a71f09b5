"""The registered query of each operator, with production parameters, and its SQL where SQL can express it.

Each takes (spark, sf_dir), reads whole tables and returns the operator's full result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import bpe, brown, crosstok, decontam, jaccard, linededup, media, negatives, quality, simhash, tokenbin, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality; learnt from labels outside the held-out quarter."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=4)


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture against the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(urlfilter.dated_captures(pages), urlfilter.derived_list(pages))


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as JPEG, decode the stored bytes, and describe them."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with the class-based bigram model, learnt from six sevenths of them."""
    return brown.scores(table(spark, sf_dir, "documents"), mod=7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds the item within its edit budget."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and merge their index; a row for each page, in index order."""
    merged = warc.histories(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines from all documents; the digest of what stays."""
    return linededup.digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 3 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3, words_per_shingle=3)


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode all documents, write them bit-packed in document order, and read the files back."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return tokenbin.offsets_and_digests(table(spark, sf_dir, "documents"), path, end_id=1)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Encode all documents by the ranks and decode the ids."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document: links at a Jaccard of 85 % of its 4-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives near the positives of every hundredth vector; a seventh of the labels is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align two tokenizers' tokens of all documents, and count the links of token pairs."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.cross_alignment(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_url_lists, op3_jpeg, op4_brown_lm, op5_decontamination, op6_warc, op7_line_dedup, op8_simhash, op9_token_files, op10_byte_bpe, op11_jaccard_join, op12_hard_negatives, op13_cross_tokenizer)
}

SQL: dict[str, str] = {"op2_url_lists": urlfilter.EVALUATE_SQL, "op6_warc": warc.HISTORIES_SQL, "op7_line_dedup": linededup.DIGEST_SQL, "op11_jaccard_join": jaccard.JACCARD_SQL, "op12_hard_negatives": negatives.NEGATIVES_SQL}
