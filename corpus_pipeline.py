"""Cleaning and packing of a corpus: five stages, each by an operator of strataq.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents. Nulls: a null text is an
empty one; a row without doc_id is never a near-duplicate. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontaminate, near_copies, packing, secrets, toxicity
from strataq.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints of 5-word shingles in a vantage-point tree, links
    confirmed by a Jaccard similarity of 0.8 or more; bands give the links that lie beyond the tree's radius."""
    return near_copies.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets; n_chars follows the text."""
    clean = secrets.redact(secrets.find_secrets(docs, out_col="__secrets"), spans_col="__secrets")
    changed = clean.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their token ids."""
    rows = packing.pack_examples(docs, public_tokenizers.path("word_bpe_49k.json"), byte_level=False, end_id=2)
    return rows.select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_copies), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("packing", pack)]

#: SQL expresses no stage but the regular expressions; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
