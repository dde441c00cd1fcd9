"""A corpus pipeline over documents: language ID, line dedup, near duplicates, repeated spans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet and reads again as the
next stage's docs. All stages but the last return the columns of documents; n_chars follows the text.

Defined cases, in every stage: a null or empty text is no error (language ID drops it, as it has no letter; the stages
behind would keep it); documents of one id are documents each, but of rows that repeat id and text the Jaccard join keeps
one; ties go to the smaller id; whole texts are read, however long; further columns pass through under their names, those
that are named like a stage's own columns included; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import langid, lines, ngramjoin, packing, substrings
from spanloom.llm.common import save


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted again where there is a text."""
    kinds = dict(docs.dtypes)
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kinds["n_chars"]) if "n_chars" in kinds else None
    return out.select(*[counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = langid.predict(packed, langid.trained_model(docs), keep=False)
    return found.filter(F.col("lang_pred") != "und").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return _columns(lines.drop_boilerplate(docs), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngramjoin.near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of 13 words and more that an earlier document holds."""
    return _columns(substrings.remove_repeats(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs, lean=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: No SQL computes Viterbi labels or token ids; tests/llm/test_joins.py compares every piece with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
