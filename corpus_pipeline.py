"""Corpus pipeline: quality, language, exact dedup, near dedup, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``.  Nulls, empty texts, repeated rows, empty tables
and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.llm import exact_dedup, langid, near_dedup, packing, quality
from stockpilot.llm.columns import positional
from stockpilot.session import scratch_path

#: A document stays only if its language's posterior probability is at least this.
LEAST_LANGUAGE = 0.5


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the classifier's threshold; null and
    empty texts score 0 and go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, (text,) = positional(docs, "text")
    scored = quality.with_quality(rows, model, rows.columns, text)
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(*rows.columns).toDF(*docs.columns)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language with enough certainty, and letter by letter as
    likely in it as the texts it was learnt from; texts without letters go."""
    rows, (text,) = positional(docs, "text")
    found = langid.with_language(rows, langid.train(docs), rows.columns, text, fit=True)
    sure = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE)
    fits = F.coalesce(F.col("__fit") >= 0, F.lit(True))  # too short to be judged: stays
    return found.filter(sure & fits).select(*rows.columns).toDF(*docs.columns)


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at similarity 0.8 or more."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: The stages' models, links and token ids can't be stated in SQL.
ORACLE_SQL = None
