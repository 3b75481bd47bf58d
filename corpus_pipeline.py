"""From raw documents to packed training sequences, in five stages over whole tables.

1. quality_rules: documents that fail the base rules or the likelihood-ratio rule go.
2. line_dedup: lines repeated across documents stay in one document only.
3. jaccard_join: of each class of near-duplicate documents one stays.
4. mixing: each document stays as often as the mix of sources to their target weights takes it.
5. best_fit_packing: what is left is cut and packed into sequences of permitted lengths.

Every stage reads its predecessor's result from Parquet.  All but the last return the columns of
``documents``; the last returns one row per packed piece.  SQL can't express the hashed weights, the
schedule and the packing, so there is no SQL for the whole; tests compare each stage with a
brute-force version.  Empty tables, null and empty texts and repeated rows are handled as the
stage's operator says in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelspark.llm.common import shared_dir, stored
from funnelspark.llm.jaccard_join import one_of_each
from funnelspark.llm.line_dedup import rewritten_documents
from funnelspark.llm.mixing import mixed_documents
from funnelspark.llm.packing import pack
from funnelspark.llm.quality_rules import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_filter(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rewritten_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: see the module's docstring.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written below the shared folder and read again."""
    work = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{work}/{k}-{name}")
    return docs
