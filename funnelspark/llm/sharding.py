"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

A record scores ``-weight / ln(u)`` on every shard, ``u`` being a uniform number from the hash of
(key, shard), and goes to the shard with the highest score.  The score on one shard does not
depend on the others, so adding a shard moves rows into that shard only, and removing one moves
only its own rows.  Expected shares are proportional to the weights.

Defined cases: a null key is a key of its own (all its rows share a shard); rows with equal keys
share a shard; empty input gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hash range used for ``u``: 53 bits fit a double exactly.
_BITS = 53


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard id for ``key``; ``weights`` maps shard id to its (positive) weight."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must name at least one shard, all weights positive")
    stable = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = []
    for shard, weight in sorted(weights.items()):
        draw = F.shiftrightunsigned(F.xxhash64(stable, F.lit(int(shard))), 64 - _BITS).cast("double")
        uniform = (draw + 0.5) / F.lit(float(2**_BITS))
        scores.append(F.struct((F.lit(float(weight)) / -F.log(uniform)).alias("score"), F.lit(-int(shard)).alias("neg")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)  # ties go to the smaller shard id
    return (-best["neg"]).cast("int")


def shard_records(df: DataFrame, key: str, text: str, weights: Mapping[int, float],
                  grown: Mapping[int, float] | None = None, buckets: int = 1024) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot and (with ``grown``) grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1).  ``slot`` numbers the rows of a shard
    from 0 without gaps, in the order of a hash of the row, then (key, size, crc).  The numbering is
    done in two levels, so that no task holds a shard: counts per (shard, hash bucket) are summed
    up over the buckets, and rows are ranked inside one bucket only.  Raise ``buckets`` with the
    corpus (a bucket holds rows / (shards * buckets)).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"), shard_of(F.col(key), weights).alias("shard"),
        *([shard_of(F.col(key), grown).alias("grown")] if grown else []),
    )
    rows = rows.withColumn("h", F.xxhash64("k", "size", "crc"))
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "k", "size", "crc")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "bucket"]).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        *([F.col("grown").alias("grown_shard")] if grown else []),
    )


def write_shards(df: DataFrame, key: str, weights: Mapping[int, float], path: str, shard_column: str = "shard") -> None:
    """Write every row of ``df`` below ``path``, one folder ``shard=<id>`` per shard."""
    (df.withColumn(shard_column, shard_of(F.col(key), weights))
       .write.mode("overwrite").partitionBy(shard_column).parquet(path))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 of equal weight, law ``key``; grown_shard is with shard 8 added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_records(docs, "doc_id", "text", {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
