"""Mixing sources to target weights by a low-discrepancy slot schedule.

Targets: sources in code-point order (null last) take weights from a repeating tuple and share the
corpus's words in proportion; no target exceeds ``cap`` times its source's size, and what is cut
off is shared out again by weight (water filling).

Schedule: slot k of N has the van der Corput point of k (its bits reversed), which is mapped
through the cumulative block counts of the sources, so any stretch of slots holds each source
nearly in proportion.  The slots of a source are ranked; rank r takes block r of that source.

Blocks: a source's documents are shuffled by a seeded hash and laid end to end, again and again
for further passes; the stream is cut into blocks of ``block`` words and ends at the rounded
target.  A block whose rank has no slot (a source can come out a few slots short) follows at the
end of the schedule, so nothing is lost.  As a target is at most ``cap`` passes, no document is
taken more than ``cap`` times.

Offsets and ranks are prefix sums in two levels (sums per bucket, then inside a bucket), so a
source with most of the rows is spread over many tasks.  One task sees one row per source and
one per bucket, never the documents of a source.

Defined cases: null or empty texts have size 0 and are never taken; rows with equal ids are rows of
their own; an empty table gives no rows; other columns are ignored by ``mix_report`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.llm.common import shared_dir, stored, whole_row, words

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 2048
#: Rows a hash bucket of a source's shuffle, or a chunk of the schedule, should hold.
BUCKET_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(sid, source, source_size, target) from rows (source, size); one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.get(cycle, F.col("sid") % len(weights))).withColumn("top", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("w"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("full", F.col("top") <= F.col("w") * F.col("level"))
    # the level of the first source that is not full holds for all that follow
    first = F.min_by(F.col("level"), F.when(~F.col("full"), F.struct(F.col("top") / F.col("w"), F.col("sid")))).over(everything)
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise(F.col("w") * first)
    return per.select("sid", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK_WORDS, seed: int = 17
        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces).

    rows: rid, id, source, size, h (hash of the text), one per input row.
    sources: sid, source, source_size, target, goal, need, first (its first block in the cumulated counts).
    pieces: position (in the schedule), sid, rank, rid, pass, from_word, n_words: the mix itself, in order of
    (position, from_offset).
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(body).alias("h")), f"{work}/rows")
    sources = source_targets(rows, weights, cap)
    goal = F.round("target").cast("long")
    sources = sources.withColumn("goal", goal).withColumn("need", F.ceil(F.col("goal") / block).cast("long"))
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = stored(sources.withColumn("first", F.coalesce(F.sum("need").over(ahead), F.lit(0))), f"{work}/sources")
    n_rows = rows.count()
    slots = sources.agg(F.sum("need")).first()[0] or 0
    ranked = _ranked_slots(spark, sources, slots)

    buckets = max(8, -(-n_rows // BUCKET_ROWS))
    live = rows.filter("size > 0").join(sources.select("sid", "source", "source_size", "goal", "first"),
                                        rows["source"].eqNullSafe(sources["source"])).drop("source")
    live = live.withColumn("o", F.xxhash64("id", "h", F.lit(seed)))
    live = live.withColumn("bucket", F.pmod("o", F.lit(buckets)))
    sums = live.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    lead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "bucket").orderBy("o", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (live.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, ["sid", "bucket"]).withColumn("at", F.col("start") + F.col("inner")))
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    passes = passes.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("at"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal"))).filter("lo < hi")
    cut = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    a = F.greatest(F.col("lo"), F.col("rank") * block)
    z = F.least(F.col("hi"), (F.col("rank") + 1) * block)
    pieces = cut.select("sid", "rank", "rid", "pass", "first", (a - F.col("lo")).alias("from_word"), (z - a).alias("n_words"),
                        a.alias("stream_word"))
    pieces = pieces.join(ranked, ["sid", "rank"], "left").select(
        F.coalesce("slot", F.lit(slots) + F.col("first") + F.col("rank")).alias("position"),
        "sid", "rank", "rid", "pass", "from_word", "n_words", "stream_word")
    return rows, sources, pieces


def _ranked_slots(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(sid, rank, slot): the van der Corput schedule of ``slots`` slots."""
    bits = max(1, (max(slots, 1) - 1).bit_length())
    mirrored = F.conv(F.reverse(F.lpad(F.bin(F.col("id")), bits, "0")), 2, 10).cast("long")
    point = F.floor(mirrored / F.lit(float(2**bits)) * F.lit(float(slots))).cast("long")
    width = max(1, slots // 4096)  # cells of the cumulated line: an equi-join instead of a range join
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") / width).cast("long"))
    spans = sources.filter("need > 0").select("sid", "first", (F.col("first") + F.col("need")).alias("end"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor((F.col("end") - 1) / width).cast("long"))))
    hit = drawn.join(spans, "cell").filter("point >= first and point < end").select("sid", "slot")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / BUCKET_ROWS))
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    lead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    return (hit.withColumn("inner", F.row_number().over(inside) - 1).join(starts, ["sid", "chunk"])
            .select("sid", (F.col("start") + F.col("inner")).cast("long").alias("rank"), "slot"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per input row: id, size, source_size, target and the words the mix takes of it."""
    rows, sources, pieces = mix(docs, **options)
    taken = pieces.groupBy("rid").agg(F.sum("n_words").alias("taken"))
    out = rows.join(sources.select("sid", "source", "source_size", "target"), rows["source"].eqNullSafe(sources["source"])).drop("source")
    return out.join(taken, "rid", "left").select(
        "id", "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (taken / size, rounded); columns unchanged."""
    report = mix_report(docs, id_col=id_col, text_col=text_col, **options)
    copies = (report.groupBy("id", "h").agg(F.avg(F.col("taken") / F.greatest("size", F.lit(1))).alias("c"))
              .select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.round("c").cast("int").alias("_c")).filter("_c > 0"))
    keyed = docs.select(whole_row(docs), F.col(id_col).alias("_id0"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h0"))
    joined = keyed.join(copies, (F.col("_h0") == F.col("_h")) & F.col("_id0").eqNullSafe(F.col("_id")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_copy")).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_report(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
