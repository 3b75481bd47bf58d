"""Document quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and adjacent word pairs of a document are hashed into ``buckets``.  Two multinomials with
add-one smoothing are counted over the buckets: the trusted target (documents labelled quality 1)
and the raw corpus (every document).  A document's score is the mean over its n-grams of
ln p_target - ln p_raw; it passes from ``threshold`` on.  The weights are rounded to integers
(1/10000 nat), so a document's sum is an exact integer and the verdict does not depend on
partitioning.  Before that stand base rules on length and repetition.

Only built-in functions run on the rows.  What reaches the driver is the weight table, whose size
is the parameter ``buckets``, whatever the corpus.

Defined cases: a null text is an empty one; without words the score is null, the base rule
fails and the document is not kept; no labelled document makes the target equal the raw corpus
(all ratios 0, so only base rules and threshold decide); rows with equal ids are judged each on
their own text; extra columns pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import SPACES, checked_small, hash_at, whole_row, word_hashes, words

BUCKETS = 1 << 14
SCALE = 10_000
#: Mean log-likelihood ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.05
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def _starts(n_words: Column, n: int) -> Column:
    """Positions (from 0) at which an n-gram begins; none if there are fewer words."""
    return F.when(n_words >= n, F.sequence(F.lit(0), n_words - n)).otherwise(F.array().cast("array<int>"))


def learn_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, *, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> list[int]:
    """Integer weights per bucket, counted over all documents and all labelled target documents."""
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("k")).filter("k is not null").distinct()
    rows = docs.select(F.col(id_col).alias("k"), word_hashes(words(F.col(text_col))).alias("h"))
    rows = rows.join(checked_small(trusted.withColumn("hit", F.lit(1))), "k", "left")
    grams = F.concat(
        F.transform("h", lambda x: _bucket(x, buckets)),
        F.transform(_starts(F.size("h"), 2), lambda i: _bucket(hash_at("h", i, 2), buckets)),
    )
    counts = (rows.select(F.explode(grams).alias("b"), F.coalesce("hit", F.lit(0)).alias("hit"))
              .groupBy("b").agg(F.count("*").alias("raw"), F.sum("hit").alias("target")))
    table = {r["b"]: (r["raw"], r["target"]) for r in counts.collect()}  # at most ``buckets`` rows
    raw_all = sum(r for r, _ in table.values())
    target_all = sum(t for _, t in table.values())
    if not target_all:
        return [0] * buckets
    shift = math.log(raw_all + buckets) - math.log(target_all + buckets)
    out = []
    for b in range(buckets):
        raw, target = table.get(b, (0, 0))
        out.append(round(SCALE * (math.log(target + 1) - math.log(raw + 1) + shift)))
    return out


def _weight_at(weights: list[int]) -> tuple[Column, int]:
    # one foldable literal: the optimizer turns it into a constant array once
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>"), len(weights)


def score_documents(docs: DataFrame, weights: list[int], threshold: float = THRESHOLD, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``_q`` with the counts, the score and the verdict."""
    return _judged(docs, weights, threshold, text_col).select("_row.*", "_q")


def _judged(docs: DataFrame, weights: list[int], threshold: float, text_col: str) -> DataFrame:
    """(_row, _q): every row of ``docs`` as a struct, and its verdict."""
    table, buckets = _weight_at(weights)
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(whole_row(docs), text.alias("_t"))
    step = step.withColumn("_w", words(F.col("_t")))
    step = step.withColumn("_h", word_hashes(F.col("_w"))).withColumn("_n", F.size("_w"))
    positions = _starts(F.col("_n"), WINDOW)
    # a cheap test first: only texts in which two windows hash alike take the exact path
    step = step.withColumn("_g", F.transform(positions, lambda i: hash_at("_h", i, WINDOW)))
    step = step.withColumn("_twice", F.size(F.array_distinct("_g")) < F.size("_g"))
    keyed = F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
    step = step.withColumn("_s", F.when(F.col("_twice"), keyed))
    last = F.size("_s") - 1
    window = lambda a: F.slice("_w", F.get("_s", a)["p"] + 1, WINDOW)
    # neighbours in hash order; where hashes agree the words decide
    same = lambda a, b: F.when(F.get("_s", a)["g"] == F.get("_s", b)["g"], window(a) == window(b)).otherwise(F.lit(False))
    repeated = F.filter(F.sequence(F.lit(0), last), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    step = step.withColumn("_p", F.when(F.col("_twice"), F.array_sort(F.transform(repeated, lambda j: F.get("_s", j)["p"]))))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("_p") - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.least(
        F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - F.get("_p", j), F.lit(WINDOW))))
    n_repeat = F.when(F.size("_p") > 0, covered).otherwise(F.lit(0).cast("long"))
    total = (F.aggregate("_h", F.lit(0).cast("long"), lambda acc, x: acc + F.get(table, _bucket(x, buckets)))
             + F.aggregate(_starts(F.col("_n"), 2), F.lit(0).cast("long"), lambda acc, i: acc + F.get(
                 table, _bucket(hash_at("_h", i, 2), buckets))))
    step = step.withColumn("_r", n_repeat).withColumn("_sum", total)
    n = F.col("_n").cast("long")
    n_grams = n + F.greatest(n - 1, F.lit(0))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    base_failed = (n < MIN_WORDS) | (100 * F.col("_r") > MAX_REPEATED_PERCENT * n)
    chars = lambda drop: F.char_length(F.translate("_t", drop, ""))
    limit = round(threshold * SCALE)
    verdict = F.struct(
        n.alias("n_words"), chars(SPACES).cast("long").alias("word_chars"),
        (F.char_length("_t") - chars(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"), base_failed.alias("base_failed"),
        (~base_failed & (F.col("_sum") >= limit * n_grams)).alias("kept"),
        F.when(n > 0, F.col("_sum") / (F.lit(float(SCALE)) * n_grams)).alias("score"))
    # the explode keeps a later filter on the verdict from being moved below, which would repeat the work per word
    return step.select("_row", F.explode(F.array(verdict)).alias("_q"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    judged = _judged(docs, learn_weights(docs, labels, buckets), threshold, "text")
    return judged.filter("_q.kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = score_documents(docs, learn_weights(docs, labels))
    return judged.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines",
                         "_q.n_repeat_words", "_q.base_failed", "_q.kept", "_q.score")
