"""SimHash document fingerprints and an exact search within a Hamming radius.

Terms are adjacent word pairs (lower-cased ASCII letters, see ``terms``); a term's weight is how often
it occurs.  Every term hash votes with its weight on 64 signed counters, and the fingerprint holds
the signs.  The angle between the term vectors of two texts is about pi times the share of differing
bits, so ``likeness`` is the cosine of that angle, at least 0.

``pairs_within_radius`` finds all pairs (query, fingerprint) that differ in at most ``radius`` bits, and
``within_radius`` counts them without a row per pair.  The 64 bits are cut into ``blocks``, each with
a radius of its own; these radii plus one sum up to radius + 1, so a pair is within the radius of
at least one block, and it is taken at the first such block only.  Fingerprints are keyed by the bits of
each block, queries by all values within the block's radius.  What meets at a key is gathered in
chunks and compared there.

Defined cases: a null or empty text has fingerprint 0; equal texts have equal fingerprints; the next
document follows in falling id (null ids last, equal ids by text hash), after the last comes the
first, and a lone document follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelspark.llm.common import checked_small, hash_at, lower_ascii, shared_dir, stored, word_hashes, words

#: Bits; see the README for the share of near copies within it.
RADIUS = 11
BLOCKS = 4
#: Fingerprints gathered in a chunk; parts into which the queries of a chunk are dealt.
CHUNK, ASK_SALTS = 512, 4
#: Documents per ordered bucket, and at most so many buckets (their heads are broadcast).
BUCKET_DOCS = 2_000
MAX_BUCKETS = 50_000
_STEP = 1 << 14


def terms(h: Column) -> Column:
    """Hashes of all adjacent pairs of the words with hashes ``h`` (a stored column), repeats included; a
    single word is a term of its own."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: hash_at(h, i, 2))
    return F.when(F.size(h) >= 2, pairs).otherwise(h)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of one document's term hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at:at + _STEP], dtype=np.int64).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash_udf(hashes: pd.Series) -> pd.Series:
    return pd.Series([simhash(np.asarray(h)) if h is not None and len(h) else 0 for h in hashes], dtype="int64")


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two fingerprints' term vectors, 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(np.pi) * F.bit_count(a.bitwiseXOR(b)) / 64))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, helper, id, h, text, next): every document and the text that follows it in falling id.

    Documents are dealt into buckets of falling ids of equal width; each bucket also gets the first
    document of the bucket behind it (the last bucket: of the first one), marked ``helper``, so the
    successor of every document is in its own bucket.  Ids spread unevenly make uneven buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    low, high = (low, high) if low is not None else (0, 0)
    buckets = min(MAX_BUCKETS, max(1, -(-n // BUCKET_DOCS)))
    width = max(1, -(-(high - low + 1) // buckets))
    rows = rows.withColumn("bucket", F.coalesce(F.floor((F.lit(high) - F.col("id")) / width), F.lit(buckets)).cast("int"))
    # heads: one row per bucket, at most MAX_BUCKETS + 1
    heads = rows.groupBy("bucket").agg(F.max("id").alias("head"))
    back = Window.orderBy("bucket")
    around = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.coalesce(F.lag("bucket").over(back), F.max("bucket").over(around)).alias("to"), "bucket", "head")
    lent = rows.join(F.broadcast(heads), (rows["bucket"] == heads["bucket"]) & rows["id"].eqNullSafe(heads["head"])).select(
        "id", "text", F.col("to").alias("bucket"))
    both = rows.withColumn("helper", F.lit(False)).unionByName(lent.withColumn("helper", F.lit(True)))
    both = both.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("helper", F.col("id").desc_nulls_last(), "h")
    return both.withColumn("next", F.lead("text").over(order))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fp, edited_fp, next_fp per document; see the module's docstring."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(~F.col("helper"), edited))
    rows = rows.withColumn("w", word_hashes(words(lower_ascii(F.col("text"))))).withColumn(
        "ew", word_hashes(words(lower_ascii(F.col("edited")))))
    rows = rows.select("bucket", "helper", "id", "h", n.cast("long").alias("n_chars"),
                       F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       simhash_udf(terms(F.col("w"))).alias("fp"), simhash_udf(terms(F.col("ew"))).alias("edited_fp"))
    order = Window.partitionBy("bucket").orderBy("helper", F.col("id").desc_nulls_last(), "h")
    return rows.withColumn("next_fp", F.lead("fp").over(order)).filter("not helper").drop("helper", "bucket", "h")


def _block_radii(radius: int, blocks: int) -> list[int]:
    """Bits by which each block may differ (-1: block not searched): all of them plus one sum up to radius + 1."""
    if radius < 0 or not 1 <= blocks <= 64:
        raise ValueError("radius must be at least 0, the number of blocks 1 to 64")
    each, more = divmod(radius + 1 - blocks, blocks)
    return [each] * (blocks - more) + [each + 1] * more


def _masks(blocks: int) -> list[int]:
    edges = [64 * b // blocks for b in range(blocks + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        mask = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _flips(mask: int, most: int) -> list[int]:
    """Every choice of at most ``most`` bits of the mask, as signed numbers."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [_signed(sum(c)) for k in range(min(most, len(bits)) + 1) for c in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _search(fingerprints: DataFrame, queries: DataFrame, radius: int, blocks: int, salts: int, pairs: bool) -> DataFrame:
    """(q, fp, n, bits) per pair, or (q, near) with the pairs of a chunk summed up inside the task."""
    masks, radii = _masks(blocks), _block_radii(radius, blocks)
    used = [(i, m, r) for i, (m, r) in enumerate(zip(masks, radii, strict=True)) if r >= 0]
    places = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m, _ in used])
    probes = [F.array(*[F.lit(x) for x in _flips(m % (1 << 64), r)]) for _, m, r in used]

    stock = fingerprints.groupBy("fp").agg(F.count("*").alias("n"))
    stock = stock.select("fp", "n", F.explode(F.transform(places, lambda p: F.struct(
        p["t"].alias("t"), F.col("fp").bitwiseAND(p["mask"]).alias("key")))).alias("k")).select("k.t", "k.key", "fp", "n")

    def probed(i: int, mask: int, flips: Column) -> Column:
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("t"), F.col("q").bitwiseAND(F.lit(mask)).bitwiseXOR(x).alias("key")))

    keys = F.concat(*[probed(i, m, f) for (i, m, _), f in zip(used, probes, strict=True)])
    asked = queries.select(F.col("fp").alias("q")).distinct().select("q", F.explode(keys).alias("k")).select("k.t", "k.key", "q")

    # keys with more rows than a chunk holds; there are at most 2 ** (64 / blocks) keys per block
    full = F.greatest(F.ceil(F.col("c") / CHUNK).cast("int"), F.lit(salts))
    cut = stock.groupBy("t", "key").agg(F.count("*").alias("c")).select("t", "key", full.alias("salts")).filter("salts > 1")
    cut = checked_small(cut)
    stock = stock.join(cut, ["t", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int"))
    asked = asked.join(cut, ["t", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    chunks = (stock.repartition("t", "key", "salt").groupBy("t", "key", "salt")
              .agg(F.collect_list(F.struct("fp", "n")).alias("held")).select("t", "key", "salt", F.col("held.fp").alias("fp"), F.col("held.n").alias("n")))
    asks = (asked.repartition("t", "key", "salt").groupBy("t", "key", "salt", F.pmod(F.xxhash64("q"), F.lit(ASK_SALTS)).alias("ask"))
            .agg(F.collect_list("q").alias("q")).drop("ask"))
    joined = asks.hint("merge").join(chunks, ["t", "key", "salt"]).select("t", "q", "fp", "n")
    wide = [np.uint64(m % (1 << 64)) for m in masks]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
            for t, asked, held, n in zip(batch["t"], batch["q"], batch["fp"], batch["n"], strict=True):
                asked, held, n = (np.asarray(v, dtype=np.int64) for v in (asked, held, n))
                for at in range(0, len(asked), CHUNK):
                    apart = asked[at:at + CHUNK, None].view(np.uint64) ^ held[None, :].view(np.uint64)
                    i, j = np.nonzero(np.bitwise_count(apart) <= radius)
                    apart = apart[i, j]
                    first = np.ones(len(i), dtype=bool)  # no block before t brings the pair together
                    for b in range(t):
                        first &= np.bitwise_count(apart & wide[b]).astype(np.int64) > radii[b]
                    i, j, apart = i[first], j[first], apart[first]
                    found.append((asked[at + i], held[j], n[j], np.bitwise_count(apart).astype(np.int64)))
            out = pd.DataFrame({c: np.concatenate(v) for c, v in zip(("q", "fp", "n", "bits"), zip(*found, strict=True), strict=True)})
            yield out if pairs else out.groupby("q", as_index=False)["n"].sum().rename(columns={"n": "near"})

    return joined.mapInPandas(compare, "q long, fp long, n long, bits long" if pairs else "q long, near long")


def pairs_within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, salts: int = 1) -> DataFrame:
    """(q, fp, n, bits): every pair of a distinct ``fp`` of ``queries`` and a distinct one of ``fingerprints``
    that differ in at most ``radius`` bits, with the number ``n`` of rows that have ``fp``.  Its members are
    the rows of ``fingerprints`` with that ``fp``."""
    return _search(fingerprints, queries, radius, blocks, salts, pairs=True)


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, salts: int = 1) -> DataFrame:
    """(fp, near): for every distinct ``fp`` of ``queries`` how many rows of ``fingerprints`` are at most
    ``radius`` bits away: the sum of ``n`` over the pairs of ``pairs_within_radius``, without a row per pair."""
    found = _search(fingerprints, queries, radius, blocks, salts, pairs=False)
    return found.groupBy(F.col("q").alias("fp")).agg(F.sum("near").alias("near"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; ``n_within_radius`` (ids divisible by 20, else null): how many of all
    documents have a fingerprint at most RADIUS bits away, itself included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = stored(fingerprint_report(docs), f"{shared_dir(spark)}/fingerprints")
    near = within_radius(out, out.filter("id % 20 = 0")).select("fp", F.col("near").alias("n"))
    asked = out.filter("id % 20 = 0").join(near, "fp", "left").withColumn("n_within_radius", F.col("n")).drop("n")
    rest = out.filter("id is null or id % 20 != 0").withColumn("n_within_radius", F.lit(None).cast("long"))
    out = asked.unionByName(rest)
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                      as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within_radius")
