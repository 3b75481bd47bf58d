"""Line de-duplication with levelled sorted runs of line hashes.

A store (``LineRuns``) keeps what is known of every line key seen so far: its 128-bit hash, the
number of documents holding it and the id of the document that keeps it.  The store is a list of
immutable runs, each a Parquet table bucketed and sorted by the hash.  A new batch

1. is reduced to one row per key,
2. is merge-anti-joined with every run: keys found in none of them are new and enter with the id
   that keeps the line, known ones only add to the count (their keeper is in an older run),
3. is written as a run of its own at level 0.

When a level holds ``fanout`` runs they are compacted into one run of the next level, so a key is
rewritten O(log batches) times.  Runs share the bucketing, so batches and runs meet bucket by bucket
without shuffling a run again.

``dedup_documents`` feeds a table in batches of descending document ids, so the first batch that
holds a key holds its largest id.  There is a batch per ``BATCH_DOCS`` documents, at
least ``MIN_BATCHES`` (so runs are compacted at every size) and at most ``MAX_BATCHES`` (each batch reads all runs);
their edges are quantiles of the ids, so a far-off id doesn't unbalance them.  Lines of ``min_chars`` code points
or more found in ``min_docs`` documents or more then lose all copies except those in the keeper.

Only built-in functions run on the rows.  Lines are compared by the MD5 of their key (128 bits).

Defined cases: a null or empty text is one empty line; a null id counts as the smallest id; rows
with equal ids are separate documents of one id (both keep the line if that id is the largest);
an empty table gives no rows; other columns pass through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import SPACES, lower_ascii, shared_dir, stored, whole_row

MIN_CHARS = 40
MIN_DOCS = 5
#: Copies of a frequent key in the final join, so that a line held by a third of all documents meets its key in so many tasks.
SALTS = 32
#: Documents that a batch should hold, and the fewest and most batches of a table.
BATCH_DOCS = 20_000_000
MIN_BATCHES, MAX_BATCHES = 5, 64


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled runs of (key, n_docs, keeper); see the module's docstring."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "key").write.mode("overwrite").format("parquet")
             .bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "key binary, n_docs long, keeper long")
        return self._merge(runs)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs merged bucket by bucket; a key stands at most once in each."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select("key", F.col("n_docs").alias("n2"), F.col("keeper").alias("k2"))
            out = out.join(more, "key", "full_outer").select(
                "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "k2").alias("keeper"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Add (key, id) rows, one per document and key."""
        keys = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        fresh = keys
        for run in self.runs():
            fresh = fresh.join(run.select("key"), "key", "left_anti")
        if any(self.levels):
            known = fresh.select("key", F.lit(True).alias("new"))
            keys = keys.join(known, "key", "left").select(
                "key", "n_docs", F.when(F.col("new"), F.col("keeper")).alias("keeper"))
        self._write(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of ``level`` into one run of the next level."""
        whole, self.levels[level] = self.levels[level], []
        self._write(self._merge([self.spark.table(name) for name in whole]), level + 1)
        for name in whole:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Forget the table names (the files stay in the work folder)."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _id(docs_id: str) -> Column:
    return F.coalesce(F.col(docs_id).cast("long"), F.lit(-(2**63)))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, key, pos, first) for every line of at least ``min_chars``; ``first`` marks a key's first line in its row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos"))),
        lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(long_enough, lambda x: F.struct(F.unhex(F.md5(x["key"])).alias("key"), x["pos"].alias("pos")))
    rows = docs.select(_id(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.sort_array(hashed).alias("keys"))
    flagged = F.transform("keys", lambda x, i: F.struct(
        x["key"].alias("key"), x["pos"].alias("pos"),
        F.coalesce(F.get("keys", i - 1)["key"] != x["key"], F.lit(True)).alias("first")))
    return rows.select("id", "text_hash", F.inline(flagged))


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                    min_docs: int = MIN_DOCS, batch_docs: int = BATCH_DOCS, fanout: int = 4) -> DataFrame:
    """``docs`` plus ``_kept`` (text without dropped lines), ``_lines`` and ``_dropped`` (counts)."""
    return _deduped(docs, id_col, text_col, min_chars, min_docs, batch_docs, fanout).select("_row.*", "_out.*")


def rewritten_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                        **options) -> DataFrame:
    """``docs`` with the dropped lines gone from the text and the character count (if there is one) renewed."""
    out = _deduped(docs, id_col, text_col, **{"min_chars": MIN_CHARS, "min_docs": MIN_DOCS, "batch_docs": BATCH_DOCS, "fanout": 4, **options})
    changed = F.col("_out._dropped") > 0
    new = {text_col: F.col("_out._kept"), chars_col: F.char_length("_out._kept").cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(F.col("_row").getField(c)).alias(c) if c in new else F.col("_row").getField(c).alias(c)
                        for c in docs.columns])


def _edges(ids: DataFrame, batch_docs: int) -> list[int]:
    """Ids that end the batches but the last, rising; equal ids fall into one batch."""
    batches = min(MAX_BATCHES, max(MIN_BATCHES, -(-ids.count() // batch_docs)))
    found = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0]
    return sorted(set(found or []))


def _frequent(lines: DataFrame, batches: int, work: str, min_docs: int, fanout: int) -> DataFrame:
    """(key, keeper) of the lines in ``min_docs`` rows or more; batch 0 has the largest ids."""
    store = LineRuns(lines.sparkSession, work, fanout)
    try:
        for b in range(batches):
            store.add(lines.filter((F.col("batch") == b) & F.col("first")).select("key", "id"))
        return stored(store.merged().filter(F.col("n_docs") >= min_docs).select("key", "keeper"), f"{work}/frequent")
    finally:
        store.drop()


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batch_docs: int, fanout: int) -> DataFrame:
    """(_row, _out): every row of ``docs`` as a struct, and its kept text and counts."""
    spark = docs.sparkSession
    work = shared_dir(spark)
    edges = _edges(docs.select(_id(id_col).alias("id")), batch_docs)
    batch = F.lit(0)
    for edge in edges:  # at most MAX_BATCHES
        batch = batch + (F.col("id") <= edge).cast("int")
    lines = keyed_lines(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(f"{work}/lines")
    lines = spark.read.schema("id long, text_hash long, key binary, pos int, first boolean, batch int").parquet(f"{work}/lines")
    frequent = _frequent(lines, len(edges) + 1, work, min_docs, fanout)
    salted = frequent.select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = (lines.select("id", "text_hash", "pos", "key", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"))
            # merged, not broadcast: the copies per salt make this side larger than its estimate
            .join(salted.hint("merge"), ["key", "salt"]).filter("id < keeper"))
    # one row per document: positions to drop, at most its own lines (documents without an id differ by their text)
    drops = hits.select("id", "text_hash", F.struct("pos", "key").alias("hit")).distinct().groupBy("id", "text_hash").agg(
        F.collect_list("hit").alias("_hits"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole_row(docs), _id(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.split(text, "\n", -1).alias("_all"))
    return _without(rows.join(drops.withColumnsRenamed({"id": "_id", "text_hash": "_text"}), ["_id", "_text"], "left"))


def _without(rows: DataFrame) -> DataFrame:
    """Drop the lines at the positions in ``_hits``, where the line there still has that key.

    Rows of equal id and text share their hits, and so would texts of one id whose hashes agree; the key tells which
    of them a position belongs to.
    """
    # touched documents only: a position counts if the line there has the key of the hit
    own = F.filter("_hits", lambda h: F.coalesce(
        F.unhex(F.md5(line_key(F.get("_all", h["pos"])))) == h["key"], F.lit(False)))
    rows = rows.withColumn("_gone", F.when(F.col("_hits").isNotNull(), F.array_distinct(F.transform(own, lambda h: h["pos"]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_gone")
    text = F.when(F.size("_gone") > 0, F.array_join(F.transform(kept, lambda i: F.get("_all", i)), "\n")).otherwise(
        F.array_join("_all", "\n"))
    out = F.struct(text.alias("_kept"), F.size("_all").cast("long").alias("_lines"),
                   F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long").alias("_dropped"))
    # the explode keeps a later filter on the counts from being moved below, which would repeat the work per line
    return rows.select("_row", F.explode(F.array(out)).alias("_out"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_documents(docs)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
                      F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
             GROUP BY key HAVING count(DISTINCT r) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id < f.keeper AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, sum(gone::int)::bigint AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
