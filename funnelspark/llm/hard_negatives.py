"""Hard negatives by an inverted multi-index: exact top lists inside score windows.

Vectors are integers here, so scores are exact.  Each half of the dimensions has a codebook (k-means on a
bounded sample, centres rounded to integers); the pair of a row's codewords is its cell.  A half of a row lies
within its codeword's radius, the largest distance of any row of the table that has it, so

    bound(i, j) = <a1, c1_i> + |a1| r1_i  +  <a2, c2_j> + |a2| r2_j

is at least the score of every row of cell (i, j) with the anchor a.  Per anchor a heap walks the cells by falling
bound, as a multi-sequence: one pointer per codeword of the first half into the second half's sorted
bounds.  A window (scores from lo to hi, best k) is certified once it holds k rows that score above the next
cell's bound, or that bound is below lo; nothing is approximate and no cap ends the walk.

Walks go in rounds: anchors with near cells form blocks, a block's walks ask for packs of rows (a cell's
rows in chunks of bounded size), and a task scores a bounded slice of packs with the block's anchors.  The
rows to be asked for grow fourfold with every round, so the number of rounds is logarithmic.  First the
positives are found (rows of the anchor's label), then all their windows together among the rows of other labels.

Of rows with equal vector and label the ``k`` smallest ids stand for all in the index, as no others can
be among the first ``k``; anchors with equal vector and label are walked once.  So copies meet in no task.

Bounds: ``SAMPLE_PER_WORD * MAX_WORDS`` rows train the codebooks on the driver, which also holds the row count of
each of the at most ``MAX_WORDS ** 2`` cells and their radii; everything else covers all rows.

Defined cases: rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part;
shorter vectors count as filled up with zeros; repeated rows (equal id, label and vector) count once; rows that share
only the id are rows of their own; ties go to the smaller id; anchors without positives, and positives without a row in
their window, give no rows; an empty table gives none; scores beyond a long fail; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.llm.common import shared_dir, stored

#: Rows a cell should hold, the most codewords per half, and sampled rows per codeword.
CELL_ROWS = 256
MAX_WORDS = 512
SAMPLE_PER_WORD = 32
#: Values (rows times dimensions) of a pack and of a slice, and anchors of a block.
PACK_VALUES = 1 << 17
SLICE_VALUES = 1 << 21
BLOCK_ANCHORS = 256
#: Rows that an anchor's walk asks for in the first round; each further round takes ``GROWTH`` times as many.
ROUND_ROWS = 8192
GROWTH = 4
_TILE = 8192
_FAR = 1 << 62
_HITS = "qid long, win int, score long, id long, rid long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as longs; null if the vector or one of its components is not usable."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    unusable = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(unusable, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


@dataclass
class Codebook:
    """Two half-space codebooks with what is known of the indexed rows; integers throughout."""

    dims: int
    exact: bool  # all sums of products are below 2**53, so doubles hold them exactly
    centres: list[np.ndarray]
    radii: list[np.ndarray] | None = None
    counts: np.ndarray | None = None

    def matrix(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.float64 if self.exact else object)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.dims // 2], x[:, self.dims // 2:]]

    def pack_rows(self) -> int:
        return max(1, PACK_VALUES // self.dims)

    def chunks(self, cells: np.ndarray) -> np.ndarray:
        return -(-cells // self.pack_rows())


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1) if x.shape[1] else x.sum(axis=1)


def _root_above(x: np.ndarray) -> np.ndarray:
    """Integers above the square roots."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) + 1 for v in x], dtype=object)
    return np.floor(np.sqrt(x)) + 1


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword of each row and the square of its distance."""
    if not x.shape[1]:
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    far = _squares(centres)[None, :] - 2 * (x @ centres.T)
    best = np.argmin(far, axis=1)
    return best, _squares(x) + far[np.arange(len(x)), best]


def _centres(x: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """k-means from the first distinct rows; integer centres."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:words]].astype(np.float64)
    for _ in range(rounds if x.shape[1] else 0):
        word, _ = _nearest(x, centres)
        for w in np.unique(word):
            centres[w] = x[word == w].mean(axis=0)
    return np.rint(centres)


def _dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """List array as a matrix of longs, shorter rows filled up with zeros."""
    length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < length[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _column(batch, name: str) -> pa.Array:
    c = batch.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _placed(book: Codebook) -> Callable:
    """Rows (.., vec) with their codewords, squared distances and the vector as bytes."""
    def place(batches):
        for batch in batches:
            x = _dense(_column(batch, "vec"), book.dims)
            found = [_nearest(half, c) for half, c in zip(book.halves(book.matrix(x)), book.centres)]
            flat = pa.py_buffer(np.ascontiguousarray(x.astype("<i8")))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * book.dims), len(x), [None, flat]).cast(pa.binary())
            out = {n: batch.column(n) for n in batch.schema.names if n != "vec"} | {"v": packed}
            for h, (word, far) in enumerate(found, 1):
                out[f"w{h}"] = pa.array(word.astype(np.int32))
                out[f"r{h}"] = pa.array([int(y) for y in _root_above(far)], pa.int64())
            yield pa.RecordBatch.from_pydict(out)
    return place


def _vectors(packed: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), dtype="<i8").reshape(-1, dims)


def _walk(sides: list[np.ndarray], book: Codebook, bound: int, budget: int) -> tuple[list[tuple[int, int]], int]:
    """Next cells of one anchor by falling bound, those below ``bound``, until ``budget`` rows are asked
    for; and the bound of all cells behind them.  Cells with equal bounds are taken together."""
    order = [np.argsort(-s, kind="stable") for s in sides]
    one, two = ([int(x) for x in s[o]] for s, o in zip(sides, order))
    falling = np.array([-x for x in two], dtype=np.int64)
    heap = []
    for i, top in enumerate(one):
        j = int(np.searchsorted(falling, top - bound)) if bound < _FAR else 0  # those above the bound were visited
        if j < len(two):
            heap.append((-(top + two[j]), i, j))
        if j == 0:
            break  # rows further down are opened as this one is reached
    heapq.heapify(heap)
    cells, rows, last = [], 0, None
    while heap and (rows < budget or -heap[0][0] == last):
        low, i, j = heapq.heappop(heap)
        last = -low
        cell = int(order[0][i]), int(order[1][j])
        if book.counts[cell]:
            cells.append(cell)
            rows += int(book.counts[cell])
        if j + 1 < len(two):
            heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
    return cells, -heap[0][0] if heap else -_FAR


def _asks(book: Codebook, budget: int) -> Callable:
    """What a block of anchors asks for next: a row per pack with the askers, dealt into slices, and one row
    (cell -1) with the askers' new bounds.  Certified anchors ask for nothing."""
    def ask(block: pd.DataFrame) -> pd.DataFrame:
        x = book.halves(book.matrix(np.frombuffer(b"".join(block["v"]), dtype="<i8").reshape(-1, book.dims)))
        sides = [h @ c.T + _root_above(_squares(h))[:, None] * r[None, :] if h.shape[1] else np.zeros((len(h), 1))
                 for h, c, r in zip(x, book.centres, book.radii)]
        wanted, askers, bounds = {}, [], []
        for k, (qid, bound, lows, kths) in enumerate(zip(block["qid"], block["bound"], block["lo"], block["kth"])):
            if bound == -_FAR or all(bound < lo or (kth > -_FAR and kth > bound) for lo, kth in zip(lows, kths)):
                continue
            cells, left = _walk([s[k] for s in sides], book, int(bound), budget)
            askers.append(qid)
            bounds.append(left)
            for cell in cells:
                wanted.setdefault(cell, []).append(qid)
        rows, at, filled, most = [], 0, 0, max(1, SLICE_VALUES // book.dims)
        for cell in sorted(wanted):
            n = int(book.counts[cell])
            parts = int(book.chunks(n))
            for part in range(parts):
                if filled >= most:
                    at, filled = at + 1, 0
                filled += -(-n // parts)
                rows.append((cell[0] * book.counts.shape[1] + cell[1], part, at, wanted[cell], None))
        if askers:
            rows.append((-1, 0, 0, askers, bounds))
        out = pd.DataFrame(rows, columns=["cell", "chunk", "slice", "members", "bounds"])
        out.insert(0, "block", block["block"].iloc[0])
        return out
    return ask


def _scores(book: Codebook, k: int, same: bool) -> Callable:
    """The best ``k`` rows of a slice for every window of its block's anchors."""
    def score(packs: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict = {"qid": [], "win": [], "score": [], "id": [], "rid": []}
        if packs.num_rows and anchors.num_rows:
            lists = _column(packs, "rows")
            rows, length = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids, rids, labels = (pc.struct_field(rows, n).to_numpy(zero_copy_only=False) for n in ("id", "rid", "label"))
            v = book.matrix(_vectors(pc.struct_field(rows, "v"), book.dims))
            qids, own = _column(anchors, "qid").to_numpy(), _column(anchors, "label").to_numpy()
            q = book.matrix(_vectors(_column(anchors, "v"), book.dims))
            place = {x: i for i, x in enumerate(qids.tolist())}
            asked = np.zeros((len(qids), packs.num_rows), dtype=bool)
            for p, members in enumerate(_column(packs, "members").to_pylist()):
                asked[[place[m] for m in members], p] = True
            pack_of = np.repeat(np.arange(packs.num_rows), length)
            lows, highs, kths = (_column(anchors, n).to_pylist() for n in ("lo", "hi", "kth"))
            wins = max(map(len, lows))
            fill = lambda lists, none: np.array([[*x, *[none] * (wins - len(x))] for x in lists], dtype=object if not book.exact else np.float64)
            low, high = np.maximum(fill(lows, _FAR), fill(kths, -_FAR)), fill(highs, -_FAR)
            best: dict = {}
            for a in range(0, len(ids), _TILE):
                b = min(a + _TILE, len(ids))
                s = q @ v[a:b].T
                usable = asked[:, pack_of[a:b]] & ((labels[None, a:b] == own[:, None]) == same)
                for w in range(wins):
                    fits = usable & (s >= low[:, w, None]) & (s <= high[:, w, None])
                    for i in np.nonzero(fits.any(axis=1))[0]:
                        at = np.nonzero(fits[i])[0]
                        if len(at) > 4 * k:  # all that reach the k-th score, ties included
                            at = at[s[i, at] >= np.partition(s[i, at], len(at) - k)[len(at) - k]]
                        new = [(-int(s[i, c]), int(ids[a + c]), int(rids[a + c])) for c in at]
                        kept = best[i, w] = heapq.nsmallest(k, best.get((i, w), []) + new)
                        if len(kept) == k:
                            low[i, w] = max(low[i, w], -kept[-1][0])
            for (i, w), kept in best.items():
                for minus, row, rid in kept:
                    for name, value in zip(out, (int(qids[i]), w, -minus, row, rid)):
                        out[name].append(value)
        return pa.table(out, schema=pa.schema([("qid", pa.int64()), ("win", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("rid", pa.int64())]))
    return score


class MultiIndex:
    """The rows (rid, id, label, vec) by cells, in packs below ``folder``."""

    def __init__(self, rows: DataFrame, folder: str, copies: int, cell_rows: int = CELL_ROWS):
        self.folder = folder
        # copies of a vector with one label: the smallest ids stand for all
        first = Window.partitionBy("label", "vec").orderBy("id", "rid")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= copies).drop("_n")
        rows = stored(rows, f"{folder}/entries")
        n, dims, most = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()
        dims, most = max(1, dims or 0), int(most or 0)
        words = max(1, min(MAX_WORDS, round(math.sqrt(n / cell_rows))))
        sample = rows.select("vec", F.xxhash64("id", "rid").alias("h"), "rid").orderBy("h", "rid").limit(SAMPLE_PER_WORD * words).select("vec").toArrow()
        x = _dense(_column(sample, "vec"), dims) if n else np.zeros((1, dims), dtype=np.int64)
        book = Codebook(dims, 16 * dims * (most + 1) ** 2 < 2**53, [])
        book.centres = [book.matrix(_centres(h.astype(np.float64), words)) for h in book.halves(x)]
        placed = stored(self._place(rows, book, "rid long, id long, label long"), f"{folder}/placed")
        one, two = (len(c) for c in book.centres)
        book.counts = np.zeros((one, two), dtype=np.int64)
        per = placed.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()
        w1, w2, c, r1, r2 = (per.column(i).to_numpy() for i in range(5))
        book.counts[w1, w2] = c
        book.radii = [np.zeros(one, dtype=np.int64), np.zeros(two, dtype=np.int64)]
        np.maximum.at(book.radii[0], w1, r1)
        np.maximum.at(book.radii[1], w2, r2)
        book.radii = [book.matrix(r) for r in book.radii]
        self.book = book
        cells = rows.sparkSession.createDataFrame(
            [(int(i), int(j), int(book.chunks(book.counts[i, j]))) for i, j in np.argwhere(book.counts)] or [(0, 0, 1)], "w1 int, w2 int, chunks int")
        share = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
        packs = placed.join(F.broadcast(cells), ["w1", "w2"])  # at most MAX_WORDS**2 rows
        packs = packs.groupBy((F.col("w1") * two + F.col("w2")).alias("cell"), share.alias("chunk")).agg(
            F.collect_list(F.struct("id", "rid", "label", "v")).alias("rows"))  # a pack is bounded by PACK_VALUES
        self.packs = stored(packs, f"{folder}/packs")

    @staticmethod
    def _place(rows: DataFrame, book: Codebook, columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]
        return rows.select(*names, "vec").mapInArrow(_placed(book), f"{columns}, v binary, w1 int, r1 long, w2 int, r2 long")

    def blocks(self, queries: DataFrame, name: str) -> DataFrame:
        """Queries (qid, label, vec) as (block, qid, label, v); blocks of about ``BLOCK_ANCHORS`` with near cells."""
        placed = stored(self._place(queries, self.book, "qid long, label long"), f"{self.folder}/{name}-placed")
        per = placed.groupBy("w1", "w2").count().orderBy("w1", "w2").collect()  # at most MAX_WORDS**2 rows
        starts, total = [], 0
        for r in per:
            starts.append((r["w1"], r["w2"], total, r["count"]))
            total += r["count"]
        starts = queries.sparkSession.createDataFrame(starts or [(0, 0, 0, 1)], "w1 int, w2 int, start long, n long")
        # inside a cell a hash of the id deals evenly, so that no task has to number a cell's anchors
        spot = F.col("start") + F.pmod(F.xxhash64("qid"), F.col("n"))
        return placed.join(F.broadcast(starts), ["w1", "w2"]).select(
            F.floor(spot / BLOCK_ANCHORS).alias("block"), "qid", "label", "v")

    def search(self, queries: DataFrame, name: str, k: int, same: bool, round_rows: int = ROUND_ROWS) -> DataFrame:
        """(qid, win, score, id, rid): for every window ``win`` of queries (block, qid, label, v, lo, hi) the best ``k``
        rows with lo <= score <= hi of the query's label (``same``) or of other labels."""
        none = F.transform("lo", lambda _: F.lit(-_FAR))
        state = stored(queries.withColumn("kth", none).withColumn("bound", F.lit(_FAR)), f"{self.folder}/{name}-start")
        best = Window.partitionBy("qid", "win").orderBy(F.desc("score"), "id", "rid")
        hits, step = state.sparkSession.createDataFrame([], _HITS), 0
        while True:
            work = f"{self.folder}/{name}-{step}"
            asked = state.groupBy("block").applyInPandas(_asks(self.book, round_rows * GROWTH**step),
                                                         "block long, cell int, chunk int, slice int, members array<long>, bounds array<long>")
            asked = stored(asked, f"{work}-asked")
            requests = asked.filter("cell >= 0")
            if asked.isEmpty():
                return hits
            packs = requests.join(self.packs, ["cell", "chunk"]).select("block", "slice", "members", "rows")
            slices = state.sparkSession.read.schema(asked.schema).parquet(f"{work}-asked").filter("cell >= 0")
            askers = slices.select("block", "slice").distinct().join(state, "block")
            new = packs.groupBy("block", "slice").cogroup(askers.groupBy("block", "slice")).applyInArrow(_scores(self.book, k, same), _HITS)
            hits = hits.unionByName(new).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
            hits = stored(hits, f"{work}-hits")
            bounds = asked.filter("cell < 0").select(F.explode(F.arrays_zip("members", "bounds")).alias("x"))
            bounds = bounds.select(F.col("x.members").alias("qid"), F.col("x.bounds").alias("bound"))
            full = hits.groupBy("qid", "win").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") == k)
            full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("win", "s"))).alias("full"))  # one entry per window
            state = state.drop("bound", "kth").join(bounds, "qid").join(full, "qid", "left")
            kth = F.transform("lo", lambda _, i: F.coalesce(F.element_at("full", i), F.lit(-_FAR)))
            state = stored(state.withColumn("kth", kth).drop("full"), f"{work}-state")
            step += 1


def hard_negatives(rows: DataFrame, anchors: Column, folder: str, *, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95, cell_rows: int = CELL_ROWS, round_rows: int = ROUND_ROWS) -> DataFrame:
    """For rows (id, label, vec) and the anchors among them: anchor_id, positive_id, rank, negative_id and both scores.

    Positives of an anchor are the best ``n_positives`` other rows of its label; a positive's negatives are the best
    ``n_negatives`` rows of other labels whose score is between the two percentages of the positive's.
    """
    rows = rows.select("id", F.col("label").cast("long").alias("label"), "vec").dropna().distinct()
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), f"{folder}/rows")
    index = MultiIndex(rows, folder, max(n_positives + 1, n_negatives), cell_rows)
    asking = rows.filter(anchors)
    queries = asking.groupBy("label", "vec").agg(F.min("rid").alias("qid"))
    queries = stored(queries, f"{folder}/queries")
    blocks = stored(index.blocks(queries, "blocks"), f"{folder}/blocks")
    # one more than asked for, as an anchor finds itself
    whole = blocks.withColumn("lo", F.array(F.lit(-_FAR))).withColumn("hi", F.array(F.lit(_FAR)))
    found = index.search(whole, "positives", n_positives + 1, True, round_rows)
    positives = found.groupBy("qid").agg(F.collect_list(F.struct(F.col("score"), F.col("id"), F.col("rid"))).alias("pos"))
    levels = positives.select("qid", F.array_sort(F.array_distinct("pos.score")).alias("levels"))
    # windows in whole numbers: ceil(low * p / 100) to floor(high * p / 100)
    cut = lambda p, percent: F.floor(p * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = blocks.join(levels, "qid").withColumn("lo", F.transform("levels", lambda p: -cut(-p, low_percent))).withColumn(
        "hi", F.transform("levels", lambda p: cut(p, high_percent)))
    windows = stored(windows, f"{folder}/windows")
    negatives = index.search(windows.drop("levels"), "negatives", n_negatives, False, round_rows)
    negatives = negatives.join(windows.select("qid", "levels"), "qid").select(
        "qid", F.get("levels", F.col("win")).alias("level"), F.col("score").alias("s"), F.col("id").alias("negative"), "rid")
    lists = negatives.groupBy("qid", "level").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("minus"), "negative", "rid"))).alias("negs"))
    lists = lists.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("level", "negs"))).alias("by"))  # one entry per positive score
    each = positives.join(lists, "qid").join(queries, "qid").select("label", "vec", "pos", "by")
    out = asking.select("id", "rid", "label", "vec").join(each, ["label", "vec"])  # a hot vector is one row of ``each``: skew joins split it
    others = F.filter("pos", lambda p: p["rid"] != F.col("rid"))
    ordered = F.array_sort(F.transform(others, lambda p: F.struct((-p["score"]).alias("minus"), p["id"].alias("id"), p["rid"].alias("rid"))))
    out = out.select(F.col("id").alias("anchor_id"), F.explode(F.slice(ordered, 1, n_positives)).alias("p"), "by")
    out = out.select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"),
                     F.posexplode(F.element_at("by", -F.col("p.minus"))).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.negative").alias("negative_id"),
                      "positive_score", (-F.col("n.minus")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("vec"))
    return hard_negatives(rows, F.col("id") % 50 == 0, shared_dir(spark))


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
