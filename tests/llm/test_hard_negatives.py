"""Hard negatives: against brute force over all rows, with copies, ties, rounds, several cells and awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score long, rid long, vec string, qid string, _n int"


def plain(rows, every=50, scale=256):
    """Sorted result rows of (id, label, vector) rows."""
    usable = set()
    for k, label, v in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.add((k, (label + 1) % 10 if k % 7 == 0 else label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b) for b in usable if b != a)
        for p, pid, _ in [x for x in scored if x[2][1] == a[1]][:5]:
            fits = [(n, nid) for n, nid, b in scored if b[1] != a[1] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a[0], pid, r, nid, -p, -n) for r, (n, nid) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, folder, **options):
    df = spark.createDataFrame([(*r, 1, 2, "v", "q", 3) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = df.select(F.col("vec_id").alias("id"), label.alias("label"), H.quantised(F.col("embedding")).alias("vec"))
    got = H.hard_negatives(df, F.col("id") % 50 == 0, str(folder), **options)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, seed, dims=6):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(k, rng.randrange(10), [h + rng.gauss(0, 0.1) for h in rng.choice(heads)]) for k in range(n)]


def test_many_cells_and_rounds(spark, tmp_path):
    rows = clustered(1200, 5)
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows, tmp_path / "a", cell_rows=20, round_rows=40) == want


def test_copies_ties_and_awkward_rows(spark, tmp_path):
    rows = clustered(200, 6, dims=2)
    rows += [(k, 3, [1.0, 0.25]) for k in range(1000, 1400)]  # one vector, one label; eight anchors among them
    rows += [(k, k % 4, [0.75, 0.25]) for k in range(2000, 2100)]
    rows += [rows[0], rows[0], (0, 5, [0.5, 0.5]), (50, 3, [0.5]), (100, 3, []), (150, None, [1.0, 1.0]), (200, 1, None), (None, 1, [1.0, 1.0]),
             (250, 2, [1.0, None]), (300, 2, [float("nan"), 1.0]), (350, 2, [float("inf"), 1.0]), (-50, 3, [-1.0, -0.25])]
    assert mined(spark, rows, tmp_path / "a", cell_rows=16, round_rows=30) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0])], [(50, 1, [1.0, 0.0]), (51, 1, [1.0, 0.5]), (52, 2, [0.7, 0.0])]])
def test_small_tables(spark, tmp_path, rows):
    assert mined(spark, rows, tmp_path / "s") == plain(rows)


def test_scores_beyond_doubles_are_exact(spark, tmp_path):
    rows = [(k, k % 2, [100_000.0 + k, 70_000.0 - 3 * k]) for k in range(60)]
    assert mined(spark, rows, tmp_path / "b") == plain(rows)


def test_a_walk_visits_cells_by_falling_bound_and_never_twice():
    rng = np.random.default_rng(1)
    book = H.Codebook(2, True, [], counts=rng.integers(0, 4, (7, 9)))
    sides = [np.floor(rng.normal(0, 5, 7)), np.floor(rng.normal(0, 5, 9))]
    seen, bound = [], H._FAR
    while bound > -H._FAR:
        cells, bound = H._walk(sides, book, bound, 10)
        sums = [sides[0][i] + sides[1][j] for i, j in cells]
        assert sums == sorted(sums, reverse=True) and all(s > bound for s in sums)
        seen += cells
    assert sorted(seen) == [(int(i), int(j)) for i, j in np.argwhere(book.counts)]


def test_bounds_hold_for_every_row(spark, tmp_path):
    rows = clustered(300, 8)
    df = spark.createDataFrame([(k, label, v) for k, label, v in rows], "id long, label long, embedding array<float>")
    df = df.select("id", "label", H.quantised(F.col("embedding")).alias("vec"), F.col("id").alias("rid"))
    index = H.MultiIndex(df, str(tmp_path / "i"), 6, cell_rows=10)
    placed = spark.read.parquet(str(tmp_path / "i/placed")).collect()
    v = np.array([np.frombuffer(r["v"], dtype="<i8") for r in placed], dtype=float)
    book = index.book
    for a in v[:20]:
        bound = [h @ c.T + H._root_above(np.array([h @ h])) * r for h, c, r in zip((a[:3], a[3:]), book.centres, book.radii)]
        assert all(bound[0][r["w1"]] + bound[1][r["w2"]] >= a @ x for r, x in zip(placed, v))
    assert book.counts.sum() == 300 and len(book.centres[0]) > 3
