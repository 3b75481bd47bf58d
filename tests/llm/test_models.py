"""Byte CNN (gradients, held-out accuracy) and fingerprints (brute force)."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from funnelspark.llm import classifier as C
from funnelspark.llm import fingerprints as S
from plain import LOWER, words


def test_chunks_cover_every_byte():
    for n in (0, 1, C.CHUNK - 1, C.CHUNK, C.CHUNK + 1, 5 * C.CHUNK + 3):
        starts = list(C.chunk_starts(n))
        assert starts[0] == 0 and starts[-1] + C.CHUNK >= n
        assert all(b - a == C.CHUNK - C.OVERLAP for a, b in zip(starts, starts[1:], strict=False))


def test_gradients():
    rng = np.random.default_rng(1)
    model = C.ByteCNN(2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    chunks = rng.integers(0, 256, (3, C.CHUNK)).astype(np.uint8)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.forward(chunks)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = model.gradients(chunks, y)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g.reshape(-1)[i], rel=1e-3, abs=1e-7), name


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = C.op5_quality_classifier(spark, sf).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) / len(held) > 0.93


def test_scores_of_awkward_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (4, "é" * 60_000), (5, "\x00")]
    labels = spark.createDataFrame([(6, 1), (None, 0)], "doc_id long, quality int")
    df = make_docs(rows)
    assert {r["score"] for r in C.score(df, C.fit(df, labels)).collect()} == {0.5}
    net = C.ByteCNN()
    scored = C.score(df, net).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert C.score(make_docs([]), net).collect() == []
    texts = ["a" * 200_000, "b", None, "a" * 200_000]
    assert C.score_texts(net, texts) == pytest.approx([C.score_texts(net, [t])[0] for t in texts], abs=1e-6)


def plain_simhash(text):
    w = words((text or "").translate(LOWER))
    term = lambda *p: _chain(p)
    terms = [term(a, b) for a, b in zip(w, w[1:], strict=False)] if len(w) > 1 else [term(x) for x in w]
    out = 0
    for bit in range(64):
        if 2 * sum(t >> bit & 1 for t in terms) > len(terms):
            out |= 1 << bit
    return out


def _chain(parts):
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    if len(hashes) == 1:
        return hashes[0]
    h = 42
    for x in hashes:
        h = xxhash.xxh64(x.to_bytes(8, "little"), seed=h).intdigest()
    return h


def plain_report(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), _signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest())))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), *(_signed(plain_simhash(t)) for t in (text, edited, after))))
    return sorted(out, key=repr)


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def report(df):
    return sorted((tuple(r) for r in S.fingerprint_report(df).select("id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp").collect()), key=repr)


def test_fingerprints(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert report(docs) == plain_report(rows)
    monkeypatch.setattr(S, "BUCKET_DOCS", 7)
    assert report(docs) == plain_report(rows)


def test_fingerprints_of_awkward_rows(make_docs, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_DOCS", 2)
    rows = [(1, None), (-9, ""), (10**12, "one"), (5, "two words"), (5, "two words"), (7, "é" * 100 + " b c"), (8, "w x " * 40_000), (None, "no id here")]
    assert report(make_docs(rows)) == plain_report(rows)
    assert report(make_docs(rows[:1])) == plain_report(rows[:1])
    assert report(make_docs([])) == []


def test_query_likeness(spark, sf_dir):
    rows = S.op10_simhash(spark, sf_dir).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 16 for r in rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)
    fps = [int(r["fingerprint"], 16) for r in rows]
    for r in rows:
        near = sum((int(r["fingerprint"], 16) ^ x).bit_count() <= S.RADIUS for x in fps)
        assert r["n_within_radius"] == (near if r["doc_id"] % 20 == 0 else None)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 2), (3, 6), (5, 7)])
def test_search_finds_everything_within_the_radius(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = [b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 8), replace=False)) for b in base for _ in range(12)] + [0, 0, (1 << 64) - 1]
    fps = [_signed(x) for x in fps]
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    queries = table.limit(40)
    asked = {r["fp"] for r in queries.collect()}
    got = {r["fp"]: r["near"] for r in S.within_radius(table, queries, radius, blocks, salts=3).collect()}
    assert got == {q: sum(bin((q ^ x) & (2**64 - 1)).count("1") <= radius for x in fps) for q in asked}


def test_pairs_within_the_radius(spark):
    """The pairs themselves, at the registered radius, which holds most near copies; a crowded key is cut into chunks."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = [_signed(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in range(14)] + [_signed(base[0])] * 3
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    queries = spark.createDataFrame([(_signed(b),) for b in base], "fp long")
    far = {(q, x): bin((q ^ x) & (2**64 - 1)).count("1") for q in map(_signed, base) for x in fps}
    expected = sorted((q, x, fps.count(x), d) for (q, x), d in far.items() if d <= S.RADIUS)
    assert S.RADIUS >= 10 and any(d == 10 for *_, d in expected)
    for salts in (1, 3):
        assert sorted(tuple(r) for r in S.pairs_within_radius(table, queries, salts=salts).select("q", "fp", "n", "bits").collect()) == expected


def test_likeness_is_the_cosine(spark):
    row = spark.sql("select 0L a, 255L b, -1L c").select(S.likeness(F.col("a"), F.col("a")).alias("same"), S.likeness(F.col("a"), F.col("b")).alias("near"), S.likeness(F.col("a"), F.col("c")).alias("far")).first()
    assert (row["same"], row["far"]) == (1.0, 0.0) and row["near"] == pytest.approx(math.cos(math.pi / 8))
