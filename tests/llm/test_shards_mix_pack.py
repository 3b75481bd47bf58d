"""Sharding, mixing and packing: laws, brute force and awkward rows."""

import collections
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from funnelspark.llm import mixing as M
from funnelspark.llm import packing as P
from funnelspark.llm import sharding as S
from plain import words

AWKWARD = [(1, None, None), (2, "", "b"), (3, "a b", "a"), (3, "a b", "a"), (None, "x", "a"), (None, None, "a"), (5, "é" * 9, "Z"), (6, "w " * 9000, "b")]


def test_shards(spark, sf_dir):
    rows = S.op6_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        draws = [xxhash.xxh64(s.to_bytes(4, "little"), seed=xxhash.xxh64(str(r["doc_id"]).encode(), seed=42).intdigest()).intdigest() >> 11 for s in range(9)]
        assert r["shard"] == max(range(8), key=lambda s: draws[s])  # equal weights: the largest draw
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_awkward_rows_and_weights(spark, make_docs):
    df = make_docs(AWKWARD)
    rows = S.shard_records(df, "doc_id", "text", {0: 1.0, 1: 2.0}, {0: 1.0, 1: 2.0, 2: 1.0}, buckets=3).collect()
    assert len(rows) == len(AWKWARD) and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    many = spark.range(20_000).select(S.shard_of(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in many}[1] == pytest.approx(15_000, rel=0.03)
    moved = spark.range(20_000).filter(S.shard_of(F.col("id"), {0: 1.0, 1: 1.0}) != S.shard_of(F.col("id"), {0: 1.0, 1: 1.0, 2: 1.0}))
    assert moved.filter(S.shard_of(F.col("id"), {0: 1.0, 1: 1.0, 2: 1.0}) != 2).count() == 0
    assert S.shard_records(make_docs([]), "doc_id", "text", {0: 1.0}).collect() == []
    with pytest.raises(ValueError):
        S.shard_of(F.col("id"), {})


def test_write_shards(spark, make_docs, tmp_path):
    S.write_shards(make_docs(AWKWARD), "doc_id", {0: 1.0, 1: 1.0}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(AWKWARD)


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(names):
        level = (total - sum(fixed.values())) / sum(weight[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and level * weight[s] >= cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in names if s not in fixed}
        fixed |= {s: float(cap * sizes[s]) for s in over}
    return fixed


def check_mix(rows, result, tolerance=1.0):
    sizes = collections.Counter()
    for key, text, source in rows:
        sizes[source] += len(words(text))
    targets = water_fill(sizes)
    assert len(result) == len(rows)
    taken = collections.Counter()
    by_id = collections.defaultdict(set)
    for key, text, source in rows:
        by_id[key].add((source, len(words(text))))
    for r in result:
        source = next(s for s, n in by_id[r["id"]] if n == r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - t) <= tolerance for s, t in targets.items())


def test_mix_matches_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first = M.mix_report(docs).collect()
    check_mix(rows, first)
    assert sorted((r["id"], r["taken"]) for r in M.mix_report(docs.repartition(5)).collect()) == sorted((r["id"], r["taken"]) for r in first)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix_of_skewed_sources(make_docs, block):
    rows = [(i, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 10}") for i in range(150)] + [(1000, "w " * 5000, "big"), (1001, "w", None)]
    check_mix(rows, M.mix_report(make_docs(rows), block=block).collect())


def test_mix_of_awkward_rows(make_docs):
    rows = [(1, None, None), (2, "", "b"), (3, "a b", "a"), (4, "x", "a"), (5, None, "a"), (6, "w " * 9000, "b"), (7, "é", "é")]
    check_mix(rows, M.mix_report(make_docs(rows)).collect())
    assert M.mix_report(make_docs(AWKWARD)).count() == len(AWKWARD)
    assert M.mix_report(make_docs([])).collect() == [] and M.mixed_documents(make_docs([])).collect() == []
    assert [r["taken"] for r in M.mix_report(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_schedule_is_even(make_docs):
    """Any prefix of the schedule holds every source nearly in proportion."""
    rows = [(i, "w " * 64, f"s{i % 4}") for i in range(400)]
    _, sources, pieces = M.mix(make_docs(rows), block=32)
    need = {r["sid"]: r["need"] for r in sources.collect()}
    total = sum(need.values())
    order = [r["sid"] for r in pieces.select("position", "sid").distinct().orderBy("position").collect()]
    seen = collections.Counter()
    for k, sid in enumerate(order, 1):
        seen[sid] += 1
        assert all(abs(seen[s] - k * n / total) < 12 for s, n in need.items())


def test_pieces_tile_the_stream(make_docs):
    rows = [(i, "w " * (5 + 7 * i % 90), f"s{i % 3}") for i in range(80)]
    _, sources, pieces = M.mix(make_docs(rows), block=50)
    goals = {r["sid"]: r["goal"] for r in sources.collect()}
    ends = collections.defaultdict(int)
    for r in pieces.orderBy("sid", "stream_word").collect():
        assert r["stream_word"] == ends[r["sid"]]
        ends[r["sid"]] += r["n_words"]
    assert ends == {s: g for s, g in goals.items() if g}


def test_mixed_documents_repeat_whole_rows(make_docs):
    rows = [(i, f"w{i} " * 40, "a" if i < 10 else "b") for i in range(60)]
    df = make_docs(rows)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    copies = collections.Counter(r["doc_id"] for r in out.collect())
    report = {r["id"]: r["taken"] / r["size"] for r in M.mix_report(df).collect()}
    assert all(copies[k] in (int(v), int(v) + 1) for k, v in report.items())


def check_pack(rows, result, lengths=P.LENGTHS):
    bins = collections.defaultdict(list)
    for r in result:
        bins[r["bin_id"]].append(r)
    for members in bins.values():
        length = members[0]["bin_length"]
        used = sum(r["n_words"] for r in members)
        assert {r["bin_length"] for r in members} == {length} and length == min(c for c in lengths if c >= used)
        at = 0
        for r in sorted(members, key=lambda r: (r["bin_offset"], r["n_words"])):
            assert r["bin_offset"] == at
            at += r["n_words"]
    got = collections.Counter((r["id"], r["n_words"]) for r in result)
    expected = collections.Counter()
    for key, text, *_ in rows:
        n = len(words(text))
        for at in range(0, max(n, 1), max(lengths)):
            expected[key, min(max(lengths), n - at)] += 1
    assert got == expected


def test_pack_covers_every_word_once(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    result = P.pack(docs).collect()
    check_pack(rows, result)
    check_pack(rows, P.pack(docs, lengths=(64, 200), group_pieces=50).collect(), (64, 200))
    filled = sum(r["n_words"] for r in result) / sum({r["bin_id"]: r["bin_length"] for r in result}.values())
    assert filled > 0.95
    check_pack(AWKWARD, P.pack(make_docs(AWKWARD)).collect())
    assert P.pack(make_docs([])).collect() == []


def test_pack_group_against_all_partitions():
    """Small cases against the cheapest of all ways to split the pieces into bins."""
    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield rest[:i] + [[items[0], *rest[i]]] + rest[i + 1:]

    lengths, overhead = (4, 8, 12), 1
    for sizes in ([12, 3], [8, 8, 4, 4], [5, 4, 3, 2], [7, 5, 5, 3, 2, 1], [6, 6, 6], [1], [2, 2, 2, 2, 2, 2], [0, 0]):
        for attention in (16, 10**9):
            price = lambda c: P.sequence_cost(c, overhead, attention)  # noqa: E731,B023
            packed = P.pack_group(sizes, lengths, overhead, attention)
            assert sorted(i for _, m in packed for i in m) == list(range(len(sizes)))
            cost = sum(price(c) for c, _ in packed)
            best = min(sum(price(min(c for c in lengths if c >= sum(b))) for b in way) for way in partitions(sizes) if all(sum(b) <= 12 for b in way))
            assert best <= cost * (1 + 1e-9) and cost <= 1.25 * best


def test_lengths_compete():
    """Trials differ, bins use several lengths, and the joint choice is cheaper than any single length."""
    rng = random.Random(2)
    sizes = sorted((min(4096, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(3000)), reverse=True)
    costs = {c: P.sequence_cost(c) for c in P.LENGTHS}
    trials = {tuple(map(tuple, P._one_trial(sizes, some, costs))) for some in [P.LENGTHS, P.LENGTHS[1:], (4096,), (512, 4096)]}
    assert len(trials) == 4
    packed = P.pack_group(sizes, P.LENGTHS, P.OVERHEAD)
    assert len({c for c, _ in packed}) == 4
    cost = sum(costs[c] for c, _ in packed)
    single = len(P._one_trial(sizes, (4096,), costs)) * costs[4096]
    assert cost < 0.9 * single
    words_held = sum(sizes)
    assert words_held / sum(c for c, _ in packed) > 0.95


def test_ties_between_lengths_and_empty_pieces():
    assert P.pack_group([0, 0, 0], (4, 8), 1) == [(4, [0, 1, 2])]
    assert P.pack_group([], (4, 8), 1) == []
    assert P._beside([-9, -5, -5, -2, 0], [21, 12, 7, 2, 0], 1, 8) == 7 and P._beside([-9, -5], [14, 5], 0, 4) == 0
    assert [c for c, _ in P.pack_group([4, 4], (4, 8), 0, 10**12)] in ([8], [4, 4])
