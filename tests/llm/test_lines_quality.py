"""Line de-duplication and quality rules against plain Python."""

import collections
import hashlib
import math
import random

import pytest
import xxhash

from funnelspark.llm import line_dedup as L
from funnelspark.llm import quality_rules as Q
from plain import line_key, words


def brute_lines(rows, least=40, docs=5):
    holders = collections.defaultdict(list)
    for r, (key, text) in enumerate(rows):
        for k in {line_key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders[k].append((-(2**63) if key is None else key, r))
    gone = {k: max(h)[0] for k, h in holders.items() if len(h) >= docs}
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        own = -(2**63) if key is None else key
        kept = [x for x in lines if not (line_key(x) in gone and own < gone[line_key(x)])]
        out.append((key, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run_lines(df, **options):
    from pyspark.sql import functions as F
    out = L.dedup_documents(df, **options)
    assert out.columns[:len(df.columns)] == df.columns
    rows = out.select("doc_id", "_lines", "_dropped", F.sha2(F.encode("_kept", "UTF-8"), 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def line_rows(seed):
    rng = random.Random(seed)
    common = [f"Common line number {i} that is long enough to count é" for i in range(8)] + ["short line"]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()} of document {i} which is long" for _ in range(rng.randrange(0, 9))]
        lines = [x.upper() if rng.random() < 0.2 and "é" not in x else f" \t{x}\r" if rng.random() < 0.2 else x for x in lines]
        rows.append((rng.randrange(-50, 500) * 2, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("batch_docs", "fanout"), [(1000, 2), (1000, 4), (6, 2)])
def test_lines_match_brute_force_for_any_batches(make_docs, monkeypatch, batch_docs, fanout):
    compacted = []
    whole = L.LineRuns.compact
    monkeypatch.setattr(L.LineRuns, "compact", lambda self, level: (compacted.append(level), whole(self, level)))
    rows = [(k, t) for k, t in {k: t for k, t in line_rows(batch_docs)}.items()]
    assert run_lines(make_docs(rows), batch_docs=batch_docs, fanout=fanout) == brute_lines(rows)
    assert compacted and (fanout > 2 or max(compacted) > 0)  # runs are compacted, over several levels if the fan-out is small


def test_batches_of_far_off_and_missing_ids(spark, make_docs):
    rows = [(k, f"text {k}") for k in range(400)] + [(2**60, "far"), (None, "x"), (None, "y")]
    edges = L._edges(make_docs(rows).selectExpr(f"coalesce(doc_id, {-2**63}) id"), 50)
    sizes = [sum(lo < (-2**63 if k is None else k) <= hi for k, _ in rows) for lo, hi in zip([-2**64, *edges], [*edges, 2**62], strict=True)]
    assert len(sizes) == 9 and max(sizes) < 100


def test_documents_without_ids_meet_in_no_list(make_docs):
    line = "a line of more than forty characters, which several documents hold"
    rows = [(None, f"{line} {i % 3}\nown {i}") for i in range(60)] + [(7, f"{line} {i}") for i in range(3)]
    assert run_lines(make_docs(rows)) == brute_lines(rows)
    lines = L.keyed_lines(make_docs(rows), "doc_id", "text")
    assert lines.select("id", "text_hash").distinct().count() == 63


def test_lines_of_awkward_rows(make_docs):
    line = "a line of more than forty characters, which several documents hold"
    rows = [(i, f"{line}\n{line}\nrest {i}\n\n") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "\n"), (None, line), (3, line + "\nanother text of a repeated id"), (13, "x\n" * 5000 + line)]
    assert run_lines(make_docs(rows)) == brute_lines(rows)


def test_lines_of_empty_table(make_docs):
    assert run_lines(make_docs([])) == []


def brute_quality(rows, good, threshold=Q.THRESHOLD, buckets=Q.BUCKETS):
    def bucket(*parts):
        hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        h = hashes[0]
        if len(hashes) > 1:
            h = 42
            for x in hashes:
                h = xxhash.xxh64(x.to_bytes(8, "little"), seed=h).intdigest()
        return (h - (1 << 64) if h >= 1 << 63 else h) % buckets

    def grams(text):
        w = words(text)
        return [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:], strict=False)]

    raw, target = collections.Counter(), collections.Counter()
    for key, text in rows:
        raw.update(grams(text))
        if key in good:
            target.update(grams(text))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    shift = math.log(n_raw + buckets) - math.log(n_target + buckets)
    weight = lambda b: round(Q.SCALE * (math.log(target[b] + 1) - math.log(raw[b] + 1) + shift)) if n_target else 0
    out = []
    for key, text in rows:
        text = text or ""
        w = words(text)
        windows = collections.defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i:i + 5])].append(i)
        covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        g = grams(text)
        kept = not base and sum(map(weight, g)) >= round(threshold * Q.SCALE) * len(g)
        out.append((key, len(w), sum(map(len, w)), sum(text.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered), base, kept))
    return sorted(out, key=repr)


def run_quality(docs, labels):
    judged = Q.score_documents(docs, Q.learn_weights(docs, labels))
    rows = judged.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", "_q.kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_quality_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    rows = [tuple(r) for r in docs.collect()]
    got = Q.op7_quality_rules(spark, sf_dir).drop("score").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_quality(rows, good)


def test_quality_of_awkward_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e " * 4), (6, "a b c d e f g h i j k l m n a b c d e"), (7, "x y z w v " * 3000),
            (8, "a\na\n \n \nA\na #$%"), (9, " ".join(f"w{i}" for i in range(30_000))), (5, "another text of a repeated id with enough words in it"),
            (None, "a row without an id but with more than ten words in its text")]
    labels = spark.createDataFrame([(6, 1), (6, 1), (9, 1), (None, 1), (4, 0), (77, 1)], "doc_id long, quality int")
    assert run_quality(make_docs(rows), labels) == brute_quality(rows, {6, 9})
    assert run_quality(make_docs(rows), labels.limit(0)) == brute_quality(rows, set())
    assert run_quality(make_docs([]), labels) == []


def test_quality_filter_keeps_columns(spark, make_docs):
    rows = [(1, " ".join(f"good{i}" for i in range(40))), (2, "bad")]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    df = make_docs(rows)
    kept = Q.quality_filter(df, labels)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
