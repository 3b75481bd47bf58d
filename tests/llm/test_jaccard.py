"""The join against brute force over all pairs, on planted near copies and on awkward rows."""

import random

import numpy as np
import pytest
import xxhash

from funnelspark.llm import jaccard_join as J
from plain import LOWER, words


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """[(id, size, smallest id reachable)] in the order of rows."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    best = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None:
            best[r] = min(best.get(r, key), key)
    return sorted(((key, len(sets[i]), best.get(find(i))) for i, (key, _) in enumerate(rows)), key=repr)


def run(df):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in J.class_report(df).collect()), key=repr)


def planted(seed, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 100
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 5, 6, 9, 14, 23, 40, 80, 200)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 16 + 1))):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)])) or w[at:at + 1]
            text = " ".join(w)
            rows.append((key, text.upper() if rng.random() < 0.2 else text if g % 3 else passage + " " + text))
            key += rng.randrange(1, 5)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_match_brute_force(make_docs, seed):
    rows = planted(seed)
    assert run(make_docs(rows)) == brute(rows)


def test_awkward_rows(make_docs):
    long = " ".join(f"t{i % 977}x{i}" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (9, "one two three"), (8, "ONE two  three"), (4, "one two"), (11, long), (12, long + " end"),
            (13, "same text of more than five words here"), (13, "same text of more than five words here"),
            (20, "a repeated id with one text of its own"), (20, "a repeated id with quite another text than that"),
            (None, "a row without id but with some text in it"), (3, "a row without id but with some text in it")]
    assert run(make_docs(rows)) == brute(rows)


def test_empty_table(make_docs):
    assert run(make_docs([])) == []
    assert J.one_of_each(make_docs([])).count() == 0


def test_one_of_each_keeps_columns_and_clean_rows(make_docs):
    rows = planted(4)
    df = make_docs(rows)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    expected = {c for _, _, c in brute(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    twice = J.one_of_each(make_docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, "")]))
    assert sorted(r["doc_id"] for r in twice.collect()) == [1, 3, 4]


def test_large_group_of_near_copies(make_docs):
    """Copies whose mutual similarity straddles the threshold: classes must still be exact."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((1000 - k, " ".join(w)))
    assert run(make_docs(rows)) == brute(rows)


def partners(rows):
    """[(id, number of other documents at the threshold)]; equal id and text are one document."""
    docs = list(dict.fromkeys((key, text or "") for key, text in rows))
    sets = [shingle_set(t) for _, t in docs]
    n = [sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) if a else 0 for i, a in enumerate(sets)]
    found = dict(zip(docs, n, strict=True))
    return sorted(((key, found[key, text or ""]) for key, text in rows), key=repr)


def test_links_are_counted_inside_classes(make_docs):
    """Chains and groups of copies around the threshold, equal texts, equal sizes, repeated rows and ids."""
    rng = random.Random(9)
    rows = planted(5, groups=8) + [(9000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 40))) for i in range(9)]
    base = [f"b{i}" for i in range(90)]
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(90)] = f"n{rng.randrange(40)}"
        rows.append((20_000 - k, " ".join(w)))
    rows += [(30_000, rows[-1][1]), (30_001, rows[-1][1]), (30_001, rows[-1][1]), (None, rows[-2][1]), (30_002, None), (30_003, ""), (9000, "one text more")]
    got = J.class_report(make_docs(rows)).select("id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == partners(rows)


def test_sets_no_cut_suits_at_once(make_docs, monkeypatch):
    """With few spare segments every cut leaves some sets short: only these ask in another cut."""
    monkeypatch.setattr(J, "SPARE", 1.0)
    monkeypatch.setattr(J, "SPARE_LEAST", 2)
    monkeypatch.setattr(J, "SMALL_SET", 1)
    rng = random.Random(6)
    rows = []
    for n in (50, 60, 71, 72, 73, 75, 90, 110, 128):
        base = [f"v{rng.randrange(5000)}" for _ in range(n + 4)]
        for k in range(30):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((1000 * n + k, " ".join(w)))
    df = make_docs(rows)
    join = J.JaccardJoin(df)
    assert not join._short(join._cut(join.singles, 0, None), 0).isEmpty()
    assert run(df) == brute(rows)


def test_pigeonhole_holds_for_every_pair():
    """Without Spark: every similar pair shares an asked signature, small and deficient sets included."""
    rng = np.random.default_rng(0)
    for seed in range(3):
        signer = J.Signer(75, seed)
        for n in (1, 2, 3, 4, 5, 7, 8, 12, 13, 23, 24, 40, 73, 74, 150):
            for _ in range(20):
                big = rng.integers(-(2**62), 2**62, n)
                most = J.most_apart(n, 75)
                drop = rng.integers(0, most + 1)
                y = np.concatenate([big[drop:], rng.integers(-(2**62), 2**62, rng.integers(0, most - drop + 1))])
                common = n - drop
                if len(y) > n or 100 * common < 75 * (n + len(y) - common):
                    continue
                out = signer.sign(np.array([1, 2]), np.array([n, len(y)]), np.concatenate([big, y]))
                x_total, x_cover = out["total"][0], out["cover"][0]
                need = most + 1
                assert x_cover >= need or x_total < need
                if x_cover < need:
                    continue  # the universe is cut anew for such a set
                index = {s for s, w, k in zip(out["sig"], out["who"], out["kind"], strict=True) if w == 1 and k in (J.OWN, J.BELOW, J.OWN_LESS, J.BELOW_LESS)}
                asked = [s for s, w, k in zip(out["sig"], out["who"], out["kind"], strict=True) if w == 0 and k in (J.OWN, J.ASK_LESS)]
                shared = sum(s in index for s in asked)
                assert shared > 0
                if x_total >= need:  # whatever is left out, any need of them meet the partner
                    assert x_total - sum(s in index for s, k in zip(asked, [J.OWN] * len(asked), strict=False)) < need


def test_registered_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = J.op1_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_texts_that_agree_in_one_hash_are_not_merged(make_docs):
    join = J.JaccardJoin(make_docs([(k, f"text {k}") for k in range(50)]))
    rows = join.spark.read.parquet(f"{join.folder}/hashed").collect()
    follows = [xxhash.xxh64((1).to_bytes(4, "little"), seed=r["h1"] % 2**64).intdigest() for r in rows]  # what a chained hash would be
    assert all(f != r["h2"] % 2**64 for f, r in zip(follows, rows)) and len({r["h2"] for r in rows}) == 50
