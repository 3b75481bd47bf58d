"""Merkle manifest: against SQL, against trees built whole in plain Python, awkward rows, several tiers."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from funnelspark.llm import merkle as M


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, place):
    for level in tree[:-1]:
        run = level[place // 3 * 3:place // 3 * 3 + 3]
        yield "".join(run[:place % 3]), "".join(run[place % 3 + 1:])
        place //= 3


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, text, source), whole trees in memory."""
    groups = {}
    for k, text, source in rows:
        size = None if text is None else len(text)
        own = leaf(k, source, None, size, text)
        odd = k is None or zlib.crc32(str(k).encode()) % 2
        groups.setdefault(source, []).append((k is not None, k or 0, own, own if odd else leaf(k, source, None, size, text and text.replace("\n", ""))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for place, (real, k, own, now) in enumerate(sorted(groups[s])):
            steps = [*siblings(trees[s], place), *siblings(top, at)]
            for left, right in steps:
                now = digest(left + now + right)
            out.append((k if real else None, own, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), now))
    return sorted(out, key=repr)


def manifest(docs, folder):
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return M.manifest(docs, str(folder), tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=even)


def outcome(rows):
    return sorted(((r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows), key=repr)


AWKWARD = [(1, None, None), (2, "", "b"), (3, "a\nb", "a"), (3, "a\nb", "a"), (3, "z\n", "a"), (None, "x\ny", "a"), (None, None, "a"),
           (5, "é\n" * 9, "Z"), (6, "w\n" * 9000, "b"), (7, "\n", ""), (8, "-", "-"), (-4, "neg\n", "a")]


def test_awkward_rows(make_docs, tmp_path):
    rows = manifest(make_docs(AWKWARD), tmp_path).collect()
    assert outcome(rows) == plain(AWKWARD)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)


@pytest.mark.parametrize("rows", [[], [(9, "one\nleaf", "a")], [(k, "same\n", "a") for k in (4, 4, 4, 4)]])
def test_small_tables(make_docs, tmp_path, rows):
    assert outcome(manifest(make_docs(rows), tmp_path).collect()) == plain(rows)


def test_several_tiers_and_many_groups(make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "DEPTH", 2)
    monkeypatch.setattr(M, "BLOCK", 9)  # 200 rows of one source: three tiers; 30 sources: two
    rows = [(k, f"line\n{k % 7}", "hot" if k % 3 else f"s{k % 90}") for k in range(300)]
    got = manifest(make_docs(rows), tmp_path).cache()
    assert outcome(got.collect()) == plain(rows)
    # a version shares all nodes but its leaf's ancestors
    version = got.filter("path is not null and g = '=hot'").orderBy("idx").collect()[7]
    hot = sorted((k, own) for k, own, sub, *_ in plain(rows) if sub == version["subroot"])
    leaves = [own for _, own in hot]
    base, copy = levels(leaves), levels([version["tampered_leaf"] if i == version["idx"] else x for i, x in enumerate(leaves)])
    for level, nodes in enumerate(copy):
        for place, node in enumerate(nodes):
            assert (M.node_in_version(got, version["key"], level, place) or base[level][place]) == node if place in (0, version["idx"] // 3**level) else True
    changed = sum(a != b for x, y in zip(base, copy) for a, b in zip(x, y))
    assert changed == len(base) and len(version["path"]) == len(base) - 1 + len(levels(["x"] * 31)) - 1
    with pytest.raises(KeyError):
        M.node_in_version(got, 10**9, 0, 0)


def test_numbering_splits_a_hot_group(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.lit(1).alias("key"))
    got = M.numbered_rows(rows, str(tmp_path / "n"), ["key"], range_rows=100).groupBy("g").agg(
        F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max("n").alias("n")).collect()
    assert {r["g"]: (r["d"], r["lo"], r["hi"], r["n"]) for r in got} == {"a": (1667, 0, 1666, 1667), "b": (3333, 0, 3332, 3333)}
