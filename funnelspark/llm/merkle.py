"""Merkle manifest of a dataset, as a persistent tree whose versions copy only a path.

A row's leaf is the SHA-256 of its fields; the leaves of a group ascend by key and every ``FAN``
consecutive nodes become one until one is left, the subroot; the subroots, ordered by group, become
the root in the same way.

The tree is kept in aligned blocks of ``BLOCK = FAN**DEPTH`` consecutive nodes.  A task builds one block
and hands up only its top node; the tops are nodes of the next tier, which is built in blocks again, so
no task sees more than ``BLOCK`` nodes however many rows a group has.  Each tampered leaf creates a
version of its own: it shares every untouched node with the base tree, which it names by position, and
holds copies of its leaf's ancestors only (``path``).  Inside the leaf's block the copies are made from
the block's nodes; the tiers above reach a block as one short list of neighbours (left, right) per
level, joined by block, and the version goes on from there to the root.  ``node_in_version`` reads any node
of any version.

Rows are numbered without gathering a group: they are dealt by ranges of (group, key, leaf), and a row's
place is its place in its range plus the rows of its group in earlier ranges.

Defined cases: a null field is ``-``; null keys come first and are never tampered with; rows with equal keys
are leaves of their own, by leaf digest; a null group is a group of its own and comes first; a group of one row
has its leaf as subroot, a single group's subroot is the root; a leaf without any neighbour has the proof of
the empty string; a version whose leaf is unchanged verifies; an empty table has no rows and no root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.llm.common import checked_small, shared_dir, stored

FAN = 3
DEPTH = 6
BLOCK = FAN**DEPTH
#: Rows of a range when rows are numbered.
RANGE_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ORDINAL = (1 << 33) - 1  # monotonically_increasing_id: partition above, ordinal below
_SIDES = "array<struct<l:string,r:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields one after another, each ``-`` or ``<UTF-8 bytes>:<value>``."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.encode(F.concat(*[part(c) for c in fields]), "UTF-8"), 256)


def numbered_rows(rows: DataFrame, folder: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (with a group ``g`` that is never null) plus ``idx``, from 0 within the group in ``order``, and the
    group's ``n``.  Rows that agree in ``order`` are numbered in the order they were written in."""
    rows = stored(rows.withColumn("seq", F.monotonically_increasing_id()), f"{folder}/rows")
    session = rows.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    by = ["g", *order, "seq"]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged.drop("seq"), f"{folder}/ranged")
    pid, ordinal = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_ORDINAL))
    spans = ranged.groupBy("g", pid.alias("pid")).agg(F.min(ordinal).alias("low"), F.count("*").alias("c"))
    group = Window.partitionBy("g")  # at most one row per range
    before = group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("g", "pid", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("c").over(group).alias("n"))
    spans = stored(spans, f"{folder}/spans")
    return (ranged.withColumn("pid", pid).join(checked_small(spans), ["g", "pid"])
            .withColumn("idx", ordinal + F.col("shift")).drop("pid", "at", "shift"))


def _levels(n: int) -> int:
    """Levels from ``n`` nodes up to one, a block's depth at most."""
    k = 0
    while n > 1 and k < DEPTH:
        n, k = -(-n // FAN), k + 1
    return k


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _climb(nodes: list[str], up: int) -> list[list[str]]:
    """The levels of a block, its own nodes first, its top last."""
    levels = [nodes]
    for _ in range(up):
        low = levels[-1]
        levels.append([_digest("".join(low[i:i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def _neighbours(level: list[str]) -> list[tuple[str, str]]:
    """For each node of a level, what stands left and right of it in its run."""
    out = []
    for i in range(0, len(level), FAN):
        run = level[i:i + FAN]
        out += [("".join(run[:j]), "".join(run[j + 1:])) for j in range(len(run))]
    return out


def _block_tops(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("idx")
    n, block = int(nodes["n"].iloc[0]), int(nodes["idx"].iloc[0]) // BLOCK
    top = _climb(list(nodes["digest"]), _levels(n))[-1][0]
    return pd.DataFrame({"g": [nodes["g"].iloc[0]], "idx": [block], "n": [-(-n // BLOCK)], "digest": [top]})


def _lift_block(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("idx")
    n, block = int(nodes["n"].iloc[0]), int(nodes["idx"].iloc[0]) // BLOCK
    levels = _climb(list(nodes["digest"]), _levels(n))
    beside = [_neighbours(level) for level in levels[:-1]]
    sides = [[dict(zip("lr", beside[k][j // FAN**k])) for k in range(len(beside))] for j in range(len(nodes))]
    return pd.DataFrame({"g": nodes["g"], "idx": nodes["idx"], "above": block, "n_above": -(-n // BLOCK),
                         "top": levels[-1][0], "sides": sides})


def _by_block(nodes: DataFrame):
    return nodes.groupBy("g", F.floor(F.col("idx") / BLOCK).alias("block"))


def lift(units: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """From nodes (g, idx, n, digest), tier by tier to one node per group: (g, idx, sides), with a pair of
    neighbours per level from the node's own to the last before the group's top, and the tops (g, digest)."""
    tiers, tops = [], [units.filter("n = 1").select("g", "digest")]
    start = units
    while (units.agg(F.max("n")).first()[0] or 0) > 1:
        tier = _by_block(units.filter("n > 1")).applyInPandas(
            _lift_block, f"g string, idx long, above long, n_above long, top string, sides {_SIDES}")
        tier = stored(tier, f"{folder}/tier{len(tiers)}")
        tiers.append(tier)
        units = tier.filter(F.col("idx") % BLOCK == 0).select("g", F.col("above").alias("idx"), F.col("n_above").alias("n"), F.col("top").alias("digest"))
        tops.append(units.filter("n = 1").select("g", "digest"))
    none = F.array().cast(_SIDES)
    sides = None
    for tier in reversed(tiers):
        if sides is None:
            sides = tier.select("g", "idx", "sides")
        else:
            more = sides.select("g", F.col("idx").alias("above"), F.col("sides").alias("more"))
            sides = tier.join(more, ["g", "above"], "left").select("g", "idx", F.concat("sides", F.coalesce("more", none)).alias("sides"))
    alone = start.filter("n = 1").select("g", "idx", none.alias("sides"))
    sides = alone if sides is None else sides.unionByName(alone)
    every = tops[0]
    for more in tops[1:]:
        every = every.unionByName(more)
    return stored(sides, f"{folder}/sides"), stored(every, f"{folder}/tops")


def _finish(leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Proof, fold and copied path of every leaf of a block; ``block`` is the block's one row."""
    leaves = leaves.sort_values("idx")
    above = [(s["l"], s["r"]) for s in block["sides"].iloc[0]]
    last = "".join(left + right for left, right in above)
    levels = _climb(list(leaves["digest"]), _levels(int(leaves["n"].iloc[0])))
    beside = [_neighbours(level) for level in levels[:-1]]
    proofs, folded, paths = [], [], []
    for j, (leaf, tampered) in enumerate(zip(leaves["digest"], leaves["tampered"])):
        steps = [beside[k][j // FAN**k] for k in range(len(beside))]
        proofs.append(_digest("".join(left + right for left, right in steps) + last))
        now, path = (leaf if tampered is None else tampered), []
        for left, right in steps + above:
            now = _digest(left + now + right)
            path.append(now)
        folded.append(now)
        paths.append(None if tampered is None else path)
    root = block["root"].iloc[0]
    return pd.DataFrame({"key": leaves["key"], "g": leaves["g"], "idx": leaves["idx"], "n": leaves["n"], "leaf": leaves["digest"],
                         "tampered_leaf": leaves["tampered"], "subroot": block["subroot"].iloc[0], "root": root,
                         "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded], "path": paths})


def manifest(docs: DataFrame, folder: str, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
             tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: key, g, idx, n, leaf, tampered_leaf, subroot, root, proof_sha256, folded_root,
    verified, path.

    ``g`` is ``-`` for the null group, else ``=`` and the group.  Where ``when`` holds the row is tampered with:
    the fields of ``tampered`` are replaced, which creates a version; ``path`` then holds its copied
    ancestors from the leaf's parent to the root (else null).
    """
    original = [F.col(f"`{c}`") for c in fields]
    name = F.col(f"`{group}`").cast("string")
    changed = F.lit(None).cast("string")
    if when is not None:
        changed = F.when(when, leaf_digest([(tampered or {}).get(c, F.col(f"`{c}`")) for c in fields]))
    leaves = docs.select(F.col(f"`{key}`").alias("key"), F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("g"),
                         leaf_digest(original).alias("digest"), changed.alias("tampered"))
    leaves = stored(numbered_rows(leaves, f"{folder}/leaves", ["key", "digest"]), f"{folder}/numbered")
    nodes = leaves.select("g", "idx", "n", "digest")
    blocks = stored(_by_block(nodes).applyInPandas(_block_tops, "g string, idx long, n long, digest string"), f"{folder}/blocks")
    sides, subroots = lift(blocks, f"{folder}/groups")
    # the groups are the leaves of the last tree
    tree = numbered_rows(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), f"{folder}/subroots", ["name"])
    tree = stored(tree, f"{folder}/dataset")
    blocks = _by_block(tree.select("g", "idx", "n", "digest")).applyInPandas(_block_tops, "g string, idx long, n long, digest string")
    upper, top = lift(stored(blocks, f"{folder}/dataset-blocks"), f"{folder}/dataset-tiers")
    root = top.first()
    inner = _by_block(tree.select("g", "idx", "n", "digest")).applyInPandas(
        _lift_block, f"g string, idx long, above long, n_above long, top string, sides {_SIDES}")
    inner = inner.join(upper.select(F.col("idx").alias("above"), F.col("sides").alias("more")), "above")
    groups = tree.join(inner.select("idx", F.concat("sides", "more").alias("more")), "idx").select(
        F.col("name").alias("g"), F.col("digest").alias("subroot"), "more")
    groups = stored(groups, f"{folder}/group-sides")
    blocks = sides.join(checked_small(groups), "g").select(
        "g", F.col("idx").alias("block"), F.concat("sides", "more").alias("sides"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"))
    kind = leaves.schema["key"].dataType.simpleString()
    return (_by_block(leaves).cogroup(blocks.groupBy("g", "block")).applyInPandas(
        _finish, f"key {kind}, g string, idx long, n long, leaf string, tampered_leaf string, subroot string, root string, "
                 "proof_sha256 string, folded_root string, verified boolean, path array<string>"))


def node_in_version(rows: DataFrame, version_key: object, level: int, place: int) -> str | None:
    """Digest, in the version made by the leaf ``version_key``, of the node ``place`` of ``level`` above the leaves
    of that leaf's group: the copy if it is an ancestor, else None, which says that the base tree's node is shared."""
    row = rows.filter((F.col("key") == F.lit(version_key)) & F.col("path").isNotNull()).first()
    if row is None:
        raise KeyError(version_key)
    if place != row["idx"] // FAN**level:
        return None
    return row["tampered_leaf"] if level == 0 else row["path"][level - 1]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; where 2 divides crc32(doc_id) the text's line feeds are taken out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    rows = manifest(docs, shared_dir(spark), tampered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, when=even)
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP11_SQL = """
WITH RECURSIVE
t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
      FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, row_number() OVER () AS rid, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
        lambda c, b: xor(list_extract(t.crc, (xor(c, b) % 256 + 1)::BIGINT), c // 256)), 4294967295) % 2 = 0 AS even
  FROM documents, t),
e AS (
  SELECT doc_id, rid, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN even THEN sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) END AS tampered
  FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM e),
nodes AS (
  SELECT g, 0 AS lvl, idx, n, leaf AS h FROM l
  UNION ALL
  SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 3, n),
sides AS (
  SELECT g, lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1),
top_sides AS (
  SELECT lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY tier, lvl) AS k, l, r FROM (
    SELECT l.rid, 0 AS tier, x.lvl, x.l, x.r FROM l JOIN sides x ON l.g = x.g AND x.idx = l.idx // (3 ** x.lvl)::BIGINT
    UNION ALL
    SELECT l.rid, 1, x.lvl, x.l, x.r FROM l JOIN s ON l.g = s.g JOIN top_sides x ON x.idx = s.idx // (3 ** x.lvl)::BIGINT)),
proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS p FROM steps GROUP BY rid),
fold AS (
  SELECT rid, 0 AS k, coalesce(tampered, leaf) AS h FROM l
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(x.l || f.h || x.r) FROM fold f JOIN steps x ON x.rid = f.rid AND x.k = f.k + 1),
folded AS (SELECT rid, max_by(h, k) AS h FROM fold GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(p.p, '')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM l JOIN s ON l.g = s.g JOIN folded f ON f.rid = l.rid LEFT JOIN proofs p ON p.rid = l.rid
"""
