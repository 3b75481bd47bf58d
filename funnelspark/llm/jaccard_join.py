"""Exact Jaccard self-join of documents on word n-gram sets, and its connected classes.

Method: universe partition with the pigeonhole principle.

* A document's set holds the 64-bit hashes of its distinct word n-grams.  Sizes fall into bands that
  grow by 1/threshold squared, so a set's smaller partners are in its own band or the one below.
* Two sets of at least the threshold differ in at most H = floor(2 n (1-t)/(1+t)) tokens, n the larger
  size.  A band hashes all possible tokens into m > H + 1 segments.  Whatever segments of the larger
  set are chosen, if their thresholds t_i (0: equal, 1: one token apart) sum up to sum(t_i + 1) >= H + 1,
  the partner meets one of them.
* Index: every set enters the hash of each of its segments, in its own band and, if it can be the
  smaller partner of a larger band, there too.  Sets of small bands also enter the one-deletion
  neighbourhoods of their segments.
* Cost-based allocation: a segment's cost is the number of sets that hold it.  A segment nobody else
  holds costs nothing, and a set with H + 1 of these has no smaller partner and is done.  The others
  take the cheapest segments until the sum is reached.  A set whose tokens lie in too few segments
  takes one-deletion thresholds too; if even that can't reach the sum, it asks in another cut of the
  universe, which the sets of its partners' sizes enter, so no set is ever left out.
* Candidates are verified exactly on the sets.

Equal texts are merged first.  Candidates are not expanded inside large groups: each set is first
verified against one centre; then sets are compared with whole blocks of sets that share a signature
they ask.  Every pair of different texts is so verified where its larger set asks (equal sizes: the
larger id), and counted for both; pairs themselves are no rows.  Where only classes are wanted, blocks
whose class is the set's own are left out: every link between different classes is still found.

Defined cases: null and empty texts have empty sets and are linked with nothing; with fewer words than
n the whole sequence is one shingle; rows with equal ids and texts are one document, rows with equal
(or null) ids and different texts are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.llm.common import checked_small, hash_at, lower_ascii, shared_dir, stored, whole_row, word_hashes, words
from funnelspark.llm.components import components

NGRAM = 5
PERCENT = 75
#: Bands up to this set size also index one-deletion neighbourhoods.
SMALL_SET = 64
#: Segments beyond H + 1, relative and absolute: room to leave costly and empty ones out.
SPARE, SPARE_LEAST = 1.25, 12
#: Cuts of the universe a set is tried in; each but the first holds only what the cut before didn't suit.
CUTS = 16
#: Tokens handled at once inside a task.
SLICE_TOKENS = 200_000
#: Sets in a block, sets compared with a block at once, rows of one Python call.
BLOCK_SETS, BLOCK_ASKS, BIN_ROWS = 512, 2_000, 5_000
OWN, BELOW, OWN_LESS, BELOW_LESS, ASK_LESS, HEAD = range(6)
SIGNATURES = "sig long, node long, kind tinyint, head struct<n:int,total:int,cover:int>"


def shingles(h: Column, n: int = NGRAM) -> Column:
    """Distinct hashes of the n-grams of the words with hashes ``h`` (a stored column)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: hash_at(h, i, n))
    return (F.when(F.size(h) >= n, F.array_distinct(grams)).when(F.size(h) > 0, F.array(F.xxhash64(h, F.size(h))))
            .otherwise(F.array().cast("array<long>")))


def most_apart(n, percent: int):
    """Most tokens by which a partner of at most ``n`` tokens can differ from a set of ``n``."""
    return 2 * n * (100 - percent) // (100 + percent)


def band_edges(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each band; a partner of the first size of a band is at most one band below."""
    edges, ratio = [1], (100 / percent) ** 2
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return edges


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Signatures of sets; plain numpy, one slice of documents at a time."""

    def __init__(self, percent: int = PERCENT, seed: int = 0):
        self.percent, self.seed = percent, np.uint64(seed * 2 + 1)
        edges = band_edges(percent)
        self.first = np.array(edges, dtype=np.int64)
        apart = [most_apart(e - 1, percent) + 1 for e in edges[1:]]
        self.segments = np.array([max(int(SPARE * h) + 1, h + SPARE_LEAST) for h in apart], dtype=np.int64)

    def sign(self, node: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of SIGNATURES for documents with ``size`` tokens each, laid end to end in ``tokens``."""
        tokens = tokens.view(np.uint64)
        band = np.searchsorted(self.first, size, side="right") - 1
        band[size == 0] = 0
        up = np.minimum(band + 1, len(self.segments) - 1)
        # the smallest partner of a set of the first size of the band above
        lends = (size > 0) & (100 * size >= self.percent * self.first[up])
        owner = np.repeat(np.arange(len(size)), size)
        need = most_apart(size, self.percent) + 1
        parts = []
        own, total, more = self._side(owner, tokens, band, size > 0, OWN, OWN_LESS, parts)
        short = total < need
        if short.any():
            self._deletions(*own, short, ASK_LESS, parts)
        self._side(owner, tokens, up, lends, BELOW, BELOW_LESS, parts)
        sig = np.concatenate([p[0] for p in parts] + [_mix(node.view(np.uint64))])
        who = np.concatenate([p[1] for p in parts] + [np.arange(len(size))])
        kind = np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts] + [np.full(len(size), HEAD, np.int8)])
        # one-deletion thresholds count only where partners index their neighbourhoods
        cover = np.where(short & self._small(band), total + more, total)
        return {"sig": sig.view(np.int64), "who": who, "kind": kind, "n": size, "total": total, "cover": cover}

    def _small(self, band: np.ndarray) -> np.ndarray:
        return self.first[np.minimum(band + 1, len(self.first) - 1)] <= SMALL_SET

    def _side(self, owner, tokens, band, used, kind, kind_less, parts):
        m = np.where(used, self.segments[band], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        keep = used[owner]
        owner, tokens = owner[keep], tokens[keep]
        salt = _mix(band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed)
        segment = ((_mix(tokens ^ salt[owner]) >> np.uint64(16)) % m[owner].astype(np.uint64)).astype(np.int64)
        value = _mix(tokens * np.uint64(0xD6E8FEB86659FD93) + self.seed)
        place = base[owner] + segment
        n_all = int(base[-1])
        count = np.bincount(place, minlength=n_all)
        low = np.bincount(place, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_all).astype(np.uint64)
        high = np.bincount(place, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n_all).astype(np.uint64)
        sums = low + (high << np.uint64(32))  # exact modulo 2**64
        filled = np.flatnonzero(count)
        doc = np.repeat(np.arange(len(m)), m)
        where = _mix(salt[doc] + (np.arange(n_all) - base[doc]).astype(np.uint64))
        parts.append((_mix(sums[filled] ^ where[filled]), doc[filled], kind))
        state = (owner, place, value, sums, count, where)
        small = used & self._small(band)
        if small.any():
            self._deletions(*state, small, kind_less, parts)
        total = np.bincount(doc[filled], minlength=len(m))
        several = np.bincount(doc[filled], weights=(count[filled] > 1), minlength=len(m)).astype(np.int64)
        return state, total, several

    @staticmethod
    def _deletions(owner, place, value, sums, count, where, chosen, kind, parts):
        """Each segment of several tokens with one of them left out."""
        pick = np.flatnonzero(chosen[owner] & (count[place] > 1))
        at = place[pick]
        parts.append((_mix((sums[at] - value[pick]) ^ where[at]), owner[pick], kind))


def signatures(sets: DataFrame, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """SIGNATURES of (node, set); one HEAD row per set, whatever its size."""
    signer = Signer(percent, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("set")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = np.cumsum(size)
            at = 0
            while at < len(node):
                start = ends[at] - size[at]
                stop = max(at + 1, int(np.searchsorted(ends, start + SLICE_TOKENS, side="right")))
                out = signer.sign(node[at:stop], size[at:stop], flat[start:ends[stop - 1]])
                head = out["kind"] == HEAD
                heads = pa.StructArray.from_arrays(
                    [pa.array(out[c][out["who"]].astype(np.int32)) for c in ("n", "total", "cover")], ["n", "total", "cover"], mask=pa.array(~head))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["sig"]), pa.array(node[at:stop][out["who"]]), pa.array(out["kind"]), heads], ["sig", "node", "kind", "head"])
                at = stop

    return sets.mapInArrow(run, SIGNATURES)


def links_between(queries: pd.DataFrame, block: pd.DataFrame, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links (query, member) that connect all classes of which a query and a member of the block are similar
    enough (a spanning forest, so there are fewer than classes); and (set, number) of the documents linked with each, a pair taken where its larger set asks."""
    size = np.array([len(x) for x in block["t_set"]], dtype=np.int64)
    tokens = np.concatenate([np.asarray(x, dtype=np.int64) for x in block["t_set"]]) if len(size) else np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(size)), size)[order]
    node, label, weight = block["t_node"].to_numpy(), block["t_label"].to_numpy(), block["t_weight"].to_numpy()
    held, out, counts = np.zeros(len(size), np.int64), [], []
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for q, q_label, q_weight, q_set in zip(queries["q_node"], queries["q_label"], queries["q_weight"], queries["q_set"], strict=True):
        q_set = np.asarray(q_set, dtype=np.int64)
        first, last = np.searchsorted(tokens, q_set, "left"), np.searchsorted(tokens, q_set, "right")
        span = last - first
        hits = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        common = np.bincount(owner[hits], minlength=len(size))
        good = 100 * common >= percent * (size + len(q_set) - common)
        other = np.flatnonzero(good & (label != q_label))
        _, one = np.unique(label[other], return_index=True)
        for i in other[one]:
            mine, its = root(int(q_label)), root(int(label[i]))
            if mine != its:
                up[its] = mine
                out.append((int(q), int(node[i])))
        less = good & ((size < len(q_set)) | ((size == len(q_set)) & (node < q)))
        if less.any():
            held[less] += q_weight
            counts.append((int(q), int(weight[less].sum())))
    counts += [(int(node[i]), int(held[i])) for i in np.flatnonzero(held)]
    return out, counts


def _no_asker(asks: Column) -> Column:
    """Column ``kind``; sets that don't ask enter their own segments as those of a band below do."""
    kind = F.col("kind")
    return F.when(asks, kind).when(kind == OWN, F.lit(BELOW)).when(kind == OWN_LESS, F.lit(BELOW_LESS)).otherwise(kind).cast("tinyint")


class JaccardJoin:
    """The join over one table; ``classes()`` gives its result, one row per document."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, ngram: int = NGRAM,
                 count: bool = False):
        self.spark, self.percent, self.ngram, self.count = docs.sparkSession, percent, ngram, count
        self.folder = shared_dir(self.spark)
        text = F.coalesce(F.col(text_col), F.lit(""))
        raw = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
        # the constant first: a hash is the seed of the next column's, and behind the text it would follow from h1
        hashed = raw.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        hashed = stored(hashed, f"{self.folder}/hashed")
        odd = hashed.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("id is null or lo != hi").select("id")
        node = F.col("id")
        self.texts = raw.withColumn("h1", F.xxhash64("text"))
        self.repeats = not odd.isEmpty()
        if self.repeats:  # ids that don't tell texts apart: such rows get a hash of id and text, below all ids
            odd = stored(odd.select(F.coalesce("id", F.lit(0)).alias("o"), F.col("id").isNull().alias("none")), f"{self.folder}/odd")
            own = F.shiftrightunsigned(F.xxhash64("id", "h1"), 2) - F.lit(2**62)

            def named(df: DataFrame) -> DataFrame:
                mark = checked_small(odd.withColumn("odd", F.lit(True)))
                df = df.withColumn("o", F.coalesce("id", F.lit(0))).withColumn("none", F.col("id").isNull())
                return df.join(mark, ["o", "none"], "left").withColumn("node", F.when(F.col("odd"), own).otherwise(F.col("id"))).drop("o", "none", "odd")

            hashed, self.texts = named(hashed), named(self.texts)
        else:
            hashed, self.texts = hashed.withColumn("node", node), self.texts.withColumn("node", node)
        reps = hashed.groupBy("h1", "h2").agg(F.min("node").alias("rep"), F.count_distinct("node").alias("copies"))
        self.rows = stored(hashed.join(reps, ["h1", "h2"]).select("id", "node", "rep", "h1", "copies"), f"{self.folder}/rows")
        copies = self.rows.filter("node != rep").select("node").distinct()
        self.singles = self.texts.join(checked_small(copies), "node", "left_anti").select("node", "text")

    def _sets(self, rows: DataFrame) -> DataFrame:
        hashed = rows.select("node", word_hashes(words(lower_ascii(F.col("text")))).alias("h"))
        return hashed.select("node", shingles(F.col("h"), self.ngram).alias("set"))

    def _shared(self) -> DataFrame:
        """Signatures held by several sets, with their number ``cost``, and all HEAD rows.

        Sets that a cut of the universe doesn't suit ask in another one instead, which the sets of the
        sizes of their smaller partners enter, not to ask there themselves.
        """
        found = self._cut(self.singles, 0, None)
        short = self._short(found, 0)
        for seed in range(1, CUTS):
            if short.isEmpty():
                return found
            sizes = short.select(F.explode(F.sequence(F.ceil(F.col("n") * self.percent / 100).cast("int"), "n")).alias("n")).distinct()
            heads = found.filter(F.col("kind") == HEAD).select("node", F.col("head.n").alias("n"))
            near = heads.join(sizes, "n", "left_semi").select("node")
            again = short.select("node").distinct()
            more = self._cut(self.singles.join(near, "node", "left_semi"), seed, again)
            left = found.join(again.withColumn("again", F.lit(True)), "node", "left")
            left = left.filter(F.col("again").isNull() | ~F.col("kind").isin(HEAD, ASK_LESS)).withColumn("kind", _no_asker(F.col("again").isNull())).drop("again")
            found = stored(left.select(more.columns).unionByName(more), f"{self.folder}/both{seed}")
            short = self._short(more, seed)
        if short.isEmpty():
            return found
        raise RuntimeError(f"none of {CUTS} cuts of the universe suits some set")

    def _cut(self, singles: DataFrame, seed: int, askers: DataFrame | None) -> DataFrame:
        """The shared signatures of one cut; only ``askers`` (None: all sets) ask and have HEAD rows."""
        found = signatures(self._sets(singles), self.percent, seed)
        if askers is not None:
            found = found.join(askers.withColumn("asker", F.lit(True)), "node", "left")
            found = found.filter(F.col("asker").isNotNull() | ~F.col("kind").isin(HEAD, ASK_LESS))
            found = found.withColumn("kind", _no_asker(F.col("asker").isNotNull())).select("sig", "node", "kind", "head")
        over = Window.partitionBy("sig")
        found = (found.withColumn("cost", F.count("*").over(over))
                 .withColumn("asked", F.max(F.col("kind").isin(OWN, ASK_LESS)).over(over))
                 .filter((F.col("kind") == HEAD) | ((F.col("cost") > 1) & F.col("asked"))).drop("asked"))
        return stored(found, f"{self.folder}/shared{seed}")

    def _short(self, found: DataFrame, seed: int) -> DataFrame:
        """(node, n) of the sets whose segments can't reach the sum."""
        short = found.filter((F.col("kind") == HEAD) & (F.col("head.n") > 0) & (F.col("head.cover") < self._need("head.n")))
        return stored(short.select("node", "head.n"), f"{self.folder}/short{seed}")

    def _need(self, size: str) -> Column:
        return F.floor(2 * F.col(size) * (100 - self.percent) / F.lit(100 + self.percent)) + 1

    def links(self) -> DataFrame:
        """(a, b): verified links that hold every class together (not all pairs of a class)."""
        shared = self._shared()
        heads = shared.filter(F.col("kind") == HEAD).select("node", "head.n", "head.total").distinct()
        self.heads = heads
        asks = shared.filter(F.col("kind").isin(OWN, ASK_LESS)).select("node", "sig", "kind", "cost").distinct()
        hot = asks.filter(F.col("kind") == OWN).groupBy("node").agg(F.count("*").alias("hot"))
        open_ = heads.join(hot, "node", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
        open_ = open_.select("node", "n", (F.col("total") < self._need("n")).alias("short"), (self._need("n") - F.col("total") + F.col("hot")).alias("take"))
        open_ = open_.filter("take > 0")
        ranked = asks.join(open_, "node").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("cost", "sig")))
        asked = stored(ranked.filter("short or r <= take").select("sig", F.col("node").alias("x"), F.col("n").alias("xn"), "kind", "short"), f"{self.folder}/asked")
        wanted = asked.groupBy("sig").agg(F.max("short").alias("short"))
        members = shared.filter(F.col("kind") != HEAD).join(wanted, "sig").filter(F.col("kind").isin(OWN, BELOW) | F.col("short"))
        members = stored(members.select("sig", "node").distinct(), f"{self.folder}/members")
        sets = self._sets(self.singles.join(checked_small(members.select("node").distinct()), "node", "left_semi"))
        sets = stored(sets.dropDuplicates(["node"]) if self.repeats or self._has_repeated_rows() else sets, f"{self.folder}/sets")

        # first against one centre: of each signature the set with the largest share of common segments
        share = members.groupBy("node").agg(F.count("*").alias("k")).join(heads, "node").select("node", (F.col("k") / F.col("n")).alias("share"))
        centre = members.join(share, "node").groupBy("sig").agg(F.max_by("node", F.struct("share", -F.col("node"))).alias("centre"))
        best = members.join(centre, "sig").groupBy("node", "centre").agg(F.count("*").alias("k"))
        best = stored(best.groupBy("node").agg(F.max_by("centre", F.struct("k", -F.col("centre"))).alias("centre")), f"{self.folder}/best")
        pairs = best.filter("node != centre").select(F.greatest("node", "centre").alias("x"), F.least("node", "centre").alias("y")).distinct()
        links = stored(self._verified(pairs, sets), f"{self.folder}/links0")
        labels = stored(components(links, f"{self.folder}/cc0"), f"{self.folder}/labels0")
        more = stored(self._between(asked, members, best, sets, labels), f"{self.folder}/links1")
        self.counts = more.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("linked"))
        return links.unionByName(more.filter("b is not null").select("a", "b"))

    def _has_repeated_rows(self) -> bool:
        return not self.rows.groupBy("node").count().filter("count > 1").isEmpty()

    def _between(self, asked: DataFrame, members: DataFrame, best: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) between sets that share an asked signature and lie in different classes so far, and
        (a, k) with parts of the number of documents linked with set ``a``.

        Sets are dealt into blocks of about BLOCK_SETS by their centre.  A set is compared with all
        blocks that hold a signature it asks; without ``counts`` those signatures and blocks are left out
        whose sets are all in one class.  A row stands for a set and a block, never for a pair, and a
        block reports fewer links than classes.
        """
        above = best.select(F.col("node").alias("centre"), F.col("centre").alias("root"))  # a centre may prefer another one
        named = best.join(above, "centre").select("node", F.col("root").alias("centre"))
        named = named.join(labels, "node", "left").select("node", "centre", F.coalesce("label", "node").alias("label"))
        chunks = named.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("chunks"))
        named = named.join(chunks, "centre").withColumn("block", F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("chunks"))))
        weights = self.rows.filter("node = rep").select("node", F.col("copies").alias("weight")).distinct()
        named = stored(named.join(weights, "node"), f"{self.folder}/named")
        held = members.join(named, "node")
        if self.count:
            places = held.groupBy("sig").agg(F.collect_set("centre").alias("centres"))
            asks = asked.select("sig", F.col("x").alias("node")).join(named.select("node", "label", "weight"), "node").join(places, "sig")
        else:
            main = held.groupBy("sig", "label").agg(F.count("*").alias("k")).groupBy("sig").agg(
                F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
            held = stored(held.join(main, "sig"), f"{self.folder}/held")
            places = held.groupBy("sig", "centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            # the centres of a signature, not its members
            places = places.groupBy("sig").agg(F.collect_list(F.struct("centre", "lo", "hi")).alias("places"))
            asks = held.filter("label != main").select("sig", "node", "label", "weight").join(places, "sig")
            open_places = F.filter("places", lambda p: (p["lo"] != F.col("label")) | (p["hi"] != F.col("label")))
            asks = asks.select("node", "label", "weight", F.transform(open_places, lambda p: p["centre"]).alias("centres"))
        asks = asks.select("node", "label", "weight", F.explode("centres").alias("centre")).distinct()
        blocks = named.select(F.col("centre").alias("c"), F.col("block").alias("at")).distinct()
        asks = asks.join(blocks, F.col("centre") == F.col("c")).select("node", "label", "weight", "at")
        asks = stored(asks, f"{self.folder}/asks")
        rounds = asks.groupBy("at").agg(F.count("*").alias("k"), F.ceil(F.count("*") / BLOCK_ASKS).cast("long").alias("rounds"))
        totals = rounds.agg(F.sum("k"), F.sum("rounds")).first()
        bins = max(1, -(-((totals[0] or 0) + BLOCK_SETS * (totals[1] or 0)) // BIN_ROWS))

        def binned(df: DataFrame, p: str) -> DataFrame:
            own = df.select(*[F.col(c).alias(p + c) for c in ("at", "round", "node", "label", "weight", "set")])
            return own.withColumn(f"{p}bin", F.pmod(F.xxhash64(f"{p}at", f"{p}round"), F.lit(bins)))

        left = asks.join(rounds.drop("k"), "at").withColumn("round", F.pmod(F.xxhash64("node"), F.col("rounds"))).drop("rounds")
        left = binned(left.join(sets, "node"), "q_")
        right = named.select("node", "label", "weight", "block").join(rounds.drop("k"), F.col("block") == F.col("at")).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
        right = binned(right.join(sets, "node"), "t_")
        percent, count = self.percent, self.count

        def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            targets = dict(tuple(held.groupby(["t_at", "t_round"])))
            links: list[tuple[int, int]] = []
            counts: list[tuple[int, int]] = []
            for key, queries in asked.groupby(["q_at", "q_round"]):
                if key in targets:
                    more, numbers = links_between(queries, targets[key], percent)
                    links += more
                    counts += numbers if count else []
            a, b, k = [x for x, _ in links + counts], [y for _, y in links] + [None] * len(counts), [0] * len(links) + [y for _, y in counts]
            return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="Int64"), "k": pd.Series(k, dtype="int64")})

        return left.groupBy("q_bin").cogroup(right.groupBy("t_bin")).applyInPandas(compare, "a long, b long, k long")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (x, y) that reach the threshold, as links (a, b)."""
        a = sets.select(F.col("node").alias("x"), F.col("set").alias("sx"))
        b = sets.select(F.col("node").alias("y"), F.col("set").alias("sy"))
        both = F.size(F.array_intersect("sx", "sy"))
        either = F.size("sx") + F.size("sy") - both
        return (pairs.join(a, "x").join(b, "y").filter(100 * both >= self.percent * either)
                .select(F.col("x").alias("a"), F.col("y").alias("b")))

    def classes(self) -> DataFrame:
        """(id, h1, n, node, label) per input row, with ``count`` also n_links; ``label`` names the class."""
        links = self.links()
        labels = stored(components(links, f"{self.folder}/cc1"), f"{self.folder}/labels1")
        sizes = self.heads.select(F.col("node").alias("rep"), "n").distinct()
        out = self.rows.join(sizes, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        label = F.when(F.col("n") == 0, F.col("node")).otherwise(F.coalesce("label", "rep"))
        columns = ["id", "h1", F.col("n").cast("long").alias("n"), "node", label.alias("label")]
        if self.count:  # documents of the same text and of linked texts
            out = out.join(self.counts, "rep", "left")
            columns.append(F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        return stored(out.select(*columns), f"{self.folder}/classes")


def class_report(docs: DataFrame, **options) -> DataFrame:
    """(id, n_shingles, component_id, class_size, n_links) per input row; component_id is the smallest id of
    the class, n_links the number of other documents that reach the threshold with this one."""
    join = JaccardJoin(docs, count=True, **options)
    classes = join.classes()
    if join.repeats:
        per = classes.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("class_size"))
    else:
        per = classes.groupBy("label").agg(F.count("*").alias("class_size")).withColumn("component_id", F.col("label"))
    return classes.join(per, "label").select("id", F.col("n").alias("n_shingles"), "component_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of every class the one of the smallest id (then text hash); columns unchanged."""
    classes = JaccardJoin(docs, id_col=id_col, text_col=text_col, **options).classes()
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "h1")).alias("m")).select(F.col("m.id").alias("_id"), F.col("m.h1").alias("_h"))
    first = first.distinct()
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("_id0"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h0"))
    kept = rows.join(first, (F.col("_h0") == F.col("_h")) & F.col("_id0").eqNullSafe(F.col("_id")), "left_semi")
    if not classes.groupBy("node").count().filter("count > 1").isEmpty():  # rows of equal id and text: one stays
        kept = kept.dropDuplicates(["_id0", "_h0"])
    return kept.select("_row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return class_report(docs).withColumnRenamed("id", "doc_id")
