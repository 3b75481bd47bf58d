"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length.  Pieces are dealt by hash into groups
of about ``group_pieces`` and every group is packed by itself, so a task holds one bounded group
whatever the corpus; with thousands of pieces in a group the loss against one global packing is a
fraction of a bin per group.

A sequence of length c costs its c tokens, a fixed ``overhead`` and the work of attention, which grows with the
square: c + overhead + c * c / attention.  So a token is cheaper in a short sequence than in a long one, and a
well-filled one cheaper than a half-empty one; long sequences are for long pieces.

Inside a group, pieces go by falling size into the open bin they fill best.  If none has room, the permitted
lengths compete for the new bin: for each that holds the piece, what could go beside it is looked up among the
pieces still to come (the largest that fit, one after another), and the length of least cost per word wins.
That is tried with every subset of the permitted lengths that can hold the longest piece; at the end each bin is
downsized to the shortest permitted length that holds its contents, and the cheapest trial wins.

Defined cases: null or empty texts are one piece of 0 words (any bin takes it); rows with equal ids
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate, combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import shared_dir, stored, words

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Length at which attention costs as much as all else.
ATTENTION = 16_384
GROUP_PIECES = 10_000


def sequence_cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return length + overhead + length * length / attention


def _beside(minus: list[int], behind: list[int], at: int, free: int) -> int:
    """Words that go into ``free`` if the largest fitting pieces from position ``at`` on are put in, one after another.

    ``minus`` are the negated sizes (rising), ``behind`` the words of all pieces from a position on."""
    filled = 0
    while free:
        at = bisect_left(minus, -free, at)
        if at >= len(minus) or not minus[at]:
            break
        if behind[at] <= free:
            return filled + behind[at]
        filled, free, at = filled - minus[at], free + minus[at], at + 1
    return filled


def _one_trial(sizes: list[int], lengths: tuple[int, ...], costs: dict[int, float]) -> list[list[int]]:
    """Bins (lists of positions in ``sizes``, which falls) opened at ``lengths`` only."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free words, bin), sorted
    minus = [-s for s in sizes]
    behind = [*accumulate(reversed(sizes))][::-1]
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((c for c in lengths if c >= size),
                       key=lambda c: (costs[c] / max(1, size + _beside(minus, behind, i + 1, c - size)), c))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (free - size, b))
    return bins


def pack_group(sizes: list[int], lengths: tuple[int, ...], overhead: int, attention: int = ATTENTION) -> list[tuple[int, list[int]]]:
    """[(length, positions in ``sizes``)] of the cheapest trial; ``sizes`` must fall."""
    ordered = tuple(sorted(lengths))
    costs = {c: sequence_cost(c, overhead, attention) for c in ordered}
    best: tuple[float, list[tuple[int, list[int]]]] | None = None
    longest = sizes[0] if sizes else 0
    for some in (s for k in range(len(ordered), 0, -1) for s in combinations(ordered, k)):
        if some[-1] < longest:
            continue
        packed = []
        for members in _one_trial(sizes, some, costs):
            held = sum(sizes[i] for i in members)
            packed.append((next(c for c in ordered if c >= held), members))
        cost = sum(costs[c] for c, _ in packed)
        if best is None or cost < best[0]:
            best = (cost, packed)
    return best[1] if best else []


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
         overhead: int = OVERHEAD, attention: int = ATTENTION, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, piece, start_word, n_words, bin_id, bin_length, bin_offset."""
    spark = docs.sparkSession
    longest = max(lengths)
    sized = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.size(words(F.col(text_col))).cast("long").alias("n"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("long")
    pieces = stored(sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))), f"{shared_dir(spark)}/pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.select(
        "id", "h", "piece", (F.col("piece") * longest).alias("start_word"),
        F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("long").alias("n_words"),
        F.pmod(F.xxhash64("id", "h", "piece", F.lit(8)), F.lit(groups)).alias("group"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "id", "h", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last")
        pdf = pdf.reset_index(drop=True)
        sizes = pdf["n_words"].tolist()
        bin_id, bin_length, offset = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        base = int(pdf["group"].iloc[0]) << 32
        for b, (length, members) in enumerate(pack_group(sizes, lengths, overhead, attention)):
            at = 0
            for i in members:
                bin_id[i], bin_length[i], offset[i] = base + b, length, at
                at += sizes[i]
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start_word": pdf["start_word"], "n_words": pdf["n_words"],
                             "bin_id": bin_id, "bin_length": bin_length, "bin_offset": offset})

    out = pieces.groupBy("group").applyInPandas(
        packed, "id string, piece long, start_word long, n_words long, bin_id long, bin_length long, bin_offset long")
    return out.withColumn("id", F.col("id").cast("long"))  # as text on the way: pandas would make null ids floats


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).withColumnRenamed("id", "doc_id")
