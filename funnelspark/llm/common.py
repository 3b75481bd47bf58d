"""Shared pieces of the text-corpus operators: words, the shared work folder, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters every text operator uses, and the word pattern they imply.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows up to which the small side of a join may be broadcast (8-byte keys: about 16 MB).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs inside one local process (tests) a scratch folder
    is taken instead; on a cluster the setting is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="funnelspark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else unchanged (shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_row``: no name of theirs can then clash with a working column;
    ``select("_row.*")`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def words(text: Column) -> Column:
    """All maximal runs of characters other than the six white spaces; null has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def word_hashes(w: Column) -> Column:
    """64-bit hashes of the words ``w``; n-gram hashes are made of them, so a word's letters are read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def hash_at(hashes: Column | str, first: Column, n: int) -> Column:
    """Hash of the n-gram whose word hashes begin at position ``first`` (from 0) of a stored column."""
    return F.xxhash64(*[F.get(hashes, first + k) for k in range(n)])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())
