"""Privacy and public-baseline sanitising.

Pseudonyms are numbered over the *distinct* owner labels, range by range, as students are over their rows.
Frames are relabelled in one pass over all label columns: by lookup in a constant if a count proves the
mapping small, else by one join.  A baseline is published as one version: all its tables, or none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import clean_text, sum_money
from ..functions.numbering import numbered
from ..session import cut_lineage
from ..sources.versions import commit_tables


def redact_pii(df: DataFrame, pii=None) -> DataFrame:
    return df.drop(*[c for c in (R.PII_COLUMNS if pii is None else pii) if c in df.columns])


def label_pseudonyms(frames: Sequence[tuple[DataFrame, Sequence[str]]], prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct labels over (frame, columns) pairs -> '<prefix> 01', ...; labels in ``keep`` or in
    the public keep list (case does not matter) are not renamed and take no number."""
    stay = [*R.PUBLIC_KEEP_VALUES, *[k.lower() for k in keep]]
    parts = [f.select(clean_text(F.col(c)).alias("label")) for f, cols in frames for c in cols if c in f.columns]
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    labels = labels.where(~F.lower("label").isin(stay)).distinct()
    return numbered(labels, ["label"], "__n").select("label", F.format_string(f"{prefix} %02d", "__n").alias("pseudonym"))


#: Labels up to which the mapping travels with the rows as a constant (some 100 bytes each).
MAX_INLINE_LABELS = 20_000
_LABELS_PER_BUCKET = 4


def _inline_lookup(mapping: DataFrame, n: int):
    """label -> pseudonym as an expression: an array of small maps, chosen by the label's hash, in a scalar subquery."""
    buckets = max(1, n // _LABELS_PER_BUCKET)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    # a label stands for itself once, whatever the mapping repeats
    maps = mapping.groupBy("label").agg(F.min("pseudonym").alias("p")).groupBy(slot(F.col("label")).alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("m"))
    held = maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("by"))
    # maps are searched entry by entry, arrays are indexed: buckets without a label hold null
    table = held.select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.element_at("by", b.cast("long")))).scalar()
    return table, lambda t, c: F.element_at(F.get(t, slot(c).cast("int")), c)


def _looked_up(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with their labels replaced by one join over all columns: the labels of a row are unpivoted, joined
    and brought back to it as a map from column to pseudonym."""
    rows = cut_lineage(df.withColumn("__rid", F.monotonically_increasing_id()))
    cells = rows.select("__rid", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), clean_text(F.col(f"`{c}`")).alias("label")) for c in columns])).alias("x"))
    cells = cells.select("__rid", "x.c", "x.label").where(F.col("label") != "")
    hits = cells.join(mapping.groupBy("label").agg(F.min("pseudonym").alias("p")), "label")
    hits = hits.groupBy("__rid").agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("__names"))  # one entry per column
    out = rows.join(hits, "__rid", "left")
    return out.withColumns({c: F.coalesce(F.element_at("__names", F.lit(c)), F.col(f"`{c}`")) for c in columns}).drop("__rid", "__names")


def apply_label_map(df: DataFrame, mapping: DataFrame, columns: Sequence[str], inline: int = MAX_INLINE_LABELS) -> DataFrame:
    """Replace labels in the named columns by exact trimmed match (label, pseudonym), all columns in one pass.

    A count of the mapping decides: up to ``inline`` labels are looked up in a constant, without a join; more are
    joined once.  Blank labels stay; of a label that the mapping repeats, the smallest pseudonym is taken."""
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not present:
        return df
    n = mapping.limit(inline + 1).count()
    if n == 0:
        return df
    if n > inline:
        return _looked_up(df, mapping, present)
    table, look = _inline_lookup(mapping, n)
    held = df.withColumn("__labels", table)  # bound once, not per column
    return held.withColumns({c: F.coalesce(look(F.col("__labels"), clean_text(F.col(f"`{c}`"))), F.col(f"`{c}`")) for c in present}).drop("__labels")


def sanitize_frame(df: DataFrame, owners: DataFrame, student_order: Sequence[str] | None = None, row_labels: DataFrame | None = None) -> DataFrame:
    """What may be published of ``df``: private and unnamed columns go, owner, budget and source labels
    that are owners become pseudonyms, and students become 'Student 0001', ... in that order."""
    out = df.drop(*[c for c in df.columns if c in R.PUBLISHED_DROP_COLUMNS or c.lower().startswith("unnamed")])
    if student_order:
        out = numbered(out, student_order, "__student").withColumn("student", F.format_string("Student %04d", "__student")).drop("__student")
    out = apply_label_map(out, owners, [*R.OWNER_LABEL_COLUMNS, *R.SOURCE_LABEL_COLUMNS])
    return out if row_labels is None else apply_label_map(out, row_labels, ["row_label"])


def public_metadata(leads: DataFrame, paid: DataFrame, enrollments: DataFrame, allocations: DataFrame, term: str = "") -> DataFrame:
    """One row: what was published (row counts, tracker revenue, workbook term)."""
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return enrollments.agg(F.count(F.lit(1)).alias("enrollment_rows"), sum_money(F.col("revenue").try_cast("double")).alias("tracker_revenue")).select(
        rows(paid).alias("paid_rows"), rows(leads).alias("udr_rows"), "enrollment_rows", F.coalesce("tracker_revenue", F.lit(0.0)).alias("tracker_revenue"),
        rows(allocations).alias("budget_allocation_rows"), F.lit(term).alias("workbook_term"))


def public_baseline(tables: Mapping[str, DataFrame], owners: DataFrame, student_orders: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Every table sanitised, by name."""
    return {name: sanitize_frame(df, owners, (student_orders or {}).get(name)) for name, df in tables.items()}


def publish_baseline(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], owners: DataFrame, metadata: DataFrame,
                     student_orders: Mapping[str, Sequence[str]] | None = None, at: str | None = None) -> int:
    """Publish every table sanitised, and the metadata row as table ``metadata``, as one version below ``root``; a run
    that fails publishes nothing.  Readers take ``sources.versions.read_tables``."""
    if "metadata" in tables:
        raise ValueError("metadata is the name of the metadata row's table")
    return commit_tables(spark, root, public_baseline(tables, owners, student_orders) | {"metadata": metadata}, at=at)
