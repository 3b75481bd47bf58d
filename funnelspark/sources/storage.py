"""Table storage, freshness and refresh audit.

Tables are written as Parquet under a shared folder (CSV for readers that need it); loading a
missing table yields an empty frame with the requested schema.  Freshness and audit rows are
computed from counts and timestamps, with ``now`` always an argument.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ts_literal

STALE_AFTER_HOURS = 24


def save_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    paths = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
        paths[name] = path
    return paths


def load_tables(spark: SparkSession, folder: str, schemas: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    out = {}
    for name, schema in schemas.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            out[name] = (spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv"
                         else spark.read.schema(schema).parquet(path))
            out[name].schema  # noqa: B018 - resolve now so a missing path falls through
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # only a missing table is an empty one
                raise
            out[name] = spark.createDataFrame([], schema)
    return out


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) for every table, one count job per table unioned lazily."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_freshness(refresh_log: DataFrame, tables: Mapping[str, DataFrame], now) -> DataFrame:
    """One row: last refresh, age in hours, stale (> 24 h or unknown), empty tables, has_cache."""
    counts = table_counts(tables)
    empty = counts.where(F.col("rows") == 0).agg(F.array_sort(F.collect_list("table")).alias("empty_tables"))
    last = refresh_log.agg(F.max(F.col("refreshed_at").cast("timestamp")).alias("last_refresh"))
    age = (F.unix_micros(ts_literal(now)) - F.unix_micros(F.col("last_refresh"))) / F.lit(3.6e9)
    has_cache = counts.agg(F.max(F.col("rows") > 0)).scalar()
    return last.select("last_refresh", age.alias("age_hours"),
                       F.coalesce(age > STALE_AFTER_HOURS, F.lit(True)).alias("stale"),
                       empty.select("empty_tables").scalar().alias("empty_tables"),
                       F.coalesce(has_cache, F.lit(False)).alias("has_cache"))


def refresh_audit(tables: Mapping[str, DataFrame], limits: Mapping[str, int], now, include_activities: bool) -> DataFrame:
    """One status row: per-table row counts, limits, activity flag and refresh time."""
    counts = table_counts(tables)
    pivoted = counts.groupBy().pivot("table", list(tables)).agg(F.first("rows"))
    return pivoted.select(*[F.col(t).alias(f"{t}_rows") for t in tables],
                          *[F.lit(v).alias(f"max_{k}") for k, v in limits.items()],
                          F.lit(include_activities).alias("include_activities"), ts_literal(now).alias("refreshed_at"))


def refresh_log_row(spark: SparkSession, when: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(when.strftime("%Y-%m-%d %H:%M:%S"),)], "refreshed_at string")
