"""Tables saved in versions: a commit publishes several tables together or none.

    <root>/<table>/<version>-<id>/...        Parquet files, never changed once written
    <root>/_commits/<version>.json           what the version consists of

A save writes new folders first and publishes them with one small file at the end, so readers always see
whole tables of one version: a save that fails leaves the old version as it was, and what it wrote
is never read.  A version names every table of the store, those of earlier saves included.  Two saves that
start from the same version can't both publish: the number is claimed by creating a file, and the
second one fails with ``CommitConflict``.  (The claim and the rename need a file system on which they
are atomic, as HDFS and mounted folders have; on a plain object store one writer at a time must be arranged.)

Large tables are partitioned, usually by month, and a filter on the partition column reads only its folders.
Row counts and times come from the published files and the Parquet footers, never from a scan of columns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import ts_literal
from .storage import STALE_AFTER_HOURS

#: A claim without a version after so many seconds is taken for that of a writer that died.
CLAIM_SECONDS = 600


class CommitConflict(RuntimeError):
    """Another save published the same version number first."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit_files(spark: SparkSession, root: str) -> dict[str, int]:
    """Names below ``_commits`` with their modification times (milliseconds)."""
    fs, folder = _path(spark, f"{root.rstrip('/')}/_commits")
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(folder)} if fs.exists(folder) else {}


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _commit_files(spark, root) if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Contents of a version, the newest if none is named: {"version", "committed_at", "tables": {name: ...}}."""
    numbers = version_numbers(spark, root)
    if version is None:
        if not numbers:
            return {"version": 0, "committed_at": None, "tables": {}}
        version = numbers[-1]
    if version not in numbers:
        raise KeyError(f"{root} has no version {version}")
    fs, file = _path(spark, f"{root.rstrip('/')}/_commits/{version:010d}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, contents: dict) -> None:
    version = contents["version"]
    folder = f"{root.rstrip('/')}/_commits"
    fs, final = _path(spark, f"{folder}/{version:010d}.json")
    claim = _path(spark, f"{folder}/{version:010d}.claim")[1]
    if fs.exists(final):
        raise CommitConflict(f"version {version} of {root} exists")
    if not fs.createNewFile(claim):
        age = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
        if fs.exists(final) or age < CLAIM_SECONDS:
            raise CommitConflict(f"version {version} of {root} is being published by another writer")
    draft = _path(spark, f"{folder}/{uuid.uuid4().hex}.draft")[1]
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(contents, indent=1).encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise CommitConflict(f"version {version} of {root} exists")


def commit_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], *, partitions: Mapping[str, Sequence[str]] | None = None,
                  at: str | None = None) -> int:
    """Save ``tables`` and publish them, with the store's other tables, as the next version; its number.

    ``partitions`` names the partition columns of a table; rows are dealt by them and AQE splits a large
    partition over several tasks.  ``at`` is the time of the refresh (text; now if not given).
    """
    root = root.rstrip("/")
    before = manifest(spark, root)
    version = before["version"] + 1
    written = {}
    for name, df in tables.items():
        if not name or name.startswith("_") or "/" in name:
            raise ValueError(f"{name!r} is no table name")
        by = list((partitions or {}).get(name, ()))
        path = f"{root}/{name}/{version:010d}-{uuid.uuid4().hex}"
        (df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write).parquet(path)
        entry = {"path": path, "schema": df.schema.json(), "partitions": by, "version": version}
        written[name] = entry | {"rows": _read(spark, entry).count()}  # an empty read schema: footers only
    at = at or time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    _publish(spark, root, {"version": version, "committed_at": at, "tables": before["tables"] | written})
    return version


def _read(spark: SparkSession, entry: Mapping) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])


def read_tables(spark: SparkSession, root: str, names: Mapping[str, str] | Sequence[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of one version by name.  ``names`` may map a name to a schema, which stands for the table where
    the version has none; a missing table without a schema is an error."""
    held = manifest(spark, root, version)["tables"]
    schemas = names if isinstance(names, Mapping) else {}
    out = {}
    for name in held if names is None else names:
        if name in held:
            out[name] = _read(spark, held[name])
        elif name in schemas:
            out[name] = spark.createDataFrame([], schemas[name])
        else:
            raise KeyError(f"{root} has no table {name}")
    return out


def stored_tables(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(table, rows, table_version, partitioned_by): what a version holds, from the manifest alone."""
    held = manifest(spark, root, version)["tables"]
    rows = [(name, e["rows"], e["version"], ",".join(e["partitions"])) for name, e in sorted(held.items())]
    return spark.createDataFrame(rows, "table string, rows long, table_version long, partitioned_by string")


def stored_freshness(spark: SparkSession, root: str, now, expected: Sequence[str] = ()) -> DataFrame:
    """One row: last refresh, age in hours, stale (older than a day, or never refreshed), tables that are empty or
    expected but missing, whether any table has rows.  Reads the manifest only."""
    held = manifest(spark, root)
    rows = {name: e["rows"] for name, e in held["tables"].items()} | {name: 0 for name in expected if name not in held["tables"]}
    last = F.lit(None).cast("timestamp") if held["committed_at"] is None else ts_literal(held["committed_at"])
    age = (F.unix_micros(ts_literal(now)) - F.unix_micros("last_refresh")) / F.lit(3.6e9)
    empty = F.array(*[F.lit(n) for n in sorted(n for n, k in rows.items() if not k)]).cast("array<string>")
    return spark.range(1).select(last.alias("last_refresh")).select(
        "last_refresh", age.alias("age_hours"), F.coalesce(age > STALE_AFTER_HOURS, F.lit(True)).alias("stale"),
        empty.alias("empty_tables"), F.lit(any(rows.values())).alias("has_cache"))


def folder_freshness(spark: SparkSession, folders: Mapping[str, str], now) -> DataFrame:
    """(table, rows, last_written, age_hours) of plain Parquet folders: counts from the footers, times from the files."""
    out = None
    for name, folder in folders.items():
        files = spark.read.parquet(folder)
        part = files.agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_modification_time").alias("last_written"))
        part = part.select(F.lit(name).alias("table"), "rows", "last_written")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("age_hours", (F.unix_micros(ts_literal(now)) - F.unix_micros("last_written")) / F.lit(3.6e9))


def expire_versions(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Take the oldest versions away, ``keep`` newest ones stay, and the folders that only those used; their numbers."""
    numbers = version_numbers(spark, root)
    gone = numbers[:-keep] if keep > 0 else []
    if not gone:
        return []
    kept = {e["path"] for n in numbers[-keep:] for e in manifest(spark, root, n)["tables"].values()}
    unused = {e["path"] for n in gone for e in manifest(spark, root, n)["tables"].values()} - kept
    for n in gone:  # the version first: a reader never finds one whose files are missing
        fs, file = _path(spark, f"{root.rstrip('/')}/_commits/{n:010d}.json")
        fs.delete(file, False)
    for path in unused:
        fs, folder = _path(spark, path)
        fs.delete(folder, True)
    return gone


def folder_version(spark: SparkSession, folder: str) -> str:
    """A text that changes whenever a file directly below ``folder``, or below a table folder in it, is
    added, replaced or taken away: names, sizes and times.  For caches of what was derived from the files."""
    fs, p = _path(spark, folder)
    marks = []
    for s in fs.listStatus(p):
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        marks += [(s.getPath().getName(), x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in inner]
    return str(hash(tuple(sorted(marks))))


def month_of(c: Column) -> Column:
    """Partition value of a time: 'yyyy-MM', 'none' where there is no time."""
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("none"))
