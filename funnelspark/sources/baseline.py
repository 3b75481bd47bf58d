"""Baseline files (CSV) read with a type per column and a table of what didn't fit.

Files are read as text once.  A line whose number of fields isn't the header's is set aside whole; a value
that its column's type can't take becomes null, its row stays, and the value is listed.  So good rows and
rejects together account for everything that was in the files.  Both are tables; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import strip_ws
from ..session import cut_lineage

_CORRUPT = "_corrupt_record"
#: Date spellings tried in turn after the ISO forms.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM")
KINDS = {"text": "string", "date": "timestamp", "number": "double", "integer": "bigint", "flag": "boolean"}
REJECTS = "table string, reason string, row_key string, column string, value string"


def coerced(c: Column, kind: str) -> Column:
    """The text as the column's type, null where it doesn't fit: dates in any of the spellings, numbers, whole numbers
    (also written with a zero fraction), flags as true/yes/1 and false/no/0 in any case."""
    text = strip_ws(c)
    if kind == "text":
        return text
    if kind == "number":
        return text.try_cast("double")
    if kind == "integer":
        return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^[+-]?\d+\.0*$"), F.substring_index(text, ".", 1).try_cast("bigint")))
    if kind == "flag":
        low = F.lower(text)
        return F.when(low.isin("true", "yes", "1"), F.lit(True)).when(low.isin("false", "no", "0"), F.lit(False))
    if kind == "date":
        return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])
    raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")


def load_baseline(spark: SparkSession, path: str, columns: Mapping[str, str], key: str, table: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the CSV files with a header below ``path``.

    ``columns`` gives each column's kind (``KINDS``).  Columns that the files lack are null, further ones are
    left out; blank values are null and no rejects.  Rejects: table, reason ('row' or 'value'), the row's ``key``,
    column and value (of a row: the whole line).  A missing path has no rows; files of one table with
    different headers are an error.
    """
    for kind in columns.values():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    typed = ", ".join(f"`{c}` {KINDS[k]}" for c, k in columns.items())
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed), spark.createDataFrame([], REJECTS)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _CORRUPT]])
    raw = (spark.read.schema(schema).options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT,
                                             columnPruning=False).csv(path))
    raw = cut_lineage(raw)  # read once, every field: what is broken doesn't depend on the columns asked for
    whole, broken = raw.where(F.col(_CORRUPT).isNull()), raw.where(F.col(_CORRUPT).isNotNull())
    present = {c: kind for c, kind in columns.items() if c in header}
    blank = lambda c: F.coalesce(strip_ws(F.col(f"`{c}`")), F.lit("")) == ""
    value = lambda c: F.when(~blank(c), coerced(F.col(f"`{c}`"), columns[c]))
    rows = whole.select(*[(value(c) if c in present else F.lit(None)).cast(KINDS[kind]).alias(c) for c, kind in columns.items()])
    row_key = F.col(f"`{key}`") if key in header else F.lit(None).cast("string")
    unfit = [F.when(~blank(c) & value(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")))
             for c, kind in present.items() if kind != "text"]
    rejects = broken.select(F.lit(table).alias("table"), F.lit("row").alias("reason"), F.lit(None).cast("string").alias("row_key"),
                            F.lit(None).cast("string").alias("column"), F.col(_CORRUPT).alias("value"))
    if unfit:
        cells = whole.select(row_key.alias("row_key"), F.explode(F.array_compact(F.array(*unfit))).alias("x"))
        rejects = rejects.unionByName(cells.select(F.lit(table).alias("table"), F.lit("value").alias("reason"), "row_key", "x.column", "x.value"))
    return rows, rejects


# ---- baseline files derived from the driver tables ------------------------------------------------

ENROLLMENT_COLUMNS = {"row_key": "text", "student": "text", "enrolled_date": "date", "revenue": "number", "days_to_enroll": "integer",
                      "title_iv": "flag", "term": "date"}
_FLAGS = ["true", "0", "YES", "", "no"]


def enrollment_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """A CSV baseline from orders, with values as people type them: unquoted commas, 'TBD', 'n/a', three date spellings."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "yyyy-MM-dd HH:mm:ss")), (k % 3 + 1).cast("int"))
    fields = [
        F.concat(F.lit("E"), k.cast("string")),
        F.when(k % 97 == 0, F.concat(F.lit("Last, S"), k.cast("string"))).otherwise(F.concat(F.lit("S"), k.cast("string"))),
        F.when(k % 41 == 0, F.lit("TBD")).otherwise(spelled),
        F.when(k % 53 == 0, F.lit("n/a")).when(k % 19 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string")),
        F.when(k % 29 == 0, F.lit("12.5")).when(k % 7 == 0, F.concat((k % 90).cast("string"), F.lit(".0"))).otherwise((k % 90 - 5).cast("string")),
        F.when(k % 37 == 0, F.lit("maybe")).otherwise(F.element_at(F.array(*[F.lit(x) for x in _FLAGS]), (k % len(_FLAGS) + 1).cast("int"))),
    ]
    header = ",".join([c for c in ENROLLMENT_COLUMNS if c != "term"])

    def with_header(batches):
        for n, batch in enumerate(batches):
            if n == 0:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
            yield batch

    o.select(F.concat_ws(",", *fields).alias("value")).mapInArrow(with_header, "value string").write.text(folder)
    return folder


OVERRIDE_COLUMNS = {"program_degree_level": "text", "note": "text", "duration_months": "number", "duration_years": "number", "refreshed_at": "integer"}
#: Levels in the order by which parts are dealt to them; the last two are no levels.
_OVERRIDE_LEVELS = ["Certificate", "Associate", "Bachelor", "Master", "Doctoral", "_comment", ""]


def override_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Overrides of the tuition rules as people keep them (CSV): some parts each change a level's duration and note, a
    few lines are comments or have no level."""
    p = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").where(F.col("p_partkey") % 101 == 7)
    k, size = F.col("p_partkey"), F.col("p_size")
    level = F.element_at(F.array(*[F.lit(x) for x in _OVERRIDE_LEVELS]), (k % len(_OVERRIDE_LEVELS) + 1).cast("int"))
    rows = p.select(level.alias("program_degree_level"), F.when(size % 3 != 0, F.concat(F.lit("see "), "p_name")).alias("note"), (size + 6).alias("duration_months"),
                    F.when(size % 2 == 0, F.lit(2)).alias("duration_years"), k.alias("refreshed_at"))
    rows.write.option("header", True).csv(folder)
    return folder
