"""Text extraction as Spark jobs over text tables.

Tag stripping, line splitting, keyword filtering and price-line regexes are JVM expressions;
only HTML entity unescaping (a stdlib one-liner with a table of ~2000 entities) runs as an
Arrow-batched pandas UDF on the already tag-stripped text.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R

LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"  # str.splitlines() boundaries


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def strip_tags(c: Column) -> Column:
    """Block tags -> newline, every other tag -> space."""
    return F.regexp_replace(F.regexp_replace(c, R.HTML_BLOCK_TAG_PATTERN, "\n"), "<[^>]+>", " ")


def html_to_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    return pages.withColumn(out, _unescape(strip_tags(F.col(html_col))))


def extract_data_lines(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                       limit: int | None = None) -> DataFrame:
    """Lines holding a digit and a keyword, whitespace collapsed, numbered in text order;
    every line, or the first ``limit`` of each document."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text_col), LINE_BREAKS)).alias("pos", "raw"))
    keep = F.col("raw").rlike(r"\p{Nd}") & F.col("raw").rlike("(?i)" + R.DATA_LINE_KEYWORDS)
    lines = lines.where(keep).select(key, "pos", F.trim(F.regexp_replace(F.col("raw"), r"\s+", " ")).alias("line"))
    lines = lines.where(F.col("line") != "")
    rn = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    lines = lines.withColumn("line_no", rn).select(key, "line_no", "line")
    return lines if limit is None else lines.where(F.col("line_no") <= limit)


def read_text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, text) of text files landed below ``folder``, each read whole, so that blocks over several lines
    stay together.  Files land in folders ``page_id=<id>``; elsewhere a file's name is its id."""
    pages = spark.read.text(folder, wholetext=True)
    key = F.col("page_id") if "page_id" in pages.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return pages.select(key.alias("page_id"), F.col("value").alias("text"))


def extract_price_table(pages_text: DataFrame, text_col: str = "text", key: str = "page_id") -> DataFrame:
    """Four numbers per degree level from page text (whitespace normalised, case-insensitive)."""
    pages_text = pages_text.where(F.contains(F.col(text_col), F.lit("$")))  # no pattern matches without a price
    pages_text = pages_text.select(key, F.regexp_replace(F.col(text_col), r"\s+", " ").alias("__norm"))
    norm = F.col("__norm")
    num = lambda s: F.regexp_replace(s, ",", "").try_cast("long")
    rows = []
    for level, pattern in R.PRICE_LINE_PATTERNS:
        pat = "(?i)" + pattern
        rows.append(F.struct(
            F.lit(level).alias("program_degree_level"), norm.rlike(pat).alias("hit"),
            num(F.regexp_extract(norm, pat, 1)).alias("tuition_per_credit"),
            num(F.regexp_extract(norm, pat, 2)).alias("credits_required"),
            num(F.regexp_extract(norm, pat, 3)).alias("estimated_total_tuition"),
            num(F.regexp_extract(norm, pat, 4)).alias("estimated_annual_tuition")))
    out = pages_text.select(key, F.explode(F.array(*rows)).alias("p")).where(F.col("p.hit"))
    return out.select(key, "p.program_degree_level", "p.tuition_per_credit", "p.credits_required",
                      "p.estimated_total_tuition", "p.estimated_annual_tuition")
