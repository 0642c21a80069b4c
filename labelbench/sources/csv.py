"""Typed CSV scan of the main table and the matching CSV writer.

Columns are taken by the names in the file's header, whatever their order; values are read as
text (no inference pass) with RFC-4180 quoting and embedded newlines, and pandas' NA tokens
become NULL once at the scan.  Types are then forced explicitly: labels strict BIGINT,
annotation columns DOUBLE (a fraction stays one).  An annotation that is not a number is kept
as NaN: it counts as present and as non-zero, but equals no code.

Spark's ``multiLine`` scan reads a file in one task; ``in_splits`` reads one large file by many tasks
(``csv_split``).  The scan lands what it reads in the shared folder, so a file is parsed once and
its row numbers are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABELS, NUMBER_RE
from ..functions.casts import na_to_null, strict_int
from ..session import land
from . import csv_split

RAW_TEXT_COLUMNS = ["row_id", "description", "source", "ambuiguity", "ambiguity_type", "comments", *LABELS, "goal"]
ANNOTATIONS = ("ambuiguity", "ambiguity_type")

_CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def raw_schema(columns: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in (columns or RAW_TEXT_COLUMNS)])


def write_csv(df: DataFrame, path: str) -> None:
    """Write a text table as quoted CSV (values keep their outer whitespace)."""
    (df.write.mode("overwrite").options(**_CSV_OPTIONS).option("quoteAll", "true")
     .option("nullValue", "").option("emptyValue", "").csv(path))


def annotation(c: str, strict: bool = False) -> Column:
    """An annotation as DOUBLE: NULL stays NULL, what is not a number becomes NaN (or raises)."""
    num = F.regexp_extract(F.col(c), NUMBER_RE, 1)
    bad = F.raise_error(F.concat(F.lit(f"malformed value of '{c}': "), F.col(c))).cast("double") if strict else F.lit(float("nan"))
    return F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(num != "", num.cast("double")).otherwise(bad)


def _file_order(raw: DataFrame) -> DataFrame:
    """``row_id`` 0, 1, 2, ... by file name and place in the file.

    A file is read by one task, so its rows have consecutive scan numbers; the running sum of
    the files' row counts is over one row per file.
    """
    files = raw.groupBy("_file").agg(F.min("_scan").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(files, "_file").withColumn("row_id", F.col("_scan") + F.col("_shift")).drop("_shift")


def scan_csv_typed(spark: SparkSession, path: str, labels: list[str] | None = None,
                   strict_annotations: bool = False, in_splits: bool = False) -> DataFrame:
    """Read the main table by its header: NA tokens -> NULL, labels strict, annotations DOUBLE.

    All files must have the same header.  ``row_id`` comes from the file when it has one, else
    rows are numbered in file order.  Columns the file has beyond the known ones stay text.
    Runs a job when called (the landing).
    """
    labels = labels or LABELS
    if in_splits:
        raw = csv_split.read_csv(spark, path, _CSV_OPTIONS)
        cols, place = [c for c in raw.columns if c not in ("_file", "_scan")], [F.col("_file"), F.col("_scan")]
    else:
        raw = spark.read.options(**_CSV_OPTIONS).option("enforceSchema", "false").csv(path)
        cols, place = raw.columns, [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_scan")]
    raw = land(raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in cols], *place), "csv")
    df = raw.withColumn("row_id", F.col("row_id").cast("bigint")) if "row_id" in cols else _file_order(raw)
    casts = {c: annotation(c, strict_annotations) for c in ANNOTATIONS if c in cols}
    casts.update({c: strict_int(c, c) for c in labels if c in cols})
    return df.withColumns(casts).drop("_file", "_scan")
