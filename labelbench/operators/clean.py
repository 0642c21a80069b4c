"""Cleaning: annotated-row filter, strict labels, text normalisation, keep-first de-dup.

De-duplication never ranks inside a key group: a key may hold a third of all rows, so
the first row of every key is found with a partially aggregated ``min(row_id)`` (map-side
combine, one small row per key and task) and the rows are kept by a semi join on the
unique ``row_id``.  Keys are shuffled as a 16-byte md5 of the lower-cased text, not as
the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.casts import strict_int
from ..functions.text import normalize_description
from ..session import land

KEY = "_dedupe_key"


def filter_annotated(df: DataFrame, col: str = "ambuiguity") -> DataFrame:
    """Keep rows whose ambiguity annotation is present."""
    return df.filter(F.col(col).isNotNull())


def cast_labels_strict(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Labels to INT; a NULL or malformed label fails the job (like ``astype(int)``)."""
    labels = labels or LABELS
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: strict_int(c, c, types.get(c)) for c in labels})


def normalize_text(df: DataFrame, col: str = "description") -> DataFrame:
    """strip() then rstrip('.') on the text column."""
    return df.withColumn(col, normalize_description(F.col(col)))


def dedupe_key(col: str = "description") -> Column:
    """Case-insensitive duplicate key, hashed so shuffles move 16 bytes per row."""
    return F.unhex(F.md5(F.lower(F.col(col))))


def _first_ids(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    return df.select(key.alias(KEY), F.col(order_col)).groupBy(KEY).agg(F.min(order_col).alias(order_col))


def repeated_ids(df: DataFrame, col: str = "description", order_col: str = "row_id") -> DataFrame:
    """Row ids of the 2nd and later occurrences of a key; only keys and ids are shuffled.

    The first id of every key that repeats is a partially aggregated minimum, so the side that a
    hot key's rows are joined to has one row of it.
    """
    keys = df.select(dedupe_key(col).alias(KEY), F.col(order_col))
    first = keys.groupBy(F.col(KEY).alias("_key")).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keys.join(first, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col(order_col) > F.col("_first"))).select(order_col)


def dedupe_keep_first(df: DataFrame, col: str = "description", order_col: str = "row_id", land_repeats: bool = False) -> DataFrame:
    """``drop_duplicates(subset=[lower(col)], keep='first')`` with first = smallest row id.

    All NULL texts form one group, as in pandas.  With ``land_repeats`` the ids of the repeated rows are
    written first (this runs a job): Spark then knows their size, and while they are small enough to
    be broadcast no row of ``df`` is shuffled; beyond that both sides are shuffled by id.  Worth it
    where rows are wide and repeats few.  Row ids must be unique.
    """
    if land_repeats:
        return df.join(land(repeated_ids(df, col, order_col), "dedupe-repeats"), order_col, "left_anti")
    keep = _first_ids(df, dedupe_key(col), order_col).select(order_col)
    return df.join(keep, order_col, "left_semi")


def duplicate_count(df: DataFrame, col: str = "description") -> DataFrame:
    """Number of rows that repeat an earlier key (``duplicated().sum()``)."""
    per_key = df.groupBy(dedupe_key(col).alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_flags(df: DataFrame, col: str = "description", order_col: str = "row_id") -> DataFrame:
    """``duplicated()`` per row: true for the 2nd and later occurrence of a key."""
    keep = _first_ids(df, dedupe_key(col), order_col).select(F.col(order_col), F.lit(True).alias("_first"))
    return (df.join(keep, order_col, "left")
            .withColumn("is_duplicate", F.col("_first").isNull()).drop("_first"))


def prepare_sentences(df: DataFrame, labels: list[str] | None = None, land_repeats: bool = False) -> DataFrame:
    """Dataset preparation in the studied order: annotated filter -> strict labels ->
    strip / trailing dots -> keep-first case-insensitive de-dup (see there for ``land_repeats``)."""
    out = filter_annotated(df)
    out = cast_labels_strict(out, labels)
    out = normalize_text(out)
    return dedupe_keep_first(out, land_repeats=land_repeats)
