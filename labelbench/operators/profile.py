"""Profiles: null counts, schema info, label and annotation distributions.

Each report is one aggregation pass with conditional sums (partial aggregation on the
map side) followed by an unpivot of the single result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABELS
from ..functions.casts import lenient_int


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def null_profile(df: DataFrame) -> DataFrame:
    """Number of NULLs of every column: (column, nulls)."""
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).cast("bigint").alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def table_info(df: DataFrame) -> DataFrame:
    """Type and non-NULL count of every column: (position, column, dtype, non_null)."""
    wide = df.agg(*[F.count(F.col(c)).cast("bigint").alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column", "non_null")
    meta = F.create_map(*[x for i, f in enumerate(df.schema.fields)
                          for x in (F.lit(f.name), F.struct(F.lit(i).alias("position"),
                                                            F.lit(f.dataType.simpleString()).alias("dtype")))])
    return long.select(meta[F.col("column")]["position"].alias("position"), "column",
                       meta[F.col("column")]["dtype"].alias("dtype"), "non_null")


def value_distribution(df: DataFrame, col: str, domain: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows per value of ``domain`` (0 for a value that does not occur) and their share of the
    domain total in percent; values are read as by ``lenient_int``."""
    v = lenient_int(col, _dtypes(df)[col])
    wide = df.agg(*[F.count(F.when(v == d, 1)).cast("bigint").alias(f"v{d}") for d in domain])
    total = sum((F.col(f"v{d}") for d in domain[1:]), F.col(f"v{domain[0]}"))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("value"), F.col(f"v{d}").alias("n"),
                 F.round(F.coalesce(F.try_divide(F.col(f"v{d}") * 100.0, total), F.lit(0.0)), 6).alias("pct"))
        for d in domain])))


def label_counts(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Positive count per label (lenient numeric), label order kept in ``position``."""
    labels = labels or LABELS
    dt = _dtypes(df)
    wide = df.agg(*[F.coalesce(F.sum(lenient_int(c, dt[c])), F.lit(0)).cast("bigint").alias(c) for c in labels])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("label"),
                                                   F.col(c).alias("positives"))
                                          for i, c in enumerate(labels)])))


def label_by_ambiguity(df: DataFrame, labels: list[str] | None = None, amb_col: str = "ambuiguity") -> DataFrame:
    """Per label: positives among ambiguous and non-ambiguous rows and their shares.

    Ambiguous means any annotation other than zero, malformed ones (NaN) included; the
    annotated filter runs first.
    """
    labels = labels or LABELS
    dt = _dtypes(df)
    amb = F.coalesce(F.col(amb_col).cast("double") != 0, F.lit(True))
    aggs = []
    for c in labels:
        v = lenient_int(c, dt[c])
        aggs += [F.coalesce(F.sum(F.when(amb, v).otherwise(0)), F.lit(0)).cast("bigint").alias(f"a_{c}"),
                 F.coalesce(F.sum(F.when(~amb, v).otherwise(0)), F.lit(0)).cast("bigint").alias(f"n_{c}")]
    wide = df.agg(*aggs)

    def pct(x, t):
        return F.round(F.coalesce(F.try_divide(x * 100.0, t), F.lit(0.0)), 6)

    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("label"),
                 F.col(f"a_{c}").alias("ambiguous"), F.col(f"n_{c}").alias("non_ambiguous"),
                 (F.col(f"a_{c}") + F.col(f"n_{c}")).alias("total"),
                 pct(F.col(f"a_{c}"), F.col(f"a_{c}") + F.col(f"n_{c}")).alias("ambiguous_pct"),
                 pct(F.col(f"n_{c}"), F.col(f"a_{c}") + F.col(f"n_{c}")).alias("non_ambiguous_pct"))
        for i, c in enumerate(labels)])))
