"""Casts with the null semantics of a pandas workflow, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NA_TOKENS, NUMBER_RE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """CSV NA tokens (pandas defaults) become NULL; other text is kept as is."""
    c = _c(c)
    return F.when(~F.coalesce(c.isin(NA_TOKENS), F.lit(True)), c)


def _number_text(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER_RE, 1)


def lenient_int(c, dtype: T.DataType | None = None) -> Column:
    """A BIGINT whatever the value: numbers are truncated toward zero, everything else is 0.

    Not a number are NULL, NaN, infinities, text that is not a plain decimal number (also
    Spark-only forms like '1.0d', '1f') and numbers beyond 64 bits.
    """
    c = _c(c)
    if dtype is None or isinstance(dtype, T.StringType):
        num = _number_text(c.cast("string"))
        c = F.when(num != "", num)
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)).try_cast("bigint"), F.lit(0).cast("bigint"))


def strict_int(c, name: str = "label", dtype: T.DataType | None = None) -> Column:
    """A BIGINT: numbers are truncated, NULL or malformed text raises."""
    c = _c(c)
    msg = F.lit(f"cannot convert non-finite or malformed value of '{name}' to int")
    if dtype is not None and isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.coalesce(c.cast("bigint"), F.raise_error(msg).cast("bigint"))
    num = _number_text(c.cast("string"))
    return F.when(F.coalesce(num != "", F.lit(False)), num.cast("double").cast("bigint")) \
        .otherwise(F.raise_error(msg).cast("bigint"))


def safe_div(a, b) -> Column:
    """a / b, 0.0 on a zero (or NULL) denominator."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))
