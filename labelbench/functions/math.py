"""Numeric helpers: sigmoid and the numerically stable BCE-with-logits element loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x) -> Column:
    x = _c(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x, y) -> Column:
    """max(x,0) - x*y + log(1 + exp(-|x|)); finite for any logit."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
