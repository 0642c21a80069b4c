"""Exact seeded split, batches, dense numbering, class distribution.

A global order over a big table is never computed with a partition-less window (one
task).  Ranks are built in two levels instead:

1. each row gets a bucket that preserves the order (a prefix of its md5 order key, or the
   number of its partition after a range exchange by a unique key);
2. per (group, bucket) row counts form a small table (at most groups x buckets rows, only
   non-empty buckets) whose running sum is each bucket's offset;
3. the rows are joined to their bucket offset on (group, bucket) - a uniform key - and
   numbered inside the bucket with a window partitioned by the same key, so the join's
   shuffle already delivers the window's partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABELS
from ..session import land

_B = "_bucket"


def hash_order_key(seed: int | str, id_col: str = "row_id") -> Column:
    """Seeded pseudo-random order of rows: md5 of 'seed:id' (hex string order)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def _rank_in_buckets(d: DataFrame, by: list[str], order: list[Column], rank_col: str) -> DataFrame:
    counts = d.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    tot = Window.partitionBy(*by)
    offs = counts.select(*by, _B, F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(tot).alias("_group_n"))
    wr = Window.partitionBy(*by, _B).orderBy(*order)
    return (d.join(offs, [*by, _B])
            .withColumn(rank_col, (F.row_number().over(wr) + F.col("_off")).cast("bigint"))
            .drop("_off", _B))


def hash_rank(df: DataFrame, seed: int | str, by: list[str] | None = None, id_col: str = "row_id",
              hex_digits: int = 4, rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group in seeded hash order (ties by id).

    Adds ``rank`` and ``_group_n`` (rows in the group).  ``hex_digits`` hex characters of the
    key give 16**hex_digits buckets (65,536 by default: ~1.5M rows per window task at 1e11
    rows).  The bucket-count table holds only non-empty buckets, so small inputs pay nothing.
    """
    by = list(by or [])
    h = hash_order_key(seed, id_col)
    d = df.withColumn("_h", h).withColumn(_B, F.conv(F.substring(F.col("_h"), 1, hex_digits), 16, 10).cast("int"))
    return _rank_in_buckets(d, by, [F.col("_h"), F.col(id_col)], rank_col).drop("_h")


def ordered_rank(df: DataFrame, order_col: str = "row_id", by: list[str] | None = None,
                 rank_col: str = "rank") -> DataFrame:
    """1-based dense number in ascending order of a unique key, per group.

    The rows are dealt by range of (group, key) to as many partitions as the session shuffles to
    and landed (a job runs when this is called); a partition's number is the bucket.
    """
    by = list(by or [])
    d = land(df.repartitionByRange(*by, order_col).withColumn(_B, F.spark_partition_id()), "ordered")
    return _rank_in_buckets(d, by, [F.col(order_col)], rank_col).drop("_group_n")


def n_valid(n: Column, test_size: float) -> Column:
    """Validation size of a shuffled split: ceil(test_size * n) in double arithmetic."""
    return F.ceil(F.lit(float(test_size)) * n.cast("double")).cast("bigint")


def split_exact(df: DataFrame, test_size: float = 0.15, seed: int = 42, by: list[str] | None = None,
                id_col: str = "row_id") -> DataFrame:
    """Exact-size seeded split per group: the first ceil(test_size*n) rows of the seeded
    order are 'valid', the rest 'train'.  Adds ``rank``, ``split``, ``split_rank``."""
    r = hash_rank(df, seed, by, id_col)
    nv = n_valid(F.col("_group_n"), test_size)
    return (r.withColumn("split", F.when(F.col("rank") <= nv, F.lit("valid")).otherwise(F.lit("train")))
            .withColumn("split_rank", F.when(F.col("rank") <= nv, F.col("rank")).otherwise(F.col("rank") - nv))
            .drop("_group_n"))


def batch_assign(df_split: DataFrame, train_batch_size: int = 16, valid_batch_size: int = 16,
                 epoch: int | None = None, by: list[str] | None = None, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Consecutive batches: batch = floor((split_rank - 1) / size).

    Without ``epoch`` batches follow the split order.  With one, training rows are put in a new
    seeded order for every epoch (``split_rank`` is that order's rank); validation rows stay.
    """
    if epoch is not None:
        train = df_split.filter(F.col("split") == "train").drop("split_rank")
        train = hash_rank(train, f"{seed}:{epoch}", by, id_col, rank_col="split_rank").drop("_group_n")
        df_split = df_split.filter(F.col("split") != "train").unionByName(train.select(df_split.columns))
    size = F.when(F.col("split") == "valid", F.lit(valid_batch_size)).otherwise(F.lit(train_batch_size))
    return df_split.withColumn("batch_id", F.floor((F.col("split_rank") - 1) / size).cast("bigint"))


# Fixed primes: each is above 2^16, so four of them can't all divide a number below 2^64.
EPOCH_PRIMES = [65_537, 131_101, 262_147, 524_309, 786_433, 917_519, 1_048_573]


def epoch_order(rank0: Column, n: Column, epoch: int, seed: int = 42) -> Column:
    """A new order of 0..n-1 for every epoch, row by row: no exchange and no sort.

    ``x -> (p * x + s) mod n`` is a bijection of 0..n-1 when p and n have no common divisor; p is the
    first prime in the epoch's turn that does not divide n, and such a one is among any four.  The
    ranks come in a seeded hash order already; this deals them anew.  Ranks must be below 2^43.
    """
    turn = [EPOCH_PRIMES[(seed + epoch + k) % len(EPOCH_PRIMES)] for k in range(4)]
    p = F.lit(turn[-1]).cast("bigint")
    for q in reversed(turn[:-1]):
        p = F.when(n % q != 0, F.lit(q).cast("bigint")).otherwise(p)
    shift = (seed * 7_919 + epoch * 104_729) % 2**31
    return ((rank0.cast("bigint") * p + F.lit(shift)) % n).cast("bigint")


def epoch_batch(df: DataFrame, n: Column, batch_size: int, epoch: int, seed: int = 42) -> DataFrame:
    """Adds ``batch`` and ``place`` (in the batch) of a row with 1-based dense ``split_rank`` among ``n``."""
    at = epoch_order(F.col("split_rank") - 1, n, epoch, seed)
    return df.withColumns({"batch": F.floor(at / batch_size).cast("bigint"), "place": (at % batch_size).cast("bigint")})


def class_distribution(df_split: DataFrame, labels: list[str] | None = None,
                       by: list[str] | None = None) -> DataFrame:
    """Positives per label in the train and validation parts: (group, split, label, positives)."""
    labels = labels or LABELS
    by = list(by or [])
    wide = df_split.groupBy(*by, "split").agg(*[F.sum(F.col(c)).cast("bigint").alias(c) for c in labels])
    return wide.select(*by, "split", F.inline(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).alias("positives")) for c in labels])))
