"""Mixing sources to target weights along a time-varying curriculum (native).

Every source is a stream of its documents in md5 order, repeated as often as its target asks
for, and cut exactly at the target, so at most one document of a source is taken in part.
Each source has a weight schedule over training time; its integral says which share of the
source's words has been consumed by time t, so the inverse of that integral gives every
document the time at which it is trained on.

Running sums are two-level: sums per (source, md5 bucket) with their own running sums, and a
window inside (source, bucket).  A source holding a third of all rows is spread over all buckets.
There are about as many buckets as rows in a bucket, so neither window grows beyond the square
root of the table (up to 65,536 buckets).  The window runs over cells of rows with one id and size
in one landed partition, so an id that a third of all rows share, or none, is few rows of one
window.  No text is shuffled for the plan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land
from .common import SPACES, as_docs, n_words, numbered

WEIGHTS = (3, 1, 2)
# weight of a source over training time, at evenly spaced knots with straight lines between:
# level, falling, rising; dealt to the sources in turn like the weights
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
MAX_HEX = 4


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_rank, source_size, target): one row per source.

    The pool is ``share`` times all sizes, dealt by weight; a source above ``cap`` times its own
    size stops there and its excess is dealt again.  Ordered by cap / weight the stopped sources
    come first, so one running sum finds the level at which none is above.  The windows without
    partition run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                       (F.col("source_rank") % len(weights) + 1).cast("int")).cast("bigint"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), "source_rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
    s = s.withColumn("left_w", F.sum("w").over(after))
    s = s.withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
    pool = F.col("all_size") * F.lit(float(share)) - F.col("capped")
    over = F.lit(cap) * F.col("source_size") * F.col("left_w") <= F.col("w") * pool
    s = s.withColumn("over", over).withColumn("level_num", pool)
    # the first source that is not stopped fixes the level of all that follow
    first = F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("w"), "source_rank", "level_num", "left_w"))
                  ).over(Window.partitionBy())
    s = s.withColumn("first", first)
    target = F.when(F.col("over") | F.col("first").isNull(), (cap * F.col("source_size")).cast("double")) \
        .otherwise(F.col("w") * F.col("first.level_num") / F.col("first.left_w"))
    return s.select("source", "source_rank", "source_size", target.alias("target"))


def _time_of(share: Column, rank: Column, schedules) -> Column:
    """Inverse of the integral of a source's schedule: the time in 0..1 by which ``share`` of its words are used."""
    out = None
    for k, knots in reversed(list(enumerate(schedules))):
        n = len(knots) - 1
        areas = [(knots[i] + knots[i + 1]) / 2 / n for i in range(n)]
        demand = share * F.lit(float(sum(areas)))
        time, done = F.lit(1.0), sum(areas)
        for i in reversed(range(n)):
            done -= areas[i]
            a, b = float(knots[i]), float(knots[i + 1])
            # a * x + (b - a) * n * x^2 / 2 = rest, solved without cancellation
            rest = F.greatest(demand - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.lit(a * a) + F.lit(2 * (b - a) * n) * rest)
            x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(a) + root))
            time = F.when(demand >= F.lit(done), F.lit(i / n) + F.least(x, F.lit(1.0 / n))).otherwise(time) if i else \
                F.when(demand < F.lit(areas[0] if n > 1 else float("inf")), x).otherwise(time)
        out = time if out is None else F.when(rank % len(schedules) == k, time).otherwise(out)
    return F.round(out, 9)


def mix_plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, cap: int = 2,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: what the mix takes of it, and when.

    ``size`` words, ``source_size`` and ``target`` of its source, ``taken`` words in all, of
    which ``taken_1`` in the first pass over the source and ``taken_2`` in the second, at
    training times ``position`` and ``position_2`` (null: not taken).  Rows are range-sorted by
    ``position``.  Null text and text without words: size 0, taken 0.  Null source: a source of
    its own, last.  Null or repeated doc_id: rows are treated one by one, by size; rows of one source, id and
    size are interchangeable.  A text of any length is one number here.  An empty table gives no row.
    """
    if cap != 2:
        raise ValueError("the plan has columns for two passes")
    sizes = as_docs(docs, "doc_id", "source", "text", *carry).select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"),
                                                                      F.monotonically_increasing_id().alias("mix_no"))
    sizes = land(sizes.withColumn("salt", F.spark_partition_id()), "mix-sizes")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    digits = min(max(round(math.log(max(sizes.count(), 1), 16) / 2), 1), MAX_HEX)
    rows = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    t = source_targets(sizes, weights, share, cap)
    per = per.join(t.withColumnRenamed("source", "source_t"), F.col("source").eqNullSafe(F.col("source_t"))) \
        .select(F.col("source").alias("source_b"), F.col("bucket").alias("bucket_b"), "base", "source_rank", "source_size", "target")
    # rows of one id and size, counted per landed partition: a repeated id is as many cells as it has sizes there
    cells = rows.groupBy("source", "bucket", "key", "doc_id", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[F.col(c).alias(f"{c}_c") for c in ("source", "key", "doc_id", "size", "salt")],
                         F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)).alias("before_cell"))
    alike = Window.partitionBy("source", "key", "doc_id", "size", "salt").orderBy("mix_no")
    rows = rows.withColumn("nth", F.row_number().over(alike) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in ("source", "key", "doc_id", "size", "salt")]
    # about as many cells as rows, with keys of 32 characters: more than Spark takes them for, so never broadcast
    rows = rows.join(cells.hint("merge"), reduce(and_, same)).withColumn("before", F.col("before_cell") + F.col("nth") * F.col("size"))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("source_b")) & (F.col("bucket") == F.col("bucket_b")))
    start = F.col("base") + F.col("before")
    goal = F.floor(F.col("target") + 0.5)
    took = lambda room: F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("bigint")
    rows = rows.withColumn("start", start).withColumn("goal", goal)
    rows = rows.withColumn("taken_1", took(F.col("goal") - F.col("start")))
    rows = rows.withColumn("taken_2", took(F.col("goal") - F.col("source_size") - F.col("start")))
    when = lambda col, at: F.when(F.col(col) > 0, _time_of(at / F.col("goal"), F.col("source_rank"), schedules))
    out = rows.select("doc_id", *carry, "size", "source_size", "target", (F.col("taken_1") + F.col("taken_2")).alias("taken"),
                      "taken_1", "taken_2", when("taken_1", F.col("start")).alias("position"),
                      when("taken_2", F.col("start") + F.col("source_size")).alias("position_2"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, n being 1 at least (fewer words: the whole text)."""
    ends = F.split(text, f"(?<=[^{SPACES}])(?=[{SPACES}])")  # cut behind every word
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training order: the taken documents with the columns they came with, once per pass.

    Documents are range-sorted by training position; the one document of a source at which its
    target is reached is cut after the last word taken.  A document that the mix does not take
    is left out, one taken twice comes twice.
    """
    rows = numbered(docs)
    plan = mix_plan(rows.select("row_no", "row.doc_id", "row.source", "row.text"), carry=("row_no",), **options)
    takes = plan.select("row_no", "size", F.inline(F.array(
        F.struct(F.col("taken_1").alias("taken_now"), F.col("position").alias("at")),
        F.struct(F.col("taken_2").alias("taken_now"), F.col("position_2").alias("at"))))).filter("taken_now > 0")
    cut = F.when(F.col("taken_now") < F.col("size"), first_words(F.col("row.text"), F.col("taken_now"))).otherwise(F.col("row.text"))
    out = takes.join(rows, "row_no").withColumn("cut", cut)
    cols = [F.col("cut").alias("text") if c == "text" else F.length("cut").cast("bigint").alias(c) if c == "n_chars"
            else F.col(f"row.`{c}`") for c in docs.columns]
    return out.orderBy("at", "row_no").select(*cols)
