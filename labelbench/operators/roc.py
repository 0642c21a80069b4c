"""ROC curves and areas per label, micro (all cells pooled) and macro (mean curve on a grid).

Scale design - there are only a few labels, so nothing is windowed over a whole label:

* cells are pre-aggregated to one row per (group, label, distinct score) with positive and
  negative counts (partial aggregation; a hot score collapses to one row), dealt by range of
  (group, label, falling score) to as many partitions as the session shuffles to, and landed:
  the cells are scanned once, and a partition's number is the bucket of its rows.  A range holds
  as many distinct scores as any other, however the scores crowd and whichever label they are of;
* cumulative counts in descending score order are two-level prefix sums: a window runs inside
  one (group, label, bucket), and the bucket totals (a row each) give the offsets;
* the area is an exact integer sum, sum(neg * (2 * tps - pos)) / (2 * P * N).  It needs no curve
  points: with offset o of a bucket, its part is sum(neg * (2 * run - pos)) + 2 * o * sum(neg),
  so the windowed rows are reduced to one row per bucket at once;
* the macro curve needs, for every grid value x, the last curve point with fpr <= x and
  the first with fpr > x.  Each point knows the first grid index g with x_g >= fpr, so both
  are a max / min grouped by (group, label, g) - at most 100 rows per label - followed by
  running max / min over those tiny tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ROC_GRID_POINTS
from ..session import land

MICRO = "micro"
MACRO = "macro"
_B = "_bucket"


def _k(keys) -> list[str]:
    return list(keys or [])


def score_counts(pred: DataFrame, keys=None, micro: bool = True) -> DataFrame:
    """(keys, label, p, pos, neg): one row per distinct score of a label (+ 'micro')."""
    keys = _k(keys)
    agg = pred.groupBy(*keys, "label", "p").agg(
        F.count(F.when(F.col("y") > 0, 1)).cast("bigint").alias("pos"),
        F.count(F.when(~(F.col("y") > 0), 1)).cast("bigint").alias("neg"))
    if not micro:
        return agg
    pooled = agg.groupBy(*keys, "p").agg(F.sum("pos").cast("bigint").alias("pos"),
                                         F.sum("neg").cast("bigint").alias("neg")) \
        .withColumn("label", F.lit(MICRO))
    return agg.unionByName(pooled)


def ranged_counts(pred: DataFrame | None, keys=None, micro: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """The score table dealt into buckets of falling scores, landed (a job runs when this is called)."""
    keys = _k(keys)
    c = counts if counts is not None else score_counts(pred, keys, micro)
    if _B in c.columns:
        return c
    return land(c.repartitionByRange(*keys, "label", F.desc("p")).withColumn(_B, F.spark_partition_id()), "roc_counts")


def _offsets(per_bucket: DataFrame, grp: list[str]) -> DataFrame:
    """Counts before each bucket and in its whole group; one row per bucket in and out."""
    before = Window.partitionBy(*grp).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*grp)
    return per_bucket.withColumns({
        "_po": F.coalesce(F.sum("_bp").over(before), F.lit(0)), "_no": F.coalesce(F.sum("_bn").over(before), F.lit(0)),
        "n_pos": F.sum("_bp").over(whole), "n_neg": F.sum("_bn").over(whole)})


def roc_points(pred: DataFrame | None, keys=None, micro: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Curve points in descending score order, ties merged, starting at (0, 0):
    (keys, label, threshold, tps, fps, fpr, tpr, pos, neg, n_pos, n_neg).  ``threshold`` is NULL at the
    start point; fpr / tpr are NULL for a label without negatives / positives.  Lands the score
    table when called unless it is given (``ranged_counts``)."""
    keys = _k(keys)
    grp = [*keys, "label"]
    c = ranged_counts(pred, keys, micro, counts)
    offs = _offsets(c.groupBy(*grp, _B).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn")), grp)
    run = Window.partitionBy(*grp, _B).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    pts = (c.join(offs.drop("_bp", "_bn"), [*grp, _B])
           .select(*grp, F.col("p").alias("threshold"),
                   (F.col("_po") + F.sum("pos").over(run)).cast("bigint").alias("tps"),
                   (F.col("_no") + F.sum("neg").over(run)).cast("bigint").alias("fps"),
                   "pos", "neg", "n_pos", "n_neg"))
    zero = F.lit(0).cast("bigint")
    start = offs.groupBy(*grp).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg")) \
        .select(*grp, F.lit(None).cast("double").alias("threshold"), zero.alias("tps"), zero.alias("fps"),
                zero.alias("pos"), zero.alias("neg"), "n_pos", "n_neg")
    return pts.unionByName(start).withColumns({
        "fpr": F.col("fps").cast("double") / F.when(F.col("n_neg") > 0, F.col("n_neg").cast("double")),
        "tpr": F.col("tps").cast("double") / F.when(F.col("n_pos") > 0, F.col("n_pos").cast("double")),
    })


def roc_points_reduced(pred: DataFrame | None, keys=None, micro: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """The curve's corners: ``roc_points`` without those that lie on a straight line between their neighbours.

    A point stays unless the step to it and the step from it have the same direction, which the
    counts tell exactly.  The step behind a bucket's last point is the next bucket's first; a row per
    bucket carries it over the border.  The area under the corners is that under all points, and scores
    that differ along a straight run give the same corners as if they were tied.
    """
    keys = _k(keys)
    grp = [*keys, "label"]
    c = ranged_counts(pred, keys, micro, counts)
    step = F.struct("pos", "neg")
    per = c.groupBy(*grp, _B).agg(F.max_by(step, "p").alias("_first"))
    per = per.select(*grp, _B, F.lead("_first").over(Window.partitionBy(*grp).orderBy(_B)).alias("_behind"))
    inside = Window.partitionBy(*grp, _B).orderBy(F.desc("p"))
    steps = c.join(per, [*grp, _B]).select(*grp, F.col("p").alias("threshold"), "pos", "neg",
                                           F.coalesce(F.lead(step).over(inside), F.col("_behind")).alias("_next"))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    corner = F.col("_next").isNull() | (wide("pos") * wide("_next.neg") != wide("neg") * wide("_next.pos"))
    points = roc_points(None, keys, counts=c)
    kept = points.join(steps.filter(corner).select(*grp, "threshold"), [*grp, "threshold"])
    return kept.select(points.columns).unionByName(points.filter(F.col("threshold").isNull()))


def roc_auc(pred: DataFrame | None, keys=None, micro: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Trapezoid area per label (and micro) from exact integer sums: (keys, label, auc)."""
    keys = _k(keys)
    grp = [*keys, "label"]
    c = ranged_counts(pred, keys, micro, counts)
    run = Window.partitionBy(*grp, _B).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    big = lambda x: x.cast("decimal(38,0)")
    part = c.withColumn("_run", F.sum("pos").over(run)).groupBy(*grp, _B).agg(
        F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"), F.sum(big(F.col("neg")) * big(2 * F.col("_run") - F.col("pos"))).alias("_in"))
    s = _offsets(part, grp).groupBy(*grp).agg(
        F.sum(F.col("_in") + big(2 * F.col("_po")) * big(F.col("_bn"))).alias("_a2"),
        F.first("n_pos").alias("_np"), F.first("n_neg").alias("_nn"))
    return s.select(*grp, (F.col("_a2").cast("double")
                           / F.when((F.col("_np") > 0) & (F.col("_nn") > 0),
                                    F.lit(2.0) * F.col("_np").cast("double") * F.col("_nn").cast("double"))).alias("auc"))


def grid_value(k: Column, n: int = ROC_GRID_POINTS) -> Column:
    """linspace(0, 1, n)[k]: k * (1 / (n - 1)), the last point exactly 1."""
    return F.when(k == n - 1, F.lit(1.0)).otherwise(k.cast("double") * F.lit(1.0 / (n - 1)))


def _first_grid_at_or_above(fpr: Column, n: int = ROC_GRID_POINTS) -> Column:
    c = F.least(F.greatest(F.floor(fpr * (n - 1)), F.lit(0)), F.lit(n - 1))
    return (F.when((c >= 1) & (grid_value(c - 1, n) >= fpr), c - 1)
            .when(grid_value(c, n) >= fpr, c).otherwise(c + 1)).cast("int")


def roc_macro_curve(pred: DataFrame | None, keys=None, counts: DataFrame | None = None,
                    n: int = ROC_GRID_POINTS) -> DataFrame:
    """Macro curve: mean over labels of each label's TPR linearly interpolated at
    linspace(0, 1, n) (at equal fpr the last, highest point counts).  (keys, k, fpr, tpr);
    tpr is NULL when a label has no positives or no negatives."""
    keys = _k(keys)
    grp = [*keys, "label"]
    c = ranged_counts(pred, keys, micro=False, counts=counts)
    pts = roc_points(None, keys, counts=c.filter(F.col("label") != MICRO))
    # NULL for a label without positives or negatives: its groups stay (so the label stays in
    # the mean and makes it NULL) and the grid comes from this small table, not from the points
    pt = F.when(F.col("fpr").isNotNull() & F.col("tpr").isNotNull(), F.struct(F.col("fpr"), F.col("tpr")))
    per_g = (pts.withColumn("k", F.coalesce(_first_grid_at_or_above(F.col("fpr"), n), F.lit(0)))
             .groupBy(*grp, "k").agg(F.max(pt).alias("a"), F.min(pt).alias("b")))
    grid = (per_g.select(*grp).distinct()
            .select(*grp, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")))
    g = grid.join(per_g, [*grp, "k"], "left")
    upto = Window.partitionBy(*grp).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*grp).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    g = g.select(*grp, "k", F.max("a").over(upto).alias("A"), F.min("b").over(after).alias("B"))
    x = grid_value(F.col("k"), n)
    ax, ay, bx, by = F.col("A.fpr"), F.col("A.tpr"), F.col("B.fpr"), F.col("B.tpr")
    interp = (F.when(F.col("A").isNull(), F.lit(None).cast("double"))
              .when(F.col("B").isNull() | (ax == x), ay)
              .otherwise((by - ay) / (bx - ax) * (x - ax) + ay))
    per_label = g.select(*grp, "k", interp.alias("t"))
    return per_label.groupBy(*keys, "k").agg(
        F.when(F.count("t") == F.count(F.lit(1)), F.avg("t")).alias("tpr")) \
        .withColumn("fpr", grid_value(F.col("k"), n)).select(*keys, "k", "fpr", "tpr")


def roc_auc_macro(pred: DataFrame | None, keys=None, curve: DataFrame | None = None) -> DataFrame:
    """Area of the macro curve (not the mean of label areas): (keys, label='macro', auc)."""
    keys = _k(keys)
    cv = curve if curve is not None else roc_macro_curve(pred, keys)
    nxt = Window.partitionBy(*keys).orderBy("k")  # <= 100 rows per group
    seg = cv.select(*keys, "k", ((F.lead("fpr").over(nxt) - F.col("fpr"))
                                 * (F.col("tpr") + F.lead("tpr").over(nxt)) / 2).alias("s"),
                    F.col("tpr").isNull().alias("_null"))
    return seg.groupBy(*keys).agg(
        F.when(F.max(F.col("_null").cast("int")) == 0, F.sum("s")).alias("auc")).withColumn("label", F.lit(MACRO)) \
        .select(*keys, "label", "auc")


def roc_summary(pred: DataFrame, keys=None) -> DataFrame:
    """Areas per label, micro and macro in one table, from one landed score table."""
    keys = _k(keys)
    c = ranged_counts(pred, keys, micro=True)
    return roc_auc(None, keys, counts=c).unionByName(
        roc_auc_macro(None, keys, curve=roc_macro_curve(None, keys, counts=c)))
