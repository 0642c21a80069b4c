"""Loss analytics: early-stop trace, best epoch, BCE losses, sigmoid scores.

A history table is ``(experiment, epoch, train_loss, valid_loss)``; a group holds at most the
configured number of epochs, so a window over one experiment is small however many
experiments there are.  Training continues while the validation loss is not above the best
so far (ties continue and re-save); the first worse epoch is recorded and ends the run.  A NaN
loss counts as worse, also in the first epoch: nothing is saved then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import bce_with_logits, sigmoid
from ..session import land
from .split import hash_rank


def early_stop_trace(history: DataFrame, keys=("experiment",), max_epochs: int | None = None) -> DataFrame:
    """Per epoch: best loss before it, whether it was worse, whether it ran and was saved."""
    keys = list(keys)
    h = history if max_epochs is None else history.filter(F.col("epoch") <= max_epochs)
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    t = h.withColumn("best_before", F.min("valid_loss").over(before)) \
        .withColumn("is_worse", F.coalesce(F.isnan("valid_loss") | (F.col("valid_loss") > F.col("best_before")),
                                           F.isnan("valid_loss"), F.lit(False)))
    t = t.withColumn("ran", F.coalesce(F.max(F.col("is_worse").cast("int")).over(before), F.lit(0)) == 0)
    return t.withColumn("saved", F.col("ran") & ~F.col("is_worse"))


def best_epoch(history: DataFrame, keys=("experiment",), max_epochs: int | None = None) -> DataFrame:
    """Per experiment: epochs run, the reloaded (last saved) epoch and its losses."""
    keys = list(keys)
    t = early_stop_trace(history, keys, max_epochs).filter("ran")
    best = F.max(F.when(F.col("saved"), F.struct("epoch", "valid_loss", "train_loss")))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("epochs_run"), best.alias("_b"),
                                F.max(F.col("is_worse").cast("int")).alias("_stopped")) \
        .select(*keys, "epochs_run", F.col("_b.epoch").alias("best_epoch"),
                F.col("_b.valid_loss").alias("best_valid_loss"), F.col("_b.train_loss").alias("best_train_loss"),
                (F.col("_stopped") == 1).alias("stopped_early"))


def sigmoid_scores(logits: DataFrame, x_col: str = "x") -> DataFrame:
    """Probabilities from logits."""
    return logits.withColumn("p", sigmoid(F.col(x_col)))


def bce_loss(logits: DataFrame, keys=None) -> DataFrame:
    """Mean BCE-with-logits over all cells."""
    keys = list(keys or [])
    return logits.groupBy(*keys).agg(F.avg(bce_with_logits("x", "y")).alias("bce"),
                                     F.count(F.lit(1)).cast("bigint").alias("cells"))


def bce_batch_mean(logits: DataFrame, batch_size: int = 16, seed: int = 42, keys=None) -> DataFrame:
    """Epoch loss as the mean of per-batch mean losses (a short last batch weighs as much
    as a full one); batches are consecutive rows of the seeded order.

    Cells are reduced to one row per sentence (loss sum, cell count) first and that table is
    landed (the two-level rank reads it twice); the rank and the batches work on it, so the
    cells are scanned once and never joined back."""
    keys = list(keys or [])
    rows = land(logits.groupBy(*keys, "row_id").agg(F.sum(bce_with_logits("x", "y")).alias("_loss"),
                                                   F.count(F.lit(1)).alias("_cells")), "loss_rows")
    ranked = hash_rank(rows, seed, keys).withColumn(
        "batch_id", F.floor((F.col("rank") - 1) / batch_size).cast("bigint"))
    per_batch = ranked.groupBy(*keys, "batch_id").agg((F.sum("_loss") / F.sum("_cells")).alias("batch_loss"))
    return per_batch.groupBy(*keys).agg(F.avg("batch_loss").alias("bce_batch_mean"),
                                        F.count(F.lit(1)).cast("bigint").alias("batches"))
