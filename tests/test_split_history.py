"""Exact split sizes and properties; early stop and best epoch; BCE losses."""
import math

import pytest
from pyspark.sql import functions as F

from labelbench.operators import history as hs, split as sp


@pytest.mark.parametrize("n", [1, 6, 7, 20, 100, 1000])
def test_split_sizes_exact_disjoint_complete(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("experiment", F.lit("e"))
    s = sp.split_exact(df, 0.15, 42, by=["experiment"]).collect()
    n_val = math.ceil(0.15 * n)
    assert sum(r.split == "valid" for r in s) == n_val
    assert sorted(r.row_id for r in s) == list(range(n))
    assert sorted(r.rank for r in s) == list(range(1, n + 1))


def test_split_stable_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id").withColumn("experiment", F.lit("e"))
    a = {r.row_id: r.split for r in sp.split_exact(df, 0.15, 42, ["experiment"]).collect()}
    b = {r.row_id: r.split for r in sp.split_exact(df.repartition(13), 0.15, 42, ["experiment"]).collect()}
    assert a == b


def test_hash_rank_equals_global_row_number(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    got = {r.row_id: r.rank for r in sp.hash_rank(df, 42).collect()}
    ref = df.withColumn("h", sp.hash_order_key(42)).orderBy("h", "row_id").collect()
    assert [got[r.row_id] for r in ref] == list(range(1, 1001))


def test_ordered_rank_is_reset_index(spark):
    df = spark.createDataFrame([(i * 7 + 3,) for i in range(300)], "row_id long")
    got = sorted((r.row_id, r.rank) for r in sp.ordered_rank(df).collect())
    assert [r for _, r in got] == list(range(1, 301))


def test_batches(spark):
    df = spark.range(40).withColumnRenamed("id", "row_id").withColumn("experiment", F.lit("e"))
    b = sp.batch_assign(sp.split_exact(df, 0.15, 42, ["experiment"]), 16, 4).collect()
    val = sorted((r.split_rank, r.batch_id) for r in b if r.split == "valid")
    assert [x[1] for x in val] == [0, 0, 0, 0, 1, 1]
    train = [r.batch_id for r in b if r.split == "train"]
    assert sorted(set(train)) == [0, 1, 2] and train.count(2) == 2


def test_epoch_batches_reshuffle_training_rows(spark):
    df = sp.split_exact(spark.range(60).withColumnRenamed("id", "row_id").withColumn("experiment", F.lit("e")), 0.2, 42, ["experiment"])
    one, two = ({r.row_id: (r.split, r.split_rank) for r in sp.batch_assign(df, 16, 4, epoch=e, by=["experiment"]).collect()} for e in (1, 2))
    assert {k for k, v in one.items() if v[0] == "valid" and two[k] == v} == {k for k, v in one.items() if v[0] == "valid"}
    train = [k for k, v in one.items() if v[0] == "train"]
    assert sorted(one[k][1] for k in train) == sorted(two[k][1] for k in train) == list(range(1, 49))
    assert sum(one[k] != two[k] for k in train) > 24


def test_nan_in_the_first_epoch_stops(spark):
    r = hs.best_epoch(_hist(spark, [float("nan"), .5])).first()
    assert r.epochs_run == 1 and r.best_epoch is None and r.stopped_early


def _hist(spark, losses):
    return spark.createDataFrame([("e", i + 1, 0.0, v) for i, v in enumerate(losses)],
                                 "experiment string, epoch int, train_loss double, valid_loss double")


@pytest.mark.parametrize("losses,run,best", [([.6, .5, .5, .55, .4], 4, 3), ([.5, .6, .4], 2, 1), ([.7], 1, 1),
                                             ([.5, .4, .3, .2, .1], 5, 5)])
def test_early_stop_best_epoch(spark, losses, run, best):
    r = hs.best_epoch(_hist(spark, losses)).first()
    assert (r.epochs_run, r.best_epoch) == (run, best)
    assert r.stopped_early == (run < len(losses) or losses[run - 1] > min(losses[: run - 1] or [math.inf]))


def test_bce_and_batch_mean(spark):
    import numpy as np
    xs = np.linspace(-800, 800, 37)
    rows = [(i // 2, f"l{i % 2}", i % 3 % 2, float(x)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "row_id long, label string, y int, x double")
    bce = hs.bce_loss(df).first().bce
    ref = np.mean([max(x, 0) - x * y + np.log1p(np.exp(-abs(x))) for _, _, y, x in rows])
    assert bce == pytest.approx(ref, rel=1e-12)
    assert math.isfinite(hs.bce_batch_mean(df, 4).first().bce_batch_mean)
