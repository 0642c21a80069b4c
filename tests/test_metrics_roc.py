"""Metric edge cases and a numpy cross-check of the ROC curves and areas."""
import random

import numpy as np
import pytest

from labelbench.operators import metrics as mt, roc


def _pred(spark, Y, P, labels=None):
    labels = labels or [f"l{j}" for j in range(Y.shape[1])]
    rows = [(i, labels[j], int(Y[i, j]), float(P[i, j])) for i in range(Y.shape[0]) for j in range(Y.shape[1])]
    return spark.createDataFrame(rows, "row_id long, label string, y int, p double")


def test_threshold_comparators(spark):
    Y = np.array([[1, 0], [0, 1]])
    P = np.array([[0.2, 0.2 - 1e-9], [0.2 + 1e-9, 0.2]])
    df = _pred(spark, Y, P, ["compute", "network"])
    ge = {(r.row_id, r.label): r.yhat for r in mt.binarize(df).collect()}
    assert ge == {(0, "compute"): 1, (0, "network"): 0, (1, "compute"): 1, (1, "network"): 1}
    ll = {r.row_id: r.predicted_labels for r in mt.label_lists(df).collect()}
    assert ll == {0: [], 1: ["compute"]}  # strict > for sentence results


def test_degenerate_labels_zero_filled(spark):
    Y = np.array([[0, 1, 0], [0, 1, 0], [0, 1, 1]])
    P = np.array([[0.1, 0.9, 0.0], [0.3, 0.1, 0.1], [0.0, 0.8, 0.9]])
    df = _pred(spark, Y, P)
    conf = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in mt.per_label_confusion(df).collect()}
    assert conf == {"l0": (0, 1, 0, 2), "l1": (2, 0, 1, 0), "l2": (1, 0, 0, 2)}
    rep = {r.row_name: r for r in mt.classification_report(df, labels=["l0", "l1", "l2"]).collect()}
    assert rep["l0"].precision == 0.0 and rep["l0"].recall == 0.0 and rep["l0"].support == 0
    assert rep["micro avg"].precision == pytest.approx(3 / 4)
    bc = {(r.true_req, r.pred_req): r.n for r in mt.binary_confusion(df).collect()}
    assert bc == {(False, False): 0, (False, True): 0, (True, False): 0, (True, True): 3}
    auc = {r.label: r.auc for r in roc.roc_auc(df).collect()}
    assert auc["l0"] is None and auc["l1"] is None  # one class only
    assert roc.roc_auc_macro(df).first().auc is None


def test_samples_average_empty_rows_score_zero(spark):
    Y = np.array([[0, 0], [1, 0]])
    P = np.array([[0.0, 0.0], [0.9, 0.9]])
    r = mt.report_samples_avg(_pred(spark, Y, P)).first()
    assert (r.precision, r.recall, r.f1_score) == pytest.approx((0.25, 0.5, 1 / 3))


def _np_roc(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps, fps = np.cumsum(y)[idx], np.cumsum(1 - y)[idx]
    tps, fps = np.r_[0, tps], np.r_[0, fps]
    return fps / fps[-1], tps / tps[-1]


def test_roc_matches_numpy(spark):
    rng = np.random.default_rng(7)
    n, L = 400, 4
    Y = (rng.random((n, L)) < 0.3).astype(int)
    P = np.round(np.clip(0.35 * Y + rng.random((n, L)) * 0.7, 0, 1), 2)  # many ties
    df = _pred(spark, Y, P)
    aucs = {r.label: r.auc for r in roc.roc_auc(df).collect()}
    grid = np.linspace(0, 1, 100)
    mean_tpr = np.zeros_like(grid)
    for j in range(L):
        f, t = _np_roc(Y[:, j], P[:, j])
        assert aucs[f"l{j}"] == pytest.approx(np.trapezoid(t, f), abs=1e-12)
        mean_tpr += np.interp(grid, f, t)
    mean_tpr /= L
    f, t = _np_roc(Y.ravel(), P.ravel())
    assert aucs["micro"] == pytest.approx(np.trapezoid(t, f), abs=1e-12)
    curve = sorted((r.k, r.tpr) for r in roc.roc_macro_curve(df).collect())
    assert np.allclose([c[1] for c in curve], mean_tpr, atol=1e-12)
    assert roc.roc_auc_macro(df).first().auc == pytest.approx(np.trapezoid(mean_tpr, grid), abs=1e-12)
    # ranks: micro area equals the Mann-Whitney statistic
    y, s = Y.ravel(), P.ravel()
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (pos.size * neg.size)
    assert aucs["micro"] == pytest.approx(mw, abs=1e-12)


def test_metrics_independent_of_shuffle_partitions(spark):
    rng = np.random.default_rng(3)
    Y = (rng.random((200, 3)) < 0.4).astype(int)
    P = np.round(rng.random((200, 3)), 3)
    df = _pred(spark, Y, P)
    a = sorted(tuple(r) for r in mt.classification_report(df, labels=["l0", "l1", "l2"]).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(tuple(r) for r in mt.classification_report(df.repartition(5), labels=["l0", "l1", "l2"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[2:] == pytest.approx(y[2:], abs=1e-12)


def test_confusion_cells_add_up(spark):
    rng = np.random.default_rng(11)
    Y = (rng.random((150, 6)) < 0.25).astype(int)
    P = np.round(rng.random((150, 6)), 3)
    conf = mt.per_label_confusion(_pred(spark, Y, P)).collect()
    assert len(conf) == 6 and all(r.tp + r.fp + r.fn + r.tn == 150 for r in conf)
    bc = mt.binary_confusion(_pred(spark, Y, P)).collect()
    assert sum(r.n for r in bc) == 150


def test_crowded_scores_spread_over_buckets(spark):
    # a model's scores crowd near 0: fixed-width buckets would put them all in one window task
    rng = np.random.default_rng(5)
    n = 3000
    Y = (rng.random((n, 1)) < 0.2).astype(int)
    P = np.where(Y == 1, rng.random((n, 1)) * 1e-3 + 5e-4, rng.random((n, 1)) * 1e-3)
    df = _pred(spark, Y, P)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would go to one partition
    try:
        counts = roc.ranged_counts(df, micro=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_bucket = [r["count"] for r in counts.groupBy("_bucket").count().collect()]
    assert len(per_bucket) == 8 and max(per_bucket) < 2 * n / 8
    assert {r.label: r.auc for r in roc.roc_auc(None, counts=counts).collect()} == {r.label: r.auc for r in roc.roc_auc(df, micro=False).collect()}
    f, t = _np_roc(Y[:, 0], P[:, 0])
    auc = {r.label: r.auc for r in roc.roc_auc(df).collect()}
    assert auc["l0"] == pytest.approx(np.trapezoid(t, f), abs=1e-12)


def test_reduced_curve_keeps_the_area_and_ignores_ties_on_straight_runs(spark):
    random.seed(4)
    cells = [("a", k, int(random.random() < 0.3 + 0.5 * (k % 50 > 25)), (k % 50) / 50) for k in range(400)]
    straight = [("b", k, int(k < 30), 1 - k / 100) for k in range(60)]  # all positives first: corners are start, one point, end
    tied = [("c", k, int(k < 30), 0.9 if k < 30 else 0.1) for k in range(60)]
    pred = spark.createDataFrame(cells + straight + tied, "label string, row_id long, y int, p double")
    counts = roc.ranged_counts(pred, micro=False)
    got, every = roc.roc_points_reduced(None, counts=counts).collect(), roc.roc_points(None, counts=counts).collect()

    def curve(rows, label):
        return sorted((r.fps, r.tps) for r in rows if r.label == label)

    def area(points):
        return sum((x2 - x1) * (y1 + y2) for (x1, y1), (x2, y2) in zip(points, points[1:]))

    for label in "abc":
        few, many = curve(got, label), curve(every, label)
        assert area(few) == area(many) and set(few) <= set(many)
        assert all((b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(few, few[1:], few[2:]))
    assert curve(got, "b") == curve(got, "c") == [(0, 0), (0, 30), (30, 30)]
