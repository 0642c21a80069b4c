"""Multi-label evaluation as distributed aggregations over the long prediction table.

Input, either long or wide, ``keys`` being optional grouping columns such as ``experiment``:

* long: ``(keys..., row_id, label, y, p)``, one cell per row and label;
* wide: ``(keys..., row_id, cells)``, all cells of a row as an array of (label, y, p) - what a
  model gives.  Row-level metrics are then expressions over the row: nothing is shuffled by
  ``row_id``.  A long table is brought into this form by one grouping where a row counts.

Per-label metrics aggregate by (keys, label): few groups, so Spark's partial (map-side)
aggregation keeps every shuffle to a handful of rows per task even when one label or
experiment holds most cells.

Two comparators exist on purpose: metric arrays use ``p >= threshold``; the per-sentence
results use ``p > threshold``.  Ratios with a zero denominator are 0 (``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, THRESHOLD
from ..functions.casts import safe_div
from ..functions.text import display_label


def _k(keys) -> list[str]:
    return list(keys or [])


def to_long(pred: DataFrame) -> DataFrame:
    """One row per cell."""
    if "cells" not in pred.columns:
        return pred
    return pred.select(*[c for c in pred.columns if c != "cells"], F.inline("cells"))


def to_wide(pred: DataFrame, keys=None) -> DataFrame:
    """One row per (keys, row_id) with its array of cells (a row's few labels)."""
    if "cells" in pred.columns:
        return pred
    return pred.groupBy(*_k(keys), "row_id").agg(F.collect_list(F.struct("label", "y", "p")).alias("cells"))


def binarize(pred: DataFrame, threshold: float = THRESHOLD, strict: bool = False, out: str = "yhat") -> DataFrame:
    """Predicted 0/1 per cell: ``p >= t`` (metrics) or ``p > t`` (sentence results)."""
    cond = F.col("p") > threshold if strict else F.col("p") >= threshold
    return pred.withColumn(out, cond.cast("int"))


def _cells(pred: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    return binarize(to_long(pred), threshold, strict)


def _row_counts(pred: DataFrame, threshold: float, keys: list[str], strict: bool = False) -> DataFrame:
    """Wide rows with their label counts n_true, n_pred, n_both, n_wrong, n_cells."""
    said = lambda c: c["p"] > threshold if strict else c["p"] >= threshold
    n = lambda test: F.size(F.filter("cells", test)).cast("bigint")
    return to_wide(pred, keys).withColumns({
        "n_true": n(lambda c: c["y"] > 0), "n_pred": n(said), "n_both": n(lambda c: (c["y"] > 0) & said(c)),
        "n_wrong": n(lambda c: (c["y"] > 0) != said(c)), "n_cells": F.size("cells").cast("bigint")})


def per_label_confusion(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """2x2 counts per label, always complete (zero-filled): tp, fp, fn, tn."""
    c = _cells(pred, threshold)
    y, yh = F.col("y") > 0, F.col("yhat") > 0
    return c.groupBy(*_k(keys), "label").agg(
        F.count(F.when(y & yh, 1)).cast("bigint").alias("tp"),
        F.count(F.when(~y & yh, 1)).cast("bigint").alias("fp"),
        F.count(F.when(y & ~yh, 1)).cast("bigint").alias("fn"),
        F.count(F.when(~y & ~yh, 1)).cast("bigint").alias("tn"))


def per_label_accuracy(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    conf = per_label_confusion(pred, threshold, keys)
    return conf.select(*_k(keys), "label",
                       safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
                       .alias("accuracy"))


def row_summary(pred: DataFrame, threshold: float = THRESHOLD, keys=None, strict: bool = False) -> DataFrame:
    """Per row: true / predicted / shared label counts and wrong cells."""
    return _row_counts(pred, threshold, _k(keys), strict).drop("cells")


def exact_match(pred: DataFrame, threshold: float = THRESHOLD, keys=None, strict: bool = False) -> DataFrame:
    """Subset accuracy: share of rows whose predicted label set equals the true one."""
    r = row_summary(pred, threshold, keys, strict)
    return r.groupBy(*_k(keys)).agg(
        F.count(F.when(F.col("n_wrong") == 0, 1)).cast("bigint").alias("exact_rows"),
        F.count(F.lit(1)).cast("bigint").alias("rows")) \
        .withColumn("exact_match", safe_div("exact_rows", "rows"))


def hamming_loss(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Wrong cells / all cells."""
    c = _cells(pred, threshold)  # cells of one row need not meet: a long table is not regrouped
    return c.groupBy(*_k(keys)).agg(
        F.count(F.when((F.col("y") > 0) != (F.col("yhat") > 0), 1)).cast("bigint").alias("wrong_cells"),
        F.count(F.lit(1)).cast("bigint").alias("cells")) \
        .withColumn("hamming_loss", safe_div("wrong_cells", "cells"))


def _label_scores(conf: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumns({
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1_score": safe_div(2 * tp, 2 * tp + fp + fn),
        "support": (tp + fn).cast("bigint"),
        "jaccard": safe_div(tp, tp + fp + fn),
    })


def jaccard_macro(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Mean over labels of tp / (tp + fp + fn), 0 for a label never true nor predicted."""
    s = _label_scores(per_label_confusion(pred, threshold, keys))
    return s.groupBy(*_k(keys)).agg(F.avg("jaccard").alias("jaccard"))


def _label_position(labels: list[str]) -> Column:
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return F.try_element_at(m, F.col("label"))


def _label_and_row_counts(pred: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """tp / fp / fn / cells, one row per (keys, label) with ``_n`` = 1 and one per
    (keys, n_true, n_pred, n_both, n_wrong) with the number of such rows in ``_n``.

    One scan: rows are first counted by their pattern, the label, truth and prediction of each cell.
    A few labels have few patterns (4^labels at most), so that count collapses map-side, and
    all cell work is done once per pattern.
    """
    said = F.transform("cells", lambda c: F.struct(c["label"].alias("label"), (c["y"] > 0).alias("t"), (c["p"] >= threshold).alias("h")))
    r = to_wide(pred, keys).select(*keys, said.alias("cells")).groupBy(*keys, "cells").agg(F.count(F.lit(1)).alias("_w"))
    n = lambda test: F.size(F.filter("cells", test)).cast("bigint")
    r = r.withColumns({"n_true": n(lambda c: c["t"]), "n_pred": n(lambda c: c["h"]), "n_both": n(lambda c: c["t"] & c["h"]),
                       "n_cells": F.size("cells").cast("bigint")})
    one = lambda test: F.when(test, F.col("_w")).otherwise(F.lit(0).cast("bigint"))
    cell = F.transform("cells", lambda c: F.struct(
        c["label"].alias("label"), one(c["t"] & c["h"]).alias("tp"), one(~c["t"] & c["h"]).alias("fp"),
        one(c["t"] & ~c["h"]).alias("fn"), F.col("_w").alias("cells")))
    row = F.struct(F.lit(None).cast("string").alias("label"), F.col("n_both").alias("tp"), (F.col("n_pred") - F.col("n_both")).alias("fp"),
                   (F.col("n_true") - F.col("n_both")).alias("fn"), F.col("n_cells").alias("cells"))
    flat = r.select(*keys, "_w", F.inline(F.concat(cell, F.array(row))))
    kind = [F.when(F.col("label").isNull(), F.col(c)).alias(f"_{c}") for c in ("tp", "fp", "fn", "cells")]
    agg = flat.groupBy(*keys, "label", *kind).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "cells")], F.sum("_w").alias("_m"))
    per_label = F.col("label").isNotNull()
    return agg.select(*keys, "label", *[F.when(per_label, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("tp", "fp", "fn", "cells")],
                      F.when(per_label, F.lit(1)).otherwise(F.col("_m")).alias("_n"), per_label.cast("int").alias("_per_label"))


def label_level_summary(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Exact match, hamming loss and macro Jaccard per group from one scan:
    (keys, exact_match_accuracy, hamming_loss, jaccard_score)."""
    keys = _k(keys)
    c = _label_scores(_label_and_row_counts(pred, threshold, keys))
    lab = F.col("_per_label") == 1
    wrong = F.col("fp") + F.col("fn")
    g = c.groupBy(*keys).agg(
        F.sum(F.when(~lab & (wrong == 0), F.col("_n"))).alias("_exact"), F.sum(F.when(~lab, F.col("_n"))).alias("_rows"),
        F.sum(F.when(~lab, wrong * F.col("_n"))).alias("_wrong"), F.sum(F.when(~lab, F.col("cells") * F.col("_n"))).alias("_cells"),
        F.avg(F.when(lab, F.col("jaccard"))).alias("jaccard_score"))
    return g.select(*keys, safe_div("_exact", "_rows").alias("exact_match_accuracy"),
                    safe_div("_wrong", "_cells").alias("hamming_loss"), "jaccard_score")


def classification_report(pred: DataFrame, threshold: float = THRESHOLD, keys=None,
                          labels: list[str] | None = None) -> DataFrame:
    """Per-label precision / recall / F1 / support plus micro, macro, weighted and samples
    averages.  ``row_name`` is the display label or the average's name; ``position`` orders
    the report (labels first).

    One scan: the counts per label and per kind of row feed a single aggregation by
    ``keys`` that keeps the per-label rows (a list bounded by the label count) and every
    average; the samples average uses the same ratios on per-row counts."""
    labels = labels or LABELS
    keys = _k(keys)
    n = len(labels)
    c = _label_scores(_label_and_row_counts(pred, threshold, keys))
    lab = F.col("_per_label") == 1
    tp, fp, fn, sup = (F.col(x) for x in ("tp", "fp", "fn", "support"))
    pr, rc, f1 = F.col("precision"), F.col("recall"), F.col("f1_score")

    def row(pos, name, p_, r_, f_, s_):
        return F.struct(pos.cast("int").alias("position"), name.alias("row_name"), p_.cast("double").alias("precision"),
                        r_.cast("double").alias("recall"), f_.cast("double").alias("f1_score"),
                        s_.cast("bigint").alias("support"))

    g = c.groupBy(*keys).agg(
        F.collect_list(F.when(lab, row(_label_position(labels), display_label("label"), pr, rc, f1, sup))).alias("per"),
        *[F.sum(F.when(lab, x)).alias(f"t_{i}") for i, x in enumerate((tp, fp, fn, sup))],
        *[F.avg(F.when(lab, x)).alias(f"m_{i}") for i, x in enumerate((pr, rc, f1))],
        *[F.sum(F.when(lab, x * sup)).alias(f"w_{i}") for i, x in enumerate((pr, rc, f1))],
        *[(F.sum(F.when(~lab, x * F.col("_n"))) / F.sum(F.when(~lab, F.col("_n")))).alias(f"s_{i}") for i, x in enumerate((pr, rc, f1))])
    ttp, tfp, tfn, tsup = (F.col(f"t_{i}") for i in range(4))
    avgs = F.array(
        row(F.lit(n), F.lit("micro avg"), safe_div(ttp, ttp + tfp), safe_div(ttp, ttp + tfn),
            safe_div(2 * ttp, 2 * ttp + tfp + tfn), tsup),
        row(F.lit(n + 1), F.lit("macro avg"), F.col("m_0"), F.col("m_1"), F.col("m_2"), tsup),
        row(F.lit(n + 2), F.lit("weighted avg"), safe_div("w_0", tsup), safe_div("w_1", tsup), safe_div("w_2", tsup),
            tsup),
        row(F.lit(n + 3), F.lit("samples avg"), F.col("s_0"), F.col("s_1"), F.col("s_2"), tsup))
    return g.select(*keys, F.inline(F.concat("per", avgs)))


def _samples_avg(rows: DataFrame, keys: list[str]) -> DataFrame:
    both, nt, npred = F.col("n_both"), F.col("n_true"), F.col("n_pred")
    return rows.groupBy(*keys).agg(
        F.avg(safe_div(both, npred)).alias("precision"),
        F.avg(safe_div(both, nt)).alias("recall"),
        F.avg(safe_div(2 * both, nt + npred)).alias("f1_score"),
        F.sum(nt).cast("bigint").alias("support")).withColumn("row_name", F.lit("samples avg"))


def report_samples_avg(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Samples average: per-row precision, recall and F1 of the label sets, averaged over rows
    (a row with no true and no predicted label scores 0)."""
    keys = _k(keys)
    return _samples_avg(row_summary(pred, threshold, keys), keys)


# ---------------------------------------------------------------- any-label (requirement) level
def is_requirement(pred: DataFrame, threshold: float = THRESHOLD, keys=None, strict: bool = False) -> DataFrame:
    """Per row: is any label true / predicted."""
    r = row_summary(pred, threshold, keys, strict)
    return r.select(*_k(keys), "row_id", (F.col("n_true") > 0).alias("true_req"),
                    (F.col("n_pred") > 0).alias("pred_req"))


def binary_confusion(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Zero-filled 2x2 matrix of the requirement flags: (true_req, pred_req, n)."""
    keys = _k(keys)
    r = is_requirement(pred, threshold, keys)
    t, p = F.col("true_req"), F.col("pred_req")
    wide = r.groupBy(*keys).agg(*[F.count(F.when((t == a) & (p == b), 1)).cast("bigint").alias(f"n_{int(a)}{int(b)}")
                                  for a in (False, True) for b in (False, True)])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("true_req"), F.lit(b).alias("pred_req"), F.col(f"n_{int(a)}{int(b)}").alias("n"))
        for a in (False, True) for b in (False, True)])))


def binary_report(pred: DataFrame, threshold: float = THRESHOLD, keys=None) -> DataFrame:
    """Report of the requirement flags: rows False, True, accuracy, macro avg, weighted avg."""
    keys = _k(keys)
    r = is_requirement(pred, threshold, keys)
    t, p = F.col("true_req"), F.col("pred_req")
    w = r.groupBy(*keys).agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"),
                             F.count(F.when(t & ~p, 1)).alias("fn"), F.count(F.when(~t & ~p, 1)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    cls = {  # class -> (precision, recall, f1, support)
        "False": (safe_div(tn, tn + fn), safe_div(tn, tn + fp), safe_div(2 * tn, 2 * tn + fn + fp), tn + fp),
        "True": (safe_div(tp, tp + fp), safe_div(tp, tp + fn), safe_div(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    (p0, r0, f0, s0), (p1, r1, f1, s1) = cls["False"], cls["True"]

    def row(pos, name, pr, rc, f, s):
        return F.struct(F.lit(pos).alias("position"), F.lit(name).alias("row_name"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.alias("f1_score"), s.cast("bigint").alias("support"))

    return w.select(*keys, F.inline(F.array(
        row(0, "False", p0, r0, f0, s0),
        row(1, "True", p1, r1, f1, s1),
        row(2, "accuracy", F.lit(None), F.lit(None), safe_div(tp + tn, n), n),
        row(3, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row(4, "weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
            safe_div(f0 * s0 + f1 * s1, n), n))))


# ---------------------------------------------------------------- per-sentence results
def label_lists(pred: DataFrame, threshold: float = THRESHOLD, keys=None, labels: list[str] | None = None) -> DataFrame:
    """Per row, in label order: true labels (y == 1), predicted labels (p > t, strict) and
    the scores."""
    labels = labels or LABELS
    keys = _k(keys)
    order = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    g = to_wide(pred, keys).withColumn("cs", F.sort_array(F.transform("cells", lambda c: F.struct(
        F.try_element_at(order, c["label"]).alias("pos"), c["label"].alias("label"), c["y"].alias("y"), c["p"].alias("p")))))
    return g.select(
        *keys, "row_id",
        F.transform(F.filter("cs", lambda c: c["y"] == 1), lambda c: c["label"]).alias("true_labels"),
        F.transform(F.filter("cs", lambda c: c["p"] > threshold), lambda c: c["label"]).alias("predicted_labels"),
        F.transform("cs", lambda c: c["p"]).alias("scores"))


def sentence_results(pred: DataFrame, sentences: DataFrame, threshold: float = THRESHOLD, keys=None,
                     labels: list[str] | None = None, text_col: str = "description") -> DataFrame:
    """One row per validation sentence, scored once: sentence, true and predicted display
    labels, correctness (list equality) and scores rounded to 3 places."""
    keys = _k(keys)
    ll = label_lists(pred, threshold, keys, labels)
    s = sentences.select(*keys, "row_id", F.col(text_col).alias("sentence"))
    return ll.join(s, [*keys, "row_id"]).select(
        *keys, "row_id", "sentence",
        F.transform("true_labels", display_label).alias("true_label"),
        F.transform("predicted_labels", display_label).alias("predicted"),
        (F.col("true_labels") == F.col("predicted_labels")).alias("correctness"),
        F.transform("scores", lambda x: F.round(x, 3)).alias("probabilities"))


def sentence_confusion(results: DataFrame, keys=None) -> DataFrame:
    """Any-label confusion flags per sentence (TP, TN, FP, FN exactly one is 1)."""
    keys = _k(keys)
    has_p, has_t = F.size("predicted") > 0, F.size("true_label") > 0
    return results.select(
        *keys, "row_id", has_p.cast("int").alias("predicted"), has_t.cast("int").alias("true_label"),
        F.col("sentence").alias("text"),
        (has_p & has_t).cast("int").alias("TP"), (~has_p & ~has_t).cast("int").alias("TN"),
        (has_p & ~has_t).cast("int").alias("FP"), (~has_p & has_t).cast("int").alias("FN"))


def precision_recall(confusion: DataFrame, keys=None) -> DataFrame:
    """Totals of the confusion rows and any-label precision, recall and F1."""
    keys = _k(keys)
    t = confusion.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c.lower())
                                       for c in ("TP", "TN", "FP", "FN")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr, rc = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return t.withColumns({"precision": pr, "recall": rc}) \
        .withColumn("f1_score", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
