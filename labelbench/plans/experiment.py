"""Experiments: subset -> split -> distribution -> train -> score -> evaluate -> export.

A suite of experiments is run as one set of Spark jobs keyed by ``experiment``: one tagging
pass over (row id, labels), one split, one join of the split with the features for all
experiments, one training of all experiments' heads, one metric pass grouped by experiment.  Texts are not
carried through the split: the validation rows alone are joined to them for the results.  A
``scorer`` can replace the model (any function from the split table to predictions),
which is how the evaluation half is checked against SQL.

Every run function runs its jobs when called: split, predictions and results are landed or
written once and everything else is read from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..constants import LABELS
from ..functions.casts import safe_div
from ..functions.text import experiment_display_name, sanitize_name
from ..operators import joint
from ..operators import metrics as mt
from ..operators import roc
from ..operators import split as sp
from ..operators import subsets as sb
from ..operators import train as tr
from ..session import land, shared_path
from ..sources.results import read_results, write_results

KEY = "experiment"
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class SuiteResult:
    split: DataFrame
    distribution: DataFrame
    pred: DataFrame
    summary: DataFrame
    threshold: float
    make_results: Callable[[], DataFrame]
    models: dict = field(default_factory=dict)
    train_history: DataFrame | None = None
    results_path: str | None = None

    @cached_property
    def results(self) -> DataFrame:
        """Every validation sentence with its labels and predictions: what was exported, else joined and landed when first asked for."""
        return self.make_results()

    @cached_property
    def confusion(self) -> DataFrame:
        return mt.sentence_confusion(self.results, [KEY])

    @cached_property
    def evaluation(self) -> dict[str, DataFrame]:
        """The metric bundle with ROC (made, and its score table landed, when first asked for)."""
        return evaluate(self.pred, self.threshold)


def evaluate(pred: DataFrame, threshold: float, keys=(KEY,)) -> dict[str, DataFrame]:
    """The whole metric bundle of one prediction table.  Lazy but for the ROC score table, which is landed."""
    keys = list(keys)
    scores = roc.ranged_counts(mt.to_long(pred), keys)
    return {
        "threshold": threshold,
        "summary": mt.label_level_summary(pred, threshold, keys),
        "per_label_confusion": mt.per_label_confusion(pred, threshold, keys),
        "per_label_accuracy": mt.per_label_accuracy(pred, threshold, keys),
        "exact_match": mt.exact_match(pred, threshold, keys),
        "hamming_loss": mt.hamming_loss(pred, threshold, keys),
        "jaccard": mt.jaccard_macro(pred, threshold, keys),
        "classification_report": mt.classification_report(pred, threshold, keys),
        "binary_confusion": mt.binary_confusion(pred, threshold, keys),
        "binary_report": mt.binary_report(pred, threshold, keys),
        "roc_points": roc.roc_points(None, keys, counts=scores),
        "roc_auc": roc.roc_auc(None, keys, counts=scores),
        "roc_macro_curve": roc.roc_macro_curve(None, keys, counts=scores),
    }


def split_sizes(split_df: DataFrame) -> DataFrame:
    return split_df.groupBy(KEY).agg(F.count(F.when(F.col("split") == "train", 1)).cast("bigint").alias("train_size"),
                                     F.count(F.when(F.col("split") == "valid", 1)).cast("bigint").alias("val_size"))


def experiment_summary(split_df: DataFrame, pred: DataFrame, threshold: float, results_path: str | None = None,
                       model_folders: dict[str, str] | None = None) -> DataFrame:
    """One row per experiment: sizes, exact match, hamming, jaccard (label level), any-label
    precision / recall, and where its models and results were written (NULL where they were
    not).  Every input is reduced to one row per experiment before the joins."""
    lv = mt.label_level_summary(pred, threshold, [KEY])
    rows = mt.row_summary(pred, threshold, [KEY], strict=True)
    t, p = F.col("n_true") > 0, F.col("n_pred") > 0
    flags = rows.select(KEY, *[c.cast("int").alias(n) for n, c in {"TP": t & p, "TN": ~t & ~p, "FP": ~t & p, "FN": t & ~p}.items()])
    pr = mt.precision_recall(flags, [KEY]).select(KEY, "precision", "recall")
    folders = [F.when(F.col(KEY) == e, F.lit(f)) for e, f in (model_folders or {}).items()]
    results = F.concat(F.lit(f"{results_path}/results/experiment="), sanitize_name(F.col(KEY))) if results_path else F.lit(None).cast("string")
    return split_sizes(split_df).join(lv, KEY, "left").join(pr, KEY, "left").withColumns({
        "best_model_path": F.coalesce(*folders, F.lit(None).cast("string")) if folders else F.lit(None).cast("string"),
        "validation_results_path": results})


def _run(tagged: DataFrame, texts: DataFrame, names: list[str], on: list[str], cfg: ExperimentConfig, out_dir: str | None,
         export: bool, scorer: Scorer | None, labels: list[str]) -> SuiteResult:
    """``tagged`` has (experiment, row_id, labels), ``texts`` the text of every row by the columns ``on``."""
    spark = tagged.sparkSession
    split_df = land(sp.split_exact(tagged.select(KEY, "row_id", *labels), cfg.test_size, cfg.seed, by=[KEY]), "split")
    dist = sp.class_distribution(split_df, labels, by=[KEY])
    path = (out_dir or shared_path(spark, "artifacts", unique=True)).rstrip("/")
    models, hist, folders = {}, None, {}
    if scorer is None and cfg.optimizer == "adam":
        width = tr.feature_width(texts, cfg)
        model, hist = joint.train(split_df, texts, names, width, cfg, labels, tuple(on), f"{path}/models/joint")
        models, folders = {"joint": model}, {name: f"{path}/models/joint" for name in names}
        rows = split_df.filter(F.col("split") == "valid").join(texts, on)
        pred = land(joint.score(model, rows, cfg), "predictions")
    elif scorer is None:
        feats = tr.featurize(texts, tr.feature_width(texts, cfg), cfg, id_cols=tuple(on))
        joined = land(split_df.join(feats, on), "joined", partition_by=KEY)  # the one join of rows and features
        models, hist = tr.train_multilabel(joined, names, cfg, labels, KEY)
        folders = tr.save_models(models, f"{path}/models")
        pred = land(tr.score_multilabel(models, joined, KEY), "predictions")
    else:
        pred = land(scorer(split_df), "predictions")

    def make_results() -> DataFrame:
        valid = split_df.filter(F.col("split") == "valid").select(KEY, "row_id").join(texts, on).select(KEY, "row_id", "description")
        results = mt.sentence_results(pred, valid, cfg.threshold, [KEY], labels)
        return land(results.withColumn(KEY, sanitize_name(F.col(KEY))) if export else results, "results")

    published = None
    if export:
        named = make_results()
        published = write_results(named, mt.sentence_confusion(named, [KEY]), path)
        make_results = lambda: named
    summary = experiment_summary(split_df, pred, cfg.threshold, published, folders)
    return SuiteResult(split_df, dist, pred, summary, cfg.threshold, make_results, models, hist, path if export or models else None)


def suite_split(df: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), labels: list[str] | None = None) -> DataFrame:
    """The split of every ambiguity subset of the cleaned sentence table, without texts."""
    labels = labels or LABELS
    tagged = sb.prepare_baseline(sb.subset_suite(df.drop("description"), sb.subset_conditions()), labels)
    return sp.split_exact(tagged.select(KEY, "row_id", *labels), cfg.test_size, cfg.seed, by=[KEY])


def run_suite(df: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), conditions: dict[str, Column] | None = None,
              out_dir: str | None = None, export: bool = True, scorer: Scorer | None = None,
              labels: list[str] | None = None) -> SuiteResult:
    """Run every experiment of ``conditions`` (default: the seven ambiguity subsets) over
    the cleaned sentence table ``df``.  Models are saved whether or not results are exported."""
    labels = labels or LABELS
    conditions = conditions or sb.subset_conditions()
    tagged = sb.prepare_baseline(sb.subset_suite(df.drop("description"), conditions), labels)
    return _run(tagged, df.select("row_id", "description"), list(conditions), ["row_id"], cfg, out_dir, export, scorer, labels)


def run_tables(tables: dict[str, DataFrame], cfg: ExperimentConfig = ExperimentConfig(), out_dir: str | None = None,
               export: bool = True, scorer: Scorer | None = None, labels: list[str] | None = None) -> SuiteResult:
    """One experiment per table: all its rows, under the table's name (row ids unique per table)."""
    labels = labels or LABELS
    parts = [sb.prepare_baseline(d, labels).select(F.lit(name).alias(KEY), "row_id", "description", *labels) for name, d in tables.items()]
    rows = land(reduce(DataFrame.unionByName, parts), "tables")
    return _run(rows.drop("description"), rows.select(KEY, "row_id", "description"), list(tables), [KEY, "row_id"], cfg, out_dir,
                export, scorer, labels)


def run_experiment(df: DataFrame, name: str, cfg: ExperimentConfig = ExperimentConfig(),
                   out_dir: str | None = None, export: bool = True, scorer: Scorer | None = None,
                   labels: list[str] | None = None) -> SuiteResult:
    """One experiment over the whole of ``df``."""
    return run_suite(df, cfg, {name: F.lit(True)}, out_dir, export, scorer, labels)


def run_subset_experiment(df: DataFrame, subset_fn: Callable[[DataFrame], DataFrame] | None = None,
                          cfg: ExperimentConfig = ExperimentConfig(), name: str = "subset", **kw) -> SuiteResult:
    """A caller's subset function, then one experiment on what it keeps."""
    return run_experiment(sb.subset_transform(df, subset_fn), name, cfg, **kw)


def artifact_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per experiment found under ``path``: sizes, correct sentences, exact match (mean
    correctness), any-label precision / recall / F1 and the confusion totals."""
    results, confusion = read_results(spark, path)
    r = results.groupBy(KEY).agg(F.count(F.lit(1)).cast("bigint").alias("validation_sentences"),
                                 F.count(F.when(F.col("correctness"), 1)).cast("bigint").alias("correct_sentences"))
    c = mt.precision_recall(confusion, [KEY])
    return (r.join(c, KEY, "full")
            .select(F.col(KEY).alias("experiment_key"), experiment_display_name(F.col(KEY)).alias("experiment"),
                    F.coalesce("validation_sentences", F.lit(0)).alias("validation_sentences"),
                    F.coalesce("correct_sentences", F.lit(0)).alias("correct_sentences"),
                    safe_div("correct_sentences", "validation_sentences").alias("exact_match_accuracy"),
                    "precision", "recall", "f1_score", "tp", "tn", "fp", "fn")
            .orderBy("experiment"))  # one row per experiment


def metrics_long(summary: DataFrame) -> DataFrame:
    """Wide -> long: (experiment, metric, score) for precision, recall and F1."""
    return summary.unpivot(["experiment"], ["precision", "recall", "f1_score"], "metric", "score")


def confusion_rates(summary: DataFrame) -> DataFrame:
    """tp / tn / fp / fn as shares of their row total (NULL for an empty experiment)."""
    tot = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return summary.select("experiment", *[F.try_divide(F.col(c).cast("double"), tot).alias(c)
                                          for c in ("tp", "tn", "fp", "fn")])
