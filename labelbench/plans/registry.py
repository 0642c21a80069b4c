"""Named queries over the driver tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose column names match
the oracle SQL twin in ``oracle/sql.py``.  Arrays are shown as joined strings there only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..constants import AMBIGUITY_TYPES, LABELS
from ..functions import text as tx
from ..functions.casts import lenient_int
from ..operators import clean, profile, roc
from ..operators import encode as en
from ..operators import history as hs
from ..operators import metrics as mt
from ..operators import split as sp
from ..operators import subsets as sb
from ..operators import train as tr
from ..session import land, shared_path
from ..sources import csv as csvsrc
from ..sources import fixtures as fx
from ..sources.results import read_results
from ..sources.tables import read_table
from . import experiment as ex

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filter_annotated(fx.req(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned, de-duplicated sentence table (dataset preparation, E1), landed once in
    the shared folder: the queries built on it (subsets, split, encoding, experiments)
    read it several times and must not re-run the scan, cleaning and de-dup per branch."""
    return land(clean.prepare_sentences(fx.req(spark, sf_dir)), "prepared")


# ---------------------------------------------------------------- 2.2 filters / casts
@query("filter_annotated")
def q_filter_annotated(spark, sf_dir):
    return annotated(spark, sf_dir).select("row_id", "ambuiguity", "ambiguity_type", "source")


@query("labels_strict")
def q_labels_strict(spark, sf_dir):
    return clean.cast_labels_strict(annotated(spark, sf_dir)).select("row_id", *LABELS)


@query("cast_lenient")
def q_cast_lenient(spark, sf_dir):
    r = fx.req(spark, sf_dir)
    return r.select("row_id", "goal", lenient_int("goal").alias("goal_int"),
                    lenient_int(F.col("ambuiguity").cast("string")).alias("ambuiguity_int"))


# ---------------------------------------------------------------- 2.3 text
@query("normalize_text")
def q_normalize_text(spark, sf_dir):
    r = fx.req(spark, sf_dir)
    d = tx.normalize_description(F.col("description"))
    return r.select("row_id", tx.strip_ws("description").alias("stripped"), d.alias("description"),
                    F.lower(d).alias("dedupe_key"))


@query("collapse_ws")
def q_collapse_ws(spark, sf_dir):
    return fx.req(spark, sf_dir).select("row_id", tx.collapse_ws("description").alias("collapsed"))


# ---------------------------------------------------------------- 2.4 aggregates / de-dup
@query("duplicate_count")
def q_duplicate_count(spark, sf_dir):
    a = clean.normalize_text(annotated(spark, sf_dir))
    return clean.duplicate_count(a)


@query("dedupe_keep_first")
def q_dedupe_keep_first(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_id", "description", *LABELS)


@query("dedupe_by_repeats")
def q_dedupe_by_repeats(spark, sf_dir):
    return clean.prepare_sentences(fx.req(spark, sf_dir), land_repeats=True).select("row_id", "description", *LABELS)


@query("duplicate_flags")
def q_duplicate_flags(spark, sf_dir):
    a = clean.normalize_text(annotated(spark, sf_dir))
    return clean.duplicate_flags(a).select("row_id", "is_duplicate")


@query("label_counts")
def q_label_counts(spark, sf_dir):
    return profile.label_counts(annotated(spark, sf_dir))


@query("goal_distribution")
def q_goal_distribution(spark, sf_dir):
    return profile.value_distribution(annotated(spark, sf_dir), "goal")


@query("ambiguity_distribution")
def q_ambiguity_distribution(spark, sf_dir):
    return profile.value_distribution(annotated(spark, sf_dir), "ambuiguity")


@query("label_by_ambiguity")
def q_label_by_ambiguity(spark, sf_dir):
    return profile.label_by_ambiguity(annotated(spark, sf_dir))


@query("null_profile")
def q_null_profile(spark, sf_dir):
    return profile.null_profile(annotated(spark, sf_dir))


@query("table_info")
def q_table_info(spark, sf_dir):
    return profile.table_info(clean.cast_labels_strict(annotated(spark, sf_dir)))


# ---------------------------------------------------------------- subsets (2.2, 2.8 R7, 2.7 J1)


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned table tagged with its experiments, metadata dropped, labels strict."""
    return sb.prepare_baseline(sb.subset_suite(prepared(spark, sf_dir)))


@query("prepare_baseline")
def q_prepare_baseline(spark, sf_dir):
    return sb.prepare_baseline(prepared(spark, sf_dir))


@query("subset_no_ambiguity")
def q_subset_no_ambiguity(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return sb.prepare_baseline(p.filter(F.col("ambuiguity") == 0)).select("row_id", *LABELS)


@query("subset_drop_type")
def q_subset_drop_type(spark, sf_dir):
    p = prepared(spark, sf_dir)
    codes = F.array(*[F.lit(c) for c in AMBIGUITY_TYPES])
    x = p.select("row_id", "ambiguity_type", F.explode(codes).alias("dropped_type"))
    return x.filter(~F.col("ambiguity_type").eqNullSafe(F.col("dropped_type"))).select("dropped_type", "row_id")


@query("filter_subset")
def q_filter_subset(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return sb.filter_subset(p, condition=F.col("compute") == 1,
                            query="ambiguity_type is null or ambiguity_type <> 2").select("row_id")


@query("subset_transform")
def q_subset_transform(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return sb.subset_transform(p, lambda d: d.filter(F.col("network") + F.col("compute") > 0)) \
        .select("row_id", "network", "compute")


@query("subset_suite")
def q_subset_suite(spark, sf_dir):
    return suite(spark, sf_dir).select("experiment", "row_id")


@query("subset_sizes")
def q_subset_sizes(spark, sf_dir):
    return sb.subset_sizes(prepared(spark, sf_dir))


@query("ambiguity_type_names")
def q_ambiguity_type_names(spark, sf_dir):
    return annotated(spark, sf_dir).select("row_id", "ambiguity_type",
                                           sb.ambiguity_type_name().alias("type_name"))


@query("overlay_rewrites")
def q_overlay_rewrites(spark, sf_dir):
    p = prepared(spark, sf_dir)
    out = sb.overlay_rewrites(p, fx.rewrites(spark, sf_dir))
    return out.select("row_id", "description", "is_rewritten")


@query("sanitize_name")
def q_sanitize_name(spark, sf_dir):
    return fx.req(spark, sf_dir).select("row_id", tx.sanitize_name("description").alias("safe_name"))


@query("display_names")
def q_display_names(spark, sf_dir):
    s = suite(spark, sf_dir).groupBy(F.col("experiment").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    src = fx.req(spark, sf_dir).groupBy(tx.sanitize_name(F.concat(F.col("source"), F.lit("_set"))).alias("name")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    return s.unionByName(src).select("name", tx.experiment_display_name("name").alias("display_name"),
                                     F.col("rows").cast("bigint").alias("rows"))


# ---------------------------------------------------------------- split / batches (2.6 G1-G3, 2.4 A8)
def split_suite(spark: SparkSession, sf_dir: str, test_size: float = 0.15, seed: int = 42) -> DataFrame:
    return sp.split_exact(suite(spark, sf_dir), test_size, seed, by=["experiment"])


@query("split_exact")
def q_split_exact(spark, sf_dir):
    return split_suite(spark, sf_dir).select("experiment", "row_id", "rank", "split")


@query("batch_assign")
def q_batch_assign(spark, sf_dir):
    return sp.batch_assign(split_suite(spark, sf_dir)).select("experiment", "row_id", "split", "batch_id")


@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    return sp.class_distribution(split_suite(spark, sf_dir), by=["experiment"])


@query("dense_row_number")
def q_dense_row_number(spark, sf_dir):
    return sp.ordered_rank(prepared(spark, sf_dir).select("row_id")) \
        .select("row_id", (F.col("rank") - 1).alias("row_number"))


# ---------------------------------------------------------------- metrics (2.2 P14-P18, 2.4 A9-A17)


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def _joined(c) -> F.Column:
    return F.array_join(c, "|")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence texts of the scored rows (normalised)."""
    return clean.normalize_text(annotated(spark, sf_dir)).select("row_id", "description")


@query("binarize_ge")
def q_binarize_ge(spark, sf_dir):
    return mt.binarize(fx.pred(spark, sf_dir)).select("row_id", "label", "y", "p", "yhat")


@query("predicted_labels")
def q_predicted_labels(spark, sf_dir):
    ll = mt.label_lists(fx.pred_wide(spark, sf_dir))
    return ll.select("row_id", _joined("true_labels").alias("true_labels"),
                     _joined("predicted_labels").alias("predicted_labels"))


@query("is_requirement")
def q_is_requirement(spark, sf_dir):
    return mt.is_requirement(fx.pred_wide(spark, sf_dir))


@query("sentence_results")
def q_sentence_results(spark, sf_dir):
    r = mt.sentence_results(fx.pred_wide(spark, sf_dir), sentences(spark, sf_dir))
    return r.select("row_id", "sentence", _joined("true_label").alias("true_label"),
                    _joined("predicted").alias("predicted"), "correctness",
                    F.array_join(F.transform("probabilities", lambda x: F.format_string("%.3f", x)), ",")
                    .alias("probabilities"))


@query("sentence_confusion")
def q_sentence_confusion(spark, sf_dir):
    r = mt.sentence_results(fx.pred_wide(spark, sf_dir), sentences(spark, sf_dir))
    return mt.sentence_confusion(r)


@query("precision_recall")
def q_precision_recall(spark, sf_dir):
    r = mt.sentence_results(fx.pred_wide(spark, sf_dir), sentences(spark, sf_dir))
    return _r6(mt.precision_recall(mt.sentence_confusion(r)), "precision", "recall", "f1_score")


@query("binary_confusion")
def q_binary_confusion(spark, sf_dir):
    return mt.binary_confusion(fx.pred_wide(spark, sf_dir))


@query("binary_report")
def q_binary_report(spark, sf_dir):
    return _r6(mt.binary_report(fx.pred_wide(spark, sf_dir)), "precision", "recall", "f1_score")


@query("per_label_confusion")
def q_per_label_confusion(spark, sf_dir):
    return mt.per_label_confusion(fx.pred(spark, sf_dir))


@query("per_label_accuracy")
def q_per_label_accuracy(spark, sf_dir):
    return _r6(mt.per_label_accuracy(fx.pred(spark, sf_dir)), "accuracy")


@query("exact_match")
def q_exact_match(spark, sf_dir):
    p = fx.pred_wide(spark, sf_dir)
    ge = mt.exact_match(p).withColumn("comparator", F.lit(">="))
    gt = mt.exact_match(p, strict=True).withColumn("comparator", F.lit(">"))
    return _r6(ge.unionByName(gt), "exact_match")


@query("hamming_loss")
def q_hamming_loss(spark, sf_dir):
    return _r6(mt.hamming_loss(fx.pred_wide(spark, sf_dir)), "hamming_loss")


@query("jaccard_macro")
def q_jaccard_macro(spark, sf_dir):
    return _r6(mt.jaccard_macro(fx.pred_wide(spark, sf_dir)), "jaccard")


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return _r6(mt.classification_report(fx.pred_wide(spark, sf_dir)), "precision", "recall", "f1_score")


@query("report_samples_avg")
def q_report_samples_avg(spark, sf_dir):
    return _r6(mt.report_samples_avg(fx.pred_wide(spark, sf_dir)), "precision", "recall", "f1_score")


# ---------------------------------------------------------------- ROC (2.5 C1-C4)


@query("roc_points")
def q_roc_points(spark, sf_dir):
    p = roc.roc_points(fx.pred(spark, sf_dir))
    return _r6(p.select("label", "threshold", "tps", "fps", "fpr", "tpr"), "fpr", "tpr")


@query("roc_points_reduced")
def q_roc_points_reduced(spark, sf_dir):
    p = roc.roc_points_reduced(fx.pred(spark, sf_dir))
    return _r6(p.select("label", "threshold", "tps", "fps", "fpr", "tpr"), "fpr", "tpr")


@query("roc_auc_per_label")
def q_roc_auc_per_label(spark, sf_dir):
    a = roc.roc_auc(fx.pred(spark, sf_dir), micro=False)
    return _r6(a, "auc")


@query("roc_auc_micro")
def q_roc_auc_micro(spark, sf_dir):
    c = roc.score_counts(fx.pred(spark, sf_dir)).filter(F.col("label") == roc.MICRO)
    return _r6(roc.roc_auc(None, counts=c), "auc")


@query("roc_macro_curve")
def q_roc_macro_curve(spark, sf_dir):
    return _r6(roc.roc_macro_curve(fx.pred(spark, sf_dir)), "fpr", "tpr")


@query("roc_auc_macro")
def q_roc_auc_macro(spark, sf_dir):
    return _r6(roc.roc_auc_macro(fx.pred(spark, sf_dir)), "auc")


# ---------------------------------------------------------------- loss history (2.6 G4-G5, 2.4 A18-A19, T12)


@query("early_stop_trace")
def q_early_stop_trace(spark, sf_dir):
    t = hs.early_stop_trace(fx.history(spark, sf_dir))
    return t.select("experiment", "epoch", "valid_loss", "best_before", "is_worse", "ran", "saved")


@query("best_epoch")
def q_best_epoch(spark, sf_dir):
    return hs.best_epoch(fx.history(spark, sf_dir))


@query("sigmoid_scores")
def q_sigmoid_scores(spark, sf_dir):
    return _r6(hs.sigmoid_scores(fx.logits(spark, sf_dir)).select("row_id", "label", "p"), "p")


@query("bce_loss")
def q_bce_loss(spark, sf_dir):
    return _r6(hs.bce_loss(fx.logits(spark, sf_dir)), "bce")


@query("bce_batch_mean")
def q_bce_batch_mean(spark, sf_dir):
    return _r6(hs.bce_batch_mean(fx.logits(spark, sf_dir)), "bce_batch_mean")


# ---------------------------------------------------------------- encoding (2.3 T13)


@query("build_vocab")
def q_build_vocab(spark, sf_dir):
    return en.build_vocab(prepared(spark, sf_dir))


def _shown(e: DataFrame) -> DataFrame:
    return e.select("row_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attention_len"),
                    F.size("token_type_ids").alias("type_len"), "n_tokens")


@query("encode_tokens")
def q_encode_tokens(spark, sf_dir):
    t = en.tokenised(prepared(spark, sf_dir))
    return _shown(en.encode_tokens(t, en.build_vocab(t)))


PIECES = 2_000  # few, so that many words are cut


@query("build_pieces")
def q_build_pieces(spark, sf_dir):
    return en.build_pieces(en.build_vocab(prepared(spark, sf_dir)), PIECES)


@query("encode_subwords")
def q_encode_subwords(spark, sf_dir):
    t = en.tokenised(prepared(spark, sf_dir))
    vocab = land(en.build_vocab(t), "vocab")
    return _shown(en.encode_subwords(t, vocab, en.build_pieces(vocab, PIECES)))


# ---------------------------------------------------------------- sources / sinks / experiments (2.1, 2.4 A20-A21, 2.8 R3-R4, 2.9)


def _landed_csv(spark: SparkSession, df: DataFrame) -> str:
    path = shared_path(spark, "csv", unique=True)
    csvsrc.write_csv(df, path)
    return path


@query("scan_csv_typed")
def q_scan_csv_typed(spark, sf_dir):
    return csvsrc.scan_csv_typed(spark, _landed_csv(spark, fx.raw_strings(fx.req(spark, sf_dir))))


CSV_FILE_BYTES = 512 << 20  # of text in a file of scan_csv_splits: several read splits, and what one task writes


@query("scan_csv_splits")
def q_scan_csv_splits(spark, sf_dir):
    """The same scan, a file read by several tasks; more text makes more files, so no task writes it all."""
    size = read_table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    raw = fx.raw_strings(fx.req(spark, sf_dir)).coalesce(1 + size // CSV_FILE_BYTES)
    return csvsrc.scan_csv_typed(spark, _landed_csv(spark, raw), in_splits=True)


@query("scan_csv_header")
def q_scan_csv_header(spark, sf_dir):
    """A file without row_id whose columns stand in another order: rows are numbered in file order."""
    raw = fx.raw_strings(fx.req(spark, sf_dir)).orderBy(F.col("row_id").cast("bigint"))
    cols = ["goal", *reversed(LABELS), "description", "comments", "ambiguity_type", "ambuiguity", "source"]
    return csvsrc.scan_csv_typed(spark, _landed_csv(spark, raw.select(*cols))).select("row_id", *cols)


@query("scan_csv_annotations")
def q_scan_csv_annotations(spark, sf_dir):
    """Annotations as they may stand in a file - whole, fractional, not a number, missing - and what becomes of them."""
    r = F.col("row_id").cast("bigint")
    raw = fx.raw_strings(fx.req(spark, sf_dir)).withColumn(
        "ambuiguity", F.when(r % 7 == 0, "yes").when(r % 7 == 1, "0.5").when(r % 7 == 2, "1.0d").when(r % 7 == 3, "NA")
        .when(r % 7 == 4, "1e10").otherwise((r % 2).cast("string")))
    df = clean.filter_annotated(csvsrc.scan_csv_typed(spark, _landed_csv(spark, raw)))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select("row_id", F.isnan("ambuiguity").alias("malformed"), lenient_int("ambuiguity", types["ambuiguity"]).alias("as_int"),
                     (F.col("ambuiguity") == 0).alias("not_ambiguous"))


def hashed_suite(spark: SparkSession, sf_dir: str, export: bool = True) -> ex.SuiteResult:
    return ex.run_suite(prepared(spark, sf_dir), ExperimentConfig(), export=export, scorer=fx.hash_scorer)


@query("results_roundtrip")
def q_results_roundtrip(spark, sf_dir):
    res = hashed_suite(spark, sf_dir)
    results, confusion = read_results(spark, res.results_path)
    return confusion.join(results.select("experiment", "row_id", "correctness"), ["experiment", "row_id"]) \
        .select("experiment", "row_id", "predicted", "true_label", "TP", "TN", "FP", "FN", "correctness")


@query("experiment_summary")
def q_experiment_summary(spark, sf_dir):
    res = hashed_suite(spark, sf_dir, export=False)
    return _r6(res.summary, "exact_match_accuracy", "hamming_loss", "jaccard_score", "precision", "recall")


@query("evaluate_bundle")
def q_evaluate_bundle(spark, sf_dir):
    """One figure of the bundle's parts per experiment: micro and mean label area, label-level and any-label figures."""
    e = hashed_suite(spark, sf_dir, export=False).evaluation
    auc = e["roc_auc"].groupBy("experiment").agg(F.max(F.when(F.col("label") == roc.MICRO, F.col("auc"))).alias("auc_micro"),
                                                 F.avg(F.when(F.col("label") != roc.MICRO, F.col("auc"))).alias("auc_mean"))
    requirements = e["binary_confusion"].filter("true_req and pred_req").select("experiment", F.col("n").alias("both_req"))
    return _r6(e["summary"].join(auc, "experiment").join(requirements, "experiment"),
               "exact_match_accuracy", "hamming_loss", "jaccard_score", "auc_micro", "auc_mean")


@query("suite_with_rewrites")
def q_suite_with_rewrites(spark, sf_dir):
    """Baseline and rewritten texts as two tables of one suite: the sentences that are validated."""
    base = prepared(spark, sf_dir)
    new = sb.overlay_rewrites(base, fx.rewrites(spark, sf_dir)).drop("is_rewritten")
    res = ex.run_tables({"baseline": base, "rewritten": new}, export=False, scorer=fx.hash_scorer)
    return res.results.select("experiment", "row_id", "sentence", "correctness")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.artifact_summary(spark, hashed_suite(spark, sf_dir).results_path)


@query("artifact_summary")
def q_artifact_summary(spark, sf_dir):
    return _r6(_artifacts(spark, sf_dir), "exact_match_accuracy", "precision", "recall", "f1_score")


@query("metrics_long")
def q_metrics_long(spark, sf_dir):
    return _r6(ex.metrics_long(_artifacts(spark, sf_dir)), "score")


@query("confusion_rates")
def q_confusion_rates(spark, sf_dir):
    return _r6(ex.confusion_rates(_artifacts(spark, sf_dir)), "tp", "tn", "fp", "fn")


# Spark ML keys: a fitted model has no SQL twin; the keys ending in _facts hold what SQL can tell of them.
def _baseline(spark: SparkSession, sf_dir: str) -> ex.SuiteResult:
    return ex.run_experiment(prepared(spark, sf_dir), "baseline", ExperimentConfig(), export=False)


@query("train_multilabel")
def q_train_multilabel(spark, sf_dir):
    return _baseline(spark, sf_dir).train_history


@query("train_multilabel_facts")
def q_train_multilabel_facts(spark, sf_dir):
    """Per experiment: epochs numbered from 1, a training loss that never rises, the sizes trained and validated on."""
    res = _baseline(spark, sf_dir)
    h = res.train_history.withColumn("before", F.lag("train_loss").over(Window.partitionBy("experiment").orderBy("epoch")))
    facts = h.groupBy("experiment").agg(
        (F.min("epoch") == 1).alias("from_one"), F.bool_and(F.coalesce(F.col("train_loss") <= F.col("before") + 1e-9, F.lit(True))).alias("never_rises"),
        F.bool_and(F.col("valid_loss") > 0).alias("valid_loss_positive"))
    return facts.join(ex.split_sizes(res.split), "experiment")


@query("score_multilabel")
def q_score_multilabel(spark, sf_dir):
    return mt.to_long(_baseline(spark, sf_dir).pred)


@query("score_multilabel_facts")
def q_score_multilabel_facts(spark, sf_dir):
    cells = mt.to_long(_baseline(spark, sf_dir).pred)
    return cells.select("experiment", "row_id", "label", "y", F.col("p").between(0, 1).alias("p_is_probability"))


@query("score_text")
def q_score_text(spark, sf_dir):
    """Models of the annotated sentences label the sentences that are not annotated."""
    res = _baseline(spark, sf_dir)
    new = clean.normalize_text(fx.req(spark, sf_dir).filter(F.col("ambuiguity").isNull())).select("row_id", "description")
    return tr.score_text(res.models, new, "baseline")


@query("score_text_facts")
def q_score_text_facts(spark, sf_dir):
    out = q_score_text(spark, sf_dir)
    p = F.map_values("probabilities")
    return out.select("row_id", F.size(p).alias("n_probabilities"), F.forall(p, lambda x: x.between(0, 1)).alias("in_range"),
                      (F.size("predicted_labels") == F.size(F.filter(p, lambda x: x > ExperimentConfig().threshold))).alias("above_threshold"))


@query("run_experiment")
def q_run_experiment(spark, sf_dir):
    return _baseline(spark, sf_dir).summary


@query("run_suite")
def q_run_suite(spark, sf_dir):
    return ex.run_suite(prepared(spark, sf_dir), ExperimentConfig()).summary


@query("run_suite_facts")
def q_run_suite_facts(spark, sf_dir):
    """Sizes per experiment, and which paths the summary names."""
    s = q_run_suite(spark, sf_dir)
    return s.select("experiment", "train_size", "val_size", F.col("best_model_path").endswith(F.concat(F.lit("/models/"), F.col("experiment"))).alias("has_models"),
                    F.col("validation_results_path").endswith(F.concat(F.lit("/results/experiment="), F.col("experiment"))).alias("has_results"))


# The joint trainer in batches that suit the tables: a step is one job.
JOINT = ExperimentConfig(optimizer="adam", epochs=3, learning_rate=1e-3, train_batch_size=4096, valid_batch_size=256)


@query("epoch_batches")
def q_epoch_batches(spark, sf_dir):
    """Batch and place of every training row in three epochs, without an exchange of rows."""
    split = land(ex.suite_split(prepared(spark, sf_dir)), "split").filter(F.col("split") == "train")
    sizes = split.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))  # a row per experiment
    rows = split.join(sizes, "experiment")
    parts = [sp.epoch_batch(rows, F.col("n"), 16, e).select("experiment", "row_id", F.lit(e).alias("epoch"), "batch", "place") for e in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("train_joint")
def q_train_joint(spark, sf_dir):
    """The history of all seven experiments, trained together."""
    return ex.run_suite(prepared(spark, sf_dir), JOINT, export=False).train_history


@query("train_joint_facts")
def q_train_joint_facts(spark, sf_dir):
    """Per experiment: sizes, steps of an epoch, epochs without a gap, and a best loss below that of zero weights."""
    res = ex.run_suite(prepared(spark, sf_dir), JOINT, export=False)
    facts = res.train_history.groupBy("experiment").agg(
        (F.max("epoch") == F.count(F.lit(1))).alias("no_gaps"), (F.min("valid_loss") < 0.693).alias("learns"))
    steps = F.ceil(F.col("train_size") / JOINT.train_batch_size).cast("bigint").alias("steps")
    return facts.join(ex.split_sizes(res.split), "experiment").select("experiment", "train_size", "val_size", steps, "no_gaps", "learns")


@query("score_joint_facts")
def q_score_joint_facts(spark, sf_dir):
    """Every validation row of every experiment scored in one pass, with its labels."""
    cells = mt.to_long(ex.run_suite(prepared(spark, sf_dir), JOINT, export=False).pred)
    return cells.select("experiment", "row_id", "label", "y", F.col("p").between(0, 1).alias("p_is_probability"))
