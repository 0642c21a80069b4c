"""Multi-label classifier (binary relevance), replacing the neural network.

One logistic regression per (experiment, label) on hashed token counts: the same objective per
label as a sigmoid output trained with binary cross-entropy, ``weight_decay`` being Spark ML's ``regParam``.

An epoch is one iteration of Spark ML's optimiser (L-BFGS), which ``lbfgs`` runs for all heads of all
experiments at once with their vectors in blocks.  After every epoch the validation loss of the
experiment is measured; the first epoch whose loss is worse than the best so far (or NaN) ends
its training, and the models of the best epoch are kept.

The rows come joined to their features once.  Scoring yields the wide prediction table
``(experiment, row_id, cells)``; it also takes models that Spark ML fitted.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ExperimentConfig
from ..constants import LABELS, SAFE_NAME_FALLBACK, SAFE_NAME_OTHER_RUN, SAFE_NAME_STRIP_CHARS
from ..functions.text import tokens
from . import lbfgs


class Head:
    """The model of one (experiment, label): a column of the weights in blocks that the heads of a training share."""

    def __init__(self, weights: DataFrame, intercepts: np.ndarray, exp: int, label: int, width: int):
        self.weights, self.intercepts, self.exp, self.label, self.numFeatures = weights, intercepts, exp, label, width

    @property
    def intercept(self) -> float:
        return float(self.intercepts[self.exp, self.label])

    @cached_property
    def coefficients(self) -> SparseVector:
        """The weights of all features, on the driver: for a look at a small model only."""
        at, n = {}, self.intercepts.shape[1]
        for r in self.weights.filter(F.col("exp") == self.exp).collect():
            at.update(zip(r.idx, np.frombuffer(r.w).reshape(-1, n)[:, self.label].tolist(), strict=True))
        return Vectors.sparse(self.numFeatures, at)


Models = dict[tuple[str, str], Head | LogisticRegressionModel]


def safe_name(name: str) -> str:
    """``functions.text.sanitize_name`` for a name the driver holds."""
    return re.sub(SAFE_NAME_OTHER_RUN, "_", name.strip()).strip(SAFE_NAME_STRIP_CHARS) or SAFE_NAME_FALLBACK


def _model_tokens(text_col: str, max_len: int) -> Column:
    return F.slice(tokens(text_col), 1, max_len - 2)


def feature_width(df: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), text_col: str = "description") -> int:
    """A power of two of at least twice the distinct tokens (estimated).  Runs a job."""
    n = df.select(F.explode(_model_tokens(text_col, cfg.max_len)).alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    return 1 << math.ceil(math.log2(max(2 * n, 16)))


def featurize(df: DataFrame, width: int, cfg: ExperimentConfig = ExperimentConfig(), text_col: str = "description",
              id_cols: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(ids, features): hashed counts of the first ``max_len - 2`` tokens, one row per sentence."""
    tf = HashingTF(inputCol="_tokens", outputCol="features", numFeatures=width)
    return tf.transform(df.select(*id_cols, F.coalesce(_model_tokens(text_col, cfg.max_len), F.array().cast("array<string>")).alias("_tokens"))) \
        .select(*id_cols, "features")


def _with_margins(models: Models, exp: str, df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows with one margin ``_x{i}`` and one probability ``_p{i}`` per label."""
    for i, lab in enumerate(labels):
        m = models[(exp, lab)].copy({})
        m.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
        df = m.transform(df).withColumns({f"_x{i}": vector_to_array(f"_raw{i}")[1], f"_p{i}": vector_to_array(f"_prob{i}")[1]}) \
            .drop(f"_prob{i}", f"_raw{i}", f"_pred{i}")
    return df


def train_multilabel(joined: DataFrame, experiments: list[str], cfg: ExperimentConfig = ExperimentConfig(),
                     labels: list[str] | None = None, key: str = "experiment") -> tuple[Models, DataFrame]:
    """Fit one model per (experiment, label) on the rows with ``split = 'train'``, epoch by epoch.

    Returns the models of each experiment's best epoch and the history ``(experiment, epoch,
    train_loss, valid_loss)``; ``train_loss`` is the mean of the labels' objectives.  An experiment
    without training rows raises.  A label with only one class in the training rows gets a model
    that gives that class probability 1, with loss 0.  An experiment whose first validation loss
    is NaN (no validation rows) ends there and keeps that epoch's models.  Runs the fits.
    """
    labels = labels or LABELS
    weights, intercepts, history = lbfgs.fit(joined, experiments, labels, key, cfg.epochs, cfg.weight_decay)
    width = joined.select("features").first()[0].size
    models = {(e, lab): Head(weights, intercepts, i, j, width) for i, e in enumerate(experiments) for j, lab in enumerate(labels)}
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("epoch", T.IntegerType()),
                           T.StructField("train_loss", T.DoubleType()), T.StructField("valid_loss", T.DoubleType())])
    return models, joined.sparkSession.createDataFrame(history, schema)  # experiments x epochs rows


def _truth(rows: DataFrame, lab: str) -> Column:
    return F.col(lab).cast("int") if lab in rows.columns else F.lit(None).cast("int")


def _score_heads(models: Models, rows: DataFrame, exps: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """(keep, cells) of the rows that meet an experiment's condition, for heads that share their weights."""
    first = next(iter(exps))
    labels = [lab for e, lab in models if e == first]
    head = {e: models[(e, labels[0])] for e in exps}
    number = F.lit(None).cast("int")
    for e, c in exps.items():
        number = F.when(c, F.lit(head[e].exp)).otherwise(number)
    some = rows.select(*keep, F.array(*[_truth(rows, lab) for lab in labels]).alias("_y"), number.alias("_exp"), F.col("features").alias("_features")).filter("_exp IS NOT NULL")
    got = lbfgs.score(some, head[first].weights, head[first].intercepts)
    cells = F.array(*[F.struct(F.lit(lab).alias("label"), F.col("_y")[i].alias("y"), F.col("_p")[models[(first, lab)].label].alias("p"))
                      for i, lab in enumerate(labels)])
    return got.select(*keep, cells.alias("cells"))


def score_rows(models: Models, rows: DataFrame, exp: str, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keep, cells): every row with ``features`` scored by one experiment's models.

    ``y`` of a cell is the row's label where the table has that column, else NULL.  Heads land the rows.
    """
    labels = [lab for e, lab in models if e == exp]
    if isinstance(models[(exp, labels[0])], Head):
        return _score_heads(models, rows, {exp: F.lit(True)}, keep)
    d = _with_margins(models, exp, rows, labels)
    cells = F.array(*[F.struct(F.lit(lab).alias("label"), _truth(rows, lab).alias("y"), F.col(f"_p{i}").alias("p"))
                      for i, lab in enumerate(labels)])
    return d.select(*keep, cells.alias("cells"))


def score_multilabel(models: Models, joined: DataFrame, key: str = "experiment", split: str | None = "valid") -> DataFrame:
    """Wide predictions of every experiment's models on its rows (validation part by default).

    Heads trained or loaded together are applied in one pass."""
    rows = joined if split is None else joined.filter(F.col("split") == split)
    shared: dict[object, list[str]] = {}
    for exp in dict.fromkeys(e for e, _ in models):
        own = tuple((lab, m) for (e, lab), m in models.items() if e == exp)
        together = (id(own[0][1].weights), tuple((lab, m.label) for lab, m in own)) if isinstance(own[0][1], Head) else exp
        shared.setdefault(together, []).append(exp)
    out = None
    for exps in shared.values():
        if isinstance(next(m for (e, _), m in models.items() if e == exps[0]), Head):
            part = _score_heads(models, rows, {e: F.col(key) == e for e in exps}, (key, "row_id"))
        else:
            part = score_rows(models, rows.filter(F.col(key) == exps[0]), exps[0], (key, "row_id"))
        out = part if out is None else out.unionByName(part)
    return out


def score_text(models: Models, texts: DataFrame, exp: str, cfg: ExperimentConfig = ExperimentConfig(),
               text_col: str = "description", id_col: str = "row_id") -> DataFrame:
    """Label new, unlabelled text: (id, predicted_labels, probabilities).

    ``predicted_labels`` are the labels of a probability above the threshold, ``probabilities`` a
    map of all of them.  A NULL text scores like an empty one.
    """
    width = next(m.numFeatures for (e, _), m in models.items() if e == exp)
    scored = score_rows(models, featurize(texts, width, cfg, text_col, (id_col,)), exp, (id_col,))
    return scored.select(
        id_col, F.transform(F.filter("cells", lambda c: c["p"] > cfg.threshold), lambda c: c["label"]).alias("predicted_labels"),
        F.map_from_entries(F.transform("cells", lambda c: F.struct(c["label"], c["p"]))).alias("probabilities"))


def save_models(models: Models, path: str) -> dict[str, str]:
    """Write an experiment's models under ``path/<safe experiment name>``; the folder of each experiment.

    Heads of an experiment are one table, whose row of block -1 has their labels, intercepts and width;
    a model of Spark ML has a folder of its label.
    """
    folders = {}
    for exp in dict.fromkeys(e for e, _ in models):
        own = {lab: m for (e, lab), m in models.items() if e == exp}
        folders[exp] = f"{path.rstrip('/')}/{safe_name(exp)}"
        m = next(iter(own.values()))
        if not isinstance(m, Head):
            for lab, one in own.items():
                one.write().overwrite().save(f"{folders[exp]}/{lab}")
            continue
        blocks = m.weights.filter(F.col("exp") == m.exp).select("block", "idx", "w")
        head = blocks.sparkSession.createDataFrame(
            [(-1, [x.numFeatures for x in own.values()], m.intercepts[m.exp].astype(float).tobytes(), list(own), [x.label for x in own.values()])],
            "block long, idx array<long>, w binary, labels array<string>, columns array<int>")
        blocks.unionByName(head, allowMissingColumns=True).write.mode("overwrite").parquet(folders[exp])
    return folders


def load_models(path: str, experiments: list[str], labels: list[str] | None = None) -> Models:
    """Heads saved by ``save_models``, all of the experiments together."""
    labels = labels or LABELS
    spark = SparkSession.getActiveSession()
    tables = [spark.read.parquet(f"{path.rstrip('/')}/{safe_name(e)}") for e in experiments]
    heads = [t.filter("block = -1").first() for t in tables]  # a row per experiment
    weights = None
    for i, t in enumerate(tables):
        part = t.filter("block >= 0").select(F.lit(i).alias("exp"), "block", "idx", "w")
        weights = part if weights is None else weights.unionByName(part)
    intercepts = np.array([np.frombuffer(h.w) for h in heads])
    return {(e, lab): Head(weights, intercepts, i, heads[i].columns[heads[i].labels.index(lab)], heads[i].idx[0])
            for i, e in enumerate(experiments) for lab in labels}
