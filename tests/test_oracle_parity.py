"""Every registered query against its DuckDB twin on the smallest tables (the driver's
correctness gate runs the same comparison at sf0.01)."""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from labelbench.plans.registry import REGISTRY
from labelbench.sources.tables import TABLES
from tests.conftest import SF_SMALL

SQL = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}  # the llm queries are tested in tests/llm
SLOW = {"train_multilabel", "score_multilabel", "score_text", "run_experiment", "run_suite"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return sorted(cols), len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    spark_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[key])
    duck_rows = cur.fetchall()
    assert _digest(df.columns, spark_rows) == _digest([d[0] for d in cur.description], duck_rows)


def test_every_query_has_oracle_or_is_model_based():
    assert set(REGISTRY) - set(SQL) == SLOW
    assert set(SQL) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["position", "label", "positives"] and len(rows) == 6


def test_epochs_stop_and_best_is_kept(spark):
    """A tiny set whose training labels mislead: the validation loss rises, training stops, the first epoch is kept."""
    from labelbench.config import ExperimentConfig
    from labelbench.operators import history as hs
    from labelbench.operators import train as tr

    rows = [("e", i, "train" if i < 40 else "valid", i % 2 if i < 40 else 1 - i % 2, "odd word" if i % 2 else "even thing") for i in range(60)]
    df = spark.createDataFrame(rows, "experiment string, row_id long, split string, a int, description string")
    cfg = ExperimentConfig(epochs=4)
    width = tr.feature_width(df, cfg)
    assert width == 16
    joined = df.join(tr.featurize(df, width, cfg), "row_id")
    models, hist = tr.train_multilabel(joined, ["e"], cfg, ["a"])
    best = hs.best_epoch(hist).first()
    assert best.stopped_early and best.epochs_run == hist.count() == 2 and best.best_epoch == 1
    # the kept model is the first iteration's, and a full fit reaches the optimum of the separable part
    one, _ = tr.train_multilabel(joined, ["e"], ExperimentConfig(epochs=1), ["a"])
    assert one[("e", "a")].coefficients == models[("e", "a")].coefficients


def test_fit_reaches_the_optimum(spark):
    import numpy as np

    from labelbench.config import ExperimentConfig
    from labelbench.operators import train as tr

    rng = np.random.default_rng(0)
    words = [["red", "blue"][int(k)] for k in rng.integers(0, 2, 200)]
    y = [int(rng.random() < (0.8 if w == "red" else 0.3)) for w in words]
    df = spark.createDataFrame([("e", i, "valid" if i % 5 == 0 else "train", y[i], words[i]) for i in range(200)],
                               "experiment string, row_id long, split string, a int, description string")
    cfg = ExperimentConfig(epochs=25, weight_decay=0.0)
    joined = df.join(tr.featurize(df, 16, cfg), "row_id")
    models, _ = tr.train_multilabel(joined, ["e"], ExperimentConfig(epochs=1), ["a"])
    assert len(models) == 1
    from pyspark.ml.classification import LogisticRegression
    full = LogisticRegression(labelCol="a", maxIter=25, standardization=False).fit(joined.filter("split = 'train'"))
    p = {r.description: r.cells[0].p for r in tr.score_rows({("e", "a"): full}, joined, "e", ("description",)).collect()}
    for w in ("red", "blue"):  # one word per text: the optimum is the share of positives among its texts
        share = np.mean([y[i] for i in range(200) if words[i] == w and i % 5])
        assert abs(p[w] - share) < 1e-3


def test_one_class_label_and_new_text(spark):
    from labelbench.config import ExperimentConfig
    from labelbench.operators import train as tr

    df = spark.createDataFrame([("e", i, "valid" if i % 4 == 0 else "train", i % 2, 0, f"word{i % 2}") for i in range(24)],
                               "experiment string, row_id long, split string, a int, b int, description string")
    cfg = ExperimentConfig(epochs=2)
    joined = df.join(tr.featurize(df, 16, cfg), "row_id")
    models, hist = tr.train_multilabel(joined, ["e"], cfg, ["a", "b"])
    assert hist.filter("isnan(train_loss)").count() == 0
    new = spark.createDataFrame([(1, "word1"), (2, "word0"), (3, None), (4, "")], "row_id long, description string")
    got = {r.row_id: r for r in tr.score_text(models, new, "e", cfg).collect()}
    assert len(got) == 4 and all(r.probabilities["b"] == 0 for r in got.values()) and got[1].predicted_labels == ["a"]
    assert got[3].probabilities == got[4].probabilities


def test_models_saved_and_reloaded(spark):
    from pyspark.sql import functions as F

    from labelbench.config import ExperimentConfig
    from labelbench.operators import train as tr
    from labelbench.plans import experiment as ex
    from labelbench.plans.registry import prepared
    from labelbench.session import landed

    cfg = ExperimentConfig(epochs=2)
    with landed(spark):
        p = prepared(spark, SF_SMALL)
        res = ex.run_subset_experiment(p, lambda d: d.filter(F.col("ambuiguity") == 0), cfg, name="a/b 2024", export=False)
        kept = {r.row_id for r in p.filter(F.col("ambuiguity") == 0).select("row_id").collect()}
        assert {r.row_id for r in res.split.select("row_id").collect()} == kept
        loaded = tr.load_models(f"{res.results_path}/models", ["a/b 2024"])
        assert set(loaded) == set(res.models)
        assert all(loaded[k].coefficients == m.coefficients for k, m in res.models.items())
        s = res.summary.first()
        assert s.best_model_path.endswith("/models/a_b_2024") and s.validation_results_path is None
        assert s.train_size + s.val_size == len(kept) and res.train_history.columns == ["experiment", "epoch", "train_loss", "valid_loss"]
        files = res.split.inputFiles()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
