"""The heads trained together against Spark ML's fits of the same number of iterations."""
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from labelbench.config import ExperimentConfig
from labelbench.operators import lbfgs
from labelbench.operators import train as tr
from labelbench.session import land

CFG = ExperimentConfig(epochs=6, weight_decay=1e-3)


@pytest.fixture(scope="module")
def joined(spark):
    """Validation rows that repeat training rows, so that all epochs run; a label of one class; texts without tokens."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(200):
        own = rng.choice(words, rng.integers(0, 12)).tolist()
        row = (int("w1" in own or rng.random() < 0.2), int("w2" in own), 0, None if i == 7 else "the " * (i != 9) + " ".join(own))
        rows += [("e" if i % 3 else "f", 2 * i + k, "valid" if k else "train", *row) for k in (0, 1)]
    df = spark.createDataFrame(rows, "experiment string, row_id long, split string, a int, b int, c int, description string")
    return land(df.join(tr.featurize(df, 128, CFG), "row_id"), "joined", partition_by="experiment")


def test_takes_spark_mls_path(spark, joined, monkeypatch):
    monkeypatch.setattr(lbfgs, "CHUNK", 16)
    monkeypatch.setattr(lbfgs, "BLOCK", 32)
    models, history = tr.train_multilabel(joined, ["e", "f"], CFG, ["a", "b"])
    got = {(r.experiment, r.epoch): r for r in history.collect()}
    assert len(got) == 12
    for e in "ef":
        some = joined.filter((F.col("experiment") == e) & (F.col("split") == "train"))
        fits = {lab: LogisticRegression(labelCol=lab, maxIter=6, regParam=1e-3, family="binomial", standardization=False).fit(some) for lab in "ab"}
        paths = [m.summary.objectiveHistory for m in fits.values()]
        for k in range(1, 7):
            assert abs(got[e, k].train_loss - sum(p[k] for p in paths) / 2) < 1e-10
        for lab, m in fits.items():
            assert np.allclose(m.coefficients.toArray(), models[(e, lab)].coefficients.toArray(), atol=1e-8) and abs(m.intercept - models[(e, lab)].intercept) < 1e-8
        want = {r.row_id: [c.p for c in r.cells] for r in tr.score_rows({(e, lab): m for lab, m in fits.items()}, some, e).collect()}
        cells = {r.row_id: r.cells for r in tr.score_multilabel(models, joined, split="train").filter(F.col("experiment") == e).collect()}
        assert want.keys() == cells.keys() and all(np.allclose(want[i], [c.p for c in cells[i]], atol=1e-9) for i in want)
        truth = {r.row_id: [r.a, r.b] for r in some.collect()}
        assert all([c.y for c in cells[i]] == truth[i] for i in truth)


def test_no_vector_of_features_reaches_the_driver(spark, monkeypatch):
    """What a training collects does not grow with the vocabulary."""
    most, collect = {}, type(spark.range(1)).collect
    for n in (1, 40):
        df = spark.createDataFrame([("e", i, "train" if i % 4 else "valid", i % 2, " ".join(f"w{i * n + k}" for k in range(2 * n))) for i in range(40)],
                                   "experiment string, row_id long, split string, a int, description string")
        joined = land(df.join(tr.featurize(df, 1 << 14, CFG), "row_id"), "joined")
        seen = []
        with monkeypatch.context() as m:
            m.setattr(type(df), "collect", lambda self: seen.append(len(str(got := collect(self)))) or got)
            tr.train_multilabel(joined, ["e"], ExperimentConfig(epochs=2), ["a"])
        most[n] = max(seen)
    assert most[40] < 1.5 * most[1]


def test_one_class_and_saved_models(spark, joined, tmp_path):
    models, history = tr.train_multilabel(joined, ["f", "e"], ExperimentConfig(epochs=3), ["a", "c"])
    assert {(r.experiment, r.epoch) for r in history.collect()} == {("e", 1), ("f", 1)}  # the certain label's loss is NaN
    assert models[("e", "c")].intercept == -np.inf and models[("e", "c")].coefficients.numNonzeros() == 0
    folders = tr.save_models(models, str(tmp_path))
    assert folders["e"] == f"{tmp_path}/e"
    loaded = tr.load_models(str(tmp_path), ["e", "f"], ["a", "c"])
    assert all(loaded[k].coefficients == m.coefficients and loaded[k].intercept == m.intercept for k, m in models.items())
    a, b = ({(r.experiment, r.row_id): r.cells for r in tr.score_multilabel(m, joined).collect()} for m in (models, loaded))
    assert a == b and len(a) == 200
    with pytest.raises(ValueError, match="no training rows in none"):
        tr.train_multilabel(joined, ["e", "none"], CFG, ["a"])


def test_a_reader_holds_few_chunks_at_once(spark, joined, monkeypatch):
    """A Parquet reader unpacks a row group at once, so one has a bounded number of chunks or blocks, and no array of cells in it."""
    groups, large = {}, {}

    def noted(df, name, *a, **k):
        out = land(df, name, *a, **k)
        for f in out.inputFiles():
            meta = pq.ParquetFile(f.removeprefix("file://")).metadata
            groups[name] = max([groups.get(name, 0), *(meta.row_group(g).num_rows for g in range(meta.num_row_groups))])
            large[name] = max([large.get(name, 0), *(meta.row_group(g).column(c).num_values for g in range(meta.num_row_groups) for c in range(meta.num_columns)
                                                     if meta.row_group(g).column(c).path_in_schema.split(".")[0] in ("feature", "value", "wanted"))])
        return out

    monkeypatch.setattr(lbfgs, "land", noted)
    monkeypatch.setattr(lbfgs, "CHUNK", 8)
    monkeypatch.setattr(lbfgs, "BLOCK", 8)
    tr.train_multilabel(joined.coalesce(1), ["e", "f"], ExperimentConfig(epochs=1), ["a", "b"])
    assert 1 < groups["lbfgs-chunks"] <= 4 and groups["lbfgs-state"] <= 4 and groups["lbfgs-margins"] <= 4 and groups["lbfgs-weights"] <= 4
    assert large["lbfgs-chunks"] <= 4  # a number for each chunk, not for each cell
