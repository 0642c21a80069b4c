"""The joint trainer against a numpy double that trains on dense matrices, one head at a time."""
import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelbench.config import ExperimentConfig
from labelbench.constants import LABELS
from labelbench.operators import joint, split
from labelbench.session import land

CFG = ExperimentConfig(optimizer="adam", epochs=3, learning_rate=0.05, weight_decay=1e-3, train_batch_size=10, valid_batch_size=4, test_size=0.2)
EXPS, WIDTH, USED = ["all", "odd"], 64, LABELS[:3]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(25)]
    rows = []
    for i in range(45):
        own = rng.choice(words, rng.integers(0, 9)).tolist()
        rows.append((i, " ".join(own) if i != 5 else None, *[int(f"w{k}" in own or rng.random() < 0.1) for k in range(3)]))
    table = land(spark.createDataFrame(rows, "row_id long, description string, " + ", ".join(f"{c} int" for c in USED)), "rows")
    both = table.withColumn("experiment", F.lit("all")).unionByName(table.filter("row_id % 2 = 1").withColumn("experiment", F.lit("odd")))
    return land(split.split_exact(both.drop("description"), CFG.test_size, CFG.seed, by=["experiment"]), "split"), table.select("row_id", "description")


def dense(split_df, texts, cfg):
    """{experiment: (history, {label: weights})} of plain dense Adam."""
    x = {r.row_id: np.bincount(r.f, minlength=WIDTH + 1) for r in texts.select("row_id", joint.hashed_tokens("description", WIDTH, cfg.max_len).alias("f")).collect()}
    out = {}
    for exp in EXPS:
        rows = [r for r in split_df.collect() if r.experiment == exp]
        train, valid = ([r for r in sorted(rows, key=lambda r: r.split_rank) if r.split == s] for s in ("train", "valid"))
        y = lambda some, lab: np.array([r[lab] for r in some], float)
        w, m, v = ({lab: np.zeros(WIDTH + 1) for lab in USED} for _ in range(3))
        history, best, t = [], (math.inf, None), 0
        for epoch in range(1, cfg.epochs + 1):
            primes = [split.EPOCH_PRIMES[(cfg.seed + epoch + k) % 7] for k in range(4)]
            p = next(q for q in primes if len(train) % q)
            shift = (cfg.seed * 7_919 + epoch * 104_729) % 2**31
            place = {(p * i + shift) % len(train): r for i, r in enumerate(train)}
            assert len(place) == len(train)
            order, losses = [place[k] for k in range(len(train))], []
            for a in range(0, len(order), cfg.train_batch_size):
                some, t, total = order[a:a + cfg.train_batch_size], t + 1, 0.0
                xs = np.array([x[r.row_id] for r in some], float)
                for lab in USED:
                    z = xs @ w[lab]
                    total += float(np.mean(np.logaddexp(0, z) - z * y(some, lab))) / len(USED)
                    g = xs.T @ (1 / (1 + np.exp(-z)) - y(some, lab)) / (len(some) * len(USED)) + cfg.weight_decay * w[lab]
                    m[lab] = 0.9 * m[lab] + 0.1 * g
                    v[lab] = 0.999 * v[lab] + 0.001 * g * g
                    w[lab] = w[lab] - cfg.learning_rate * (m[lab] / (1 - 0.9**t)) / (np.sqrt(v[lab] / (1 - 0.999**t)) + 1e-8)
                losses.append(total)
            held = []
            for a in range(0, len(valid), cfg.valid_batch_size):
                some = valid[a:a + cfg.valid_batch_size]
                zs = [np.array([x[r.row_id] for r in some], float) @ w[lab] for lab in USED]
                held.append(float(np.mean([np.mean(np.logaddexp(0, z) - z * y(some, lab)) for z, lab in zip(zs, USED)])))
            history.append((epoch, float(np.mean(losses)), float(np.mean(held))))
            if history[-1][2] <= best[0]:
                best = (history[-1][2], {lab: w[lab].copy() for lab in USED})
            else:
                break
        out[exp] = history, best[1], x
    return out


def history_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.epoch):
        out.setdefault(r.experiment, []).append((r.epoch, r.train_loss, r.valid_loss))
    return out


def test_equals_dense_adam_and_resumes(spark, data, tmp_path):
    split_df, texts = data
    want = dense(split_df, texts, CFG)
    # stopped after an epoch, with a part of the next one left behind, then gone on with
    path = str(tmp_path / "model")
    joint.train(split_df, texts, EXPS, WIDTH, replace(CFG, epochs=1), USED, path=path)
    (tmp_path / "model" / "epoch-2.part-9" / "state").mkdir(parents=True)
    model, history = joint.train(split_df, texts, EXPS, WIDTH, CFG, USED, path=path)
    got = history_of(history)
    for exp in EXPS:
        assert np.allclose(got[exp], want[exp][0], atol=1e-12)
    rows = split_df.filter("split = 'valid'").join(texts, "row_id")
    scored = joint.score(model, rows, CFG).collect()
    assert len(scored) == rows.count()
    truth = {(r.experiment, r.row_id): r for r in rows.collect()}
    for r in scored:
        _, w, x = want[r.experiment]
        for c in r.cells:
            assert c.y == truth[(r.experiment, r.row_id)][c.label]
            assert abs(c.p - 1 / (1 + math.exp(-float(x[r.row_id] @ w[c.label])))) < 1e-12


def test_more_chunks_and_blocks_give_the_same_losses(spark, data, monkeypatch):
    split_df, texts = data
    want = dense(split_df, texts, replace(CFG, epochs=1, train_batch_size=36))
    monkeypatch.setattr(joint, "CHUNK", 3)
    _, history = joint.train(split_df, texts, EXPS, WIDTH, replace(CFG, epochs=1, train_batch_size=36), USED)
    for exp, h in history_of(history).items():
        assert np.allclose(h, want[exp][0], atol=1e-12)


def test_new_text_and_unknown_words(spark, data):
    split_df, texts = data
    model, history = joint.train(split_df.filter("experiment = 'all' AND split = 'train'"), texts, ["all"], WIDTH, replace(CFG, epochs=4, train_batch_size=50), USED)
    assert [h[0] for h in history_of(history)["all"]] == [1]  # no validation rows: the loss is NaN and ends it
    new = spark.createDataFrame([("all", 1, "w1 w2 never seen"), ("all", 2, None), ("other", 3, "w1")], "experiment string, row_id long, description string")
    got = {r.row_id: r.cells for r in joint.score(model, new, CFG).collect()}
    assert set(got) == {1, 2} and all(c.y is None and 0 < c.p < 1 for cells in got.values() for c in cells)
    with pytest.raises(ValueError, match="no training rows in none"):
        joint.train(split_df, texts, ["all", "none"], WIDTH, CFG, USED)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 50), st.integers(0, 100))
def test_epoch_order_is_a_bijection(n, epoch, seed):
    turn = [split.EPOCH_PRIMES[(seed + epoch + k) % 7] for k in range(4)]
    p = next(q for q in turn if n % q)
    assert math.gcd(p, n) == 1 and len({p * x % n for x in range(n)}) == n


def test_epoch_order_in_spark(spark):
    for n in (1, 7, 65_537, 131_101 * 2):
        for epoch in (1, 2):
            d = spark.range(n).select(split.epoch_order(F.col("id"), F.lit(n), epoch).alias("k"))
            r = d.agg(F.countDistinct("k").alias("c"), F.min("k").alias("a"), F.max("k").alias("b")).first()
            assert (r.c, r.a, r.b) == (n, 0, n - 1)


def test_a_step_writes_only_the_features_of_its_batch(spark, monkeypatch):
    rows = [(i, f"all own{i}", i % 2) for i in range(12)]
    table = spark.createDataFrame(rows, f"row_id long, description string, {USED[0]} int")
    split_df = table.drop("description").select("*", F.lit("all").alias("experiment"), F.lit("train").alias("split"), (F.col("row_id") + 1).alias("split_rank"))
    written, write = [], joint._Mail.write

    def spy(self, rows):
        written.append({r.folder: r.n for r in rows.groupBy("folder").agg(F.sum(F.size("idx")).alias("n")).collect()})
        write(self, rows)
    monkeypatch.setattr(joint._Mail, "write", spy)
    _, history = joint.train(split_df, table.select("row_id", "description"), ["all"], 1 << 20, replace(CFG, epochs=1, train_batch_size=2), USED[:1])
    steps = [w for w in written if "loss" in w]
    # two words of their own, one that all rows have and the intercept; the six batches' own words go to the epoch's end at once
    assert len(steps) == 6 and all(sum(n for f, n in w.items() if f != "loss") == 4 for w in steps)
    assert [w.get("end") for w in steps] == [2, 2, 2, 2, 2, 4] and history.count() == 1


def test_a_batch_asks_for_each_feature_once(spark, monkeypatch):
    rows = [(i, f"all own{i % 7}", i % 2) for i in range(1100)]
    table = spark.createDataFrame(rows, f"row_id long, description string, {USED[0]} int")
    split_df = table.drop("description").select("*", F.lit("all").alias("experiment"), F.lit("train").alias("split"), (F.col("row_id") + 1).alias("split_rank"))
    asked, write, own_land = [], joint._Mail.write, joint.land

    def spy(df, name, **kw):
        out = own_land(df, name, **kw)
        if name == "joint-chunks":
            asked.extend(n for r in joint._asked(out).collect() for n in np.frombuffer(bytes(r.ids), np.int64).tolist())
        return out

    def no_exchange(self, rows):
        with monkeypatch.context() as m:
            m.setattr(type(rows), "repartition", lambda *_: pytest.fail("another exchange of the state"))
            write(self, rows)
    monkeypatch.setattr(joint, "land", spy)
    monkeypatch.setattr(joint._Mail, "write", no_exchange)
    _, history = joint.train(split_df, table.select("row_id", "description"), ["all"], 1 << 20, replace(CFG, epochs=1, train_batch_size=2000), USED[:1])
    # a word that all rows have, seven others and the intercept
    assert len(asked) == len(set(asked)) == 9 and history.count() == 1
