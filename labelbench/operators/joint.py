"""All heads of all experiments trained together by mini-batch Adam, and scored in one pass.

A head is one (experiment, label): logistic regression on hashed token counts, as in ``train``.  Here
an epoch goes on from the one before: a feature's weights and both moments are kept per experiment, in
rows by block of features with all labels side by side.  Step k takes batch k of every experiment that
still trains, so the number of jobs follows the batches and epochs, not experiments or labels.

A step is one plan in three exchanges:

* pull - a chunk of rows asks the blocks for the weights of its distinct features, once each;
* compute - the chunk has margins, losses and its part of the gradient;
* push - a block sums the parts of its features and makes the Adam step.

A feature of every text is one row per chunk in each exchange, never one per text, and no weight
passes through the driver.  A step reads and writes only the features of its own batch.  The batches of
an epoch are known when it begins, so each feature's next one is: the step makes the steps up to there
at once (a feature without rows moves by its moments and the decay alone) and leaves the result for the
batch that wants it.  Batches far ahead share a folder, which is dealt out when their turn comes.
Features that no batch had yet are zero and aren't kept.

An epoch ends with the validation loss, the mean of the batches' means as for the training loss; the
state and the history are then committed by one rename, and a restart goes on from the last epoch
committed.  An experiment whose loss gets worse (or NaN) stops, and its best epoch's weights are its model.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ExperimentConfig
from ..constants import LABELS
from ..session import drop_landed, land, note_landed, recording, shared_path
from .split import epoch_batch
from .train import _model_tokens

BLOCK, BLOCKS, MOST = 4096, 16, 1 << 20  # least features to a block; blocks, more only if one would have above MOST features
CHUNK = 4096  # rows of one experiment to a chunk, at most
FILES = 8  # to a batch, at most
WRITERS = 32  # tasks that write a step's state, at most: each has a file per folder
LOSS = -1  # the block of a step's losses
DEAL = -1  # the batch before the first
B1, B2, EPS = 0.9, 0.999, 1e-8
STATE = "exp int, block long, idx array<long>, w binary, m binary, v binary, next int"
PACKED = "batch long, chunk long, exp int, block long, ids binary, row_id array<long>, y array<int>, n_cells array<int>, feature binary, count binary"
HISTORY = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("epoch", T.IntegerType()),
                        T.StructField("train_loss", T.DoubleType()), T.StructField("valid_loss", T.DoubleType())])


@dataclass(frozen=True)
class JointModel:
    """Weights of all heads: ``weights`` has (exp, block, idx, w) rows, exp an experiment's number and w with a column per label."""

    weights: DataFrame
    width: int
    experiments: tuple[str, ...]
    labels: tuple[str, ...]


def hashed_tokens(text_col: str, width: int, max_len: int) -> Column:
    """Features of a text's first ``max_len - 2`` tokens, repeats included, and the feature ``width`` that every row has."""
    some = F.coalesce(_model_tokens(text_col, max_len), F.array().cast("array<string>"))
    return F.concat(F.transform(some, lambda t: F.pmod(F.xxhash64(t), F.lit(width))), F.array(F.lit(width).cast("bigint")))


def counted(texts: DataFrame, on: list[str], width: int, max_len: int, text_col: str) -> DataFrame:
    """(on, feats, counts): the distinct features of every text in order, and how often it has each, as 64- and 32-bit numbers end to end."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(on))
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            cells, counts = np.unique(np.repeat(np.arange(len(n)), n) * (width + 1) + lists.flatten().to_numpy(), return_counts=True)
            row, feature = np.divmod(cells, width + 1)
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
            yield pa.record_batch([*batch.columns[:len(on)], _blobs(feature.astype(np.int64), off), _blobs(counts.astype(np.int32), off)], names=[*on, "feats", "counts"])

    both = T.StructType([T.StructField("feats", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    some = texts.select(*on, hashed_tokens(text_col, width, max_len).alias("feats"))
    return some.mapInArrow(count, T.StructType([*some.schema.fields[:len(on)], *both.fields]))


def _blobs(x: np.ndarray, off: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes: Spark hands those on in one piece, arrays number by number."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(col: pa.ChunkedArray, kind=np.int64) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in col.to_pylist()]


def _number(names, col: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(col == name, F.lit(i)).otherwise(out)
    return out


def _one(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def span(width: int) -> int:
    """Features to a block."""
    return min(max(BLOCK, -(-(width + 1) // BLOCKS)), MOST)


def _pack(t: pa.Table, span: int) -> pa.Table:
    """A chunk's rows as one (its block is null): sparse counts by row, over the chunk's own sorted features; and those by block, a row each."""
    t = t.sort_by("row_id")
    feats = t["feats"].to_pylist()
    wanted, feature = np.unique(np.frombuffer(b"".join(feats), np.int64), return_inverse=True)
    block = wanted // span
    first = np.flatnonzero(np.diff(block, prepend=-1))
    more, names = [None] * len(first), ("batch", "chunk", "exp")
    of = {c: pa.array([t[c][0].as_py()] * (len(first) + 1), t[c].type) for c in names}
    return pa.table({**of, "block": pa.array([None, *block[first]], pa.int64()),
                     "ids": pa.array([None, *[wanted[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(wanted)), strict=True)]], pa.binary()),
                     "row_id": pa.array([t["row_id"].to_numpy(), *more], pa.list_(pa.int64())), "y": pa.array([t["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False), *more], pa.list_(pa.int32())),
                     "n_cells": pa.array([[len(x) // 8 for x in feats], *more], pa.list_(pa.int32())), "feature": pa.array([feature.astype(np.int32).tobytes(), *more], pa.binary()),
                     "count": pa.array([b"".join(t["counts"].to_pylist()), *more], pa.binary())})


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Chunks of (batch, chunk, exp, row_id, y, feats, counts) rows; a chunk is of one experiment."""
    of = span(width)
    return rows.groupBy("batch", "chunk").applyInArrow(lambda t: _pack(t, of), PACKED)


def _asked(chunks: DataFrame) -> DataFrame:
    """(batch, chunk, exp, block, ids): what chunks want of every block."""
    return chunks.filter("block IS NOT NULL").select("batch", "chunk", "exp", "block", "ids")


def _ids(col: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in col]


def _uses(t: pa.Table) -> pa.Table:
    """Per batch the features of a block that it wants and the next batch that wants each (-1: none)."""
    some = _numbers(t["ids"])
    ids, batch = np.concatenate(some), np.repeat(t["batch"].to_numpy(), [len(x) for x in some])
    order = np.lexsort((batch, ids))
    ids, batch = ids[order], batch[order]
    keep = np.concatenate([[True], (ids[1:] != ids[:-1]) | (batch[1:] != batch[:-1])])
    ids, batch = ids[keep], batch[keep]
    follows = np.append(ids[1:] == ids[:-1], False)
    later = np.where(follows, np.append(batch[1:], 0), -1)
    head = np.concatenate([[True], ~follows[:-1]])
    ids, later, batch = np.concatenate([ids[head], ids]), np.concatenate([batch[head], later]), np.concatenate([np.full(head.sum(), DEAL), batch])
    order = np.argsort(batch, kind="stable")
    ids, later, batch = ids[order], later[order], batch[order]
    first = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))
    cut = list(zip(first, np.append(first[1:], len(batch)), strict=True))
    return pa.table({"batch": pa.array(batch[first], pa.int64()), "exp": pa.array([t["exp"][0].as_py()] * len(cut), pa.int32()),
                     "block": pa.array([t["block"][0].as_py()] * len(cut), pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in cut], pa.binary()),
                     "later": pa.array([later[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary())})


def _pull(heads: int):
    def pull(asked: pa.Table, state: pa.Table) -> pa.Table:
        out = []
        if len(state) and len(asked):
            idx, w = np.concatenate(_ids(state["idx"])), np.frombuffer(b"".join(state["w"].to_pylist())).reshape(-1, heads)
            order = np.argsort(idx, kind="stable")
            idx, w = idx[order], w[order]
        for ids in _numbers(asked["ids"]):
            x = np.zeros((len(ids), heads))
            if len(state):
                at = np.minimum(np.searchsorted(idx, ids), len(idx) - 1)
                x = np.where((idx[at] == ids)[:, None], w[at], 0.0)  # a feature that no training row has weighs nothing
            out.append(x.tobytes())
        return pa.table({"chunk": asked["chunk"], "block": asked["block"], "ids": asked["ids"], "w": pa.array(out, pa.binary())})
    return pull


def _chunk(t: pa.Table, pulled: pa.Table, n_labels: int):
    """A chunk's arrays and the margins of its rows, by weights in the order of the blocks."""
    row_id, y, n = (t[c][0].values.to_numpy() for c in ("row_id", "y", "n_cells"))
    feature, count = (np.frombuffer(t[c][0].as_py(), np.int32) for c in ("feature", "count"))
    w = np.frombuffer(b"".join(pulled["w"].to_pylist())).reshape(-1, n_labels)
    row = np.repeat(np.arange(len(n)), n)
    margin = np.add.reduceat(count[:, None] * w[feature], np.cumsum(n) - n)
    y = y.reshape(-1, n_labels)
    loss = np.maximum(margin, 0) - margin * y + np.log1p(np.exp(-np.abs(margin)))
    return row_id, y, row, feature, count, margin, loss


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _with_weights(chunks: DataFrame, weights: DataFrame, heads: int, compute, schema: str) -> DataFrame:
    """``compute(chunk, pulled weights)`` of every chunk; the weights are in the order of the blocks."""
    state = weights.select(F.col("exp").alias("of_exp"), F.col("block").alias("of"), "idx", "w")
    pulled = _asked(chunks).select("chunk", "exp", "block", "ids").groupBy("exp", "block").cogroup(state.groupBy("of_exp", "of")).applyInArrow(
        lambda a, s: _pull(heads)(a, s), "chunk long, block long, ids binary, w binary")
    rows = chunks.filter("block IS NULL").select("chunk", "exp", "row_id", "y", "n_cells", "feature", "count")
    return rows.groupBy("chunk").cogroup(pulled.withColumnRenamed("chunk", "by").groupBy("by")).applyInArrow(
        lambda t, p: compute(t, p.sort_by("block")), schema)


def _gradient(n_labels: int, batch_rows: list[int]):
    """Parts of the gradient of each experiment's mean loss over a batch, and of that loss."""
    def compute(t: pa.Table, pulled: pa.Table) -> pa.Table:
        exp = t["exp"][0].as_py()
        per = 1 / (max(1, batch_rows[exp]) * n_labels)
        _, y, row, feature, count, margin, loss = _chunk(t, pulled, n_labels)
        rest = (sigmoid(margin) - y) * per
        ids = pulled["ids"].to_pylist()
        stop = np.cumsum([len(x) // 8 for x in ids])
        g = np.stack([np.bincount(feature, count * rest[row, j], stop[-1]) for j in range(n_labels)], axis=1)
        names = [LOSS, *pulled["block"].to_pylist()]
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()] * len(names), pa.int64()), "exp": pa.array([exp] * len(names), pa.int32()), "block": pa.array(names, pa.int64()),
                         "ids": pa.array([b"", *ids], pa.binary()),
                         "g": pa.array([(loss * per).sum(0).tobytes(), *[x.tobytes() for x in np.split(g, stop[:-1])]], pa.binary())})
    return compute


PARTS = "chunk long, exp int, block long, ids binary, g binary"


def _adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray | float, step: int, cfg: ExperimentConfig) -> None:
    """One step, in place."""
    g = g + cfg.weight_decay * w
    m *= B1
    m += (1 - B1) * g
    v *= B2
    v += (1 - B2) * g * g
    w -= cfg.learning_rate / (1 - B1 ** step) * m / (np.sqrt(v) / np.sqrt(1 - B2 ** step) + EPS)


AT_ONCE = 4096  # features that make their steps together: what stays in the cache


def _push(n_labels: int, k: int, epoch: int, batches: list[int], near: int, cfg: ExperimentConfig):
    """The Adam step of batch ``k`` for the features of a block, and their steps up to the next batch that wants each.

    ``k`` = DEAL makes no step of its own.  Rows are for ``folder``: the next batch, its ``near`` batches or the epoch's end.
    """
    def push(key, parts: pa.Table | None, side: pa.Table) -> pa.Table:
        exp, block = (x.as_py() for x in key)
        if block == LOSS:
            total = np.sum([np.frombuffer(b) for b in parts.sort_by("chunk")["g"].to_pylist()], axis=0)
            return pa.table({"exp": pa.array([exp], pa.int32()), "block": pa.array([block], pa.int64()), "idx": pa.array([[0]], pa.list_(pa.int64())), "w": [total.tobytes()],
                             "m": [b""], "v": [b""], "next": pa.array([k], pa.int32()), "folder": ["loss"]})
        wants = side["later"].is_valid()
        uses, state = side.filter(wants), side.filter(side["w"].is_valid())
        idx, later = _numbers(uses["ids"])[0], _numbers(uses["later"], np.int32)[0]
        order = np.argsort(np.where(later < 0, batches[exp], later), kind="stable")  # those with the fewest steps first
        place = np.empty(len(idx), np.int64)
        place[order] = np.arange(len(idx))
        w, m, v = (np.zeros((len(idx), n_labels)) for _ in range(3))
        if len(state):
            at = place[np.searchsorted(idx, np.concatenate(_ids(state["idx"])))]
            for x, name in ((w, "w"), (m, "m"), (v, "v")):
                x[at] = np.frombuffer(b"".join(state[name].to_pylist())).reshape(-1, n_labels)
        steps = (epoch - 1) * batches[exp] + k + 1
        if k != DEAL:
            g = np.zeros_like(w)
            parts = parts.sort_by("chunk")  # always the same order of sums
            for ids, blob in zip(_numbers(parts["ids"]), parts["g"].to_pylist(), strict=True):
                g[place[np.searchsorted(idx, ids)]] += np.frombuffer(blob).reshape(-1, n_labels)
            _adam(w, m, v, g, steps, cfg)
        idx, later = idx[order], later[order]
        gap = np.where(later < 0, batches[exp], later) - k - 1
        for a in range(0, len(idx), AT_ONCE):
            own = gap[a:a + AT_ONCE]
            b = a + len(own)
            for s in range(own[-1]):
                lo = a + int(np.searchsorted(own, s, side="right"))
                _adam(w[lo:b], m[lo:b], v[lo:b], 0.0, steps + s + 1, cfg)
        cut = np.flatnonzero(np.diff(later, prepend=-2))
        cut = list(zip(cut, np.append(cut[1:], len(idx)), strict=True))
        turn = later[[a for a, _ in cut]].tolist()
        folder = ["end" if n < 0 else f"batch-{n}" if n // near == max(k, 0) // near else f"far-{n // near}" for n in turn]
        return pa.table({"exp": pa.array([exp] * len(cut), pa.int32()), "block": pa.array([block] * len(cut), pa.int64()),
                         "idx": pa.array([idx[a:b] for a, b in cut], pa.list_(pa.int64())),
                         **{name: pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for name, x in (("w", w), ("m", m), ("v", v))},
                         "next": pa.array(turn, pa.int32()), "folder": pa.array(folder, pa.string())})
    return push


def _whole(t: pa.Table, n_labels: int) -> pa.Table:
    """A block's rows as one, in the order of the features."""
    idx = np.concatenate(_ids(t["idx"]))
    order = np.argsort(idx, kind="stable")
    return pa.table({"exp": t["exp"].slice(0, 1), "block": t["block"].slice(0, 1), "idx": _one(idx[order], pa.int64()),
                     **{c: pa.array([np.frombuffer(b"".join(t[c].to_pylist())).reshape(-1, n_labels)[order].tobytes()], pa.binary()) for c in "wmv"},
                     "next": t["next"].slice(0, 1)})


class _Mail:
    """Rows of the state in folders by who reads them next: a batch, a run of batches, the epoch's end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_path(spark, "joint-state", unique=True)
        note_landed(self.path)

    def write(self, rows: DataFrame, of_batch: bool = True) -> None:
        """Tasks write what they made, without another exchange; what is of one batch is made by few, so that folders have few files."""
        if of_batch:
            rows = rows.coalesce(WRITERS)
        rows.write.mode("append").partitionBy("folder").parquet(self.path)

    def read(self, folder: str) -> DataFrame:
        path = f"{self.path}/folder={folder}"
        fs, p = _hadoop(self.spark, path)
        return self.spark.read.schema(STATE).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], STATE)

    def drop(self, folder: str) -> None:
        drop_landed(self.spark, [f"{self.path}/folder={folder}"])


def _train_epoch(chunks: DataFrame, uses: DataFrame, state: DataFrame | None, n_labels: int, epoch: int, batches: list[int],
                 n_train: list[int], cfg: ExperimentConfig) -> _Mail:
    """The steps of an epoch; its end and its losses are in the mail."""
    mail, n_steps = _Mail(chunks.sparkSession), max(batches)
    near = math.isqrt(n_steps - 1) + 1

    def side(k: int, rows: DataFrame) -> DataFrame:
        return rows.select("exp", "block", "idx", "w", "m", "v").unionByName(uses.filter(F.col("batch") == k).select("exp", "block", "ids", "later"), allowMissingColumns=True)

    out = STATE + ", folder string"
    if state is not None:
        deal = _push(n_labels, DEAL, epoch, batches, near, cfg)
        mail.write(side(DEAL, state).groupBy("exp", "block").applyInArrow(lambda key, t: deal(key, None, t), out), of_batch=False)
    for k in range(n_steps):
        if k and k % near == 0:
            mail.write(mail.read(f"far-{k // near}").withColumn("folder", F.concat(F.lit("batch-"), F.col("next").cast("string"))))
            mail.drop(f"far-{k // near}")
        now = mail.read(f"batch-{k}")
        held = [min(cfg.train_batch_size, n - k * cfg.train_batch_size) for n in n_train]
        parts = _with_weights(chunks.filter(F.col("batch") == k), now, n_labels, _gradient(n_labels, held), PARTS)
        own = side(k, now).withColumnsRenamed({"exp": "of_exp", "block": "of"})
        mail.write(parts.groupBy("exp", "block").cogroup(own.groupBy("of_exp", "of")).applyInArrow(_push(n_labels, k, epoch, batches, near, cfg), out))
        mail.drop(f"batch-{k}")
    return mail


def _loss(t: pa.Table) -> pa.Table:
    """An experiment's losses of all steps added up, in their order."""
    total = 0.0
    for blob in t.sort_by("next")["w"].to_pylist():
        total += float(np.frombuffer(blob).sum())
    return pa.table({"exp": t["exp"].slice(0, 1), "loss": [total]})


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_state(done: str, state: DataFrame) -> str:
    """Write an epoch's state under another name than the epoch's."""
    part = f"{done}.part-{uuid.uuid4().hex[:12]}"
    state.write.mode("overwrite").parquet(f"{part}/state")
    return part


def _commit(spark: SparkSession, part: str, done: str, history: list[tuple]) -> None:
    """Add the history and rename: an epoch is there as a whole or not at all."""
    spark.createDataFrame(history, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{part}/history")
    fs, target = _hadoop(spark, done)
    if not fs.rename(_hadoop(spark, part)[1], target):
        raise OSError(f"could not commit {done}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the epochs committed under ``path``."""
    fs, folder = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[6:]) for n in names if n.startswith("epoch-") and n[6:].isdigit())


def best_epochs(history: list[tuple]) -> tuple[dict[str, int], set[str]]:
    """Each experiment's best epoch, and the experiments that have stopped."""
    best: dict[str, tuple[float, int]] = {}
    stopped = set()
    for exp, epoch, _, valid in sorted(history, key=lambda h: h[1]):
        if exp not in best:
            best[exp] = (valid, epoch)
            if math.isnan(valid):
                stopped.add(exp)
        elif valid <= best[exp][0]:
            best[exp] = (valid, epoch)
        else:  # worse, or NaN
            stopped.add(exp)
    return {e: k for e, (_, k) in best.items()}, stopped


def train(split_df: DataFrame, texts: DataFrame, experiments: list[str], width: int, cfg: ExperimentConfig = ExperimentConfig(),
          labels: list[str] | None = None, on: tuple[str, ...] = ("row_id",), path: str | None = None,
          text_col: str = "description") -> tuple[JointModel, DataFrame]:
    """Train all heads; the model of each experiment's best epoch and the history.  Runs the training.

    ``split_df`` has (experiment, row_id, split, split_rank, labels); ``texts`` the text by the columns
    ``on``.  Epochs are committed under ``path``; those already there are not trained again, so the
    call can be repeated after a failure, or with more epochs.  An experiment without training rows raises.
    """
    labels = labels or LABELS
    spark, n_exp, n_lab = split_df.sparkSession, len(experiments), len(labels)
    path = (path or shared_path(spark, "joint-model", unique=True)).rstrip("/")
    feats = counted(texts, list(on), width, cfg.max_len, text_col)
    rows = land(split_df.join(feats, list(on)).select(
        "experiment", _number(experiments, F.col("experiment")).alias("exp"), "row_id", "split", "split_rank",
        F.array(*[F.col(c).cast("int") for c in labels]).alias("y"), "feats", "counts").filter("exp IS NOT NULL"), "joint-rows")
    sizes = {(r.exp, r.split): r.n for r in rows.groupBy("exp", "split").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows an experiment
    n_train = [sizes.get((e, "train"), 0) for e in range(n_exp)]
    if 0 in n_train:
        raise ValueError(f"no training rows in {experiments[n_train.index(0)]}")
    size = cfg.train_batch_size
    batches = [-(-n // size) for n in n_train]
    valid = rows.filter("split = 'valid'").withColumn("batch", F.floor((F.col("split_rank") - 1) / cfg.valid_batch_size).cast("bigint"))
    valid = land(packed(valid.withColumn("chunk", F.floor((F.col("split_rank") - 1) / CHUNK).cast("bigint") * n_exp + F.col("exp"))
                        .withColumn("y", F.concat("y", F.array(F.col("batch").cast("int")))).withColumn("batch", F.lit(0).cast("bigint")), width), "joint-valid")

    def valid_losses(state: DataFrame) -> dict[int, float]:
        def compute(t: pa.Table, pulled: pa.Table) -> pa.Table:
            y = t["y"][0].values.to_numpy().reshape(-1, n_lab + 1)
            t = t.set_column(t.schema.get_field_index("y"), "y", _one(y[:, :-1].reshape(-1), pa.int32()))
            *_, loss = _chunk(t, pulled, n_lab)
            return pa.table({"exp": pa.array([t["exp"][0].as_py()] * len(y), pa.int32()), "batch": y[:, -1], "loss": loss.mean(1)})
        cells = _with_weights(valid, state, n_lab, compute, "exp int, batch int, loss double")
        per = cells.groupBy("exp", "batch").agg(F.avg("loss").alias("loss")).groupBy("exp").agg(F.avg("loss").alias("loss"))
        return {r.exp: r.loss for r in per.collect()}  # one row an experiment

    done = committed(spark, path)
    history = [tuple(h) for k in done for h in spark.read.schema(HISTORY).parquet(f"{path}/epoch-{k}/history").collect()]
    state = spark.read.schema(STATE).parquet(f"{path}/epoch-{done[-1]}/state") if done else None
    if done and state.filter("exp IS NOT NULL").isEmpty():
        raise ValueError(f"{path} has epochs of another format")
    train_rows = rows.filter("split = 'train'")
    for epoch in range(done[-1] + 1 if done else 1, cfg.epochs + 1):
        _, stopped = best_epochs(history)
        going = [i for i, e in enumerate(experiments) if e not in stopped]
        if not going:
            break
        some = F.col("exp").isin(going)
        dealt = epoch_batch(train_rows.filter(some), F.element_at(F.array(*[F.lit(n).cast("bigint") for n in n_train]), F.col("exp") + 1), size, epoch, cfg.seed)
        with recording() as paths:
            chunks = packed(dealt.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("bigint") * n_exp + F.col("exp")), width)
            chunks = land(chunks.repartition("batch", F.col("chunk") % FILES), "joint-chunks", partition_by="batch")
            uses = _asked(chunks).select("batch", "exp", "block", "ids").groupBy("exp", "block").applyInArrow(_uses, "batch long, exp int, block long, ids binary, later binary")
            uses = land(uses.repartition("batch", F.when(F.col("batch") == DEAL, F.col("block") * n_exp + F.col("exp")).otherwise(F.col("block") % FILES)), "joint-uses", partition_by="batch")
            mail = _train_epoch(chunks, uses, state.filter(some) if state is not None else None, n_lab, epoch, [b if i in going else 0 for i, b in enumerate(batches)], n_train, cfg)
            lost = {r.exp: r.loss for r in mail.read("loss").groupBy("exp").applyInArrow(_loss, "exp int, loss double").collect()}  # one row an experiment
            part = _write_state(f"{path}/epoch-{epoch}", mail.read("end").groupBy("exp", "block").applyInArrow(lambda t: _whole(t, n_lab), STATE))
            losses = valid_losses(spark.read.schema(STATE).parquet(f"{part}/state"))
            new_rows = [(experiments[i], epoch, lost[i] / batches[i], float(losses.get(i, math.nan))) for i in going]
            _commit(spark, part, f"{path}/epoch-{epoch}", new_rows)
        drop_landed(spark, paths)
        history += new_rows
        state = spark.read.schema(STATE).parquet(f"{path}/epoch-{epoch}/state")
    best, _ = best_epochs(history)
    kept = None
    for k in sorted(set(best.values())):
        own = spark.read.schema(STATE).parquet(f"{path}/epoch-{k}/state").filter(F.col("exp").isin([i for i, e in enumerate(experiments) if best[e] == k]))
        kept = own if kept is None else kept.unionByName(own)
    weights = land(kept.select("exp", "block", "idx", "w"), "joint-model")
    return JointModel(weights, width, tuple(experiments), tuple(labels)), spark.createDataFrame(history, HISTORY)


def score(model: JointModel, rows: DataFrame, cfg: ExperimentConfig = ExperimentConfig(), text_col: str = "description") -> DataFrame:
    """(experiment, row_id, cells) of (experiment, row_id, text, labels) rows: one pass over the rows for all heads.

    ``cells`` are as in ``train.score_rows``; a row's own experiment has its heads applied.  Lands the packed rows.
    """
    n_exp, n_lab = len(model.experiments), len(model.labels)
    truth = [F.col(c).cast("int") if c in rows.columns else F.lit(None).cast("int") for c in model.labels]
    rows = rows.select(_number(model.experiments, F.col("experiment")).alias("exp"), "row_id", F.array(*[F.coalesce(c, F.lit(-1)) for c in truth]).alias("y"),
                       F.col(text_col).alias("text")).filter("exp IS NOT NULL")
    some = counted(rows, ["exp", "row_id", "y"], model.width, cfg.max_len, "text")
    n = rows.count()
    some = some.withColumn("batch", F.lit(0).cast("bigint")).withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(max(1, -(-n // (n_exp * CHUNK))))) * n_exp + F.col("exp"))
    chunks = land(packed(some, model.width), "joint-score")

    def compute(t: pa.Table, pulled: pa.Table) -> pa.Table:
        row_id, y, *_, margin, _ = _chunk(t, pulled, n_lab)
        return pa.table({"exp": pa.array([t["exp"][0].as_py()] * len(row_id), pa.int32()), "row_id": row_id, "y": _lists(y, n_lab, pa.int32()), "p": _lists(sigmoid(margin), n_lab, pa.float64())})

    got = _with_weights(chunks, model.weights, n_lab, compute, "exp int, row_id long, y array<int>, p array<double>")
    cells = F.array(*[F.struct(F.lit(lab).alias("label"), F.when(F.col("y")[i] >= 0, F.col("y")[i]).alias("y"), F.col("p")[i].alias("p"))
                      for i, lab in enumerate(model.labels)])
    name = F.element_at(F.array(*[F.lit(e) for e in model.experiments]), F.col("exp") + 1)
    return got.select(name.alias("experiment"), "row_id", cells.alias("cells"))


def _lists(x: np.ndarray, n: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n), pa.int32()), pa.array(x.reshape(-1), kind))

