"""Logistic regression of all heads at once by L-BFGS, with no vector of features on the driver.

The optimiser is Spark ML's: features scaled and centred by their training rows, intercepts that start
at the log odds, ten remembered steps, and a line search by the strong Wolfe conditions.  Its
vectors live in a state table with a row per (experiment, block of features); the driver holds
inner products of them, which are enough to choose every head's direction and to check its length.
An iteration is three steps:

* pull - a chunk of rows asks the blocks for the point and the direction at its distinct features, and
  keeps both margins of every row;
* search - losses and slopes at any length follow from those margins: a few sums per head;
* push - a block sums the chunks' parts of the gradient, makes the step and its inner products.

Every head is at its own length; heads that have found one wait for the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_landed, land, recording

BLOCK = 4096  # features to a block
CHUNK = 1024  # rows of one experiment to a chunk, at most
AT_ONCE = 4  # chunks or blocks that a task reads or writes at once: a row of them has megabytes
MEMORY, TOLERANCE = 10, 1e-6
X, KEPT, G = 0, 1, 2  # the point, the best epoch's point, the gradient; remembered steps and changes follow
PACKED = "chunk long, exp int, train binary, y binary, n_cells binary, feature binary, value binary, wanted binary, sums binary, block array<long>, first array<int>, size array<int>"
ROWS = ("chunk", "exp", "train", "y", "n_cells", "feature", "value", "wanted")
STATE = "exp int, block long, idx array<long>, inv binary, mean binary, v binary, dots binary"
_NO_STATE = pa.schema([("exp", pa.int32()), ("block", pa.int64()), ("idx", pa.list_(pa.int64()))] + [(n, pa.binary()) for n in ("inv", "mean", "v", "dots")]).empty_table()
MARGINS = "chunk long, exp int, train binary, y binary, x binary, d binary"


class SearchFailed(Exception):
    """No step was found along a direction."""


def _one(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _bytes(values, kind) -> pa.Array:
    """Numbers as one value of bytes, which Spark hands on in one piece; arrays go number by number and are unpacked to several times their size."""
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def _numbers(blob, kind) -> np.ndarray:
    blob = blob.as_buffer()
    return np.frombuffer(blob, kind) if blob.size else np.zeros(0, kind)


def _floats(blob, *shape) -> np.ndarray:
    blob = blob.as_py() if hasattr(blob, "as_py") else blob
    return (np.frombuffer(blob) if blob else np.zeros(0)).reshape(*shape)


def cells_of(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells per row, features, values) of a column of ML vectors."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size, values = vectors.field("indices").value_lengths(), vectors.field("values")
    n = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if size.null_count:  # dense vectors among them
        some = vectors.field("indices").to_pylist()
        indices = np.concatenate([np.arange(k) if i is None else np.array(i, np.int64) for i, k in zip(some, n, strict=True)])
    else:
        indices = vectors.field("indices").flatten().to_numpy().astype(np.int64)
    return n, indices, values.flatten().to_numpy()


def _by_block(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block = wanted // BLOCK
    first = np.flatnonzero(np.diff(block, prepend=-1))
    return block[first], first, np.diff(first, append=len(wanted))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a partition's rows, each of one experiment, over their own sorted features; with each feature's sums of values and squares in the training rows."""
    chunk = TaskContext.get().partitionId() << 32
    for b in batches:
        exps = b.column("exp").to_numpy()
        for e in np.unique(exps):
            at = np.flatnonzero(exps == e)
            for k in range(0, len(at), CHUNK):
                t = b.take(pa.array(at[k:k + CHUNK]))
                n, features, values = cells_of(t.column("features"))
                wanted, local = np.unique(features, return_inverse=True)
                block, first, size = _by_block(wanted)
                train = t.column("train").to_numpy()
                on = np.repeat(train, n) == 1
                sums = _by_feature(len(wanted), local[on], np.stack([values[on], values[on] ** 2], 1))
                yield pa.record_batch([
                    pa.array([chunk], pa.int64()), pa.array([e], pa.int32()), _bytes(train, np.int32),
                    _bytes(t.column("y").flatten().to_numpy(), np.int32), _bytes(n, np.int32), _bytes(local, np.int32), _bytes(values, np.float64),
                    _bytes(wanted, np.int64), _bytes(sums, np.float64), _one(block, pa.int64()), _one(first, pa.int32()), _one(size, pa.int32())],
                    names=["chunk", "exp", "train", "y", "n_cells", "feature", "value", "wanted", "sums", "block", "first", "size"])
                chunk += 1


def _arrays(t: pa.Table, n_lab: int):
    train, y, n, feature = (_numbers(t[c][0], np.int32) for c in ("train", "y", "n_cells", "feature"))
    value, wanted = _numbers(t["value"][0], np.float64), _numbers(t["wanted"][0], np.int64)
    return train, y.reshape(-1, n_lab), np.repeat(np.arange(len(n)), n), feature, value, wanted


def _summed(rows: int, row: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of ``part`` by ascending ``row``."""
    out = np.zeros((rows, part.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(part, first)
    return out


def _parts(exp: int, chunk: int, wanted: np.ndarray, sums: np.ndarray) -> pa.Table:
    """Sums per feature as rows of blocks."""
    block, first, size = _by_block(wanted)
    cut = list(zip(first, first + size, strict=True))
    return pa.table({"of": pa.array([exp] * len(block), pa.int32()), "in": pa.array(block, pa.int64()), "chunk": pa.array([chunk] * len(block), pa.int64()),
                     "ids": pa.array([wanted[a:b].tobytes() for a, b in cut], pa.binary()), "g": pa.array([sums[a:b].tobytes() for a, b in cut], pa.binary())})


PARTS = "of int, in long, chunk long, ids binary, g binary"


def _by_feature(wanted: int, feature: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(feature, part[:, i], minlength=wanted) for i in range(part.shape[1])], 1)


def _first_state(chunks: DataFrame, n_train: list[int], n_lab: int) -> DataFrame:
    """Scales and centres of the features that vary in the training rows; points and gradients of zero."""
    def merge(t: pa.Table) -> pa.Table:
        exp = t["of"][0].as_py()
        t = t.sort_by("chunk")
        idx, at = np.unique(np.concatenate([_numbers(i, np.int64) for i in t["ids"]]), return_inverse=True)
        s, sq = _by_feature(len(idx), at, np.concatenate([_floats(g, -1, 2) for g in t["g"]])).T
        n = n_train[exp]
        std = np.sqrt(np.maximum(n * sq - s * s, 0) / (n * max(1, n - 1)))
        some = std > 0
        if not some.any():
            return _NO_STATE
        inv = 1 / std[some]
        idx, mean, v = idx[some], s[some] / n * inv, np.zeros((3, some.sum(), n_lab))
        return pa.table({"exp": pa.array([exp], pa.int32()), "block": t["in"].slice(0, 1), "idx": _one(idx, pa.int64()), "inv": [inv.tobytes()],
                         "mean": [mean.tobytes()], "v": [v.tobytes()], "dots": [_dots(v, inv, mean).tobytes()]})

    return _per_block(chunks, sums=16).select("of", "in", "chunk", "ids", F.col("sums").alias("g")).groupBy("of", "in").applyInArrow(merge, STATE)


def _dots(v: np.ndarray, inv: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Per label: products of all vectors, those weighted by 1/variance, and those with the centre."""
    plain = np.einsum("anl,bnl->lab", v, v, optimize=True)
    scaled = v * inv[:, None]
    return np.concatenate([plain, np.einsum("anl,bnl->lab", scaled, scaled, optimize=True), np.einsum("anl,n->la", v, mean)[:, None]], 1)


def _total(state: DataFrame, n_exp: int, n_lab: int, k: int) -> np.ndarray:
    """Sums of the blocks' products: a row per experiment."""
    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        return pa.table({"exp": t["exp"].slice(0, 1), "dots": [sum(_floats(b, -1) for b in t["dots"]).tobytes()]})
    out = np.zeros((n_exp, n_lab, 2 * k + 1, k))
    for r in state.select("exp", "block", "dots").groupBy("exp").applyInArrow(add, "exp int, dots binary").collect():
        out[r.exp] = _floats(r.dots, n_lab, 2 * k + 1, k)
    return out


def pulled(asked: DataFrame, state: DataFrame, answer: Callable, width: int) -> DataFrame:
    """(by, of, part, w): ``answer(state row) -> (features, values of ``width``)`` at the ids that chunks ask (exp, block) for."""
    def pull(a: pa.Table, s: pa.Table) -> pa.Table:
        if not len(a):
            return pa.table({"by": pa.array([], pa.int64()), "of": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "w": pa.array([], pa.binary())})
        idx, w = answer(s) if len(s) else (np.zeros(0, np.int64), None)
        out = []
        for ids in a["ids"]:
            ids = _numbers(ids, np.int64)
            x = np.zeros((len(ids), width))
            if len(idx):  # a feature that does not vary in the training rows weighs nothing
                at = np.minimum(np.searchsorted(idx, ids), len(idx) - 1)
                x = np.where((idx[at] == ids)[:, None], w[at], 0.0)
            out.append(x.tobytes())
        return pa.table({"by": a["chunk"], "of": a["of"], "part": a["in"], "w": pa.array(out, pa.binary())})
    return asked.groupBy("of", "in").cogroup(state.groupBy("exp", "block")).applyInArrow(lambda a, s: pull(a, s), "by long, of int, part long, w binary")


def _per_block(chunks: DataFrame, **more: int) -> DataFrame:
    """(chunk, of, in, ids, more): what chunks have of every block; ``more`` columns have that many bytes a feature."""
    part = lambda c, n: F.substring(c, F.col("g.first") * n + 1, F.col("g.size") * n)
    return chunks.select("chunk", "exp", "wanted", *more, F.explode(F.arrays_zip("block", "first", "size")).alias("g")) \
        .select("chunk", F.col("exp").alias("of"), F.col("g.block").alias("in"), part("wanted", 8).alias("ids"), *[part(c, n).alias(c) for c, n in more.items()])


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def cross_entropy(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.maximum(m, 0) - m * y + np.log1p(np.exp(-np.abs(m)))


def line_search(f0: float, slope0: float, t: float):
    """A generator that yields lengths, is sent (value, slope) there, and ends at the length it was last sent.

    Strong Wolfe conditions, brackets grown by 1.5 and cut by cubic interpolation."""
    if slope0 > 0 or math.isnan(slope0):
        raise SearchFailed

    def cut(a, b):
        (lt, lf, ls), (rt, rf, rs) = sorted((a, b))
        d1 = ls + rs - 3 * (lf - rf) / (lt - rt)
        d2 = d1 * d1 - ls * rs
        t = rt - (rt - lt) * (rs + math.sqrt(d2) - d1) / (rs - ls + 2 * math.sqrt(d2)) if d2 >= 0 else math.nan
        return min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)) if t == t else t

    low = (0.0, f0, slope0)
    for i in range(10):
        f, slope = yield t
        c = (t, f, slope)
        if not math.isfinite(f):
            t /= 2
            continue
        if f > f0 + 1e-4 * t * slope0 or (f >= low[1] and i > 0):
            hi = c
        elif abs(slope) <= 0.9 * abs(slope0):
            return
        elif slope >= 0:
            low, hi = c, low
        else:
            low, t = c, 1.5 * t
            continue
        for _ in range(10):
            t = cut(low, hi)
            f, slope = yield t
            c = (t, f, slope)
            if f > f0 + 1e-4 * t * slope0 or f >= low[1]:
                hi = c
            else:
                if abs(slope) <= 0.9 * abs(slope0):
                    return
                if slope * (hi[0] - low[0]) >= 0:
                    hi = low
                low = c
        raise SearchFailed
    raise SearchFailed


class _Head:
    """What the driver knows of one head: its intercept's coordinates, value, slots of remembered steps."""

    def __init__(self, intercept: float, done: bool):
        self.b, self.kept_b, self.g, self.f, self.valid = intercept, intercept, 0.0, 0.0, math.nan
        self.slots: list[int] = []  # newest first
        self.step_b: dict[int, float] = {}
        self.change_b: dict[int, float] = {}
        self.values, self.iteration, self.failed, self.done, self.constant = [math.inf], 0, False, done, done

    def direction(self, dots: np.ndarray, place: dict[int, tuple[int, int]], k: int) -> tuple[np.ndarray, float, float, float]:
        """Coefficients over the stored vectors, the intercept's part, the slope and the length of the direction."""
        plain = dots[:k]
        vec = lambda i, side: (place[i][side], (self.step_b if side == 0 else self.change_b)[i])
        c, cb = np.zeros(k), self.g
        c[G] = 1.0

        def with_direction(v):
            return float(plain[v[0]] @ c) + v[1] * cb

        a, rho = {}, {}
        for n, i in enumerate(self.slots):
            s, y = vec(i, 0), vec(i, 1)
            rho[i] = float(plain[s[0], y[0]]) + s[1] * y[1]
            if n == 0:
                scale = rho[i] / (float(plain[y[0], y[0]]) + y[1] * y[1]) if rho[i] >= 0 else math.nan
            a[i] = with_direction(s) / rho[i] if rho[i] else math.nan
            if math.isnan(a[i]) or math.isnan(scale):
                raise SearchFailed
            c[y[0]] -= a[i]
            cb -= a[i] * y[1]
        if self.slots:
            c, cb = c * scale, cb * scale
        for i in reversed(self.slots):
            s, y = vec(i, 0), vec(i, 1)
            more = a[i] - with_direction(y) / rho[i]
            c[s[0]] += more
            cb += more * s[1]
        c, cb = -c, -cb
        return c, cb, float(plain[G] @ c) + self.g * cb, math.sqrt(max(0.0, float(c @ plain @ c)) + cb * cb)


def fit(joined: DataFrame, experiments: list[str], labels: list[str], key: str, epochs: int, weight_decay: float):
    """Train until every experiment's validation loss gets worse, at most ``epochs`` iterations.  Runs the training.

    Returns a landed table (exp, block, idx, w) with the best epochs' weights of the raw features, a column
    per label; their intercepts, an array (experiments, labels); and rows (experiment, epoch, train loss, validation loss).
    """
    n_exp, n_lab = len(experiments), len(labels)
    number = F.lit(None).cast("int")
    for i, e in enumerate(experiments):
        number = F.when(F.col(key) == e, F.lit(i)).otherwise(number)
    rows = joined.filter(F.col("split").isin("train", "valid")).select(
        number.alias("exp"), (F.col("split") == "train").cast("int").alias("train"), F.array(*[F.col(c).cast("int") for c in labels]).alias("y"), "features").filter("exp IS NOT NULL")
    with recording() as paths:
        chunks = land(rows.mapInArrow(_pack, PACKED), "lbfgs-chunks", group_rows=AT_ONCE)
        counts = rows.groupBy("exp", "train").agg(F.count(F.lit(1)).alias("n"), *[a for i in range(n_lab) for a in (
            F.count(F.when(F.col("y")[i].isin(0, 1), 1)).alias(f"ok{i}"), F.sum(F.col("y")[i]).alias(f"s{i}"))]).collect()  # two rows an experiment
        n_train, n_valid, positive = [0] * n_exp, [0] * n_exp, np.zeros((n_exp, n_lab))
        for r in counts:
            if any(r[f"ok{i}"] != r.n for i in range(n_lab)):
                raise ValueError(f"labels of {experiments[r.exp]} are not all 0 or 1")
            (n_train if r.train else n_valid)[r.exp] = r.n
            if r.train:
                positive[r.exp] = [r[f"s{i}"] for i in range(n_lab)]
        if 0 in n_train:
            raise ValueError(f"no training rows in {experiments[n_train.index(0)]}")
        heads = [[_Head(math.inf if p == n else -math.inf if p == 0 else math.log(p / (n - p)), p in (0, n)) for p in ps] for ps, n in zip(positive, n_train, strict=True)]
        out = _run(chunks, heads, experiments, n_train, n_valid, n_lab, epochs, weight_decay)
        weights = land(out[0], "lbfgs-weights", group_rows=AT_ONCE)
    intercepts = np.array([[h.kept_b for h in hs] for hs in heads])
    shifts = {r.exp: _floats(r.shift, n_lab) for r in weights.groupBy("exp").applyInArrow(
        lambda t: pa.table({"exp": t["exp"].slice(0, 1), "shift": [sum(_floats(b, -1) for b in t.sort_by("block")["shift"]).tobytes()]}), "exp int, shift binary").collect()}
    for e, s in shifts.items():
        intercepts[e] -= s
    drop_landed(joined.sparkSession, [p for p in paths if "lbfgs-weights" not in p])
    return weights.drop("shift"), intercepts, out[1]


def _run(chunks: DataFrame, heads: list[list[_Head]], experiments: list[str], n_train: list[int], n_valid: list[int], n_lab: int, epochs: int, decay: float):
    spark, n_exp = chunks.sparkSession, len(experiments)
    every = [(e, i) for e in range(n_exp) for i in range(n_lab)]
    place: dict[int, tuple[int, int]] = {}  # slot -> places of its step and change among the state's vectors
    state = land(_first_state(chunks, n_train, n_lab), "lbfgs-state", group_rows=AT_ONCE)
    k, dots = 3, _total(state, n_exp, n_lab, 3)

    def grid(value) -> np.ndarray:
        return np.array([[value(heads[e][i]) for i in range(n_lab)] for e in range(n_exp)], float)

    def measured(margins: DataFrame, t: np.ndarray) -> dict[int, np.ndarray]:
        """Per experiment, trial of lengths ``t`` and label: sums of training losses, slopes, residuals, validation losses."""
        def part(batches):
            for b in batches:
                for r in range(len(b)):
                    e = b.column("exp")[r].as_py()
                    x, d = (_floats(b.column(c)[r], -1, n_lab) for c in "xd")
                    train, y = _numbers(b.column("train")[r], np.int32)[:, None] == 1, _numbers(b.column("y")[r], np.int32).reshape(-1, n_lab)
                    sums = []
                    for trial in t:
                        m = x + trial[e] * d
                        loss, rest = cross_entropy(m, y), np.where(train, sigmoid(m) - y, 0.0)
                        sums.append([np.where(train, loss, 0).sum(0), (rest * d).sum(0), rest.sum(0), np.where(train, 0, loss).sum(0)])
                    sums = np.array(sums)
                    yield pa.record_batch([b.column("chunk").slice(r, 1), b.column("exp").slice(r, 1), pa.array([sums.tobytes()], pa.binary())], names=["chunk", "exp", "sums"])
        rows = margins.mapInArrow(part, "chunk long, exp int, sums binary").groupBy("exp").applyInArrow(
            lambda a: pa.table({"exp": a["exp"].slice(0, 1), "sums": [sum(_floats(s, -1, 4, n_lab) for s in a.sort_by("chunk")["sums"]).tobytes()]}), "exp int, sums binary").collect()
        return {r.exp: _floats(r.sums, -1, 4, n_lab) for r in rows}  # a row per experiment

    def push(margins: DataFrame, t: np.ndarray, c: np.ndarray, residual: np.ndarray, moved: np.ndarray, keep: list[bool], slots: list[int]) -> DataFrame:
        """The state after steps of ``t`` along the directions ``c``; ``slots`` are the vectors that stay remembered."""
        def gradient(a: pa.Table, m: pa.Table) -> pa.Table:
            e, (train, y, row, feature, value, wanted) = a["exp"][0].as_py(), _arrays(a, n_lab)
            x, d = (_floats(m[name][0], -1, n_lab) for name in "xd")
            rest = np.where(train[:, None] == 1, sigmoid(x + t[e] * d) - y, 0.0) / n_train[e]
            return _parts(e, a["chunk"][0].as_py(), wanted, _by_feature(len(wanted), feature, value[:, None] * rest[row]))

        def step(parts: pa.Table, s: pa.Table) -> pa.Table:
            e, idx = s["exp"][0].as_py(), s["idx"][0].values.to_numpy()
            inv, mean, v = _floats(s["inv"][0], -1), _floats(s["mean"][0], -1), _floats(s["v"][0], -1, len(idx), n_lab)
            if not len(parts):
                g = v[G]
            else:
                g = np.zeros((len(idx), n_lab))
                for ids, blob in (zip(*(parts.sort_by("chunk")[n] for n in ("ids", "g")), strict=True) if len(idx) else ()):
                    ids, w = _numbers(ids, np.int64), _floats(blob, -1, n_lab)
                    at = np.minimum(np.searchsorted(idx, ids), len(idx) - 1)
                    on = idx[at] == ids
                    g[at[on]] += w[on]
            along = t[e] * np.einsum("lk,knl->nl", c[e], v)
            x = v[X] + along
            g = np.where(moved[e], inv[:, None] * g - mean[:, None] * residual[e] + decay * x * (inv ** 2)[:, None], v[G]) if len(parts) else v[G]
            new = [x, v[X] if keep[e] else v[KEPT], g, *[v[i] for n in slots for i in place[n]], along, np.where(moved[e], g - v[G], 0.0)]
            v = np.stack(new)
            return pa.table({"exp": s["exp"], "block": s["block"], "idx": s["idx"], "inv": s["inv"], "mean": s["mean"], "v": [v.tobytes()], "dots": [_dots(v, inv, mean).tobytes()]})

        going = [e for e in range(n_exp) if moved[e].any()]
        parts = chunks.filter(F.col("exp").isin(going)).select(*ROWS).groupBy("chunk").cogroup(margins.withColumnRenamed("chunk", "by").groupBy("by")) \
            .applyInArrow(lambda a, m: gradient(a, m) if len(a) else _parts(0, 0, np.zeros(0, np.int64), np.zeros((0, n_lab))), PARTS)
        return parts.groupBy("of", "in").cogroup(state.groupBy("exp", "block")).applyInArrow(
            lambda p, s: step(p, s) if len(s) else _NO_STATE, STATE)

    def margins_of(c: np.ndarray, going: list[int]) -> DataFrame:
        """Margins of every row at the points and along the directions ``c``."""
        b, db = grid(lambda h: h.b), np.array([[h.db for h in hs] for hs in heads])
        centre = dots[:, :, 2 * k]
        b, db = b - centre[:, :, X], db - np.einsum("elk,elk->el", centre, c)

        def answer(s: pa.Table):
            e, idx = s["exp"][0].as_py(), s["idx"][0].values.to_numpy()
            v, inv = _floats(s["v"][0], -1, len(idx), n_lab), _floats(s["inv"][0], -1)[:, None]
            return idx, np.concatenate([v[X] * inv, np.einsum("lk,knl->nl", c[e], v) * inv], 1)

        def compute(a: pa.Table, p: pa.Table) -> pa.Table:
            e, (train, y, row, feature, value, wanted) = a["exp"][0].as_py(), _arrays(a, n_lab)
            w = _floats(b"".join(p.sort_by("part")["w"].to_pylist()), len(wanted), 2 * n_lab)
            m = _summed(len(train), row, value[:, None] * w[feature])
            x, d = m[:, :n_lab] + b[e], m[:, n_lab:] + db[e]
            return pa.table({"chunk": a["chunk"], "exp": a["exp"], "train": a["train"], "y": a["y"], "x": [x.tobytes()], "d": [d.tobytes()]})

        some = chunks.filter(F.col("exp").isin(going))
        got = pulled(_per_block(some), state.filter(F.col("exp").isin(going)).select("exp", "block", "idx", "inv", "v"), answer, 2 * n_lab)
        return some.select(*ROWS).groupBy("chunk").cogroup(got.groupBy("by")).applyInArrow(compute, MARGINS)

    def regular(e: int, i: int, c: np.ndarray, t: float) -> tuple[float, float]:
        """The weight decay's value and slope at length ``t`` along ``c``."""
        q = dots[e, i, k:2 * k]
        xx, xd, dd = q[X, X], q[X] @ c, c @ q @ c
        return decay * (xx / 2 + t * xd + t * t * dd / 2), decay * (xd + t * dd)

    def converged(e: int, i: int) -> bool:
        h = heads[e][i]
        size = math.sqrt(dots[e, i, G, G] + h.g * h.g)
        return size <= max(TOLERANCE * abs(h.f), 1e-8) or (len(h.values) > 1 and abs(h.f - max(h.values)) <= TOLERANCE * h.first)

    zero = np.zeros((n_exp, n_lab))
    for e, i in every:
        heads[e][i].db = 0.0
    before: list[str] = []

    def stepped(margins, t, c, residual, moved, keep, slots):
        nonlocal state, dots, k, before
        with recording() as own:
            state = land(push(margins, t, c, residual, moved, keep, slots), "lbfgs-state", group_rows=AT_ONCE)
        drop_landed(spark, before)
        before = own
        k = 3 + 2 * (len(slots) + 1)
        dots = _total(state, n_exp, n_lab, k)

    # the gradient at zero
    with recording() as own:
        margins = land(margins_of(np.zeros((n_exp, n_lab, k)), list(range(n_exp))), "lbfgs-margins", group_rows=AT_ONCE)
    got = {e: sums[0] for e, sums in measured(margins, zero[None]).items()}
    free = np.array([[not h.constant for h in hs] for hs in heads])
    stepped(margins, zero, np.zeros((n_exp, n_lab, k)), np.array([got[e][2] / n_train[e] for e in range(n_exp)]), free, [False] * n_exp, [])
    drop_landed(spark, own)
    place = {-1: (3, 4)}
    for e, i in every:
        h = heads[e][i]
        h.valid = got[e][3][i] / n_valid[e] if n_valid[e] else math.nan
        if not h.constant:
            h.f = h.first = got[e][0][i] / n_train[e]
            h.g = got[e][2][i] / n_train[e]
            h.done = converged(e, i)
    best, history, going, keep, counter = [math.inf] * n_exp, [], list(range(n_exp)), [False] * n_exp, 0
    for epoch in range(1, epochs + 1):
        while need := [(e, i) for e in going for i in range(n_lab) if not heads[e][i].done and heads[e][i].iteration < epoch]:
            c, searches, t = np.zeros((n_exp, n_lab, k)), {}, np.zeros((n_exp, n_lab))
            lost = set()
            for e, i in every:
                heads[e][i].db = 0.0
            for e, i in need:
                h = heads[e][i]
                try:
                    c[e, i], h.db, slope, length = h.direction(dots[e, i], place, k)
                    search = line_search(h.f, slope, 1.0 / length if h.iteration == 0 else 1.0)
                    t[e, i] = next(search)
                    searches[e, i] = search
                except SearchFailed:
                    c[e, i], h.db = 0.0, 0.0
                    lost.add((e, i))
            with recording() as own:
                margins = land(margins_of(c, sorted({e for e, _ in need})), "lbfgs-margins", group_rows=AT_ONCE)
            found, more = {}, 9 if any(heads[e][i].iteration == 0 for e, i in searches) else 1
            while searches:
                trials = [t.copy()]
                for _ in range(more):  # the lengths a search asks for while it goes on growing, in the same pass
                    trials.append(1.5 * trials[-1])
                got, more = measured(margins, np.array(trials)), 0
                for (e, i), search in list(searches.items()):
                    for k_trial, trial in enumerate(trials):
                        if trial[e, i] != t[e, i]:
                            break
                        sums = got[e][k_trial][:, i]
                        value, slope = regular(e, i, c[e, i], t[e, i])
                        now = sums[0] / n_train[e] + value, sums[1] / n_train[e] + slope
                        try:
                            t[e, i] = search.send(now)
                        except (StopIteration, SearchFailed) as stop:
                            del searches[e, i]
                            norm = math.sqrt(dots[e, i, G, G] + heads[e][i].g ** 2)
                            if isinstance(stop, SearchFailed) or t[e, i] * norm < 1e-10:
                                t[e, i] = 0.0
                                lost.add((e, i))
                            else:
                                found[e, i] = (now[0], sums[2] / n_train[e], sums[3] / n_valid[e] if n_valid[e] else math.nan)
                            break
            moved, residual = np.zeros((n_exp, n_lab), bool), np.zeros((n_exp, n_lab))
            for (e, i), (_, rest, _) in found.items():
                moved[e, i], residual[e, i] = True, rest
            for e, i in lost:
                h = heads[e][i]
                h.done, h.failed, h.slots = h.failed, True, []
            used = [s for s in place if any(s in h.slots[:MEMORY - 1] for hs in heads for h in hs)]
            if found:
                stepped(margins, t, c, residual, moved, keep, used)
                keep = [False] * n_exp
                place = {s: (3 + 2 * n, 4 + 2 * n) for n, s in enumerate([*used, counter])}
            drop_landed(spark, own)
            for (e, i), (f, rest, valid) in found.items():
                h = heads[e][i]
                h.step_b[counter], h.change_b[counter] = t[e, i] * h.db, rest - h.g
                h.b, h.g, h.f, h.valid = h.b + t[e, i] * h.db, rest, f, valid
                h.slots = [counter, *h.slots][:MEMORY]
                h.values, h.iteration, h.failed = [f, *h.values][:20], h.iteration + 1, False
                h.done = converged(e, i)
            counter += 1
        for e in list(going):
            loss = sum(h.valid for h in heads[e]) / n_lab
            history.append((experiments[e], epoch, float(sum(h.f for h in heads[e]) / n_lab), float(loss)))
            if loss <= best[e] or epoch == 1:
                keep[e] = True
                for h in heads[e]:
                    h.kept_b = h.b
            if not loss <= best[e]:  # worse, or NaN
                going.remove(e)
            else:
                best[e] = loss
        if not going:
            break

    def final(batches):
        for b in batches:
            for r in range(len(b)):
                e, idx = b.column("exp")[r].as_py(), b.column("idx")[r].values.to_numpy()
                x = _floats(b.column("v")[r], -1, len(idx), n_lab)[X if keep[e] else KEPT]
                w, shift = x * _floats(b.column("inv")[r], -1)[:, None], _floats(b.column("mean")[r], -1) @ x
                yield pa.record_batch([b.column(n).slice(r, 1) for n in ("exp", "block", "idx")] + [pa.array([w.tobytes()], pa.binary()), pa.array([shift.tobytes()], pa.binary())],
                                      names=["exp", "block", "idx", "w", "shift"])
    return state.mapInArrow(final, "exp int, block long, idx array<long>, w binary, shift binary"), history


def score(rows: DataFrame, weights: DataFrame, intercepts: np.ndarray) -> DataFrame:
    """Rows of (_exp, _features and others) with the probabilities ``_p`` of their experiment's heads.  Lands the rows.

    ``weights`` has (exp, block, idx, w), ``intercepts`` a row per experiment.
    """
    n_lab = intercepts.shape[1]
    kept = [c for c in rows.columns if c != "_features"]
    schema = rows.select(*kept).schema.add("_p", T.ArrayType(T.DoubleType()))
    rows = land(rows.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), 10)), "lbfgs-rows")  # at most 1,024 rows of a partition

    def ask(t: pa.Table) -> pa.Table:
        wanted = np.unique(cells_of(t["_features"])[1])
        return _parts(t["_exp"][0].as_py(), t["_chunk"][0].as_py(), wanted, np.zeros((len(wanted), 0))).select(["chunk", "of", "in", "ids"])

    def answer(s: pa.Table):
        return s["idx"][0].values.to_numpy(), _floats(s["w"][0], -1, n_lab)

    def compute(t: pa.Table, p: pa.Table) -> pa.Table:
        n, features, values = cells_of(t["_features"])
        wanted, local = np.unique(features, return_inverse=True)
        w = _floats(b"".join(p.sort_by("part")["w"].to_pylist()), len(wanted), n_lab)
        m = _summed(len(n), np.repeat(np.arange(len(n)), n), values[:, None] * w[local]) + intercepts[t["_exp"][0].as_py()]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, n_lab), pa.int32()), pa.array(sigmoid(m).reshape(-1)))
        return t.select(kept).append_column("_p", lists)

    asked = rows.select("_chunk", "_exp", "_features").groupBy("_chunk", "_exp").applyInArrow(ask, "chunk long, of int, in long, ids binary")
    got = pulled(asked, weights, answer, n_lab)
    return rows.groupBy("_chunk", "_exp").cogroup(got.groupBy("by", "of")).applyInArrow(compute, schema)
