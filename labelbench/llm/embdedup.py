"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label (and one length) are compared in tiles.  In the coordinates of their
principal axes, unit vectors of cosine t or more differ by at most sqrt(2 - 2t) in every
coordinate, so cells of that width in the leading two are compared with neighbouring cells only.
Inside a pair of tiles products are accumulated over the leading axes first; the product of the
two suffix norms bounds what the rest can add, and a pair that cannot reach the threshold any
more is dropped.  Survivors are verified with the plain cosine of the vectors as they came.

Copies are compared once (as one class with a weight).  A pair of tiles reports per class the
number of links and one link to a root of its connected part, so the output of a tile pair is
as long as its tiles, however many of their vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import as_docs
from .components import components

TILE = 1024
SLACK = 1e-9  # rounding of the rotated products; the final test is exact
AXES = (4, 8, 16, 32)  # leading axes after which pairs are dropped


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().cast(pa.float64())).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d))
        yield int(d), part, _matrix(part.column("embedding"), int(d))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the eigenvectors of the second moments of all unit vectors, largest first.

    Tasks send sums of d x d products, Spark adds them up; d squared numbers reach the driver.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_dim(batch):
                u = _unit(x)
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            i, j = np.triu_indices(d)
            yield pa.record_batch([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])],
                                  names=["dim", "i", "j", "v"])

    sums = classes.select("dim", "embedding").mapInArrow(moments, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    got = sums.toArrow()
    dims = got["dim"].to_numpy()
    for d in np.unique(dims):
        m, here = np.zeros((d, d)), dims == d
        i, j, v = (got[c].to_numpy()[here] for c in "ijv")
        m[i, j] = m[j, i] = v
        out[int(d)] = np.linalg.eigh(m)[1][:, ::-1]
    return out


def _compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y (i < j where both are one tile) with cosine >= threshold."""
    ux, uy = _unit(x) @ axes, _unit(y) @ axes
    d = ux.shape[1]
    steps = [a for a in AXES if a < d] or [d]
    k = steps[0]
    rest_x, rest_y = (np.sqrt(np.maximum(np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1], 0)) for u in (ux, uy))
    rest = lambda r, k: r[:, k] if k < d else np.zeros(len(r))
    dots = ux[:, :k] @ uy[:, :k].T
    alive = dots + np.outer(rest(rest_x, k), rest(rest_y, k)) >= threshold - SLACK
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    dots = dots[i, j]
    for nxt in [*steps[1:], d]:
        if nxt > k and len(i):
            dots = dots + np.einsum("nk,nk->n", ux[i, k:nxt], uy[j, k:nxt])
            ok = dots + rest(rest_x, nxt)[i] * rest(rest_y, nxt)[j] >= threshold - SLACK
            i, j, dots, k = i[ok], j[ok], dots[ok], nxt
    scale = lambda m: m / np.abs(m).max(axis=1, keepdims=True)
    a, b = scale(x), scale(y)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    keep = np.concatenate([np.zeros(0, bool), *[np.einsum("nk,nk->n", a[i[c:c + 65536]], b[j[c:c + 65536]]) / (na[i[c:c + 65536]] * nb[j[c:c + 65536]]) >= threshold
                                               for c in range(0, len(i), 65536)]]).astype(bool)
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (i, j) among n points."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine
    is at least ``threshold`` (above 0).  ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the smallest vec_id reachable, ``kept`` whether it is the row's
    own.  Null, empty and zero vectors, vectors with null or non-finite components, and rows with
    a null label or null vec_id link with nothing (a null vec_id: component null, not kept).  Rows
    that repeat a vec_id count one by one.  An empty table gives no row.  Runs jobs when called.
    """
    rows = as_docs(vectors, "vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    rows = land(rows.withColumn("valid", valid), "emb-rows")
    good = rows.filter("valid")
    classes = good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = land(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "emb-classes")
    axes = principal_axes(classes)
    width = float(np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_dim(batch):
                lead = np.floor(_unit(x) @ axes[d][:, :2] / width).astype(np.int32)
                cells = [lead[:, 0], lead[:, 1] if d > 1 else np.zeros(len(x), np.int32)]
                yield pa.record_batch([part.column(c) for c in ("cid", "weight", "dim", "embedding", "label")] + [pa.array(c) for c in cells],
                                      names=["cid", "weight", "dim", "embedding", "label", "c1", "c2"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    cells = land(classes.select("cid", "weight", "dim", "embedding", "label").mapInArrow(
        place, f"cid long, weight long, dim int, embedding {kinds['embedding']}, label {kinds['label']}, c1 int, c2 int"), "emb-cells")
    at = ["label", "dim", "c1", "c2"]
    counts = land(cells.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks")), "emb-counts")
    # a class's chunk is a share of its id's hash, so a cell of any size spreads over its chunks
    chunked = cells.join(counts, at).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d = t["dim"][0].as_py()
        x = _matrix(t["embedding"].chunk(0), d)
        first = lambda c: t[c].slice(0, 1)
        return pa.table({**{c: first(c) for c in [*at, "chunk"]}, "ids": pa.array([t["cid"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "weights": pa.array([t["weight"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "matrix": pa.array([x.tobytes()], pa.binary())})

    tile_key = [*at, "chunk"]
    tiles = land(chunked.groupBy(*tile_key).applyInArrow(
        pack, f"label {kinds['label']}, dim int, c1 int, c2 int, chunk int, ids binary, weights binary, matrix binary"), "emb-tiles")
    # each pair of neighbouring cells once: steps that come first in (c1, c2) order, and the cell itself
    steps = F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = tiles.select(*tile_key).withColumn("step", F.explode(steps)).select(
        "label", "dim", F.col("c1").alias("l1"), F.col("c2").alias("l2"), F.col("chunk").alias("lchunk"),
        (F.col("c1") + F.col("step.d1")).alias("c1"), (F.col("c2") + F.col("step.d2")).alias("c2"))
    pairs = near.join(tiles.select(*tile_key), at).filter("l1 <> c1 or l2 <> c2 or lchunk <= chunk")
    left = tiles.select("label", "dim", F.col("c1").alias("l1"), F.col("c2").alias("l2"), F.col("chunk").alias("lchunk"),
                        F.col("ids").alias("lids"), F.col("weights").alias("lweights"), F.col("matrix").alias("lmatrix"))
    work = pairs.join(left, ["label", "dim", "l1", "l2", "lchunk"]).join(tiles, tile_key) \
        .select("dim", F.expr("l1 = c1 and l2 = c2 and lchunk = chunk").alias("same"), "lids", "lweights", "lmatrix", "ids", "weights", "matrix")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                d, same, *blobs = (batch.column(c)[r].as_py() for c in range(8))
                ia, wa, ib, wb = (np.frombuffer(blobs[k], np.int64) for k in (0, 1, 3, 4))
                x, y = (np.frombuffer(blobs[k]).reshape(-1, d) for k in (2, 5))
                i, j = _compare(x, y, axes[d], threshold, same)
                if same:
                    ids, links = ia, np.zeros(len(ia), np.int64)
                    root = _roots(len(ids), i, j)
                    np.add.at(links, i, wa[j])
                    np.add.at(links, j, wa[i])
                else:
                    ids, links = np.concatenate([ia, ib]), np.zeros(len(ia) + len(ib), np.int64)
                    root = _roots(len(ids), i, j + len(ia))
                    np.add.at(links, i, wb[j])
                    np.add.at(links, j + len(ia), wa[i])
                hit = np.flatnonzero(links)
                yield pa.record_batch([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["cid", "links", "root"])

    found = land(work.mapInArrow(compare, "cid long, links long, root long"), "emb-links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "label", "embedding", "weight", "least").join(links, "cid", "left") \
        .join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(
        rows.filter("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
