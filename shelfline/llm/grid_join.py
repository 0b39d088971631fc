"""Near-duplicate vectors by an epsilon grid order join."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfline.operators.graph import components
from shelfline.session import settle

COSINE = 0.98
LEADING = 8                 # principal dimensions of the grid order
BLOCK_ROWS = 2_048          # vectors of a block of the sequence
LEAF_ROWS = 128             # vectors of an interval that is compared directly


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & plain & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one, in doubles; scaled by the largest component first, so squares stay finite."""
    x = np.array(list(vectors), float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per number of components, the leading principal directions of all unit vectors (columns).

    Tasks send sums of products, whose size depends on the number of components only.
    """
    def moments(batches):
        total = {}
        for b in batches:
            for dims, rows in b.groupby("dims"):
                x = unit_rows(rows["embedding"])
                total[dims] = total.get(dims, 0) + (x.T @ x)
        for dims, m in total.items():
            yield pd.DataFrame({"dims": np.int32(dims), "i": np.arange(dims * dims), "v": m.ravel()})
    rows = vectors.select("dims", "embedding").mapInPandas(moments, "dims int, i long, v double").groupBy("dims", "i").agg(F.sum("v").alias("v"))
    sums: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator():
        sums.setdefault(r["dims"], np.zeros(r["dims"] ** 2))[r["i"]] = r["v"]
    out = {}
    for dims, s in sums.items():
        _, axes = np.linalg.eigh(s.reshape(dims, dims))
        out[dims] = axes[:, ::-1][:, :LEADING]
    return out


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, cosine: float):
    """Pairs of intervals (first positions a and c, matrix of linked positions) of two sequences in grid order;
    within one sequence each pair once, as a position and a later one.

    An interval pair whose boxes in the leading dimensions lie further apart than the radius cannot link and
    is skipped; others are halved until they are small and compared by dot products in doubles.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a or a == b or c == d:
            continue
        apart = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (apart * apart).sum() > radius * radius:
            continue
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            hits = x[a:b] @ y[c:d].T >= cosine
            if same and a == c:
                hits = np.triu(hits, 1)
            if hits.any():
                yield a, c, hits
            continue
        e, f = (a + b) // 2, (c + d) // 2
        left = [(a, e), (e, b)] if b - a > LEAF_ROWS else [(a, b)]
        right = [(c, f), (f, d)] if d - c > LEAF_ROWS else [(c, d)]
        stack += [(*p, *q) for p in left for q in right]


class Connected:
    """Which rows of two sequences are connected; ``label`` is the first row of each row's component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, rows: np.ndarray, cols: np.ndarray, hits: np.ndarray) -> None:
        """Connects what a matrix of links between ``rows`` and ``cols`` connects.

        Links within a component count for nothing. Of the others one per row is taken, as often as there are any: each
        time every component with such a link joins another, so a few times suffice and only rows that join
        something are touched one by one.
        """
        while True:
            new = hits & (self.label[rows][:, None] != self.label[cols][None, :])
            some = np.flatnonzero(new.any(axis=1))
            if not len(some):
                return
            for i, j in zip(rows[some].tolist(), cols[new[some].argmax(axis=1)].tolist()):
                x, y = self.label[i], self.label[j]
                if x != y:
                    self.label[self.label == max(x, y)] = min(x, y)

    def stars(self, ids: np.ndarray) -> np.ndarray:
        """Per component of several ids, edges from its smallest id to the others."""
        least = ids.copy()
        np.minimum.at(least, self.label, ids)
        centre = least[self.label]
        return np.unique(np.stack([centre, ids], 1)[centre != ids], axis=0)


def _blocks(points: DataFrame, axes: dict[int, np.ndarray], radius: float) -> DataFrame:
    """Blocks of the grid order: (label, dims, block, ids, copies, coords, low, high), settled.

    Each label's vectors are sorted by the cells of the grid on the leading dimensions and cut into runs.
    The range partitioning splits a label of any size.
    """
    project = T.StructType([*points.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType()))])

    def cells(batches):
        for b in batches:
            out = b.copy()
            out["cell"] = [None] * len(b)
            for dims, rows in b.groupby("dims"):
                at = np.floor(unit_rows(rows["embedding"]) @ axes[dims] / radius).astype(np.int32)
                out.loc[rows.index, "cell"] = pd.Series(list(at), index=rows.index)
            yield out

    def cut(batches):
        held, key, number = [], None, 0
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()

        def block():
            rows = pd.concat(held)
            x = unit_rows(rows["embedding"])
            p = x @ axes[key[1]]
            return pd.DataFrame({"label": [key[0]], "dims": [key[1]], "block": [task * 2 ** 32 + number], "ids": [rows["id"].to_numpy()],
                                 "copies": [rows["copies"].to_numpy()], "vectors": [np.concatenate(rows["embedding"].to_numpy()).astype(float)],
                                 "low": [p.min(0)], "high": [p.max(0)]})
        n = 0
        for b in batches:
            for k, rows in b.groupby(["label", "dims"], sort=False):
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows.iloc[at:at + BLOCK_ROWS]
                    if held and (k != key or n + len(part) > BLOCK_ROWS):
                        yield block()
                        held, n, number = [], 0, number + 1
                    held, key, n = held + [part], k, n + len(part)
        if held:
            yield block()
    order = ["label", "dims", "cell", "id"]
    ordered = points.mapInPandas(cells, project).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ordered.mapInPandas(cut, "label int, dims int, block long, ids array<long>, copies array<long>, vectors array<double>, "
                                           "low array<double>, high array<double>"), "blocks")


def link_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine
    in doubles is at least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Rows that repeat a vec_id count as vectors of their own in n_links. A null
    vec_id links with nothing and is not kept. Other columns are not read.

    Equal vectors of a label are one point with a number of copies. Points are sorted in grid order and cut
    into blocks; pairs of blocks that lie within the radius on every leading dimension are joined
    recursively, each in one task, which sends link counts and one edge per connected vector, never all pairs. The
    search is exact: a grid cell or block of any size is split further.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    rows = embeddings.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    able = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    # -0.0 equals 0.0; adding zero makes them one key
    able = able.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    points = settle(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                    .withColumn("dims", F.size("embedding")), "points")
    of_point = settle(able.join(points.select("label", "embedding", "id", "copies"), ["label", "embedding"]).select("vec_id", "id", "copies"), "copies")
    axes = principal(points)
    blocks = _blocks(points, axes, radius)
    boxes = blocks.select("label", "dims", "block", "low", "high")
    strip = lambda v: F.floor(v / F.lit(radius))
    # the first leading dimension gives strips to join on; the others prune
    left = boxes.withColumn("strip", F.explode(F.sequence(strip(F.col("low")[0]), strip(F.col("high")[0]))))
    right = left.select("label", "dims", "strip", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = left.withColumn("strip", F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)))
    gap = F.aggregate(F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"), lambda a, b: F.greatest(
        F.lit(0.0), a["low"] - b["high2"], b["low2"] - a["high"])), F.lit(0.0), lambda s, g: s + g * g)
    pairs = (near.join(right, ["label", "dims", "strip"]).where((F.col("block") <= F.col("other")) & (gap <= radius * radius))
             .select("block", "other").distinct())
    one = blocks.select("block", "dims", F.col("ids").alias("ids1"), F.col("copies").alias("copies1"), F.col("vectors").alias("v1"))
    two = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("vectors").alias("v2"))
    tasks = pairs.join(one, "block").join(two, "other")

    def link(batches):
        for b in batches:
            for r in b.itertuples():
                same, axis = r.block == r.other, axes[r.dims]
                x = unit_rows(np.asarray(r.v1).reshape(-1, r.dims))
                y = x if same else unit_rows(np.asarray(r.v2).reshape(-1, r.dims))
                ids1, ids2, c1, c2 = (np.asarray(v) for v in (r.ids1, r.ids2, r.copies1, r.copies2))
                n1, n2 = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                ids, shift, whole = (ids1, 0, Connected(len(x))) if same else (np.concatenate([ids1, ids2]), len(x), Connected(len(x) + len(y)))
                for at, on, hits in join_intervals(x, x @ axis, y, y @ axis, same, cosine):
                    i, j = np.arange(at, at + hits.shape[0]), np.arange(on, on + hits.shape[1])
                    n1[i] += hits @ c2[j]
                    (n1 if same else n2)[j] += c1[i] @ hits
                    whole.join(i, j + shift, hits)
                edge = whole.stars(ids)
                count = [(v, n) for some, m in ((ids1, n1), (ids2, n2)) for v, n in zip(some[m > 0], m[m > 0])]
                out = [(v, None, n) for v, n in count] + [(a, c, 0) for a, c in edge.tolist()]
                yield pd.DataFrame({"a": np.array([o[0] for o in out], np.int64), "b": pd.array([o[1] for o in out], "Int64"),
                                    "n": np.array([o[2] for o in out], np.int64)})
    found = settle(tasks.mapInPandas(link, "a long, b long, n long"), "links")
    others = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b").unionByName(
        of_point.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    comp = components(edges).select(F.col("node").alias("vec_id"), "component")
    linked = (of_point.join(others, "id", "left").groupBy("vec_id")
              .agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    return (rows.select("vec_id").join(linked, "vec_id", "left").join(comp, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
