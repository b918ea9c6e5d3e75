"""Nearest neighbours by cosine over stable projections and kd-trees.

Unit vectors are projected to ``DIMENSIONS`` coordinates by a Gaussian matrix;
that law is 2-stable, so the squared projected distance of two vectors over
their squared distance is chi-square with ``DIMENSIONS`` degrees of freedom.
A search walks through neighbours in the projection, nearest first, and
verifies each on the original vectors.  It stops when the next projected
distance is so large that a vector as near as the k-th one found would lie
within it with probability ``CONFIDENCE``; that is also the expected recall.

A coarse kd-tree, fitted on a bounded sample, cuts the projection into cells;
every vector is routed, and cells that came out too large are cut further by a
hash (same box, several parts).  A query first searches its own cell, which
gives it a k-th distance, then only the cells whose boxes the stopping test
does not exclude.  Inside a cell a kd-tree over its rows gives the leaves in
order.  Copies of one vector need no more than their ``k + 1`` smallest ids, so
a vector of any frequency is a few rows.

Defined cases: rows whose vector is null, empty, zero or holds null or
non-finite components, and rows without an id, take no part, nor do vectors of
another length than most have; rows alike in id and vector are one row.  Fewer
than ``k`` candidates are all returned.  Extra columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import sent_by_value, written
from panelwright.operators.ordered import join_stats, top_per_group

sent_by_value(__name__)

K = 5
QUERY_EVERY = 50
# Even, which gives the distribution function a closed form.
DIMENSIONS = 16
CONFIDENCE = 0.97
SEED = 42
# The coarse tree is fitted on a sample by hash: about SAMPLE vectors, never more than twice as many.
SAMPLE = 16_384
# Rows a cell should hold, as far as the sample tells; a larger one is cut by hash.
CELL_ROWS = 8_192
LEAF_ROWS = 64
# Projected distances up to this count as zero.
TINY = 1e-12


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 4.0 * degrees + 100
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, DIMENSIONS))


def units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components keep their precision.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The measure, in double precision; equal rows get equal values."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt((q * q).sum()))


# --- the coarse tree --------------------------------------------------------------------------------------------------


def fit_cells(sample: np.ndarray, share: float) -> list:
    """Nodes ``(axis, cut, below, above)``; a cell is ``None``.  The widest axis is cut at its median."""
    nodes: list = [None]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        at, own = todo.pop()
        if len(own) <= max(1.0, share * len(sample)):
            continue
        points = sample[own]
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        cut = float(np.median(points[:, axis]))
        below = points[:, axis] <= cut
        if below.all() or not below.any():
            continue
        nodes[at] = (axis, cut, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, own[below]), (len(nodes) - 1, own[~below])]
    return nodes


def route(points: np.ndarray, nodes: list) -> np.ndarray:
    """The cell of each point."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if nodes[at] is None:
            out[own] = at
            continue
        axis, cut, below, above = nodes[at]
        low = points[own, axis] <= cut
        todo += [(below, own[low]), (above, own[~low])]
    return out


# --- the search inside a cell ---------------------------------------------------------------------------------------------


class Index:
    """A kd-tree over the projected rows of a cell; leaves are runs of one permutation."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        low = projection(vectors.shape[1])
        points = units(vectors) @ low
        order, leaves, todo = np.arange(len(ids)), [], [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF_ROWS:
                leaves.append((a, b))
                continue
            part = points[order[a:b]]
            axis, mid = int(np.argmax(part.max(axis=0) - part.min(axis=0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.ids, self.vectors, self.points, self.low = ids[order], vectors[order], points[order], low
        self.starts, self.ends = np.array(leaves).T
        self.lows = np.array([self.points[a:b].min(axis=0) for a, b in leaves])
        self.highs = np.array([self.points[a:b].max(axis=0) for a, b in leaves])

    def search(self, own: int, vector: np.ndarray, k: int, bound: float) -> list[tuple[float, int]]:
        """The best ``(-cosine, id)`` found, given that a k-th squared distance of ``bound`` is known already."""
        at = (units(vector[None]) @ self.low)[0]
        gap = np.maximum(self.lows - at, 0) + np.maximum(at - self.highs, 0)
        boxes = (gap * gap).sum(axis=1)
        order = np.argsort(boxes, kind="stable")
        best: list[tuple[float, int]] = []
        limit, at_leaf, take = _REACH * bound + TINY, 0, 2
        while at_leaf < len(order) and boxes[order[at_leaf]] <= limit:
            step = order[at_leaf : at_leaf + take]
            step = step[boxes[step] <= limit]
            at_leaf, take = at_leaf + take, min(2 * take, 64)
            rows = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in step])
            rows = rows[self.ids[rows] != own]
            away = self.points[rows] - at
            rows = rows[(away * away).sum(axis=1) <= limit]
            if not len(rows):
                continue
            score = cosines(self.vectors[rows], vector)
            top = np.lexsort((self.ids[rows], -score))[:k]
            best = sorted(best + [(-float(score[i]), int(self.ids[rows[i]])) for i in top])[:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 + 2 * best[-1][0]))
                limit = _REACH * bound + TINY
        return best


_REACH = quantile(CONFIDENCE, DIMENSIONS)
# The largest squared distance of unit vectors, and a little more for rounding.
WHOLE = 4.01


# --- the jobs -----------------------------------------------------------------------------------------------------------------


def usable(table: DataFrame, k: int = K) -> DataFrame:
    """``vec_id, v``: the rows that take part, each vector with its ``k + 1`` smallest ids only; of queries none is lost (see ``neighbours``)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def _points(vectors: pa.Array, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(-1, width)


def neighbours(table: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` of columns ``vec_id, v`` against all rows of ``table`` (``vec_id``, ``embedding``)."""
    spark = table.sparkSession
    rows = usable(table, k)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    width = width["w"]
    rows, queries = rows.where(F.size("v") == width), queries.where(F.size("v") == width)
    # Copies beyond the k + 1 smallest ids cannot be among the k nearest of any row.  A task cuts them before the shuffle.
    copies = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).dropDuplicates(["h1", "h2", "vec_id"])
    rows = written(top_per_group(copies, ["h1", "h2"], [("vec_id", True)], k + 1).select("vec_id", "v"), "ann-rows")
    queries = written(queries.select("vec_id", "v").dropDuplicates(), "ann-queries")

    n = rows.count()
    one_in = max(1, n // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(one_in)) == 0).limit(2 * SAMPLE).select("v").toPandas()["v"]
    low = projection(width)
    sample = units(np.array([np.asarray(v) for v in drawn])) @ low if len(drawn) else np.zeros((0, DIMENSIONS))
    nodes = fit_cells(sample, CELL_ROWS / max(n, 1)) if len(sample) else [None]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = route(units(_points(batch.column(1), width)) @ low, nodes) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "v", "cell"])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = units(_points(batch.column(1), width)) @ low if batch.num_rows else np.zeros((0, DIMENSIONS))
            cells = batch.column(2).to_numpy()
            own = [points[cells == c] for c in np.unique(cells)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            out = [np.unique(cells), [len(p) for p in own], [p.min(axis=0) for p in own], [p.max(axis=0) for p in own]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(out, kinds, strict=True)], names=["cell", "n", "lo", "hi"])

    placed = written(rows.mapInArrow(located, "vec_id long, v array<double>, cell long"), "ann-placed")
    asked = written(queries.mapInArrow(located, "vec_id long, v array<double>, cell long"), "ann-asked")
    found = placed.mapInArrow(boxes, "cell long, n long, lo array<double>, hi array<double>")
    axis = range(DIMENSIONS)
    # One box per cell; their number is bounded by the nodes of the tree that every task holds already.
    found = found.groupBy("cell").agg(
        F.sum("n").alias("n"),
        F.array(*[F.min(F.col("lo")[i]) for i in axis]).alias("lo"),
        F.array(*[F.max(F.col("hi")[i]) for i in axis]).alias("hi"),
    )
    found = written(found.withColumn("parts", F.ceil(F.col("n") / (2 * CELL_ROWS)).cast("int")), "ann-cells")
    cells = found.orderBy("cell").toPandas()
    lows, highs = np.array([*map(np.asarray, cells["lo"])]), np.array([*map(np.asarray, cells["hi"])])
    names, parts = cells["cell"].to_numpy(), cells["parts"].to_numpy()

    data = join_stats(placed, found.select("cell", "parts"), ["cell"])
    data = data.select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int").alias("part"), "vec_id", "v", F.lit(None).cast("double").alias("bound"))

    def visits(home: bool):
        """One row per query and cell part to search: its own cell, or the others that the stopping test leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = units(_points(batch.column(1), width)) @ low
                own, bound = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for i in range(batch.num_rows):
                    gap = np.maximum(lows - points[i], 0) + np.maximum(points[i] - highs, 0)
                    here = names == own[i]
                    go = here if home else ~here & ((gap * gap).sum(axis=1) <= _REACH * bound[i] + TINY)
                    to = np.flatnonzero(go)
                    cell, part = np.repeat(names[to], parts[to]), np.concatenate([np.arange(parts[t]) for t in to]) if len(to) else np.zeros(0, int)
                    again = pa.array(np.full(len(cell), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int64()), pa.array(part, pa.int32()), batch.column(0).take(again), batch.column(1).take(again), pa.array(np.full(len(cell), bound[i]))],
                        names=["cell", "part", "vec_id", "v", "bound"],
                    )

        return run

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        wanted = group["bound"].notna()
        here, ask = group[~wanted], group[wanted]
        if len(here) and len(ask):
            index = Index(here["vec_id"].to_numpy(np.int64), np.array([*map(np.asarray, here["v"])]))
            for own, vector, bound in zip(ask["vec_id"], ask["v"], ask["bound"], strict=True):
                vector = np.asarray(vector)
                out += [(int(own), vector, i, -s) for s, i in index.search(int(own), vector, k, bound)]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])

    def searched(visiting: DataFrame) -> DataFrame:
        both = data.unionByName(visiting)
        return both.groupBy("cell", "part").applyInPandas(search, "query_id long, q array<double>, vec_id long, score double")

    def best(hits: DataFrame) -> DataFrame:
        return top_per_group(hits, ["query_id", "q"], [("score", False), ("vec_id", True)], k, "rank")

    pair = "cell long, part int, vec_id long, v array<double>, bound double"
    first = asked.withColumn("bound", F.lit(WHOLE)).mapInArrow(visits(True), pair)
    near = written(best(searched(first)), "ann-home")
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("q").alias("v"), F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("bound"))
    known = asked.join(bounds, ["vec_id", "v"], "left").select("vec_id", "v", "cell", F.coalesce("bound", F.lit(WHOLE)).alias("bound"))
    far = searched(known.mapInArrow(visits(False), pair))
    return best(near.drop("rank").unionByName(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def result(table: DataFrame) -> DataFrame:
    """Contract columns for every row whose id is divisible by 50: ``query_id, rank, vec_id, score``."""
    return neighbours(table, usable(table).where(F.col("vec_id") % QUERY_EVERY == 0))
