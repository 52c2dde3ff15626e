"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected by ``dims`` Gaussian (2-stable) functions.  For a pair at distance d the
squared projected distance divided by d^2 is chi-square with ``dims`` degrees of freedom, so the
projected neighbours of a query, taken in order of projected distance r, need no more
verification once ``r^2 / d_k^2`` exceeds the ``confidence`` quantile: a point beyond r that is
nearer than the k-th found has a projection that far off with probability ``1 - confidence``
at most.

The top of the kd-tree deals the vectors into cells; a cell is a block of one task, cut into more
blocks where it is large.  A query first searches its own cell, and then, with that bound,
every cell that the stopping test does not exclude.  Within a block a local kd-tree yields the
buckets in order of their distance until the test holds, and of a bucket only the vectors whose own
projected distance passes the test are verified.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept

#: projections
DIMS = 24
#: vectors of a block, and of a bucket of its kd-tree
BLOCK_ROWS, BUCKET_ROWS = 8_000, 256
#: most cells of the top tree; larger cells are cut into blocks by hash
MAX_CELLS = 4_096
#: vectors that the top tree is fitted to
SAMPLE_ROWS = 50_000
#: queries of a block that one task answers
QUERY_ROWS = 2_000
CONFIDENCE = 0.93
#: share of a projection's squared length by which equal vectors may be off through rounding
ROUNDING = 1e-12


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def split(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """The top tree: (dimension, value, left, right) nodes; a negative child is the cell
    ``-child - 1``.  Cells get equal shares of the points; one cell has no node."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def build(rows: np.ndarray, n: int) -> int:
        nonlocal made
        if n == 1 or len(rows) < 2 or not np.ptp(points[rows], axis=0).max() > 0:
            made += 1
            return -made
        dim = int(np.ptp(points[rows], axis=0).argmax())
        left_n = n // 2
        value = float(np.quantile(points[rows, dim], left_n / n, method="lower"))
        left = points[rows, dim] <= value
        if left.all():                            # ties at the top: cut below them
            value = float(points[rows, dim][points[rows, dim] < value].max())
            left = points[rows, dim] <= value
        me = len(nodes)
        nodes.append((dim, value, 0, 0))
        a, b = build(rows[left], left_n), build(rows[~left], n - left_n)
        nodes[me] = (dim, value, a, b)
        return me

    build(np.arange(len(points)), cells)
    return nodes


def cell_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of each projected point."""
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -node - 1
        elif len(rows):
            dim, value, a, b = nodes[node]
            left = points[rows, dim] <= value
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


class Tree:
    """A kd-tree over the projections of a block: nodes with tight boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []
        self._build(points, 0, len(points))

    def _build(self, points: np.ndarray, lo: int, hi: int) -> int:
        mine = points[self.order[lo:hi]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((low, high, lo, hi, -1, -1))
        if hi - lo > BUCKET_ROWS and (high > low).any():
            dim, mid = int((high - low).argmax()), (hi - lo) // 2
            part = np.argpartition(mine[:, dim], mid)
            self.order[lo:hi] = self.order[lo:hi][part]
            a, b = self._build(points, lo, lo + mid), self._build(points, lo + mid, hi)
            self.nodes[me] = (low, high, lo, hi, a, b)
        return me

    def rising(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(squared distance of its box, first, end in ``order``) of the buckets, nearest box first."""
        def far(node: int) -> float:
            low, high = self.nodes[node][:2]
            gap = np.maximum(np.maximum(low - query, query - high), 0)
            return float(gap @ gap)

        heap = [(far(0), 0)]
        while heap:
            at, node = heapq.heappop(heap)
            _, _, lo, hi, a, b = self.nodes[node]
            if a < 0:
                yield at, lo, hi
            else:
                heapq.heappush(heap, (far(a), a))
                heapq.heappush(heap, (far(b), b))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, x)``: one row per non-null id whose vector takes part: not null, not zero,
    without null or non-finite components, of the most frequent length (ties: the shorter)."""
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = (vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                           F.col(vector_column).cast("array<double>").alias("x"))
            .where("vec_id is not null and x is not null and size(x) > 0")
            .where(finite & F.exists("x", lambda v: v != 0)))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return (rows.join(F.broadcast(sizes.select("n")), F.size("x") == F.col("n"), "left_semi")
            .groupBy("vec_id").agg(F.min("x").alias("x")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def _limit(quantile: float, bound, length):
    """Squared projected distance up to which the stopping test goes on; ``length`` is the
    query's squared projected length, and its rounding keeps exact copies within the limit."""
    return quantile * bound * (1 + 1e-9) + ROUNDING * length


def _search(block: pd.DataFrame, queries: pd.DataFrame, k: int, quantile: float) -> pd.DataFrame:
    """The k nearest of a block to each query, as far as the stopping test needs them.  The first
    row of a query holds how many vectors were ``verified``, without a vector if none is near."""
    out_q, out_v, out_d, out_n = [], [], [], []
    if len(block) and len(queries):
        p = _matrix(block["p"])
        tree = Tree(p)
        ids, x, p = block["vec_id"].to_numpy()[tree.order], _matrix(block["x"])[tree.order], p[tree.order]
        bounds = queries["bound"].to_numpy(np.float64)
        for q, qx, qp, bound in zip(queries["vec_id"].to_numpy(), _matrix(queries["x"]),
                                    _matrix(queries["p"]), bounds):
            got_v, got_d, verified, length = np.zeros(0, np.int64), np.zeros(0), 0, float(qp @ qp)
            for far, lo, hi in tree.rising(qp):
                limit = _limit(quantile, bound, length)
                if far > limit:
                    break
                rows = lo + np.flatnonzero(((p[lo:hi] - qp) ** 2).sum(axis=1) <= limit)
                verified += len(rows)
                d = ((x[rows] - qx) ** 2).sum(axis=1)
                keep = (d <= bound) & (ids[rows] != q)
                if keep.any():
                    got_v, got_d = np.append(got_v, ids[rows][keep]), np.append(got_d, d[keep])
                    if len(got_v) >= k:
                        best = np.lexsort((got_v, got_d))[:k]
                        got_v, got_d = got_v[best], got_d[best]
                        bound = min(bound, float(got_d[-1]))
            if not len(got_v):
                got_v, got_d = np.array([-1]), np.array([np.inf])
            out_q.append(np.full(len(got_v), q))
            out_v.append(got_v)
            out_d.append(got_d)
            out_n.append(np.r_[float(verified), np.full(len(got_v) - 1, np.nan)])
    none = [np.zeros(0)]
    d2, verified = np.concatenate(out_d or none), np.concatenate(out_n or none)
    vec_id = pd.Series(np.concatenate(out_v or none), dtype="Int64").mask(np.isinf(d2))
    return pd.DataFrame({"query_id": np.concatenate(out_q or none).astype(np.int64), "vec_id": vec_id,
                         "d2": d2, "verified": pd.Series(verified).astype("Int64")})


FOUND = "query_id long, vec_id long, d2 double, verified long"


def _answer(blocks: DataFrame, visits: DataFrame, k: int, quantile: float) -> DataFrame:
    """Every visit ``(cell, vec_id, x, p, bound)`` searches all blocks of its cell.  Visits of a
    cell are cut into groups of about ``QUERY_ROWS``, each with its own copy of the block."""
    groups = (visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
              .select("cell", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("groups")))
    parts = blocks.select("cell", "blocks").distinct().join(groups, "cell")
    asked = (visits.join(parts, "cell")
             .withColumn("group", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", "block", "group", "vec_id", "x", "p", "bound"))
    held = (blocks.join(groups, "cell")
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
            .select("cell", "block", "group", "vec_id", "x", "p"))

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _search(block, queries, k, quantile)

    keys = ("cell", "block", "group")
    return (held.groupBy(*keys).cogroup(asked.groupBy(*keys))
            .applyInPandas(run, FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest found of every query, with the vectors verified and blocks searched for it."""
    mine = Window.partitionBy("query_id")
    return (found.withColumns({"rank": F.row_number().over(mine.orderBy("d2", "vec_id")),
                               "verified": F.sum("verified").over(mine),
                               "blocks": F.count("verified").over(mine)})
            .where((F.col("rank") <= k) & F.col("vec_id").isNotNull()))


def nearest(vectors: DataFrame, is_query, k: int = 10, dims: int = DIMS, confidence: float = CONFIDENCE,
            id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 7) -> DataFrame:
    """``(query_id, rank, vec_id, score, verified, blocks)``: for every vector that ``is_query`` (a condition on
    ``vec_id``) selects, the k nearest other vectors found, ``score`` being the Euclidean distance
    in double precision; ties go to the smaller id.  ``verified`` vectors in ``blocks`` blocks were
    compared with the query in all.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null
    ids and vectors of another length than most; rows of one id count once (the smallest vector).
    With fewer than k others, all of them are returned; without usable vectors, no row.
    Further columns are ignored.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    rows = kept(usable(vectors, id_column, vector_column))
    n = rows.count()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long, blocks long")
    width = rows.select(F.size("x").alias("n")).first()["n"]
    directions = np.random.default_rng(seed).standard_normal((width, dims))
    cells = max(1, min(MAX_CELLS, -(-n // BLOCK_ROWS)))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(SAMPLE_ROWS).select("x").toPandas()
    nodes = split(_matrix(sample["x"]) @ directions, cells)
    quantile = chi_square_quantile(confidence, dims)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _matrix(b["x"]) @ directions
                yield b.assign(p=list(p), cell=cell_of(nodes, p))

    placed = kept(rows.mapInPandas(place, "vec_id long, x array<double>, p array<double>, cell int"))
    ends = [f(F.get("p", i)).alias(f"{name}{i}") for i in range(dims)
            for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()  # MAX_CELLS rows at most
    low = boxes[[f"low{i}" for i in range(dims)]].to_numpy()
    high = boxes[[f"high{i}" for i in range(dims)]].to_numpy()
    names = boxes["cell"].to_numpy(np.int32)
    share = F.broadcast(spark.createDataFrame(
        [(int(c), -(-int(m) // BLOCK_ROWS)) for c, m in zip(boxes["cell"], boxes["n"])], "cell int, blocks int"))
    blocks = (placed.join(share, "cell")
              .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.col("blocks")).cast("int")))

    queries = placed.where(is_query).toDF(*placed.columns)        # columns of its own: it meets `blocks`
    first = kept(_answer(blocks, queries.withColumn("bound", F.lit(float("inf"))), k, quantile))
    bound = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("d2").alias("bound"))
    bounded = queries.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, x, p, limit, own in zip(b["vec_id"], b["x"], _matrix(b["p"]) if len(b) else [], b["bound"], b["cell"]):
                gap = np.maximum(np.maximum(low - p, p - high), 0)
                far = (gap ** 2).sum(axis=1)
                go = names[(far <= _limit(quantile, limit, float(p @ p))) & (names != own)]
                if len(go):
                    yield pd.DataFrame({"cell": go, "vec_id": q, "x": [x] * len(go), "p": [p] * len(go),
                                        "bound": limit})

    visits = bounded.select("vec_id", "x", "p", "bound", "cell").mapInPandas(
        others, "cell int, vec_id long, x array<double>, p array<double>, bound double")
    second = _answer(blocks, kept(visits), k, quantile)
    return (_best(first.union(second), k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"),
                    "verified", "blocks"))
