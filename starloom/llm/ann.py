"""Approximate nearest neighbours: stable projections under kd-trees.

Method: vectors are projected to a few dimensions by Gaussian (2-stable)
directions, so that squared projected over squared true distance follows a
chi-square law.  A query takes its projected neighbours incrementally, nearest
first, and verifies them on the original vectors, until the chi-square test
holds: a row not yet seen would be nearer than the k-th found with a chance
below 1 - CONFIDENCE.  The directions of one draw are made orthogonal, which
only narrows that law, so the test errs on the side of more neighbours.

The kd-tree has two levels.  Its upper part, fitted on a hash sample of at
most ``SAMPLE`` projected rows, cuts space into cells; every row goes to
exactly one of them.  A cell is held by one task and has a tree of its own.
A query is searched in its home cell first and then, with the distance found
there, in the other cells that the stopping radius reaches, and in no others.
Cells have about ``CELL`` rows, more only beyond ``MOST_CELLS`` cells, whatever
the cluster's size.

Rows of equal vectors are combined before they are sent, and equal queries are
searched once, so a vector that a third of all rows have costs no more than
others and its ties are exact.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
values take no part, neither as query nor as row, and so do rows with a null
identifier; vectors of other lengths are not compared; a row is no candidate
for queries of its own identifier; a repeated identifier is one query (with its
smallest vector) and fills one place of an answer, with its nearest vector;
ties go to the smaller identifier; an empty table gives an empty result; other
columns are ignored, whatever their names.  Long vectors are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .common import Scratch

PROJECTIONS = 32
CONFIDENCE = 0.8
LEAF = 64
CELL, MOST_CELLS = 4_096, 65_536
SAMPLE, SAMPLE_PER_CELL = 262_144, 64
HASHES = 1 << 20


def chi_square_cdf(x: float, m: int) -> float:
    """The lower incomplete gamma function as a series."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    if h > 700 + 2 * a:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int, seed: int = 11) -> np.ndarray:
    """(dim, m) directions with m half the dimensions, ``PROJECTIONS`` at most; each coordinate keeps a distance's scale."""
    m = max(1, min(PROJECTIONS, dim // 2))
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, m)))
    return q * math.sqrt(dim)


@dataclass
class Cells:
    """The upper kd-tree: splits (side, value, left, right), negative children being cells; and each cell's region."""

    splits: list[tuple[int, float, int, int]]
    low: np.ndarray
    high: np.ndarray

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        at = np.zeros(len(points), np.int64) if self.splits else np.full(len(points), -1)
        side, value, left, right = (np.array(c) for c in zip(*self.splits, strict=True)) if self.splits else ((),) * 4
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            at[live] = np.where(points[live, side[node]] < value[node], left[node], right[node])
        return -1 - at

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to every cell's region."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def cut_cells(sample: np.ndarray, cells: int) -> Cells:
    """Splits the largest part at its median along the widest side until there are ``cells``, or nothing is left to split."""
    m = sample.shape[1]
    splits: list[tuple[int, float, int, int]] = []
    lows, highs = [], []

    def cut(points: np.ndarray, share: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(m)
        if share > 1 and spread.max() > 0:
            side = int(np.argmax(spread))
            column = np.sort(points[:, side])
            fresh = np.flatnonzero(column[1:] > column[:-1]) + 1
            value = float(column[fresh[np.argmin(np.abs(fresh - len(column) / 2))]])
            me = len(splits)
            splits.append((side, value, 0, 0))
            left = points[:, side] < value
            upper, lower = high.copy(), low.copy()
            upper[side] = lower[side] = value
            a = cut(points[left], share // 2, low, upper)
            b = cut(points[~left], share - share // 2, lower, high)
            splits[me] = (side, value, a, b)
            return me
        lows.append(low)
        highs.append(high)
        return -len(lows)

    cut(sample, cells, np.full(m, -np.inf), np.full(m, np.inf))
    return Cells(splits, np.array(lows), np.array(highs))


def leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): points in the order of a kd-tree's leaves, by medians along the widest side."""
    order, starts = np.arange(len(points)), []
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        own = points[order[a:b]]
        if b - a > leaf:
            side = int(np.argmax(own.max(0) - own.min(0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        else:
            starts.append(a)
    return order, np.array(starts)


class Index:
    """The rows of one cell: distinct vectors with their smallest identifiers, in the order of kd-tree leaves."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], k: int, confidence: float = CONFIDENCE):
        vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        held: list[set[int]] = [set() for _ in range(len(vectors))]
        for own, c in zip(ids, inverse.ravel().tolist(), strict=True):
            held[c].update(own)
        self.k, self.direction = k, projection(vectors.shape[1])
        points = vectors @ self.direction
        order, self.starts = leaves(points)
        self.vectors, self.points = vectors[order], points[order]
        self.ids = [sorted(held[c])[: k + 1] for c in order.tolist()]
        self.ends = np.append(self.starts[1:], len(order))
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.limit = chi_square_quantile(confidence, self.points.shape[1])

    def search(self, q: np.ndarray, bound: float = math.inf) -> tuple[list[tuple[float, int]], int]:
        """The k + 1 nearest (distance, id) found of those within ``bound``, each identifier once, ties to the smaller; and how many rows were verified."""
        p, best, worst, seen = q @ self.direction, {}, bound, 0
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        reach = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(reach, kind="stable")
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(order) and reach[order[at]] <= self.limit * worst * worst:
            took = order[at : at + step]  # the next leaves by the distance of their boxes, in growing numbers
            at, step = at + step, min(2 * step, 16)
            radius = reach[order[at]] if at < len(order) else math.inf  # rows not yet taken are farther
            new = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in took.tolist()])
            gap = self.points[new] - p
            rows, far = np.concatenate([rows, new]), np.concatenate([far, np.einsum("ij,ij->i", gap, gap)])
            come = np.flatnonzero(far <= min(radius, self.limit * worst * worst))
            come = come[np.argsort(far[come], kind="stable")]
            begin, size = 0, 16
            while begin < len(come):  # incremental neighbours, verified in growing batches
                part = come[begin : begin + size]
                begin, size = begin + size, min(2 * size, 256)
                part = part[far[part] <= self.limit * worst * worst]
                if not len(part):
                    break
                seen += len(part)
                gap = self.vectors[rows[part]] - q
                dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                close = np.flatnonzero(dist <= worst)
                if len(close):
                    for c in close.tolist():
                        d = float(dist[c])
                        for i in self.ids[rows[part[c]]]:
                            if d < best.get(i, math.inf):
                                best[i] = d
                    if len(best) > self.k:
                        kept = sorted((d, i) for i, d in best.items())[: self.k + 1]
                        best, worst = {i: d for d, i in kept}, min(worst, kept[-1][0])
            keep = far > radius
            rows, far = rows[keep], far[keep]
        return sorted((d, i) for i, d in best.items()), seen


def usable(column: str) -> Column:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float, copy=False)


def _by_length(column: pa.Array):
    """(row numbers, vectors) for each length."""
    size = column.value_lengths().to_numpy()
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, matrix(column.take(pa.array(rows)))


def combine(rows: DataFrame, k: int) -> DataFrame:
    """(dim, v, ids): equal vectors of a batch as one row with their k + 1 smallest identifiers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, vectors in _by_length(batch.column(1)):
                held: dict[bytes, list[int]] = {}
                for i, v in zip(ids[at].tolist(), vectors, strict=True):
                    held.setdefault(v.tobytes(), []).append(i)
                dim = vectors.shape[1]
                flat = np.frombuffer(b"".join(held), float)
                n = len(held)
                lists = [sorted(set(x))[: k + 1] for x in held.values()]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(flat)), pa.array(lists, pa.list_(pa.int64()))], names=["dim", "v", "ids"])

    return map_arrow(rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")), run, "dim int, v array<double>, ids array<long>")  # -0.0 + 0.0 is 0.0


def fit_cells(combined: DataFrame, sizes: dict[int, int]) -> dict[int, Cells]:
    """The upper tree of every length, from a sample chosen by a hash of the vector."""
    wanted = {dim: min(MOST_CELLS, -(-n // CELL)) for dim, n in sizes.items()}
    many = {dim: c for dim, c in wanted.items() if c > 1}
    out = {dim: Cells([], np.full((1, projection(dim).shape[1]), -np.inf), np.full((1, projection(dim).shape[1]), np.inf)) for dim in sizes}
    if many:
        drawn = {dim: min(SAMPLE_PER_CELL * c, SAMPLE) for dim, c in many.items()}
        scale = min(1.0, SAMPLE / sum(drawn.values()))
        least = F.lit(0)
        for dim, n in drawn.items():
            least = F.when(F.col("dim") == dim, F.lit(math.ceil(scale * n / sizes[dim] * HASHES))).otherwise(least)

        def project(batches):
            for batch in batches:
                for at, vectors in _by_length(batch.column(1)):
                    points = (vectors @ projection(vectors.shape[1])).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(points), pa.list_(pa.float32()))], names=["dim", "p"])

        sample = map_arrow(combined.where(F.pmod(F.xxhash64("v"), F.lit(HASHES)) < least).select("dim", "v"), project, "dim int, p array<float>").toArrow().combine_chunks()
        order = pa.table({"dim": sample["dim"], "p": sample["p"]}).to_pydict() if sample.num_rows else {"dim": [], "p": []}
        for dim, cells in many.items():
            points = np.array(sorted(p for d, p in zip(order["dim"], order["p"], strict=True) if d == dim))
            if len(points):
                out[dim] = cut_cells(points, cells)
    return out


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for each row whose id is divisible by ``every``, its k nearest found, and how many rows were verified for it."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "neighbours")
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    combined = scratch.write(combine(rows, k), "rows")
    sizes = {r[0]: r[1] for r in combined.groupBy("dim").agg(F.count("*")).collect()}  # a row a length
    trees = spark.sparkContext.broadcast(fit_cells(combined, sizes))  # MOST_CELLS regions a length at most

    def route(batches):
        for batch in batches:
            for at, vectors in _by_length(batch.column(0)):
                dim = vectors.shape[1]
                cell = trees.value[dim].locate((vectors @ projection(dim)).astype(np.float32))
                own = pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([dim] * len(at), pa.int32()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "dim", "cell"])

    data = map_arrow(combined.select("v", "ids"), route, "v array<double>, ids array<long>, dim int, cell int")
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0))).alias("v")).select("id", "v", *key)
    asked = scratch.write(asked, "asked")
    single = asked.groupBy("h1", "h2").agg(F.min("v").alias("v"))
    home = map_arrow(single.select("v", "h1", "h2"), route, "v array<double>, h1 long, h2 long, dim int, cell int")

    def search(table: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and queries.num_rows:
            column = lambda t, name: t[name].combine_chunks() if isinstance(t[name], pa.ChunkedArray) else t[name]
            index = Index(matrix(column(table, "v")), table["ids"].to_pylist(), k, confidence)
            for a, b, d, q in zip(*(queries[x].to_pylist() for x in ("h1", "h2", "bound")), matrix(column(queries, "v")), strict=True):
                found, seen = index.search(q, math.inf if d is None else d)
                out.append((a, b, [{"score": s, "vec_id": i} for s, i in found], seen))
        columns = list(zip(*out, strict=True)) or [()] * 4
        near = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"h1": pa.array(columns[0], pa.int64()), "h2": pa.array(columns[1], pa.int64()), "near": pa.array(columns[2], near), "seen": pa.array(columns[3], pa.int64())})

    def visit(queries: DataFrame) -> DataFrame:
        return data.groupBy("dim", "cell").cogroup(queries.groupBy("dim", "cell")).applyInArrow(search, "h1 long, h2 long, near array<struct<score:double,vec_id:long>>, seen long")

    first = scratch.write(visit(home.withColumn("bound", F.lit(None).cast("double"))), "first")

    def spread(batches):
        for batch in batches:
            for at, vectors in _by_length(batch.column(0)):
                dim = vectors.shape[1]
                tree, direction = trees.value[dim], projection(dim)
                limit = chi_square_quantile(confidence, direction.shape[1])
                points = (vectors @ direction).astype(np.float32)
                homes, bounds = tree.locate(points), batch.column(3).take(pa.array(at)).to_pylist()
                for n, (p, own, d) in enumerate(zip(points.astype(float), homes.tolist(), bounds, strict=True)):
                    met = np.flatnonzero(tree.bounds(p) <= (math.inf if d is None else limit * d * d))
                    met = met[met != own]
                    one = batch.slice(int(at[n]), 1).take(pa.array(np.zeros(len(met), np.int64)))
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([dim] * len(met), pa.int32()), pa.array(met, pa.int32())], names=[*batch.schema.names, "dim", "cell"])

    bound = F.when(F.size("near") > k, F.element_at("near", k + 1)["score"]).alias("bound")
    again = map_arrow(single.join(first.select("h1", "h2", bound), ["h1", "h2"]).select("v", "h1", "h2", "bound"), spread, "v array<double>, h1 long, h2 long, bound double, dim int, cell int")
    both = first.union(scratch.write(visit(again), "again")) if any(len(t.low) > 1 for t in trees.value.values()) else first
    # One row a distinct query: k + 1 entries of the home cell, and of others those within the distance found there.
    found = both.select("h1", "h2", F.explode("near").alias("x")).groupBy("h1", "h2", "x.vec_id").agg(F.min("x.score").alias("score"))
    lists = found.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    lists = lists.join(both.groupBy("h1", "h2").agg(F.sum("seen").alias("verified")), ["h1", "h2"])
    own = asked.select("id", "h1", "h2").join(lists, ["h1", "h2"])
    out = own.select(F.col("id").alias("query_id"), "verified", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "verified")
