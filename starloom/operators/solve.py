"""Least-squares fits: sums of products in Spark, then one small linear system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..shipping import map_arrow


def least_squares(df: DataFrame, systems: list[tuple[list[Column], Column]]) -> DataFrame:
    """(pos, value): coefficients of one least-squares problem, given as rows (terms, target) that each input row adds.

    The normal equations are sums, so their aggregation is partial; the system
    that is solved at the end has as many rows as there are coefficients.
    """
    k = len(systems[0][0])
    sums: dict[str, Column] = {}
    for terms, target in systems:
        for i in range(k):
            for j in range(i, k):
                sums[f"a{i}_{j}"] = sums.get(f"a{i}_{j}", F.lit(0.0)) + terms[i] * terms[j]
            sums[f"b{i}"] = sums.get(f"b{i}", F.lit(0.0)) + terms[i] * target
    names = list(sums)
    one = df.select(*[v.alias(n) for n, v in sums.items()]).agg(*[F.sum(n).alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row[names[0]] is None:
                    continue
                a, b = np.zeros((k, k)), np.zeros(k)
                for n, v in row.items():
                    if n[0] == "b":
                        b[int(n[1:])] = v
                    else:
                        i, j = map(int, n[1:].split("_"))
                        a[i, j] = a[j, i] = v
                scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                x = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-15)[0] / scale
                yield pa.RecordBatch.from_pydict({"pos": pa.array(range(k), pa.int32()), "value": pa.array(x)})

    return map_arrow(one, run, "pos int, value double")


def fit_affine(pairs: DataFrame) -> DataFrame:
    """Six coefficients of (x, y) -> (p, q)."""
    x, y, one, zero = F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.0)
    return least_squares(pairs, [([x, y, one, zero, zero, zero], F.col("p")), ([zero, zero, zero, x, y, one], F.col("q"))])


def fit_homography(pairs: DataFrame) -> DataFrame:
    x, y, p, q, one, zero = F.col("x"), F.col("y"), F.col("p"), F.col("q"), F.lit(1.0), F.lit(0.0)
    return least_squares(pairs, [([x, y, one, zero, zero, zero, -p * x, -p * y], p), ([zero, zero, zero, x, y, one, -q * x, -q * y], q)])


def fit_wcs(pairs: DataFrame, crpix: tuple[float, float], crval: tuple[float, float]) -> DataFrame:
    """The CD matrix (row by row, degrees a pixel) from pixels and sky points."""
    xi, eta = sky.to_tangent(F.col("ra"), F.col("dec"), *crval)
    u, v, zero = F.col("x") - crpix[0], F.col("y") - crpix[1], F.lit(0.0)
    return least_squares(pairs, [([u, v, zero, zero], F.degrees(xi)), ([zero, zero, u, v], F.degrees(eta))])


def fit_sip(pairs: DataFrame, order: int) -> DataFrame:
    """Distortion terms with 2 <= i + j <= order for du, then for dv, highest power of u first."""
    u, v = F.col("u"), F.col("v")
    terms = []
    for n in range(2, order + 1):
        for i in range(n, -1, -1):
            t = F.lit(1.0)
            for _ in range(i):
                t = t * u
            for _ in range(n - i):
                t = t * v
            terms.append(t)
    zero = [F.lit(0.0)] * len(terms)
    return least_squares(pairs, [(terms + zero, F.col("du")), (zero + terms, F.col("dv"))])


def triples(n: int, count: int = 100, seed: int = 42) -> list[tuple[int, int, int]]:
    """RANSAC samples: three different indices each, by 64-bit xorshift."""
    state, out, mask = seed, [], (1 << 64) - 1
    for _ in range(count):
        pick: list[int] = []
        while len(pick) < 3:
            state ^= state << 13 & mask
            state ^= state >> 7
            state ^= state << 17 & mask
            if state % n not in pick:
                pick.append(state % n)
        out.append(tuple(pick))
    return out
