"""Mesh background: clipped cells, fill, 3 x 3 median, bicubic surface; histogram background and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .pixels import size, with_size


def shape(pix: DataFrame) -> DataFrame:
    """One row (w, h, cell, nx, ny)."""
    s = size(pix).withColumn("cell", F.greatest(F.expr("greatest(w, h) div 32"), F.lit(16)))
    return s.withColumn("nx", F.expr("(w + cell - 1) div cell")).withColumn("ny", F.expr("(h + cell - 1) div cell"))


def cells(pix: DataFrame) -> DataFrame:
    """(cx, cy, n, kept, bg, sigma, valid) of every mesh cell."""
    p = pix.crossJoin(F.broadcast(shape(pix))).where(~F.isnan("v") & (F.abs("v") < float("inf")))  # one row
    g = p.groupBy(F.expr("x div cell").alias("cx"), F.expr("y div cell").alias("cy")).agg(stats.values("v").alias("l"), F.count("*").alias("n"))
    g = g.select("cx", "cy", "n", stats.mode_and_sigma(stats.clipped(F.col("l"), 3.0, 3, 10, 1e-6)).alias("m"))
    return g.select("cx", "cy", "n", F.col("m.kept").alias("kept"), F.col("m.mode").alias("bg"), F.col("m.sigma").alias("sigma"), ((F.col("n") >= 10) & (F.col("m.kept") >= F.expr("n * 7 div 10"))).alias("valid"))


def filled(mesh: DataFrame) -> DataFrame:
    """Invalid cells take the nearest valid one: by ring, then steps, then row order. A frame's cells are a bounded array."""
    every = mesh.where("valid").agg(F.collect_list(F.struct("cx", "cy", "bg", "sigma")).alias("cells"))
    ring = lambda c: F.greatest(F.abs(c["cx"] - F.col("cx")), F.abs(c["cy"] - F.col("cy")))
    steps = lambda c: F.abs(c["cx"] - F.col("cx")) + F.abs(c["cy"] - F.col("cy"))
    near = F.array_min(F.transform("cells", lambda c: F.struct(ring(c).alias("r"), steps(c).alias("d"), c["cy"].alias("cy"), c["cx"].alias("cx"), c["bg"].alias("bg"), c["sigma"].alias("sigma"))))
    m = mesh.crossJoin(F.broadcast(every)).withColumn("near", F.when(~F.col("valid"), near))
    return m.select("cx", "cy", "valid", F.when(F.col("valid"), F.col("bg")).otherwise(F.coalesce("near.bg", F.lit(0.0))).alias("bg"), F.when(F.col("valid"), F.col("sigma")).otherwise(F.coalesce("near.sigma", F.lit(1.0))).alias("sigma"))


def median3(mesh: DataFrame) -> DataFrame:
    """Upper median over the cell and its neighbours within the grid."""
    around = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = mesh.select("bg", F.explode(around).alias("t")).groupBy(F.col("t.cx").alias("cx"), F.col("t.cy").alias("cy")).agg(stats.values("bg").alias("l"))
    return mesh.drop("bg").join(spread, ["cx", "cy"]).select("cx", "cy", "valid", stats.upper_median(F.col("l")).alias("bg"), "sigma")


def overall(mesh: DataFrame) -> DataFrame:
    """One row (background, noise)."""
    valid = F.when(F.col("valid"), F.col("sigma"))
    noise = F.when(F.count(valid) == 0, 1.0).otherwise(F.greatest(stats.upper_median(stats.values(valid)), F.lit(0.001)))
    return mesh.agg(stats.upper_median(stats.values("bg")).alias("background"), noise.alias("noise"))


def _weights(t: Column) -> list[Column]:
    t2, t3 = t * t, t * t * t
    return [-0.5 * t3 + t2 - 0.5 * t, 1.5 * t3 - 2.5 * t2 + 1.0, -1.5 * t3 + 2.0 * t2 + 0.5 * t, 0.5 * t3 - 0.5 * t2]


def surface(pix: DataFrame, mesh: DataFrame) -> DataFrame:
    """Background of every pixel by Catmull-Rom interpolation; the grid travels as one bounded array."""
    grid = mesh.agg(F.transform(F.sort_array(F.collect_list(F.struct("cy", "cx", "bg"))), lambda c: c["bg"]).alias("grid"))
    p = pix.crossJoin(F.broadcast(shape(pix))).crossJoin(F.broadcast(grid))  # one row each
    for a in "xy":
        p = p.withColumn(f"f{a}", (F.col(a) - F.col("cell") * 0.5) / F.col("cell")).withColumn(f"i{a}", F.floor(f"f{a}"))
        p = p.withColumn(f"t{a}", F.col(f"f{a}") - F.col(f"i{a}"))
        for k, w in enumerate(_weights(F.col(f"t{a}"))):
            p = p.withColumn(f"w{a}{k}", w).withColumn(f"j{a}{k}", F.least(F.greatest(F.col(f"i{a}") + (k - 1), F.lit(0)), F.col(f"n{a}") - 1))
    total = None
    for j in range(4):
        for i in range(4):
            part = F.col(f"wy{j}") * F.col(f"wx{i}") * F.get("grid", (F.col(f"jy{j}") * F.col("nx") + F.col(f"jx{i}")).cast("int"))
            total = part if total is None else total + part
    return p.select("x", "y", F.when((F.col("nx") < 2) | (F.col("ny") < 2), F.col("grid")[0]).otherwise(total).alias("bg"))


def histogram_background(pix: DataFrame, rounds: int = 7) -> DataFrame:
    """One row (bg, sd): histogram mode, or the mean of a skewed frame; spread of a sparse sample, clipped round by round."""
    live = pix.where("v > 0 AND v < 65000").withColumn("b", F.round("v")).where("b >= 1 AND b < 65000")
    bins = live.groupBy("b").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    mode = bins.agg(F.max(F.struct("n", (-F.col("b")).alias("o")))["o"].alias("o"), (F.sum("s") / F.sum("n")).alias("mean"))
    bg = mode.select(F.when(F.col("mean") > 1.5 * -F.col("o"), F.col("mean")).otherwise(-F.col("o")).alias("bg"))
    step = F.greatest(F.round(F.col("h") / 71), F.lit(1.0))
    step = (step + F.when(step % 2 == 0, 1).otherwise(0)).cast("long")
    sample = with_size(pix).withColumn("step", step).where("x % step = 0 AND y % step = 0").crossJoin(F.broadcast(bg)).where((F.col("v") != 0) & (F.col("v") < 2 * F.col("bg")))
    s = sample.groupBy("bg").agg(F.collect_list(F.col("v") - F.col("bg")).alias("d"))  # some 71 x 71 values for each square of the frame
    start = F.struct(F.lit(0.0).alias("sd"), F.lit(False).alias("done"))

    def step_of(acc: Column, k: Column) -> Column:
        used = F.filter("d", lambda x: (k == 0) | (F.abs(x) <= 3.0 * acc["sd"]))
        new = stats.let(used, lambda u: F.when(F.size(u) > 0, F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x) / F.size(u))).otherwise(F.greatest(acc["sd"], F.lit(1.0))))
        near = lambda n: (k > 0) & (F.abs(acc["sd"] - n) < 0.05 * F.greatest(n, F.lit(1e-6)))
        return F.when(acc["done"], acc).otherwise(stats.let(new, lambda n: F.struct(F.greatest(n, F.lit(1e-6)).alias("sd"), near(n).alias("done"))))

    return s.select("bg", F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step_of)["sd"].alias("sd"))


def star_levels(pix: DataFrame, bg_sd: DataFrame, max_stars: int) -> DataFrame:
    """One row (level1, level2): where 6 and 24 times ``max_stars`` pixels lie above, less the background, floored."""
    bins = pix.where("v > 0 AND v < 65535").withColumn("b", F.round("v")).where("b >= 1 AND b < 65535").groupBy("b").agg(F.count("*").alias("n"))
    cum = bins.withColumn("cum", F.sum("n").over(Window.orderBy(F.desc("b"))))  # 65,534 bins at most
    level = cum.agg(F.max(F.when(F.col("cum") >= 6 * max_stars, F.col("b"))).alias("l1"), F.max(F.when(F.col("cum") >= 24 * max_stars, F.col("b"))).alias("l2"))
    clip = lambda c: F.greatest(F.coalesce(c, "bg") - F.col("bg") - 1.0, F.greatest(3.5 * F.col("sd"), F.lit(1.0)))
    return level.crossJoin(bg_sd).select("bg", "sd", clip("l1").alias("level1"), clip("l2").alias("level2"))  # one row each


def tile_noise(pix: DataFrame, rounds: int = 5) -> DataFrame:
    """(tx, ty, mean, sd): clipped mean and spread of a strided sample of each of 12 tiles along the longer side."""
    p = with_size(pix).withColumn("nx", F.expr("CASE WHEN w >= h THEN 12 ELSE greatest(12 * w div h, 1) END")).withColumn("ny", F.expr("CASE WHEN w >= h THEN greatest(12 * h div w, 1) ELSE 12 END"))
    p = p.withColumn("tw", F.expr("(w + nx - 1) div nx")).withColumn("th", F.expr("(h + ny - 1) div ny")).withColumn("tx", F.expr("x div tw")).withColumn("ty", F.expr("y div th"))
    p = p.withColumn("step", F.expr("greatest(greatest(least(tx * tw + tw, w) - tx * tw, least(ty * th + th, h) - ty * th) div 64, 1)"))
    s = p.where("(x - tx * tw) % step = 0 AND (y - ty * th) % step = 0").groupBy("tx", "ty").agg(stats.values("v").alias("l"))
    start = F.struct(stats.mean(F.col("l")).alias("mean"), F.lit(1.0).alias("sd"), F.lit(False).alias("done"))

    def step_of(acc: Column, k: Column) -> Column:
        used = F.filter("l", lambda x: (k == 0) | (F.abs(x - acc["mean"]) <= 3.0 * acc["sd"]))
        new = stats.let(used, lambda u: F.when(F.size(u) > 0, F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + (x - acc["mean"]) * (x - acc["mean"])) / F.size(u))))
        centre = lambda n: stats.let(F.filter("l", lambda x: F.abs(x - acc["mean"]) <= 3.0 * F.greatest(n, F.lit(1e-6))), lambda c: F.when(F.size(c) == 0, acc["mean"]).otherwise(stats.mean(c)))
        near = lambda n: (k > 0) & (F.abs(acc["sd"] - n) < 0.1 * F.greatest(n, F.lit(1e-6)))
        moved = lambda n: F.when(n.isNull(), F.struct(acc["mean"].alias("mean"), acc["sd"].alias("sd"), F.lit(True).alias("done"))).otherwise(F.struct(centre(n).alias("mean"), F.greatest(n, F.lit(1e-6)).alias("sd"), near(n).alias("done")))
        return F.when(acc["done"], acc).otherwise(stats.let(new, moved))

    got = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step_of)
    return s.select("tx", "ty", got.alias("g")).select("tx", "ty", F.col("g.mean").alias("mean"), F.greatest("g.sd", F.lit(1e-6)).alias("sd"))
