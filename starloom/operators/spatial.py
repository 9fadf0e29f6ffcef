"""Spatial joins as equi-joins on buckets, and what is built on them."""

from __future__ import annotations

import tempfile
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side).cast("long")


def within(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs (a, b, d2) of ids with a distance up to ``radius``: buckets of that side, probed 3 x 3."""
    around = F.array(*[F.struct((_cell("x", radius) + dx).alias("bx"), (_cell("y", radius) + dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    probe = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("c")).select("a", "ax", "ay", "c.bx", "c.by")
    build = right.select(F.col("id").alias("b"), "x", "y", _cell("x", radius).alias("bx"), _cell("y", radius).alias("by"))
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    near = d2 < radius * radius if strict else d2 <= radius * radius
    return probe.join(build, ["bx", "by"]).where(near).select("a", "b", d2.alias("d2"))


def without_blends(points: DataFrame, radius: float) -> DataFrame:
    """Points with no other within the radius: both of a close pair go."""
    close = within(points, points, radius).where("a <> b").select(F.col("a").alias("id")).distinct()
    return points.join(close, "id", "left_anti")


def _cut(df: DataFrame) -> DataFrame:
    """The frame worked out and written to the checkpoint folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="starloom-"))
    return df.checkpoint()


def without_chains(points: DataFrame, radius: float) -> DataFrame:
    """Points that survive the pairing in order of flux: one not marked yet marks itself and all fainter ones in reach.

    Who marks is decided in rounds: a point whose brighter neighbours are all
    marked marks its fainter ones.  All points of the image are compared.
    """
    order = points.select("id", F.struct((-F.col("flux")).isNull().alias("none"), (-F.col("flux")).alias("flux"), F.col("id").alias("own")).alias("o"))
    near = within(points, points, radius).where("a <> b").select("a", "b")
    near = near.join(order.select(F.col("id").alias("a"), F.col("o").alias("ao")), "a").join(order.select(F.col("id").alias("b"), F.col("o").alias("bo")), "b")
    pairs = live = _cut(near.where("ao < bo").select(F.col("a").alias("bright"), F.col("b").alias("faint")))
    marked = pairs.select(F.col("faint").alias("id")).where("false")
    while not live.isEmpty():
        waiting = live.select(F.col("faint").alias("bright")).distinct()
        new = _cut(live.join(waiting, "bright", "left_anti").select(F.col("faint").alias("id")).distinct())
        marked = marked.union(new)
        # Pairs with a marked point are settled; with them go those of the points that marked, whose fainter ones are all marked.
        live = _cut(live.join(new.select(F.col("id").alias("faint")), "faint", "left_anti").join(new.select(F.col("id").alias("bright")), "bright", "left_anti"))
    return points.join(pairs.select(F.col("bright").alias("id")).distinct(), "id", "left_anti").join(marked, "id", "left_anti")


def suppressed(points: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Points that are left when, in order of flux (then id), each one that is left removes all later ones in reach.

    Decided in rounds without a list of pairs: the first of each bucket stays if
    no earlier point is in its reach, then what stays removes the points in its
    reach.  A round compares a point with the first ones of 3 x 3 buckets only,
    however many points a bucket has.  NaN is the largest flux, null the least;
    points without a place stay.
    """
    flux = F.col("flux")
    order = F.struct(flux.isNull().alias("none"), (~F.isnan(flux)).alias("number"), (-flux).alias("flux"), F.col("id").alias("own"))
    around = F.array(*[F.struct((F.col("hx") + dx).alias("bx"), (F.col("hy") + dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    dx, dy = F.col("p.x") - F.col("first.p.x"), F.col("p.y") - F.col("first.p.y")
    near = dx * dx + dy * dy < radius * radius if strict else dx * dx + dy * dy <= radius * radius

    def spread(df: DataFrame) -> DataFrame:
        return df.select("first", "hx", "hy", F.explode(around).alias("c")).select("first", "hx", "hy", F.col("c.bx").alias("bx"), F.col("c.by").alias("by"))

    def meets(left: DataFrame, right: DataFrame) -> Column:
        return (left["bx"] == right["bx"]) & (left["by"] == right["by"]) & near

    out = points.where("x IS NULL OR y IS NULL")
    live = points.where("x IS NOT NULL AND y IS NOT NULL").select(order.alias("o"), F.struct(*points.columns).alias("p"), _cell("x", radius).alias("bx"), _cell("y", radius).alias("by"))
    while not live.isEmpty():
        best = live.groupBy(F.col("bx").alias("hx"), F.col("by").alias("hy")).agg(F.min(F.struct("o", "p")).alias("first"))
        probe = spread(best)
        late = live.join(probe, meets(live, probe) & (F.col("o") < F.col("first.o"))).select("hx", "hy").distinct()
        kept = _cut(best.join(late, ["hx", "hy"], "left_anti").select("first", "hx", "hy"))
        out = out.union(kept.select("first.p.*"))
        probe = spread(kept)
        live = _cut(live.join(probe, meets(live, probe), "left_anti"))
    return out


def covered(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points that have one of the others strictly within the radius."""
    hit = within(points, others, radius, strict=True).select(F.col("a").alias("id")).distinct()
    return points.join(hit, "id", "left_semi")


def nearest(probes: DataFrame, points: DataFrame) -> DataFrame:
    """(probe, id, d2): the nearest point to each of a few stated probes, ties to the smaller id."""
    p = F.broadcast(probes.select(F.col("id").alias("probe"), F.col("x").alias("px"), F.col("y").alias("py")))  # the stated probes
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    best = points.crossJoin(p).groupBy("probe").agg(F.min(F.struct(d2.alias("d2"), F.col("id").alias("id"))).alias("m"))
    return best.select("probe", F.col("m.id").alias("id"), F.col("m.d2").alias("d2"))


def brightest(points: DataFrame, n: int) -> DataFrame:
    """The n brightest with their rank from 0: a bounded list."""
    top = points.orderBy(F.desc("flux"), "id").limit(n)
    return top.withColumn("i", F.row_number().over(Window.orderBy(F.desc("flux"), "id")) - 1)


def knn(points: DataFrame, k: int) -> DataFrame:
    """(i, rank, j, d2) among a bounded list of stars."""
    o = points.select(F.col("i").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"))
    d2 = (F.col("x") - F.col("jx")) * (F.col("x") - F.col("jx")) + (F.col("y") - F.col("jy")) * (F.col("y") - F.col("jy"))
    pairs = points.join(F.broadcast(o), F.col("i") != F.col("j")).select("i", "j", d2.alias("d2"))  # the list is a parameter's length
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rank") <= k)


def quads(points: DataFrame, group: int = 4) -> DataFrame:
    """Four-star patterns: every 4-subset of a star and its nearest, once each, with edge ratios, centre and longest edge."""
    near = knn(points, group - 1).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "j"))), lambda s: s["j"]).alias("js")).where(F.size("js") == group - 1)
    members = near.select("i", F.concat(F.array("i"), "js").alias("g"))
    subsets = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.col("g")[x] for x in c]).alias("idx")) for k, c in enumerate(combinations(range(group), 4))])
    q = members.select("i", F.explode(subsets).alias("s")).select("i", "s.k", "s.idx", F.array_sort("s.idx").alias("key"))
    q = q.withColumn("first", F.row_number().over(Window.partitionBy("key").orderBy("i", "k"))).where("first = 1").select("i", "k", "idx")
    stars = points.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("x", "y")))).alias("m"))
    q = q.crossJoin(F.broadcast(stars))  # one row with the bounded list
    at = [F.col("m")[F.col("idx")[n]] for n in range(4)]
    dist = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    q = q.withColumn("d", F.array_sort(F.array(*[dist(a, b) for a, b in combinations(at, 2)])))
    centre = lambda c: (at[0][c] + at[1][c] + at[2][c] + at[3][c]) / 4
    q = q.select("i", "k", "idx", centre("x").alias("cx"), centre("y").alias("cy"), F.col("d")[5].alias("longest"), "d").where("longest >= 1e-15")
    return q.select("i", "k", "idx", "cx", "cy", "longest", *[(F.col("d")[n] / F.col("longest")).alias(f"r{n + 1}") for n in range(5)])


def match_quads(image: DataFrame, sky: DataFrame, tolerance: float) -> DataFrame:
    """Pairs alike in all five ratios; those off the median scale by 20 % or more go, if there are three or more.

    The first ratio's logarithm makes the buckets: alike ratios are at most one apart.
    """
    width = -F.log(F.lit(1 - tolerance))
    b = lambda df: F.floor(F.log(F.col("r1")) / width).cast("long")
    im = image.select(F.col("i").alias("qi"), F.col("k").alias("qk"), *[F.col(c).alias(f"q{c}") for c in ("cx", "cy", "longest", "r1", "r2", "r3", "r4", "r5")], F.explode(F.array(b(image) - 1, b(image), b(image) + 1)).alias("b"))
    pairs = im.join(sky.withColumn("b", b(sky)), "b")
    for n in range(1, 6):
        pairs = pairs.where(F.least(f"qr{n}", f"r{n}") / F.greatest(f"qr{n}", f"r{n}") >= 1 - tolerance)
    m = pairs.select("qi", "qk", "i", "k", "qcx", "qcy", "cx", "cy", (F.col("longest") / F.col("qlongest")).alias("scale"))
    stats = m.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.500000001D) WITHIN GROUP (ORDER BY scale)").alias("mid"))
    return m.crossJoin(F.broadcast(stats)).where((F.col("n") < 3) | (F.col("mid") <= 1e-15) | (F.abs(F.col("scale") - F.col("mid")) / F.col("mid") < 0.2)).drop("n", "mid")  # one row


def ransac(matches: DataFrame, samples: list[tuple[int, int, int]], threshold: float, least: int) -> DataFrame:
    """Inliers (idx) of the first best of the sampled affine models; matches are (idx, x, y, xi, eta), idx from 0.

    Samples are tried in turn until one holds over 80 % of the matches.
    """
    spark = matches.sparkSession
    rows = spark.createDataFrame([(t, *s) for t, s in enumerate(samples)], "t int, s0 long, s1 long, s2 long")
    model = rows
    for n in range(3):
        model = model.join(matches.select(F.col("idx").alias(f"s{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("x", "y", "xi", "eta")]), f"s{n}")
    c = F.col
    det = c("x0") * (c("y1") - c("y2")) - c("y0") * (c("x1") - c("x2")) + (c("x1") * c("y2") - c("x2") * c("y1"))
    model = model.withColumn("det", det).where(F.abs("det") >= 1e-20)
    for v, s in (("xi", "1"), ("eta", "2")):
        z = [c(f"{v}{n}") for n in range(3)]
        model = model.withColumn(f"a{s}", (z[0] * (c("y1") - c("y2")) + z[1] * (c("y2") - c("y0")) + z[2] * (c("y0") - c("y1"))) / c("det"))
        model = model.withColumn(f"b{s}", (z[0] * (c("x2") - c("x1")) + z[1] * (c("x0") - c("x2")) + z[2] * (c("x1") - c("x0"))) / c("det"))
        model = model.withColumn(f"c{s}", (z[0] * (c("x1") * c("y2") - c("x2") * c("y1")) + z[1] * (c("x2") * c("y0") - c("x0") * c("y2")) + z[2] * (c("x0") * c("y1") - c("x1") * c("y0"))) / c("det"))
    model = model.select("t", *[f"{k}{s}" for k in "abc" for s in "12"])
    gap = F.sqrt((c("a1") * c("x") + c("b1") * c("y") + c("c1") - c("xi")) ** 2 + (c("a2") * c("x") + c("b2") * c("y") + c("c2") - c("eta")) ** 2)
    scale = F.sqrt(c("a1") * c("a1") + c("a2") * c("a2"))
    limit = F.when(scale > 1e-15, threshold * scale).otherwise(threshold * 1e-5)
    hits = matches.crossJoin(F.broadcast(model)).where(gap < limit).select("t", "idx")  # one row a sample
    score = hits.groupBy("t").agg(F.count("*").alias("n")).crossJoin(F.broadcast(matches.agg(F.count("*").alias("total"))))
    stop = score.agg(F.min(F.when(c("n") > c("total") * 0.8, c("t"))).alias("stop"))
    best = score.crossJoin(F.broadcast(stop)).where(c("stop").isNull() | (c("t") <= c("stop"))).agg(F.max(F.struct("n", (-c("t")).alias("o"))).alias("b")).where(c("b.n") >= least)
    return hits.join(F.broadcast(best.select((-c("b.o")).alias("t"))), "t").select("idx")
