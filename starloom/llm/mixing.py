"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Method: every source is a task whose k-th unit of work is its k-th block of
documents.  With weight w, block k (from 0) is released at floor(k / w) and
due at ceil((k + 1) / w).  In each slot, the released block with the earliest
deadline goes next (ties to the smaller source).  Weights are whole parts of a
period, so one period's schedule, whose size is a parameter and not the
data's, is worked out once and repeats; at every slot each source that still
has blocks has got its share within less than one block.

A source without blocks left keeps its slots empty; the slots of the others
stay where they are.  A document's slot is past the horizon (``in_mix`` false)
when the sources still alive hold less than ``min_live`` of the weight.

Within a source, documents stand in the order of md5(id), then id.  Ranks come
from counts per (source, leading digits of the hash), so that a source with
any share of the rows is ranked in parallel.

Defined cases: a null source is a source of its own, ordered first; a null or
empty text counts as a document; repeated rows and ties of an id get
neighbouring ranks, null ids the first; a source without a weight given takes
the weight of one part; equal deadlines go to the smaller source; an empty
table gives an empty result; texts are carried whole, whatever their length.
Other columns may have any name: ``mix`` leaves out those with the names of its
own results, ``in_order`` none.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8
PERIOD = 1000
ALPHA = 0.5
MIN_LIVE = 0.5
MAX_BROADCAST = 100_000
ADDED = ["slot", "block", "release", "deadline", "position", "in_mix"]


def source_key(column: str) -> Column:
    """A source's name without nulls: null is '0', others get '1' before them."""
    return F.when(F.col(column).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(column).cast("string")))


def parts(counts: DataFrame, period: int, weights: Mapping[str, float] | None, alpha: float) -> DataFrame:
    """(key, n, part): whole parts of the period, at least one each; without weights, in proportion to n ** alpha.

    The part is the floor of the exact share, and the parts that are left go
    to the largest remainders.  If there are more sources than a period has
    parts, the period grows to their number.
    """
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in ("1" + k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        raw = F.coalesce(given[F.col("key")], F.lit(0.0))
    everything = Window.partitionBy()
    share = counts.withColumn("w", raw).withColumn("size", F.greatest(F.lit(period).cast("long"), F.count("*").over(everything)))
    share = share.withColumn("exact", F.col("w") / F.sum("w").over(everything) * (F.col("size") - F.count("*").over(everything)))
    share = share.withColumn("exact", F.round(F.coalesce("exact", F.lit(0.0)), 6)).withColumn("whole", F.floor("exact"))
    left = F.col("size") - F.count("*").over(everything) - F.sum("whole").over(everything)
    order = F.row_number().over(Window.partitionBy().orderBy((F.col("exact") - F.col("whole")).desc(), "key"))
    return share.withColumn("left", left).withColumn("turn", order).select("key", "n", (1 + F.col("whole") + (F.col("turn") <= F.col("left")).cast("long")).alias("part"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def period_schedule(shares: DataFrame) -> DataFrame:
    """(key, k, offset): the slot within a period of each source's k-th block, by earliest deadline.

    Sources of equal parts have equal releases and deadlines and take turns in
    the order of their names, so the state has an entry for each distinct part:
    at most the root of twice the period.  An entry holds when its next block is
    released and that block's rank: its deadline, then the source's number.
    """
    numbered = shares.select("key", "part", (F.row_number().over(Window.partitionBy().orderBy("key")) - 1).alias("no"))
    groups = numbered.groupBy("part").agg(F.sort_array(F.collect_list("no")).alias("own"))
    one = groups.agg(F.sort_array(F.collect_list(F.struct("part", "own"))).alias("g")).select("g", F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["part"] * F.size(x["own"])).alias("size"))
    size, none = F.col("size"), F.lit(2**62)

    def entry(group: Column, done: Column) -> Column:
        """State of a group of which ``done`` blocks have gone."""
        k, turn = F.floor(done / F.size(group["own"])), (done % F.size(group["own"])).cast("int")
        return F.struct(done.alias("done"), F.floor(k * size / group["part"]).alias("release"), (F.ceil((k + 1) * size / group["part"]) * 2**31 + F.get(group["own"], turn)).alias("rank"))

    def step(acc: Column, slot: Column) -> Column:
        first = F.array_min(F.transform(acc["s"], lambda x: F.when(x["release"] <= slot, x["rank"]).otherwise(none)))
        return _let(first, lambda f: F.struct(F.transform(acc["s"], lambda x, i: F.when(x["rank"] == f, entry(F.get("g", i), x["done"] + 1)).otherwise(x)).alias("s"), F.concat(acc["order"], F.array(f % 2**31)).alias("order")))

    # Slots go in runs of about the root of their number, so that no long array is copied at every slot.
    width = F.greatest(F.floor(F.sqrt(size.cast("double"))), F.lit(1))
    begin = F.struct(F.transform("g", lambda x: entry(x, F.lit(0).cast("long"))).alias("s"), F.array().cast("array<array<bigint>>").alias("runs"))

    def run(acc: Column, r: Column) -> Column:
        slots = F.sequence(r * width, F.least((r + 1) * width, size) - 1)
        part = F.aggregate(slots, F.struct(acc["s"].alias("s"), F.array().cast("array<bigint>").alias("order")), step)
        return _let(part, lambda p: F.struct(p["s"].alias("s"), F.concat(acc["runs"], F.array(p["order"])).alias("runs")))

    runs = F.sequence(F.lit(0).cast("long"), F.ceil(size / width) - 1)
    table = one.where("size > 0").select(F.posexplode(F.flatten(F.aggregate(runs, begin, run)["runs"])).alias("offset", "no"))
    named = table.join(numbered.select("no", "key"), "no").select("key", F.col("offset").cast("long").alias("offset"))
    return named.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("offset")) - 1).cast("long").alias("k"), "offset")


def _place(df: DataFrame, id_col: str, source_col: str, weights: Mapping[str, float] | None, block: int, period: int, alpha: float, min_live: float, rows_per_group: int) -> DataFrame:
    """(_row, slot, block, release, deadline, position, in_mix): the input's columns stand in one struct, so none can clash."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), source_key(source_col).alias("_key"), F.md5(F.col(id_col).cast("string")).alias("_hash"), F.col(id_col).alias("_id"))
    slim = df.select(source_key(source_col).alias("key"), F.md5(F.col(id_col).cast("string")).alias("hash"))
    total, sources = slim.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if sources <= MAX_BROADCAST else (lambda x: x)  # what is broadcast has a row a source or a slot of the period
    digits = max(1, math.ceil(math.log(max(total, 1) / rows_per_group + 1, 16)))
    head = lambda c: F.coalesce(F.substring(c, 1, digits), F.lit(""))

    groups = slim.groupBy("key", head("hash").alias("head")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = groups.select(F.col("key").alias("_key"), F.col("head").alias("_head"), before.alias("_before"))
    shares = parts(groups.groupBy("key").agg(F.sum("n").alias("n")), period, weights, alpha)
    schedule = period_schedule(shares)
    # The slot at which a source would need a block more than it has, and from these the horizon: one row a source.
    everything = Window.partitionBy()
    dry = shares.withColumn("size", F.sum("part").over(everything)).withColumn("dry", F.floor(F.ceil(F.col("n") / block) * F.col("size") / F.col("part")))
    dry = dry.withColumn("live", 1 - F.coalesce(F.sum("part").over(Window.partitionBy().orderBy("dry").rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)) / F.col("size"))
    horizon = dry.agg(F.min(F.when(F.col("live") < min_live, F.col("dry"))).alias("_horizon"))
    plan = shares.select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.sum("part").over(everything).alias("_size")).crossJoin(F.broadcast(horizon))  # one row
    plan = plan.join(schedule.select(F.col("key").alias("_key"), "k", "offset"), "_key")

    ranked = rows.withColumn("_head", head("_hash")).withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_head").orderBy("_hash", "_id")) - 1)
    placed = ranked.join(offsets, ["_key", "_head"]).withColumn("position", F.col("_rank") + F.col("_before")).withColumn("block", F.floor(F.col("position") / block))
    sizes = small(shares.select(F.col("key").alias("_key"), F.col("part").alias("_own")))
    placed = placed.join(sizes, "_key").withColumn("k", F.col("block") % F.col("_own"))
    out = placed.join(small(plan), ["_key", "k"])
    turn = F.floor(F.col("block") / F.col("_part"))
    slot = (turn * F.col("_size") + F.col("offset")).cast("long")
    return out.select(
        "_row",
        slot.alias("slot"),
        F.col("block").cast("long").alias("block"),
        F.floor(F.col("block") * F.col("_size") / F.col("_part")).cast("long").alias("release"),
        F.ceil((F.col("block") + 1) * F.col("_size") / F.col("_part")).cast("long").alias("deadline"),
        F.col("position").cast("long").alias("position"),
        (slot < F.coalesce(F.col("_horizon"), F.lit(2**62))).alias("in_mix"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, min_live: float = MIN_LIVE, rows_per_group: int = 1_000) -> DataFrame:
    """Every row with its slot, block, release and deadline (in slots), position within the source, and in_mix."""
    own = [c for c in df.columns if c.lower() not in ADDED]
    placed = _place(df, id_col, source_col, weights, block, period, alpha, min_live, rows_per_group)
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in own], *ADDED)


def in_order(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, rows_per_group: int = 1_000) -> DataFrame:
    """Every row with its columns as they were, whatever their names, in ranges of the schedule's order."""
    placed = _place(df, id_col, source_col, weights, block, period, alpha, MIN_LIVE, rows_per_group)
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "position").select("_row.*")
