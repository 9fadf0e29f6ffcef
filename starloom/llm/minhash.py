"""MinHash near-duplicate groups.

Method: many universal hash minima over word shingles with banding, checks of
candidate pairs on signatures and then on full shingle sets, and connected
components by alternating large-star and small-star.

1. Documents with equal shingle sets form a class, which is a node of its own
   with the texts of its first row (by id, then text hash; null ids last).
2. Band buckets are aggregated to their size; buckets of one class end here.
3. Star round: in each bucket the class with the most company is the hub, and
   every other class of the bucket is compared with it.
4. Rest round: a bucket whose classes are in one component needs nothing more.
   In any other, classes of different components are compared if the shingles
   that they can share allow the threshold (``_rest_pairs``).  No link between
   components is lost, and a dense group costs its size, not its square.
5. Candidates must reach the threshold within ``SLACK`` standard deviations on
   signatures, and exactly on full sets.

Banding of 32 x 5 minima misses a pair at similarity 0.8 with a chance of
3e-6, and the signature check with one of 2e-8.

Defined cases: white space other than [\\x20\\x09-\\x0D] belongs to words; a
null or empty text, or one without words, has an empty set, is linked with
nothing and kept; fewer words than a shingle form one shingle; repeated rows
are in one class; rows that share an id but not their text are nodes of their
own, and of one component the first is kept; a component's id is its least id,
null if it has null ids only, and a row with a null id is kept if no row with
an id is linked with it and it is the first; ties of a hub go to the least
node; an empty table gives an empty result; long texts are shingled whole;
other columns are ignored, or come back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch, text_slices
from .components import components
from .textnum import STEP, Flat, U, mix, window_hashes

SLACK = 5.5
RARE = 64


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts in turn, offsets (n + 1))."""
    flat = Flat(texts, fold=True)
    starts, ends, first = flat.word_spans()
    words = flat.span_hashes(starts, ends)
    windows = window_hashes(words, width)
    parts, sizes = [], np.zeros(flat.n + 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= width:
            s = np.sort(windows[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = mix((words[a:b] * np.array(STEP[: b - a], U)).sum(dtype=U) + U(b - a) + np.zeros(1, U))
        else:
            continue
        parts.append(s)
        sizes[d + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.cumsum(sizes)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift hashing: strongly universal from 32 to 32 bits for random 64-bit a, b."""
    a = mix(np.arange(1, n + 1, dtype=U) * U(0x9FB21C651E98DF25))
    return a, mix(a ^ U(0x2545F4914F6CDD1D))


def signatures(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(n, documents with a set) minima as 32-bit values."""
    x = sets >> U(32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((n, len(starts)), np.uint32)
    buf = np.empty_like(x)
    for k, (a, b) in enumerate(zip(*_coefficients(n), strict=True)):
        np.multiply(x, a, out=buf)
        np.add(buf, b, out=buf)
        out[k] = np.minimum.reduceat(buf, starts) >> U(32)
    return out


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """(at, mark) of a row, never null: its id, and a hash of its text and of whether the id is null."""
    number = F.col(id_col).cast("long")
    return [F.coalesce(number, F.lit(0).cast("long")).alias("at"), F.xxhash64(number.isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias("mark")]


def _prepare(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, mark, n, d1, d2, sig, keys) per row; d1, d2 is a 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                sets, off = shingle_sets(texts, s.width)
                n, size = len(texts), np.diff(off)
                full = size > 0
                digest = np.zeros((2, n), U)
                sig = np.zeros((n, 0), np.uint32)
                sig_off = np.concatenate([[0], np.cumsum(full)])
                keys = np.zeros((0, s.bands), U)
                if full.any():
                    begin = off[:-1][full]
                    digest[0, full] = np.add.reduceat(mix(sets), begin)
                    digest[1, full] = np.add.reduceat(mix(sets ^ STEP[0]), begin)
                    sig = signatures(sets, off, s.bands * s.rows).T
                    keys = np.empty((len(sig), s.bands), U)
                    for band in range(s.bands):
                        h = np.full(len(sig), mix(np.array([band], U))[0], U)
                        for r in range(s.rows):
                            h = mix(h ^ sig[:, band * s.rows + r].astype(U))
                        keys[:, band] = h
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(sig_off * (a.shape[1] if len(a) else 0), pa.int32()), pa.array(np.ascontiguousarray(a).ravel().view(kind)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists(sig, np.int32), lists(keys, np.int64)],
                    names=["id", "mark", "n", "d1", "d2", "sig", "keys"],
                )

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _row_key(id_col, text_col)[1]), run, "id long, mark long, n long, d1 long, d2 long, sig array<int>, keys array<long>")


def _with_sets(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members) of the given nodes (node, at, mark), from the whole texts of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                sets, off = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(sets.view(np.int64)))], names=["node", "members"])

    texts = df.select(*_row_key(id_col, text_col), F.col(text_col).alias("text")).join(nodes.hint("merge"), ["at", "mark"]).dropDuplicates(["at", "mark"])  # one plan for every size: nodes grow with the rows
    return map_arrow(texts.select("node", "text"), run, "node long, members array<long>")


def _agreeing(pairs: DataFrame, sig: DataFrame, s: Settings) -> DataFrame:
    """Pairs (node, hub) whose sizes and signatures allow the threshold."""
    k, t = s.bands * s.rows, s.percent / 100
    least = int(k * (t - SLACK * (t * (1 - t) / k) ** 0.5))
    hubs = sig.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    fit = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * s.percent
    same = F.aggregate(F.zip_with("sig", "hub_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return pairs.join(sig, "node").join(hubs, "hub").where(fit & (same >= least)).select("node", "hub")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): pairs whose full sets reach the threshold."""
    hubs = sets.select(F.col("node").alias("hub"), F.col("members").alias("hub_members"))
    both = F.size(F.array_intersect("members", "hub_members"))
    joined = pairs.join(sets, "node").join(hubs, "hub").select("node", "hub", both.alias("both"), (F.size("members") + F.size("hub_members")).alias("total"))
    return joined.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _group(df: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(id, mark, n, component, kept) of every row."""
    s, scratch = settings, Scratch(df.sparkSession, "minhash")
    ready = scratch.write(_prepare(df, id_col, text_col, s), "ready")
    whole = ready.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    at = F.coalesce("first.id", F.lit(0).cast("long")).alias("at")
    # Written before they are used, so that a node's number stays the same.
    classes = scratch.write(whole.groupBy("d1", "d2", "n").agg(first).select("d1", "d2", "n", "first", at, F.col("first.mark").alias("mark"), F.monotonically_increasing_id().alias("node")), "classes")
    rows = whole.select(F.coalesce("id", F.lit(0).cast("long")).alias("at"), "mark", "n", "sig", "keys")
    nodes = scratch.write(rows.join(classes.select("at", "mark", "node"), ["at", "mark"]).select("node", "n", "sig", "keys").dropDuplicates(["node"]), "nodes")
    places = classes.select("node", "at", "mark")
    sig = nodes.select("node", "n", "sig")

    entries = nodes.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "size")
    buckets = scratch.write(entries.join(sizes, "key"), "buckets")

    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = buckets.join(company, "node").select("key", "node", F.struct("company", (-F.col("node")).alias("order")).alias("rank"))
    hubs = ranked.groupBy("key").agg((-F.max("rank")["order"]).alias("hub"))
    stars = buckets.select("key", "node").join(hubs, "key").where("node <> hub").select("node", "hub").distinct()
    tried = scratch.write(_agreeing(stars, sig, s), "tried")
    wanted = tried.select("node").union(tried.select(F.col("hub").alias("node"))).distinct()
    sets = scratch.write(_with_sets(df, id_col, text_col, places.join(wanted, "node"), s.width), "sets")
    links = scratch.write(_confirmed(tried, sets, s.percent), "links")
    scratch.drop("sets")
    groups = scratch.write(components(links, scratch, "stars"), "groups")

    members = _unsettled(buckets, sig, groups, scratch)
    sets = scratch.write(_with_sets(df, id_col, text_col, places.join(members.select("node").distinct(), "node"), s.width), "sets")
    rest = _rest_pairs(members, sets, scratch, s).join(tried, ["node", "hub"], "left_anti").join(tried.select(F.col("node").alias("hub"), F.col("hub").alias("node")), ["node", "hub"], "left_anti")
    rest = scratch.write(_agreeing(rest, sig, s), "rest")
    if not rest.isEmpty():
        more = scratch.write(_confirmed(rest, sets, s.percent), "more")
        if not more.isEmpty():
            groups = scratch.write(components(links.union(more), scratch, "all"), "final")
    for name in ("buckets", "sets", "rare", "unsettled", "able", "bounds", "nodes"):
        scratch.drop(name)
    named = groups.join(classes.select("node", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = groups.join(least, "component").select("node", "least")
    labelled = classes.join(named, "node", "left").select("d1", "d2", "n", F.coalesce("least", "first").alias("least"))
    out = ready.select("id", "mark", "n", "d1", "d2").join(labelled, ["d1", "d2", "n"], "left")
    kept = F.col("least").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark")))
    return out.select("id", "mark", "n", F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component"), kept.alias("kept"))


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    out = _group(df, id_col, text_col, settings)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _unsettled(buckets: DataFrame, sig: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, label, n) of the buckets whose classes are not all in one component."""
    labelled = buckets.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    labelled = scratch.write(labelled.join(sig.select("node", "n"), "node"), "labelled")
    unsettled = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    members = scratch.write(labelled.join(unsettled, "key"), "unsettled")
    scratch.drop("labelled")
    return members


def _rest_pairs(members: DataFrame, sets: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """Pairs of different components that share a bucket and could still reach the threshold.

    A shingle is rare if at most ``RARE`` classes of unsettled buckets have it.
    Two sets share at most their c common-place shingles, plus the rare ones
    that the index of rare shingles lists for both.  So a pair is either one
    whose c allow the threshold, or one that meets in short lists of the index;
    all others, in a dense group nearly all, are never made.
    """
    entries = sets.select("node", F.explode("members").alias("shingle"))
    few = scratch.write(entries.groupBy("shingle").agg(F.count("*").alias("f"), F.min("node").alias("only")).where(F.col("f") <= RARE), "few")
    own = few.where("f = 1").groupBy(F.col("only").alias("node")).agg(F.count("*").alias("own"))
    rare = scratch.write(entries.join(few.where("f > 1").select("shingle"), "shingle"), "rare")
    shared = rare.groupBy("node").agg(F.count("*").alias("shared"))

    # c: shingles that aren't rare; reach: the largest partner that c allows.
    c = F.col("n") - F.col("own") - F.col("shared")
    reach = lambda x: x * (100 + s.percent) / s.percent - F.col("n")
    nodes = members.select("node", "label", "n").distinct().join(own, "node", "left").join(shared, "node", "left").na.fill(0, ["own", "shared"])
    nodes = scratch.write(nodes.select("node", "label", "n", "own", c.alias("c"), reach(c).alias("reach")), "bounds")
    scratch.drop("few")

    inside = members.select("key", "node").join(nodes, "node")
    counts = inside.groupBy("key", "label").agg(F.count("*").alias("size"), F.min("n").alias("n"), F.max("reach").alias("reach"))
    limits = counts.groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.min("n").alias("least"), F.max("reach").alias("furthest"))
    able = scratch.write(inside.join(limits, "key").where("reach >= least AND n <= furthest").select("key", "node", "label", "n", "reach", "main"), "able")
    hubs = able.select("key", *[F.col(x).alias(f"hub_{x}") for x in ("node", "label", "n", "reach")])
    fit = (F.col("label") != F.col("hub_label")) & ((F.col("hub_label") == F.col("main")) | (F.col("node") < F.col("hub_node"))) & (F.col("n") <= F.col("hub_reach")) & (F.col("hub_n") <= F.col("reach"))
    first = able.where("label <> main").join(hubs, "key").where(fit).select("node", F.col("hub_node").alias("hub")).distinct()

    usable = nodes.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * s.percent)
    listed = rare.join(usable.select("node", "label", "n", "c"), "node")
    other = listed.select("shingle", *[F.col(x).alias(f"hub_{x}") for x in ("node", "label", "n", "c")])
    met = listed.join(other, "shingle").where((F.col("node") < F.col("hub_node")) & (F.col("label") != F.col("hub_label")) & (F.col("n") * 100 >= F.col("hub_n") * s.percent) & (F.col("hub_n") * 100 >= F.col("n") * s.percent))
    met = met.groupBy("node", "hub_node", "n", "hub_n", "c", "hub_c").agg(F.count("*").alias("both"))
    second = met.where((F.least("c", "hub_c") + F.col("both")) * (100 + s.percent) >= (F.col("n") + F.col("hub_n")) * s.percent).select("node", F.col("hub_node").alias("hub"))
    return first.union(second).distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The first row of each group, all columns as they were; of rows that share its id and text one stays, but all with neither id nor words."""
    scratch = Scratch(df.sparkSession, "keepers")
    at, mark = _row_key(id_col, text_col)
    rows = _group(df, id_col, text_col, settings).where("kept").withColumn("alone", F.expr("id IS NULL AND n = 0"))
    kept = rows.groupBy(F.coalesce("id", F.lit(0).cast("long")).alias("_kept_at"), F.col("mark").alias("_kept_mark")).agg(F.max("alone").alias("_alone"), F.count("*").alias("copies"))
    kept = scratch.write(kept, "kept")
    keys = ["_kept_at", "_kept_mark"]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")  # one struct, so no input column can clash
    out = df.select(row, at.alias(keys[0]), mark.alias(keys[1])).join(kept.drop("copies"), keys)
    if not kept.where("copies > 1 AND NOT _alone").isEmpty():
        out = out.where("_alone").union(out.where("NOT _alone").dropDuplicates(keys))
    return out.select("_row.*")
