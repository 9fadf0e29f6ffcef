"""Quality rules as a short-circuit cascade.

Method: every rule's cost (seconds a row) and selectivity (share of rows it
rejects, of those that pass the base and the rules before it) are estimated on
a sample of about 1,024 rows; the rules then run in the order of rejection per
cost on the rows that all earlier ones let pass.  The order decides the work,
never the verdict: a row is kept when no rule rejects it.

Defined cases: a null or empty text has no words, all counts 0, fails the
base and is not kept; rows repeated in the input are judged each on its own;
null and repeated ids are carried along; rules of equal gain run in the order
given; an empty table gives an empty result; long texts are judged whole;
columns besides the two used are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import text_slices
from .textnum import IS_SPACE, Flat, U, mix, window_hashes

WINDOW = 5
# The symbol characters of the base rule.
SYMBOLS = "#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS.encode())] = True


@dataclass(frozen=True)
class Rule:
    """``reject`` maps a batch of whole texts to a boolean per text."""

    name: str
    reject: Callable[[Flat], np.ndarray]


def _count_words(f: Flat) -> np.ndarray:
    return np.diff(f.word_spans()[2])


def symbols_per_word(limit: float) -> Rule:
    return Rule("symbols_per_word", lambda f: f.per_document(IS_SYMBOL[f.b]) > limit * _count_words(f))


def shouting(limit: float, least: int = 40) -> Rule:
    """More than ``limit`` of the ASCII letters are capitals."""

    def reject(f: Flat) -> np.ndarray:
        upper = f.per_document((f.b >= 65) & (f.b <= 90))
        letters = upper + f.per_document((f.b >= 97) & (f.b <= 122))
        return (letters >= least) & (upper > limit * letters)

    return Rule("shouting", reject)


def exclamations(limit: float) -> Rule:
    return Rule("exclamations", lambda f: f.per_document(f.b == 33) > limit * np.maximum(_count_words(f), 1))


def duplicate_lines(limit: float, least: int = 4) -> Rule:
    def reject(f: Flat) -> np.ndarray:
        total, dup = _line_counts(f)
        return (total >= least) & (dup > limit * total)

    return Rule("duplicate_lines", reject)


def word_length(low: float, high: float) -> Rule:
    """The mean word, in code points, is shorter than ``low`` or longer than ``high``."""

    def reject(f: Flat) -> np.ndarray:
        words = np.maximum(_count_words(f), 1)
        chars = f.per_document(~IS_SPACE[f.b] & ((f.b & 0xC0) != 0x80))
        return (chars < low * words) | (chars > high * words)

    return Rule("word_length", reject)


def letterless(limit: float) -> Rule:
    """Less than ``limit`` of the non-space bytes belong to letters or to characters beyond ASCII."""

    def reject(f: Flat) -> np.ndarray:
        low = f.b | 0x20
        letters = f.per_document(((low >= 97) & (low <= 122)) | (f.b >= 128))
        return letters < limit * f.per_document(~IS_SPACE[f.b])

    return Rule("letterless", reject)


RULES = (symbols_per_word(0.4), shouting(0.5), exclamations(0.5), duplicate_lines(0.5), word_length(1.5, 30.0), letterless(0.5))


def _line_counts(f: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier one."""
    starts, ends, doc = f.line_spans()
    solid = np.zeros(len(f.b) + 1, np.int64)
    np.cumsum(~IS_SPACE[f.b], out=solid[1:])
    full = solid[ends] > solid[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    total = np.bincount(doc, minlength=f.n)
    _, first = np.unique(f.span_hashes(starts, ends) ^ mix(doc.astype(U)), return_index=True)
    return total, total - np.bincount(doc[first], minlength=f.n)


def base_counts(f: Flat) -> dict[str, np.ndarray]:
    """The five base counts of every text."""
    starts, ends, first = f.word_spans()
    n_words = np.diff(first)
    solid = ~IS_SPACE[f.b]
    out = {"n_words": n_words, "word_chars": f.per_document(solid & ((f.b & 0xC0) != 0x80)), "n_symbols": f.per_document(IS_SYMBOL[f.b]), "n_dup_lines": _line_counts(f)[1]}
    doc = np.repeat(np.arange(f.n), n_words)
    windows = window_hashes(f.span_hashes(starts, ends), WINDOW)
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(windows):
        own = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :])
        keys = windows[own] ^ mix(doc[own].astype(U))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            near = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)]
            again = own[near == keys]
            covered[again] += 1
            covered[again + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=f.n)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def cascade(texts: pa.Array, passed: np.ndarray, rules: tuple[Rule, ...], flat: Flat | None = None) -> tuple[np.ndarray, list[int]]:
    """Rows of ``passed`` that no rule rejects, and how many rows each rule was asked about.

    The texts are laid out anew for the rows that are left once they are fewer
    than half of those laid out.
    """
    rows = np.arange(len(texts))
    flat, alive, asked = flat or Flat(texts), np.array(passed, bool), []
    for rule in rules:
        if 2 * alive.sum() < len(rows):
            rows = rows[alive]
            flat, alive = Flat(texts.take(pa.array(rows))), np.ones(len(rows), bool)
        asked.append(len(rows))
        if len(rows):
            alive &= ~rule.reject(flat)
    kept = np.zeros(len(texts), bool)
    kept[rows[alive]] = True
    return kept, asked


def by_gain(cost: list[float], masks: dict[int, int]) -> list[tuple[int, float]]:
    """(rule, selectivity) in the order of rejection per cost, each rule rated on the rows that the earlier ones let pass.

    ``masks`` counts rows by the rules that reject them, a bit a rule.
    """
    left, out = dict(masks), []
    while len(out) < len(cost):
        total = max(sum(left.values()), 1)
        share = {k: sum(n for m, n in left.items() if m >> k & 1) / total for k in range(len(cost)) if k not in {x for x, _ in out}}
        best = max(share, key=lambda k: (share[k] / max(cost[k], 1e-12), -cost[k], -k))
        out.append((best, share[best]))
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def estimate(df: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, rows: int = 1024) -> list[dict]:
    """Cost and selectivity of each rule on a random sample of about ``rows`` rows, best rejection per cost first.

    Costs are those of a layout of texts of its own; selectivity counts rows
    that pass the base and the rules before.
    """
    total = df.count()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                own = texts.filter(pa.array(~base_failed(base_counts(Flat(texts)))))
                mask = np.zeros(len(own), np.int64)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hit = rule.reject(Flat(own.take(pa.array(np.arange(len(own))))))
                    took = time.perf_counter() - began
                    mask |= hit.astype(np.int64) << k
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "mask": pa.array([-1], pa.int64()), "rows": pa.array([len(own)], pa.int64()), "took": [took]})
                kinds, n = np.unique(mask, return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array([-1] * len(n), pa.int32()), "mask": pa.array(kinds, pa.int64()), "rows": pa.array(n, pa.int64()), "took": pa.array([0.0] * len(n), pa.float64())})

    sample = df.select(F.col(text_col).alias("t")).sample(min(1.0, rows / max(total, 1)), seed=7)
    got = map_arrow(sample, measure, "k int, mask long, rows long, took double").groupBy("k", "mask").agg(F.sum("rows").alias("rows"), F.sum("took").alias("took")).collect()  # a row a rule and a set of rules
    cost = [1.0] * len(rules)
    for r in got:
        if r.k >= 0 and r.rows:
            cost[r.k] = r.took / r.rows
    order = by_gain(cost, {r["mask"]: r.rows for r in got if r.k < 0})
    return [{"rule": rules[k].name, "cost": cost[k], "selectivity": share, "gain": share / max(cost[k], 1e-12)} for k, share in order]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, base counts, base_failed and kept."""
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[x["rule"]] for x in estimate(df, text_col, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                flat = Flat(texts)
                counts = base_counts(flat)
                failed = base_failed(counts)
                kept, _ = cascade(texts, ~failed, ordered, flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(failed), pa.array(kept)], names=[id_col, *counts, "base_failed", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, all columns as they were: the filter form, with no join and no shuffle."""
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[x["rule"]] for x in estimate(df, text_col, rules))
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, column):
                flat = Flat(texts)
                kept, _ = cascade(texts, ~base_failed(base_counts(flat)), ordered, flat)
                yield batch.slice(at, len(texts)).filter(pa.array(kept))

    return map_arrow(df, run, df.schema)
