"""Toxicity by a weighted finite-state pattern grammar.

Method: words are classed (insult, threat, target, negation, reporting verb,
intensifier, other).  Five transducers over word classes rewrite a clause from
left to right: reported speech and negation mark what stands in their scope,
insults and threats near a target become attacks and menaces.  They are
composed into one machine; each arc adds its weight to the clause's score.
A clause is matched as menace, attack, name-calling (an insult that is neither
marked nor aimed at a target) or marked.  A document is scored by its matched
clauses: a logistic model of how many there are of each kind, of their summed
and best score and of their share of all clauses, fitted on a bounded sample of labelled rows.  A word
that stands alone is no clause and counts for nothing.

The insult class is a fixed list.  The training rows add stems, since insults
are inflected: word beginnings that at least ``LEARN_SHARE`` of the toxic rows
have, ``LEARN_RATIO`` times the share of the others.  Of nested beginnings the
one that tells the two best apart is taken.

Only rows whose crc32(id as text) mod 3 is not 1 teach, at most ``SAMPLE`` of
them, chosen by a hash of the id.  Labels, lang, source and id are no inputs of a score.

Defined cases: a null or empty text has no clause and gets the score of such
texts; labels that are null, or of one class only, teach nothing and leave the
fixed weights; rows that share an id are each scored on their own text, and of
an id's labels the largest counts; a null id is not held out and teaches
nothing; stems that tell alike go by length, then name; an empty table gives an
empty result; long texts are scored whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch, text_slices
from .textnum import Flat

SAMPLE = 20_000
LEARN_SHARE, LEARN_RATIO = 0.02, 15.0
STEM_LENGTHS = range(3, 10)
THRESHOLD = 0.7
# Word classes.
INSULTS = "idiot idiots moron morons imbecile stupid dumb worthless loser losers scum trash garbage pathetic disgusting clown clowns filth vermin cretin dimwit halfwit bastard bitch asshole jerk pig swine coward liar parasite freak creep idiota imbecil estupido inutil basura asqueroso patetico idiote imbecile debile connard salaud ordure pathetique trottel vollidiot dummkopf abschaum arschloch versager widerlich erbärmlich".split()
THREATS = "kill murder hurt destroy crush burn shoot stab beat strangle hang slaughter töten umbringen matar tuer".split()
TARGETS = "you your yours yourself u he him his she her they them their everyone people du dich dir euch ihr sie tu te vous ils elles usted ustedes ellos tú".split()
NEGATIONS = "not never no isn aren wasn weren don doesn didn nobody nicht kein keine nie pas jamais ningún nunca".split()
REPORTS = "said says say wrote writes quoted quote called calls claimed reported allegedly according sagte schrieb nannte dit écrit dijo escribió".split()
INTENSIFIERS = "so such really very totally utterly complete absolute sehr total très tan muy".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, STEM = range(8)
# Symbols that the transducers write besides the classes.
MARKED_INSULT, MARKED_THREAT, MARKED_STEM, ATTACK, MENACE = range(8, 13)
SYMBOLS = 13
MARKED = {INSULT: MARKED_INSULT, THREAT: MARKED_THREAT, STEM: MARKED_STEM}

Arc = tuple[int, int, float]  # next state, symbol written, weight


class Transducer:
    """A deterministic letter-to-letter transducer: a table of arcs by (state, symbol)."""

    def __init__(self, states: int, arc):
        self.table: list[list[Arc]] = [[arc(s, x) for x in range(SYMBOLS)] for s in range(states)]

    def __matmul__(self, after: "Transducer") -> "Transducer":
        """Composition: what this one writes, ``after`` reads; weights add."""
        n = len(after.table)
        pairs = list(product(range(len(self.table)), range(n)))

        def arc(state: int, x: int) -> Arc:
            a, b = pairs[state]
            p, y, v = self.table[a][x]
            q, z, w = after.table[b][y]
            return p * n + q, z, v + w

        return Transducer(len(pairs), arc)

    def run(self, symbols: list[int]) -> tuple[list[int], float]:
        state, out, total = 0, [], 0.0
        for x in symbols:
            state, y, w = self.table[state][x]
            out.append(y)
            total += w
        return out, total


def _scope(opener: int, reach: int, cost: float) -> Transducer:
    """After ``opener``, insults and threats within ``reach`` words are marked, at a cost."""

    def arc(left: int, x: int) -> Arc:
        if x == opener:
            return reach, x, 0.0
        rest = max(left - 1, 0)
        if left and x in MARKED:
            return rest, MARKED[x], cost
        return rest, x, 0.0

    return Transducer(reach + 1, arc)


def _insult() -> Transducer:
    """Insults weigh 1, marked ones little; an intensifier before one adds to it."""

    def arc(primed: int, x: int) -> Arc:
        extra = 0.5 if primed else 0.0
        if x == INSULT:
            return primed, x, 1.0 + extra
        if x == STEM:
            return primed, x, 0.6 + extra
        if x in (MARKED_INSULT, MARKED_STEM):
            return primed, x, 0.3
        return (2 if x == INTENSIFIER else max(primed - 1, 0)), x, 0.0

    return Transducer(3, arc)


def _target(reach: int = 4) -> Transducer:
    """An insult within ``reach`` words after a target is an attack."""

    def arc(left: int, x: int) -> Arc:
        if x == TARGET:
            return reach, x, 0.0
        if left and x in (INSULT, STEM):
            return left, ATTACK if x == INSULT else x, 1.0
        return max(left - 1, 0), x, 0.0

    return Transducer(reach + 1, arc)


def _threat(reach: int = 3) -> Transducer:
    """A target within ``reach`` words after a threat makes a menace of it."""

    def arc(left: int, x: int) -> Arc:
        if x == THREAT:
            return reach, x, 0.0
        if left and x == TARGET:
            return 0, MENACE, 1.5
        return max(left - 1, 0), x, 0.0

    return Transducer(reach + 1, arc)


def grammar() -> Transducer:
    return _scope(REPORT, 6, -0.2) @ _scope(NEGATION, 3, -0.4) @ _insult() @ _target() @ _threat()


# What a matched clause is, by the symbols written for it; the first that fits counts.
KINDS = [("menace", {MENACE}), ("attack", {ATTACK}), ("name-calling", {INSULT, STEM}), ("marked", {MARKED_INSULT, MARKED_THREAT, MARKED_STEM})]
FEATURES = 1 + len(KINDS) + 3
DEFAULT = np.array([-3.0, 6.0, 5.0, 3.0, 0.0, 1.0, 1.0, 1.0])  # where there is nothing to learn from
_word = re.compile(r"[^\W\d_]+")
_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
_ends = np.zeros(256, bool)
_ends[list(b".!?;:\n")] = True


class Lexicon:
    """Word classes by word hash."""

    def __init__(self, stems: list[str] = ()):
        classes: dict[str, int] = {}
        for words, c in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENSIFIERS, INTENSIFIER)):
            for w in words:
                classes.setdefault(w, c)
        names = list(classes)
        flat = Flat(pa.array(names, pa.large_string()), fold=True)
        hashes = flat.span_hashes(flat.off[:-1], flat.off[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.classes = np.array([classes[n] for n in names], np.int8)[order]

        ends = Flat(pa.array(list(stems), pa.large_string()), fold=True)
        self.stems: dict[int, np.ndarray] = {}  # hashes of the stems by their length in bytes
        for h, n in zip(ends.span_hashes(ends.off[:-1], ends.off[1:]).tolist(), np.diff(ends.off).tolist(), strict=True):
            self.stems[n] = np.append(self.stems.get(n, np.zeros(0, np.uint64)), np.uint64(h))

    def classify(self, flat: Flat, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = flat.span_hashes(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.classes[at], OTHER)
        for n, own in self.stems.items():
            long = np.flatnonzero((ends - starts >= n) & (out == OTHER))
            out[long[np.isin(flat.span_hashes(starts[long], starts[long] + n), own)]] = STEM
        return out


def match(kinds: list[int], machine: Transducer) -> tuple[int | None, float]:
    """(kind of match, score) of one clause of word classes; a word that stands alone is no clause."""
    if len(kinds) < 2:
        return None, 0.0
    written, score = machine.run(kinds)
    symbols = set(written)
    return next((k for k, (_, own) in enumerate(KINDS) if symbols & own), None), score


def features(texts: pa.Array, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """(documents, FEATURES): 1, log counts of matched clauses by kind, log of their summed and of their best score, root of their share of all clauses."""
    flat = Flat(texts, fold=True)
    counts = np.zeros((flat.n, len(KINDS)))
    total, best, clauses = np.zeros(flat.n), np.zeros(flat.n), np.ones(flat.n)
    starts, ends = flat.runs(_letters[flat.b])
    if len(starts):
        kinds = lexicon.classify(flat, starts, ends)
        stop = np.zeros(len(flat.b) + 1, np.int64)
        np.cumsum(_ends[flat.b], out=stop[1:])
        doc = np.searchsorted(flat.off, starts, "right") - 1
        clause = stop[starts] + doc  # grows at every clause and document border
        edges = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]]))
        bounds = np.concatenate([edges, [len(starts)]])
        clauses = np.maximum(np.bincount(doc[edges], minlength=flat.n), 1)
        hot = np.unique(np.searchsorted(edges, np.flatnonzero((kinds == INSULT) | (kinds == THREAT) | (kinds == STEM)), "right") - 1)
        for c in hot.tolist():  # no transducer fires in a clause without an insult, a stem or a threat
            a, b = bounds[c], bounds[c + 1]
            kind, score = match(kinds[a:b].tolist(), machine)
            if kind is not None:
                d = doc[a]
                counts[d, kind] += 1
                total[d] += max(score, 0.0)
                best[d] = max(best[d], score)
    return np.column_stack([np.ones(flat.n), np.log1p(counts), np.log1p(total), np.log1p(best), np.sqrt(counts.sum(1) / clauses)])


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_stems(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int) -> list[str]:
    """Stems far more frequent in toxic rows; of nested ones, the best at telling them apart."""
    rated = []
    for stem, b in bad.items():
        x, y = (b + 0.5) / (n_bad + 1), (good.get(stem, 0) + 0.5) / (n_good + 1)
        if x >= LEARN_RATIO * y:
            rated.append((-(x - 2 * y), -len(stem), stem))
    out: list[str] = []
    for _, _, stem in sorted(rated):
        if not any(stem.startswith(o) or o.startswith(stem) for o in out):
            out.append(stem)
    return sorted(out)


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(learned stems, weights) from at most ``sample`` labelled rows, chosen by a hash of the id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    labelled = usable.count()
    share = min(1.0, (sample - 4 * sample**0.5) / max(labelled, 1))  # four deviations below, so the sample stays under its bound
    chosen = usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    scratch = Scratch(df.sparkSession, "toxicity")
    taught = scratch.write(df.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", F.col("toxic").cast("int").alias("toxic")), "taught")
    sizes = taught.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_bad, n_good = int(sizes[1]), int(sizes[0] - sizes[1])
    if not n_bad or not n_good:
        return [], DEFAULT

    def frequencies(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
        """(stem, n): rows that have a word with this beginning."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in text_slices(batch, 0):
                    n: Counter[str] = Counter()
                    for t in texts.to_pylist():
                        own = {w[:k] for w in set(_word.findall(t.lower())) for k in STEM_LENGTHS if len(w) >= k}
                        n.update(own if only is None else own & only)
                    yield pa.RecordBatch.from_pydict({"stem": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

        return map_arrow(rows.select("text"), run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    least = max(5.0, LEARN_SHARE * n_bad)
    bad = {r[0]: r[1] for r in frequencies(taught.where("toxic = 1"), None).where(F.col("n") >= least).collect()}  # as many as the mean row's stems over LEARN_SHARE at most
    good = {r[0]: r[1] for r in frequencies(taught.where("toxic = 0"), frozenset(bad)).collect()}
    learned = choose_stems(bad, good, n_bad, n_good)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(learned), grammar()
        for batch in batches:
            for at, texts in text_slices(batch, 0):
                x = features(texts, lexicon, machine)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(at, len(texts))], names=["x", "y"])

    got = map_arrow(taught, rows, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).collect()  # at most ``sample`` rows
    got.sort(key=lambda r: (r.x, r.y))
    x = np.repeat(np.array([r.x for r in got]), [r.n for r in got], axis=0)
    y = np.repeat(np.array([r.y for r in got], float), [r.n for r in got])
    return learned, fit(x, y)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    learned, weights = train(df, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(learned), grammar()
        for batch in batches:
            for at, texts in text_slices(batch, 2):
                p = 1 / (1 + np.exp(-np.clip(features(texts, lexicon, machine) @ weights, -30, 30)))
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_col), run, f"{id_col} {kind}, held_out boolean, score double, predicted int")
