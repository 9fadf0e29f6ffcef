"""URL filters: rules first, then segmented words under naive Bayes.

Method: host labels are split into words by unigram Viterbi, with word counts
over all page texts, which stay in Spark and are joined to the substrings of
the distinct hosts; multinomial naive Bayes then scores the host's words and
the path's tokens.  The rules supply its training labels: urls that a rule
blocks or allows.  Its features are hashed into ``BUCKETS`` cells, so the
model's size is a parameter and no token is left out.

A rule fits its host and all subdomains if the path starts with the rule's;
the longest rule that fits wins.  A url without a rule is blocked if its
log-odds are above 0; if the rules give no example of one class, it is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the prior alone, as any url without tokens is;
null html adds no words; words longer than a host label can be (``LONGEST``)
only add to the total; repeated rows count as often as they stand; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch, text_slices
from .textnum import Flat

# The rules, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 16
LONGEST = 63  # letters of a host label by the domain name system
_is_letter = np.zeros(256, bool)
_is_letter[97:123] = _is_letter[65:91] = True
_tag = re.compile(r"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", re.S | re.I)
_token = re.compile(r"[^\W\d_]+|\d+")


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a url column."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def count_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): lower-cased ASCII words of all page texts, pre-counted in slices; those over ``LONGEST`` letters count as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                flat = Flat(pa.array([_tag.sub(" ", t) for t in texts.to_pylist()], pa.large_string()), fold=True)
                starts, ends = flat.runs(_is_letter[flat.b])
                fit = ends - starts <= LONGEST
                beyond = int(len(fit) - fit.sum())
                starts, ends = starts[fit], ends[fit]
                _, first, n = np.unique(flat.span_hashes(starts, ends), return_index=True, return_counts=True)
                data = flat.b.tobytes().lower()
                words = [data[a:b].decode("ascii") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"word": pa.array([*words, ""], pa.string()), "n": pa.array([*n.tolist(), beyond], pa.int64())})

    return map_arrow(pages.select(html_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Segmenter:
    """Splits a name into its likeliest words under a unigram model."""

    def __init__(self, words: dict[str, int], total: int):
        self.total = max(total, 1)
        self.cost = {w: math.log(self.total / n) for w, n in words.items()}
        self._known: dict[str, list[str]] = {}

    def _cost(self, word: str) -> float:
        got = self.cost.get(word)
        return got if got is not None else math.log(self.total) + 2.4 * len(word) + 1.0

    def split(self, name: str) -> list[str]:
        """Viterbi over end positions; ties go to the longer last word."""
        got = self._known.get(name)
        if got is None:
            best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
            for end in range(1, len(name) + 1):
                for start in range(max(0, end - LONGEST), end):
                    c = best[start] + self._cost(name[start:end])
                    if c < best[end] - 1e-12:
                        best[end], back[end] = c, start
            got, end = [], len(name)
            while end:
                got.append(name[back[end] : end])
                end = back[end]
            if len(self._known) > 50_000:
                self._known.clear()
            self._known[name] = got = got[::-1]
        return got


def parts(host: str) -> list[str]:
    """Runs of letters, of digits and of others in the host's labels, but for the last."""
    return [part for label in host.split(".")[:-1] for part in re.findall(r"[a-z]+|[0-9]+|[^a-z0-9-]+", label)]


def host_tokens(host: str, seg: Segmenter) -> list[str]:
    """Words of the host; numbers are alike."""
    out = []
    for part in parts(host):
        out += ["h:" + w for w in seg.split(part)] if part[0] in LOWER else ["h:0" if part[0].isdigit() else "h:" + part]
    return out


def path_tokens(path: str) -> list[str]:
    return ["p:0" if t[0].isdigit() else "p:" + t for t in _token.findall(path.lower())]


def split_hosts(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, words) of distinct hosts: their tokens under the counts of all words."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column(0).to_pylist():
                found = {part[a:b] for part in parts(host) if part[0] in LOWER for a in range(len(part)) for b in range(a + 1, min(a + LONGEST, len(part)) + 1)}
                yield pa.RecordBatch.from_pydict({"host": pa.array([host] * (len(found) + 1), pa.string()), "word": pa.array([*found, None], pa.string())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [host_tokens(h, Segmenter({w["word"]: w["n"] for w in ws}, total)) for h, ws in zip(hosts, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["host", "words"])

    met = map_arrow(hosts, pieces, "host string, word string").join(counts, "word", "left")
    known = met.groupBy("host").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    return map_arrow(known, split, "host string, words array<string>")


def bucket(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) % BUCKETS


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, tokens, score) of every row."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    counts = scratch.write(count_words(pages, html_col), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    host, path = host_path(url_col)
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"))
    words = scratch.write(split_hosts(rows.select("host").distinct(), counts.where("word <> ''"), total), "hosts")
    scratch.drop("words")
    rows = rows.join(words, "host").select(id_col, "host", "path", "rule", "ruled", "words")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for p, v, ws in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                row = sums[int(v == "block")]
                row[BUCKETS] += 1
                for t in ws + path_tokens(p):
                    row[bucket(t)] += 1
        kind, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(sums[kind, cell])})

    ruled = rows.where("ruled is not null").select("path", "ruled", "words")
    cells = map_arrow(ruled, train, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()  # at most 2 x (BUCKETS + 1) rows
    sums = np.zeros((2, BUCKETS + 1))
    for r in cells:
        sums[r.kind, r.cell] = r.n
    docs = sums[:, BUCKETS]
    smooth = sums[:, :BUCKETS] + 0.5
    odds = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    prior = float(np.log((docs[1] + 0.5) / (docs[0] + 0.5)))
    usable = bool(docs.min() > 0)
    model = spark.sparkContext.broadcast(odds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = model.value
        for batch in batches:
            paths, ruled, hosts = (batch.column(k).to_pylist() for k in (2, 4, 5))
            found = [ws + path_tokens(p) for ws, p in zip(hosts, paths, strict=True)]
            scores = [prior + float(sum(odds[bucket(t)] for t in ts)) if usable else -1.0 for ts in found]
            verdicts = [v or ("block" if s > 0 else "allow") for v, s in zip(ruled, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3)), pa.array(verdicts, pa.string()), pa.array([" ".join(ts) for ts in found], pa.string()), pa.array(scores, pa.float64())], names=[id_col, "host", "path", "rule", "verdict", "tokens", "score"])

    return map_arrow(rows, score, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, tokens string, score double")
