"""Corpus preparation: five stages from raw documents to token ids.

Every stage works on all that its predecessor kept.  Quality rules drop what
they reject; near-duplicate groups keep their smallest id; secrets are cut out
of the texts; mixing writes every document in schedule order, also beyond the
slot at which sources run dry; encoding returns the token ids.

Defined cases, stage by stage.  Null, empty and word-less texts fail the
quality rules and go; later stages, given such rows, keep them.  Null ids and
rows that share an id are carried along by quality rules, secret scans, mixing
and encoding; near-duplicates keep the first row of a group (least id, then
text hash, null ids last), and one of rows alike in id and text.  Ties in
mixing go to the smaller source, then hash, then id.  Long texts are worked on
whole.  An empty table gives an empty result at every stage.  Other columns may
have any name and come back unchanged, but for ``n_chars``, which secret scans
bring up to date with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import bpe, minhash, mixing, quality, secret_scan
from starloom.llm.common import Scratch, table
from starloom.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.clean(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("secret scans", remove_secrets),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: No SQL: shingle components, entropy windows and BPE are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return STAGES[-1][1](spark, docs, sf_dir)
