"""The thin ``opN_*`` queries: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_extract, minhash, mixing, quality, secret_scan, toxicity, urls, warc
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(table(spark, sf_dir, "documents"), settings=minhash.Settings(width=4))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLES["op9_mixing"] = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key FROM documents
), cnt AS (
  SELECT key, count(*) AS n FROM doc GROUP BY key
), raw AS (
  SELECT key, n, pow(n::DOUBLE, {mixing.ALPHA}::DOUBLE) AS w, greatest({mixing.PERIOD}, count(*) OVER ()) AS size, count(*) OVER () AS m FROM cnt
), exact AS (
  SELECT key, n, size, m, round(w / sum(w) OVER () * (size - m), 6) AS exact FROM raw
), turn AS (
  SELECT key, n, floor(exact)::BIGINT AS whole, size - m - sum(floor(exact)::BIGINT) OVER () AS lft,
         row_number() OVER (ORDER BY exact - floor(exact) DESC, key) AS turn FROM exact
), share AS (
  SELECT key, n, 1 + whole + CASE WHEN turn <= lft THEN 1 ELSE 0 END AS part FROM turn
), lists AS (
  SELECT list(key ORDER BY key) AS ks, list(part ORDER BY key) AS ps, sum(part)::BIGINT AS size FROM share
), edf AS (
  SELECT ks, ps, size, 0::BIGINT AS slot, list_transform(ps, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM lists
  UNION ALL
  SELECT ks, ps, size, slot + 1, list_transform(range(1, len(ps) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (
    SELECT *, list_position(due, list_min(due))::BIGINT AS p FROM (
      SELECT *, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN (done[i] * size) // ps[i] <= slot THEN -((-(done[i] + 1) * size) // ps[i]) END) AS due
      FROM edf WHERE slot < size
    )
  )
), schedule AS (
  SELECT ks[pick] AS key, slot - 1 AS off, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf WHERE pick > 0
), dry AS (
  SELECT key, part, (ceil(n / {mixing.BLOCK}::DOUBLE)::BIGINT * size) // part AS dry, size FROM share, (SELECT sum(part)::BIGINT AS size FROM share)
), live AS (
  SELECT dry, 1 - sum(part) OVER (ORDER BY dry RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / size::DOUBLE AS live FROM dry
), horizon AS (
  SELECT min(dry) AS horizon FROM live WHERE live < {mixing.MIN_LIVE}
), placed AS (
  SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS position FROM doc
), blocks AS (
  SELECT p.*, p.position // {mixing.BLOCK} AS block, s.part, l.size FROM placed p JOIN share s USING (key) CROSS JOIN lists l
)
SELECT doc_id, source, ((block // part) * b.size + off)::BIGINT AS slot, block::BIGINT AS block,
       ((block * b.size) // part)::BIGINT AS release, (-((-(block + 1) * b.size) // part))::BIGINT AS deadline, position::BIGINT AS position,
       coalesce((block // part) * b.size + off < horizon, true) AS in_mix
FROM blocks b JOIN schedule c ON c.key = b.key AND c.k = b.block % b.part CROSS JOIN horizon
"""


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages")).drop("url", "payload")


ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN first END AS refers_to
FROM q
"""


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLES["op1_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again CROSS JOIN range(5) r(k) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^!]', '', 'g')) AS excl,
    strlen(text) - length(regexp_replace(text, '[^\x01-\x7F]', '', 'g')) AS beyond, strlen(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS solid
  FROM t LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.4 * n_words OR (up + low >= 40 AND up > 0.5 * (up + low)) OR excl > 0.5 * n_words OR (n_lines >= 4 AND n_dup_lines > 0.5 * n_lines)
    OR word_chars < 1.5 * n_words OR word_chars > 30 * n_words OR up + low + beyond < 0.5 * solid) AS kept
FROM b
"""

ORACLES["op8_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""
