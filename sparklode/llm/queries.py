"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import jaccard, langid, lines, mixing, neardup_vectors, quality, sentencepiece, suffixes, topk, warc

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("SPARKLODE_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, with the decision to keep it."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids, and decoded again."""
    return sentencepiece.tokenize(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality for every document, by trees that are fitted on the labels."""
    docs = _read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


#: Target weights of op2; every other source has weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
BUDGET_SHARE = 0.5


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of half of all tokens, sources in proportion to their target weights."""
    return mixing.schedule(_read(spark, sf_dir, "documents"), WEIGHTS, budget_share=BUDGET_SHARE)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that occur earlier."""
    return lines.dedup(_read(spark, sf_dir, "documents"))


ORACLES["op2_mixing"] = """
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS BIGINT) AS n_tokens,
         md5('1-' || CAST(doc_id AS VARCHAR)) AS key,
         CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents),
timed AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id) AS DOUBLE) / weight AS finish FROM base),
ranked AS (
  SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish, source NULLS FIRST, key, doc_id) AS BIGINT) AS total_tokens FROM timed)
SELECT doc_id, source, n_tokens, finish, total_tokens FROM ranked
WHERE total_tokens <= floor((SELECT sum(n_tokens) FROM base) * 0.5)
"""

#: Least similarity of op3. A changed word takes up to three trigrams from either side, so one word in ten leaves 0.54.
NEAR = 0.5


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links: documents whose sets of word trigrams have
    a Jaccard similarity of at least NEAR with its own."""
    return jaccard.links(_read(spark, sf_dir, "documents"), NEAR)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read again as payload chunks of 16 KiB."""
    return warc.roundtrip(_read(spark, sf_dir, "pages"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document that consist of repeated passages of at least 50 words."""
    return suffixes.repeats(_read(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for every embedding whose id is divisible by 20."""
    return topk.nearest(_read(spark, sf_dir, "embeddings"), every=20)


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class of near duplicates and its number of links: embeddings with a cosine of at least 0.95
    with it."""
    return neardup_vectors.links(_read(spark, sf_dir, "embeddings"))


_CLASSES = """
reach AS (
  SELECT {row}, {row} AS other FROM {table}
  UNION
  SELECT r.{row}, l.b FROM reach r JOIN linked l ON l.a = r.other),
n AS (SELECT a, count(*) AS n_links FROM linked GROUP BY a)
SELECT r.{row}, min(r.other) AS class_id, CAST(coalesce(any_value(n.n_links), 0) AS BIGINT) AS n_links FROM reach r LEFT JOIN n ON n.a = r.{row} GROUP BY r.{row}
"""

ORACLES["op3_jaccard"] = """
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\r\f]+') AS ws FROM documents),
gram AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) ELSE [array_to_string(ws, ' ')] END) AS g
  FROM listed WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT m.a, m.b FROM met m JOIN size s ON s.doc_id = m.a JOIN size t ON t.doc_id = m.b
  WHERE CAST(m.common AS DOUBLE) / (s.n + t.n - m.common) >= 0.5 - 1e-12),
""" + _CLASSES.format(row="doc_id", table="documents")

ORACLES["op10_lattice"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
linked AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
""" + _CLASSES.format(row="vec_id", table="embeddings")

ORACLES["op4_warc"] = """
WITH page AS (SELECT '<urn:page:' || page_id || '>' AS record_id, url AS uri, hex(encode(html)) AS h FROM pages),
piece AS (SELECT *, CAST(unnest(range(greatest(1, CAST(ceil(length(h) / 32768.0) AS BIGINT)))) AS INTEGER) AS chunk_no FROM page),
cut AS (SELECT *, substr(h, 1 + chunk_no * 32768, 32768) AS part FROM piece)
SELECT record_id, uri, chunk_no, CAST(chunk_no AS BIGINT) * 16384 AS "offset", CAST(length(part) // 2 AS INTEGER) AS n_bytes,
       base64(unhex(part)) AS payload, sha1(unhex(substr(h, 1, (chunk_no + 1) * 32768))) AS sha1,
       (chunk_no + 1) * 32768 >= length(h) AS "last"
FROM cut
"""

ORACLES["op5_suffix_array"] = """
WITH listed AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM listed WHERE len(ws) >= 50),
passage AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER w) AS h, count(*) OVER w AS n
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
ranked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS places, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r
  FROM passage WHERE n = 50),
marked AS (SELECT doc_id, 'repeated' AS kind, i FROM ranked WHERE places > 1 UNION ALL SELECT doc_id, 'later', i FROM ranked WHERE r > 1),
edge AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, kind ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM marked),
span AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY i) AS s FROM edge)
SELECT doc_id, kind, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word FROM span GROUP BY doc_id, kind, s
"""

ORACLES["op6_topk"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbour, round(dist, 6) AS distance FROM r WHERE rank <= 10
"""

ORACLES["op8_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM split),
run AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, count(*) OVER (PARTITION BY doc_id) AS n
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS r FROM run WHERE i + 2 < n)
  WHERE r > 1),
dead AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) AS t(k))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE dead_i IS NULL), '') AS text,
       CAST(count(dead_i) AS INTEGER) AS n_deleted
FROM (SELECT l.*, d.i AS dead_i FROM line l LEFT JOIN dead d USING (doc_id, i)) GROUP BY doc_id
"""

QUERIES["op1_sentencepiece"] = op1_sentencepiece
QUERIES["op2_mixing"] = op2_mixing
QUERIES["op3_jaccard"] = op3_jaccard
QUERIES["op4_warc"] = op4_warc
QUERIES["op5_suffix_array"] = op5_suffix_array
QUERIES["op6_topk"] = op6_topk
QUERIES["op7_langid"] = op7_langid
QUERIES["op8_line_dedup"] = op8_line_dedup
QUERIES["op9_quality"] = op9_quality
QUERIES["op10_lattice"] = op10_lattice
