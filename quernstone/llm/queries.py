"""The queries of this subpackage, one opN_ query an operator, with production parameters over whole tables, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .decontaminate import leaks
from .htmltext import extract
from .minhash import near_duplicates
from .neardup_vectors import near_vectors
from .records import token_digests
from .sharding import shard_documents
from .substring import remove_repeats
from .toxicity import toxicity_scores
from .warc import warc_digests


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digests(_table(spark, sf_dir, "pages"))


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, threshold=0.8)


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_ALL = (op1_warc, op2_leaks, op3_near_vectors, op4_html_text, op5_token_records, op6_substring_dedup, op7_toxicity, op8_near_duplicates, op9_lpt_shards, op10_bpe)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_BASE32 = " || ".join(
    f"(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {1 + 5 * k}, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1), '' ORDER BY j) FROM range(4) r(j))" for k in range(8)
)

ORACLE: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (hex)""",
    "op3_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON node = vec_id""",
    "op8_near_duplicates": r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS uid FROM documents GROUP BY text),
w AS (SELECT uid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM t),
g AS (SELECT uid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
b AS (SELECT uid, s, count(*) AS n FROM g GROUP BY uid, s),
z AS (SELECT uid, sum(n) AS total FROM b GROUP BY uid),
p AS (SELECT x.uid AS u, y.uid AS v, sum(least(x.n, y.n)) AS shared FROM b x JOIN b y ON x.s = y.s AND x.uid < y.uid GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN z a ON a.uid = u JOIN z c ON c.uid = v WHERE 5 * shared >= 4 * (a.total + c.total - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT uid AS node, uid AS root FROM t UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.node),
m AS (SELECT node, min(root) AS class_id FROM c GROUP BY node)
SELECT d.doc_id, t.uid AS text_class, m.class_id, d.doc_id = m.class_id AS kept
FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text JOIN m ON m.node = t.uid""",
}
