"""Queries over the driver's tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25, idf
from ..functions.text import STOPWORDS, approx_tokens, embedding_text, normalize_terms, short_id, strip_html
from ..functions.vector import cosine
from ..operators.bm25 import bm25_scores, ranked
from ..operators.chunker import chunk, chunk_in_python
from ..operators.excerpt import answers, budgeted, most
from ..operators.hybrid import Fusion, hybrid_scores
from ..operators.index import doc_stats, postings, term_stats
from ..sources.html import host, html_to_markdown
from .answers import answer_in_turn, answer_ranked, search
from ..operators.scratch import scratch
from .store import IndexStore
from .corpora import embedded_corpus, markdown_corpus, prompts, search_corpus, table

INDEXED = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROMPT = "tion with re ouch thing"


def _one(spark: SparkSession, prompt: str = PROMPT, tokens: int = 2000) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(prompt).alias("prompt"), F.lit(tokens).alias("max_tokens"))


def _one_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("vector"))
    return _one(spark).join(first, F.lit(True), "left")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def normalize_terms_counts(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(normalize_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def strip_html_pages(spark, sf_dir):
    text = strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", approx_tokens(F.col("text")).cast("long").alias("tokens"))


def term_frequency(spark, sf_dir):
    return postings(search_corpus(spark, sf_dir))


def doc_frequency(spark, sf_dir):
    return term_stats(postings(search_corpus(spark, sf_dir)))


def chunk_length_avg(spark, sf_dir):
    return doc_stats(search_corpus(spark, sf_dir)).select("doc_id", "num_chunks", F.round("avg_len", 6).alias("avg_len"))


def idf_weights(spark, sf_dir):
    chunks = search_corpus(spark, sf_dir)
    both = term_stats(postings(chunks)).join(doc_stats(chunks), "doc_id")
    return both.select("doc_id", "term", F.round(idf(F.col("num_chunks"), F.col("df")), 6).alias("idf"))


def bm25_rank(spark, sf_dir):
    chunks = search_corpus(spark, sf_dir).withColumn("has_code", F.lit(False))
    return _flat(ranked(bm25_scores(chunks, _one(spark)), chunks)).select("doc_id", "chunk_id", "score", "rank")


def bm25_code_boost(spark, sf_dir):
    chunks = search_corpus(spark, sf_dir)
    return _flat(bm25_scores(chunks, _one(spark), Bm25())).select("doc_id", "chunk_id", "score")


def multi_query_bm25(spark, sf_dir):
    return _flat(bm25_scores(search_corpus(spark, sf_dir), prompts(spark, sf_dir))).select("query_id", "doc_id", "chunk_id", "score")


def cosine_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(q), F.lit(True)).select("vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))


def hybrid_weighted(spark, sf_dir):
    return _flat(hybrid_scores(search_corpus(spark, sf_dir), _one_vector(spark, sf_dir), Fusion("weighted"), embedded=embedded_corpus(spark, sf_dir))).select("doc_id", "chunk_id", "score")


def hybrid_rrf(spark, sf_dir):
    return _flat(hybrid_scores(search_corpus(spark, sf_dir), _one_vector(spark, sf_dir), Fusion("rrf"), embedded=embedded_corpus(spark, sf_dir))).select("doc_id", "chunk_id", "score")


def _fitted(spark, sf_dir):
    chunks = search_corpus(spark, sf_dir)
    found = search(chunks, _one(spark), top=most(2000)).withColumn("max_tokens", F.lit(2000)).drop("start_line")
    return budgeted(found, chunks)


def excerpts_budget(spark, sf_dir):
    return _fitted(spark, sf_dir).where("fits").select("doc_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("tokens").cast("long").alias("tokens"), F.col("used").cast("long").alias("used"))


def query_answer(spark, sf_dir):
    return answers(_fitted(spark, sf_dir)).select("doc_id", "answer")


def query_all_ranked(spark, sf_dir):
    return answer_ranked(search_corpus(spark, sf_dir), _one(spark)).select("answer")


def query_all_parity(spark, sf_dir):
    return answer_in_turn(search_corpus(spark, sf_dir), prompts(spark, sf_dir))


def _chunks(spark, sf_dir):
    return chunk(markdown_corpus(spark, sf_dir))


def chunk_boundaries(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "start_line", "end_line", "title", F.array_join("heading_path", " > ").alias("headings"), "has_code", F.md5("text").alias("digest"))


def chunk_boundaries_python(spark, sf_dir):
    out = chunk_in_python(markdown_corpus(spark, sf_dir))
    return out.select("doc_id", "start_line", "end_line", "title", F.array_join("heading_path", " > ").alias("headings"), "has_code", F.md5("text").alias("digest"))


def code_blocks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", F.explode("code_blocks").alias("b")).select("path", F.col("b.line").alias("line"), F.col("b.language").alias("language"), F.col("b.code").alias("code"))


def table_rows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", F.explode("table_rows").alias("r")).select("path", F.col("r.line").alias("line"), F.array_join("r.cells", " | ").alias("cells"))


def chunk_search(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return _flat(ranked(bm25_scores(chunks, _one(spark, "alpha tail bold select")), chunks)).select("doc_id", "chunk_id", "score", "rank")


def embedding_texts(spark, sf_dir):
    text = embedding_text(F.col("heading_path"), F.col("text"))
    return search_corpus(spark, sf_dir).select("chunk_id", F.md5(text).alias("digest"))


def doc_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", short_id(F.col("url")).alias("doc_id"))


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("file_hash"))


def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def _own_store(spark) -> IndexStore:
    return IndexStore(spark, scratch(spark), buckets=8)


def docs_list(spark, sf_dir):
    store, files = _own_store(spark), markdown_corpus(spark, sf_dir)
    store.index(files.withColumn("file_hash", F.sha2("content", 256)), INDEXED)
    return store.list().select("doc_id", "path", "num_chunks")


def stored_postings(spark, sf_dir):
    store, files = _own_store(spark), markdown_corpus(spark, sf_dir)
    store.index(files.withColumn("file_hash", F.sha2("content", 256)), INDEXED)
    return store.postings().select("doc_id", "chunk_id", "term", "tf", "df", "length", "num_chunks", F.round("avg_len", 6).alias("avg_len"))


def _versions(spark, sf_dir):
    """The pages as files, and a store that has seen all but every seventh, and every fifth with another content."""
    p = table(spark, sf_dir, "pages").select(short_id(F.col("url")).alias("doc_id"), F.col("url").alias("path"), "page_id", F.coalesce("html", F.lit("")).alias("content"))
    store, hashed = _own_store(spark), F.sha2("content", 256)
    seen = F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    store.index(p.where("page_id % 7 <> 0").withColumn("content", seen).withColumn("file_hash", hashed), INDEXED)
    return p.withColumn("file_hash", hashed), store


def stale_documents(spark, sf_dir):
    files, store = _versions(spark, sf_dir)
    return store.stale(files).select("doc_id", "path")


def load_summary(spark, sf_dir):
    files, store = _versions(spark, sf_dir)
    return files.agg(F.count("*").alias("loaded")).crossJoin(store.stale(files).agg(F.count("*").alias("stale"))).select("loaded", (F.col("loaded") - F.col("stale")).alias("cached"))


def pages_markdown(spark, sf_dir):
    return html_to_markdown(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "markdown")


_ALL = (
    normalize_terms_counts, strip_html_pages, token_estimates, term_frequency, doc_frequency, chunk_length_avg, idf_weights, bm25_rank, bm25_code_boost, multi_query_bm25, cosine_similarity, hybrid_weighted,
    hybrid_rrf, excerpts_budget, query_answer, query_all_ranked, query_all_parity, chunk_boundaries, chunk_boundaries_python, code_blocks, table_rows, chunk_search, embedding_texts, doc_ids, content_hash,
    url_hosts, docs_list, stored_postings, stale_documents, load_summary, pages_markdown,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def _strip(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&[a-zA-Z0-9#]+;', '', 'g')"


def _terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(replace({_strip(f'coalesce({x}, chr(32))')}, 'İ', 'i')), '[a-zA-Z0-9_]+'), lambda t: length(t) >= 2 AND t NOT IN {_STOP})"


_S = f"c AS (SELECT source AS doc_id, doc_id::VARCHAR AS chunk_id, doc_id AS line, doc_id % 4 = 0 AS has_code, lang, text, {_terms('text')} AS terms FROM documents)"
_POSTED = "p AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest(terms) AS term FROM c) GROUP BY ALL)"
_STATS = "f AS (SELECT doc_id, term, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT doc_id, count(*) AS num_chunks, avg(len(terms)) AS avg_len FROM c GROUP BY doc_id)"
_ONE = f"q AS (SELECT 0 AS query_id, unnest({_terms(repr(PROMPT))}) AS term)"
_QUERY = "qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL)"
_SCORE = """s AS (SELECT query_id, p.doc_id, p.chunk_id, any_value(has_code) AS has_code, any_value(line) AS line,
  sum(ln(1e0 + (num_chunks - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / avg_len)) * qf) AS raw
  FROM qf JOIN p USING (term) JOIN f ON f.doc_id = p.doc_id AND f.term = p.term JOIN n ON n.doc_id = p.doc_id JOIN c ON c.doc_id = p.doc_id AND c.chunk_id = p.chunk_id GROUP BY query_id, p.doc_id, p.chunk_id)"""
_BASE = f"WITH {_S}, {_POSTED}, {_STATS}"
_BM25 = f"{_BASE}, {_ONE}, {_QUERY}, {_SCORE}"
_BOOST = "b AS (SELECT query_id, doc_id, chunk_id, line, CASE WHEN has_code THEN raw * 1.2e0 ELSE raw END AS score FROM s)"
_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, line) AS rank FROM b)"
_SIM = """v AS (SELECT c.doc_id, c.chunk_id, line, list_cosine_similarity(z.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
  FROM c JOIN embeddings e ON e.vec_id = line, (SELECT embedding FROM embeddings WHERE vec_id = 0) z)"""
_EXCERPT = "'### ' || c.doc_id || ' › ' || c.lang || chr(10) || 'Source: ' || c.doc_id || '.md#L' || c.line || '-L' || (c.line + 1) || chr(10) || chr(10) || {text} || chr(10)"
_FIT = f"""x AS (SELECT r.doc_id, r.chunk_id, r.rank, r.line, {_EXCERPT.format(text='c.text')} AS whole, c.text, c.lang FROM r JOIN c USING (chunk_id)),
o AS (SELECT *, (octet_length(encode(whole)) + 3) // 4 - 2000 AS over, length(text) AS size FROM x),
k AS (SELECT *, CASE WHEN size - 4 * over < 80 THEN least(80, size) ELSE size - 4 * over END AS cut FROM o),
y AS (SELECT c.doc_id, chunk_id, rank, CASE WHEN rank = 1 AND over > 0 AND cut < size THEN {_EXCERPT.format(text="(substr(c.text, 1, cut) || chr(10) || '…')")} ELSE whole END AS excerpt FROM k c),
t AS (SELECT *, (octet_length(encode(excerpt)) + 3) // 4 AS tokens FROM y),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY rank) AS used FROM t)"""
_SEP = "chr(10) || '--------------------------------' || chr(10) || chr(10)"
_VERSIONS = """w AS (SELECT page_id, sha256(url)[1:16] AS doc_id, url AS path, sha256(html) AS file_hash FROM pages),
k AS (SELECT sha256(url)[1:16] AS doc_id, url AS path, CASE WHEN page_id % 5 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS file_hash FROM pages WHERE page_id % 7 <> 0)"""
_MARKDOWN = r"""m AS (SELECT 'docs/' || source || '-' || (doc_id // 50) || '.md' AS path, '# ' || source || chr(10) || chr(10) || string_agg(
  '## Doc ' || doc_id || ' (' || lang || ')' || chr(10) || chr(10) || coalesce(text, '') || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN E'```sql\nSELECT 1;\n# not a heading\n| not | a row |\n```\n' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN E'| Name | Kind |\n| --- | :--: |\n| alpha | beta |\n' ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN E'\n\n\n\n' ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN E'<b>bold</b> &amp; <i>it</i>&nbsp;&copy;\n' ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN E'### Part\n#### Deep\n\ntail\n' ELSE '' END, '' ORDER BY doc_id) AS content FROM documents GROUP BY source, doc_id // 50),
l AS (SELECT path, generate_subscripts(lines, 1) AS no, unnest(lines) AS line FROM (SELECT path, string_split(content, chr(10)) AS lines FROM m)),
a AS (SELECT path, no, line, regexp_matches(line, '^```[\t\n\f\r ]*$') AS shut, regexp_matches(line, '^```\w*[\t\n\f\r ]*$') AS open,
  length(regexp_extract(line, '^(#{1,6})[\t\n\f\r ]+(.+?)[\t\n\f\r ]*$', 1)) AS level, regexp_extract(line, '^(#{1,6})[\t\n\f\r ]+(.+?)[\t\n\f\r ]*$', 2) AS title,
  regexp_extract(line, '^```(\w*)[\t\n\f\r ]*$', 1) AS language, trim(line, E' \t\r\x0b\x0c') = '' AS blank FROM l)"""
# the state after each line; out is the chunk that the line closed: one before it (heading) or with it (limits)
_STEPS = r"""w AS (
  SELECT path, 0 AS no, 1 AS start, 0 AS n, 0 AS blanks, false AS solid, false AS code, '' AS language, 0 AS opened, string_split(path, '/')[-1] AS title, []::STRUCT(level INT, title VARCHAR)[] AS heads,
    NULL::STRUCT(s INT, e INT, title VARCHAR, heads VARCHAR) AS out, NULL::STRUCT(language VARCHAR, line INT, shut INT) AS block, false AS outside FROM m
  UNION ALL
  SELECT a.path, a.no, CASE WHEN head AND w.n >= 12 THEN a.no WHEN full_ THEN a.no + 1 ELSE w.start END::INT, CASE WHEN head AND w.n >= 12 THEN 1 WHEN full_ THEN 0 ELSE w.n + 1 END,
    CASE WHEN head OR full_ THEN 0 WHEN plain THEN run ELSE w.blanks END, CASE WHEN full_ THEN false WHEN head AND w.n >= 12 THEN true ELSE w.solid OR NOT a.blank END,
    CASE WHEN opens THEN true WHEN w.code AND a.shut THEN false ELSE w.code END, CASE WHEN opens THEN a.language ELSE w.language END, CASE WHEN opens THEN a.no ELSE w.opened END::INT,
    CASE WHEN head THEN a.title ELSE w.title END, CASE WHEN head THEN list_append(list_filter(w.heads, lambda h: h.level < a.level), {'level': a.level::INT, 'title': a.title}) ELSE w.heads END,
    CASE WHEN head AND w.n >= 12 AND w.solid THEN {'s': w.start, 'e': (a.no - 1)::INT, 'title': w.title, 'heads': hs} WHEN full_ AND (w.solid OR NOT a.blank) THEN {'s': w.start, 'e': a.no::INT, 'title': w.title, 'heads': hs} END,
    CASE WHEN w.code AND a.shut THEN {'language': w.language, 'line': w.opened, 'shut': a.no::INT} END, plain
  FROM w JOIN a ON a.path = w.path AND a.no = w.no + 1,
    LATERAL (SELECT NOT w.code AND a.open AS opens, NOT w.code AND NOT a.open AND a.level > 0 AS head, NOT w.code AND NOT a.open AND a.level = 0 AS plain, CASE WHEN a.blank THEN w.blanks + 1 ELSE 0 END AS run,
      array_to_string(list_transform(w.heads, lambda h: h.title), ' > ') AS hs) x,
    LATERAL (SELECT plain AND (w.n + 1 >= 120 OR run >= 4) AS full_) z)"""
_FOUND = f"WITH RECURSIVE {_MARKDOWN}, {_STEPS}"

_CUT = """c AS (SELECT path, out.s AS s, out.e AS e FROM w WHERE out IS NOT NULL
UNION ALL SELECT path, start, no FROM w WHERE n > 0 AND solid AND no = (SELECT max(no) FROM l WHERE l.path = w.path))"""
_TEXTS = f"""b AS (SELECT path, block.shut AS shut FROM w WHERE block IS NOT NULL),
x AS (SELECT sha256(path)[1:16] AS doc_id, s, e, EXISTS (SELECT 1 FROM b WHERE b.path = c.path AND shut BETWEEN s AND e) AS has_code,
  (SELECT string_agg(line, chr(10) ORDER BY no) FROM l WHERE l.path = c.path AND no BETWEEN s AND e) AS text FROM c),
k AS (SELECT doc_id, doc_id || ':' || s || '-' || e AS chunk_id, s, has_code, {_terms('text')} AS terms FROM x)"""
_STATS_OF_CHUNKS = """p AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest(terms) AS term FROM k) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT doc_id, count(*) AS num_chunks, avg(len(terms)) AS avg_len FROM k GROUP BY doc_id)"""

ORACLE: dict[str, str] = {
    "normalize_terms_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_terms('text')}) AS term FROM documents) GROUP BY term",
    "strip_html_pages": f"SELECT page_id, md5(x) AS digest, length(x)::BIGINT AS n FROM (SELECT page_id, {_strip('html')} AS x FROM pages)",
    "token_estimates": "SELECT doc_id, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens FROM documents",
    "term_frequency": f"WITH {_S}, {_POSTED} SELECT doc_id, chunk_id, term, tf FROM p",
    "doc_frequency": f"{_BASE} SELECT doc_id, term, df FROM f",
    "chunk_length_avg": f"{_BASE} SELECT doc_id, num_chunks, round(avg_len, 6) AS avg_len FROM n",
    "idf_weights": f"{_BASE} SELECT doc_id, term, round(ln(1e0 + (num_chunks - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM f JOIN n USING (doc_id)",
    "bm25_rank": f"{_BM25} SELECT doc_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, line)::INT AS rank FROM s WHERE raw > 0",
    "bm25_code_boost": f"{_BM25}, {_BOOST} SELECT doc_id, chunk_id, round(score, 6) AS score FROM b",
    "multi_query_bm25": f"{_BASE}, q AS (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark), {_QUERY}, {_SCORE}, {_BOOST} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score FROM b",
    "cosine_similarity": "SELECT e.vec_id, round(list_cosine_similarity(z.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z",
    "hybrid_weighted": f"""{_BM25}, {_BOOST}, {_SIM}, g AS (SELECT doc_id, chunk_id, score / max(score) OVER (PARTITION BY doc_id) AS share FROM b)
SELECT doc_id, chunk_id, round(CASE WHEN sim IS NULL THEN 0.3e0 * share ELSE 0.3e0 * coalesce(share, 0) + 0.7e0 * (sim + 1) / 2 END, 6) AS score FROM g FULL JOIN v USING (doc_id, chunk_id)
WHERE doc_id IN (SELECT doc_id FROM v)
UNION ALL SELECT doc_id, chunk_id, round(score, 6) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM v)""",
    "hybrid_rrf": f"""{_BM25}, {_BOOST}, {_RANK}, {_SIM}, g AS (SELECT doc_id, chunk_id, rank FROM r WHERE doc_id IN (SELECT doc_id FROM v)
UNION ALL SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, line) FROM v)
SELECT doc_id, chunk_id, round(sum(1e0 / (60 + rank)), 6) AS score FROM g GROUP BY doc_id, chunk_id
UNION ALL SELECT doc_id, chunk_id, round(score, 6) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM v)""",
    "excerpts_budget": f"{_BM25}, {_BOOST}, {_RANK}, {_FIT} SELECT doc_id, chunk_id, rank::BIGINT AS rank, tokens::BIGINT AS tokens, used::BIGINT AS used FROM u WHERE used <= 2000",
    "query_answer": f"{_BM25}, {_BOOST}, {_RANK}, {_FIT} SELECT doc_id, coalesce(string_agg(excerpt, {_SEP} ORDER BY rank) FILTER (used <= 2000), 'Token limit too small to return any excerpt.') AS answer FROM u GROUP BY doc_id",
    "query_all_ranked": f"""{_BM25}, {_BOOST}, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, line) AS rank FROM b),
{_FIT.replace("PARTITION BY doc_id ORDER BY rank", "ORDER BY rank").replace("- 4 * over", "- 4 * over - 4")}
SELECT coalesce(string_agg(excerpt, {_SEP} ORDER BY rank) FILTER (used <= 2000), 'Token limit too small to return any excerpt.') AS answer FROM u""",
    "chunk_boundaries": rf"""{_FOUND}, c AS (SELECT path, out.s AS s, out.e AS e, out.title AS title, out.heads AS heads FROM w WHERE out IS NOT NULL
UNION ALL SELECT path, start, no, title, array_to_string(list_transform(heads, lambda h: h.title), ' > ') FROM w WHERE n > 0 AND solid AND no = (SELECT max(no) FROM l WHERE l.path = w.path)),
b AS (SELECT path, block.shut AS shut FROM w WHERE block IS NOT NULL)
SELECT c.path, s AS start_line, e AS end_line, title, heads AS headings, EXISTS (SELECT 1 FROM b WHERE b.path = c.path AND shut BETWEEN s AND e) AS has_code,
  md5(regexp_replace((SELECT string_agg(line, chr(10) ORDER BY no) FROM l WHERE l.path = c.path AND no BETWEEN s AND e), '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g')) AS digest FROM c""",
    "code_blocks": f"{_FOUND} SELECT w.path, block.line AS line, block.language AS language, (SELECT string_agg(line, chr(10) ORDER BY no) FROM l WHERE l.path = w.path AND l.no > block.line AND l.no < block.shut) AS code FROM w WHERE block IS NOT NULL",
    "table_rows": f"""{_FOUND} SELECT path, no::INT AS line, cells FROM (SELECT w.path, w.no,
  array_to_string(list_filter(list_transform(string_split(trim(l.line), '|'), lambda x: trim(x)), lambda x: NOT regexp_full_match(x, '[-:]*')), ' | ') AS cells
  FROM w JOIN l ON l.path = w.path AND l.no = w.no WHERE outside AND starts_with(trim(l.line), '|')) WHERE cells <> ''""",
    "embedding_texts": "SELECT doc_id::VARCHAR AS chunk_id, md5(source || ' > ' || lang || ': ' || text) AS digest FROM documents",
    "doc_ids": "SELECT page_id, sha256(url)[1:16] AS doc_id FROM pages",
    "content_hash": "SELECT page_id, sha256(html) AS file_hash FROM pages",
    "url_hosts": r"SELECT regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "docs_list": f"{_FOUND}, {_CUT} SELECT sha256(path)[1:16] AS doc_id, path, count(s) AS num_chunks FROM m LEFT JOIN c USING (path) GROUP BY path",
    "stored_postings": f"{_FOUND}, {_CUT}, {_TEXTS}, {_STATS_OF_CHUNKS} SELECT doc_id, chunk_id, term, tf, df, len(terms)::INT AS length, num_chunks, round(avg_len, 6) AS avg_len FROM p JOIN f USING (doc_id, term) JOIN n USING (doc_id) JOIN k USING (doc_id, chunk_id)",
    "chunk_search": f"""{_FOUND}, {_CUT}, {_TEXTS}, {_STATS_OF_CHUNKS}, q AS (SELECT 0 AS query_id, unnest({_terms("'alpha tail bold select'")}) AS term), {_QUERY},
g AS (SELECT doc_id, chunk_id, any_value(s) AS line, any_value(has_code) AS has_code,
  sum(ln(1e0 + (num_chunks - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / avg_len)) * qf) AS raw
  FROM qf JOIN p USING (term) JOIN f USING (doc_id, term) JOIN n USING (doc_id) JOIN k USING (doc_id, chunk_id) GROUP BY doc_id, chunk_id),
h AS (SELECT doc_id, chunk_id, line, CASE WHEN has_code THEN raw * 1.2e0 ELSE raw END AS score FROM g)
SELECT doc_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, line)::INT AS rank FROM h WHERE score > 0""",
    "stale_documents": f"WITH {_VERSIONS} SELECT doc_id, path FROM w ANTI JOIN k USING (doc_id, path, file_hash)",
    "load_summary": f"WITH {_VERSIONS} SELECT count(*) AS loaded, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.doc_id = w.doc_id AND k.path = w.path AND k.file_hash = w.file_hash)) AS cached FROM w",
}
ORACLE["chunk_boundaries_python"] = f"SELECT sha256(path)[1:16] AS doc_id, start_line, end_line, title, headings, has_code, digest FROM ({ORACLE['chunk_boundaries']})"
