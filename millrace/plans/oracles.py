"""The queries in SQL, as DuckDB runs it over the same tables."""

from __future__ import annotations

import json

from millrace.config import Settings

_S = Settings()
_PARAMS = {
    "chunking_method": _S.chunking_method, "chunk_size": _S.chunk_size, "overlap_size": _S.overlap_size,
    "semantic_breakpoint_percentile": _S.semantic_breakpoint_percentile, "semantic_buffer_size": _S.semantic_buffer_size,
    "semantic_max_chunk_sentences": _S.semantic_max_chunk_sentences, "token_chunk_size": _S.token_chunk_size,
    "token_chunk_overlap": _S.token_chunk_overlap, "token_encoding": _S.token_encoding, "model": _S.embedding_model,
}
CONFIG = f"substr(md5('{json.dumps(_PARAMS, sort_keys=True)}'), 1, 8)"
QUESTION = "'the nature of that and this'"
SENT = r"SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_matches(s, '\S')) AS s FROM documents"
CLEAN = f"SELECT doc_id, list_transform(s, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS s FROM ({SENT})"
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda t: t <> '')"


def windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, CAST(i / {step} AS BIGINT) AS chunk_id, CAST(i AS BIGINT) AS first_sentence,
  md5(array_to_string(list_slice(s, i + 1, i + {size}), ' ')) AS text_md5
FROM (SELECT doc_id, s, unnest(range(0, len(s), {step})) AS i FROM ({SENT}))"""


def budget(most: int, overlap: int) -> str:
    return f"""WITH RECURSIVE t AS (
  SELECT doc_id, i, s[i + 1] AS sent, greatest(1, floor(len({TOKENS.format("s[i + 1]")}) * 1.33::DOUBLE)::BIGINT) AS n
  FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM ({CLEAN}))
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS size FROM t
), j AS (
  SELECT a.doc_id, a.i, a.size, greatest(a.i + 1, max(b.i + 1)) AS j, a.upto - a.n AS start
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND (b.i = a.i OR b.upto - (a.upto - a.n) <= {most}) GROUP BY a.doc_id, a.i, a.size, a.upto, a.n
), e AS (
  SELECT j.*, c.upto AS stop FROM j JOIN c ON c.doc_id = j.doc_id AND c.i = j.j - 1
), jump AS (
  SELECT e.doc_id, e.i, e.j, e.size, coalesce(min(k.i), e.j) AS following
  FROM e LEFT JOIN c k ON {overlap} > 0 AND k.doc_id = e.doc_id AND k.i > e.i AND k.i < e.j AND e.stop - (k.upto - k.n) <= {overlap} GROUP BY e.doc_id, e.i, e.j, e.size
), walk AS (
  SELECT doc_id, i, j, following, 0 AS chunk_id FROM jump WHERE i = 0
  UNION ALL
  SELECT jump.doc_id, jump.i, jump.j, jump.following, walk.chunk_id + 1 FROM walk JOIN jump ON jump.doc_id = walk.doc_id AND jump.i = walk.following
)
SELECT walk.doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(walk.i AS BIGINT) AS first_sentence, md5(array_to_string(list_slice(s, walk.i + 1, walk.j), ' ')) AS text_md5
FROM walk JOIN ({CLEAN}) x ON x.doc_id = walk.doc_id"""


SEMANTIC = f"""WITH s AS (
  SELECT doc_id, pos, s[pos + 1] AS sentence, array_to_string(list_slice(s, greatest(pos, 1), pos + 2), ' ') AS context
  FROM (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM ({CLEAN}))
), b AS (
  SELECT doc_id, pos, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, pos, unnest({TOKENS.format("context")}) AS tok FROM s) GROUP BY ALL
), l AS (
  SELECT doc_id, pos, sqrt(sum(n * n)) AS len FROM b GROUP BY ALL
), d AS (
  SELECT x.doc_id, x.pos, sum(x.n * y.n) AS dot FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.bucket = y.bucket GROUP BY ALL
), a AS (
  SELECT s.doc_id, s.pos, s.sentence, CASE WHEN m.len IS NOT NULL THEN round(1 - coalesce(dot, 0) / (l.len * m.len), 9) END AS distance
  FROM s JOIN l USING (doc_id, pos) LEFT JOIN l m ON m.doc_id = s.doc_id AND m.pos = s.pos + 1 LEFT JOIN d ON d.doc_id = s.doc_id AND d.pos = s.pos
), q AS (
  SELECT *, coalesce(distance > round(quantile_cont(distance, 0.95) OVER (PARTITION BY doc_id), 9), false) AS breaks FROM a
)
"""

MANIFEST = f"""f AS (
  SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path, sha256(text) AS hash, lang FROM documents
), m AS (
  SELECT path, CASE WHEN lang = 'fr' THEN reverse(hash) ELSE hash END AS hash, CASE WHEN lang = 'es' THEN '00000000' ELSE {CONFIG} END AS config_fingerprint FROM f WHERE lang <> 'de'
  UNION ALL SELECT 'pages/' || page_id || '.html', sha256(html), {CONFIG} FROM pages
), st AS (
  SELECT f.path, f.hash, CASE WHEN m.path IS NULL THEN 'new' WHEN m.hash = f.hash AND m.config_fingerprint = {CONFIG} THEN 'skipped' ELSE 'updated' END AS status
  FROM f LEFT JOIN m USING (path)
)
"""


def knn(asked: str, n: int, distance: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {asked}),
d AS (SELECT query_id, id, round({distance}, 6) + 0.0::DOUBLE AS distance FROM v CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM d)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, distance FROM r WHERE rank < {n}"""


L2 = "list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
COS = "1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))"


def bm25(asked: str, n: int) -> str:
    """Common tables up to ``kw``: query_id, id, score, rank. asked: SQL for query_id, query."""
    return f"""tok AS (SELECT doc_id AS id, unnest({TOKENS.format("text")}) AS term FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS id, len({TOKENS.format("text")}) AS dl FROM documents),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
w AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), cs),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w),
aq AS ({asked}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM aq) GROUP BY ALL),
sc AS (SELECT query_id, p.id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN i USING (term) JOIN p USING (term) JOIN dl ON dl.id = p.id, cs GROUP BY ALL),
al AS (SELECT x.query_id, x.id, round(coalesce(score, 0), 6) AS score FROM (SELECT query_id, doc_id AS id FROM aq CROSS JOIN documents) x LEFT JOIN sc ON sc.query_id = x.query_id AND sc.id = x.id),
kw AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM al) WHERE rank < {n})"""


ONE = f"SELECT 0::BIGINT AS query_id, {QUESTION} AS query"
FUSED = """fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS vr, b.rank AS kr, coalesce(a.distance, 0) AS distance,
  coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM va a FULL JOIN kw b ON a.query_id = b.query_id AND a.id = b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, id) - 1 AS rank FROM fu)
"""
COLLECTIONS = f"""x AS (
  SELECT lang AS collection, 'docs/' || source || '.' || lang || '/' || doc_id || CASE WHEN source = 'src0' THEN '.TXT' WHEN source = 'src1' THEN '' ELSE '.md' END AS path,
    CASE WHEN source = 'src2' THEN '00000000' ELSE {CONFIG} END AS config, doc_id || CASE WHEN source = 'src0' THEN '.TXT' WHEN source = 'src1' THEN '' ELSE '.md' END AS file_name,
    len(range(0, len(s), 35)) AS chunks, source
  FROM documents JOIN ({SENT}) y USING (doc_id)
)
"""

NATIONS = "(SELECT n_nationkey AS k, n_name AS n, r_regionkey AS r, r_name AS rn, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"
REGIONS = "(SELECT r, rn, count(*) AS c FROM {0} GROUP BY ALL)".format(NATIONS)
SOURCE_TEXT = f"SELECT 'docs/' || doc_id || '.txt' AS path, CAST(i - 1 AS BIGINT) AS idx, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM ({SENT}))"
SOURCE_CSV = f"""SELECT 'in/' || r || '.csv' AS path, CAST(i - 1 AS BIGINT) AS idx,
  'key: ' || k || ', name: ' || n || CASE WHEN k % 2 = 0 THEN '' ELSE ', note: odd, indeed' END || '.' AS sentence FROM {NATIONS}"""
SOURCE_MARKDOWN = f"""SELECT 'in/' || r || '.md' AS path, CAST(idx AS BIGINT) AS idx, sentence, section_title FROM (
  SELECT r, 0 AS idx, 'First words.' AS sentence, NULL AS section_title FROM {REGIONS}
  UNION ALL SELECT r, 2 * i - 1, '**' || n || '** is [here](x).', 'Region ' || rn FROM {NATIONS}
  UNION ALL SELECT r, 2 * i, 'Its key is ' || k || '!', 'Region ' || rn FROM {NATIONS}
  UNION ALL SELECT r, 2 * c + 1, 'Last.', 'Region ' || rn FROM {REGIONS})"""
SOURCE_HTML = f"""SELECT 'in/' || r || '.html' AS path, CAST(idx AS BIGINT) AS idx, sentence, section_title FROM (
  SELECT r, 0 AS idx, 'First words.' AS sentence, NULL AS section_title FROM {REGIONS}
  UNION ALL SELECT r, i, n || '  has  key ' || k || '.', 'Region  ' || rn FROM {NATIONS}
  UNION ALL SELECT r, c + 1, 'One.', 'Region  ' || rn FROM {REGIONS}
  UNION ALL SELECT r, c + 2, 'Two.', 'Region  ' || rn FROM {REGIONS}
  UNION ALL SELECT r, c + 3, 'Three & four', 'Region  ' || rn FROM {REGIONS})"""
SIDECARS = """SELECT 'in/' || c_custkey || '.txt' AS path,
  CASE c_custkey % 4 WHEN 0 THEN 'http://default' WHEN 1 THEN 'http://default' WHEN 2 THEN NULL ELSE 'http://x/' || c_custkey END AS source_url,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS fields FROM customer"""
# Visible text of the pages by patterns: what is hidden up to the first end of a hidden element, scripts, comments, tags.
HTML_TEXT = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<head\b.*?</(style|script|head)\s*>', '', 'g'), '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '(?i)</(p|div|li|h[1-6]|tr|br)\s*>', ' ', 'g'), '<[^>]*>', '', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages"""

ORACLES: dict[str, str] = {
    "source_text": SOURCE_TEXT, "source_csv": SOURCE_CSV, "source_markdown": SOURCE_MARKDOWN, "source_html": SOURCE_HTML, "sidecar_urls": SIDECARS,
    "html_text": HTML_TEXT,
    "sentences": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, s[pos + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM ({SENT}))",
    "chunk_sentence_window": windows(40, 5),
    "chunk_sentence_window_small": windows(3, 1),
    "token_estimate": f"SELECT doc_id, greatest(1, CAST(floor(len({TOKENS.format('text')}) * 1.33::DOUBLE) AS BIGINT)) AS tokens FROM documents",
    "chunk_token_budget": budget(512, 50),
    "chunk_token_budget_no_overlap": budget(64, 0),
    "context_window": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, array_to_string(list_slice(s, greatest(pos, 1), pos + 2), ' ') AS context FROM (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM ({CLEAN}))",
    "consecutive_distance": "WITH x AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT label, vec_id, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0::DOUBLE AS distance FROM x",
    "semantic_breakpoints": SEMANTIC + "SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(distance, 6) + 0.0::DOUBLE AS distance, breaks FROM q",
    "chunk_semantic": SEMANTIC + """, g AS (
  SELECT doc_id, pos, sentence, coalesce(sum(breaks::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM q
) SELECT doc_id, CAST(seg AS BIGINT) AS chunk_id, CAST(min(pos) AS BIGINT) AS first_sentence, count(*) AS n_sentences, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text_md5 FROM g GROUP BY doc_id, seg""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "config_fingerprint": f"SELECT {CONFIG} AS fingerprint",
    "reindex_status": f"WITH {MANIFEST} SELECT path, status FROM st",
    "stale_files": f"WITH {MANIFEST} SELECT path FROM m WHERE path NOT IN (SELECT path FROM f)",
    "upsert_result": f"WITH {MANIFEST} SELECT path, hash, config_fingerprint FROM m WHERE path IN (SELECT path FROM st WHERE status = 'skipped') UNION ALL SELECT path, hash, {CONFIG} FROM st WHERE status <> 'skipped'",
    "run_summary": f"WITH {MANIFEST} SELECT status, count(*) AS files FROM st GROUP BY status UNION ALL SELECT 'removed', count(*) FROM m WHERE path NOT IN (SELECT path FROM f)",
    "knn_l2": knn("vec_id = (SELECT min(vec_id) FROM embeddings)", 10, L2),
    "knn_batch": knn("vec_id % 20 = 0", 5, L2),
    "knn_cosine": knn("vec_id % 20 = 0", 5, COS),
    "bm25_topk": f"WITH {bm25(ONE, 15)} SELECT CAST(rank AS BIGINT) AS rank, id, score FROM kw",
    "benchmark_retrieval": f"WITH {bm25('SELECT item_id AS query_id, text AS query FROM benchmark', 5)} SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM kw",
    "rrf_fusion": f"WITH va AS ({knn('vec_id % 20 = 0', 15, L2)}), kw AS ({knn('vec_id % 20 = 0', 15, '1 - list_dot_product(v.e, list_reverse(q.e))')}), {FUSED} SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score, distance FROM rk WHERE rank < 5",
    "hybrid_search": f"""WITH {bm25(ONE, 15)}, bk AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf)::DOUBLE AS n FROM p GROUP BY ALL),
qb AS (SELECT ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(times)::DOUBLE AS n FROM qt GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(n * n)) AS len FROM bk GROUP BY id), dd AS (SELECT bk.id, sum(bk.n * qb.n) AS dot FROM bk JOIN qb USING (b) GROUP BY bk.id),
vd AS (SELECT dl.id, round(CASE WHEN len IS NULL THEN 1 ELSE 2 - 2 * coalesce(dot, 0) / (len * (SELECT sqrt(sum(n * n)) FROM qb)) END, 6) AS distance FROM dl LEFT JOIN dn USING (id) LEFT JOIN dd USING (id)),
va AS (SELECT * FROM (SELECT 0::BIGINT AS query_id, id, distance, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM vd) WHERE rank < 15), {FUSED}
SELECT CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score, distance FROM rk WHERE rank < 5""",
    "format_prompt": f"""WITH {bm25(ONE, 5)} SELECT 0::BIGINT AS query_id, 'Answer the question from the data below. If the data does not answer it, say so.' || chr(10) || chr(10) || 'Data:' || chr(10) ||
  string_agg('Document ' || (rank + 1) || ':' || chr(10) || 'File: ' || source || chr(10) || 'Chunk ID: ' || doc_id || chr(10) || 'Section: ' || lang || chr(10) || 'Content: ' || text || chr(10) || repeat('-', 80) || chr(10), '' ORDER BY rank)
  || chr(10) || chr(10) || 'Question: ' || {QUESTION} AS prompt FROM kw JOIN documents ON doc_id = id""",
    "table_as_text": """WITH r AS (SELECT n_regionkey, '| ' || n_name || ' | ' || n_nationkey || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey, string_agg(CASE WHEN k = 1 AND n > 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY k) AS text FROM (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS n FROM r) GROUP BY n_regionkey""",
    "row_prose": "SELECT c_custkey, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_acctbal: ' || c_acctbal || ', c_mktsegment: ' || c_mktsegment || '.' AS prose FROM customer",
    "collection_list": f"WITH {COLLECTIONS} SELECT collection, CAST(sum(chunks) AS BIGINT) AS chunks, count(*) AS files, '2024-01-02 03:04:05' AS last_indexed, CASE WHEN count(DISTINCT config) = 1 THEN min(config) ELSE count(DISTINCT config) || ' mixed' END AS fingerprint, collection = 'en' AS active FROM x GROUP BY collection",
    "collection_stats": f"WITH {COLLECTIONS} SELECT CAST(sum(chunks) AS BIGINT) AS chunks, count(*) AS files, round(avg(chunks), 6) AS avg_chunks, min(chunks) AS min_chunks, max(chunks) AS max_chunks, CAST(sum(chunks) AS BIGINT) AS listed_chunks, CASE WHEN count(DISTINCT config) = 1 THEN min(config) ELSE count(DISTINCT config) || ' distinct (re-index needed)' END AS fingerprint FROM x",
    "ext_counts": f"WITH {COLLECTIONS} SELECT CASE WHEN source = 'src0' THEN '.txt' WHEN source = 'src1' THEN '(no ext)' ELSE '.md' END AS ext, count(*) AS files FROM x GROUP BY ALL",
    "metadata_keys": f"WITH {COLLECTIONS} SELECT unnest(['file_name', 'chunk_id']) AS key UNION ALL SELECT 'section_title' WHERE (SELECT max(chunks) FROM x) > 1",
    "collection_inspect": f"WITH {COLLECTIONS} SELECT file_name, path, CAST(chunks AS BIGINT) AS chunks, '2024-01-02 03:04:05' AS indexed_at FROM x WHERE contains(file_name, '7')",
    "chat_log_summary": "SELECT conv_id, turn, role, substr(text, 1, 50) AS summary FROM conversations",
}
ORACLES["keyword_index_topk"], ORACLES["keyword_index_benchmark"] = ORACLES["bm25_topk"], ORACLES["benchmark_retrieval"]
ORACLES["knn_cells"] = ORACLES["knn_batch"]
ORACLES["store_state"] = """SELECT 'first' AS version, printf('%012d', doc_id) AS id, md5(coalesce(text, '')) AS document_md5 FROM documents
UNION ALL SELECT 'last', printf('%012d', doc_id), md5(coalesce(CASE WHEN lang = 'fr' THEN reverse(text) ELSE text END, '')) FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id % 10 <> 3
UNION ALL SELECT 'last', 'page-' || page_id, md5(coalesce(html, '')) FROM pages"""
_FILES = """SELECT doc_id // 50 AS doc_id, string_agg(CASE WHEN doc_id // 50 % 3 = 0 THEN 'Changed. ' ELSE '' END || coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text
FROM documents WHERE doc_id // 50 % 5 <> 1 GROUP BY doc_id // 50"""
ORACLES["refresh_files"] = f"""WITH w AS ({windows(40, 5).replace("FROM documents", f"FROM ({_FILES})")})
SELECT doc_id AS grp, chunk_id, text_md5 AS document_md5, count(*) OVER (PARTITION BY doc_id) AS n_chunks, CAST(64 AS BIGINT) AS dim FROM w"""
ORACLES["cached_embeddings"] = """SELECT sha256(coalesce(text, '')) AS key, CAST(CASE WHEN coalesce(bool_or(lang <> 'de'), false) THEN 1 ELSE 2 END AS BIGINT) AS run,
  count(*) AS documents, CAST(64 AS BIGINT) AS dim FROM documents GROUP BY 1"""


def _bare(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', ''))"


def _kind(x: str) -> str:
    word = rf"regexp_replace({_bare(x)}, '\.$', '')"
    return rf"CASE WHEN regexp_matches({word}, '^[\p{{N}}.,]+$') THEN '##' ELSE {word} END"


def _share(k: str, n: str, p: str) -> str:
    return f"((CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END) + (CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(1 - ({p})) END))"


_RATIO = f"""-2 * ({_share("c12", "c1", "c2 / words")} + {_share("(c2 - c12)", "(words - c1)", "c2 / words")} - {_share("c12", "c1", "c12 / c1")} - {_share("(c2 - c12)", "(words - c1)", "(c2 - c12) / (words - c1)")})"""
_SENTENCE_MODEL = rf"""x AS (
  SELECT coalesce(lang, '') AS lang, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS w FROM documents
), t AS (
  SELECT lang, {_kind("w[i]")} AS type, ends_with({_bare("w[i]")}, '.') AS dot, nullif(regexp_extract(w[i], '([.!?])[^\p{{L}}\p{{N}}.!?]*$', 1), '') AS mark, CASE WHEN i < len(w) THEN {_kind("w[i + 1]")} END AS after_
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM x)
), o AS (
  SELECT * FROM t WHERE type <> ''
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang)::DOUBLE AS words, sum(dots) OVER (PARTITION BY lang)::DOUBLE AS periods FROM (SELECT lang, type, count(*)::DOUBLE AS n, count(*) FILTER (dot)::DOUBLE AS dots FROM o GROUP BY ALL)
), a AS (
  SELECT lang, type, -2 * ({_share("dots", "n", "periods / words")} - {_share("dots", "n", "0.99::DOUBLE")}) * exp(-len(replace(type, '.', ''))) * (len(type) - len(replace(type, '.', '')) + 1) * pow(len(replace(type, '.', '')), dots - n) AS score
  FROM c WHERE dots > 0 AND type <> '##' AND regexp_matches(type, '\p{{L}}')
), s AS (
  SELECT * FROM a WHERE score >= 0.3
), p AS (
  SELECT o.lang, mark, o.type, after_, count(*)::DOUBLE AS n, any_value(s.type IS NOT NULL OR len(o.type) = 1 OR o.type = '##') AS loose FROM o LEFT JOIN s ON s.lang = o.lang AND s.type = o.type WHERE mark IS NOT NULL AND after_ <> '' GROUP BY ALL
), e AS (
  SELECT lang, after_, sum(n)::DOUBLE AS c12 FROM p WHERE mark <> '.' OR NOT loose GROUP BY ALL
), m AS (
  SELECT e.lang, after_ AS term, c12, sum(c12) OVER (PARTITION BY e.lang)::DOUBLE AS c1, c.n AS c2, words FROM e JOIN c ON c.lang = e.lang AND c.type = after_
), k AS (
  SELECT p.lang, p.type AS term, after_ AS other, sum(p.n)::DOUBLE AS c12, any_value(b.n) AS c1, any_value(c.n) AS c2, any_value(c.words) AS words
  FROM p JOIN c b ON b.lang = p.lang AND b.type = p.type JOIN c ON c.lang = p.lang AND c.type = after_ WHERE mark = '.' AND loose GROUP BY p.lang, p.type, after_
), r AS (
  SELECT lang, 'abbreviation' AS kind, type AS term, NULL::VARCHAR AS other, score FROM s
  UNION ALL SELECT * FROM (SELECT lang, 'starter', term, NULL::VARCHAR, {_RATIO} AS score FROM m WHERE c12 * words > c1 * c2 AND regexp_matches(term, '^\p{{L}}')) WHERE score >= 30
  UNION ALL SELECT * FROM (SELECT lang, 'collocation', term, other, {_RATIO} AS score FROM k WHERE c12 > 1 AND c12 * words > c1 * c2) WHERE score >= 7.88
)
"""
ORACLES["sentence_model"] = f"WITH {_SENTENCE_MODEL} SELECT lang, kind, term, other, round(score, 6) AS score FROM r"
ORACLES["learnt_sentences"] = rf"""WITH {_SENTENCE_MODEL}, y AS (
  SELECT doc_id, coalesce(lang, '') AS lang, i, z[i] AS piece, z[i - 1] AS before
  FROM (SELECT doc_id, lang, z, unnest(range(1, len(z) + 1)) AS i FROM (SELECT doc_id, lang, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(31) || '\2', 'g'), chr(31)) AS z FROM documents))
), f AS (
  SELECT *, {_bare("last_")} AS b, {_kind("last_")} AS type, {_kind("word")} AS first_, regexp_matches(word, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') AS upper_, regexp_matches(word, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') AS lower_
  FROM (SELECT *, regexp_extract(before, '(\S+)$', 1) AS last_, regexp_extract(piece, '^\s*(\S+)', 1) AS word FROM y)
), h AS (
  SELECT f.*, NOT coalesce(ends_with(b, '.'), false) OR NOT CASE WHEN l.term IS NOT NULL THEN true WHEN v.term IS NOT NULL OR regexp_matches(f.type, '^\p{{L}}$') THEN NOT (upper_ AND u.term IS NOT NULL) WHEN f.type = '##' THEN lower_ ELSE false END AS begins
  FROM f LEFT JOIN r l ON l.kind = 'collocation' AND l.lang = f.lang AND l.term = f.type AND l.other = first_
  LEFT JOIN r v ON v.kind = 'abbreviation' AND v.lang = f.lang AND v.term = f.type LEFT JOIN r u ON u.kind = 'starter' AND u.lang = f.lang AND u.term = first_
), g AS (
  SELECT doc_id, n, regexp_replace(string_agg(piece, '' ORDER BY i), '^\s+', '') AS sentence
  FROM (SELECT doc_id, i, piece, sum(CASE WHEN i = 1 OR begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h) GROUP BY doc_id, n
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, sentence FROM g WHERE regexp_matches(sentence, '\S')"""
