"""SQL, as DuckDB runs it, for the corpus queries that SQL can express on whole small tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
), s AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r
), g AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY doc_id, span
), l AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM g GROUP BY doc_id
), p AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS until_ FROM g
), q AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * until_ + 1, 2 * (a - until_)), '' ORDER BY a) AS kept, max(b) AS b FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN q.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * b + 1) END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN q USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter({WORDS.replace("coalesce(text, '')", LOWER)}, lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, y FROM r JOIN both_ways ON other = x
), c AS (
  SELECT doc_id, min(other) AS component FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

RECOMPRESSION = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), k AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 50), ' ') AS key FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM k) WHERE first < doc_id
), c AS (
  SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id
), x AS (
  SELECT doc_id, p, w[p + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d)
), t AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), q AS (
  SELECT item, item_id, m, j, array_to_string(list_slice(w, j + 1, j + m), ' ') AS key
  FROM (SELECT item, item_id, w, least(len(w), 13) AS m, unnest(range(len(w) - least(len(w), 13) + 1)) AS j FROM b WHERE len(w) > 0)
), k AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i + 1, i + m), ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM q) WHERE len(w) >= m)
), h AS (
  SELECT doc_id, i, j, k.m AS m, item, item_id FROM k JOIN q ON q.m = k.m AND q.key = k.key
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id
), o AS (
  SELECT doc_id, item, m, i, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run, i - j AS diagonal FROM h
), l AS (
  SELECT doc_id, min(i) AS place, count(*) + max(m) - 1 AS longest FROM o GROUP BY doc_id, item, diagonal, run
), f AS (
  SELECT doc_id, longest, place, row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, place) AS nth FROM l
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(place AS BIGINT) AS longest_at
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT * FROM f WHERE nth = 1) z USING (doc_id)
"""

LINES = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, lines, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS k
  FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS pos FROM l WHERE len(lines) >= 3)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w
), c AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list([pos, pos + 1, pos + 2])))) AS gone FROM r WHERE nth > 1 GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(list_filter(gone, lambda x: NOT list_contains(gone, x - 1))), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(lines, chr(10))
    ELSE coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN c USING (doc_id)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
), o AS (
  SELECT sum(source_size) OVER () AS total, sum(3 * source_size) OVER o AS full_, sum(weight) OVER () - sum(weight) OVER o AS open_ FROM w WINDOW o AS (ORDER BY source_size / weight, number ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max(CAST(total - full_ AS DOUBLE) / open_) AS level FROM (SELECT * FROM o UNION ALL SELECT sum(source_size), 0, sum(weight) FROM w) WHERE open_ > 0
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM w, l
), p AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t
), r AS (
  SELECT doc_id, size, h, p.*, sum(size) OVER (PARTITION BY p.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - 0.5 * size AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND middle < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

INFILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(w[1:least(x, y)], '') AS prefix, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(w[greatest(x, y) + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
