"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from fieldspark.llm import license_scan

OP1_URL_FILTER = r"""
WITH rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT row_number() OVER () AS nth, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT nth, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY nth ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM split JOIN rules ON ((host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (nth)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({nth}, {_quoted(name)}, {_quoted(text)})" for nth, (name, text) in enumerate(license_scan.TEMPLATES))
_PLAIN = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

OP4_LICENSE_SCAN = f"""
WITH templates(nth, license, template) AS (VALUES {_TEMPLATES}),
known AS (
  SELECT nth, license, len(words) - 1 AS size, {_GRAMS.format("words")} AS grams
  FROM (SELECT nth, license, string_split({_PLAIN.format("template")}, ' ') AS words FROM templates)
), segments AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(parts))) AS position, unnest(parts) AS segment
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, kind, position, segment FROM (
    SELECT doc_id, 'paragraph' AS kind, unnest(range(len(parts))) AS position, unnest(parts) AS segment
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents WHERE text IS NOT NULL)
  ) WHERE contains(trim(segment, chr(10) || ' ' || chr(9) || chr(13)), chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM documents WHERE len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) > 1
), plain AS (
  SELECT row_number() OVER () AS id, doc_id, kind, position, string_split({_PLAIN.format("segment")}, ' ') AS words
  FROM segments WHERE {_PLAIN.format("segment")} <> ''
), met AS (
  SELECT plain.id, doc_id, kind, position, nth, license, known.grams AS theirs, {_GRAMS.format("words")} AS mine
  FROM plain CROSS JOIN known WHERE len(words) > 1 AND size > 0
), scored AS (
  SELECT *, 2.0::DOUBLE * len(list_intersect(theirs, mine)) / (len(theirs) + len(mine)) AS dice FROM met
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dice DESC, nth) AS place FROM scored
)
SELECT doc_id, kind, position, license, nth AS template, dice FROM ranked WHERE place = 1 AND dice >= {license_scan.THRESHOLD}
"""

OP12_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^ \t]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS part FROM documents
  )
), placed AS (
  SELECT piece, lang, unnest(words) AS w, unnest(range(len(words))) AS place FROM pieces
), runs AS (
  SELECT lang, w AS w1, lead(w) OVER ahead AS w2, lead(w, 2) OVER ahead AS w3 FROM placed WINDOW ahead AS (PARTITION BY piece ORDER BY place)
), words AS (
  SELECT lang, w1 AS w, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM words GROUP BY lang
), pairs AS (
  SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), triples AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY ALL
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r
  FROM pairs p JOIN words x ON (p.lang = x.lang AND p.w1 = x.w) JOIN words y ON (p.lang = y.lang AND p.w2 = y.w)
  LEFT JOIN longer g ON (p.lang = g.lang AND p.w1 = g.w1 AND p.w2 = g.w2) WHERE g.f IS NULL OR 100 * g.f < 50 * p.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM triples t JOIN words x ON (t.lang = x.lang AND t.w1 = x.w) JOIN pairs y ON (t.lang = y.lang AND t.w2 = y.w1 AND t.w3 = y.w2)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM triples t JOIN pairs x ON (t.lang = x.lang AND t.w1 = x.w1 AND t.w2 = x.w2) JOIN words y ON (t.lang = y.lang AND t.w3 = y.w)
), scored AS (
  SELECT *, ((a::HUGEINT * a * 1000000) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP11_SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)
), priced AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON (a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN priced x ON (x.lang = a.lang AND x.source = a.source)
  LEFT JOIN priced y ON (y.lang = b.lang AND y.source = b.source AND y.term = x.term)
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SUFFIX_DEDUP = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nth, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT nth, id, place, substr(h, 2 * place + 1, 100) AS w FROM (SELECT nth, id, h, unnest(range(length(h) // 2 - 49)) AS place FROM docs)
), gone AS (
  SELECT nth, place FROM (SELECT nth, id, place, min(id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < id
), islands AS (
  SELECT nth, place, sum(opens) OVER (PARTITION BY nth ORDER BY place) AS island FROM (SELECT nth, place, CASE WHEN place - lag(place) OVER (PARTITION BY nth ORDER BY place) <= 50 THEN 0 ELSE 1 END AS opens FROM gone)
), spans AS (
  SELECT nth, min(place) AS start, max(place) + 50 AS stop FROM islands GROUP BY nth, island
), pieces AS (
  SELECT nth, start, stop, coalesce(lag(stop) OVER (PARTITION BY nth ORDER BY start), 0) AS before FROM spans
), cut AS (
  SELECT nth, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last, string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS kept FROM pieces JOIN docs USING (nth) GROUP BY nth
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (nth)
"""
