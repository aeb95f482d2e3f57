"""DuckDB SQL of the structure queries. It reads the lines' text; the two folds are recursions over numbered lines and clauses."""

from __future__ import annotations

#: Up to (doc_id, n, line, s, page, opens, block, block_id, kind, path) of every line, as in structure.marked_lines.
_LINES = r"""WITH RECURSIVE
li AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY ALL),
pg AS (SELECT l_orderkey AS doc_id, l_linenumber AS p, CASE l_linenumber % 4
  WHEN 1 THEN concat_ws(chr(10), (l_orderkey % 6 + 1) || '. General', (l_orderkey % 6 + 1) || '.2.1. The limits are:', (l_orderkey % 6 + 1) || '.2.1.1. ' || q || ' mm', 'more text')
  WHEN 2 THEN concat_ws(chr(10), '5.2.' || l_linenumber || '. shall not exceed ' || q || ' mm', '| Seat | Load |', '| --- | --- |', '| Driver | ' || q || ' |', 'and so on')
  WHEN 3 THEN concat_ws(chr(10), 'Annex ' || (l_orderkey % 4), '7.6.2. Procedure', 'step', '7.6.3.', 'second step') ELSE 'plain text' END AS text FROM li),
ul AS (SELECT doc_id, p, unnest(list_concat(['<!-- page: ' || p || ' -->'], string_split(text, chr(10)))) AS line, unnest(range(1, 2 + len(string_split(text, chr(10))))) AS pos FROM pg),
ln AS (SELECT doc_id, line, trim(line) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY p, pos) AS n FROM ul),
c0 AS (SELECT *, CAST(nullif(regexp_extract(s, '(?i)^<!--\s*page:\s*(\d+)\s*-->', 1), '') AS INT) AS page, nullif(regexp_extract(s, '(?i)^(annex\s+\d+)$', 1), '') AS annex,
  nullif(regexp_extract(s, '^(\d+(?:\.\d+)*\.?)\s+([A-Z].{3,})$', 1), '') AS head, substr(regexp_extract(s, '^(\d+(?:\.\d+)*\.?)\s+([A-Z].{3,})$', 2), 1, 60) AS head_title,
  nullif(regexp_extract(s, '^(\d+(?:\.\d+)+)\.(?:$|\s+[A-Za-z])', 1), '') AS soft FROM ln),
c AS (SELECT *, CASE WHEN annex IS NULL AND len(string_split(head, '.')) <= 2 THEN rtrim(head, '.') END AS section FROM c0),
e AS (SELECT doc_id, n, CASE WHEN annex IS NOT NULL THEN 'Annex' ELSE section END AS hard, soft, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM c WHERE annex IS NOT NULL OR section IS NOT NULL OR soft IS NOT NULL),
r(doc_id, i, n, id, opened) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 'General', false FROM pg
  UNION ALL SELECT e.doc_id, e.i, e.n, CASE WHEN hard IS NOT NULL THEN hard WHEN go THEN soft ELSE id END, hard IS NULL AND go
  FROM (SELECT e.*, r.id, r.id IN ('General', 'Document') OR starts_with(r.id, 'Annex') OR string_split(soft, '.')[1] <> string_split(r.id, '.')[1]
          OR (len(string_split(soft, '.')) <= len(string_split(r.id, '.')) AND NOT starts_with(soft, r.id)) AS go FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1) e),
o AS (SELECT c.*, CASE WHEN annex IS NOT NULL THEN 'annex' WHEN section IS NOT NULL THEN 'section' WHEN r.opened THEN 'clause' END AS opens FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND r.n = c.n),
m0 AS (SELECT doc_id, n, line, s, page, opens, count(opens) OVER w AS block,
  coalesce(last_value(CASE opens WHEN 'annex' THEN replace(annex, ' ', '_') WHEN 'section' THEN section WHEN 'clause' THEN soft END IGNORE NULLS) OVER w, 'General') AS block_id,
  coalesce(last_value(opens IGNORE NULLS) OVER w, 'section') AS kind, coalesce(last_value(CASE opens WHEN 'annex' THEN annex WHEN 'clause' THEN 'Document' END IGNORE NULLS) OVER w, 'Document') AS base,
  last_value(CASE opens WHEN 'section' THEN head_title END IGNORE NULLS) OVER w AS title FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN kind = 'annex' OR block = 0 THEN base WHEN kind = 'clause' THEN 'Document > §' || block_id ELSE base || ' > §' || block_id || ' ' || title END AS path FROM m0 WHERE opens IS DISTINCT FROM 'annex'),
bl AS (SELECT doc_id, block, block_id, kind, path, min(page) AS first_page, max(page) AS last_page, trim(string_agg(line, chr(10) ORDER BY n)) AS text FROM m GROUP BY ALL HAVING trim(string_agg(line, chr(10) ORDER BY n)) <> '')
"""

BLOCKS = _LINES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS block, block_id, kind, path AS heading_path, first_page, last_page, text FROM bl"

CHUNKS = _LINES + r""",
k0 AS (SELECT *, CASE WHEN kind <> 'clause' THEN nullif(regexp_extract(s, '^(\d+(?:\.\d+)+)\.?(?:$|\s+(.+)$)', 1), '') END AS number, regexp_extract(s, '^(\d+(?:\.\d+)+)\.?(?:$|\s+(.+)$)', 2) AS rest FROM m),
k AS (SELECT *, CASE WHEN kind = 'clause' THEN line WHEN number IS NOT NULL THEN nullif(trim(rest), '') WHEN s <> '' AND NOT starts_with(s, '<!--') THEN line END AS text,
  count(number) OVER w AS cl, last_value(page IGNORE NULLS) OVER w AS page_now FROM k0 WINDOW w AS (PARTITION BY doc_id, block ORDER BY n ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT doc_id, block, block_id, kind, path, cl, CASE WHEN kind = 'clause' THEN block_id ELSE max(number) END AS number, CASE WHEN max(number) IS NOT NULL THEN trim('§' || max(number) || ' ' || max(CASE WHEN number IS NOT NULL THEN substr(rest, 1, 80) END)) ELSE '' END AS title,
  max(page_now) AS page, coalesce(list(text ORDER BY n) FILTER (WHERE text IS NOT NULL), []) AS lines FROM k GROUP BY doc_id, block, block_id, kind, path, cl),
cs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY cl) AS i FROM pt WHERE number IS NOT NULL OR len(lines) > 0),
h(doc_id, block, i, head, number, colon) AS (SELECT DISTINCT doc_id, block, 0::BIGINT, -1::BIGINT, NULL::VARCHAR, false FROM cs
  UNION ALL SELECT doc_id, block, i, CASE WHEN child THEN head ELSE cl END, CASE WHEN child THEN hn ELSE number END, CASE WHEN child THEN true ELSE number IS NOT NULL AND coalesce(ends_with(rtrim(lines[-1]), ':'), false) END
  FROM (SELECT cs.*, h.head, h.number AS hn, h.colon AND coalesce(starts_with(cs.number, h.number || '.') AND len(string_split(cs.number, '.')) = len(string_split(h.number, '.')) + 1, false) AS child
        FROM h JOIN cs ON cs.doc_id = h.doc_id AND cs.block = h.block AND cs.i = h.i + 1)),
bo AS (SELECT cs.doc_id, cs.block, cs.block_id, cs.kind, cs.path, h.head, arg_min(cs.number, cl) AS number, arg_min(cs.title, cl) AS title, max(CASE WHEN cl = h.head THEN cs.page END) AS page,
  flatten(list(CASE WHEN cl <> h.head THEN list_concat([cs.number || '.'], lines) ELSE lines END ORDER BY cl)) AS lines FROM cs JOIN h ON h.doc_id = cs.doc_id AND h.block = cs.block AND h.i = cs.i GROUP BY ALL),
b1 AS (SELECT * EXCLUDE (lines), unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM bo),
b2 AS (SELECT *, regexp_matches(trim(line), '^\|.+\|$') AS pipe, pos - sum(CAST(regexp_matches(trim(line), '^\|.+\|$') AS INT)) OVER (PARTITION BY doc_id, block, head ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM b1),
b3 AS (SELECT *, pipe AND count(*) OVER (PARTITION BY doc_id, block, head, pipe, island) >= 2 AS inside FROM b2),
b4 AS (SELECT *, count(CASE WHEN inside AND NOT coalesce(was, false) THEN 1 END) OVER (PARTITION BY doc_id, block, head ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT *, lag(inside) OVER (PARTITION BY doc_id, block, head ORDER BY pos) AS was FROM b3)),
tx AS (SELECT doc_id, block, block_id, kind, path, head, number, title, page, 0 AS rank, 0 AS nth, trim(coalesce(string_agg(CASE WHEN NOT inside THEN line END, chr(10) ORDER BY pos), '')) AS text FROM b4 GROUP BY doc_id, block, block_id, kind, path, head, number, title, page),
tb AS (SELECT doc_id, block, block_id, kind, path, head, number, title, page, CASE WHEN inside THEN seen ELSE seen + 1 END AS no, trim(coalesce(string_agg(CASE WHEN NOT inside THEN line END, chr(10) ORDER BY pos), '')) AS preamble, string_agg(CASE WHEN inside THEN line END, chr(10) ORDER BY pos) AS markdown,
  arg_min(CASE WHEN inside THEN line END, pos) FILTER (WHERE inside) AS header FROM b4 GROUP BY doc_id, block, block_id, kind, path, head, number, title, page, CASE WHEN inside THEN seen ELSE seen + 1 END),
ch AS (SELECT doc_id, block, block_id, -1 AS head, NULL AS number, first_page AS page, 0 AS rank, 0 AS nth, 'section' AS chunk_type, path AS heading_path, trim(substr(text, 1, 1800)) AS chunk_text FROM bl WHERE kind <> 'clause'
  UNION ALL SELECT doc_id, block, block_id, head, number, page, 0, 0, CASE WHEN number IS NULL THEN 'paragraph' ELSE 'clause' END, CASE WHEN title = '' THEN path ELSE path || ' > ' || title END, text FROM tx WHERE text <> ''
  UNION ALL SELECT doc_id, block, block_id, head, number, page, 1, no, 'table', path || ' > ' || 'Table: ' || array_to_string(list_transform(string_split(trim(header, '|'), '|')[1:4], lambda x: trim(x)), ', '),
    'Table: ' || array_to_string(list_transform(string_split(trim(header, '|'), '|')[1:4], lambda x: trim(x)), ', ') || chr(10) || chr(10) || CASE WHEN preamble = '' THEN '' ELSE preamble || chr(10) || chr(10) END || markdown FROM tb WHERE markdown IS NOT NULL),
ix AS (SELECT ch.*, row_number() OVER (PARTITION BY doc_id ORDER BY block, head, rank, nth) - 1 AS chunk_index FROM ch JOIN (SELECT doc_id, block FROM bl) USING (doc_id, block)),
pa AS (SELECT *, max(CASE WHEN chunk_type = 'section' THEN chunk_index END) OVER (PARTITION BY doc_id, block) AS sec, min(CASE WHEN chunk_type = 'clause' THEN chunk_index END) OVER (PARTITION BY doc_id, block, head) AS cla FROM ix)
SELECT pa.doc_id, chunk_index, CASE chunk_type WHEN 'section' THEN NULL WHEN 'table' THEN coalesce(cla, sec) ELSE sec END AS parent_index, chunk_type, coalesce(number, pa.block_id) AS section, coalesce(pa.page, bl.first_page) AS page_number, heading_path, chunk_text,
  sha256(trim(regexp_replace(lower(chunk_text), '\s+', ' ', 'g'))) AS content_hash FROM pa JOIN bl ON bl.doc_id = pa.doc_id AND bl.block = pa.block"""
