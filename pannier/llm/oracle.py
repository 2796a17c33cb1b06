"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), n AS (
  SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id
), h AS (
  SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM h JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
"""

OP11 = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS rid, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS ahead,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS n0,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents
), crc AS (
  SELECT rid, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM f WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT rid, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM (
    SELECT rid, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
    FROM crc WHERE i < 8 * strlen(s))
), hit AS (
  SELECT rid FROM crc WHERE i = 8 * strlen(s) AND xor(c, 4294967295) % 7 = 0
), leaf AS (
  SELECT f.rid, doc_id, lang, sha256(ahead || n0 || body) AS leaf,
    sha256(ahead || CASE WHEN hit.rid IS NULL THEN n0 ELSE n1 END || body) AS held
  FROM f LEFT JOIN hit USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), tree AS (
  SELECT 0 AS lv, lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lv + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lv, lang, pos // 2, n
), sub AS (
  SELECT lang, lv AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS lv, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY lv, pos // 2, n
), climb AS (
  SELECT rid, lang, 0 AS lv, pos, held AS cur, '' AS seen FROM placed
  UNION ALL
  SELECT c.rid, c.lang, c.lv + 1, c.pos // 2,
    sha256(CASE WHEN t.h IS NULL THEN c.cur WHEN c.pos % 2 = 0 THEN c.cur || t.h ELSE t.h || c.cur END), c.seen || coalesce(t.h, '')
  FROM climb c JOIN sub ON sub.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM c.lang AND t.lv = c.lv AND t.pos = xor(c.pos, 1)
  WHERE c.lv < sub.top
), over AS (
  SELECT c.rid, 0 AS lv, sub.pos, c.cur, c.seen, sub.subroot FROM climb c JOIN sub ON sub.lang IS NOT DISTINCT FROM c.lang AND c.lv = sub.top
  UNION ALL
  SELECT o.rid, o.lv + 1, o.pos // 2,
    sha256(CASE WHEN t.h IS NULL THEN o.cur WHEN o.pos % 2 = 0 THEN o.cur || t.h ELSE t.h || o.cur END), o.seen || coalesce(t.h, ''), o.subroot
  FROM over o LEFT JOIN crown t ON t.lv = o.lv AND t.pos = xor(o.pos, 1)
  WHERE o.lv < (SELECT max(lv) FROM crown)
), top AS (
  SELECT lv, h AS root FROM crown WHERE n = 1
)
SELECT p.doc_id, p.leaf, o.subroot, top.root, sha256(o.seen) AS proof_sha256, o.cur AS folded_root, o.cur = top.root AS verified
FROM placed p JOIN over o USING (rid) JOIN top ON top.lv = o.lv
"""

OP13 = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT doc_id, lang, m, array_to_string(w[i:i+m-1], ' ') AS phrase FROM (
    SELECT doc_id, lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS r(m))
), f AS (
  SELECT lang, m, phrase, count(*) AS f, min(doc_id) AS first_doc FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), c AS (
  SELECT lang, m, phrase, f AS a, first_doc, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), cuts AS (
  SELECT lang, m, phrase, a, first_doc, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k+1:m], ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), scored AS (
  SELECT x.lang, x.phrase, x.a, x.first_doc, x.k, l.f AS l, r.f AS r, total.n,
    CAST((CAST(x.a AS HUGEINT) * total.n * 1000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp
  JOIN total ON total.lang = x.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i+s-1], ' ') AS phrase, a FROM (
    SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c))
), over AS (
  SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY lang, phrase
), held AS (
  SELECT best.* FROM best LEFT JOIN over ON over.lang = best.lang AND over.phrase = best.phrase
  WHERE over.a IS NULL OR 100 * over.a < 100 * best.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM held
)
SELECT lang, rank, phrase, a, l, r, n, score, first_doc FROM ranked WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op3_decontamination": OP3, "op11_merkle_manifest": OP11, "op13_collocations": OP13}
