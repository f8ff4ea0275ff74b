"""DuckDB SQL of queries whose statement is long."""

from __future__ import annotations


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def _row_hash(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars"])) + f" || {_field(text)})"


# The checksum of a short ASCII string, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(generate_series(1, strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))))"""

# Trees level by level; a path is, for each level, the run that holds the node.
MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('+' || source, '') AS grp, {_row_hash('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 2 = 0 THEN {_row_hash("replace(text, chr(10), '')")} END AS altered
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS rid,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM hashed
),
nodes AS (
  SELECT 0::BIGINT AS level, grp, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, grp, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY level, grp, idx // 3, n
),
heads AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),
upper_nodes AS (
  SELECT 0::BIGINT AS level, idx, n, subroot AS digest FROM heads
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 3, n
),
levels AS (SELECT DISTINCT level, (3 ** level)::BIGINT AS span FROM (SELECT level FROM nodes UNION ALL SELECT level FROM upper_nodes)),
runs AS (
  SELECT l.rid, s.level, s.idx, s.digest, l.idx // v.span AS own
  FROM leaves l JOIN levels v ON TRUE JOIN nodes s ON s.grp = l.grp AND s.level = v.level AND s.n > 1 AND s.idx // 3 = l.idx // v.span // 3
  UNION ALL
  SELECT l.rid, 1000 + s.level, s.idx, s.digest, h.idx // v.span
  FROM leaves l JOIN heads h USING (grp) JOIN levels v ON TRUE JOIN upper_nodes s ON s.level = v.level AND s.n > 1 AND s.idx // 3 = h.idx // v.span // 3
),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS step,
    coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS r
  FROM runs GROUP BY rid, level
),
proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY rid),
folds AS (
  SELECT rid, 0::BIGINT AS step, coalesce(altered, leaf) AS digest FROM leaves
  UNION ALL
  SELECT rid, s.step, sha256(s.l || f.digest || s.r) FROM folds f JOIN steps s USING (rid) WHERE s.step = f.step + 1
),
ends AS (SELECT rid, arg_max(digest, step) AS folded_root FROM folds GROUP BY rid)
SELECT doc_id, leaf, subroot, u.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = u.digest AS verified
FROM leaves JOIN heads USING (grp) JOIN ends USING (rid) LEFT JOIN proofs USING (rid) JOIN upper_nodes u ON u.n = 1
"""

# Phrases of one to five words by position; the lowest cut; phrases inside a longer one of the same count go.
PHRASES = r"""
WITH pieces AS (
  SELECT doc_id, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS t FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents)
),
words AS (SELECT lang, list_filter(string_split(replace(t, chr(9), ' '), ' '), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM grams WHERE f >= 100),
inner_ones AS (
  SELECT DISTINCT lang, array_to_string(w[s : s + m - 1], ' ') AS g, f
  FROM often, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE m < k AND s + m - 1 <= k
),
open_ones AS (
  SELECT o.* FROM often o WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = o.lang AND i.g = o.g AND i.f >= o.f)
),
cuts AS (
  SELECT o.lang, o.g AS phrase, o.f AS a, c AS cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * o.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM open_ones o JOIN (SELECT unnest([1, 2, 3, 4]) AS c) ON c < o.k JOIN totals USING (lang)
  JOIN often l ON l.lang = o.lang AND l.g = array_to_string(o.w[1 : c], ' ') JOIN often r ON r.lang = o.lang AND r.g = array_to_string(o.w[c + 1 : o.k], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000
"""
