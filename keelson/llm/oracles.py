"""DuckDB SQL of the operators of this subpackage that SQL can express."""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS ks(k)))
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100
), inside AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM frequent WHERE k > 2)
  GROUP BY lang, phrase
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w, c.k, unnest(range(1, c.k)) AS cut
  FROM frequent c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE c.k > 1 AND (i.longer IS NULL OR i.longer < c.f)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, one.f AS l, two.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (one.f::HUGEINT * two.f))::BIGINT AS score
  FROM cuts c
  JOIN frequent one ON one.lang = c.lang AND one.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN frequent two ON two.lang = c.lang AND two.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""

SOURCE_AUDIT = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), occurrences AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), sizes AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang
), used AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(u.n), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.total + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) v
    ON v.lang = g.lang AND v.source = g.source AND v.item = o.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
