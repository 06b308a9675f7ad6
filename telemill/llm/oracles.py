"""The results of the queries as DuckDB SQL, for those that SQL can express.

Fingerprints hashed with XXH64, trees, networks, sampled segmentations and aligned
lines have none; tests hold those against plain Python. Distances are summed up component by
component, as doubles depend on the order.
"""

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op5_mix_sources"] = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * 1.0 / ((SELECT count(*) FROM sizes)::DOUBLE * n) AS rate FROM sizes
),
parts AS (SELECT source, greatest(ceil(rate / 64.0), 1)::INT AS draws, rate / greatest(ceil(rate / 64.0), 1) AS mean FROM rates),
cdf AS (
  SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM cdf
  WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 40)
),
draws AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') AS id, unnest(range(1, draws + 1)) AS d
  FROM documents JOIN parts USING (source)
),
numbers AS (
  SELECT *, ('0x' || substr(md5('mix:' || id || ':' || d), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM draws
),
copies AS (
  SELECT doc_id, n.source, id, count(*) AS copies FROM numbers n JOIN cdf c ON n.source = c.source AND c.c < n.u GROUP BY ALL
),
rows AS (SELECT doc_id, source, id, unnest(range(copies)) AS copy FROM copies)
SELECT doc_id, source, copy, md5('mix-order:' || id || ':' || copy) AS shuffle_key FROM rows
"""

ORACLES["op6_warc_audit"] = """
WITH fates AS (SELECT page_id, substr(sha256(page_id::VARCHAR), 1, 2) AS fate FROM pages)
SELECT 'pages-' || (page_id // 256) || '-0' AS file, page_id % 256 AS slot,
  CASE fate WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'extra' END AS kind
FROM fates WHERE fate IN ('00', '01', '02')
"""

ORACLES["op7_nearest_neighbours"] = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
      list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_LOST = r"""
  (regexp_matches(l, '[|»›•·]') AND length(l) - length(regexp_replace(l, '[|»›•·]', '', 'g')) >= 2
    AND (length(l) - length(regexp_replace(l, '[|»›•·]', '', 'g'))) * 4 >= words)
  OR (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) * 10 > length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))
  OR (NOT regexp_matches(l, '\p{Ll}') AND regexp_matches(l, '\p{Lu}') AND words >= 3)
  OR (length(l) <= 200 AND regexp_matches(l, '(?i)(?:all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|javascript is disabled|lorem ipsum|click here|read more|sign up|log in|subscribe now)'))
  OR (words < 3 AND NOT regexp_matches(l, '[.!?:;…。！？"''”’»)\]][\x20\x09-\x0D]*$'))
"""

ORACLES["op8_quality_rules"] = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
windows AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
often AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN often USING (doc_id, win)) GROUP BY doc_id
),
per_line AS (
  SELECT doc_id, l, len({_WORDS.format("l")}) AS words FROM (SELECT doc_id, unnest(lines) AS l FROM docs)
),
left_over AS (SELECT doc_id, sum(words)::BIGINT AS n FROM per_line WHERE NOT ({_LOST}) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n, 0)::BIGINT AS n_kept_words
  FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN left_over k USING (doc_id)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * (n_words - n_kept_words) <= 50 * n_words AS kept FROM judged
"""

ORACLES["op10_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (win) WHERE first < doc_id
),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

ORACLES["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor, r.vec_id AS other, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
  SELECT anchor, other AS positive, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.positive AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.other)::INT AS rank
FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLES["op13_collocations"] = r"""
WITH lines AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM lines),
runs AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, 6) AS sizes(size))
),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2),
inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM candidates, range(2, 5) AS lengths(m) WHERE m < size)
),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.longer >= 100 * c.a)
),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
),
scored AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, k,
    ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = lp JOIN counts r ON r.lang = c.lang AND r.phrase = rp
    JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
