"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

#: Lines as sets of words; similar sets meet by their rarest words (ranked by
#: exact counts here), and every pair is verified on the words.
OP10_LINE_JOIN = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, pos, parts[pos] AS line
          FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos FROM docs)),
worded AS (
  SELECT doc_id, pos, toks FROM (
    SELECT doc_id, pos, list_sort(list_distinct(list_filter(
      regexp_split_to_array(lower(line), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS toks FROM lines)
  WHERE len(toks) > 0),
sets AS (SELECT row_number() OVER () AS sid, toks, len(toks) AS n, first
         FROM (SELECT toks, min((doc_id, pos)) AS first FROM worded GROUP BY toks)),
tok AS (SELECT sid, n, unnest(toks) AS w FROM sets),
df AS (SELECT w, count(*) AS df FROM tok GROUP BY w),
prefix AS (
  SELECT sid, n, w FROM (
    SELECT sid, n, tok.w, row_number() OVER (PARTITION BY sid ORDER BY df, tok.w) AS place
    FROM tok JOIN df ON tok.w = df.w)
  WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (
  SELECT DISTINCT a.sid AS x, b.sid AS y FROM prefix a JOIN prefix b
  ON a.w = b.w AND a.sid < b.sid AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
pairs AS (
  SELECT x, y FROM (
    SELECT x, y, a.n AS n, b.n AS m, len(list_intersect(a.toks, b.toks)) AS o
    FROM cand JOIN sets a ON a.sid = x JOIN sets b ON b.sid = y)
  WHERE o >= 0.8 * (n + m - o) - 1e-9),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
other AS (SELECT x AS sid, count(*) AS links, min(s.first) AS earlier FROM links JOIN sets s ON s.sid = y GROUP BY x),
known AS (SELECT s.toks, coalesce(o.links, 0) AS links,
            CASE WHEN o.earlier < s.first THEN o.earlier ELSE s.first END AS least
          FROM sets s LEFT JOIN other o ON s.sid = o.sid),
marked AS (SELECT w.doc_id, k.links, k.least[1] AS first_id,
             CASE WHEN k.least < (w.doc_id, w.pos) THEN 1 ELSE 0 END AS gone
           FROM worded w JOIN known k ON w.toks = k.toks),
each AS (SELECT doc_id, min(first_id) AS class_id, count(*) AS n_lines, sum(gone) AS n_removed, sum(links) AS n_links
         FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(e.class_id, d.doc_id) AS BIGINT) AS class_id,
  CAST(coalesce(e.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(e.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(e.n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id
"""

#: Base counts by counting; the divergences bin by bin.
OP3_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
base AS (
  SELECT k, doc_id, lang, words, len(words) AS n_words, length(t) AS n_chars,
    length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    length(regexp_replace(t, '[^a-z]+', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digit,
    length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS n_stop
  FROM docs),
wins AS (SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
         FROM (SELECT k, words, unnest(generate_series(1, n_words - 2)) AS i FROM base WHERE n_words > 2)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM wins) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT i + s) AS n FROM again, (VALUES (0), (1), (2)) AS o(s) GROUP BY k),
shares AS (
  SELECT k, lang, n_chars, c, CASE c WHEN 0 THEN n_upper WHEN 1 THEN n_digit WHEN 2 THEN n_chars - word_chars
    WHEN 3 THEN n_stop WHEN 4 THEN n_symbols WHEN 5 THEN n_lower
    ELSE n_chars - n_lower - n_upper - n_digit - (n_chars - word_chars) - n_stop - n_symbols END AS n
  FROM base, (VALUES (0), (1), (2), (3), (4), (5), (6)) AS o(c)),
cref AS (SELECT lang, c, sum(n)::DOUBLE / sum(n_chars) AS q FROM shares WHERE lang IS NOT NULL GROUP BY lang, c
         HAVING sum(n_chars) > 0),
cparts AS (SELECT s.k, r.lang, s.n::DOUBLE / s.n_chars AS p, r.q FROM shares s JOIN cref r ON s.c = r.c WHERE s.n_chars > 0),
cdist AS (SELECT k, min(d) AS d FROM (
    SELECT k, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END))) AS d FROM cparts GROUP BY k, lang) GROUP BY k),
lw AS (SELECT k, lang, n_words, lower(unnest(words)) AS w FROM base),
total AS (SELECT lang, sum(n_words) AS n FROM base WHERE lang IS NOT NULL GROUP BY lang),
wref AS (
  SELECT lang, w, q FROM (
    SELECT c.lang, w, c.n::DOUBLE / t.n AS q, row_number() OVER (PARTITION BY c.lang ORDER BY c.n DESC, w) AS nth
    FROM (SELECT lang, w, count(*) AS n FROM lw WHERE lang IS NOT NULL GROUP BY lang, w) c JOIN total t ON c.lang = t.lang)
  WHERE nth <= 24),
wown AS (SELECT k, w, count(*)::DOUBLE / any_value(n_words) AS p FROM lw WHERE w IN (SELECT w FROM wref) GROUP BY k, w),
wbins AS (
  SELECT b.k, r.lang, coalesce(o.p, 0) AS p, r.q FROM base b CROSS JOIN wref r
  LEFT JOIN wown o ON o.k = b.k AND o.w = r.w WHERE b.n_words > 0),
wall AS (SELECT k, lang, p, q FROM wbins UNION ALL
         SELECT k, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM wbins GROUP BY k, lang),
wdist AS (SELECT k, min(d) AS d FROM (
    SELECT k, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END))) AS d FROM wall GROUP BY k, lang) GROUP BY k),
judged AS (
  SELECT b.*, coalesce(v.n, 0) AS n_repeat_words, coalesce(c.d, 0) AS cd, coalesce(w.d, 0) AS wd
  FROM base b LEFT JOIN covered v ON v.k = b.k LEFT JOIN cdist c ON c.k = b.k LEFT JOIN wdist w ON w.k = b.k)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND cd <= 0.28 AND (n_words < 100 OR wd <= 0.35) AS kept
FROM judged
"""

#: Each document against each filter, then each order step by step.
OP12_FILTER_AUDIT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT k, part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN f.first < d.doc_id THEN 'E' ELSE '' END) AS failed
  FROM docs d JOIN firsts f ON d.t = f.t LEFT JOIN said s ON d.doc_id = s.doc_id),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, i AS step, substr(o, i, 1) AS own, substr(o, 1, i - 1) AS earlier
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
marked AS (
  SELECT part, o, step, own, n, good, toxic, contains(failed, own) AS own_fails, failed = own AS only_own,
    len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone
  FROM sets, steps),
audit AS (
  SELECT part, o AS filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT own_fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND own_fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND own_fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN only_own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND own_fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND own_fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit
"""

#: All pairs of a label; components by the smallest id that can be reached.
OP11_EMBED_KMEANS = r"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vecs a JOIN vecs b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links,
  CAST(least(e.vec_id, coalesce(l.y, e.vec_id)) AS BIGINT) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.x LEFT JOIN least l ON e.vec_id = l.x
"""

#: Every window of words, counted as it stands; counts are multiplied as HUGEINT.
OP13_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, w FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(w) > 0),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces),
windows AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM windows GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest
  FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < m),
judged AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
taken AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand t, (SELECT unnest([1, 2]) AS i), cand s
  WHERE t.m = 3 AND s.m = 2 AND s.lang = t.lang AND s.phrase = array_to_string(t.w[i:i + 1], ' ') AND 100 * t.a >= 50 * s.a),
kept AS (SELECT b.* FROM best b ANTI JOIN taken t ON b.lang = t.lang AND b.phrase = t.phrase)
SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM kept k JOIN total t ON k.lang = t.lang
QUALIFY rank <= 2000
"""
