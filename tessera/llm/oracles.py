"""SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

VECTORS = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
"""

ORACLES: dict[str, str] = {
    "op1_vector_approximation": VECTORS
    + """
, scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op2_pivot_permutations": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT vec_id AS start, vec_id AS node FROM usable
  UNION
  SELECT r.start, l.b FROM reached r JOIN links l ON l.a = r.node
), smallest AS (SELECT start, min(node) AS component_id FROM reached GROUP BY start
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN smallest ON e.vec_id = start LEFT JOIN counts ON e.vec_id = a
""",
    "op3_chat_collapse": """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), lists AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST) AS said
  FROM turns GROUP BY conv_id
), kept AS (
  SELECT a.conv_id FROM lists a
  WHERE NOT EXISTS (
    SELECT 1 FROM lists b
    WHERE (len(b.said) > len(a.said) AND list_slice(b.said, 1, len(a.said)) = a.said)
       OR (b.said = a.said AND b.conv_id < a.conv_id))
), numbered AS (
  SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) - 1 AS n
  FROM turns t JOIN kept USING (conv_id)
)
SELECT conv_id, CAST(n // 256 AS INTEGER) AS part, count(*) AS turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY n) AS text
FROM numbered GROUP BY conv_id, n // 256
""",
    "op4_source_schedule": rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 2.0::DOUBLE * source_size AS cap FROM sums
), weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(place % 3 + 1 AS INTEGER)] AS weight FROM placed
), rates AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed
), common AS (SELECT arg_min(rate, [cap / weight, place]) AS rate FROM rates WHERE rate * weight <= cap
), targets AS (
  SELECT r.source, r.place, r.source_size,
         CASE WHEN r.rate * r.weight <= r.cap OR r.cap / r.weight >= c.rate THEN c.rate * r.weight ELSE r.cap END AS target
  FROM rates r LEFT JOIN common c ON true
), block AS (SELECT greatest(1, CAST(ceil(1.5 * sum(source_size) / 1048576) AS BIGINT)) AS words, sum(target) AS total FROM targets
), ranges AS (
  SELECT place, sum(target) OVER (ORDER BY place) - target AS low, sum(target) OVER (ORDER BY place) AS high FROM targets
), points AS (
  SELECT i, (i % 2147483648) * 1327217885 % 2147483648 / 2147483648.0::DOUBLE AS p FROM range(1048576) t(i), block
  WHERE i < ceil(total / words)
), taken AS (
  SELECT place, count(*) AS n FROM points, block, ranges
  WHERE p >= low / total AND (p < high / total OR high >= total) GROUP BY place
), lined AS (
  SELECT doc_id, size, source_size, target, place,
         sum(size) OVER (PARTITION BY place ORDER BY h, doc_id) - size AS begin_
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), blocks AS (
  SELECT l.*, words, least(coalesce(n, 0), 2 * ((source_size + words - 1) // words)) AS slots,
         greatest(1, (source_size + words - 1) // words) AS per_pass
  FROM lined l LEFT JOIN taken USING (place), block
)
SELECT doc_id, size, source_size, target,
       CAST((slots // per_pass) * size + greatest(0, least(begin_ + size, (slots % per_pass) * words) - begin_) AS BIGINT) AS taken
FROM blocks
""",
    "op8_host_reputation": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule, name, tail, says) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM split JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, tail) GROUP BY page_id
), ruled AS (SELECT s.*, f.rule, f.says FROM split s LEFT JOIN fits f USING (page_id)
), members AS (
  SELECT host, CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
         string_split(host, '.')[-1] AS suffix,
         CAST(count(says) AS DOUBLE) AS n, CAST(count(*) FILTER (says = 'allow') AS DOUBLE) AS x FROM ruled GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM members GROUP BY domain, suffix
), suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix
), s0 AS (SELECT *, (SELECT CASE WHEN sum(n) > 0 THEN sum(x) / sum(n) ELSE 0.5 END FROM suffixes) AS prior FROM suffixes
), k0 AS (
  SELECT greatest(0.001, least(0.999, CASE WHEN sum((n - 1) * prior * (1 - prior)) FILTER (n > 0) > 0
    THEN (sum(n * (x / n - prior) ** 2) FILTER (n > 0) - sum(prior * (1 - prior)) FILTER (n > 0)) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0)
    ELSE 0 END)) AS share FROM s0
), s1 AS (SELECT suffix, (prior * (1 - share) / share + x) / ((1 - share) / share + n) AS mean FROM s0, k0
), d0 AS (SELECT d.*, mean AS prior FROM domains d JOIN s1 USING (suffix)
), k1 AS (
  SELECT greatest(0.001, least(0.999, CASE WHEN sum((n - 1) * prior * (1 - prior)) FILTER (n > 0) > 0
    THEN (sum(n * (x / n - prior) ** 2) FILTER (n > 0) - sum(prior * (1 - prior)) FILTER (n > 0)) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0)
    ELSE 0 END)) AS share FROM d0
), d1 AS (SELECT domain, suffix, (prior * (1 - share) / share + x) / ((1 - share) / share + n) AS mean FROM d0, k1
), h0 AS (SELECT m.*, mean AS prior FROM members m JOIN d1 USING (domain, suffix)
), k2 AS (
  SELECT greatest(0.001, least(0.999, CASE WHEN sum((n - 1) * prior * (1 - prior)) FILTER (n > 0) > 0
    THEN (sum(n * (x / n - prior) ** 2) FILTER (n > 0) - sum(prior * (1 - prior)) FILTER (n > 0)) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0)
    ELSE 0 END)) AS share FROM h0
), h1 AS (
  SELECT host, (1 - share) / share + n AS weight, (prior * (1 - share) / share + x) / ((1 - share) / share + n) AS mean FROM h0, k2
)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN h1 USING (host)
""",
    "op9_stupid_backoff": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), own1 AS (
  SELECT r, word, count(*) AS n FROM placed GROUP BY r, word UNION ALL SELECT r, '', 1 FROM docs WHERE len(w) > 0
), all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY word
), left1 AS (SELECT r, word, greatest(a.n - o.n, 0) AS n FROM own1 o JOIN all1 a USING (word)
), totals AS (SELECT r, greatest(1, (SELECT count(*) FROM placed) - len(w)) AS total FROM docs
), runs AS (SELECT r, lag(word, 1, '') OVER (PARTITION BY r ORDER BY i) AS a, word AS b FROM placed
), own2 AS (SELECT r, a, b, count(*) AS tf FROM runs GROUP BY ALL
), all2 AS (SELECT a, b, sum(tf) AS n FROM own2 GROUP BY a, b
), scored AS (
  SELECT o.r, tf, CASE WHEN s.n > tf THEN log10((s.n - tf) / x.n) ELSE log10(0.4::DOUBLE) + log10(greatest(y.n, 1) / total) END AS score
  FROM own2 o JOIN all2 s USING (a, b) JOIN left1 x ON x.r = o.r AND x.word = o.a
       JOIN left1 y ON y.r = o.r AND y.word = o.b JOIN totals t ON t.r = o.r
), sums AS (SELECT r, CAST(sum(tf) AS BIGINT) AS words, sum(tf * score) / sum(tf) AS score FROM scored GROUP BY r)
SELECT doc_id, coalesce(words, 0) AS words, round(score, 6) AS score FROM docs LEFT JOIN sums USING (r)
""",
    "op9_whole_backoff": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), counts AS (
  SELECT word, count(*) AS n FROM placed GROUP BY word UNION ALL SELECT '', count(*) FROM docs WHERE len(w) > 0
), pairs AS (SELECT r, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), '') AS a, word AS b FROM placed
), seen AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b
), model AS (
  SELECT s.a, s.b, CASE WHEN s.n >= 2 THEN log10(s.n / ca.n) ELSE log10(0.4::DOUBLE * cb.n / (SELECT count(*) FROM placed)) END AS score
  FROM seen s JOIN counts ca ON ca.word = s.a JOIN counts cb ON cb.word = s.b
), sums AS (SELECT r, count(*) AS words, sum(score) / count(*) AS score FROM pairs JOIN model USING (a, b) GROUP BY r)
SELECT doc_id, coalesce(words, 0) AS words, round(score, 6) AS score FROM docs LEFT JOIN sums USING (r)
""",
    "op9_trigram_backoff": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), own1 AS (
  SELECT r, word, count(*) AS n FROM placed GROUP BY r, word UNION ALL SELECT r, '', 1 FROM docs WHERE len(w) > 0
), all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY word
), left1 AS (SELECT r, word, greatest(a.n - o.n, 0) AS n FROM own1 o JOIN all1 a USING (word)
), totals AS (SELECT r, greatest(1, (SELECT count(*) FROM placed) - len(w)) AS total FROM docs
), runs AS (
  SELECT r, lag(word, 2, '') OVER (PARTITION BY r ORDER BY i) AS a, lag(word, 1, '') OVER (PARTITION BY r ORDER BY i) AS b, word AS c FROM placed
), own2 AS (
  SELECT r, b AS a, c AS b, count(*) AS tf FROM runs GROUP BY ALL UNION ALL SELECT r, '', '', 1 FROM docs WHERE len(w) > 0
), all2 AS (SELECT a, b, sum(tf) AS n FROM own2 GROUP BY a, b
), left2 AS (SELECT r, a, b, s.n - tf AS n FROM own2 JOIN all2 s USING (a, b)
), own3 AS (SELECT r, a, b, c, count(*) AS tf FROM runs GROUP BY ALL
), all3 AS (SELECT a, b, c, sum(tf) AS n FROM own3 GROUP BY a, b, c
), scored AS (
  SELECT o.r, tf, CASE WHEN s.n > tf THEN log10((s.n - tf) / p.n)
                       WHEN q.n > 0 THEN log10(0.4::DOUBLE) + log10(q.n / x.n)
                       ELSE 2 * log10(0.4::DOUBLE) + log10(greatest(y.n, 1) / total) END AS score
  FROM own3 o JOIN all3 s USING (a, b, c) JOIN left2 p ON p.r = o.r AND p.a = o.a AND p.b = o.b
       JOIN left2 q ON q.r = o.r AND q.a = o.b AND q.b = o.c JOIN left1 x ON x.r = o.r AND x.word = o.b
       JOIN left1 y ON y.r = o.r AND y.word = o.c JOIN totals t ON t.r = o.r
), sums AS (SELECT r, CAST(sum(tf) AS BIGINT) AS words, sum(tf * score) / sum(tf) AS score FROM scored GROUP BY r)
SELECT doc_id, coalesce(words, 0) AS words, round(score, 6) AS score FROM docs LEFT JOIN sums USING (r)
""",
    "op11_grammar_runs": rf"""
WITH checked AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS said,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(CAST(doc_id AS VARCHAR))),
           lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS h
  FROM documents
), sized AS (SELECT *, len(said) AS n, h // 10 AS g FROM checked
), planted AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized
), docs AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted
), words AS (
  SELECT doc_id, n, i, said[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM docs, LATERAL (SELECT unnest(range(n)) AS i)
), equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, first([start, length, period] ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text
  FROM words w LEFT JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i WHERE d.i IS NULL GROUP BY w.doc_id
)
SELECT docs.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
       1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
