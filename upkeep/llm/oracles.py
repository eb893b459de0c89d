"""DuckDB SQL for the queries of this package that SQL can express.

Each statement restates its query by brute force: windows and pairs of whole
words instead of hashes, and all pairs of documents that share a shingle
instead of candidates.
"""

from __future__ import annotations

from upkeep.llm import permuterm, quality, rotation_codes, secret_scan

_WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), gram AS (
  SELECT doc_id, unnest(CASE
      WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM doc
), shape AS (
  SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS grams FROM gram GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN shape x ON x.doc_id = a.doc_id JOIN shape y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 5 * count(*) >= 4 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
), same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS copy_id FROM shape
)
SELECT d.doc_id, c.class_id, coalesce(s.copy_id, d.doc_id) AS copy_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM doc d
JOIN (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id) c USING (doc_id)
LEFT JOIN same s USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a) k USING (doc_id)
"""

QUALITY = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w
  FROM documents
), win AS (
  SELECT r, unnest(range(1, len(w) - {quality.WINDOW} + 2)) AS i, w FROM doc WHERE len(w) >= {quality.WINDOW}
), twice AS (
  SELECT r, unnest(list(i)) AS i
  FROM (SELECT r, i, array_to_string(w[i:i+{quality.WINDOW - 1}], ' ') AS t FROM win)
  GROUP BY r, t HAVING count(*) > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY r
), raw AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM doc
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), norm AS (
  SELECT r, host, line, sum(n) AS n FROM (
    SELECT r, host, array_to_string(regexp_extract_all(lower(line), '{_WORDS}'), ' ') AS line,
           len(regexp_extract_all(line, '{_WORDS}')) AS n FROM raw)
  WHERE line <> '' GROUP BY r, host, line
), holder AS (
  SELECT DISTINCT n.host, n.line, doc.text, min(doc.doc_id) OVER (PARTITION BY n.host, n.line, doc.text) AS doc_id
  FROM norm n JOIN doc ON doc.r = n.r
), frequent AS (
  SELECT host, line, first(text ORDER BY doc_id NULLS LAST) AS first_text FROM holder GROUP BY host, line
  HAVING count(*) > {quality.MIN_DOCS} AND count(*) > CAST({quality.SHARE} AS DOUBLE)
    * (SELECT count(DISTINCT text) FROM doc WHERE doc.host = holder.host)
), removed AS (
  SELECT n.r, sum(n.n) AS n FROM norm n JOIN doc ON doc.r = n.r JOIN frequent f ON f.host = n.host AND f.line = n.line
  WHERE doc.text <> f.first_text GROUP BY n.r
), figures AS (
  SELECT d.r, d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM doc d LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
       NOT base_failed AND 100 * (n_words - removed_words) >= {quality.MIN_LEFT_PERCENT} * n_words AS kept
FROM judged
"""


def _placed(pattern: str, kind: str, keep: str) -> str:
    """Spans of one kind: ``keep`` tests the list ``m`` of matches at ``i``
    (and ``v``, the second groups) in SQL."""
    pattern = pattern.replace("'", "''")
    second = f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else "m"
    return f"""
  SELECT r, '{kind}' AS kind, s AS start, s + length(m[i]) AS stop, m[i] AS token, coalesce({keep}, false) AS ok
  FROM (SELECT r, m, v, i, (list_sum(list_transform(g[1:i], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
        FROM (SELECT r, m, v, g, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, {second} AS v,
                           string_split_regex(text, '{pattern}') AS g FROM doc)))
  WHERE {keep}"""


def secrets_sql() -> str:
    q = secret_scan
    quoted = {p: p.replace("'", "''") for p in (q.ASSIGN, q.ACCESS, q.HEX, q.WORD)}
    pick = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT)"
    plain = "text"
    for p in (q.ASSIGN, q.ACCESS, q.HEX):
        plain = f"regexp_replace({plain}, '{quoted[p]}', ' ', 'g')"
    code = f"strpos('{q.ALPHABET}', {{}})"
    model = """
  SELECT a.a, b.b, ln((coalesce(n, 0) + 1) / (coalesce(sum(n) OVER (PARTITION BY a.a), 0) + {codes})) AS p
  FROM (SELECT unnest(range(0, {codes})) AS a) a, (SELECT unnest(range(0, {codes})) AS b) b
  LEFT JOIN (SELECT a, b, count(*) AS n
             FROM (SELECT {one} AS a, {two} AS b
                   FROM (SELECT t, unnest(range(1, length(t))) AS i FROM {tokens})) GROUP BY a, b) c
    ON c.a = a.a AND c.b = b.b"""
    parts = {"codes": q.CODES, "one": code.format("substr(t, i, 1)"), "two": code.format("substr(t, i + 1, 1)")}
    return f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {pick} AS pick FROM documents
), random_token AS (
  SELECT unnest(list_filter(regexp_extract_all(text, '{quoted[q.ASSIGN]}', 2), lambda x: length(x) >= {q.ASSIGN_CHARS})
                || regexp_extract_all(text, '{q.ACCESS}') || regexp_extract_all(text, '{q.HEX}')) AS t
  FROM doc WHERE pick < {q.SAMPLE_RANDOM * (1 << 28)}::DOUBLE / (SELECT count(*) FROM documents)
), ordinary_token AS (
  SELECT unnest(regexp_extract_all({plain}, '{quoted[q.WORD]}')) AS t
  FROM doc WHERE pick < {q.SAMPLE_ORDINARY * (1 << 28)}::DOUBLE / (SELECT count(*) FROM documents)
), random_model AS ({model.format(tokens="random_token", **parts)}
), ordinary_model AS ({model.format(tokens="ordinary_token", **parts)}
), base AS ({_placed(q.ASSIGN, "assign", f"length(v[i]) >= {q.ASSIGN_CHARS}")}
  UNION ALL {_placed(q.ACCESS, "access", "true")}
  UNION ALL {_placed(q.HEX, "hex", "true")}
), candidate AS (
  SELECT * FROM ({_placed(q.CANDIDATE, "markov", "regexp_matches(m[i], '[A-Za-z]')")})
), score AS (
  SELECT r, start, any_value(stop) AS stop, any_value(token) AS token, sum(x.p - y.p) AS total
  FROM (SELECT *, unnest(range(1, length(token))) AS i FROM candidate) c
  JOIN random_model x ON x.a = {code.format("substr(token, i, 1)")} AND x.b = {code.format("substr(token, i + 1, 1)")}
  JOIN ordinary_model y ON y.a = x.a AND y.b = x.b
  GROUP BY r, start
), added AS (
  SELECT r, 'markov' AS kind, start, stop FROM score s
  WHERE total >= greatest({q.LEAST_TOTAL}, {q.LEAST_MEAN} * (length(token) - 1))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND b.stop > s.start)
), spans AS (
  SELECT r, kind, start, stop, true AS is_base FROM base UNION ALL SELECT r, kind, start, stop, false FROM added
), joined AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position(
             ['assign', 'access', 'hex', 'markov'], kind)) FILTER (WHERE is_base) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position(
             ['assign', 'access', 'hex', 'markov'], kind)) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN joined USING (r)
"""


CODES = f"""
WITH RECURSIVE vec AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM vec
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {rotation_codes.THRESHOLD}
), reach(r, other) AS (
  SELECT r, r FROM vec
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.other
), named AS (
  SELECT reach.r, min(vec.vec_id) AS component_id FROM reach JOIN vec ON vec.r = reach.other GROUP BY reach.r
)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, n.component_id,
       v.vec_id IS NOT DISTINCT FROM n.component_id AS kept
FROM vec v JOIN named n USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM link GROUP BY a) k USING (r)
"""


def spelling_sql() -> str:
    """Words by a table-driven crc32 over the bytes of each run, near words by
    the edit distance of every two words whose lengths fit (letters beyond
    ASCII stand for one byte each, so that the distance counts letters)."""
    q = permuterm
    accented = "".join(chr(c) for c in range(0xC0, 0x100))
    spare = [chr(c) for c in range(33, 127) if not chr(c).islower()][:len(accented)]
    flat = "".join(spare).replace("'", "''")
    return f"""
WITH RECURSIVE step(k, c, i) AS (
  SELECT k, k, 0 FROM (SELECT unnest(range(0, 256))::BIGINT AS k)
  UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, i + 1 FROM step WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{q.LETTERS}+')), '{q._UPPER}', '{q._LOWER}') AS run
  FROM documents
), long AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM run
  WHERE length(run) >= {q.LEAST_CHARS} GROUP BY 1, 2
), hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1),
          lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
      lambda a, b: xor(a // 256, crc.t[1 + xor(a % 256, b)]))) AS h
  FROM long, crc
), word AS (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{accented}', '{flat}') AS flat
  FROM (SELECT n, CASE WHEN h % {q.EDIT_EVERY} = 0
                       THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= {q.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {q.LEAST_COUNT}
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m
  FROM word a JOIN word b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word
  WHERE levenshtein(a.flat, b.flat) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= {q.TIMES} * w.n THEN b.other END AS form,
         CASE WHEN b.m >= {q.TIMES} * w.n THEN b.m END AS form_n
  FROM word w LEFT JOIN best b USING (word)
), way(word, last) AS (
  SELECT word, word FROM judged
  UNION ALL
  SELECT way.word, judged.form FROM way JOIN judged ON judged.word = way.last WHERE judged.form IS NOT NULL
)
SELECT j.word, j.form, w.last AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN way w USING (word) JOIN judged e ON e.word = w.last WHERE e.form IS NULL
"""


ORACLES = {"op5_secrets": secrets_sql(), "op7_jaccard": JACCARD, "op9_quality": QUALITY, "op12_codes": CODES,
           "op13_spelling": spelling_sql()}
