"""DuckDB SQL that registered queries of this subpackage must agree with."""

from __future__ import annotations

_OPENING = r"\### Assistant: </turn> ok"

#: Turn by turn from the rows; `e` is a text as it stands in the formatted output, whose marks add 15 characters a turn.
CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_OPENING}'), (-7, 1, 'assistant', '{_OPENING}')
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(replace(replace(replace(role || text, '\\', '\\\\'), '<turn>', '\\<turn>'), '</turn>', '\\</turn>'))
      + length(role) - length(replace(role, chr(10), '')) AS n
  FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: crc32 bit by bit; then the least (cost, edits) of every state after each row, forwards, in place of a search.
REPAIR = r"""
WITH RECURSIVE c AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''),
      lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS crc
  FROM c
), k AS (
  SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS k FROM bits
), after AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM k WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, left(role, 1) AS initial
  FROM after
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), steps AS (
  SELECT * FROM (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')) t(q, takes, nxt)
), inserts AS (  -- up to two turns before a row; more than two come back to the same state
  SELECT * FROM (VALUES ('0', '', '', '0'), ('S', '', '', 'S'), ('U', '', '', 'U'), ('A', '', '', 'A'),
    ('0', 'I', 'user:;', 'U'), ('S', 'I', 'user:;', 'U'), ('A', 'I', 'user:;', 'U'), ('U', 'I', 'assistant:;', 'A'),
    ('0', 'II', 'user:;assistant:;', 'A'), ('S', 'II', 'user:;assistant:;', 'A')) t(q, ins, added, nxt)
), moves AS (
  SELECT f.conv_id, f.i, s.q, s.ins || e.edit AS edits, e.nxt, 5 * length(s.ins) + e.cost AS cost,
    [x || ':' FOR x IN string_split(rtrim(replace(s.added, ':', ''), ';'), ';') IF x <> ''] || e.said AS said
  FROM f CROSS JOIN inserts s JOIN LATERAL (
    SELECT 'D' AS edit, s.nxt AS nxt, 2 AS cost, CAST([] AS VARCHAR[]) AS said
    UNION ALL SELECT 'K', t.nxt, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, [f.role || ':' || f.text] FROM steps t
      WHERE t.q = s.nxt AND t.takes = f.initial AND f.fault IN ('', 'truncated')
    UNION ALL SELECT 'R', t.nxt, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, [CASE t.takes WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] FROM steps t
      WHERE t.q = s.nxt AND t.takes IN ('u', 'a') AND t.takes <> f.initial AND f.fault IN ('', 'truncated')
  ) e ON true
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM facts
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.said FROM (
    SELECT w.conv_id, m.i, m.nxt AS q, min(struct_pack(cost := w.cost + m.cost, audit := w.audit || m.edits, said := w.said || m.said)) AS b
    FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.q = w.q GROUP BY ALL)
), ends AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + 5 * length(s.ins), audit := w.audit || s.ins,
    said := w.said || [x || ':' FOR x IN string_split(rtrim(replace(s.added, ':', ''), ';'), ';') IF x <> ''])) AS b
  FROM walk w JOIN facts t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN inserts s ON s.q = w.q WHERE s.nxt IN ('0', 'A') GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _codes(rounds: int = 4) -> str:
    """Rounds unrolled; distances and floors in whole numbers."""
    assign = """SELECT x.vec_id, x.label, x.p, arg_min(b.e, b.e + 256 * list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS e,
      min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, any_value(x.v) AS v
    FROM x JOIN b{k} b USING (p) GROUP BY x.vec_id, x.label, x.p"""
    ctes = ["""i AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
            """x AS MATERIALIZED (SELECT vec_id, label, p, v[CAST(p * len(v) / 4 + 1 AS BIGINT):CAST((p + 1) * len(v) / 4 AS BIGINT)] AS v FROM i, range(4) t(p))""",
            """b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < 256)"""]
    for k in range(rounds):
        ctes.append(f"a{k} AS MATERIALIZED ({assign.format(k=k)})")
        ctes.append(f"""m{k} AS MATERIALIZED (SELECT p, e, list(c ORDER BY j) AS v FROM (
      SELECT p, e, j, (s - ((s % n) + n) % n) // n AS c FROM (SELECT p, e, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY p, e, j)) GROUP BY p, e)""")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    ctes.append(f"last AS MATERIALIZED ({assign.format(k=rounds)})")
    ctes.append("""coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded"""


CODES = _codes()


def _least(nodes: str, links: str) -> str:
    """Smallest id reachable over `links` (a, b, both ways) from each id of `nodes`."""
    return f"""reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b),
least AS (SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS component_id FROM {nodes} n LEFT JOIN reach r ON r.a = n.id GROUP BY n.id)"""


#: All pairs that share a shingle, with exact counts; then the transitive closure of the links.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0
), sizes AS MATERIALIZED (SELECT w.id, count(s.s) AS n FROM words w LEFT JOIN shingles s ON s.id = w.id GROUP BY w.id),
pairs AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b, count(*) AS k FROM shingles x JOIN shingles y ON y.s = x.s AND y.id <> x.id GROUP BY x.id, y.id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.id = p.a JOIN sizes y ON y.id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)
), """ + _least("sizes", "links") + """
SELECT s.id AS doc_id, s.n AS n_shingles, l.component_id FROM sizes s JOIN least l ON l.id = s.id
"""

#: All pairs of usable vectors.
RANGE_JOIN = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON y.id <> x.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
), nodes AS (SELECT vec_id AS id FROM embeddings), """ + _least("nodes", "links") + """,
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT l.id AS vec_id, coalesce(d.n, 0) AS n_links, l.component_id, l.id = l.component_id AS kept FROM least l LEFT JOIN degrees d ON d.a = l.id
"""
