"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from logmix.llm.chat_format import CONTROL

# Lengths of a template's marks by role: 8 + 11 for system, 7 + 8 for user, 1 + 5 for assistant; "<s>" opens.
_CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '{CONTROL}', '\\1\\3\\\\.\\2\\4', 'g') AS escaped,
    CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 END AS marks,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + marks) + 3 AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM marked GROUP BY conv_id
"""


def crc32(codes: str) -> str:
    """The checksum of a list of bytes, where a table ``crc`` holds the 256 remainders as ``remainders``."""
    every = "4294967295"
    return (
        f"xor({every}, list_reduce({codes}, lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), {every}))"
    )


_CRC = """crc AS MATERIALIZED (
  SELECT list(v ORDER BY n) AS remainders FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS v
    FROM range(256) r(n)))"""
_ASCII = "list_transform(string_split({}, ''), lambda c: CAST(ord(c) AS BIGINT))"

# Turn by turn: the cheapest edits that lead to each place of the pattern (0 nothing yet, 1 system, 2 user, 3 assistant).
_REPAIR = f"""
WITH RECURSIVE {_CRC},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), harmed AS (SELECT *, {crc32(_ASCII.format("name"))} % 20 AS harm FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed
), convs AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
found AS (
  SELECT g, turn, role, text, left(role, 1) AS initial,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS k
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id
), turns AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY g ORDER BY k) || initial AS pair
  FROM found
), steps(initial, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS MATERIALIZED (
  SELECT g, k, p, p AS q, 2 AS cost, 'D' AS edit FROM turns, range(4) r(p)
  UNION ALL SELECT g, k, p, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K' FROM turns JOIN steps USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT g, k, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R' FROM turns, steps WHERE fault IN ('', 'truncated') AND steps.initial <> 's'
), inserted(p, q, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')
), places(g, k, place, cost, audit) AS (
  SELECT g, 0::BIGINT, 0, 0, '' FROM convs
  UNION ALL
  SELECT g, k, q, best.cost, best.audit FROM (
    SELECT s.g, e.k, e.q, min({{'cost': s.cost + i.cost + e.cost, 'audit': s.audit || i.audit || e.edit}}) AS best
    FROM places s JOIN inserted i ON s.place = i.p JOIN edits e ON e.g = s.g AND e.k = s.k + 1 AND e.p = i.q GROUP BY ALL)
), sizes AS (SELECT g, max(k) AS n FROM places GROUP BY g),
plans AS MATERIALIZED (
  SELECT g, min({{'cost': s.cost + i.cost, 'audit': s.audit || i.audit}}) AS best
  FROM places s JOIN sizes USING (g) JOIN inserted i ON s.place = i.p WHERE s.k = n AND i.q IN (0, 3) GROUP BY g
), letters AS (SELECT g, unnest(range(1, length(best.audit) + 1)) AS spot, best.audit AS audit FROM plans),
placed AS (
  SELECT g, spot, substr(audit, spot, 1) AS edit, sum(CASE WHEN substr(audit, spot, 1) <> 'I' THEN 1 ELSE 0 END) OVER before AS k,
    sum(CASE WHEN substr(audit, spot, 1) <> 'D' THEN 1 ELSE 0 END) OVER before AS place
  FROM letters WINDOW before AS (PARTITION BY g ORDER BY spot)
), kept AS (
  SELECT p.g, spot, edit, place, role, text, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.g) AS opened
  FROM placed p LEFT JOIN turns t ON p.g = t.g AND p.k = t.k WHERE edit <> 'D'
), repaired AS (
  SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS all_turns FROM kept GROUP BY g
), facts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(coalesce(all_turns, '')) AS repaired_sha256
FROM convs JOIN plans USING (g) LEFT JOIN facts USING (g) LEFT JOIN repaired USING (g)
"""

# Letters from U+00C0 on are the bytes 195 and the code point less 64.
_LETTERS = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Near words share what is left when one letter of one or of both is taken out.
_SPELLING = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS name, translate(run, '{_UPPER}', '{_LOWER}') AS low FROM runs WHERE length(run) >= 7),
checked AS (SELECT low, {crc32("list_concat(" + _ASCII.format("name") + ", " + _LETTERS.format("low") + ")")} AS h FROM low, crc),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(low, CAST(h % length(low) AS INTEGER)) || substr(low, CAST(h % length(low) AS INTEGER) + 2) ELSE low END AS word
  FROM checked
), words AS MATERIALIZED (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
cuts AS MATERIALIZED (
  SELECT word, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (SELECT DISTINCT cuts.word AS a, words.word AS b FROM cuts JOIN words ON cuts.rest = words.word),
near AS MATERIALIZED (
  SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), counted AS (SELECT a, count(*) AS n_near FROM near GROUP BY 1),
ranked AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM near JOIN words ON near.b = words.word),
forms AS MATERIALIZED (
  SELECT words.word, words.n, r.b AS form, r.n AS form_n FROM words LEFT JOIN ranked r ON r.a = words.word AND r.place = 1 AND r.n >= 10 * words.n
), way(word, root, steps) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON way.root = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT word, max_by(root, steps) AS root FROM way GROUP BY 1)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM forms JOIN ends USING (word) LEFT JOIN counted ON counted.a = word
"""

# Whole numbers below 2^53 throughout on the given tables, so sums of doubles are exact.
_PRODUCTS = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

ORACLES: dict[str, str] = {
    "op5_chat_format": _CHAT,
    "op11_spelling_variants": _SPELLING,
    "op12_voronoi_join": _PRODUCTS,
    "op13_conversation_repair": _REPAIR,
}
