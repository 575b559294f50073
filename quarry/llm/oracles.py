"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quarry.llm.license_rules import BASE, rules
from quarry.llm.licenses import CONFIDENCE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s
QUALIFY rank <= 5
"""

OP5 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s
), f AS (
  SELECT *,
         coalesce(sum(cap) OVER b, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((budget - capped) / rest) FILTER ((budget - capped) / rest * weight <= cap) AS level FROM f
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f, l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(floor(target + 0.5) / source_size)) ELSE 0 END::BIGINT AS times FROM t
), o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.times, (floor(g.target + 0.5) - g.times * g.source_size)::BIGINT AS more,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, more - ahead)))::BIGINT AS taken FROM o
"""

OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(words) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
x AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1 :], ' ')
), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(words[s : s + size - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2)) GROUP BY ALL
), d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000
"""
OP12 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL BY NAME SELECT -7 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '</s>[INST] ok [/INST]' AS text
), e AS (
  SELECT *, length(regexp_replace(text, '(\\*)(\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|\[ROLE\]|\[TEXT\]|\[/ROLE\])', '\\\1\2', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 23 + length(role) END AS chars
  FROM c
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""
OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def _op1() -> str:
    """Each rule at each word of the texts that have its keyword and match it; no rule is over thirty words long."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(r.keyword)}, {quoted(r.pattern)}, {r.tier}, {quoted(r.label)})" for r in rules())
    phrases = ", ".join(quoted(p) for p, _ in BASE)
    confidence = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(CONFIDENCE))
    return f"""
WITH r(keyword, pattern, tier, label) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS row, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' ' AS w
  FROM documents
), x AS (SELECT row, doc_id, w, CASE WHEN w = '  ' THEN [] ELSE string_split(trim(w), ' ') END AS words FROM d),
c AS (SELECT row, words, pattern, tier, label FROM x JOIN r ON contains(w, keyword) AND regexp_matches(w, ' (?:' || pattern || ') ')),
p AS (SELECT row, pattern, tier, label, words, unnest(range(0, len(words))) AS a FROM c),
s AS (SELECT row, pattern, tier, label, a, array_to_string(words[a + 1 : a + 30], ' ') || ' ' AS t FROM p),
m AS (
  SELECT row, pattern, tier, label, a, a + len(string_split(regexp_extract(t, '^(?:' || pattern || ') '), ' ')) - 1 AS b
  FROM s WHERE regexp_matches(t, '^(?:' || pattern || ') ')
), k AS (
  SELECT * FROM m WHERE NOT EXISTS (
    SELECT 1 FROM m o WHERE o.row = m.row AND o.tier <= m.tier AND o.a <= m.a AND o.b >= m.b AND (o.a, -o.b, o.tier, o.label) < (m.a, -m.b, m.tier, m.label))
), e AS (
  SELECT row, count(*) AS n, min(a) AS first, max(a) AS last, list(DISTINCT label) AS labels FROM (SELECT DISTINCT row, a, label, pattern FROM m WHERE pattern IN ({phrases})) GROUP BY row
), f AS (SELECT row, min(tier) AS tier, list(DISTINCT label) AS labels FROM k GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(e.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(e.labels, f.labels))), ','), '') AS labels,
  (CASE tier {confidence} ELSE 0 END)::DOUBLE AS score
FROM x LEFT JOIN e USING (row) LEFT JOIN f USING (row)
"""


ORACLES = {"op1_license_scan": _op1(), "op2_exact_top_k": OP2, "op5_exact_dedup": OP5, "op10_mixing": OP10, "op11_phrase_mining": OP11, "op12_chat_formatting": OP12, "op13_hard_negatives": OP13}
