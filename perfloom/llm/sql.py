"""Checking SQL of the queries whose results SQL can express, written from their contracts."""

from __future__ import annotations

from .chat import CONTROLS, END, TEXT, TURN

LEXICAL = r"""
WITH words AS (
  SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), sizes AS (SELECT d, doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT d, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term
), scored AS (
  SELECT item_id, d, held.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN sizes USING (d) CROSS JOIN total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

REPEATED = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, start, md5(array_to_string(words[start + 1 : start + 20], ' ')) AS content
  FROM (SELECT r, doc_id, words, unnest(range(0, len(words) - 19)) AS start FROM docs WHERE len(words) >= 20)
), placed AS (
  SELECT r, start, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS nth FROM windows
), covered AS (
  SELECT r, list(DISTINCT place) AS places FROM (SELECT r, unnest(range(start, start + 20)) AS place FROM placed WHERE nth > 1) GROUP BY r
), listed AS (
  SELECT doc_id, words, coalesce(places, []) AS places FROM docs LEFT JOIN covered USING (r)
)
SELECT doc_id, len(words) AS n_words, len(places) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(0, len(words)), lambda i: NOT list_contains(places, i)), lambda i: words[i + 1]), ' '), '')) AS kept_sha256
FROM listed
"""
#: Fixed value: the reversed polynomial of CRC-32.
CRC = """list_reduce(flatten(list_transform(range(1, length({x}) + 1), lambda i: [ord(substr({x}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)"""
MERKLE = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
           CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
           CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END) AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END AS chars,
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1) END AS more,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS body,
    xor(""" + CRC.format(x="doc_id::VARCHAR") + """, 4294967295) % 7 = 0 AS tampered
  FROM documents
), leaves AS (
  SELECT r, doc_id, lang, sha256(concat(head, chars, body)) AS leaf,
    CASE WHEN tampered THEN sha256(concat(head, more, body)) ELSE sha256(concat(head, chars, body)) END AS seen FROM docs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place FROM leaves
), grow AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(concat(nodes[i + 1], coalesce(nodes[i + 2], '')))) FROM grow WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM grow WHERE len(nodes) = 1
), grow_top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(concat(nodes[i + 1], coalesce(nodes[i + 2], '')))) FROM grow_top WHERE len(nodes) > 1
), paths AS (
  SELECT r, list({side: (place >> level) % 2, other: nodes[xor(place >> level, 1) + 1]} ORDER BY level) AS steps
  FROM placed JOIN grow ON placed.lang IS NOT DISTINCT FROM grow.lang WHERE len(nodes) > 1 GROUP BY r
), top_paths AS (
  SELECT lang, subroot, list({side: (place >> level) % 2, other: nodes[xor(place >> level, 1) + 1]} ORDER BY level) FILTER (len(nodes) > 1) AS steps
  FROM subroots, grow_top GROUP BY lang, subroot
), proven AS (
  SELECT doc_id, leaf, seen, subroot, (SELECT nodes[1] FROM grow_top WHERE len(nodes) = 1) AS root,
    list_concat(coalesce(paths.steps, []), coalesce(top_paths.steps, [])) AS steps
  FROM placed LEFT JOIN paths USING (r) JOIN top_paths ON placed.lang IS NOT DISTINCT FROM top_paths.lang
), folded AS (
  SELECT *, sha256(coalesce(list_aggregate(list_filter(list_transform(steps, lambda s: s.other), lambda s: s IS NOT NULL), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_transform(steps, lambda s: {side: s.side, other: s.other}),
      lambda a, s: {side: 0::BIGINT, other: CASE WHEN s.other IS NULL THEN sha256(a.other) WHEN s.side = 1 THEN sha256(concat(s.other, a.other)) ELSE sha256(concat(a.other, s.other)) END},
      {side: 0::BIGINT, other: seen}).other AS folded_root
  FROM proven
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

TOP = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

ARCHIVES = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS size, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (SELECT digest, min(page_id) AS first FROM payloads WHERE size >= 100 GROUP BY digest)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (digest)
"""


def escaped(text: str) -> str:
    """SQL for a text with backslashes doubled and one put into each control string."""
    text = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sum({len(TURN + TEXT + END)} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars,
    string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

SQL = {"op3_topk": TOP, "op5_warc": ARCHIVES, "op6_chat_format": CHAT, "op11_relative_lz": REPEATED, "op12_merkle": MERKLE, "op13_lexical": LEXICAL}
