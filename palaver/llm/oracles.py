"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op6_decontaminate"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), item AS (
    SELECT item_id, words, least(len(words), 10) AS size FROM (
        SELECT item_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark WHERE text IS NOT NULL)
    WHERE len(words) > 0
), item_window AS (
    SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS gram
    FROM (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM item)
), doc_window AS (
    SELECT row_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS gram
    FROM (SELECT row_id, size, words, unnest(range(1, len(words) - size + 2)) AS i
          FROM doc, (SELECT DISTINCT size FROM item) WHERE len(words) >= size)
), hit AS (
    SELECT row_id, i, doc_window.size, item_id FROM doc_window JOIN item_window USING (size, gram)
), hit_words AS (
    SELECT row_id, count(DISTINCT place) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + size)) AS place FROM hit) GROUP BY row_id
), hit_items AS (
    SELECT row_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM hit GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""

ESCAPED = ("length({0}) + length({0}) - length(replace({0}, '\\', ''))"
           + "".join(f" + (length({{0}}) - length(replace({{0}}, '{control}', ''))) // {len(control)}"
                     for control in ("<s>", "[INST]", "[/INST]", "</s>", "<image>", "<audio>", "<document>")))

ORACLES["op5_chat"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
    SELECT *, role = 'assistant' AS trained,
           {ESCAPED.format("role")} + {ESCAPED.format("text")} + 14 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END AS size
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (trained), '')) AS loss_sha256,
       (3 + sum(size))::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""

ORACLES["op8_warc"] = """
WITH page AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), bits AS (
    SELECT digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + value, 1), '' ORDER BY place) AS base32
    FROM (
        SELECT digest, place, list_sum(list_transform(range(0, 5), lambda k:
                   (((strpos('0123456789abcdef', substr(digest, 1 + (5 * place + k) // 4, 1)) - 1)
                     >> (3 - (5 * place + k) % 4)) & 1) << (4 - k)))::BIGINT AS value
        FROM (SELECT DISTINCT digest FROM page), (SELECT unnest(range(0, 32)) AS place))
    GROUP BY digest
), latest AS (SELECT html, max(page_id) AS latest FROM page GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, base32 AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM page JOIN bits USING (digest) JOIN latest USING (html)
"""
