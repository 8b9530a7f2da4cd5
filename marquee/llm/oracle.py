"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from marquee.llm import chat

OP4 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS rn
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM g
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0') AS order_key
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(nth % 3 + 1 AS DOUBLE) AS weight, CASE nth % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 1.5e0 ELSE 0.5e0 END AS a,
         CASE nth % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 ELSE 1.5e0 END AS b, source_size * 3.0e0 AS cap FROM per
), levels AS (
  SELECT *, cap / weight AS ratio, (CAST(sum(source_size) OVER () AS DOUBLE)
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM weighed
), goals AS (
  SELECT source, source_size, a, b, least(cap, weight * (SELECT lev FROM levels WHERE lev <= ratio ORDER BY ratio, nth LIMIT 1)) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.a, g.b,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.order_key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), used AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(offs + size / 2.0e0 <= target AS INTEGER) + CAST(offs + source_size + size / 2.0e0 <= target AS INTEGER) + CAST(offs + 2 * source_size + size / 2.0e0 <= target AS INTEGER) END AS uses
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(uses * size AS BIGINT) AS taken,
       CASE WHEN uses = 0 THEN NULL ELSE round(CASE WHEN a = b THEN CAST(offs AS DOUBLE) / target * (a + b) / 2.0e0 / a
            ELSE (sqrt(a * a + 2.0e0 * (b - a) * (CAST(offs AS DOUBLE) / target * (a + b) / 2.0e0)) - a) / (b - a) END, 9) + 0.0e0 END AS first_position
FROM used
"""



def _entities(x: str) -> str:
    """The named entities that pages of the tables hold; those by number are covered by tests."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


#: Comments, scripts, styles and heads; tags that end a line.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_BREAKS = r"(?i)</?(p|div|br|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|hr)\b[^>]*>"
_CRLF = "chr(13) || chr(10)"
OP3 = rf"""
WITH base AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html FROM pages
), responses AS (
  SELECT *, 'sha256:' || sha256(html) AS pd FROM base
), named AS (
  SELECT *, 'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || uri || '|' || pd AS nm FROM responses
), idd AS (
  SELECT *, '<urn:uuid:' || md5(nm)[1:8] || '-' || md5(nm)[9:12] || '-' || md5(nm)[13:16] || '-' || md5(nm)[17:20] || '-' || md5(nm)[21:32] || '>' AS rid FROM named
), txt AS (
  SELECT *, {_entities(f"regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '{_BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS t0 FROM idd
), pairs AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS ct,
         'http-status: HTTP/1.1 200 OK' || {_CRLF} || 'http-content-type: text/html; charset=utf-8' || {_CRLF} || 'http-content-length: ' || strlen(html) || {_CRLF}
         || 'source-warc-block-digest: sha256:' || sha256('HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(html) || {_CRLF} || {_CRLF} || html) || {_CRLF} AS block FROM txt
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8',
         regexp_replace(regexp_replace(regexp_replace(t0, '[ \t\r\f\v]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') FROM txt
), made AS (
  SELECT *, record_type || '|' || rid AS nm2, 'sha256:' || sha256(block) AS bd FROM pairs
), linked AS (
  SELECT *, '<urn:uuid:' || md5(nm2)[1:8] || '-' || md5(nm2)[9:12] || '-' || md5(nm2)[13:16] || '-' || md5(nm2)[17:20] || '-' || md5(nm2)[21:32] || '>' AS own FROM made
)
SELECT page_id, record_type, own AS record_id, rid AS refers_to, uri AS target_uri, pd AS source_payload_digest, bd AS block_digest, CAST(length(block) AS BIGINT) AS block_chars,
  sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: ' || own || {_CRLF} || 'WARC-Refers-To: ' || rid || {_CRLF}
    || 'WARC-Refers-To-Target-URI: ' || uri || {_CRLF} || 'WARC-Refers-To-Date: 1970-01-01T00:00:00Z' || {_CRLF} || 'WARC-Target-URI: ' || uri || {_CRLF}
    || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF} || 'X-Source-Payload-Digest: ' || pd || {_CRLF} || 'WARC-Block-Digest: ' || bd || {_CRLF} || 'Content-Type: ' || ct || {_CRLF}
    || 'Content-Length: ' || strlen(block) || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF}) AS record_sha256
FROM linked
"""

OP8 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
, s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


OP10 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{chat.START}') + length(replace({_escaped("role")}, chr(10), '\' || chr(10))) + 1 + length({_escaped("text")}) + length('{chat.END}') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLIMB = "list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))"
_STEP = "coalesce(array_to_string(nodes[at // 8 * 8 + 1:at], ''), '') || '|' || coalesce(array_to_string(nodes[at + 2:at // 8 * 8 + 8], ''), '')"
OP11 = rf"""
WITH RECURSIVE one_byte AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM one_byte WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM one_byte WHERE k = 8
), hashed AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, sha256({_LEAF} || {_field("text")}) AS leaf, sha256({_LEAF} || {_field(_LOWER)}) AS lowered,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS chosen
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed
), up AS (
  SELECT g, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY g
  UNION ALL SELECT g, level + 1, {_CLIMB} FROM up WHERE len(nodes) > 1
), subroots AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM up WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_CLIMB} FROM top WHERE len(nodes) > 1
), steps AS (
  SELECT p.g, p.place, level, {_STEP.replace("at ", "(p.place // CAST(8 ** level AS BIGINT)) ").replace(":at]", ":(p.place // CAST(8 ** level AS BIGINT))]")} AS step FROM placed p JOIN up ON up.g = p.g AND len(nodes) > 1
  UNION ALL
  SELECT p.g, p.place, 100 + level, {_STEP.replace("at ", "(s.place // CAST(8 ** level AS BIGINT)) ").replace(":at]", ":(s.place // CAST(8 ** level AS BIGINT))]")} FROM placed p JOIN subroots s ON s.g = p.g, top WHERE len(nodes) > 1
), ways AS (
  SELECT g, place, list(step ORDER BY level) AS way FROM steps GROUP BY g, place
), made AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(replace(array_to_string(coalesce(way, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN chosen THEN lowered ELSE leaf END, coalesce(way, [])), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root
  FROM placed LEFT JOIN ways USING (g, place) JOIN subroots USING (g)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM made
"""

#: What tree scoring finds on the tables' pages: the article. Other layouts are covered by tests.
OP12 = r"""
WITH raw AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '<(/?p|/?h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM raw
), read AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM read
"""

OP13 = r"""
WITH low AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]'), lambda w: w <> '') AS ws FROM low
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang
), lengths AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS k
), places AS (
  SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, lengths WHERE len(ws) >= k
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM places GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, n AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.n AS l, r.n AS r, t.n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), open AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.k > s.k AND 100 * f.n >= 100 * s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM open
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

#: op8: scores differ in their last bits between engines, so its SQL serves the tests, with a tolerance.
ORACLE = {"op3_warc": OP3, "op4_exactdedup": OP4, "op5_mixing": OP5, "op10_chat": OP10, "op11_merkle": OP11, "op12_htmltext": OP12, "op13_phrases": OP13}
