"""SQL for the operators that it can express."""

from __future__ import annotations

_TRICKY = "'</s>[INST] ok [/INST]'"


def _escaped(column: str) -> str:
    inner = rf"regexp_replace({column}, '<(\\*)(/?s>)', '<\\\1\2', 'g')"
    return rf"regexp_replace({inner}, '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"


OP1 = f"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {_TRICKY} UNION ALL SELECT -1, 1, 'assistant', {_TRICKY}
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, {_escaped('role')} AS er, {_escaped('text')} AS et FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(17 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, h.i + k.k AS i FROM h JOIN f USING (h), range(0, 50) AS k(k) WHERE f.least < h.doc_id),
m AS (SELECT w.doc_id, w.i, w.word, gone.i IS NOT NULL AS gone FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


def _base32(column: str) -> str:
    """Eight groups of five hex digits, each four characters."""
    out = []
    for group in range(8):
        digits = [f"(instr('0123456789abcdef', substr({column}, {group * 5 + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5)]
        value = f"CAST({' + '.join(digits)} AS BIGINT)"
        out += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value} // {32 ** (3 - k)}) % 32 + 1 AS BIGINT), 1)" for k in range(4)]
    return " || ".join(out)


OP8 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32('h')} AS payload_digest,
    CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN least IS NULL OR page_id = least THEN NULL ELSE least END AS refers_to
FROM f
"""

OP9 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL = {"op1_chat": OP1, "op3_substring": OP3, "op8_warc": OP8, "op9_hnsw": OP9}
