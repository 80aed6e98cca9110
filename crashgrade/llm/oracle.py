"""DuckDB SQL for the queries of this folder that SQL can express."""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT query_id, vec_id,
         CAST(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.query_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

EXACT = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM n JOIN g USING (content)
"""

# crc32 (reversed polynomial 0xEDB88320) of a text's bytes, given `t`, the table
# of the 256 remainders.
CRC_TABLE = """
SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
FROM (SELECT unnest(range(256)) AS i)
"""


def crc32_of(text: str) -> str:
    at = "('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT".format(text)
    byte_list = f"list_transform(range(octet_length(encode({text}))), lambda i: {at})"
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, b: {step}), 4294967295)"


SPELLING = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents
), sums AS (
  SELECT run, {crc32_of("(id || ':' || run)")} AS h FROM runs, crc WHERE length(run) >= 7
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM sums
), words AS (SELECT word, count(*) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON c.d = w.word),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), ranked AS (
  SELECT a, b, w.n AS bn, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r
  FROM pairs JOIN words w ON w.word = b
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form,
         CASE WHEN bn >= 10 * n THEN bn END AS form_n
  FROM words LEFT JOIN ranked ON a = word AND r = 1
), chain AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS goes_on FROM judged
  UNION ALL
  SELECT c.word, j.form, TRUE FROM chain c JOIN judged j ON j.word = c.root WHERE c.goes_on AND j.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NULL
)
SELECT word, n, n_near, form, form_n, root FROM judged JOIN ends USING (word)
"""

# A state is its cost in nine digits and the audit behind it, so the least text
# is the cheapest one, and of these the ASCII-least. e: nothing yet, s: s alone,
# p: whole pairs, b: a pair begun.
_ADD = "printf('%09d', substr({0}, 1, 9)::INT + {1}) || substr({0}, 10) || '{2}'"


def _add(state: str, cost: str, edit: str) -> str:
    return _ADD.format(state, cost, edit)


def _inserted(after: str) -> str:
    """The states when up to one turn was inserted: two in a row never pay."""
    begun = ", ".join(_add(x, "2", "I") for x in "esp")
    return f"SELECT *, least(b, {begun}) AS ib, least(p, {_add('b', '2', 'I')}) AS ip FROM {after}"


def _stays(state: str, initial: str, edit_cost: str = "late") -> str:
    keep, other = _add(state, edit_cost, "K"), _add(state, f"2 + {edit_cost}", "R")
    return f"CASE WHEN NOT forced THEN CASE WHEN initial = '{initial}' THEN {keep} ELSE {other} END END"


REPAIR = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
given AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_of("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc
), copies AS (
  SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM given WHERE kind <> 0
), rows AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS i
  FROM copies
), marked AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before
  FROM rows
), judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS dup,
         bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         bare = '' OR again AS forced,
         CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late
  FROM marked
), counted AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(dup) AS duplicate, count_if(cut) AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY k
), states AS (
  SELECT DISTINCT k, 0::BIGINT AS i, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS p, NULL::VARCHAR AS b FROM given
  UNION ALL
  SELECT x.k, j.i, {_add("e", "3", "D")},
         least({_add("s", "3", "D")}, CASE WHEN NOT forced AND initial = 's' THEN {_add("e", "late", "K")} END),
         least({_add("ip", "3", "D")}, {_stays("ib", "a")}),
         least({_add("ib", "3", "D")}, {_stays("e", "u")}, {_stays("s", "u")}, {_stays("ip", "u")})
  FROM ({_inserted("states")}) x JOIN judged j ON j.k = x.k AND j.i = x.i + 1
), last AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
best AS (SELECT k, least(e, ip) AS best FROM ({_inserted("last")})),
audits AS (SELECT k, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM best),
edits AS (
  SELECT k, pos, substr(audit, pos, 1) AS edit, length(replace(audit, 'D', '')) % 2 AS lead,
         length(replace(substr(audit, 1, pos), 'I', '')) AS i, length(replace(substr(audit, 1, pos), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM audits)
), written AS (
  SELECT e.k, string_agg(
    CASE WHEN edit = 'K' THEN r.role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS whole
  FROM edits e LEFT JOIN rows r ON r.k = e.k AND r.i = e.i AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY e.k
), convs AS (SELECT DISTINCT conv_id, k FROM given)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM convs JOIN audits USING (k) LEFT JOIN counted USING (k) LEFT JOIN written USING (k)
"""

ORACLE = {
    "op1_exact_top_k": TOP_K,
    "op5_exact_dedup": EXACT,
    "op12_conversation_repair": REPAIR,
    "op13_spelling_variants": SPELLING,
}
