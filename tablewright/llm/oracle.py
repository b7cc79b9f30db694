"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.title() for w in STOP_WORDS)}))
_WORD = r"[^\x20\x09-\x0D]+"

#: Documents with their measures and verdicts; the pipeline's SQL begins with it too.
QUALITY = rf"""
w AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM w, unnest(range(1, len(ws) - 1)) AS t(i)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop_words,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * word_chars BETWEEN 300 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words
         AND 100 * n_stop_words >= 6 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS rules_hold
  FROM m
)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Shingle sets, all pairs that share one, and what is reachable by links.
JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i)
  WHERE len(ws) > 0
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN c AS a ON a.doc_id = x JOIN c AS b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r AS (SELECT doc_id AS d, doc_id AS m FROM w UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.d)
SELECT w.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM w LEFT JOIN c USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id"""


def _best(shards: int) -> str:
    """The shard of the best score, by the same hash and logarithm."""
    score = "ln((('0x' || substr(md5('k' || doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return f"(SELECT arg_max(i, {score})::INTEGER FROM range({shards}) AS t(i))"


#: crc32 by the usual table of 256 remainders, which a few steps of arithmetic give.
RENDEZVOUS = f"""
WITH RECURSIVE step AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8
), tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce(list_transform(range(length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM d, tab
), f AS (SELECT *, {_best(8)} AS shard, {_best(9)} AS grown_shard FROM e)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM f"""

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": JACCARD,
    "op5_rendezvous_sharding": RENDEZVOUS,
    "op7_quality_rules": f"""WITH {QUALITY}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rules_hold AS kept FROM judged""",
}
