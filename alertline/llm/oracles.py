"""DuckDB SQL for those named queries of the training-data operators that SQL can express."""

from __future__ import annotations

from alertline.llm.lines import (
    BOILERPLATE,
    MAX_LOST_SHARE,
    MAX_REPEATED_PERCENT,
    MAX_SYMBOLS_PER_WORD,
    MIN_SEPARATORS,
    MIN_WORDS,
    SHOUTED_WORDS,
)
from alertline.llm.mixing import MAX_PASSES, SHARE_PERCENT, WEIGHTS
from alertline.llm.neardup import THRESHOLD_PERCENT

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES: dict[str, str] = {}


def near_duplicates_sql(threshold_percent: int) -> str:
    """Near-duplicate groups at a threshold."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(x) AS x FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS x
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
    UNION ALL
    SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4)
), sizes AS (
  SELECT doc_id, count(x)::BIGINT AS n FROM texts LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= {threshold_percent} * (p.n + q.n - c)
), reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM sizes
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen
), smallest AS (SELECT node, min(seen) AS component_id FROM reached GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN smallest ON node = doc_id
"""


ORACLES["op3_near_duplicates"] = near_duplicates_sql(THRESHOLD_PERCENT)

ORACLES["op4_source_mixing"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s,
    list_value({", ".join(map(str, WEIGHTS))})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM docs GROUP BY source
), rounds AS (
  SELECT 0 AS k, source, s, w, false AS stops,
    {SHARE_PERCENT} * sum(s) OVER () AS free, sum(w) OVER () AS weight
  FROM sources
  UNION ALL
  SELECT k, source, s, w, stops,
    {SHARE_PERCENT} * sum(s) OVER () - coalesce(sum(CASE WHEN stops THEN {100 * MAX_PASSES} * s END) OVER (), 0),
    sum(CASE WHEN stops THEN 0 ELSE w END) OVER ()
  FROM (
    SELECT k + 1 AS k, source, s, w,
      stops OR w::DOUBLE * free::DOUBLE >= ({100 * MAX_PASSES} * s)::DOUBLE * weight::DOUBLE AS stops
    FROM rounds WHERE k < (SELECT count(*) FROM sources)
  )
), targets AS (
  SELECT source, s, CASE WHEN stops THEN ({MAX_PASSES} * s)::DOUBLE
    ELSE w::DOUBLE * free::DOUBLE / (100.0::DOUBLE * weight::DOUBLE) END AS target
  FROM rounds WHERE k = (SELECT count(*) FROM sources)
), budgets AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS passes FROM targets
), running AS (
  SELECT d.*, b.s, b.target, b.passes, b.target - b.passes * b.s AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, s AS source_size, target, (size * (passes + CASE
  WHEN upto <= rest THEN 1 WHEN upto - same <= rest AND upto - rest < rest - (upto - same) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

_LINE_FAILS = f"""(
  NOT regexp_matches(l, {_quoted(r'''[.!?…。！？؟।]["'”’»)\]]*(\s|$)''')})
  OR len(regexp_extract_all(l, '[|»›•·]|->|>>')) >= {MIN_SEPARATORS}
  OR len(regexp_extract_all(l, '[#*$%&|<>]')) > {MAX_SYMBOLS_PER_WORD}::DOUBLE * len(regexp_extract_all(l, '{_WORD}'))
  OR (regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}')
      AND len(regexp_extract_all(l, '{_WORD}')) >= {SHOUTED_WORDS})
  OR regexp_matches(lower(l), {_quoted("|".join(BOILERPLATE))}))"""

ORACLES["op5_quality_rules"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)
), again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY doc_id
), kept_lines AS (
  SELECT doc_id, sum(length(regexp_replace(l, '{_SPACE}', '', 'g'))) AS chars
  FROM (SELECT doc_id, unnest(list_distinct(lines)) AS l FROM texts) WHERE NOT {_LINE_FAILS} GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(k.chars, 0) AS chars
  FROM texts LEFT JOIN repeated r USING (doc_id) LEFT JOIN kept_lines k USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars = 0 THEN 0.0::DOUBLE ELSE 1 - chars::DOUBLE / word_chars::DOUBLE END AS lost_share
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_share <= {MAX_LOST_SHARE}::DOUBLE AS kept, lost_share
FROM judged
"""

ORACLES["op6_warc"] = """
WITH digests AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT payload AS p, min(page_id) AS first FROM digests GROUP BY payload),
parts AS (
  SELECT page_id, list_transform(range(0, 8), lambda k: ('0x' || hex[5 * k + 1:5 * k + 5])::INTEGER) AS v FROM digests
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(
    list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> b) & 31) + 1]), '')), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digests JOIN firsts ON payload = p JOIN parts USING (page_id)
"""
