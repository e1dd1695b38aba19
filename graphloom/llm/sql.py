"""DuckDB SQL for the operators that SQL can express. The others are held against brute force in tests/llm."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("lower(text)")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {WORDS.format("lower(text)")} AS w FROM benchmark),
dg AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: w[k : k + 4])) AS g FROM d),
bg AS (SELECT DISTINCT i, item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: w[k : k + 4])) AS g FROM b),
n AS (SELECT i, count(*) AS n_shingles FROM bg GROUP BY 1),
s AS (SELECT r, doc_id, i, item_id, count(*) AS n_shared FROM dg JOIN bg USING (g) GROUP BY 1, 2, 3, 4),
short AS (SELECT doc_id, item_id FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM s JOIN n USING (i) WHERE n_shared >= 0.8 * n_shingles
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM short
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS.format("text")} AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS k, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k : k + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
twice AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (SELECT r, count(DISTINCT k + o) AS n FROM twice, range(0, 8) x(o) GROUP BY 1),
m AS (SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, CAST(len(list_filter(w, lambda x: upper(x) = x AND regexp_matches(x, '\p{{Lu}}\P{{Lu}}*\p{{Lu}}'))) AS BIGINT) AS n_shout_words FROM d LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 10 * n_symbols >= n_words OR 30 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_shout_words >= 3 * n_words AS failed FROM f),
h AS (SELECT source, count(*) AS host_docs, CAST(sum(CAST(failed AS BIGINT)) AS BIGINT) AS host_failed FROM g GROUP BY 1),
p AS (SELECT sum(host_failed) / sum(host_docs) AS mean, sum(host_failed * host_failed / host_docs) / sum(host_docs) - power(sum(host_failed) / sum(host_docs), 2) AS between_hosts, count(*) / sum(host_docs) AS spread FROM h),
q AS (SELECT mean, CASE WHEN between_hosts - mean * (1 - mean) * spread > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / (between_hosts - mean * (1 - mean) * spread) - 1)) ELSE 1e6 END AS strength FROM p),
v AS (SELECT source, host_docs, host_failed, (host_failed + mean * strength) / (host_docs + strength) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate < 0.5 AS kept, g.source, n_shout_words, host_docs, host_failed, round(rate, 9) AS host_rate, rate >= 0.5 AS host_blocked
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
"""

JUMP = """
list_reduce(list_prepend({{'key': CAST(doc_id AS HUGEINT), 'shard': 0::BIGINT, 'next': 0::BIGINT}}, list_transform(range(0, {n}), lambda i: {{'key': 0::HUGEINT, 'shard': 0::BIGINT, 'next': 0::BIGINT}})), lambda s, x:
  CASE WHEN s.next < {n} THEN {{'key': ((s.key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT), 'shard': s.next,
    'next': CAST(floor((s.next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((((s.key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT) + 1)::DOUBLE)) AS BIGINT)}} ELSE s END).shard
"""

#: crc32 from its polynomial: a table entry for each byte by eight halvings, then a fold over the bytes. Ids are not negative and ascend in the file.
SHARDING = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  CAST({JUMP.format(n=8)} AS INTEGER) AS shard, CAST({JUMP.format(n=9)} AS INTEGER) AS grown_shard FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM s
"""

RECOMPRESSION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS k, unnest(list_transform(range(1, len(w) - 33), lambda k: md5(array_to_string(w[k : k + 34], ' ')))) AS g FROM d WHERE len(w) >= 35),
twice AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
marked AS (SELECT r, words.k, x, max(twice.k) OVER (PARTITION BY r ORDER BY words.k) AS last FROM words LEFT JOIN twice USING (r, k)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS rest FROM marked WHERE last IS NULL OR k > last + 34 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Texts as hex digits, two for each byte.
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, k, md5(substring(h, 2 * k - 1, 800)) AS g FROM (SELECT r, h, unnest(range(1, n - 398)) AS k FROM d WHERE n >= 400)),
twice AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
bytes AS (SELECT r, unnest(range(1, n + 1)) AS k, unnest(regexp_extract_all(h, '..')) AS x FROM d),
marked AS (SELECT r, bytes.k, x, coalesce(max(twice.k) OVER (PARTITION BY r ORDER BY bytes.k) > bytes.k - 400, false) AS gone FROM bytes LEFT JOIN twice USING (r, k)),
edges AS (SELECT r, k, x, gone, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY r ORDER BY k) AS begins FROM marked),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS rest FROM edges GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
grams AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda k: w[k : k + 4]) END) AS g FROM d),
size AS (SELECT r, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)
  UNION ALL SELECT x.r, y.r FROM d x JOIN d y ON len(x.w) = 0 AND len(y.w) = 0 AND x.r <> y.r),
reached AS (SELECT r AS a, r AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
classes AS (SELECT reached.a AS r, min(d.doc_id) AS class_id FROM reached JOIN d ON d.r = reached.b GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links, doc_id = class_id AS kept FROM d JOIN classes USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY 1) USING (r)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM d),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
known AS (SELECT key, max(doc_id) AS stays FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 40) GROUP BY 1 HAVING count(*) >= 5),
marked AS (SELECT r, k, line, stays IS NOT NULL AND doc_id IS DISTINCT FROM stays AS gone FROM keyed LEFT JOIN known USING (key)),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM d JOIN kept USING (r)
"""

#: Ways from a state into another: the state before, the row's role that they ask for, their cost, their edits and the lines that they write.
WAYS = {
    0: [(0, "", 4, "D", "''")],
    1: [(1, "", 4, "D", "''"), (0, "s", 0, "K", "own")],
    2: [(2, "", 4, "D", "''"), *((a, "u", 0, "K", "own") for a in (0, 1, 3)), *((a, "any", 3, "R", "told('user')") for a in (0, 1, 3)), (2, "u", 3, "IK", "'assistant:' || chr(10) || own"), (2, "any", 6, "IR", "'assistant:' || chr(10) || told('user')")],
    3: [(3, "", 4, "D", "''"), (2, "a", 0, "K", "own"), (2, "any", 3, "R", "told('assistant')"), *((a, "a", 3, "IK", "'user:' || chr(10) || own") for a in (0, 1, 3)), *((a, "any", 6, "IR", "'user:' || chr(10) || told('assistant')") for a in (0, 1, 3))],
}


def _way(before: int, role: str, cost: int, edits: str, lines: str) -> str:
    """A struct of cost with audit, and text so far; null where the way isn't open."""
    lines = lines.replace("told('user')", "'user:' || text || chr(10)").replace("told('assistant')", "'assistant:' || text || chr(10)").replace("own", "role || ':' || text || chr(10)")
    more = f"{cost} + 3 * CAST(truncated AS INTEGER)" if role else f"{cost}"
    if_open = {"": "true", "any": "NOT gone"}.get(role, f"NOT gone AND role[1] = '{role}'")
    return f"CASE WHEN s{before} IS NOT NULL AND {if_open} THEN {{'k': lpad(CAST(CAST(s{before}.k[1:12] AS BIGINT) + {more} AS VARCHAR), 12, '0') || s{before}.k[13:] || '{edits}', 't': s{before}.t || {lines}}} END"


def _least(ways: list[str]) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


#: crc32 as in SHARDING. One row for each step of each conversation holds the best audit and text of each state.
CONVERSATIONS = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS c,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS part FROM conversations, t),
hurt AS (SELECT c, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role, CASE WHEN part = 1 THEN '' WHEN part = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM raw, range(0, 2) x(copy) WHERE part <> 0 AND (copy = 0 OR part = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM hurt),
placed AS (SELECT *, k > min(k) OVER (PARTITION BY c, role, text) AS again, NOT regexp_matches(text, '[^ 	-
]') AS blank FROM numbered),
f AS (SELECT *, again AND NOT blank AS duplicate, blank OR again AS gone, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS truncated,
  CASE WHEN k > 1 AND lag(role[1]) OVER (PARTITION BY c ORDER BY k) || role[1] NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM placed),
walk AS (SELECT c, CAST(0 AS BIGINT) AS k, {{'k': '000000000000', 't': ''}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s1, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s3 FROM (SELECT DISTINCT c FROM raw)
  UNION ALL SELECT f.c, f.k, {", ".join(_least([_way(*x) for x in WAYS[j]]) for j in range(4))} FROM walk JOIN f ON f.c = walk.c AND f.k = walk.k + 1),
last AS (SELECT c, {_least(["s0", "CASE WHEN s1 IS NOT NULL THEN {'k': lpad(CAST(CAST(s1.k[1:12] AS BIGINT) + 6 AS VARCHAR), 12, '0') || s1.k[13:] || 'II', 't': s1.t || 'user:' || chr(10) || 'assistant:' || chr(10)} END",
  "CASE WHEN s2 IS NOT NULL THEN {'k': lpad(CAST(CAST(s2.k[1:12] AS BIGINT) + 3 AS VARCHAR), 12, '0') || s2.k[13:] || 'I', 't': s2.t || 'assistant:' || chr(10)} END", "s3"])} AS s FROM walk QUALIFY k = max(k) OVER (PARTITION BY c)),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, sum(illegal) AS illegal FROM f GROUP BY 1)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(s.k[1:12] AS BIGINT) AS cost, s.k[13:] AS audit, sha256(s.t[1:-2]) AS repaired_sha256 FROM (SELECT DISTINCT c, conv_id FROM raw) ids JOIN last USING (c) LEFT JOIN counts USING (c)
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op2_quality_rules": QUALITY,
    "op3_suffix_dedup": SUFFIX_DEDUP,
    "op5_sharding": SHARDING,
    "op8_recompression": RECOMPRESSION,
    "op10_ngram_join": NGRAM_JOIN,
    "op11_conversation_repair": CONVERSATIONS,
    "op13_line_dedup": LINE_DEDUP,
}
