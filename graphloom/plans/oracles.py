"""Builders of the longer SQL that the registered queries are held against: clusters and trees, searches in graphs, chunks and caches.

Sequential rules are recursive queries: one row for each group holds the state of a scan, and each step applies the rule to the next item. Levels of a tree,
whose number is bounded, follow each other as generated queries.
"""

from __future__ import annotations

from graphloom.functions.text import PART_BREAK, SOURCE_BREAK


def literal(text: str) -> str:
    """A string with line breaks as SQL."""
    return " || ".join("chr(10)" if part == "\n" else f"'{part}'" for part in _pieces(text))


def _pieces(text: str) -> list[str]:
    out: list[str] = []
    for c in text:
        if c == "\n" or not out or out[-1] == "\n":
            out.append(c)
        else:
            out[-1] += c
    return out


def clusters(rows: str, name: str, threshold: float, largest: int, least: int) -> str:
    """Queries up to {name}_kept (grp, id, first), the clusters of rows (grp, id, v): a scan of each group's pairs by falling similarity."""
    x = name
    return f"""{x}_pairs AS (SELECT a.grp, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM {rows} a JOIN {rows} b ON a.grp = b.grp AND a.id < b.id),
{x}_order AS (SELECT grp, a, b, row_number() OVER (PARTITION BY grp ORDER BY s DESC, a, b) AS k FROM {x}_pairs WHERE s >= {threshold}),
{x}_scan AS (SELECT DISTINCT grp, 0::BIGINT AS k, []::VARCHAR[] AS gone, []::STRUCT(b VARCHAR, a VARCHAR)[] AS joined, MAP([]::VARCHAR[], []::BIGINT[]) AS sizes FROM {rows}
  UNION ALL SELECT grp, k, CASE WHEN over THEN gone ELSE list_append(gone, b) END, CASE WHEN over OR n > {largest} THEN joined ELSE list_append(joined, {{'b': b, 'a': a}}) END,
    CASE WHEN over OR n > {largest} THEN sizes ELSE map_concat(sizes, MAP([a], [n])) END
  FROM (SELECT s.grp, o.k, o.a, o.b, s.gone, s.joined, s.sizes, list_contains(s.gone, o.a) OR list_contains(s.gone, o.b) AS over, coalesce(s.sizes[o.a], 1) + coalesce(s.sizes[o.b], 1) AS n
    FROM {x}_scan s JOIN {x}_order o ON o.grp = s.grp AND o.k = s.k + 1)),
{x}_end AS (SELECT * FROM {x}_scan QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC) = 1),
{x}_into AS (SELECT grp, j.b, j.a FROM (SELECT grp, unnest(joined) AS j FROM {x}_end)),
{x}_walk AS (SELECT grp, id, id AS first FROM {rows} UNION ALL SELECT w.grp, w.id, i.a FROM {x}_walk w JOIN {x}_into i ON i.grp = w.grp AND i.b = w.first),
{x}_last AS (SELECT w.grp, w.id, w.first, count(*) OVER (PARTITION BY w.grp, w.first) AS members FROM {x}_walk w JOIN {x}_end e ON e.grp = w.grp WHERE NOT list_contains(e.gone, w.first)),
{x}_kept AS (SELECT grp, id, first FROM {x}_last WHERE members >= {least} OR id = first)"""


def tree(threshold: float, largest: int = 10, least: int = 2, deepest: int = 5, least_nodes: int = 0) -> str:
    """Queries up to tree (grp, cluster_id, depth, members, children, parent_id, v, text, internal_similarity, is_root) over nodes, for groups of so many nodes at least."""
    out = [f"n0 AS (SELECT namespace AS grp, node_id AS id, v, coalesce(content, '') AS text FROM nodes QUALIFY count(*) OVER (PARTITION BY namespace) >= {least_nodes})"]
    for d in range(deepest + 1):
        only = "" if d == 0 else f" WHERE first IN (SELECT first FROM c{d}_kept GROUP BY first HAVING count(*) > 1)"
        out.append(clusters(f"n{d}", f"c{d}", threshold, largest, least))
        out.append(f"""m{d} AS (SELECT n.grp, n.id, n.v, n.text, k.first FROM n{d} n JOIN (SELECT * FROM c{d}_kept{only}) k ON k.grp = n.grp AND k.id = n.id),
mean{d} AS (SELECT first, list(x ORDER BY place) AS v FROM (SELECT first, place, avg(x) AS x FROM (SELECT first, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM m{d}) GROUP BY 1, 2) GROUP BY 1),
within{d} AS (SELECT a.first, avg(list_cosine_similarity(a.v, b.v)) AS s FROM m{d} a JOIN m{d} b ON a.first = b.first AND a.id < b.id GROUP BY 1),
l{d} AS (SELECT grp, '{d}:' || regexp_replace(first, '^[0-9]+:', '') AS cluster_id, {d} AS depth, list(id ORDER BY id) AS members, any_value(mean{d}.v) AS v, string_agg(text, {literal(PART_BREAK if d == 0 else SOURCE_BREAK)} ORDER BY id) AS text, coalesce(any_value(s), 1.0) AS internal_similarity
  FROM m{d} JOIN mean{d} USING (first) LEFT JOIN within{d} USING (first) GROUP BY grp, first),
n{d + 1} AS (SELECT grp, cluster_id AS id, v, text FROM l{d} QUALIFY count(*) OVER (PARTITION BY grp) > 1)""")
    levels = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(deepest + 1))
    out.append(f"""levels AS ({levels}),
ups AS (SELECT cluster_id AS parent_id, unnest(members) AS cluster_id FROM levels WHERE depth > 0),
tree AS (SELECT grp, l.cluster_id, depth, CASE WHEN depth = 0 THEN members ELSE [] END AS members, CASE WHEN depth > 0 THEN members ELSE [] END AS children, ups.parent_id, v, text, internal_similarity,
  depth = max(depth) OVER (PARTITION BY grp) AS is_root FROM levels l LEFT JOIN ups ON ups.cluster_id = l.cluster_id)""")
    return ",\n".join(out)


SIBLINGS = """siblings AS (SELECT parent_id, src, dst, 'semantic' AS edge_type, s AS similarity, round(1 / s, 6) AS weight
  FROM (SELECT a.parent_id, a.cluster_id AS src, b.cluster_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM tree a JOIN tree b ON a.parent_id = b.parent_id AND a.cluster_id < b.cluster_id) WHERE s >= {least})"""

DOWN = """down AS (SELECT p.cluster_id AS src, CASE WHEN c.depth = 0 THEN c.members[1] ELSE c.cluster_id END AS dst, p.grp AS namespace, 'parentchild' AS edge_type,
  round(list_cosine_similarity(c.v, p.v), 6) AS similarity FROM tree c JOIN tree p ON c.parent_id = p.cluster_id)"""


def shortest(edges: str, starts: str, name: str, rounds: int) -> str:
    """{name} (q, node, distance, path): least distances from starts (q, node) along edges (src, dst, length), by that many rounds over all nodes reached."""
    return f"""{name}_steps AS (SELECT src, dst, length FROM {edges} UNION ALL SELECT DISTINCT x, x, 0.0::DOUBLE FROM (SELECT src AS x FROM {edges} UNION SELECT dst FROM {edges} UNION SELECT node FROM {starts})),
{name}_rounds AS (SELECT q, node, 0.0::DOUBLE AS distance, [node] AS path, 0 AS round FROM {starts}
  UNION ALL SELECT r.q, e.dst, min(r.distance + e.length), (min({{'d': r.distance + e.length, 'p': CASE WHEN e.dst = r.node THEN r.path ELSE list_append(r.path, e.dst) END}})).p, r.round + 1
    FROM {name}_rounds r JOIN {name}_steps e ON e.src = r.node WHERE r.round < {rounds} GROUP BY r.q, e.dst, r.round),
{name} AS (SELECT q, node, distance, path FROM {name}_rounds WHERE round = {rounds})"""


def settled(edges: str, starts: str, name: str, steps: int) -> str:
    """{name} (q, node, distance, path): what a search from starts (q, node) reaches along edges (q, src, dst, length) while it settles so many nodes, of equally near ones the greatest first."""
    return f"""{name}_steps AS (SELECT q, src, dst, length, false AS stay FROM {edges} UNION ALL SELECT DISTINCT q, x, x, 0.0::DOUBLE, true FROM (SELECT q, src AS x FROM {edges} UNION SELECT q, dst FROM {edges} UNION SELECT q, node FROM {starts})),
{name}_rounds AS (SELECT q, node, 0.0::DOUBLE AS distance, [node] AS path, false AS done, 0 AS round FROM {starts}
  UNION ALL SELECT p.q, e.dst, min(p.distance + e.length), (min({{'d': p.distance + e.length, 'p': CASE WHEN e.stay THEN p.path ELSE list_append(p.path, e.dst) END}})).p, bool_or(e.stay AND (p.done OR p.next)), p.round + 1
    FROM (SELECT *, NOT done AND row_number() OVER (PARTITION BY q ORDER BY done, distance, node DESC) = 1 AS next FROM {name}_rounds WHERE round < {steps}) p
    JOIN {name}_steps e ON e.q = p.q AND e.src = p.node AND (e.stay OR p.next) GROUP BY p.q, e.dst, p.round),
{name} AS (SELECT q, node, distance, path FROM {name}_rounds WHERE round = {steps})"""


#: White space as Python strips it, for a class of characters.
SPACES = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def chunks(size: int, overlap: int, least: int, back: int, ahead: int, breaks: tuple[bytes, ...]) -> str:
    """The chunks of documents. A text is held as hex digits and as a string of one ASCII character for each byte, so that places are bytes."""
    inside = lambda at: f"({at} > 0 AND {at} < n AND substr(h, 2 * ({at}) + 1, 1) IN ('8', '9', 'A', 'B'))"
    snap = lambda at: f"(CASE WHEN NOT {inside(at)} THEN {at} WHEN NOT {inside(f'{at} - 1')} THEN {at} - 1 WHEN NOT {inside(f'{at} - 2')} THEN {at} - 2 ELSE {at} - 3 END)"
    marks = [" || ".join("chr(10)" if c == 10 else f"'{chr(c)}'" for c in reversed(p)) for p in breaks]
    ends = " ".join(f"WHEN strpos(w, {m}) > 0 AND high - strpos(w, {m}) + 1 > start + {least} THEN high - strpos(w, {m}) + 1" for m in marks)
    return rf"""
WITH RECURSIVE trimmed AS (SELECT row_number() OVER () AS r, doc_id, {stripped("coalesce(text, '')")} AS t FROM documents),
d AS (SELECT r, doc_id, t, hex(encode(t)) AS h, strlen(t) AS n, array_to_string(list_transform(regexp_extract_all(hex(encode(t)), '..'),
  lambda x: CASE x WHEN '20' THEN ' ' WHEN '0A' THEN chr(10) WHEN '2E' THEN '.' WHEN '21' THEN '!' WHEN '3F' THEN '?' ELSE 'x' END), '') AS b FROM trimmed WHERE t <> ''),
cut AS (SELECT r, CAST(NULL AS BIGINT) AS start, 0::BIGINT AS stop, 0::BIGINT AS ahead FROM d WHERE n > {size}
  UNION ALL SELECT r, ahead, stop, CAST(greatest({snap(f"greatest(0, stop - {overlap})")}, {snap("(ahead + 4)")}) AS BIGINT)
  FROM (SELECT r, n, h, start AS ahead, CAST(CASE WHEN target >= n THEN n {ends} ELSE {snap("target")} END AS BIGINT) AS stop
    FROM (SELECT *, reverse(substr(b, low + 1, high - low)) AS w FROM (SELECT *, {snap(f"greatest(0, target - {back})")} AS low, {snap(f"least(n, target + {ahead})")} AS high
      FROM (SELECT c.r, d.n, d.h, d.b, c.ahead AS start, least(c.ahead + {size}, d.n) AS target FROM cut c JOIN d ON d.r = c.r WHERE c.ahead < d.n AND (c.start IS NULL OR c.stop < d.n)))))),
kept AS (SELECT c.r, c.start, c.stop, {stripped("decode(from_hex(substr(h, 2 * c.start + 1, 2 * (c.stop - c.start))))")} AS content FROM cut c JOIN d ON d.r = c.r WHERE c.start IS NOT NULL AND (c.stop - c.start >= {least} OR c.stop >= n)
  UNION ALL SELECT r, 0, n, t FROM d WHERE n <= {size})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY kept.r ORDER BY start) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY kept.r) AS INTEGER) AS total, content, CAST(start AS INTEGER) AS start_offset, CAST(stop AS INTEGER) AS end_offset FROM kept JOIN d ON d.r = kept.r"""


def lru(operations: str, capacity: int, seconds: float) -> str:
    """Metrics of each cache after all operations (cache, k, op, key, seen): a scan with the entries, least recently used first, as its state."""
    return f"""scan AS (SELECT DISTINCT cache, 0::BIGINT AS k, []::STRUCT(key VARCHAR, ends DOUBLE)[] AS entries, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS evictions, 0::BIGINT AS expirations FROM {operations}
  UNION ALL SELECT cache, k, CASE WHEN op = 'put' THEN list_append(CASE WHEN pushed THEN others[2:] ELSE others END, {{'key': key, 'ends': seen + {seconds}}}) WHEN hit THEN list_append(others, own) ELSE others END,
    hits + CAST(hit AS BIGINT), misses + CAST(op = 'get' AND NOT hit AS BIGINT), evictions + CAST(pushed AS BIGINT), expirations + CAST(op = 'get' AND own IS NOT NULL AND NOT hit AS BIGINT)
  FROM (SELECT *, op = 'get' AND own IS NOT NULL AND coalesce(seen <= own.ends, false) AS hit, op = 'put' AND own IS NULL AND len(others) >= {capacity} AS pushed
    FROM (SELECT s.cache, o.k, o.op, o.key, o.seen, hits, misses, evictions, expirations, list_filter(entries, lambda x: x.key = o.key)[1] AS own, list_filter(entries, lambda x: x.key <> o.key) AS others
      FROM scan s JOIN {operations} o ON o.cache = s.cache AND o.k = s.k + 1)))
SELECT cache, hits, misses, evictions, expirations, CAST(len(entries) AS BIGINT) AS size, hits / (hits + misses) AS hit_rate FROM scan QUALIFY row_number() OVER (PARTITION BY cache ORDER BY k DESC) = 1"""
