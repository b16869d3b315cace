"""DuckDB statements of the operators whose rules SQL can express in many steps:
conversation repair (11) and the Merkle manifest (13)."""

from __future__ import annotations

# Fixed value inside: the polynomial of CRC-32.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS tab)"""


def crc32_sql(x: str) -> str:
    """CRC-32 of an ASCII string, with ``crc_table`` among the tables."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, len({x}) + 1), lambda k: CAST(ord(substr({x}, k, 1)) AS UBIGINT))),
        lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT))"""


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
    WITH RECURSIVE
    {CRC_TABLE},
    k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
    h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql('id')} % 20 AS hit FROM k, crc_table),
    spoiled AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
                  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
                FROM h WHERE hit <> 0),
    convs AS (SELECT c, row_number() OVER () AS u FROM (SELECT DISTINCT conv_id AS c FROM conversations)),
    placed AS (SELECT u, s.*, row_number() OVER (PARTITION BY u ORDER BY turn NULLS FIRST, role, text, copy) AS i
               FROM spoiled s JOIN convs ON c IS NOT DISTINCT FROM s.conv_id),
    judged AS (SELECT *, left(role, 1) AS ini, trim(text, {WHITE_SQL}) AS bare,
                 row_number() OVER (PARTITION BY u, role, text ORDER BY i) > 1 AS seen FROM placed),
    r AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault,
            CASE WHEN i > 1 THEN coalesce(lag(ini) OVER (PARTITION BY u ORDER BY i) || ini, '') END AS pair FROM judged),
    sums AS (SELECT u, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank,
               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY u),
    -- the cheapest way to each state ('' nothing yet, s, u, a) before row i, as cost and edits in one string that sorts like both
    best(u, i, q, way) AS (
        SELECT u, CAST(1 AS BIGINT), '', '000000000000|' FROM convs
        UNION ALL
        SELECT u, i + 1, q2, min(printf('%012d|', cost) || edits) FROM (
            SELECT c.u, c.i, CASE e WHEN 'D' THEN c.q WHEN 'K' THEN x.ini ELSE CASE c.q WHEN 'u' THEN 'a' ELSE 'u' END END AS q2,
                   CAST(left(c.way, 12) AS BIGINT) + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND x.fault = 't' THEN 5 ELSE 0 END AS cost,
                   substr(c.way, 14) || e AS edits
            FROM (SELECT u, i, q, min(way) AS way FROM (
                    SELECT u, i, q, way FROM best
                    UNION ALL SELECT u, i, CASE q WHEN 'u' THEN 'a' ELSE 'u' END, printf('%012d|', CAST(left(way, 12) AS BIGINT) + 5) || substr(way, 14) || 'I' FROM best
                    UNION ALL SELECT u, i, CASE q WHEN 'u' THEN 'u' ELSE 'a' END, printf('%012d|', CAST(left(way, 12) AS BIGINT) + 10) || substr(way, 14) || 'II' FROM best) GROUP BY u, i, q) c
            JOIN r x ON x.u = c.u AND x.i = c.i,
            (VALUES ('D'), ('K'), ('R')) v(e)
            WHERE e = 'D' OR (x.fault IN ('f', 't') AND (e = 'R' OR x.ini = CASE c.q WHEN 'u' THEN 'a' ELSE 'u' END OR (x.ini = 's' AND c.q = ''))))
        GROUP BY u, i, q2),
    ended AS (SELECT b.u, min(CASE b.q WHEN 's' THEN printf('%012d|', CAST(left(way, 12) AS BIGINT) + 10) || substr(way, 14) || 'II'
                                       WHEN 'u' THEN printf('%012d|', CAST(left(way, 12) AS BIGINT) + 5) || substr(way, 14) || 'I' ELSE way END) AS way
              FROM best b LEFT JOIN sums s ON s.u = b.u WHERE b.i = coalesce(s.n, 0) + 1 GROUP BY b.u),
    done AS (SELECT u, CAST(left(way, 12) AS BIGINT) AS cost, substr(way, 14) AS audit FROM ended),
    steps AS (SELECT u, j, substr(audit, j, 1) AS e, len(replace(left(audit, j), 'I', '')) AS i, len(replace(left(audit, j), 'D', '')) AS o
              FROM (SELECT u, audit, unnest(range(1, len(audit) + 1)) AS j FROM done)),
    lines AS (SELECT s.u, s.j, s.o, s.e, CASE WHEN s.e = 'I' THEN '' ELSE r.text END AS text, r.role, r.ini,
                max(CASE WHEN s.o = 1 AND s.e = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.u) AS off
              FROM steps s LEFT JOIN r ON r.u = s.u AND r.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'),
    fixed AS (SELECT u, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole
              FROM lines GROUP BY u)
    SELECT c.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM convs c JOIN done USING (u) LEFT JOIN sums USING (u) LEFT JOIN fixed USING (u)"""


MERKLE = """
    WITH RECURSIVE
    {crc_table},
    d AS (SELECT row_number() OVER () AS u, *, CAST(doc_id AS VARCHAR) AS id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g FROM documents),
    c AS (SELECT d.*, {crc} AS crc FROM d, crc_table),
    e AS (SELECT u, doc_id, g, {head} AS head, {text} AS t, CASE WHEN crc % 5 = 0 THEN {low} ELSE {text} END AS t2 FROM c),
    l AS (SELECT u, doc_id, g, sha256(head || t) AS leaf, sha256(head || t2) AS again FROM e),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, u) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM l),
    nodes(g, lvl, i, n, h) AS (
        SELECT g, 0, r, n, leaf FROM leaves
        UNION ALL SELECT g, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, n, i // 16),
    subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(lvl, i, n, h) AS (
        SELECT 0, r, n, h FROM subs
        UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, n, i // 16),
    root AS (SELECT h FROM tops WHERE n = 1),
    steps AS (
        SELECT l.u, k.lvl, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (k.i < l.r // CAST(16 ** k.lvl AS BIGINT)), '') AS lf,
               coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (k.i > l.r // CAST(16 ** k.lvl AS BIGINT)), '') AS rt
        FROM leaves l JOIN nodes k ON k.g = l.g AND k.n > 1 AND k.i // 16 = l.r // CAST(16 ** (k.lvl + 1) AS BIGINT) GROUP BY l.u, k.lvl, l.r
        UNION ALL
        SELECT l.u, 100 + k.lvl, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (k.i < s.r // CAST(16 ** k.lvl AS BIGINT)), ''),
               coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (k.i > s.r // CAST(16 ** k.lvl AS BIGINT)), '')
        FROM leaves l JOIN subs s ON s.g = l.g JOIN tops k ON k.n > 1 AND k.i // 16 = s.r // CAST(16 ** (k.lvl + 1) AS BIGINT) GROUP BY l.u, k.lvl, s.r),
    ways AS (SELECT u, list(lf || '|' || rt ORDER BY lvl) AS way, string_agg(lf || rt, '' ORDER BY lvl) AS proof FROM steps GROUP BY u),
    folded AS (SELECT l.u, l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
        list_reduce(list_prepend(l.again, coalesce(w.way, [])), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root
        FROM leaves l JOIN subs s ON s.g = l.g JOIN root ON true LEFT JOIN ways w ON w.u = l.u)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR) END"


MERKLE = MERKLE.format(crc_table=CRC_TABLE, crc=crc32_sql("id"), head=" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars")), text=_field("text"),
                       low=_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
