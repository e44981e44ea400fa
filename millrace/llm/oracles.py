"""DuckDB SQL over whole tables for what SQL can express: op1, op4 and op6 in full, and the fixed columns of op2, op3 and op10."""

from __future__ import annotations

_S = r"\x20\x09-\x0D"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')"
_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_S}]+')"


NEAR_DEDUP = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b, c = x.n AND c = y.n AS same FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept, least(d.doc_id, coalesce(k.a, d.doc_id)) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id LEFT JOIN (SELECT b, min(a) AS a FROM e WHERE same GROUP BY b) k ON k.b = d.doc_id
"""

SUFFIX_REPEATS = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + 400]) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
q AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM q),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, z, h, n, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM s JOIN t USING (doc_id)),
c AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(h[2 * b + 1 : 2 * a], '' ORDER BY a) || max(h)[2 * max(z) + 1 :] AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN c USING (doc_id)
"""

LINE_DEDUP = f"""
WITH l AS MATERIALIZED ({_LINES}),
w AS MATERIALIZED (SELECT doc_id, k, x, n, row_number() OVER o AS p, sum(n) OVER o AS c FROM (SELECT doc_id, k, regexp_replace(x, '^[{_S}]+|[{_S}]+$', '', 'g') AS x, len({_words('x')}) AS n FROM l) WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
v AS MATERIALIZED (SELECT a.doc_id, a.p AS a, min(b.p) AS z FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 24 WHERE b.c - a.c + a.n >= 25 GROUP BY 1, 2
  UNION SELECT a.doc_id, max(b.p), a.p FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - 24 AND a.p WHERE a.c - b.c + b.n >= 25 GROUP BY 1, 3),
r AS MATERIALIZED (SELECT v.doc_id, min(k) AS a, max(k) AS z, string_agg(x, chr(10) ORDER BY p) AS run FROM v JOIN w ON w.doc_id = v.doc_id AND w.p BETWEEN v.a AND v.z GROUP BY v.doc_id, v.a, v.z),
f AS (SELECT run, min(struct_pack(d := doc_id, a := a, z := z)) AS f FROM r GROUP BY run HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS k FROM r JOIN f USING (run) WHERE doc_id <> f.d OR a > f.z),
t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS t FROM l ANTI JOIN g USING (doc_id, k) GROUP BY doc_id),
u AS (SELECT d.doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS t FROM documents d LEFT JOIN t USING (doc_id))
SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, length(t) AS n_kept_chars, len(string_split(t, chr(10))) AS n_kept_lines, sha256(t) AS kept_sha256 FROM u
"""


def url_rules(rules: list[tuple[str, str]]) -> str:
    case = ""
    for _, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block", x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        case += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'"
    return f"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM a), c AS (SELECT page_id, translate(h, '{_AZ}', '{_AZ.lower()}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE{case} END AS rule FROM c"""


QUALITY_BASE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, text, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
m AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
u AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, x, count(*) AS c FROM ({_LINES}) WHERE regexp_matches(x, '[^{_S}]') GROUP BY 1, 2) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id)
"""


def _crc32(x: str) -> str:
    """crc32 of a text column of ASCII characters, by table."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    bytes_ = f"list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::BIGINT, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(({table})[(xor(c, b) & 255) + 1]::BIGINT, c >> 8)), 4294967295)"


CLASS_LM_BASE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_crc32('doc_id::VARCHAR')} % 7 = 2 AS held_out, {_words(_LOWER)} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS x FROM d),
c AS MATERIALIZED (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT sum(c) FROM c)::BIGINT AS train_tokens,
round(sum(log10((coalesce(c, 0) + 1) / ((SELECT sum(c) FROM c) + (SELECT count(*) FROM c) + 1))), 4) AS base_score FROM t LEFT JOIN c USING (x) GROUP BY doc_id
"""
