"""DuckDB SQL of the document operators that SQL can express."""

from __future__ import annotations

from . import secrets

EXACT_DEDUP = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM t"""

TOP_K = """
    WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def secret_scan() -> str:
    """Matches fenced by U+E000, the text split there, places as running lengths."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ctes, found = [], []
    for k, (kind, pattern) in enumerate(zip(secrets.KINDS, secrets.PATTERNS)):
        ctes.append(f"""f{k} AS (SELECT doc_id, string_split(regexp_replace(body, {quoted('(' + pattern + ')')}, chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS parts FROM t),
s{k} AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, parts[i] AS value
   FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM f{k}))""")
        long = f" WHERE length(regexp_extract(value, {quoted(secrets.ASSIGN_VALUE)}, 1)) >= 8" if k == 0 else ""
        found.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, a, a + length(value) AS b FROM s{k}{long}")
    text = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{secrets.KINDS[k]}" for k in range(secrets.BASE))
    return f"""WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS body FROM documents),
{', '.join(ctes)},
a AS ({' UNION ALL '.join(found)}),
g AS (SELECT doc_id, {counts}, {text.replace("',' ORDER", "',' ORDER")} FILTER (k < {secrets.BASE}) AS base, {text} AS spans FROM a GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f"coalesce(n_{secrets.KINDS[k]}, 0) AS n_{secrets.KINDS[k]}" for k in range(secrets.BASE))},
   sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


SUFFIX_DEDUP = """
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents),
    n AS (SELECT doc_id, body, length(body) // 2 AS size FROM t),
    w AS (SELECT doc_id, body, unnest(range(0, size - 399)) AS p FROM n WHERE size >= 400),
    h AS (SELECT doc_id, p, md5(substr(body, 2 * p + 1, 800)) AS m FROM w),
    r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS held FROM h) WHERE held > 1),
    g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
    i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
    u AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, run),
    k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM u
          UNION ALL SELECT n.doc_id, coalesce(max(u.b), 0) AS a, any_value(n.size) AS b FROM n LEFT JOIN u USING (doc_id) GROUP BY n.doc_id),
    kept AS (SELECT doc_id, string_agg(substr(body, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.a, k.b) AS rest FROM k JOIN n USING (doc_id) GROUP BY doc_id),
    gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS runs, string_agg(a || ':' || b, ',' ORDER BY a) AS places FROM u GROUP BY doc_id)
    SELECT n.doc_id, n.size AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
           sha256(unhex(rest)) AS kept_sha256, coalesce(places, '') AS removed
    FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

DECONTAMINATE = r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
           FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM iw),
    dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
    h AS (SELECT rid, i, dw.m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.t = iw.t),
    hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM h) GROUP BY rid),
    hi AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, hw.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

HARD_NEGATIVES = """
    WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
          FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b, p.score AS ps, s.b AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
          FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3"""

ORACLE = {"op13_hard_negatives": HARD_NEGATIVES, "op11_decontaminate": DECONTAMINATE, "op3_exact_dedup": EXACT_DEDUP, "op4_topk_search": TOP_K, "op7_secret_scan": secret_scan(), "op10_suffix_dedup": SUFFIX_DEDUP}
