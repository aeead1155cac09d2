"""DuckDB twins of the registered queries (the correctness oracle).

Each twin restates the query in plain ANSI SQL over the driver's tables,
written independently of the Spark plan. Shared pieces are CTE fragments.
Doubles are rounded to 6 places on both sides; arrays are rendered with a
separator; timestamps as 'YYYY-MM-DD HH:MM:SS.ffffff'.
"""

from __future__ import annotations

from .sources.adapters import EVENTS, ORDERS, Profile


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def hash_unit(*parts: str) -> str:
    """Twin of functions.exprs.hash_unit."""
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967295.0)"


def hash_key(*parts: str) -> str:
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"md5({key})"


def _publish(p: Profile, iid: str = "iid") -> str:
    return (f"(DATE '{p.base_date}' + CAST((({iid} // 2) * {p.publish_step}) % {p.publish_mod} AS INTEGER))")


def inter_sql(name: str) -> str:
    if name == "events":
        return f"""SELECT DISTINCT user_id AS uid, k AS iid,
  CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS rating, ts
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
WHERE ts >= {_publish(EVENTS, 'k')}"""
    return f"""SELECT DISTINCT o_custkey AS uid, l_partkey AS iid,
  CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS rating, o_orderdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= {_publish(ORDERS, 'l_partkey')}"""


def profile(name: str) -> Profile:
    return EVENTS if name == "events" else ORDERS


def items_sql(name: str) -> str:
    p = profile(name)
    return f"""SELECT iid, 'title-' || CAST(iid // 2 AS VARCHAR) AS title, {_publish(p)} AS publish_time
FROM (SELECT DISTINCT iid FROM inter_{name})"""


def base_ctes(name: str) -> str:
    """inter_<name>, items_<name> (with title_idx)."""
    return f"""inter_{name} AS ({inter_sql(name)}),
items0_{name} AS ({items_sql(name)}),
items_{name} AS (SELECT i.*, t.title_idx FROM items0_{name} i JOIN
   (SELECT title, CAST(dense_rank() OVER (ORDER BY title) - 1 AS BIGINT) AS title_idx
    FROM (SELECT DISTINCT title FROM items0_{name})) t USING (title))"""


def cohort_ctes(name: str, fake_cold: str | None = None, env: str | None = None, eval_end: str | None = None) -> str:
    """... -> cohort_<name>(uid, iid, rating, ts, title, title_idx, publish_time, env)."""
    p = profile(name)
    pub = "min(publish_time)" if p.publish_rule == "min" else "max(publish_time)"
    end = eval_end or p.eval_end
    ev_end = f" AND ts <= TIMESTAMP '{end}'" if end else ""
    join = f"LEFT JOIN items_{name} i USING (iid)"
    default_env = f"""env_{name} AS (SELECT * FROM (SELECT j.*, CASE
     WHEN c.title_idx IS NOT NULL AND ts >= TIMESTAMP '{p.eval_start}'{ev_end} THEN 3
     WHEN c.title_idx IS NULL AND ts >= TIMESTAMP '{p.train_start}' AND ts < TIMESTAMP '{p.eval_start}' THEN 0
     WHEN c.title_idx IS NULL AND ts >= TIMESTAMP '{p.eval_start}'{ev_end} THEN 1 END AS env
   FROM joined_{name} j LEFT JOIN cold_{name} c USING (title_idx)) WHERE env IS NOT NULL)"""
    joined = f"""joined_{name} AS (SELECT x.uid, x.iid, x.rating, x.ts, i.title, i.title_idx, i.publish_time
   FROM inter_{name} x {join}),
cold_{name} AS (SELECT title_idx FROM joined_{name} WHERE title_idx IS NOT NULL GROUP BY title_idx
   HAVING CAST({pub} AS TIMESTAMP) >= TIMESTAMP '{p.cold_cutoff}' AND min(ts) >= TIMESTAMP '{p.cold_cutoff}'),
{env or default_env}"""
    src = f"env_{name}"
    if fake_cold:
        joined += "," + fake_cold
        src = f"fake_{name}"
    fu = lambda s, k: f"(SELECT * FROM {s} WHERE uid IN (SELECT uid FROM {s} GROUP BY uid HAVING count(*) >= {k}))"
    fi = lambda s, k: (f"(SELECT * FROM {s} WHERE iid IN (SELECT iid FROM {s} GROUP BY iid HAVING count(*) >= {k})"  # noqa: E731
                       f" AND iid NOT IN (SELECT iid FROM (SELECT * FROM {s} WHERE iid IN (SELECT iid FROM {s} GROUP BY iid "
                       f"HAVING count(*) >= {k})) WHERE env = 0 GROUP BY iid HAVING count(*) < {k}))")
    if p.filter_order == "items_users":
        step1 = f"f1_{name} AS {fi(src, p.item_min)}"
        step2 = f"cohort_{name} AS {fu(f'f1_{name}', p.user_min)}"
    else:
        step1 = f"f1_{name} AS {fu(src, p.user_min)}"
        step2 = f"cohort_{name} AS {fi(f'f1_{name}', p.item_min)}"
    return f"{joined},\n{step1},\n{step2}"


def fake_cold_ctes(name: str, ratio: float = 0.2, seed: int = 2024) -> str:
    """W4 + D6: env_<name> -> fake_<name>."""
    return f"""wst_{name} AS (SELECT iid, max(CASE WHEN env = 0 THEN 1 ELSE 0 END) AS has_train FROM env_{name}
   WHERE env IN (0, 1) GROUP BY iid),
wrk_{name} AS (SELECT iid, row_number() OVER (ORDER BY {hash_key(str(seed), 'iid')}, iid) AS r FROM wst_{name}),
fk_{name} AS (SELECT iid FROM wst_{name} WHERE has_train = 0
   UNION SELECT iid FROM wrk_{name} WHERE r <= (SELECT CAST(floor(count(*) * {ratio}) AS BIGINT) FROM wst_{name})),
fake_{name} AS (SELECT * EXCLUDE (env, fk), CASE WHEN fk AND env = 1 THEN 2 ELSE env END AS env FROM
   (SELECT e.*, e.iid IN (SELECT iid FROM fk_{name}) AS fk FROM env_{name} e) WHERE NOT (fk AND env = 0))"""


def month_env(name: str, start: str, end: str, months: int = 12) -> str:
    return f"""rng_{name} AS (SELECT *, month(ts) + 12 * year(ts) AS mm FROM joined_{name}
   WHERE ts BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'),
env_{name} AS (SELECT * EXCLUDE (mm, late, cold), CASE WHEN cold AND late THEN 3 WHEN late THEN 1 ELSE 0 END AS env
   FROM (SELECT *, mm > (SELECT max(mm) FROM rng_{name}) - {months} AS late,
                coalesce(title_idx IN (SELECT title_idx FROM cold_{name}), false) AS cold FROM rng_{name})
   WHERE late OR NOT cold)"""


def samples_ctes(name: str, max_len: int = 15, cohorts: str | None = None) -> str:
    """... -> samples_<name>(uid, iid, rating, ts, title, env, label, c, his, his_title)."""
    return f"""{cohorts or cohort_ctes(name)},
ids_i_{name} AS (SELECT iid, CAST(dense_rank() OVER (ORDER BY iid) AS BIGINT) AS niid FROM (SELECT DISTINCT iid FROM cohort_{name})),
ids_u_{name} AS (SELECT uid, CAST(dense_rank() OVER (ORDER BY uid) AS BIGINT) AS nuid FROM (SELECT DISTINCT uid FROM cohort_{name})),
re_{name} AS (SELECT DISTINCT u.nuid AS uid, i.niid AS iid, c.rating, c.ts, c.title, c.env,
     CAST(c.rating >= 4 AS INTEGER) AS label
   FROM cohort_{name} c JOIN ids_i_{name} i USING (iid) JOIN ids_u_{name} u USING (uid)),
{history_ctes(f're_{name}', f'samples_{name}', max_len)}"""


def history_ctes(src: str, out: str, max_len: int = 15) -> str:
    """W1 restated: counter of earlier positives, RANGE frame on it."""
    return f"""c_{out} AS (SELECT *, CAST(COALESCE(SUM(label) OVER (PARTITION BY uid ORDER BY ts, iid, rating
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM {src}),
h_{out} AS (SELECT *,
     COALESCE(list(iid) FILTER (WHERE label = 1) OVER w, []) AS h,
     COALESCE(list(COALESCE(title, '')) FILTER (WHERE label = 1) OVER w, []) AS ht
   FROM c_{out} WINDOW w AS (PARTITION BY uid ORDER BY c RANGE BETWEEN {max_len} PRECEDING AND 1 PRECEDING)),
{out} AS (SELECT * EXCLUDE (h, ht),
     CASE WHEN c <= {max_len - 1} THEN list_concat([CAST(0 AS BIGINT)], h) ELSE h END AS his,
     CASE WHEN c <= {max_len - 1} THEN list_concat([''], ht) ELSE ht END AS his_title
   FROM h_{out})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def splits_ctes(name: str) -> str:
    """samples -> splits_<name> (adds part): W3 for events, W2 for both."""
    if name == "events":
        warm = f"""wi_{name} AS (SELECT iid, row_number() OVER (ORDER BY {hash_key("2024", "iid")}, iid) AS r
     FROM (SELECT DISTINCT iid FROM samples_{name} WHERE env = 1)),
warm_{name} AS (SELECT * FROM samples_{name} WHERE env = 1 AND iid IN (SELECT iid FROM wi_{name}
     WHERE r <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM wi_{name})))"""
    else:
        warm = f"warm_{name} AS (SELECT * FROM samples_{name} WHERE env = 1)"
    return f"""{warm},
mixed_{name} AS (SELECT * FROM warm_{name} UNION ALL SELECT * FROM samples_{name} WHERE env = 3),
splits_{name} AS (SELECT *, 'train' AS part FROM samples_{name} WHERE env = 0
  UNION ALL
  SELECT * EXCLUDE (rn, cnt), CASE WHEN rn < cnt // 2 THEN 'valid' ELSE 'test' END AS part FROM (
    SELECT *, row_number() OVER (PARTITION BY iid ORDER BY ts, uid, rating) - 1 AS rn,
           count(*) OVER (PARTITION BY iid) AS cnt FROM mixed_{name}))"""


def all_ctes(name: str) -> str:
    return ",\n".join([base_ctes(name), samples_ctes(name), splits_ctes(name)])


def part_sql(name: str, which: str, num: int = 0) -> str:
    cond = f"part = '{which}'"
    if which != "train" and num:
        cond += f" AND env = {1 if num == 1 else 3}"
    return f"(SELECT * FROM splits_{name} WHERE {cond})"


def templates_sql(name: str, mode: str | None) -> str:
    """G0 (+ valid membership): latest train row per user with >= 10 train rows."""
    tr = part_sql(name, "train")
    va = part_sql(name, "valid")
    cond = ""
    if mode == "in":
        cond = f" AND uid IN (SELECT uid FROM {va})"
    elif mode == "out":
        cond = f" AND uid NOT IN (SELECT uid FROM {va})"
    return f"""(SELECT * EXCLUDE (rk, n) FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, iid ASC) AS rk,
   count(*) OVER (PARTITION BY uid) AS n FROM {tr}) WHERE rk = 1 AND n >= 10{cond})"""


def candidates_ctes(name: str, version: str = "v0", n: int = 80, seed: int = 2000,
                    items_from: str | None = None, out: str = "cand") -> str:
    mode = {"v0": None, "v1": "out", "v2": "in", "v3": "out", "v4": "in"}[version]
    fresh = version in ("v0", "v3", "v4")
    items_src = items_from or part_sql(name, "test")
    # fresh samples: a walk a * (j + b)^3 + c modulo the smallest prime >= U that leaves 2 by 3
    draw = lambda letter: f"CAST(floor({hash_unit(str(seed), repr(version), repr(letter), 'iid')} * p) AS BIGINT) % p"
    if fresh:
        walk = f"""nu_{out} AS (SELECT count(*) AS u FROM rk_{out}),
pc_{out} AS (SELECT unnest(range(greatest(u, 2), u + 800)) AS c FROM nu_{out}),
pr_{out} AS (SELECT min(c) AS p FROM pc_{out} WHERE c % 3 = 2 AND c NOT IN (
   SELECT c FROM pc_{out}, (SELECT unnest(range(2, 3000)) AS d) WHERE d * d <= c AND c % d = 0)),
ab_{out} AS (SELECT iid, title, p, u, greatest(1, {draw('a')}) AS a, {draw('b')} AS b, {draw('c')} AS c FROM it_{out}, pr_{out}, nu_{out}),
wj_{out} AS (SELECT *, (j + b) % p AS y FROM (SELECT *, unnest(range(0, {n} + p - u)) AS j FROM ab_{out})),
wk_{out} AS (SELECT iid, title, j, u, (a * ((y * y % p) * y % p) + c) % p AS r FROM wj_{out}),
sl_{out} AS (SELECT iid, title, r FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY j) AS k FROM wk_{out} WHERE r < u) WHERE k <= {n}),"""
    else:
        walk = f"sl_{out} AS (SELECT iid, title, j AS r FROM it_{out}, range(0, {n}) t(j)),"
    return f"""tm_{out} AS {templates_sql(name, mode)},
rk_{out} AS (SELECT *, row_number() OVER (ORDER BY {hash_key(str(seed), repr(version), 'uid')}, uid) - 1 AS r FROM tm_{out}),
it_{out} AS (SELECT iid, min(title) AS title FROM {items_src} GROUP BY iid),
{walk}
g_{out} AS (SELECT s.iid, s.title, t.* EXCLUDE (iid, title, r) FROM sl_{out} s JOIN rk_{out} t USING (r)),
{out} AS (SELECT *, row_number() OVER (ORDER BY iid, uid) AS row_id FROM g_{out})"""


def vec_cols(prefix: str, dim: int) -> str:
    return ", ".join(f"{prefix}{k}" for k in range(dim))


def emb0_sql(nodes: str, dim: int, seed: int = 11, scale: float = 0.1) -> str:
    cols = ", ".join(f"({hash_unit(str(seed), 'node', str(k))} * 2.0 - 1.0) * {scale} AS v{k}" for k in range(dim))
    return f"(SELECT node, {cols} FROM {nodes})"


def spmm_sql(adj: str, src: str, dim: int) -> str:
    cols = ", ".join(f"sum(e.v{k} * a.w) AS v{k}" for k in range(dim))
    return f"(SELECT a.dst AS node, {cols} FROM {adj} a JOIN {src} e ON e.node = a.src GROUP BY a.dst)"


def propagate_ctes(adj: str, e0: str, out: str, layers: int, dim: int) -> str:
    parts = [f"{out}_l0 AS (SELECT * FROM {e0})"]
    for l in range(1, layers + 1):
        parts.append(f"{out}_l{l} AS {spmm_sql(adj, f'{out}_l{l-1}', dim)}")
    union = " UNION ALL ".join(f"SELECT * FROM {out}_l{l}" for l in range(layers + 1))
    cols = ", ".join(f"sum(v{k}) * (CAST(1 AS DOUBLE) / {layers + 1}) AS v{k}" for k in range(dim))
    parts.append(f"{out} AS (SELECT node, {cols} FROM ({union}) GROUP BY node)")
    return ",\n".join(parts)


def adjacency_ctes(train: str, out: str = "adj") -> str:
    return f"""{out}_one AS (SELECT uid * 2 AS a, iid * 2 + 1 AS b, sum(CAST(label AS DOUBLE)) AS v FROM {train} WHERE label > 0 GROUP BY ALL),
{out}_both AS (SELECT a AS src, b AS dst, v FROM {out}_one UNION ALL SELECT b AS src, a AS dst, v FROM {out}_one),
{out}_deg AS (SELECT src, sum(v) AS d FROM {out}_both GROUP BY src),
{out} AS (SELECT e.src, e.dst, CASE WHEN d1.d > 0 AND d2.d > 0 THEN e.v / sqrt(d1.d * d2.d) ELSE 0.0 END AS w
   FROM {out}_both e JOIN {out}_deg d1 ON d1.src = e.src JOIN {out}_deg d2 ON d2.src = e.dst)"""


def vec_text(prefix: str, dim: int, places: int = 6) -> str:
    return "concat_ws(',', " + ", ".join(f"printf('%.{places}f', {prefix}{k})" for k in range(dim)) + ")"


def sigmoid_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1.0 / (1.0 + exp(-({x}))) ELSE exp({x}) / (1.0 + exp({x})) END)"


def dot_sql(a: str, b: str, dim: int) -> str:
    expr = "0.0"
    for k in range(dim):
        expr = f"({expr} + {a}{k} * {b}{k})"
    return expr
