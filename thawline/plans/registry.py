"""Registered queries (one or more per operator of the inventory) and their
DuckDB twins. Output columns are aliased identically on both sides."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..functions.exprs import arr_text, r6, sigmoid, ts_text
from . import prep

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _hist_out(df: DataFrame) -> DataFrame:
    return df.select("uid", "iid", "rating", "label", ts_text("ts").alias("ts"),
                     F.col("n_pos_before").cast("long").alias("n_pos_before"),
                     arr_text("his").alias("his"), arr_text("his_title", "|").alias("his_title"))


def _hist_sql(out: str) -> str:
    return f"""SELECT uid, iid, rating, label, {O.ts_text('ts')} AS ts, c AS n_pos_before,
  array_to_string(his, ',') AS his, array_to_string(his_title, '|') AS his_title FROM {out}"""


# ---------------------------------------------------------------- W1 slice
for _name in ("events", "orders"):
    _key = "rolling_history" if _name == "events" else "rolling_history_orders"

    def _q(spark: SparkSession, sf_dir: str, _n=_name) -> DataFrame:
        return _hist_out(prep.history_slice(spark, sf_dir, _n))

    register(_key, O.with_(
        f"inter_{_name} AS ({O.inter_sql(_name)})",
        f"""lab_{_name} AS (SELECT DISTINCT uid, iid, rating, ts, CAST(rating >= 4 AS INTEGER) AS label,
      'title-' || CAST(iid // 2 AS VARCHAR) AS title FROM inter_{_name})""",
        O.history_ctes(f"lab_{_name}", f"hist_{_name}")) + _hist_sql(f"hist_{_name}"))(_q)


@register("incremental_history_orders", ORACLE["rolling_history_orders"])
def q_incremental_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 in three arrivals, each from its own rows and the stored state of the
    users; the twin is the one run over all rows."""
    return _hist_out(prep.history_by_batches(spark, sf_dir, "orders", ["1996-01-01", "1997-06-15"]))


# ---------------------------------------------------------------- C1 / C2 samples
def _samples_out(df: DataFrame) -> DataFrame:
    return df.select("uid", "iid", "label", ts_text("ts").alias("ts"), "title", "env",
                     arr_text("his").alias("his"), arr_text("his_title", "|").alias("his_title"))


for _name in ("events", "orders"):
    def _q(spark: SparkSession, sf_dir: str, _n=_name) -> DataFrame:
        from . import shared as _shared
        return _samples_out(_shared.samples(spark, sf_dir, _n))

    register(f"samples_{_name}", O.with_(O.base_ctes(_name), O.samples_ctes(_name))
             + f"""SELECT uid, iid, label, {O.ts_text('ts')} AS ts, title, env,
  array_to_string(his, ',') AS his, array_to_string(his_title, '|') AS his_title FROM samples_{_name}""")(_q)


# ---------------------------------------------------------------- splits
from . import shared  # noqa: E402
from ..operators import cohorts, ids  # noqa: E402
from ..sources import adapters  # noqa: E402


for _name in ("events", "orders"):
    def _q(spark, sf_dir, _n=_name):
        s = shared.splits(spark, sf_dir, _n)
        return s.select("uid", "iid", "label", ts_text("ts").alias("ts"), "env", "part")

    register(f"splits_{_name}", O.with_(O.all_ctes(_name))
             + f"SELECT uid, iid, label, {O.ts_text('ts')} AS ts, env, part FROM splits_{_name}")(_q)


# ---------------------------------------------------------------- cohorts
def _joined(spark, sf_dir, name):
    inter, items, p = adapters.adapter(spark, sf_dir, name)
    return cohorts.join_items(inter, ids.title_ids(items)), p


@register("cold_titles_events", O.with_(O.base_ctes("events"), O.cohort_ctes("events"))
          + "SELECT title_idx FROM cold_events")
def q_cold_titles(spark, sf_dir):
    data, p = _joined(spark, sf_dir, "events")
    return cohorts.cold_titles(data, p)


@register("cold_titles_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders"))
          + "SELECT title_idx FROM cold_orders")
def q_cold_titles_o(spark, sf_dir):
    data, p = _joined(spark, sf_dir, "orders")
    return cohorts.cold_titles(data, p)


@register("title_ids_orders", O.with_(O.base_ctes("orders")) + "SELECT title, title_idx FROM (SELECT DISTINCT title, title_idx FROM items_orders)")
def q_title_ids(spark, sf_dir):
    inter, items, _ = adapters.adapter(spark, sf_dir, "orders")
    return ids.title_ids(items).select("title", "title_idx").distinct()


for _name in ("events", "orders"):
    def _q(spark, sf_dir, _n=_name):
        c = prep.cohort_rows(spark, sf_dir, _n)
        return c.groupBy("env").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("uid").alias("n_users"),
                                    F.countDistinct("iid").alias("n_items"))

    register(f"env_counts_{_name}", O.with_(O.base_ctes(_name), O.cohort_ctes(_name))
             + f"""SELECT env, count(*) AS n_rows, count(DISTINCT uid) AS n_users, count(DISTINCT iid) AS n_items
FROM cohort_{_name} GROUP BY env""")(_q)


@register("filter_items_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders"))
          + """SELECT uid, iid, env, """ + O.ts_text("ts") + """ AS ts FROM env_orders
WHERE iid IN (SELECT iid FROM env_orders GROUP BY iid HAVING count(*) >= 3)
  AND iid NOT IN (SELECT iid FROM env_orders WHERE env = 0 GROUP BY iid HAVING count(*) < 3)""")
def q_filter_items(spark, sf_dir):
    data, p = _joined(spark, sf_dir, "orders")
    e = cohorts.assign_env(data, cohorts.cold_titles(data, p), p)
    return cohorts.filter_items(e, 3).select("uid", "iid", "env", ts_text("ts").alias("ts"))


@register("filter_users_events", O.with_(O.base_ctes("events"), O.cohort_ctes("events"))
          + """SELECT uid, iid, env, """ + O.ts_text("ts") + """ AS ts FROM env_events
WHERE uid IN (SELECT uid FROM env_events GROUP BY uid HAVING count(*) >= 10)""")
def q_filter_users(spark, sf_dir):
    data, p = _joined(spark, sf_dir, "events")
    e = cohorts.assign_env(data, cohorts.cold_titles(data, p), p)
    return cohorts.filter_users(e, 10).select("uid", "iid", "env", ts_text("ts").alias("ts"))


@register("dense_ids_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders"))
          + """SELECT uid AS raw_uid, CAST(dense_rank() OVER (ORDER BY uid) AS BIGINT) AS uid
FROM (SELECT DISTINCT uid FROM cohort_orders)""")
def q_dense_ids(spark, sf_dir):
    c = prep.cohort_rows(spark, sf_dir, "orders")
    return ids.dense_id_map(c, "uid", "dense").select(F.col("uid").alias("raw_uid"), F.col("dense").alias("uid"))


@register("fake_cold_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders", fake_cold=O.fake_cold_ctes("orders")))
          + f"SELECT uid, iid, env, {O.ts_text('ts')} AS ts FROM cohort_orders")
def q_fake_cold(spark, sf_dir):
    c = prep.cohort_rows(spark, sf_dir, "orders", prep.PrepOptions(fake_cold_ratio=0.2, seed=2024))
    return c.select("uid", "iid", "env", ts_text("ts").alias("ts"))


# ---------------------------------------------------------------- prompts (T-1..T-10, A11)
from ..operators import candidates as G, calibrate as L, prompts as T  # noqa: E402


def _ml_sql(src: str) -> str:
    return f"(SELECT LEAST(max(len(his)), 15) FROM {src})"


def _llm_sql(src: str) -> str:
    ml = _ml_sql(src)
    n = (f"(CASE WHEN len(his) > {ml} THEN {ml} ELSE len(his) - CASE WHEN his[1] = 0 THEN 1 ELSE 0 END END)")
    pad = (f"(CASE WHEN len(his) < {ml} THEN list_concat(list_transform(range({ml} - len(his)), lambda x: CAST(0 AS BIGINT)), his)"
           f" WHEN len(his) > {ml} THEN list_slice(his, len(his) - {ml} + 1, len(his)) ELSE his END)")
    tl = f"(CASE WHEN {n} = 0 THEN his_title ELSE list_slice(his_title, GREATEST(len(his_title) - {n} + 1, 1), len(his_title)) END)"
    q = f"list_transform(list_filter({tl}, lambda x: length(x) > 0), lambda x: '\"' || x || '\"')"
    txt = f"(CASE WHEN len({q}) > 0 THEN array_to_string({q}, ', ') ELSE 'unknow' END)"
    return f"""SELECT uid, iid, array_to_string({pad}, ',') AS his_pad, {txt} AS his_title_text,
  '"' || title || '"' AS title_text, CAST({n} AS INTEGER) AS interacted_num, label FROM {src}"""


def _llm_spark(df):
    ml = T.max_history_length(df)
    return T.llm_sample(df, ml)


@register("max_history_length_events", O.with_(O.all_ctes("events"))
          + f"SELECT CAST({_ml_sql(O.part_sql('events', 'test'))} AS INTEGER) AS max_length")
def q_max_len(spark, sf_dir):
    t = shared.part(spark, sf_dir, "events", "test")
    return t.agg(F.least(F.max(F.size("his")), F.lit(15)).alias("max_length"))


@register("llm_samples_events", O.with_(O.all_ctes("events")) + _llm_sql(O.part_sql("events", "test")))
def q_llm_samples(spark, sf_dir):
    s = _llm_spark(shared.part(spark, sf_dir, "events", "test"))
    return s.withColumn("his_pad", arr_text("his_pad")).select(
        "uid", "iid", "his_pad", "his_title_text", "title_text", F.col("interacted_num").cast("int").alias("interacted_num"), "label")


def _prompt_sql(src: str) -> str:
    base = "<s>" + T.DEFAULT_TEMPLATE
    for tag in ("<uid>", "<iid>", "<DCNFeature>"):
        base = base.replace(tag, T.PLACEHOLDER)
    his = f"array_to_string(list_transform(range(interacted_num), lambda x: '{T.PLACEHOLDER}'), ', ')"
    p = f"replace(replace(replace('{base}', '<his>', {his}), '<his_title>', his_title_text), '<title>', title_text)"
    return f"SELECT uid, iid, {p} AS prompt, CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END AS answer FROM ({_llm_sql(src)})"


@register("prompts_orders", O.with_(O.all_ctes("orders")) + _prompt_sql(O.part_sql("orders", "valid")))
def q_prompts(spark, sf_dir):
    s = T.render_prompt(_llm_spark(shared.part(spark, sf_dir, "orders", "valid")))
    return s.select("uid", "iid", "prompt", T.answer_text("label").alias("answer"))


@register("id_samples_orders", O.with_(O.all_ctes("orders"))
          + f"SELECT uid, iid, trim(title) AS title_text, label FROM {O.part_sql('orders', 'test', 2)}")
def q_id_samples(spark, sf_dir):
    return T.id_sample(shared.part(spark, sf_dir, "orders", "test", 2))


# ---------------------------------------------------------------- candidates (G0-G6), scoring
def _cand_out(cands):
    """Arrays are rendered once per template, not once per row."""
    rows, users, version, n = cands
    t = users.select("_r", arr_text("his").alias("his"), arr_text("his_title", "|").alias("his_title"), "label", "env")
    return G.attach(rows, t, version, n).select("row_id", "uid", "iid", "title", "his", "his_title", "label", "env")


def _cand_sql(out: str = "cand") -> str:
    return f"""SELECT row_id, uid, iid, title, array_to_string(his, ',') AS his,
  array_to_string(his_title, '|') AS his_title, label, env FROM {out}"""


CAND_SEED = 2000


def _cand_users(spark, sf_dir, name, version):
    """The numbered templates of a version, stored."""
    def build():
        train, valid = shared.part(spark, sf_dir, name, "train"), shared.part(spark, sf_dir, name, "valid")
        return G.ranked_users(train, seed=CAND_SEED, version=version, valid=valid)
    return shared.memo(spark, ("cand_users", sf_dir, name, version), build, store=False)


def _cands(spark, sf_dir, name, version, n=80, items_part=("test", 0)):
    """(narrow rows, templates, version, n): both stored, each template once."""
    users = _cand_users(spark, sf_dir, name, version)
    items = shared.part(spark, sf_dir, name, *items_part)
    rows = shared.memo(spark, ("cands", sf_dir, name, version, n, items_part),
                       lambda: G.sampled_rows(users, items, n=n, seed=CAND_SEED, version=version))
    return rows, users, version, n


for _v in ("v0", "v1", "v2", "v3", "v4"):
    def _q(spark, sf_dir, _v=_v):
        return _cand_out(_cands(spark, sf_dir, "orders", _v))

    register(f"candidates_{_v}_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", _v))
             + _cand_sql())(_q)


@register("candidates_v0_events", O.with_(O.all_ctes("events"), O.candidates_ctes("events", "v0")) + _cand_sql())
def q_cand_events(spark, sf_dir):
    return _cand_out(_cands(spark, sf_dir, "events", "v0"))


@register("influence_targets_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes(
    "orders", "v0", n=20, items_from=O.part_sql("orders", "test", 2))) + _cand_sql())
def q_if_targets(spark, sf_dir):
    """As v0 over the items of another test split (cold test), 20 users each."""
    return _cand_out(_cands(spark, sf_dir, "orders", "v0", n=20, items_part=("test", 2)))


def scored(spark, sf_dir, name="orders"):
    """Candidates -> prompts -> scores of the rendered texts: (row_id, uid, iid, _r,
    predicted_logit). The text up to the item is rendered once per template; a row is
    scored where it meets its template, so texts and histories do not move with the rows."""
    def build():
        users = _cand_users(spark, sf_dir, name, "v0")
        ml = T.max_history_length(users)
        open_title = users.withColumn("title", F.lit(""))
        texts = T.render_history(T.llm_sample(open_title, ml, keep=("_r",))).select("_r", "uid", "prompt")

        def score(rows):
            return G.score_candidates(T.render_title(rows.withColumn("title_text", T.title_text("title"))), keep=("iid", "_ipos", "_r", "uid"))
        items = shared.part(spark, sf_dir, name, "test", 0)
        return G.sampled_rows(texts, items, n=80, seed=CAND_SEED, version="v0", derive=score)
    return shared.memo(spark, ("scored", sf_dir, name), build)


_SCORED_SQL = f"""sc AS MATERIALIZED (SELECT c.row_id, c.uid, c.iid, c.his, {O.hash_unit('7', 'p.prompt')} AS predicted_logit
   FROM cand c JOIN ({_prompt_sql('cand')}) p USING (uid, iid))"""


@register("scored_candidates_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", "v0"), _SCORED_SQL)
          + "SELECT row_id, uid, iid, array_to_string(his, ',') AS his, round(predicted_logit, 6) AS predicted_logit FROM sc")
def q_scored(spark, sf_dir):
    histories = _cand_users(spark, sf_dir, "orders", "v0").select("_r", arr_text("his").alias("his"))
    s = G.attach(scored(spark, sf_dir), histories)
    return s.select("row_id", "uid", "iid", "his", r6("predicted_logit").alias("predicted_logit"))


# ---------------------------------------------------------------- calibration (L1, L2)
def _calib_ctes(name="orders") -> str:
    tr = O.part_sql(name, "train")
    return f"""{_SCORED_SQL},
gr AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 99 THEN CAST(5 AS DOUBLE) ELSE k * (CAST(5 AS DOUBLE) / 99) END AS t FROM range(100) r(k)),
ge AS (SELECT k, t, (SELECT count(*) FROM sc WHERE predicted_logit >= t) AS n_ge FROM gr),
st AS (SELECT (SELECT count(*) FROM sc) AS n, (SELECT avg(CAST(label AS DOUBLE)) FROM {tr}) AS p1),
df AS (SELECT k, t, abs(p1 - n_ge / n) AS diff, p1, n_ge / n AS share FROM ge, st),
best AS (SELECT * FROM df ORDER BY diff, k LIMIT 1)"""


@register("calibration_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", "v0"), _calib_ctes())
          + "SELECT k, round(t, 6) AS t, round(diff, 6) AS diff, round(p1, 6) AS p1, round(share, 6) AS share FROM best")
def q_calibration(spark, sf_dir):
    b = L.calibrate(scored(spark, sf_dir), shared.part(spark, sf_dir, "orders", "train"))
    return b.select("k", r6("t").alias("t"), r6("diff").alias("diff"), r6("p1").alias("p1"), r6("share").alias("share"))


@register("synthetic_train_rows_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", "v0", out="cand0"),
          "cand AS MATERIALIZED (SELECT * FROM cand0)",
          _calib_ctes().replace("best AS (", "best AS MATERIALIZED ("), """
lk AS MATERIALIZED (SELECT iid, min(title) AS title FROM samples_orders GROUP BY iid),
zs AS MATERIALIZED (SELECT row_id, uid, iid, CAST(predicted_logit >= b.t AS INTEGER) AS label,
   list_filter(his, lambda x: x <> 0) AS nz FROM sc, (SELECT t FROM best) b),
lab AS MATERIALIZED (SELECT row_id, uid, iid, label, CASE WHEN len(nz) = 0 THEN [CAST(0 AS BIGINT)] ELSE nz END AS his FROM zs),
ex AS MATERIALIZED (SELECT row_id, unnest(his) AS e, unnest(range(1, len(his) + 1)) AS pos FROM lab),
ht AS MATERIALIZED (SELECT row_id, string_agg(coalesce(l.title, ''), '|' ORDER BY pos) AS his_title FROM ex LEFT JOIN lk l ON l.iid = ex.e GROUP BY row_id)""")
          + """SELECT lab.row_id, uid, lab.iid, label, array_to_string(his, ',') AS his, coalesce(lk.title, '') AS title,
  his_title, '2022-10-01 00:00:00.000000' AS ts, 0 AS env
FROM lab LEFT JOIN lk USING (iid) LEFT JOIN ht USING (row_id)""")
def q_synth_rows(spark, sf_dir):
    lk = L.titles_lookup(shared.samples(spark, sf_dir, "orders"))
    users = _cand_users(spark, sf_dir, "orders", "v0").select("_r", "his")
    out = lambda h: h.select("_r", arr_text("his").alias("his"), arr_text("his_title", "|").alias("his_title"))
    x = L.synthetic_training_rows(scored(spark, sf_dir), shared.part(spark, sf_dir, "orders", "train"), lk, users, out)
    return x.select("row_id", "uid", "iid", "label", "his", "title", "his_title", ts_text("ts").alias("ts"), "env")


# ---------------------------------------------------------------- selection
from ..functions.exprs import hash_signed, hash_unit  # noqa: E402
from ..operators import selection as I  # noqa: E402
from ..operators.ordering import among_largest, global_positions, nth_largest  # noqa: E402

SEL_ITERS, SEL_SEED, SEL_RATIO, SEL_MIN_ITEM = 3, 13, 0.01, 5


def influence_by_iter(spark, sf_dir):
    """Per-iteration influence scores of the synthetic rows, derived from the
    rows (md5(seed:iter:row_id) in [-1, 1]); parquet-cut per iteration."""
    c = scored(spark, sf_dir).select("row_id")
    x = c.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(SEL_ITERS - 1))).alias("iter"))
    return x.select("iter", "row_id", hash_signed(SEL_SEED, "iter", "row_id").alias("score"))


def _sel_sql(cumulative: bool, first_bounded: bool, n_sql: str = "(SELECT count(*) FROM cand)") -> str:
    ctes = [f"s{k} AS (SELECT row_id, {O.hash_unit(str(SEL_SEED), str(k), 'row_id')} * 2.0 - 1.0 AS score FROM cand)"
            for k in range(SEL_ITERS)]
    if cumulative:
        ctes.append("a0 AS (SELECT row_id, score * 1.0 AS score FROM s0)")
        for k in range(1, SEL_ITERS):
            ctes.append(f"a{k} AS (SELECT a.row_id, a.score + s.score * {float(k + 1)} AS score FROM a{k-1} a JOIN s{k} s USING (row_id))")
        src = "a"
    else:
        src = "s"
    x = f"GREATEST(1, CAST(floor({SEL_RATIO} * {n_sql}) AS BIGINT))"
    sign = lambda c: f"(CASE WHEN {c} < 0 THEN -1 ELSE 1 END)"

    def upd(k, prev):
        return [f"""j{k} AS (SELECT p.row_id, p.state, s.score, CASE WHEN s.score < 0 THEN -1.0 ELSE s.score END AS new
   FROM {prev} p JOIN {src}{k} s USING (row_id)),
d{k} AS (SELECT * FROM j{k} WHERE {sign('new')} <> {sign('state')}),
t{k} AS (SELECT row_id, new FROM d{k} ORDER BY abs(score) DESC, row_id DESC LIMIT {x}),
st{k} AS (SELECT j.row_id, COALESCE(t.new, j.state) AS state FROM j{k} j LEFT JOIN t{k} t USING (row_id))"""]
    if first_bounded:
        ctes.append(f"init AS (SELECT row_id, -1.0 AS state FROM {src}0)")
        ctes += upd(0, "init")
    else:
        ctes.append(f"st0 AS (SELECT row_id, CASE WHEN score < 0 THEN -1.0 ELSE score END AS state FROM {src}0)")
    for k in range(1, SEL_ITERS):
        ctes += upd(k, f"st{k-1}")
    last = f"st{SEL_ITERS - 1}"
    ctes.append(f"""gd AS (SELECT c.row_id, c.iid, s.state,
   rank() OVER (PARTITION BY c.iid ORDER BY s.state) + (count(*) OVER (PARTITION BY c.iid, s.state) - 1) / 2.0 AS rk
   FROM cand c JOIN {last} s USING (row_id)),
kept AS (SELECT row_id, iid, CASE WHEN rk > {SEL_MIN_ITEM} THEN state ELSE -10000.0 END AS if_score FROM gd)""")
    return ",\n".join(ctes)


def _selected(spark, sf_dir, cumulative, first_bounded):
    def build():
        st = I.fold_states(influence_by_iter(spark, sf_dir), SEL_RATIO, first_bounded=first_bounded,
                           cumulative=cumulative, ensemble_k=1.0)
        syn = scored(spark, sf_dir).select("row_id", "uid", "iid")
        return I.guard_and_select(syn, st, SEL_MIN_ITEM)
    return shared.memo(spark, ("selected", sf_dir, cumulative, first_bounded), build)


_SEL_BASE = [O.all_ctes("orders"), O.candidates_ctes("orders", "v0")]


@register("selection_orders", O.with_(*_SEL_BASE, _sel_sql(False, True))
          + "SELECT row_id, iid, round(if_score, 6) AS if_score FROM kept WHERE if_score <= 0")
def q_selection(spark, sf_dir):
    k = _selected(spark, sf_dir, False, True)
    return k.select("row_id", "iid", r6("if_score").alias("if_score"))


@register("selection_ensemble_orders", O.with_(*_SEL_BASE, _sel_sql(True, False))
          + "SELECT row_id, iid, round(if_score, 6) AS if_score FROM kept WHERE if_score <= 0")
def q_selection_ens(spark, sf_dir):
    k = _selected(spark, sf_dir, True, False)
    return k.select("row_id", "iid", r6("if_score").alias("if_score"))


@register("delete_ratio_orders", O.with_(*_SEL_BASE, _sel_sql(False, True))
          + """SELECT (SELECT count(*) FROM cand) AS n, (SELECT count(*) FROM kept WHERE if_score <= 0) AS kept,
  round(((SELECT count(*) FROM cand) - (SELECT count(*) FROM kept WHERE if_score <= 0)) / (SELECT count(*) FROM cand), 6) AS delete_ratio""")
def q_delete_ratio(spark, sf_dir):
    d = I.delete_ratio(scored(spark, sf_dir), _selected(spark, sf_dir, False, True))
    return d.select("n", "kept", r6("delete_ratio").alias("delete_ratio"))


SAMPLE_RATIO = 0.35


@register("sample_ratio_orders", O.with_(*_SEL_BASE, _sel_sql(True, False))
          + f"""SELECT row_id, iid, round(if_score, 6) AS if_score FROM kept WHERE if_score <= (SELECT quantile_cont(if_score, {SAMPLE_RATIO}) FROM kept)""")
def q_sample_ratio(spark, sf_dir):
    """I4 by a share of the rows: the threshold is the exact quantile (A6) of the guarded scores."""
    st = I.fold_states(influence_by_iter(spark, sf_dir), SEL_RATIO, first_bounded=False, cumulative=True, ensemble_k=1.0)
    syn = scored(spark, sf_dir).select("row_id", "iid")
    k = I.guard_and_select(syn, st, SEL_MIN_ITEM, sample_ratio=SAMPLE_RATIO)
    return k.select("row_id", "iid", r6("if_score").alias("if_score"))


@register("top_disagreements_orders", O.with_(*_SEL_BASE, f"""
s0 AS (SELECT row_id, {O.hash_unit(str(SEL_SEED), '0', 'row_id')} * 2.0 - 1.0 AS score FROM cand),
s1 AS (SELECT row_id, {O.hash_unit(str(SEL_SEED), '1', 'row_id')} * 2.0 - 1.0 AS score FROM cand),
dd AS (SELECT s1.row_id, s1.score FROM s0 JOIN s1 USING (row_id)
   WHERE (CASE WHEN s0.score < 0 THEN -1 ELSE 1 END) <> (CASE WHEN s1.score < 0 THEN -1 ELSE 1 END))""")
          + f"""SELECT row_id, round(score, 6) AS score FROM dd ORDER BY abs(score) DESC, row_id DESC
LIMIT GREATEST(1, CAST(floor({SEL_RATIO} * (SELECT count(*) FROM cand)) AS BIGINT))""")
def q_top_disagree(spark, sf_dir):
    """The x rows with the largest |score| among rows whose sign changed
    between two rounds (x = 1% of rows); exact, the x-th size found by histograms."""
    d = I.by_row(influence_by_iter(spark, sf_dir).where(F.col("iter") < 2), [0, 1])
    sg = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    d = cut_lineage(d.where(sg("s0") != sg("s1")).select("row_id", F.col("s1").alias("score"), F.abs("s1").alias("_a")))
    n = scored(spark, sf_dir).count()
    v, t = nth_largest(d, "_a", max(1, int(SEL_RATIO * n)), "row_id")
    return d.where(among_largest(F.col("_a"), F.col("row_id"), v, t)).select("row_id", r6("score").alias("score"))


# ---------------------------------------------------------------- graph (M1-M8), influence
from ..operators import graph as M, influence as IF  # noqa: E402
from ..session import cut_lineage  # noqa: E402

DIM, LAYERS, EMB_SEED = 4, 2, 11


def _vtext(c: str, places: int = 6):
    return F.array_join(F.transform(F.col(c), lambda v: F.format_string(f"%.{places}f", v)), ",")


def _g_base(spark, sf_dir, name="events"):
    tr = shared.part(spark, sf_dir, name, "train")
    va = shared.part(spark, sf_dir, name, "valid")
    te = shared.part(spark, sf_dir, name, "test")
    nodes = M.graph_nodes(tr, va, te)
    e0 = M.hashed_embeddings(nodes, DIM, EMB_SEED)
    return tr, va, te, M.adjacency(tr), e0


def _g_sql_base(name="events") -> list[str]:
    tr, va, te = O.part_sql(name, "train"), O.part_sql(name, "valid"), O.part_sql(name, "test")
    nodes = (f"(SELECT DISTINCT node FROM (SELECT uid * 2 AS node FROM {tr} UNION ALL SELECT iid * 2 + 1 FROM {tr}"
             f" UNION ALL SELECT uid * 2 FROM {va} UNION ALL SELECT iid * 2 + 1 FROM {va}"
             f" UNION ALL SELECT uid * 2 FROM {te} UNION ALL SELECT iid * 2 + 1 FROM {te}))")
    return [O.all_ctes(name), O.adjacency_ctes(tr), f"e0 AS {O.emb0_sql(nodes, DIM, EMB_SEED)}",
            O.propagate_ctes("adj", "e0", "z", LAYERS, DIM)]


def _z(spark, sf_dir, name="events"):
    def build():
        tr, va, te, adj, e0 = _g_base(spark, sf_dir, name)
        return M.propagate(adj, e0, LAYERS, DIM)
    return shared.memo(spark, ("z", sf_dir, name), build)


@register("adjacency_events", O.with_(O.all_ctes("events"), O.adjacency_ctes(O.part_sql("events", "train")))
          + "SELECT src, dst, round(w, 6) AS w FROM adj")
def q_adjacency(spark, sf_dir):
    return M.adjacency(shared.part(spark, sf_dir, "events", "train")).select("src", "dst", r6("w").alias("w"))


@register("propagation_events", O.with_(*_g_sql_base()) + f"SELECT node, {O.vec_text('v', DIM)} AS vec FROM z")
def q_propagation(spark, sf_dir):
    return _z(spark, sf_dir).select("node", _vtext("vec").alias("vec"))


_PAIRS_SQL = f"""pz AS (SELECT p.uid, p.iid, p.label, {O.dot_sql('u.v', 'i.v', DIM)} AS logit
   FROM {O.part_sql('events', 'valid')} p JOIN z u ON u.node = p.uid * 2 JOIN z i ON i.node = p.iid * 2 + 1)"""


@register("pair_scores_events", O.with_(*_g_sql_base(), _PAIRS_SQL)
          + f"SELECT uid, iid, round(logit, 6) AS logit, round({O.sigmoid_sql('logit')}, 6) AS prob FROM pz")
def q_pair_scores(spark, sf_dir):
    s = M.score_pairs(shared.part(spark, sf_dir, "events", "valid").select("uid", "iid", "label"),
                      _z(spark, sf_dir), with_sigmoid=True)
    return s.select("uid", "iid", r6("logit").alias("logit"), r6("prob").alias("prob"))


@register("bce_loss_events", O.with_(*_g_sql_base(), _PAIRS_SQL)
          + "SELECT round(avg(GREATEST(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS bce_mean FROM pz")
def q_bce(spark, sf_dir):
    s = M.score_pairs(shared.part(spark, sf_dir, "events", "valid").select("uid", "iid", "label"), _z(spark, sf_dir))
    return M.bce_loss(s).select(r6("bce_mean").alias("bce_mean"))


def _triples(train):
    """(uid, pos_iid, neg_iid): each positive train row with the user's
    md5-chosen negative (one per user, a partial aggregate)."""
    from ..functions.exprs import hash_order_key
    neg = (train.where(F.col("label") == 0).groupBy("uid")
           .agg(F.min_by("iid", F.struct(hash_order_key(3, "uid", "iid"), F.col("iid"))).alias("neg_iid")))
    pos = train.where(F.col("label") == 1).select("uid", F.col("iid").alias("pos_iid"))
    return pos.join(neg, "uid")


@register("bpr_loss_events", O.with_(*_g_sql_base(), f"""
tn AS (SELECT uid, arg_min(iid, ({O.hash_key('3', 'uid', 'iid')}, iid)) AS neg_iid FROM {O.part_sql('events', 'train')} WHERE label = 0 GROUP BY uid),
tr3 AS (SELECT p.uid, p.iid AS pos_iid, n.neg_iid FROM {O.part_sql('events', 'train')} p JOIN tn n USING (uid) WHERE p.label = 1),
bp AS (SELECT {O.dot_sql('zu.v', 'zn.v', DIM)} - {O.dot_sql('zu.v', 'zp.v', DIM)} AS d,
   0.5 * ({' + '.join(f'eu.v{k}*eu.v{k} + ep.v{k}*ep.v{k} + en.v{k}*en.v{k}' for k in range(DIM))}) AS reg
   FROM tr3 t JOIN z zu ON zu.node = t.uid * 2 JOIN z zp ON zp.node = t.pos_iid * 2 + 1 JOIN z zn ON zn.node = t.neg_iid * 2 + 1
   JOIN e0 eu ON eu.node = t.uid * 2 JOIN e0 ep ON ep.node = t.pos_iid * 2 + 1 JOIN e0 en ON en.node = t.neg_iid * 2 + 1)""")
          + "SELECT round(avg(CASE WHEN d > 0 THEN d + ln(1 + exp(-d)) ELSE ln(1 + exp(d)) END), 6) AS bpr_loss, round(sum(reg) / count(*), 6) AS reg_loss FROM bp")
def q_bpr(spark, sf_dir):
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    b = M.bpr_loss(_triples(tr), _z(spark, sf_dir), e0)
    return b.select(r6("bpr_loss").alias("bpr_loss"), r6("reg_loss").alias("reg_loss"))


NCF_HIDDEN = 8


def _ncf_sql() -> str:
    w1, b1, w2, b2 = M.ncf_weights(DIM, NCF_HIDDEN)
    xs = [f"u.v{k}" for k in range(DIM)] + [f"i.v{k}" for k in range(DIM)]
    hid = []
    for row, b in zip(w1, b1):
        e = "0.0"
        for x, w in zip(xs, row):
            e = f"({e} + {x} * {float(w)!r})"
        hid.append(f"GREATEST({e} + {float(b)!r}, 0.0)")
    out = repr(float(b2))
    for h, w in zip(hid, w2):
        out = f"({out} + {h} * {float(w)!r})"
    return (f"SELECT p.uid, p.iid, round({out}, 6) AS logit FROM {O.part_sql('events', 'valid')} p "
            f"JOIN e0 u ON u.node = p.uid * 2 JOIN e0 i ON i.node = p.iid * 2 + 1")


@register("ncf_scores_events", O.with_(*_g_sql_base()) + _ncf_sql())
def q_ncf(spark, sf_dir):
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    s = M.ncf_score(va.select("uid", "iid"), e0, M.ncf_weights(DIM, NCF_HIDDEN))
    return s.select("uid", "iid", r6("logit").alias("logit"))


def _grad_sql(pairs: str, out: str = "gz", zname: str = "z") -> str:
    """M11 restated: per-row coefficients scattered to both nodes, then P."""
    uv = ", ".join(f"c * zi.v{k} AS v{k}" for k in range(DIM))
    iv = ", ".join(f"c * zu.v{k} AS v{k}" for k in range(DIM))
    sums = ", ".join(f"sum(v{k}) AS v{k}" for k in range(DIM))
    return f"""{out}_t AS (SELECT p.uid * 2 AS un, p.iid * 2 + 1 AS inn,
     ({O.sigmoid_sql(O.dot_sql('zu.v', 'zi.v', DIM))} - CAST(p.label AS DOUBLE)) / (SELECT count(*) FROM {pairs}) AS c,
     {', '.join(f'zu.v{k} AS zu{k}, zi.v{k} AS zi{k}' for k in range(DIM))}
   FROM {pairs} p JOIN {zname} zu ON zu.node = p.uid * 2 JOIN {zname} zi ON zi.node = p.iid * 2 + 1),
{out}_s AS (SELECT node, {sums} FROM (
   SELECT un AS node, {', '.join(f'c * zi{k} AS v{k}' for k in range(DIM))} FROM {out}_t
   UNION ALL SELECT inn AS node, {', '.join(f'c * zu{k} AS v{k}' for k in range(DIM))} FROM {out}_t) GROUP BY node),
{O.propagate_ctes('adj', f'{out}_s', out, LAYERS, DIM)}"""


@register("gradient_events", O.with_(*_g_sql_base(), _grad_sql(O.part_sql("events", "train")))
          + f"SELECT node, {O.vec_text('v', DIM, 12)} AS grad FROM gz")
def q_gradient(spark, sf_dir):
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    m = IF.Model(adj, e0, LAYERS, DIM)
    g = IF.gradient(m, tr.select("uid", "iid", "label"), _z(spark, sf_dir))
    return g.select("node", _vtext("vec", 12).alias("grad"))


@register("cg_influence_orders")
def q_cg_influence(spark, sf_dir):
    """C4 (M11-M14): influence of each synthetic row on the valid loss via
    CG on (H + damp I) x = grad(valid); iterative, so rows-only check."""
    tr = shared.part(spark, sf_dir, "orders", "train").select("uid", "iid", "label")
    va = shared.part(spark, sf_dir, "orders", "valid").select("uid", "iid", "label")
    syn = L.apply_threshold(scored(spark, sf_dir), L.calibrate(scored(spark, sf_dir), tr))
    nodes = M.graph_nodes(tr, va, syn.select("uid", "iid"))
    m = IF.Model(M.adjacency(tr), M.hashed_embeddings(nodes, DIM, EMB_SEED), 1, DIM)
    z = cut_lineage(m.z())
    b = IF.gradient(m, va, z)
    res = IF.solve(m, tr, b, damp=0.01, z=z)
    return IF.row_influence(m, syn, res.x, z).withColumn("cg_steps", F.lit(res.steps)) \
        .withColumn("cg_status", F.lit(res.status))


FIT_EPOCHS, FIT_LR = 3, 5.0


def _fit_sql() -> str:
    """M9 unrolled: per epoch z = P E, g = P grad_Z, E <- E - lr g."""
    tr = O.part_sql("events", "train")
    ctes, prev = [], "e0"
    for k in range(FIT_EPOCHS):
        ctes.append(O.propagate_ctes("adj", prev, f"fz{k}", LAYERS, DIM))
        ctes.append(_grad_sql(tr, f"fg{k}", f"fz{k}"))
        cols = ", ".join(f"COALESCE(g.v{d}, 0.0) * {-FIT_LR} + e.v{d} * 1.0 AS v{d}" for d in range(DIM))
        ctes.append(f"fe{k + 1} AS (SELECT e.node, {cols} FROM {prev} e LEFT JOIN fg{k} g ON g.node = e.node)")
        prev = f"fe{k + 1}"
    ctes.append(O.propagate_ctes("adj", prev, "fzf", LAYERS, DIM))
    return ",\n".join(ctes)


@register("fit_events", O.with_(*_g_sql_base(), _fit_sql())
          + f"""SELECT p.uid, p.iid, p.label, round({O.dot_sql('u.v', 'i.v', DIM)}, 6) AS logit,
  round({O.sigmoid_sql(O.dot_sql('u.v', 'i.v', DIM))}, 6) AS prob
FROM {O.part_sql('events', 'valid')} p JOIN fzf u ON u.node = p.uid * 2 JOIN fzf i ON i.node = p.iid * 2 + 1""")
def q_fit(spark, sf_dir):
    """M9 (re-aimed): full-batch gradient descent of the propagated model on
    the train split (3 epochs), then valid logits and probabilities."""
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    m = IF.fit(IF.Model(adj, e0, LAYERS, DIM), tr.select("uid", "iid", "label"), epochs=FIT_EPOCHS, lr=FIT_LR)
    s = M.score_pairs(va.select("uid", "iid", "label"), m.z(), with_sigmoid=True)
    return s.select("uid", "iid", "label", r6("logit").alias("logit"), r6("prob").alias("prob"))


@register("fit_early_events")
def q_fit_early(spark, sf_dir):
    """M9 in full: descent on the train split until the valid AUC has not
    improved for 20 epochs, then valid logits and probabilities under the best
    epoch; the number of epochs depends on the data, so rows-only check."""
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    m, log = IF.fit_valid(IF.Model(adj, e0, LAYERS, DIM), tr, va, lr=FIT_LR)
    s = M.score_pairs(va.select("uid", "iid", "label"), m.z(), with_sigmoid=True)
    return s.select("uid", "iid", "label", r6("logit").alias("logit"), r6("prob").alias("prob"),
                    F.lit(len(log)).alias("epochs"), F.lit(IF.best_epoch(log)).alias("best_epoch"))


# ---------------------------------------------------------------- evaluation (E1-E6), metric logs
from ..operators import metrics as E  # noqa: E402

PRED_SEED = 29
_SPLITS = [("valid", 0), ("valid", 1), ("valid", 2), ("test", 0), ("test", 1), ("test", 2)]


def predictions(spark, sf_dir, name="orders"):
    """Tagged union of the evaluation splits with a deterministic score."""
    out = None
    for p, n in _SPLITS:
        x = shared.part(spark, sf_dir, name, p, n).select(
            F.lit(f"{p}_{n}").alias("split"), "uid", "iid", "label",
            hash_unit(PRED_SEED, "uid", "iid").alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


def _pred_sql(name="orders") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{p}_{n}' AS split, uid, iid, label, {O.hash_unit(str(PRED_SEED), 'uid', 'iid')} AS score FROM {O.part_sql(name, p, n)}"
        for p, n in _SPLITS)
    return f"pred AS ({parts})"


def _auc_sql(keys: str) -> str:
    return f"""(SELECT {keys}, sum(label) AS n_pos, sum(1 - label) AS n_neg,
   CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
     (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) END AS auc
   FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk
         FROM pred) GROUP BY {keys})"""


@register("auc_by_split_orders", O.with_(O.all_ctes("orders"), _pred_sql())
          + f"SELECT split, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM {_auc_sql('split')}")
def q_auc(spark, sf_dir):
    a = E.auc(predictions(spark, sf_dir), ["split"])
    return a.select("split", "n_pos", "n_neg", r6("auc").alias("auc"))


_UAUC_CTE = f"""ua AS (SELECT *, CASE WHEN n_pos + n_neg = 1 THEN 'one_row' WHEN n_pos = 0 OR n_neg = 0 THEN 'one_class' ELSE 'ok' END AS status
   FROM {_auc_sql('split, uid')})"""


@register("user_auc_orders", O.with_(O.all_ctes("orders"), _pred_sql(), _UAUC_CTE)
          + "SELECT split, uid, round(auc, 6) AS auc, status FROM ua")
def q_user_auc(spark, sf_dir):
    u = E.user_auc(predictions(spark, sf_dir), extra_keys=["split"])
    return u.select("split", "uid", r6("auc").alias("auc"), "status")


@register("uauc_orders", O.with_(O.all_ctes("orders"), _pred_sql(), _UAUC_CTE)
          + """SELECT split, round(avg(CASE WHEN status = 'ok' THEN auc END), 6) AS uauc,
  CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS n_users,
  CAST(sum(CASE WHEN status = 'one_row' THEN 1 ELSE 0 END) AS BIGINT) AS n_one_row,
  CAST(sum(CASE WHEN status = 'one_class' THEN 1 ELSE 0 END) AS BIGINT) AS n_one_class FROM ua GROUP BY split""")
def q_uauc(spark, sf_dir):
    s = E.user_auc_summary(E.user_auc(predictions(spark, sf_dir), extra_keys=["split"]), ["split"])
    return s.select("split", r6("uauc").alias("uauc"), "n_users", "n_one_row", "n_one_class")


_LL_SQL = """(SELECT split, avg(-(label * ln(LEAST(GREATEST(score, 1e-15), 1 - 1e-15))
   + (1 - label) * ln(1 - LEAST(GREATEST(score, 1e-15), 1 - 1e-15)))) AS logloss FROM pred GROUP BY split)"""


@register("logloss_orders", O.with_(O.all_ctes("orders"), _pred_sql()) + f"SELECT split, round(logloss, 6) AS logloss FROM {_LL_SQL}")
def q_logloss(spark, sf_dir):
    return E.logloss(predictions(spark, sf_dir), ["split"]).select("split", r6("logloss").alias("logloss"))


@register("report_orders", O.with_(O.all_ctes("orders"), _pred_sql(), _UAUC_CTE)
          + f"""SELECT a.split, round(a.auc, 6) AS auc, round(u.uauc, 6) AS uauc, round(l.logloss, 6) AS logloss
FROM {_auc_sql('split')} a FULL JOIN (SELECT split, avg(CASE WHEN status = 'ok' THEN auc END) AS uauc FROM ua GROUP BY split) u USING (split)
FULL JOIN {_LL_SQL} l USING (split)""")
def q_report(spark, sf_dir):
    r = E.report(predictions(spark, sf_dir))
    return r.select("split", r6("auc").alias("auc"), r6("uauc").alias("uauc"), r6("logloss").alias("logloss"))


@register("accuracy_orders", O.with_(O.all_ctes("orders"), _pred_sql())
          + """SELECT round(avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1.0 ELSE score END) = label THEN 1.0 ELSE 0.0 END), 6) AS acc_reported,
  round(avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS acc FROM pred""")
def q_accuracy(spark, sf_dir):
    a = E.accuracy(predictions(spark, sf_dir))
    return a.select(r6("acc_reported").alias("acc_reported"), r6("acc").alias("acc"))


@register("dataset_loss_orders", O.with_(O.all_ctes("orders"), _pred_sql())
          + """SELECT round(sum(GREATEST(lg, 0) - lg * label + ln(1 + exp(-abs(lg)))) / ceil(count(*) / 8192.0), 6) AS loss
FROM (SELECT *, (score * 2.0 - 1.0) * 4.0 AS lg FROM pred)""")
def q_dataset_loss(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("logit", (F.col("score") * 2.0 - 1.0) * 4.0)
    return E.dataset_loss(p, batch=8192).select(r6("loss").alias("loss"))


RUNS, EPOCHS, LOG_SEED = 3, 40, 37


def metric_log(spark, sf_dir):
    """A metric log out of the valid rows, each used once: run = uid mod 3,
    epoch = iid mod 40, valid_auc of the md5 scores of the rows of that run and
    epoch (0.5 where they hold one class)."""
    def build():
        v = shared.part(spark, sf_dir, "orders", "valid", 0).select(
            (F.col("uid") % RUNS).cast("int").alias("run"), (F.col("iid") % EPOCHS).cast("int").alias("epoch"), "label", hash_unit(LOG_SEED, "uid", "iid").alias("score"))
        return E.auc(v, ["run", "epoch"]).select("run", "epoch", F.coalesce("auc", F.lit(0.5)).alias("valid_auc"))
    return shared.memo(spark, ("metric_log", sf_dir), build)


_LOG_SQL = f"""lg AS (SELECT run, epoch, coalesce(auc, 0.5) AS valid_auc FROM (
   SELECT run, epoch, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
     (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) END AS auc
   FROM (SELECT *, rank() OVER (PARTITION BY run, epoch ORDER BY score) + (count(*) OVER (PARTITION BY run, epoch, score) - 1) / 2.0 AS rk
     FROM (SELECT label, uid % {RUNS} AS run, iid % {EPOCHS} AS epoch, {O.hash_unit(str(LOG_SEED), 'uid', 'iid')} AS score
       FROM {O.part_sql('orders', 'valid', 0)}))
   GROUP BY run, epoch))"""


@register("metric_log_orders", O.with_(O.all_ctes("orders"), _LOG_SQL)
          + "SELECT CAST(run AS INTEGER) AS run, CAST(epoch AS INTEGER) AS epoch, round(valid_auc, 6) AS valid_auc FROM lg")
def q_metric_log(spark, sf_dir):
    return metric_log(spark, sf_dir).select("run", "epoch", r6("valid_auc").alias("valid_auc"))


@register("early_stop_orders", O.with_(O.all_ctes("orders"), _LOG_SQL, """
x1 AS (SELECT run, epoch, valid_auc, row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn, max(valid_auc) OVER (PARTITION BY run ORDER BY epoch
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM lg),
x2 AS (SELECT *, max(CASE WHEN pb IS NULL OR valid_auc > pb THEN rn END) OVER w AS li,
     max(valid_auc) OVER w AS best FROM x1 WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
x3 AS (SELECT *, rn - li AS cnt FROM x2),
f1 AS (SELECT run, min(epoch) AS fe FROM x3 WHERE cnt >= 5 GROUP BY run),
fb AS (SELECT f1.run, f1.fe, x3.best AS fbst FROM f1 JOIN x3 ON x3.run = f1.run AND x3.epoch = f1.fe),
e2 AS (SELECT x3.run, min(x3.epoch) AS se FROM x3 JOIN fb ON fb.run = x3.run WHERE x3.cnt >= 20 AND x3.epoch > fb.fe GROUP BY x3.run),
stp AS (SELECT fb.run, CASE WHEN fbst > 0.55 THEN fe ELSE se END AS stop_epoch FROM fb LEFT JOIN e2 USING (run))""")
          + """SELECT CAST(l.run AS INTEGER) AS run, CAST(COALESCE(stp.stop_epoch, l.last) AS INTEGER) AS stop_epoch,
  stp.stop_epoch IS NOT NULL AS stopped, round(l.best, 6) AS best_metric
FROM (SELECT run, max(epoch) AS last, max(valid_auc) AS best FROM lg GROUP BY run) l LEFT JOIN stp USING (run)""")
def q_early_stop(spark, sf_dir):
    """W11 on the metric log (patience 5, +15 once when the best <= 0.55)."""
    s = E.early_stop(metric_log(spark, sf_dir), "valid_auc", patience=5)
    return s.select("run", F.col("stop_epoch").cast("int").alias("stop_epoch"), "stopped",
                    r6("best_metric").alias("best_metric"))


@register("rolling_stats_orders", O.with_(O.all_ctes("orders"), _LOG_SQL)
          + """SELECT CAST(run AS INTEGER) AS run, CAST(epoch AS INTEGER) AS epoch, round(valid_auc, 6) AS value,
  round(list_sort(list(valid_auc) OVER w)[CAST(floor((len(list(valid_auc) OVER w) - 1) / 2) AS BIGINT) + 1], 6) AS median,
  round(avg(valid_auc) OVER w, 6) AS avg, round(max(valid_auc) OVER w, 6) AS max,
  round(avg(valid_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS global_avg
FROM lg WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def q_rolling(spark, sf_dir):
    r = E.rolling_stats(metric_log(spark, sf_dir), value="valid_auc", key="run", step="epoch")
    return r.select("run", "epoch", r6("valid_auc").alias("value"), r6("median").alias("median"),
                    r6("avg").alias("avg"), r6("max").alias("max"), r6("global_avg").alias("global_avg"))


@register("best_config_orders", O.with_(O.all_ctes("orders"), _LOG_SQL)
          + """SELECT CAST(arg_min(run, (-m, run)) AS INTEGER) AS best_config, round(max(m), 6) AS best_valid_auc
FROM (SELECT run, max(valid_auc) AS m FROM lg GROUP BY run)""")
def q_best_config(spark, sf_dir):
    per_run = metric_log(spark, sf_dir).groupBy(F.col("run").alias("config")).agg(F.max("valid_auc").alias("valid_auc"))
    b = E.best_config(per_run, "valid_auc", "config")
    return b.select(F.col("best_config").cast("int").alias("best_config"), r6("best_valid_auc").alias("best_valid_auc"))


# ---------------------------------------------------------------- sources / sinks (S1-S11), P2-P6, J2
from ..functions.exprs import imdb_key, publication_date, two_class_prob, binarize  # noqa: E402
from ..sources import readers as R, sinks as K  # noqa: E402
from ..sources.tables import table  # noqa: E402


@register("ratings_csv_roundtrip_events", O.with_(f"inter_events AS ({O.inter_sql('events')})")
          + "SELECT uid, iid, rating, " + O.ts_text("date_trunc('second', ts)") + " AS ts FROM inter_events")
def q_ratings_csv(spark, sf_dir):
    """S1 + P4: interactions written in the raw CSV shape (epoch seconds),
    read back with a declared schema, seconds -> timestamp."""
    path = K.write_ratings_csv(adapters.inter_events(spark, sf_dir), K.scratch_dir(spark, "ratings_csv"))
    r = R.read_csv(spark, path, R.RATINGS)
    return r.select(F.col("userId").alias("uid"), F.col("movieId").alias("iid"), "rating",
                    ts_text(R.epoch_seconds_to_ts("timestamp")).alias("ts"))


@register("reviews_jsonl_roundtrip_orders", O.with_(f"inter_orders AS ({O.inter_sql('orders')})")
          + f"SELECT 'U' || CAST(uid AS VARCHAR) AS user_id, 'B' || CAST(iid AS VARCHAR) AS parent_asin, rating, {O.ts_text('ts')} AS ts FROM inter_orders")
def q_reviews_jsonl(spark, sf_dir):
    """S3 + S4: JSON lines with epoch milliseconds, explicit conversion."""
    path = K.write_reviews_jsonl(adapters.inter_orders(spark, sf_dir), K.scratch_dir(spark, "reviews_jsonl"))
    r = R.read_jsonl(spark, path, R.REVIEWS)
    return r.select("user_id", "parent_asin", "rating", ts_text(R.epoch_millis_to_ts("timestamp")).alias("ts"))


def _links_movies_basics(spark, sf_dir):
    """Raw movie-side files derived from ``part``: links (imdb ids of 1-8
    digits), movies, and title basics written as TSV with '\\N' nulls."""
    p = table(spark, sf_dir, "part")
    links = p.select(F.col("p_partkey").alias("movieId"),
                     (F.col("p_partkey") * 4099 + F.col("p_size")).alias("imdbId"),
                     F.col("p_partkey").alias("tmdbId"))
    movies = p.select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"),
                      F.col("p_type").alias("genres"))
    # the public file's nine columns, in an order of its own
    basics = p.select(imdb_key(F.col("p_partkey") * 4099 + F.col("p_size")).alias("tconst"),
                      F.col("p_type").alias("titleType"),
                      F.concat(F.lit('"'), F.col("p_name")).alias("primaryTitle"), F.col("p_name").alias("originalTitle"),
                      F.lit("0").alias("isAdult"),
                      F.when(F.col("p_size") % 7 == 0, F.lit("\\N"))
                       .otherwise((F.lit(1990) + F.col("p_size") % 35).cast("string")).alias("startYear"),
                      F.lit("\\N").alias("endYear"), F.col("p_size").cast("string").alias("runtimeMinutes"),
                      F.col("p_brand").alias("genres"))
    path = K.scratch_dir(spark, "basics_tsv")
    basics.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return links, movies, R.read_tsv(spark, path)


_BASICS_SQL = """bs AS (SELECT 'tt' || CASE WHEN length(CAST(p_partkey * 4099 + p_size AS VARCHAR)) < 7
     THEN lpad(CAST(p_partkey * 4099 + p_size AS VARCHAR), 7, '0') ELSE CAST(p_partkey * 4099 + p_size AS VARCHAR) END AS tconst,
   p_type AS titleType, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(1990 + p_size % 35 AS VARCHAR) END AS startYear,
   NULL AS endYear, CAST(p_size AS VARCHAR) AS runtimeMinutes, p_brand AS genres, p_partkey AS movieId, p_name AS title, p_type AS mgenres
   FROM part)"""


@register("movie_items_tsv", O.with_(_BASICS_SQL)
          + "SELECT movieId, title, mgenres AS genres, tconst, titleType, CAST(startYear AS INTEGER) AS startYear FROM bs WHERE startYear IS NOT NULL")
def q_movie_items(spark, sf_dir):
    """S2 + P2 + J2 + P6: links -> imdb key; links left-join basics; movies
    left-join that with the clashing ``genres`` taken from movies; rows with
    an unknown start year dropped, year cast to int."""
    links, movies, basics = _links_movies_basics(spark, sf_dir)
    lk = links.select("movieId", imdb_key("imdbId").alias("tconst"))
    lb = lk.join(basics.select("tconst", "titleType", "startYear"), "tconst", "left")
    m = movies.join(lb, "movieId", "left")
    m = m.na.drop("any", subset=["startYear"])
    return m.select("movieId", "title", movies["genres"].alias("genres"), "tconst", "titleType",
                    F.col("startYear").cast("int").alias("startYear"))


@register("null_profile_basics", O.with_(_BASICS_SQL)
          + """SELECT CAST(count(*) - count(tconst) AS BIGINT) AS tconst, CAST(count(*) - count(titleType) AS BIGINT) AS titleType,
  CAST(count(*) - count(startYear) AS BIGINT) AS startYear, CAST(count(*) - count(endYear) AS BIGINT) AS endYear,
  CAST(count(*) - count(runtimeMinutes) AS BIGINT) AS runtimeMinutes, CAST(count(*) - count(genres) AS BIGINT) AS genres FROM bs""")
def q_null_profile(spark, sf_dir):
    """Null count per column in one aggregate."""
    _, _, b = _links_movies_basics(spark, sf_dir)
    return b.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in b.columns])


_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _details_sql() -> str:
    d = f"({_MONTHS}[month(o_orderdate)] || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ', ' || CAST(year(o_orderdate) AS VARCHAR))"
    parse = lambda s: f"CAST(try_strptime({s}, '%B %d, %Y') AS DATE)"
    return f"""SELECT o_orderkey, strftime(CASE o_orderkey % 6
   WHEN 0 THEN {parse(d)} WHEN 1 THEN {parse(f'lower({d})')} WHEN 2 THEN {parse(d)}
   WHEN 3 THEN NULL WHEN 4 THEN {parse(d)} ELSE NULL END, '%Y-%m-%d') AS publish_date FROM orders"""


@register("publication_dates_orders", _details_sql())
def q_publication_dates(spark, sf_dir):
    """S3 (map column) + P3: item metadata with a details map written as JSON
    lines, read back with a declared schema, publication date parsed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = F.date_format("o_orderdate", "MMMM d, yyyy")
    v = F.col("o_orderkey") % 6
    details = (F.when(v == 0, F.create_map(F.lit("Publisher"), F.concat(F.lit("Press ("), d, F.lit(")"))))
                .when(v == 1, F.create_map(F.lit("Publisher"), F.concat(F.lit("Press ("), F.lower(d), F.lit(")"))))
                .when(v == 2, F.create_map(F.lit("Publisher"), d))
                .when(v == 3, F.create_map(F.lit("Publisher"), F.lit("Press"), F.lit("Publication Date"), d))
                .when(v == 4, F.create_map(F.lit("Publication Date"), d))
                .otherwise(F.create_map(F.lit("Language"), F.lit("English"))))
    meta = o.select(F.col("o_orderkey").cast("string").alias("parent_asin"), F.lit("t").alias("title"),
                    details.alias("details"))
    path = K.scratch_dir(spark, "meta_jsonl")
    meta.write.json(path)
    m = R.read_jsonl(spark, path, R.META)
    return m.select(F.col("parent_asin").cast("long").alias("o_orderkey"),
                    F.date_format(publication_date("details"), "yyyy-MM-dd").alias("publish_date"))


_SPLIT_NAMES = [("train", 1), ("valid", 0), ("test", 0), ("valid", 1), ("valid", 2), ("test", 1), ("test", 2)]


@register("split_files_roundtrip_events", O.with_(O.all_ctes("events"))
          + " UNION ALL ".join(f"SELECT '{p}_{n}' AS split, uid, iid, label FROM {O.part_sql('events', p, n)}" for p, n in _SPLIT_NAMES))
def q_split_files(spark, sf_dir):
    """S6 + S5: the seven split outputs written partitioned by split name,
    then read back as several paths at once."""
    s = None
    for p, n in _SPLIT_NAMES:
        x = shared.part(spark, sf_dir, "events", p, n).select(F.lit(f"{p}_{n}").alias("split"), "uid", "iid", "label")
        s = x if s is None else s.unionByName(x)
    path = K.write_splits(s, K.scratch_dir(spark, "splits"))
    back = R.read_parquet_many(spark, [f"{path}/split={p}_{n}" for p, n in _SPLIT_NAMES])
    # partition column is not inside the files: re-attach from the path
    return back.withColumn("split", F.regexp_extract(F.input_file_name(), r"split=([a-z]+_[0-9])", 1)) \
        .select("split", "uid", "iid", "label")


@register("influence_files_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", "v0"))
          + f"SELECT CAST(i AS INTEGER) AS iter, count(*) AS n, CAST(0 AS BIGINT) AS n_missing FROM cand, range({SEL_ITERS}) t(i) GROUP BY i")
def q_influence_files(spark, sf_dir):
    """Influence scores written per iteration (partitioned by iter), read
    back, and checked to cover every synthetic row (anti join on row_id)."""
    path = K.write_parquet(influence_by_iter(spark, sf_dir), K.scratch_dir(spark, "influence"), ["iter"])
    back = spark.read.parquet(path)
    syn = scored(spark, sf_dir).select("row_id")
    n_syn = syn.count()
    # each id moves once, with how often each round scores it
    iters = sorted(r["iter"] for r in back.select("iter").distinct().collect())
    times = back.groupBy("row_id").agg(*[F.count_if(F.col("iter") == k).alias(f"c{k}") for k in iters])
    times = times.join(syn.select(F.col("row_id").alias("_syn")).distinct(), F.col("row_id") == F.col("_syn"), "left")
    one = F.array(*[F.struct(F.lit(k).alias("iter"), F.col(f"n{k}").alias("n"), (F.lit(n_syn) - F.col(f"h{k}")).alias("n_missing")) for k in iters])
    sums = times.agg(*[F.sum(f"c{k}").alias(f"n{k}") for k in iters],
                     *[F.count_if((F.col(f"c{k}") > 0) & F.col("_syn").isNotNull()).alias(f"h{k}") for k in iters])
    if not iters:  # no row was written
        return back.groupBy("iter").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_missing"))
    return sums.select(F.explode(one).alias("x")).select(F.col("x.iter").cast("int").alias("iter"), "x.n", "x.n_missing")


@register("metrics_json_roundtrip_orders", O.with_(O.all_ctes("orders"), _pred_sql())
          + f"SELECT e AS epoch, split, round(auc, 6) AS auc FROM {_auc_sql('split')}, (VALUES (0), (1)) t(e)")
def q_metrics_json(spark, sf_dir):
    """Per-epoch metric records appended as JSON lines, read back."""
    path = K.scratch_dir(spark, "metrics_json")
    a = E.auc(predictions(spark, sf_dir), ["split"]).select("split", "auc")
    for e in (0, 1):
        K.append_json(a.withColumn("epoch", F.lit(e)), path)
    back = spark.read.schema("split string, auc double, epoch int").json(path)
    return back.select("epoch", "split", r6("auc").alias("auc"))


# ---------------------------------------------------------------- P10-P12, W5, A2, A3, A9, E8
@register("two_class_scores_events", O.with_(O.all_ctes("events"))
          + f"""SELECT uid, iid, round(p, 6) AS prob, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM (
  SELECT uid, iid, {O.sigmoid_sql(f"(({O.hash_unit('41', 'uid', 'iid')} * 2.0 - 1.0) * 3.0) - (({O.hash_unit('43', 'uid', 'iid')} * 2.0 - 1.0) * 3.0)")} AS p
  FROM {O.part_sql('events', 'valid')})""")
def q_two_class(spark, sf_dir):
    """P10 + P12: exp(pos)/(exp(pos)+exp(neg)) from two logits, then > 0.5."""
    v = shared.part(spark, sf_dir, "events", "valid")
    x = v.select("uid", "iid", (hash_signed(41, "uid", "iid") * 3.0).alias("pos"),
                 (hash_signed(43, "uid", "iid") * 3.0).alias("neg"))
    x = x.withColumn("p", two_class_prob("pos", "neg"))
    return x.select("uid", "iid", r6("p").alias("prob"), binarize("p").alias("pred"))


@register("row_sample_orders", O.with_(O.all_ctes("orders"))
          + f"SELECT uid, iid FROM {O.part_sql('orders', 'train')} WHERE {O.hash_unit('2024', 'uid', 'iid')} < 0.3")
def q_row_sample(spark, sf_dir):
    """Seeded 30% row sample of train (hash threshold)."""
    from ..operators.splits import sample_rows
    return sample_rows(shared.part(spark, sf_dir, "orders", "train"), 0.3, 2024, "uid", "iid").select("uid", "iid")


@register("item_frequency_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders"))
          + "SELECT iid, count(*) AS n FROM cohort_orders GROUP BY iid")
def q_item_freq(spark, sf_dir):
    """A2: interactions per item (descending order is a presentation choice)."""
    return prep.cohort_rows(spark, sf_dir, "orders").groupBy("iid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@register("monthly_counts_orders", O.with_(O.base_ctes("orders"), O.cohort_ctes("orders"))
          + """SELECT CAST(m - (SELECT min(month(ts) + 12 * year(ts)) FROM joined_orders WHERE ts >= TIMESTAMP '1996-01-01') AS INTEGER) AS month,
  count(*) AS n_all, CAST(sum(CASE WHEN cold THEN 1 ELSE 0 END) AS BIGINT) AS n_cold, CAST(sum(CASE WHEN cold THEN 0 ELSE 1 END) AS BIGINT) AS n_warm
FROM (SELECT month(ts) + 12 * year(ts) AS m, title_idx IN (SELECT title_idx FROM cold_orders) AS cold FROM joined_orders WHERE ts >= TIMESTAMP '1996-01-01')
GROUP BY m""")
def q_monthly(spark, sf_dir):
    """P5 + A3: relative month index over the time-filtered rows and counts
    for all / cold / warm rows in one pass (cohort column)."""
    data, p = _joined(spark, sf_dir, "orders")
    cold = cohorts.cold_titles(data, p).withColumn("_cold", F.lit(True))
    x = data.where(F.col("ts") >= F.lit(p.train_start).cast("timestamp_ntz"))
    x = x.join(cold, "title_idx", "left").withColumn("_m", F.month("ts") + 12 * F.year("ts"))
    g = x.groupBy("_m").agg(F.count(F.lit(1)).alias("n_all"),
                            F.sum(F.when(F.col("_cold"), 1).otherwise(0)).cast("long").alias("n_cold"),
                            F.sum(F.when(F.col("_cold"), 0).otherwise(1)).cast("long").alias("n_warm"))
    lo = g.agg(F.min("_m").alias("_lo"))
    return L.one_row_join(g, lo).select((F.col("_m") - F.col("_lo")).alias("month"), "n_all", "n_cold", "n_warm")


@register("dataset_summary_events", O.with_(O.all_ctes("events"))
          + """SELECT n_train, n_valid, n_test, n_users, n_items, round((n_train + n_valid + n_test) / (n_users * n_items), 6) AS density FROM (
  SELECT CAST(sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN part = 'valid' THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  CAST(sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test, max(uid) + 1 AS n_users, max(iid) + 1 AS n_items FROM splits_events)""")
def q_summary(spark, sf_dir):
    """users = 1 + max(uid) and items = 1 + max(iid) over train, valid and
    test together; density = all rows / users / items. One aggregate."""
    rows = lambda p: F.count_if(F.col("part") == p)
    g = shared.splits(spark, sf_dir, "events").agg(
        rows("train").alias("n_train"), rows("valid").alias("n_valid"), rows("test").alias("n_test"),
        (F.max("uid") + 1).alias("n_users"), (F.max("iid") + 1).alias("n_items"))
    total = F.col("n_train") + F.col("n_valid") + F.col("n_test")
    return g.withColumn("density", r6(total / F.col("n_users") / F.col("n_items")))


@register("mixed_eval_orders", O.with_(O.all_ctes("orders"), f"""
src AS (SELECT 'warm' AS source, uid, iid, 2.0 AS w FROM {O.part_sql('orders', 'valid', 1)}
   UNION ALL SELECT 'cold' AS source, uid, iid, 1.0 AS w FROM {O.part_sql('orders', 'valid', 2)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {O.hash_key('5', 'uid', 'iid')}, uid, iid) AS r FROM src)""")
          + "SELECT source, uid, iid, row_number() OVER (ORDER BY (r - 0.5) / w, source, uid, iid) AS mix_pos FROM rk")
def q_mixed(spark, sf_dir):
    """Ratio mixing of several sources (warm:cold = 2:1) as a weighted
    round-robin order over all rows (nothing dropped); per-source ranks and
    the final order come from range-partitioned positions."""
    from ..functions.exprs import hash_order_key
    srcs = [("warm", shared.part(spark, sf_dir, "orders", "valid", 1), 2.0),
            ("cold", shared.part(spark, sf_dir, "orders", "valid", 2), 1.0)]
    out = None
    for name, df, w in srcs:
        x = df.select(F.lit(name).alias("source"), "uid", "iid", hash_order_key(5, "uid", "iid").alias("_h"))
        x = global_positions(x, ["_h", "uid", "iid"], "_r").withColumn("_k", (F.col("_r") - 0.5) / w)
        out = x if out is None else out.unionByName(x)
    out = global_positions(out, ["_k", "source", "uid", "iid"], "mix_pos")
    return out.select("source", "uid", "iid", "mix_pos")


# ---------------------------------------------------------------- streaming (S10 consumer)
@register("metric_log_stream_orders", O.with_(O.all_ctes("orders"), _LOG_SQL)
          + """SELECT CAST(run AS INTEGER) AS run, round(max(valid_auc), 6) AS best_metric,
  CAST(arg_min(epoch, (-valid_auc, epoch)) AS INTEGER) AS best_epoch, CAST(max(epoch) AS INTEGER) AS last_epoch,
  count(*) AS n_epochs FROM lg GROUP BY run""")
def q_metric_stream(spark, sf_dir):
    """The metric log appended as JSON lines in epoch batches (S10), followed
    by a Structured Streaming aggregation (best so far per run)."""
    from ..streaming.metric_log import follow
    log = metric_log(spark, sf_dir)
    path = K.scratch_dir(spark, "metric_stream")
    for lo in range(0, EPOCHS, 10):   # training appends in batches of epochs
        K.append_json(log.where((F.col("epoch") >= lo) & (F.col("epoch") < lo + 10))
                      .select(F.col("run").cast("int").alias("run"), F.col("epoch").cast("int").alias("epoch"),
                              "valid_auc"), path)
    out = follow(spark, path, K.scratch_dir(spark, "metric_stream_ckpt"), K.scratch_dir(spark, "metric_stream_best"))
    return out.select("run", r6("best_metric").alias("best_metric"), "best_epoch", "last_epoch", "n_epochs")


@register("early_stop_stream_orders", ORACLE["early_stop_orders"])
def q_early_stop_stream(spark, sf_dir):
    """W11 as a stateful stream: the log arrives in four appends, the stopper is
    started anew after each of them and goes on from its checkpoint; the twin is
    the batch form over the whole log."""
    from ..streaming.early_stop import watch
    log = metric_log(spark, sf_dir).select(F.col("run").cast("int").alias("run"), F.col("epoch").cast("int").alias("epoch"), "valid_auc")
    path, ckpt, out = (K.scratch_dir(spark, f"early_stop_{part}") for part in ("log", "ckpt", "status"))
    for lo in range(0, EPOCHS, 10):
        K.append_json(log.where((F.col("epoch") >= lo) & (F.col("epoch") < lo + 10)), path)
        s = watch(spark, path, ckpt, out, patience=5)
    return s.select("run", "stop_epoch", "stopped", r6("best_metric").alias("best_metric"))


# ---------------------------------------------------------------- C4-C6, M10
from . import iterate as C  # noqa: E402


ITER = C.IterOptions(dim=8, layers=2, lr=0.3, patience=3, min_gain=0.002)


def _iterated(spark, sf_dir):
    """(report, folder of the rounds) of C5. The folder is named by the data and the
    options, so a run that was ended goes on where it stopped."""
    from ..session import ensure_checkpoint_dir
    key = hashlib.md5(repr((shared.stamp(spark, sf_dir), ITER)).encode()).hexdigest()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds/{key}"
    tr = shared.part(spark, sf_dir, "orders", "train")
    va = shared.part(spark, sf_dir, "orders", "valid")
    evals = {"valid_0": va, "test_0": shared.part(spark, sf_dir, "orders", "test")}
    syn = _labelled_synthetic(spark, sf_dir)
    return shared.memo(spark, ("iterated", sf_dir, key), lambda: C.iterated_selection(tr, va, evals, syn, ITER, path)), path


def _labelled_synthetic(spark, sf_dir):
    tr = shared.part(spark, sf_dir, "orders", "train")
    return shared.memo(spark, ("labelled_synthetic", sf_dir), lambda: C.labelled_synthetic(scored(spark, sf_dir), tr))


@register("iterated_selection_orders")
def q_iterated(spark, sf_dir):
    """Sixteen rounds (round 0 keeps all, each later one selects by the
    influence under the last model), every fit from the last round's vectors until the
    valid AUC stops improving, every solve to its tolerance, every round committed;
    iterative, so rows-only check."""
    return _iterated(spark, sf_dir)[0]


@register("ensemble_inference_orders")
def q_ensemble(spark, sf_dir):
    """Reads the committed scores of C5's rounds, cumulative fold, selection, one fit ended by the valid AUC, report."""
    tr = shared.part(spark, sf_dir, "orders", "train").select("uid", "iid", "label")
    evals = {"valid_0": shared.part(spark, sf_dir, "orders", "valid"),
             "test_0": shared.part(spark, sf_dir, "orders", "test")}
    syn = _labelled_synthetic(spark, sf_dir)
    nodes = M.graph_nodes(tr, syn.select("uid", "iid"), *[e.select("uid", "iid") for e in evals.values()])
    scores = C.Rounds(spark, _iterated(spark, sf_dir)[1]).all("scores", ITER.rounds).select("iter", "row_id", "score")
    return C.ensemble_inference(syn, scores, tr, evals["valid_0"], nodes, evals, ITER)


from ..operators import strata as S, topitems  # noqa: E402

NCF = S.FitOptions(dim=16, hidden=16, lr=0.01, batch=1024)
FACTORS = S.FitOptions(dim=16, lr=0.02, batch=1024)


def _strata_fit(spark, sf_dir, options):
    """Valid rows scored by a model that was fitted on the train rows, with the log's ends."""
    tr, va = (shared.part(spark, sf_dir, "events", p).select("uid", "iid", "label") for p in ("train", "valid"))
    model = S.fit(tr, va, options)
    top = max((v, -k) for k, v in model.log if v is not None)
    return S.scored(model, va).select("uid", "iid", "label", r6("logit").alias("logit"), r6(sigmoid("logit")).alias("prob"),
                                      F.lit(len(model.log)).alias("passes"), F.lit(-top[1]).alias("best_pass"), F.lit(round(top[0], 6)).alias("valid_auc"))


@register("ncf_fit_events")
def q_ncf_fit(spark, sf_dir):
    """The neural scorer with trained user and item embeddings, mini-batch
    Adam over strata until the valid AUC stops improving; rows-only check."""
    return _strata_fit(spark, sf_dir, NCF)


@register("fit_strata_events")
def q_fit_strata(spark, sf_dir):
    """M9 in mini-batches: embeddings of the dot-product model, Adam over strata
    until the valid AUC stops improving; rows-only check."""
    return _strata_fit(spark, sf_dir, FACTORS)


LEARNING_RATES = (0.02, 0.04, 0.08)


def fit_log(spark, sf_dir):
    """(run, epoch, valid_auc) of real fits: one run for each learning rate, every
    AUC over the whole valid split, null where it is undefined."""
    def build():
        tr, va = (shared.part(spark, sf_dir, "events", p).select("uid", "iid", "label") for p in ("train", "valid"))
        lines = [(k, epoch, value) for k, lr in enumerate(LEARNING_RATES) for epoch, value in S.fit(tr, va, replace(FACTORS, lr=lr)).log]
        return spark.createDataFrame(lines, "run int, epoch int, valid_auc double")
    return shared.memo(spark, ("fit_log", sf_dir), build)


@register("fit_log_events")
def q_fit_log(spark, sf_dir):
    """W10-W12 on the log of real fits: per epoch its AUC and the rolling statistics,
    per run where the early stopper stops, and the best run; the number of epochs
    depends on the data, so rows-only check."""
    log = fit_log(spark, sf_dir)
    stop = E.early_stop(log, patience=FACTORS.patience, low=0.5, extra=FACTORS.patience)
    per_run = log.groupBy(F.col("run").alias("config")).agg(F.max("valid_auc").alias("valid_auc"))
    best = E.best_config(per_run).select(F.col("best_config").alias("best_run"))
    rolled = E.rolling_stats(log, value="valid_auc", key="run", step="epoch", window=5)
    rolled = rolled.select("run", "epoch", *(r6(c).alias(c) for c in ("valid_auc", "median", "avg", "max", "global_avg")))
    stop = stop.select("run", "stop_epoch", "stopped", r6("best_metric").alias("best_metric"))
    return L.one_row_join(rolled.join(stop, "run"), best)


TOP_ITEMS = 10


@register("top_items_events", O.with_(*_g_sql_base()) + f"""SELECT uid, CAST(rank AS INTEGER) AS rank, iid, round(score, 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, iid) AS rank FROM (
    SELECT u.node // 2 AS uid, i.node // 2 AS iid, {O.dot_sql('u.v', 'i.v', DIM)} AS score FROM z u JOIN z i ON u.node % 2 = 0 AND i.node % 2 = 1)) WHERE rank <= {TOP_ITEMS}""")
def q_top_items(spark, sf_dir):
    """M5: the ten best items of every user under the propagated vectors, by blocks of falling norm."""
    z = _z(spark, sf_dir)
    users = z.filter("node % 2 = 0").select(F.expr("node div 2").alias("uid"))
    items = z.filter("node % 2 = 1").select(F.expr("node div 2").alias("iid"))
    return topitems.top_items(users, items, z, TOP_ITEMS).select("uid", "rank", "iid", F.round("score", 9).alias("score"))


def _hvp_sql(pairs: str, damp: float = 0.01, v: str = "vv", out: str = "hv", gauss_newton: bool = False) -> str:
    """M12 restated: D = P v; per-row h and c; scatter; P; + damp v. The Gauss-Newton form has no c."""
    cross = (lambda k, o: "") if gauss_newton else (lambda k, o: f" + c * d{o}{k}")
    uvec = ", ".join(f"h * zi{k}{cross(k, 'i')} AS v{k}" for k in range(DIM))
    ivec = ", ".join(f"h * zu{k}{cross(k, 'u')} AS v{k}" for k in range(DIM))
    sums = ", ".join(f"sum(v{k}) AS v{k}" for k in range(DIM))
    dot_dz = " + ".join(f"du{k} * zi{k}" for k in range(DIM))
    dot_zd = " + ".join(f"zu{k} * di{k}" for k in range(DIM))
    return f"""{O.propagate_ctes('adj', v, f'{out}_d', LAYERS, DIM)},
{out}_t AS (SELECT p.uid * 2 AS un, p.iid * 2 + 1 AS inn, CAST(p.label AS DOUBLE) AS y,
     {', '.join(f'zu.v{k} AS zu{k}, zi.v{k} AS zi{k}, du.v{k} AS du{k}, di.v{k} AS di{k}' for k in range(DIM))},
     {O.sigmoid_sql(O.dot_sql('zu.v', 'zi.v', DIM))} AS sig
   FROM {pairs} p JOIN z zu ON zu.node = p.uid * 2 JOIN z zi ON zi.node = p.iid * 2 + 1
   JOIN {out}_d du ON du.node = p.uid * 2 JOIN {out}_d di ON di.node = p.iid * 2 + 1),
{out}_c AS (SELECT *, sig * (1 - sig) * (({dot_dz}) + ({dot_zd})) / (SELECT count(*) FROM {pairs}) AS h,
     (sig - y) / (SELECT count(*) FROM {pairs}) AS c FROM {out}_t),
{out}_s AS (SELECT node, {sums} FROM (SELECT un AS node, {uvec} FROM {out}_c UNION ALL SELECT inn AS node, {ivec} FROM {out}_c) GROUP BY node),
{O.propagate_ctes('adj', f'{out}_s', f'{out}_p', LAYERS, DIM)},
{out} AS MATERIALIZED (SELECT COALESCE(a.node, b.node) AS node, {', '.join(f'COALESCE(a.v{k}, 0.0) * 1.0 + COALESCE(b.v{k}, 0.0) * {damp} AS v{k}' for k in range(DIM))}
   FROM {out}_p a FULL JOIN {v} b ON a.node = b.node)"""


_VV_SQL = f"vv AS {O.emb0_sql('(SELECT node FROM e0)', DIM, 17, 1.0)}"


@register("hvp_events", O.with_(*_g_sql_base(), _VV_SQL, _hvp_sql(O.part_sql("events", "train")))
          + f"SELECT node, {O.vec_text('v', DIM, 12)} AS hv FROM hv")
def q_hvp(spark, sf_dir):
    """(H + damp I) v of the mean train BCE, v = md5 vector (seed 17)."""
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    v = M.hashed_embeddings(e0.select("node"), DIM, 17, 1.0)
    m = IF.Model(adj, e0, LAYERS, DIM)
    hv = IF.hvp(m, tr.select("uid", "iid", "label"), v, 0.01, _z(spark, sf_dir))
    return hv.select("node", _vtext("vec", 12).alias("hv"))


CG_STEPS = 2
GN_STEPS = 6  # of the SQL twin: more than the solve needs to reach its tolerance


def _cg_sql(steps: int = CG_STEPS, gauss_newton: bool = False) -> str:
    """M13 unrolled: x0 = b (b / damp for Gauss-Newton), r0 = p0 = b - A x0, then the steps; cg_x is the solution so far."""
    tr, va = O.part_sql("events", "train"), O.part_sql("events", "valid")
    every = lambda f: ", ".join(f(k) for k in range(DIM))
    dot = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in range(DIM))
    full = lambda c: f"COALESCE({c}, 0.0)"
    grow = "/ 0.01" if gauss_newton else "* 1.0"
    hvp = functools.partial(_hvp_sql, tr, gauss_newton=gauss_newton)
    ctes = [_grad_sql(va, "gv"), f"x0 AS (SELECT node, {every(lambda k: f'v{k} {grow} AS v{k}')} FROM gv)", hvp(v="x0", out="h0"),
            f"""st0 AS MATERIALIZED (SELECT node, {every(lambda k: f'x{k}')}, {every(lambda k: f'b{k} - a{k} AS r{k}')}, {every(lambda k: f'b{k} - a{k} AS p{k}')}
   FROM (SELECT COALESCE(b.node, a.node) AS node, {every(lambda k: f'{full(f"b.v{k}")} AS b{k}, {full(f"b.v{k}")} {grow} AS x{k}, {full(f"a.v{k}")} AS a{k}')} FROM gv b FULL JOIN h0 a ON a.node = b.node))"""]
    for i in range(steps):
        # a residual of zero ends the steps: nothing moves any more
        ctes += [f"pv{i} AS (SELECT node, {every(lambda k: f'p{k} AS v{k}')} FROM st{i})", hvp(v=f"pv{i}", out=f"ap{i}"), f"""
bo{i} AS MATERIALIZED (SELECT COALESCE(s.node, a.node) AS node, {every(lambda k: f'{full(f"s.x{k}")} AS x{k}, {full(f"s.r{k}")} AS r{k}, {full(f"s.p{k}")} AS p{k}, {full(f"a.v{k}")} AS a{k}')}
   FROM st{i} s FULL JOIN ap{i} a ON a.node = s.node),
al{i} AS MATERIALIZED (SELECT COALESCE(sum({dot('r', 'r')}) / NULLIF(sum({dot('p', 'a')}), 0), 0.0) AS alpha, sum({dot('r', 'r')}) AS rr FROM bo{i}),
mv{i} AS MATERIALIZED (SELECT node, {every(lambda k: f'x{k} + p{k} * alpha AS x{k}, r{k} - a{k} * alpha AS r{k}, p{k}')} FROM bo{i}, al{i}),
be{i} AS MATERIALIZED (SELECT COALESCE(sum({dot('r', 'r')}) / NULLIF((SELECT rr FROM al{i}), 0), 0.0) AS beta FROM mv{i}),
st{i + 1} AS MATERIALIZED (SELECT node, {every(lambda k: f'x{k}, r{k}, r{k} + p{k} * beta AS p{k}')} FROM mv{i}, be{i})"""]
    ctes.append(f"cg_x AS (SELECT node, {every(lambda k: f'x{k} AS v{k}')} FROM st{steps})")
    return ",\n".join(ctes)


def _cg_solution(spark, sf_dir):
    def build():
        tr, va, te, adj, e0 = _g_base(spark, sf_dir)
        m = IF.Model(adj, e0, LAYERS, DIM)
        b = IF.gradient(m, va.select("uid", "iid", "label"), _z(spark, sf_dir))
        return IF.conjugate_gradient(m, tr.select("uid", "iid", "label"), b, damp=0.01, tol=0.0, max_iter=CG_STEPS, z=_z(spark, sf_dir)).x
    return shared.memo(spark, ("cg_x", sf_dir), build)


@register("cg_steps_events", O.with_(*_g_sql_base(), _cg_sql()) + f"SELECT node, {O.vec_text('v', DIM, 10)} AS x FROM cg_x")
def q_cg_steps(spark, sf_dir):
    """The conjugate-gradient solution after two steps from the valid gradient."""
    return _cg_solution(spark, sf_dir).select("node", _vtext("vec", 10).alias("x"))


GN_TOL = 1e-18


def _gn_solution(spark, sf_dir):
    """(x, steps, r.r) of the Gauss-Newton solve, to its tolerance."""
    def build():
        tr, va, te, adj, e0 = _g_base(spark, sf_dir)
        z = _z(spark, sf_dir)
        b = IF.gradient(IF.Model(adj, e0, LAYERS, DIM), va.select("uid", "iid", "label"), z)
        res = IF.solve(IF.Model(adj, e0, LAYERS, DIM), tr.select("uid", "iid", "label"), b, damp=0.01, tol=GN_TOL, z=z, gauss_newton=True)
        return res.x.withColumn("steps", F.lit(res.steps)).withColumn("residual", F.lit(res.rr))
    return shared.memo(spark, ("gn_x", sf_dir), build)


@register("row_influence_events", O.with_(*_g_sql_base(), _cg_sql(GN_STEPS, True), O.propagate_ctes("adj", "cg_x", "xp", LAYERS, DIM))
          + f"""SELECT uid, iid, round(-(sig - label) * s, 8) AS score, (SELECT sum({' + '.join(f'r{k} * r{k}' for k in range(DIM))}) FROM st{GN_STEPS}) <= {GN_TOL} AS converged FROM (
  SELECT p.uid, p.iid, p.label, {O.sigmoid_sql(O.dot_sql('zu.v', 'zi.v', DIM))} AS sig, {O.dot_sql('xu.v', 'zi.v', DIM)} + {O.dot_sql('zu.v', 'xi.v', DIM)} AS s
  FROM {O.part_sql('events', 'test')} p JOIN z zu ON zu.node = p.uid * 2 JOIN z zi ON zi.node = p.iid * 2 + 1
  JOIN xp xu ON xu.node = p.uid * 2 JOIN xp xi ON xi.node = p.iid * 2 + 1)""")
def q_row_influence(spark, sf_dir):
    """Influence of every test row on the valid loss, under the Gauss-Newton
    system solved to its tolerance; ``converged`` says that the residual is below it."""
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    rows = te.select(F.struct("uid", "iid").alias("row_id"), "uid", "iid", "label")
    x = _gn_solution(spark, sf_dir)
    s = IF.row_influence(IF.Model(adj, e0, LAYERS, DIM), rows, x.select("node", "vec"), _z(spark, sf_dir))
    residual = x.agg(F.max("residual")).first()[0]
    return s.select("row_id.uid", "row_id.iid", F.round("score", 8).alias("score"), F.lit(residual <= GN_TOL).alias("converged"))


# ---------------------------------------------------------------- month-window cohorts, closed evaluation range, variants
_MONTHS_RANGE = ("1996-01-01", "2001-06-30")


@register("month_samples_orders", O.with_(O.base_ctes("orders"), O.samples_ctes("orders", cohorts=O.cohort_ctes(
    "orders", fake_cold=O.fake_cold_ctes("orders"), env=O.month_env("orders", *_MONTHS_RANGE))))
          + f"SELECT uid, iid, env, label, {O.ts_text('ts')} AS ts, array_to_string(his, ',') AS his FROM samples_orders WHERE env <> 2")
def q_month_samples(spark, sf_dir):
    """Closed date range, the last 12 months of the month index as test
    window, fake cold items held out; their rows (env 2) stay in the histories
    but are not exported."""
    s = prep.samples(spark, sf_dir, "orders", prep.PrepOptions(date_range=_MONTHS_RANGE, fake_cold_ratio=0.2))
    return s.where(F.col("env") != cohorts.ENV_FAKE_COLD).select(
        "uid", "iid", "env", "label", ts_text("ts").alias("ts"), arr_text("his").alias("his"))


@register("row_sample_exact_orders", O.with_(O.all_ctes("orders"))
          + f"""SELECT uid, iid, rating FROM (SELECT *, row_number() OVER (ORDER BY {O.hash_key('2024', 'uid', 'iid', 'CAST(rating AS INTEGER)')}, uid, iid, rating) AS r,
  count(*) OVER () AS n FROM {O.part_sql('orders', 'train')}) WHERE r <= CAST(floor(n * 0.3) AS BIGINT)""")
def q_row_sample_exact(spark, sf_dir):
    """Exactly floor(0.3 n) rows, first in md5 order."""
    from ..operators.splits import sample_exact
    tr = shared.part(spark, sf_dir, "orders", "train").withColumn("rating", F.col("rating").cast("int"))
    return sample_exact(tr, int(tr.count() * 0.3), 2024, "uid", "iid", "rating").select("uid", "iid", F.col("rating").cast("double").alias("rating"))


@register("accuracy_batches_orders", O.with_(O.all_ctes("orders"), _pred_sql())
          + """SELECT round(avg(h), 6) AS acc_reported, round(avg(o), 6) AS acc FROM (
  SELECT avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1.0 ELSE score END) = label THEN 1.0 ELSE 0.0 END) AS h,
         avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) = label THEN 1.0 ELSE 0.0 END) AS o
  FROM (SELECT *, row_number() OVER (ORDER BY split, uid, iid, score, label) AS rn FROM pred) GROUP BY (rn - 1) // 512)""")
def q_accuracy_batches(spark, sf_dir):
    """E5: the mean over batches of 512 rows in (split, uid, iid) order."""
    p = global_positions(predictions(spark, sf_dir), ["split", "uid", "iid", "score", "label"], "row_id")
    a = E.accuracy(p, batch=512)
    return a.select(r6("acc_reported").alias("acc_reported"), r6("acc").alias("acc"))


@register("influence_samples_orders", O.with_(O.all_ctes("orders"))
          + f"""SELECT uid, iid, trim(title) AS title_text, 1 AS label, 1 AS pos_label, 0 AS neg_label,
  round({O.hash_unit('61', 'uid', 'iid')}, 6) AS pos_if, round({O.hash_unit('62', 'uid', 'iid')}, 6) AS neg_if,
  round(abs({O.hash_unit('61', 'uid', 'iid')} - {O.hash_unit('62', 'uid', 'iid')}), 6) AS dpo_weight FROM {O.part_sql('orders', 'valid')}""")
def q_influence_samples(spark, sf_dir):
    """T-10, third projection: pairs of answers with their influences."""
    v = shared.part(spark, sf_dir, "orders", "valid")
    x = v.withColumn("pos_if", hash_unit(61, "uid", "iid")).withColumn("neg_if", hash_unit(62, "uid", "iid"))
    x = x.withColumn("dpo_weight", F.abs(F.col("pos_if") - F.col("neg_if")))
    out = T.influence_sample(x)
    return out.select("uid", "iid", "title_text", "label", "pos_label", "neg_label", *[r6(c).alias(c) for c in ("pos_if", "neg_if", "dpo_weight")])


@register("vocabulary_scores_events", O.with_(O.all_ctes("events"), f"""
lg AS (SELECT uid, iid, {', '.join(f"({O.hash_unit(str(70 + k), 'uid', 'iid')} * 6.0 - 3.0) AS l{k}" for k in range(4))} FROM {O.part_sql('events', 'valid')}),
sm AS (SELECT *, exp(l0) + exp(l1) + exp(l2) + exp(l3) AS t FROM lg)""")
          + f"SELECT uid, iid, round({O.sigmoid_sql('(exp(l1) / t - exp(l2) / t)')}, 6) AS prob, round(l1, 6) AS raw FROM sm")
def q_vocabulary_scores(spark, sf_dir):
    """P10 options: two-class form after a softmax over the vocabulary; the raw positive logit."""
    from ..functions.exprs import raw_logit, vocabulary_prob
    v = shared.part(spark, sf_dir, "events", "valid")
    x = v.select("uid", "iid", F.array(*[hash_unit(70 + k, "uid", "iid") * 6.0 - 3.0 for k in range(4)]).alias("logits"))
    return x.select("uid", "iid", r6(vocabulary_prob("logits", 1, 2)).alias("prob"), r6(raw_logit("logits", 1)).alias("raw"))


@register("what_if_scores_events", O.with_(
    O.all_ctes("events"), O.adjacency_ctes(f"(SELECT * FROM {O.part_sql('events', 'train')} WHERE (uid + iid) % 5 <> 0)", "adj2"),
    _g_sql_base()[2], O.propagate_ctes("adj2", "e0", "z2", LAYERS, DIM))
          + f"""SELECT uid, iid, round({O.sigmoid_sql('logit')}, 6) AS prob FROM (SELECT p.uid, p.iid, {O.dot_sql('u.v', 'i.v', DIM)} AS logit
  FROM {O.part_sql('events', 'valid')} p JOIN z2 u ON u.node = p.uid * 2 JOIN z2 i ON i.node = p.iid * 2 + 1)""")
def q_what_if(spark, sf_dir):
    """M4: scores if a fifth of the train rows were not in the graph."""
    tr, va, te, adj, e0 = _g_base(spark, sf_dir)
    other = M.adjacency(tr.where((F.col("uid") + F.col("iid")) % 5 != 0))
    return M.what_if_scores(other, e0, va.select("uid", "iid"), LAYERS, DIM).select("uid", "iid", r6("prob").alias("prob"))


@register("template_choice_orders", O.with_(O.all_ctes("orders"), O.candidates_ctes("orders", "v0"))
          + f"SELECT row_id, ['A <title>', 'B <title>', 'C <title>'][CAST(least(floor({O.hash_unit('4', 'row_id')} * 3), 2) AS INTEGER) + 1] AS template FROM cand")
def q_templates(spark, sf_dir):
    """T-7: a template per training row."""
    ts = ["A <title>", "B <title>", "C <title>"]
    return _cands(spark, sf_dir, "orders", "v0")[0].select("row_id", T.choose_template(ts, "train", seed=4).alias("template"))


@register("train_files_events", O.with_(O.all_ctes("events"))
          + f"SELECT uid, iid, label FROM {O.part_sql('events', 'train')} UNION ALL SELECT uid, iid, label FROM {O.part_sql('events', 'valid', 1)}")
def q_train_files(spark, sf_dir):
    """Train files and the valid files of all rounds but the last."""
    path = {}
    for part, num in (("train", 0), ("valid", 1), ("valid", 2)):
        df = shared.part(spark, sf_dir, "events", part, num).select("uid", "iid", "label")
        path[part, num] = K.write_parquet(df, K.scratch_dir(spark, f"{part}{num}"), [])
    return R.read_train_files(spark, [path["train", 0]], [path["valid", 1], path["valid", 2]])


# ---------------------------------------------------------------- whole-job forms beside the twins above
@register("closed_range_events", O.with_(O.base_ctes("events"), O.cohort_ctes("events", eval_end="2024-01-27"))
          + f"SELECT uid, iid, env, {O.ts_text('ts')} AS ts FROM cohort_events "
            "WHERE title IS NOT NULL AND title_idx IS NOT NULL AND publish_time IS NOT NULL")
def q_closed_range(spark, sf_dir):
    """C1 with the closed end of the evaluation range and the drop of
    incomplete rows over the whole item table."""
    c = prep.cohort_rows(spark, sf_dir, "events", prep.PrepOptions(eval_end="2024-01-27", drop_incomplete=True))
    return c.select("uid", "iid", "env", ts_text("ts").alias("ts"))
