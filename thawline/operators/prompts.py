"""T-1..T-10: sample projections and prompt rendering, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinel text, placeholders, answer words.
UNKNOWN_HISTORY = "unknow"
PLACEHOLDER = "<unk>"
ANSWERS = {"v2": ("Yes", "No"), "v1": ("former", "latter")}
# Our own template wording (the reference ships none); placeholders as in its prompts.
DEFAULT_TEMPLATE = ("#Question: A user has given high ratings to the following items: <his_title>. "
                    "Their ids are <his>. Would the user enjoy the item <title> (<iid>)? "
                    "Answer with Yes or No. #Answer:")


def title_list_text(titles) -> Column:
    """T-1: drop empty titles, quote, join with ', '; nothing left -> 'unknow'."""
    t = F.filter(titles if isinstance(titles, Column) else F.col(titles), lambda x: F.length(x) > 0)
    q = F.transform(t, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.when(F.size(q) > 0, F.array_join(q, ", ")).otherwise(F.lit(UNKNOWN_HISTORY))


def max_history_length(df: DataFrame, cap: int = 15) -> int:
    """min(max(len(his)), cap) - one scalar."""
    m = df.agg(F.max(F.size("his")).alias("m")).first()["m"] or 0
    return min(int(m), cap)


def interacted_num(his, max_length: int) -> Column:
    """T-3: len(his), minus 1 when his[0] == 0; max_length when truncated."""
    h = F.col(his) if isinstance(his, str) else his
    n = F.size(h) - (F.element_at(h, 1) == 0).cast("int")
    return F.when(F.size(h) > max_length, F.lit(max_length)).otherwise(n)


def pad_history(his, max_length: int) -> Column:
    """T-2: left-pad with 0 to max_length, keep the last max_length."""
    h = F.col(his) if isinstance(his, str) else his
    short = F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(max_length) - F.size(h)), h)
    last = F.slice(h, F.size(h) - max_length + 1, max_length)
    return F.when(F.size(h) < max_length, short).when(F.size(h) > max_length, last).otherwise(h)


def last_titles(his_title, n) -> Column:
    """T-4: his_title[-n:]; n = 0 keeps the whole list (Python's [-0:])."""
    t = F.col(his_title) if isinstance(his_title, str) else his_title
    return F.when(n == 0, t).otherwise(F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), n))


def delete_zeros(his) -> Column:
    """T-9: remove 0 from the history, default [0]."""
    h = F.col(his) if isinstance(his, str) else his
    nz = F.filter(h, lambda x: x != 0)
    return F.when(F.size(nz) == 0, F.array(F.lit(0).cast("long"))).otherwise(nz)


def answer_text(label, mode: str = "v2") -> Column:
    """T-8: 1 -> Yes / former, 0 -> No / latter."""
    pos, neg = ANSWERS[mode]
    return F.when(F.col(label) == 1, F.lit(pos)).otherwise(F.lit(neg))


def llm_sample(df: DataFrame, max_length: int, keep: tuple = ()) -> DataFrame:
    """T-10 (LLM form) with T-2..T-5: uid, his_pad, his_title text, iid,
    quoted title, InteractedNum, label (+ row_id and ``keep`` columns)."""
    n = interacted_num("his", max_length)
    return df.select(
        "uid", pad_history("his", max_length).alias("his_pad"),
        title_list_text(last_titles("his_title", n)).alias("his_title_text"),
        "iid", title_text("title").alias("title_text"),
        n.alias("interacted_num"), "label", *[c for c in ("row_id",) if c in df.columns], *keep)


def id_sample(df: DataFrame) -> DataFrame:
    """T-10 (id form) with T-5 without history: stripped title."""
    return df.select("uid", "iid", F.trim(F.col("title")).alias("title_text"), "label")


def influence_sample(df: DataFrame, max_length: int | None = None) -> DataFrame:
    """T-10 (influence form): both answers of a pair (labels 1 and 0) with
    their influences and the pair's weight; with histories when ``max_length``
    is given, else ids and the stripped title."""
    own = [F.lit(1).alias("label"), F.lit(1).alias("pos_label"), F.lit(0).alias("neg_label"), "pos_if", "neg_if", "dpo_weight"]
    if max_length is None:
        return df.select("uid", "iid", F.trim(F.col("title")).alias("title_text"), *own)
    base = llm_sample(df.withColumn("label", F.lit(1)), max_length, keep=("pos_if", "neg_if", "dpo_weight"))
    return base.select(*[c for c in base.columns if c not in ("label", "pos_if", "neg_if", "dpo_weight")], *own)


def choose_template(templates: list[str], mode: str = "generate", seed: int = 0,
                    key: str = "row_id") -> Column:
    """T-7: the first template when generating; when training, a template
    drawn per row from md5(seed:key) (the deterministic stand-in for a
    random choice per batch)."""
    if mode == "generate" or len(templates) == 1:
        return F.lit(templates[0])
    from ..functions.exprs import hash_unit
    idx = F.least(F.floor(hash_unit(seed, key) * len(templates)), F.lit(len(templates) - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(t) for t in templates]), idx + 1)


def title_text(title) -> Column:
    """The quoted title of a row."""
    return F.concat(F.lit('"'), F.col(title), F.lit('"'))


def render_history(sample: DataFrame, template=DEFAULT_TEMPLATE, placeholder: str = PLACEHOLDER) -> DataFrame:
    """T-6 up to the item: '<s>' + template; <uid>/<iid>/<DCNFeature> -> placeholder;
    <his> -> placeholder x InteractedNum joined by ', '; <his_title> filled. Rows of
    one history share this text, <title> is still open in it."""
    base = F.concat(F.lit("<s>"), template if isinstance(template, Column) else F.lit(template))
    for tag in ("<uid>", "<iid>", "<DCNFeature>"):
        base = F.replace(base, F.lit(tag), F.lit(placeholder))
    his = F.array_join(F.array_repeat(F.lit(placeholder), F.col("interacted_num").cast("int")), ", ")
    p = F.replace(base, F.lit("<his>"), his)
    return sample.withColumn("prompt", F.replace(p, F.lit("<his_title>"), F.col("his_title_text")))


def render_title(sample: DataFrame) -> DataFrame:
    """The last step of T-6: <title> filled from ``title_text``."""
    return sample.withColumn("prompt", F.replace(F.col("prompt"), F.lit("<title>"), F.col("title_text")))


def render_prompt(sample: DataFrame, template=DEFAULT_TEMPLATE, placeholder: str = PLACEHOLDER) -> DataFrame:
    """T-6: the whole text. Chained native ``replace``; no Python per row.
    ``template`` is a string or a Column (e.g. ``choose_template``)."""
    return render_title(render_history(sample, template, placeholder))
