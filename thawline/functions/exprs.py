"""Scalar column expressions shared by the operators.

Nothing here runs Python per row: every function returns a Spark ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Integer division with SQL ``div`` semantics."""
    return F.expr(f"({_sql(a)}) div ({_sql(b)})")


def _sql(x) -> str:
    return x if isinstance(x, str) else str(x)


# ---------------------------------------------------------------- hashing
def hash_unit(*parts) -> Column:
    """Deterministic draw in [0, 1] from the first 8 hex digits of
    ``md5(concat_ws(':', parts...))``. DuckDB computes the same number, so
    "random" orders and stub scores have an oracle twin."""
    key = F.concat_ws(":", *[col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p))
                              for p in parts])
    h8 = F.substring(F.md5(key), 1, 8)
    return F.conv(h8, 16, 10).cast("bigint").cast("double") / F.lit(4294967295.0)


def hash_signed(*parts) -> Column:
    """Same draw scaled to [-1, 1]."""
    return hash_unit(*parts) * 2.0 - 1.0


def hash_order_key(*parts) -> Column:
    """Full md5 hex as a sort key (ties impossible in practice, broken by the key)."""
    key = F.concat_ws(":", *[col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p))
                              for p in parts])
    return F.md5(key)


# ---------------------------------------------------------------- math
def sigmoid(x) -> Column:
    x = col(x)
    # stable on both tails
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def two_class_prob(pos, neg) -> Column:
    """exp(pos) / (exp(pos) + exp(neg)) in the overflow-free form (P10)."""
    return sigmoid(col(pos) - col(neg))


def vocabulary_prob(logits, pos: int, neg: int) -> Column:
    """P10 with the vocabulary option: the two answers' probabilities after a
    softmax over all ``logits`` (an array) go through the two-class form."""
    x = col(logits)
    top = F.array_max(x)
    total = F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda acc, v: acc + v)
    share = lambda k: F.exp(F.element_at(x, k + 1) - top) / total
    return sigmoid(share(pos) - share(neg))


def raw_logit(logits, pos: int) -> Column:
    """P10, second mode: the positive answer's logit as it is."""
    return F.element_at(col(logits), pos + 1)


def bce_with_logits(logit, label) -> Column:
    """max(s,0) - s*y + log1p(exp(-|s|)) (M6)."""
    s, y = col(logit), col(label).cast("double")
    return F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))


def dot(a, b) -> Column:
    """Dot product of two equally long numeric arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def vec_scale(a, s) -> Column:
    return F.transform(col(a), lambda x: x * col(s))


def vec_add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def vec_norm2(a) -> Column:
    return F.aggregate(F.transform(col(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v)


def binarize(x, at: float = 0.5) -> Column:
    """1 when the score is strictly above the cut."""
    return F.when(col(x) > at, 1).otherwise(0)


def label_from_rating(r, at: float = 4.0) -> Column:
    """Binary label rating >= 4."""
    return (col(r) >= at).cast("int")


# ---------------------------------------------------------------- keys / dates
def imdb_key(x) -> Column:
    """P2: 'tt' + id left-padded to 7 digits, never truncating longer ids."""
    s = col(x).cast("string")
    return F.concat(F.lit("tt"), F.when(F.length(s) < 7, F.lpad(s, 7, "0")).otherwise(s))


def publication_date(details) -> Column:
    """Publication date from a details map<string,string>.

    With a ``Publisher`` key: the text inside the first ``(...)`` when there
    is one, else the whole value, parsed as ``Month d, yyyy``; a failed parse
    is null with no fallback. Otherwise the ``Publication Date`` value is
    parsed. Otherwise null.
    """
    d = col(details)
    pub = F.element_at(d, F.lit("Publisher"))
    inner = F.when(pub.rlike(r"\(.*?\)"), F.regexp_extract(pub, r"\((.*?)\)", 1)).otherwise(pub)
    pdate = F.element_at(d, F.lit("Publication Date"))
    parse = lambda s: F.to_date(F.try_to_timestamp(s, F.lit("MMMM d, yyyy")))
    return (F.when(F.map_contains_key(d, "Publisher"), parse(inner))
             .when(F.map_contains_key(d, "Publication Date"), parse(pdate)))


# ---------------------------------------------------------------- rendering
def arr_text(a, sep: str = ",") -> Column:
    """Array rendered as text (element order kept)."""
    return F.array_join(F.transform(col(a), lambda v: v.cast("string")), sep, "")


def ts_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c) -> Column:
    """Round a double to 6 places (oracle hygiene)."""
    return F.round(col(c).cast("double"), 6)
