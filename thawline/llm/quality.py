"""Quality scores by a sparse rule ensemble.

1. Statistics: native columns over the whole text (lengths, shares of odd
   characters, repetition of words and lines).
2. Rules: boosted trees are fitted to labelled documents and every path of
   every tree becomes a conjunction of bounds on statistics.
3. Weights: a logistic regression with a lasso penalty over the rules (0/1)
   leaves few of them.
4. The rules with weight are compiled into one Spark column expression;
   scoring a document is a projection without a shuffle.

The fit may use a bounded sample of the labelled texts (``MAX_TRAIN``, the
ones with the smallest hashes of id and text; rows that repeat both are one). Labels,
language, source and id are never inputs of a score.

Defined cases: null text is empty and scored like any other; texts of any length are
read whole; documents that repeat an id are scored one by one; an empty table gives an empty result; several labels of an id count as the
largest; a null id is scored and held out; with no labels of both classes every score
is the share of good labels (1.0 without labels); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import stored, text_of

MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 12, 3, 11
LASSO = 0.002
THRESHOLD = 0.3
FOLDS = 5


def statistics(text: Column) -> dict[str, Column]:
    """Column expressions over ``words``, ``lines`` and the text itself."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.col("__words"), F.col("__lines")
    many = F.greatest(F.size(words), F.lit(1)).cast("double")
    gone = lambda find: F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))
    hits = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "chars": F.length(text).cast("double"), "words": F.size(words).cast("double"), "word_length": n / many,
        "distinct": F.size(F.array_distinct(words)) / many, "repeats": hits(r"(?<!\S)(\S+)(?: \1(?!\S))++") / many,
        "lines": F.size(lines).cast("double"), "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "caps": hits(r"\p{Lu}{2,}+") / many, "shouts": gone("!") / n, "bars": gone("|") / n,
        "symbols": hits(r"[%&#$*~^_=<>{}]++") / many, "digits": hits(r"[0-9]++") / many,
        "stops": gone(".") / many, "commas": gone(",") / many, "odd": hits(r"[^\p{L}\p{N}\p{P}\s]++") / many}


def featured(docs: DataFrame, keep: list[str], text: Column) -> tuple[DataFrame, list[str]]:
    split = docs.select(*keep, text.alias("__text")).select(
        *keep, "__text", F.split("__text", r"[ \t-\r]+").alias("__words"), F.split("__text", "\n").alias("__lines"))
    stats = statistics(F.col("__text"))
    return split.select(*keep, *[c.cast("double").alias(f"__{name}") for name, c in stats.items()]), [f"__{name}" for name in stats]


@dataclass
class Rules:
    """log-odds = intercept + sum of the weights of the rules that hold."""

    intercept: float = 0.0
    rules: list[tuple[tuple, float]] = field(default_factory=list)
    constant: float | None = None

    def score(self, features: list[Column]) -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        odds = F.lit(self.intercept)
        for path, weight in self.rules:
            odds = odds + F.when(holds(path, features), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def holds(path: tuple, features: list[Column]) -> Column:
    out = F.lit(True)
    for feature, is_at_most, at in path:
        out = out & ((features[feature] <= at) if is_at_most else (features[feature] > at))
    return out


def simplified(path: tuple) -> tuple:
    """The tightest bound per feature and side."""
    bounds: dict = {}
    for feature, is_at_most, at in path:
        known = bounds.get((feature, is_at_most))
        bounds[feature, is_at_most] = at if known is None else (min(known, at) if is_at_most else max(known, at))
    return tuple(sorted((f, side, at) for (f, side), at in bounds.items()))


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(FOLDS))


def fit(rows: DataFrame, names: list[str], max_train: int = MAX_TRAIN) -> Rules:
    """Rules from (features, label) rows; at most ``max_train`` of them."""
    picked = rows.select(*names, "label").orderBy(F.xxhash64(*names, "label"), *names).limit(max_train)
    train = stored(VectorAssembler(inputCols=names, outputCol="x").transform(picked).coalesce(1), "quality-train")
    seen = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(seen) != {0.0, 1.0}:
        return Rules(constant=next(iter(seen), 1.0))
    share = seen[1.0] / (seen[0.0] + seen[1.0])
    boosted = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3).fit(train)
    found = {simplified(p) for _, root in trees.parse(boosted.toDebugString) for p in trees.paths(root)}
    paths = sorted(found)
    if not paths:
        return Rules(constant=share)
    columns = [F.col(n) for n in names]
    marks = F.array(*[holds(p, columns).cast("double") for p in paths])
    from pyspark.ml.functions import array_to_vector
    table = stored(train.select(array_to_vector(marks).alias("rules"), "label").coalesce(1), "quality-rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=True).fit(table)
    weights = [(p, float(w)) for p, w in zip(paths, lasso.coefficients.toArray()) if w != 0.0]
    return Rules(float(lasso.intercept), weights)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[DataFrame, list[str]]:
    """Features and label of at most ``max_train`` labelled texts that may be learnt from.

    Which ones is decided on ids and text hashes, so statistics are computed for them alone."""
    known = (labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("double").alias("label")).filter("label is not null and __id is not null")
             .groupBy("__id").agg(F.max("label").alias("label")).filter(fold(F.col("__id")) != 0))
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__raw")).withColumn("__hash", F.xxhash64("__raw"))
    keys = rows.select("__id", "__hash").join(known, "__id").groupBy("__id", "__hash").agg(F.max("label").alias("label"))
    picked = stored(keys.orderBy(F.xxhash64("__id", "__hash"), "__id", "__hash").limit(max_train), "quality-sample")
    # max_train rows of three numbers: a proven bound
    texts = rows.join(F.broadcast(picked), ["__id", "__hash"])
    found, names = featured(texts, ["__id", "__hash", "label"], F.col("__raw"))
    return found.dropDuplicates(["__id", "__hash"]).drop("__hash"), names


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    rows, names = labelled(docs, labels, id_col, text_col)
    return fit(rows, names)


def quality_scores(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    rows, names = featured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__raw")), ["doc_id"], text_of("__raw"))
    score = rules.score([F.col(n) for n in names])
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
