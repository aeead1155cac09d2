"""Personal data: candidate generators scored by boosted trees (DataFrame functions only).

1. Base spans: the four strict patterns with their checks (octets, Luhn,
   digit counts). They are always redacted.
2. High-recall generators propose overlapping spans: anything that looks
   like an address with or without a proper @, any run of digits with
   separators, and the pieces of such runs that are as long as a card or shaped
   like a phone number (the strict patterns take the longest run and give up on it).
3. A gradient-boosted classifier scores a candidate by its format (digits, check
   digit, separators, dots, brackets, length) and context (telling words before it,
   neighbouring characters). It is trained on the corpus itself. Positive are
   candidates that are a base span, and the same ones worn down: the @ written
   out, the plus gone, the digits in groups, so that no single mark decides. All
   other candidates that no base span covers are negative: numbers with a wrong
   check digit, runs inside hashes, dates. Features are small whole numbers, so
   training sees one weighted row per distinct feature vector and label, counted
   over all documents.
4. Per generator, the threshold is calibrated on documents kept out of the
   training: the lowest score from which ``PRECISION`` of the candidates, worn ones
   included, are positive. Candidates above it are redacted too, unless a base
   span already covers them.

The fitted trees are compiled into column expressions, so finding spans in a
document is one projection without a shuffle. Places and covers come from
two-level folds, so a text with very many matches costs little more than its length.

Defined cases: null and empty texts hold nothing; texts of any length are read whole;
overlapping and equal spans of different kinds are all listed, by kind and start; every row stands for itself, so rows that
repeat a doc_id, null ids and other columns change nothing; without
candidates of both labels nothing is added to the base spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import stored, text_of
from .spans import fence_free, fenced, let, running, spans_in, written

# The patterns of the contract. A look-behind and possessive
# repeats keep them linear on long runs without changing what they match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "handle", "number", "piece"]
BASE = 4

HANDLE = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?"
          r"[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+")
NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
PIECE = (r"(?<![0-9])[0-9]{13,19}+(?![0-9])|(?<![0-9])\+?[0-9]{0,2}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
TELLING = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|iban|mail|contact|write|ip|host|address)\W{0,4}$"

BEFORE = 16
PRECISION = 0.98
TREES, DEPTH, SEED = 10, 3, 7
#: Largest value of each feature; the number of distinct feature vectors is bounded by them.
FEATURES = {"digits": 20, "luhn": 1, "length": 24, "dots": 4, "blanks": 4, "dashes": 4, "at": 1, "plus": 1, "bracket": 1, "word_before": 1, "glued": 2}


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def part(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", ""))


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CHECKS = [
    lambda v: F.lit(True),
    lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    lambda v: (_digits(v) <= 19) & _luhn(v),
    lambda v: _digits(v).between(9, 15),
]


def candidates(docs: DataFrame, keep: list[str], text: Column, worn: bool = False) -> DataFrame:
    """``keep``, the base spans (start, kind, end) and the proposed ones with their features;
    with ``worn`` also the features of the value worn down."""
    clean = docs.select(*keep, fence_free(text).alias("__text"))
    patterns = [EMAIL, IP, CARD, PHONE, HANDLE, NUMBER, PIECE]
    marked = clean.select(*keep, *[fenced(F.col("__text"), p).alias(f"__f{k}") for k, p in enumerate(patterns)])
    placed = marked.select(*keep, *[
        (F.filter(spans_in(F.col(f"__f{k}"), BEFORE), _passes(k)) if k < BASE else spans_in(F.col(f"__f{k}"), BEFORE)).alias(f"__s{k}")
        for k in range(len(patterns))])
    base = F.concat(*[F.transform(f"__s{k}", _tagged(k)) for k in range(BASE)])
    more = F.concat(*[F.transform(f"__s{k}", _valued(k)) for k in range(BASE, len(patterns))])
    both = placed.select(*keep, base.alias("__base"), more.alias("__proposed"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,more:struct<value:string,low:int,high:int,before:string,after:string>,covered:boolean,exact:boolean>>")
    told = both.select(*keep, "__base", F.when(F.size("__proposed") > 0, _related("__base", "__proposed")).otherwise(none).alias("__told"))
    return told.select(*keep, "__base", F.transform("__told", lambda s: _described(s, worn)).alias("__more"))


def _passes(kind: int):
    return lambda s: CHECKS[kind](s["value"])


def _tagged(kind: int):
    return lambda s: _span(F.lit(kind), s)


def _span(kind: Column, s: Column) -> Column:
    return F.struct(kind.alias("kind"), *[s[c].alias(c) for c in ("start", "end", "low", "high")])


def _valued(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                              F.struct(*[s[c].alias(c) for c in ("value", "low", "high", "before", "after")]).alias("more"))


def _related(base: str, more: str) -> Column:
    """The proposed spans with whether a base span covers them and whether one is the same.

    Sorted by start, longer ones first and base spans before equal proposals, what came
    before a proposal decides: the farthest base end, and the last base span."""
    details = "struct<value:string,low:int,high:int,before:string,after:string>"

    def row(s, proposal: bool, more: Column):
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("rev"), F.lit(proposal).alias("proposal"), s["kind"].alias("kind"), s["end"].alias("end"), more.alias("more"))
    rows = F.sort_array(F.concat(F.transform(base, lambda s: row(s, False, F.lit(None).cast(details))),
                                 F.transform(more, lambda s: row(s, True, s["more"]))))
    greater = lambda a, b: F.greatest(a, b)
    wide = F.lit(1 << 32).cast("long")
    key = lambda r: r["start"].cast("long") * wide + F.lit(1 << 31) - r["end"].cast("long")
    unless = lambda r, v: F.when(r["proposal"], F.lit(-1).cast("long")).otherwise(v)

    def joined(all_rows):
        reach = running(F.transform(all_rows, lambda r: unless(r, r["end"].cast("long"))), greater, F.lit(-1))
        last = running(F.transform(all_rows, lambda r: unless(r, key(r))), greater, F.lit(-1))
        told = F.zip_with(all_rows, F.zip_with(reach, last, lambda a, b: F.struct(a.alias("reach"), b.alias("last"))), lambda r, b: F.struct(
            r["proposal"].alias("proposal"), F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), r["more"].alias("more"),
                                                      (b["reach"] >= r["end"]).alias("covered"), (b["last"] == key(r)).alias("exact")).alias("told")))
        return F.transform(F.filter(told, lambda t: t["proposal"]), lambda t: t["told"])
    return let(rows, joined)


def _features(value: Column, before: Column, after: Column) -> list[Column]:
    count = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    raw = {"digits": _digits(value), "luhn": F.when(_digits(value).between(13, 19), _luhn(value).cast("int")).otherwise(0),
           "length": F.length(value), "dots": count("."), "blanks": count(" "), "dashes": count("-"),
           "at": F.contains(value, F.lit("@")).cast("int"), "plus": F.contains(value, F.lit("+")).cast("int"),
           "bracket": F.contains(value, F.lit("(")).cast("int"), "word_before": before.rlike(TELLING).cast("int"),
           "glued": before.rlike(r"\w$").cast("int") + after.rlike(r"\w").cast("int")}
    return [F.least(raw[f], F.lit(most)).cast("int").alias(f) for f, most in FEATURES.items()]


def _worn(value: Column) -> Column:
    """The value as people write it to hide it, or sloppily."""
    return (F.when(F.contains(value, F.lit("@")), F.regexp_replace(value, "@", " (at) "))
            .when(value.startswith("+"), F.substring(value, F.lit(2), F.length(value)))
            .otherwise(F.regexp_replace(value, "([0-9]{4})(?=[0-9]{4})", "$1-")))


def _described(span: Column, worn: bool) -> Column:
    value, before, after = (span["more"][c] for c in ("value", "before", "after"))
    more = [F.struct(*_features(_worn(value), before, after)).alias("worn")] if worn else []
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["more"]["low"].alias("low"), span["more"]["high"].alias("high"),
                    span["exact"].alias("positive"), span["covered"].alias("covered"), *_features(value, before, after), *more)


@dataclass
class Model:
    """Boosted trees and a threshold per generator; none where nothing could be learnt."""

    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, span: Column) -> Column:
        return trees.boosted(self.trees, [span[f] for f in FEATURES])

    def selects(self, span: Column) -> Column:
        chosen = F.lit(False)
        for kind, least in self.thresholds.items():
            chosen = chosen | ((span["kind"] == kind) & (self.score(span) >= least))
        return chosen & ~span["covered"]


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Model:
    """Trees and calibrated thresholds from the candidates of all documents."""
    texts = docs.select(text_of(text_col).alias("text")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    found = candidates(texts, ["held"], F.col("text"), worn=True).select("held", F.explode("__more").alias("c"))
    # what a base span covers without being it says nothing; positives count twice, as they are and worn
    plain = F.struct(*[F.col(f"c.{f}") for f in FEATURES])
    rows = found.filter("c.positive or not c.covered").select(
        "held", "c.kind", "c.positive", F.explode(F.when(F.col("c.positive"), F.array(plain, F.col("c.worn"))).otherwise(F.array(plain))).alias("c"))
    counted = stored(rows.groupBy("held", "kind", "positive", *[f"c.{f}" for f in FEATURES])
                     .agg(F.count("*").alias("weight")), "candidate-counts")
    labels = {r["positive"] for r in counted.filter("not held").select("positive").distinct().collect()}
    if labels != {True, False}:
        return Model()
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(
        counted.withColumn("label", F.col("positive").cast("double")).withColumn("weight", F.col("weight").cast("double")))
    train = table.filter("not held").select("x", "label", "weight", *FEATURES).coalesce(1).sortWithinPartitions("label", *FEATURES)
    fitted = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(train)
    scored = fitted.transform(table.filter("held")).select(
        "kind", "positive", "weight", F.floor(vector_to_array("probability")[1] * 1000).cast("int").alias("score"))
    model = Model(trees.parse(fitted.toDebugString))
    sums: dict[int, list] = {}
    for r in scored.groupBy("kind", "score").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("positive"), F.col("weight")).otherwise(0.0)).alias("good")).collect():
        sums.setdefault(r["kind"], []).append((r["score"], r["n"], r["good"]))
    for kind, bins in sums.items():
        n = good = 0.0
        for score, all_, right in sorted(bins, reverse=True):
            n, good = n + all_, good + right
            if good >= precision * n:
                model.thresholds[kind] = score / 1000
    return model


def find(docs: DataFrame, model: Model, keep: list[str], text: Column) -> DataFrame:
    """``keep``, ``base`` and ``spans`` (all), as arrays by kind and then start; places in code points, low and high in bytes."""
    found = candidates(docs, keep, text)
    more = F.transform(F.filter("__more", model.selects), lambda s: _span(s["kind"], s))
    return found.select(*keep, F.sort_array("__base").alias("base"), F.sort_array(F.concat("__base", more)).alias("spans"))


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"], text_of("text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
                        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, as [KIND] of the first.

    Sorted by start, longer ones first, a span opens a mark where the ends before it do not
    reach it; the bytes between marks are kept, and all pieces are joined once."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["low"].alias("low"), (-s["high"]).alias("rev"), s["kind"].alias("kind"))))

    def joined(rows, body):
        reach = running(F.transform(rows, lambda r: -r["rev"].cast("long")), lambda a, b: F.greatest(a, b), F.lit(0))

        def pieces(ends):
            before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1))
            part = lambda a, n: F.decode(F.substring(body, (a + 1).cast("int"), n.cast("int")), "UTF-8")
            marks = F.zip_with(rows, before, lambda r, a: F.when(r["low"] >= a, F.concat(part(a, r["low"] - a), F.element_at(names, r["kind"] + 1))).otherwise(F.lit("")))
            rest = part(F.element_at(ends, -1), F.octet_length(body))
            return F.concat(F.array_join(marks, ""), rest)
        return let(reach, pieces)
    marked = let(F.struct(by_place.alias("rows"), F.encode(text, "UTF-8").alias("body")), lambda x: joined(x["rows"], x["body"]))
    return F.when(F.size(spans) > 0, marked).otherwise(text)
