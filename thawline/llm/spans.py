"""Match positions with DataFrame functions only.

Spark's regular expression functions return matched strings, not places.
Here matches are fenced by one character, the text is split at the fences,
the odd pieces are the matches and places are running lengths in code
points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE, STAND_IN = chr(0xE000), chr(0xE001)
SPAN = "struct<start:int,end:int,value:string>"


def fence_free(text: Column) -> Column:
    """The text without the fence character; its stand-in is as long and no pattern here matches either."""
    return F.when(F.contains(text, F.lit(FENCE)), F.translate(text, FENCE, STAND_IN)).otherwise(text)


def fenced(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"({pattern})", f"{FENCE}$1{FENCE}")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, zero: Column) -> Column:
    """Running results of an associative ``combine`` over an array, each including its own element.

    A fold that appends copies what it holds, so m steps in a row cost m * m. Here blocks of
    sqrt(m) elements are folded on their own and shifted by the results before them."""
    none = F.array().cast("array<bigint>")
    start = F.struct(zero.cast("long").alias("at"), none.alias("out"))

    def fold(block):
        def step(acc, x):
            now = combine(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))
        return F.aggregate(block, start, step)

    def shifted(blocks):
        def step(acc, b):
            return F.struct(combine(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        before = F.aggregate(blocks, start, step, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["out"], lambda v: combine(o, v))))

    def cut(array):
        size = F.ceil(F.sqrt(F.size(array).cast("double"))).cast("int")
        count = F.ceil(F.size(array) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: fold(F.slice(array, k * size + 1, size)))
    return let(values, lambda array: F.when(F.size(array) == 0, none).otherwise(let(cut(array), shifted)))


def spans_in(fenced_text: Column, around: int = 0) -> Column:
    """array<struct<start, end, value>> of the fenced matches, in order.

    With ``around`` also low and high, the places in bytes, and up to so many characters
    before the match and one behind it, as far as the neighbouring matches leave them. They come
    from the pieces themselves: taking a substring of a text costs a walk to its place."""
    more = "struct<start:int,end:int,value:string,low:int,high:int,before:string,after:string>" if around else SPAN
    none = F.array().cast(f"array<{more}>")
    add = lambda a, b: a + b

    def picked(parts):
        ends = running(F.transform(parts, lambda p: F.length(p).cast("long")), add, F.lit(0))
        odd = F.sequence(F.lit(2), F.size(parts), F.lit(2))  # a match lies between two fences

        def at(e, i):
            return [F.element_at(e, i - 1).cast("int").alias("start"), F.element_at(e, i).cast("int").alias("end"), F.element_at(parts, i).alias("value")]
        if not around:
            return let(ends, lambda e: F.transform(odd, lambda i: F.struct(*at(e, i))))
        bytes_ = running(F.transform(parts, lambda p: F.octet_length(p).cast("long")), add, F.lit(0))
        return let(F.struct(ends.alias("e"), bytes_.alias("b")), lambda p: F.transform(odd, lambda i: F.struct(
            *at(p["e"], i), F.element_at(p["b"], i - 1).cast("int").alias("low"), F.element_at(p["b"], i).cast("int").alias("high"),
            F.substring(F.element_at(parts, i - 1), -around, around).alias("before"),
            F.coalesce(F.substring(F.try_element_at(parts, i + 1), 1, 1), F.lit("")).alias("after"))))
    return F.when(F.contains(fenced_text, F.lit(FENCE)), let(F.split(fenced_text, FENCE), picked)).otherwise(none)


def written(spans: Column, kinds: list[str]) -> Column:
    """"kind:start:end" of structs that name their kind by number, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(
        F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))
