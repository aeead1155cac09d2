"""Skew-proof ordered positions.

A per-key window (``partitionBy(key).orderBy(...)``) sends every row of a
key to one task; a key with a third of all rows then serialises the job.
The helpers here range-partition the rows by (key, order), so a hot key
spans as many partitions as its share of the rows, aggregate per (key, range
partition) with map-side combine, take prefix sums over that small table (at
most one row per key and partition), broadcast those of the keys that lie in more
than one partition (at most two rows per partition), and finish with a window over
(key, range partition) only. The result equals the plain per-key window, whatever
the values look like; nulls order last and null keys are a key.

``global_positions`` numbers rows in a total order without a single-partition
window: range partitioning, a per-partition counter, and offsets from a
table with one row per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


RANGE = "_range"


def ordered(order: list) -> list:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` as a stored table with ``_range``, the number of its range
    partition by (keys, order): ascending in the order within a key. Stored,
    because ranges come from a sample and must not be drawn twice."""
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *ordered(order))
                       .withColumn(RANGE, F.spark_partition_id()))


def same_key(keys: list[str], suffix: str = "_k"):
    """Null-safe equality of ``keys`` with their copies ``_k0``, ``_k1``, ... and of the range with ``_kr``."""
    same = F.col(RANGE) == F.col(f"{suffix}r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{suffix}{i}"))
    return same


def straddling(x: DataFrame, keys: list[str], value: str = "_v") -> DataFrame:
    """Of a ``by_range`` table: (_k0, ..., _kr, _boff, _bsum, _all) of the keys that lie in more
    than one range: the sum of ``value`` before the range, in it and over the key. Ranges are
    contiguous, so these are at most two rows per range, however many keys there are; stored."""
    per_r = x.groupBy(*keys, RANGE).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_bsum"))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = wk.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per_r = per_r.withColumn("_boff", F.coalesce(F.sum("_bsum").over(before), F.lit(0)))
    per_r = per_r.withColumn("_all", F.sum("_bsum").over(wk)).withColumn("_ranges", F.count(F.lit(1)).over(wk))
    return cut_lineage(per_r.where(F.col("_ranges") > 1).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("_kr"), "_boff", "_bsum", "_all"))


def running_before(df: DataFrame, keys: list[str], order: list[str], value,
                   out: str, total: str | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` that come
    strictly before the row in ``order``. Optionally also ``total`` = the sum
    over all rows of the key."""
    v = value if not isinstance(value, str) else F.col(value)
    keys = list(keys)
    x = by_range(df.withColumn("_v", v.cast("long")), keys, order)
    # most keys lie in one range; the others are few enough to travel to the rows
    x = x.join(F.broadcast(straddling(x, keys)), same_key(keys), "left")
    x = x.drop("_kr", *[f"_k{i}" for i in range(len(keys))])
    wl = Window.partitionBy(*keys, RANGE)
    if total:
        x = x.withColumn(total, F.coalesce("_all", F.sum("_v").over(wl), F.lit(0)))
    x = x.withColumn(out, F.coalesce("_boff", F.lit(0)) + F.coalesce(
        F.sum("_v").over(wl.orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.drop("_v", "_boff", "_bsum", "_all", RANGE)


def global_positions(df: DataFrame, order: list[str], out: str, start: int = 1,
                     num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Number the rows of ``df`` by ``order`` (must be a total order):
    ``start, start+1, ...``. Range-partitioned, no single-task window.

    The per-partition counter is position-dependent, so the numbered table is
    checkpointed (reliably) before it is reused; recomputation after an
    executor loss then cannot renumber rows.
    """
    # without an explicit count AQE may coalesce adjacent ranges (still
    # ordered), so small inputs do not become hundreds of tiny tasks
    rp = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    r = (rp.sortWithinPartitions(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_local", F.monotonically_increasing_id()
                       - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    if materialize:
        r = cut_lineage(r)
    # one row per partition: a proven size bound for the broadcast
    stats = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    stats = stats.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    r = r.join(F.broadcast(stats.select("_pid", "_off")), "_pid")
    return r.withColumn(out, F.col("_off") + F.col("_local") + F.lit(start)).drop("_pid", "_local", "_off")


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ascending average rank of ``value`` within ``keys`` (ties share the
    mean of their positions), without a per-key window: value counts are
    pre-aggregated, then counted below each value by range partitions. A null
    value has a null rank."""
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    vc = running_before(vc, [*keys], [value], "_cnt", "_less")
    vc = vc.select(*keys, value, (F.col("_less") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(vc, [*keys, value], "left")


def position_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Exact quantile with linear interpolation (pandas default); nulls do not
    count. The two neighbouring values are found by histograms (``nth_largest``), so
    no row moves or is sorted; with infinite or NaN values, from the distinct values in order."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_q"))
    ends = known.agg(F.count("_q").alias("n"), F.min("_q").alias("lo"), F.max("_q").alias("hi")).first()
    if not ends["n"]:
        return None
    if not (math.isfinite(ends["lo"]) and math.isfinite(ends["hi"])):
        return _quantile_in_order(df, value, q)
    h = q * (ends["n"] - 1)
    lo = min(int(math.floor(h)), ends["n"] - 1)

    def at(k: int) -> float:
        v = nth_largest(known, "_q", ends["n"] - k)[0]
        return ends["lo"] if v is None else v
    low = at(lo)
    high = at(min(lo + 1, ends["n"] - 1)) if h > lo else low
    return float(low + (h - lo) * (high - low))


def _quantile_in_order(df: DataFrame, value: str, q: float) -> float | None:
    """``position_quantile`` by the positions of the distinct values; only the two neighbours reach the driver."""
    vc = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    vc = running_before(vc, [], [value], "_cnt", "_less", total="_n")
    h = F.lit(q) * (F.col("_n") - 1)
    lo, hi = F.floor(h), F.least(F.floor(h) + 1, F.col("_n") - 1)
    holds = lambda k: (F.col("_less") <= k) & (k < F.col("_less") + F.col("_cnt"))
    ends = vc.agg(F.max(F.when(holds(lo), F.col(value))).alias("lo"), F.max(F.when(holds(hi), F.col(value))).alias("hi"),
                  F.max(h - lo).alias("part")).first()
    if ends["lo"] is None:
        return None
    return float(ends["lo"] + ends["part"] * (ends["hi"] - ends["lo"]))


BINS = 4096  # of one refinement pass; so many rows reach the driver


def nth_largest(df: DataFrame, value: str, x: int, tie: str | None = None):
    """(v, t): the x largest rows of ``df`` by (value, tie) are those with a
    larger value than v, or v itself and a tie of at least t; None, None when
    there are no more than x rows. The values must be finite and not null.

    Selection by histograms: each pass counts the open interval in ``BINS`` bins
    and goes on in the bin that holds the x-th row, so no row moves or is sorted.
    ``t`` is None when every row with value v belongs to the x (or without ``tie``)."""
    ends = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["n"] <= x:
        return None, None
    lo, hi, want, v = ends["lo"], ends["hi"], x, F.col(value)
    while lo < hi:
        inside, width = df.filter((v >= F.lit(lo)) & (v <= F.lit(hi))), (float(hi) - float(lo)) / BINS
        if width == 0.0:
            lo, hi, want = _split_values(inside, value, want)
            break
        # the ends fall into different bins, so every pass leaves less
        place = F.least(F.floor((v.cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if want <= b["n"]:
                break
            want -= b["n"]
        if len(bins) == 1:  # doubles that the bins cannot tell apart
            lo, hi, want = _split_values(inside, value, want)
        elif want == b["n"]:
            return b["lo"], None
        else:
            lo, hi = b["lo"], b["hi"]
    held = df.filter(v == F.lit(lo))
    return lo, nth_largest(held, tie, want)[0] if tie else None


def _split_values(df: DataFrame, value: str, want: int):
    """The value of the want-th largest row where values are neighbours: counted one by one."""
    for r in df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc(value)).toLocalIterator():
        if want <= r["n"]:
            return r[value], r[value], want
        want -= r["n"]
    raise AssertionError


def among_largest(value, tie, v, t):
    """Condition of ``nth_largest``'s rows; without a threshold every row holds it."""
    if v is None:
        return F.lit(True)
    return (value > F.lit(v)) | ((value == F.lit(v)) & (F.lit(True) if t is None else tie >= F.lit(t)))


def top_rows(df: DataFrame, order: list[str], x: int) -> DataFrame:
    """The first ``x`` rows of ``df`` in ``order`` (a total order), exact, by
    range positions: no task sees more than its range."""
    return global_positions(df, order, "_top_pos").where(F.col("_top_pos") <= x).drop("_top_pos")
