"""Exact quantiles with linear interpolation, by counting on the ordered bits of a double.

The 64 bits of a value, arranged so that their order is the order of the values, are read
from the left in three digits. The first pass counts rows by group and first digit; the
digit in which a wanted rank falls is known from the running counts. The next pass counts
only the values that share this digit, by their second, the last one by their third, and
the value is found. Passes are fixed; a group takes at most four million counters, however
many rows it has, and counters of a task are summed before they move. Nothing is sorted but
the counters, and no job runs while the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: How far a key is shifted to leave its first, its first two, all three digits.
SHIFTS = (42, 21, 0)
#: Parts into which the rows of a hot group are dealt where they meet the wanted digits.
SALTS = 16
#: The fraction bits of a double, the bias of its exponent.
FRACTION, BIAS = 52, 1023


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a long in the order of the doubles, one for each: -inf first, inf then NaN last.

    Null gives 0. The parts are columns of their own, which keeps each expression small.
    """
    v, a, guess, low, e = F.col(value), F.col("_a"), F.col("_guess"), F.col("_low"), F.col("_e")
    power = lambda x: F.pow(F.lit(2.0), x)
    out = df.withColumn("_a", F.abs(v.cast("double") + F.lit(0.0)))
    out = out.withColumn("_guess", F.least(F.greatest(F.floor(F.log2(a)), F.lit(1 - BIAS)), F.lit(BIAS)).cast("double"))
    # the logarithm may be off by one next to a power of two
    out = out.withColumn("_low", guess - (power(guess) > a).cast("double"))
    out = out.withColumn("_e", F.greatest(low + ((low < BIAS) & (power(low + 1) <= a)).cast("double"), F.lit(float(1 - BIAS))))
    normal = (e + BIAS).cast("long") * F.lit(1 << FRACTION) + ((a / power(e) - 1) * F.lit(2.0**FRACTION)).cast("long")
    subnormal = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    top = (2 * BIAS + 1) << FRACTION
    size = F.when(F.isnan(a), F.lit(top + 1)).when(a == F.lit(float("inf")), F.lit(top)).when(a < F.lit(2.0 ** (1 - BIAS)), subnormal).otherwise(normal)
    out = out.withColumn(name, size).drop("_a", "_guess", "_low", "_e")
    signed = F.when((v < 0) & ~F.isnan(v), -F.col(name)).otherwise(F.col(name))
    # never null, or joins on its digits would push tests for null with all of the above into the scan
    return out.withColumn(name, F.coalesce(signed, F.lit(0).cast("long")))


def quantiles(df: DataFrame, by, wanted: dict) -> DataFrame:
    """One row per group of `by`, groups without any value and null keys included.

    wanted: {output name: (column, probability)}. Null values don't count, NaN is largest.
    """
    by = list(by)
    columns: dict = {}
    for n, (c, p) in wanted.items():
        columns.setdefault(c, []).append((n, float(p)))
    # one key for all columns of a group, null ones too; without columns there is one group
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    rows = df.select(key.alias("g"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(len(columns))])
    values = rows.select("g", F.explode(pairs).alias("x")).select("g", "x.c", "x.v").where("v IS NOT NULL")
    values = with_ordered_bits(values, "v", "bits")
    counts = values.groupBy("g", "c", F.shiftright("bits", SHIFTS[0]).alias("digit")).agg(F.count(F.lit(1)).alias("k"))
    counts = counts.withColumn("n", F.sum("k").over(W.partitionBy("g", "c")))
    # constants, however many quantiles are wanted; their ranks follow from the counts
    asked = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(n).alias("q"), F.lit(p).alias("p")) for i, items in enumerate(columns.values()) for n, p in items])
    ranks = F.flatten(F.transform(F.filter(asked, lambda m: m["c"] == F.col("c")), _ranks))
    marks = _found(counts.withColumn("marks", ranks), ["g", "c"])
    for last, shift in zip(SHIFTS, SHIFTS[1:]):
        shared = _sharing(values.withColumn("up", F.shiftright("bits", last)), marks.select("g", "c", "up"), bool(by))
        counts = shared.groupBy("g", "c", "up", F.shiftright("bits", shift).alias("digit")).agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("v"))
        # the counters, not the rows, meet the ranks
        counts = counts.join(marks if by else F.broadcast(marks), ["g", "c", "up"])
        marks = _found(counts, ["g", "c", "up"], last=shift == 0)
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    ends = marks.groupBy("g", "q").agg(at(0).alias("lo"), at(1).alias("hi"), F.max("part").alias("part"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    # one entry a wanted quantile
    pairs = F.map_from_entries(F.collect_list(F.struct("q", value.alias("value")))).alias("found")
    out = [F.col("found")[q].alias(q) for q in wanted]
    if not by:
        return ends.agg(pairs).select(*out)
    keys = [F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)]
    return rows.select("g").distinct().join(ends.groupBy("g").agg(pairs), "g", "left").select(*keys, *out)


def _ranks(m: Column) -> Column:
    """The two ranks between which a quantile of n values lies, and its part of the way."""
    h = (F.col("n") - 1) * m["p"]
    low, high = F.floor(h).cast("long"), F.ceil(h).cast("long")
    mark = lambda side, r: F.struct(m["q"].alias("q"), F.lit(side).alias("side"), r.alias("r"), (h - low).alias("part"))
    return F.array(mark(0, low), mark(1, high))


def _found(counts: DataFrame, of: list[str], last: bool = False) -> DataFrame:
    """The digits in which the ranks of `marks` fall, with the ranks among their values."""
    before = W.partitionBy(*of).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
    ran = counts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    here = F.filter("marks", lambda m: (m["r"] >= F.col("before")) & (m["r"] < F.col("before") + F.col("k")))
    ran = ran.withColumn("marks", F.transform(here, lambda m: m.withField("r", m["r"] - F.col("before")))).where(F.size("marks") > 0)
    if last:
        return ran.select("g", "v", F.explode("marks").alias("m")).select("g", "v", "m.*")
    return ran.select("g", "c", F.col("digit").alias("up"), "marks")


def _sharing(values: DataFrame, marks: DataFrame, grouped: bool) -> DataFrame:
    """The values whose digits so far are those of a wanted rank."""
    if not grouped:
        # at most two digits a wanted quantile, whatever the rows
        return values.join(F.broadcast(marks), ["g", "c", "up"])
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    salted = values.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)))
    return salted.join(marks.withColumn("salt", F.explode(salts)), ["g", "c", "up", "salt"]).drop("salt")


def medians(df: DataFrame, by, names, suffix="") -> DataFrame:
    return quantiles(df, by, {f"{c}{suffix}": (c, 0.5) for c in names})
