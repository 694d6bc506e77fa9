"""Order statistics and fits with the reference's conventions, as aggregates over grouped rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a power of two, and parts of a bucket.
SHARES, PARTS = 256, 4096


def median_of_two(x: Column) -> Column:
    """Exact median, the mean of the two middle values for an even count; not-a-number doesn't count."""
    return F.median(F.when(~F.isnan(x), x))


def upper_median(n: Column) -> Column:
    """Place of the upper median of n sorted values, zero-based, as the other ranks are."""
    return F.floor(n / 2)


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Place round(q (n - 1))."""
    return lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)


def floor_rank(q: float) -> Callable[[Column], Column]:
    """Place min(n - 1, floor(q n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n))


def bucket(x: Column) -> Column:
    """A whole number that never falls as x grows: power of two and SHARES equal parts of it, for either sign.

    A logarithm that is rounded across a power of two gives the same number from the other side.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size))
    part = power * SHARES + F.floor((size / F.pow(F.lit(2.0), power) - 1) * SHARES) + (1100 * SHARES)
    finite = F.when(size == 0, 0).when(size == float("inf"), F.lit(1 << 29)).otherwise(part)
    return F.when(F.isnan(x), F.lit(1 << 30)).otherwise(F.signum(x).cast("long") * finite).cast("long")


def ranks(rows: DataFrame, keys: list[str], x: str, **places: Callable[[Column], Column]) -> DataFrame:
    """One row per key: keys and, for each name, the value of x at a place of the key's sorted non-null values.

    places: a zero-based place for the number of values. rows are read once, as distinct values with counts, whose exchange all steps share.
    No key's values meet in one task: counts of buckets of a 256th of a power of two find the bucket of a place, counts of
    4,096 equal parts of that bucket the part, and only the part's distinct values are ordered. Rows with a null key are left out; without keys there
    is one row, none for an empty table. Not-a-number is the largest value.
    """
    value = F.col(x).cast("double")
    some = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), bucket(value).alias("_b"))
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    distinct = some.groupBy(*keys, "_b", "_x").agg(F.count("*").alias("m"))
    counts = distinct.groupBy(*keys, "_b").agg(F.sum("m").alias("m"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    # Without keys this window holds the buckets of the whole table, of which there are few.
    total = F.sum("m").over(Window.partitionBy(*keys))
    run = F.sum("m").over(Window.partitionBy(*keys).orderBy("_b"))
    told = F.explode(F.array(*(F.struct(F.lit(name).alias("which"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()))).alias("p")
    hit = counts.select("*", total.alias("n"), run.alias("run")).select(*keys, "_b", "lo", "hi", "run", "m", told).where("run > p.place and run - m <= p.place")
    hit = hit.select(*keys, "_b", "lo", "hi", "p.*", (F.col("run") - F.col("m")).alias("before"))
    width = F.col("hi").cast("double") - F.col("lo").cast("double")
    part = F.when((width > 0) & (width < float("inf")), F.least(F.lit(PARTS - 1), F.floor((F.col("_x").cast("double") - F.col("lo").cast("double")) / width * PARTS))).otherwise(0)
    inside = distinct.join(hit, [*keys, "_b"]).select(*keys, "_b", "_x", "m", "which", "place", "before", part.alias("_part"))
    same = [*keys, "_b", "which", "place", "before"]
    parts = _reached(inside.groupBy(*same, "_part").agg(F.sum("m").alias("m")), [*keys, "which"], "_part")
    left = inside.drop("before").join(parts.select(*keys, "which", "_part", (F.col("run") - F.col("m")).alias("before")), [*keys, "which", "_part"])
    found = _reached(left, [*keys, "which"], "_x")
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == name, F.col("_x"))).alias(name) for name in places)).where(F.lit(bool(keys)) | F.col(next(iter(places))).isNotNull())


def _reached(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of each key the row at which the running count passes the place."""
    run = F.col("before") + F.sum("m").over(Window.partitionBy(*by).orderBy(order))
    return counts.withColumn("run", run).where("run > place and run - m <= place")


def robust_fit(rows: DataFrame, keys: list[str], x: str, y: str, floor: float = 0.0, least: int = 3) -> DataFrame:
    """(keys, n, a, b, inliers): y = a x + b by least squares, refitted without residuals above 3 MAD + floor."""

    def fit(r: DataFrame) -> DataFrame:
        return r.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).where(F.col("n") >= least)

    first = fit(rows)
    left = rows.join(first.drop("n"), keys).withColumn("_res", F.abs(F.col(y) - F.col("a") * F.col(x) - F.col("b")))
    limit = ranks(left, keys, "_res", mad=upper_median).select(*keys, (3.0 * F.col("mad") + floor).alias("_limit"))
    inner = left.join(limit, keys).where(F.col("_res") <= F.col("_limit")).select(*keys, x, y)
    again = fit(inner).withColumnRenamed("n", "inliers")
    return first.select(*keys, "n").join(again, keys)
