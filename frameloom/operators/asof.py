"""As-of and interval joins without cross products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], forward: bool = False, prefix: str = "", strict: bool = False) -> DataFrame:
    """left with the values of right's last row at or before ``at`` (forward: first at or after), null where none.

    Both sides are sorted together by key, so the cost is one shuffle whatever the distances are. Rows of right
    with equal key and time count as one: the one with the largest values. strict: not at ``at`` itself.
    """
    held = F.struct(F.col(at).alias("at"), *values)
    rows = left.withColumn("_left", F.lit(True)).withColumn("_held", F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType))
    last = right.groupBy(*keys, at).agg(F.max(held).alias("_held"))
    both = rows.unionByName(last.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    # At equal times the right side comes first, unless only strictly earlier rows count.
    tie = F.col("_left") if not strict else ~F.col("_left")
    order = [F.col(at).desc(), tie] if forward else [F.col(at), tie]
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_held", ignorenulls=True).over(line)).where("_left")
    return found.select(*left.columns, F.col("_found.at").alias(f"{prefix}{at}"), *(F.col(f"_found.{v}").alias(f"{prefix}{v}") for v in values)) if prefix else found.select(
        *left.columns, *(F.col(f"_found.{v}").alias(v) for v in values)
    )


def bracket(left: DataFrame, keyframes: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the keyframes a (last at or before) and b (first after) of each row, and t, where between them it lies.

    Half-open: a row at a keyframe has it as a with t = 0. Before the first and after the last keyframe both are that one.
    """
    both = asof(asof(left, keyframes, keys, at, values, prefix="a_"), keyframes, keys, at, values, forward=True, prefix="b_", strict=True)
    for v in [at, *values]:
        a, b = F.col(f"a_{v}"), F.col(f"b_{v}")
        both = both.withColumn(f"_a_{v}", F.coalesce(a, b)).withColumn(f"_b_{v}", F.coalesce(b, a))
    both = both.select(*left.columns, *(F.col(f"_{n}_{v}").alias(f"{n}_{v}") for n in "ab" for v in [at, *values]))
    span = F.col(f"b_{at}") - F.col(f"a_{at}")
    inside = (F.col(at) >= F.col(f"a_{at}")) & (span != 0)
    return both.withColumn("t", F.when(inside, (F.col(at) - F.col(f"a_{at}")) / span).otherwise(F.lit(0.0)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of points with start <= at < end, by an equi-join on buckets of ``width``; an interval meets a point in one bucket only."""
    bucket = lambda c: F.floor(c / width)
    held = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), F.greatest(bucket(F.col(start)), bucket(F.col(end))))))
    return points.withColumn("_bucket", bucket(F.col(at))).join(held, [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def nearest_valid(rows: DataFrame, keys: list[str], at: str, valid: Column, value: str) -> DataFrame:
    """rows with ``filled``: the value of the nearest valid row in order, the earlier of two equally near; itself where valid."""
    back = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    held = F.when(valid, F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    both = rows.withColumn("_p", F.last(held, ignorenulls=True).over(back)).withColumn("_n", F.first(held, ignorenulls=True).over(ahead))
    before, after = F.col(at) - F.col("_p.at"), F.col("_n.at") - F.col(at)
    pick = F.when(F.col("_n").isNull() | (before <= after), F.col("_p.v")).otherwise(F.col("_n.v"))
    return both.withColumn("filled", pick).drop("_p", "_n")
