"""Windowed smoothing, delta coding and recurrences over ordered rows."""

from __future__ import annotations

from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def line(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def neighbour(x: Column, offset: int, w: WindowSpec) -> Column:
    return F.lag(x, -offset).over(w) if offset < 0 else F.lead(x, offset).over(w) if offset else x


def replicated(x: Column, reach: int, w: WindowSpec) -> list[Column]:
    """x from reach rows before to reach rows after, with the first and last value beyond the ends."""
    out: list[Column] = [x]
    for k in range(1, reach + 1):
        out = [F.coalesce(F.lag(x, k).over(w), out[0]), *out, F.coalesce(F.lead(x, k).over(w), out[-1])]
    return out


def temporal_median(x: Column, reach: int, w: WindowSpec) -> Column:
    """Median of 2 reach + 1 rows, ends replicated."""
    return F.element_at(F.array_sort(F.array(*replicated(x, reach, w))), reach + 1)


def gaussian(x: Column, reach: int, sigma: float, w: WindowSpec) -> Column:
    """Gaussian mean of the rows that exist and aren't null."""
    parts = [(neighbour(x, k, w), exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    weight = sum((F.when(v.isNotNull(), F.lit(g)).otherwise(0.0) for v, g in parts[1:]), F.when(parts[0][0].isNotNull(), F.lit(parts[0][1])).otherwise(0.0))
    total = sum((F.coalesce(v, F.lit(0.0)) * g for v, g in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * parts[0][1])
    return F.when(weight > 1e-6, total / weight)


def last_ema(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """(keys, ema): the exponential mean after each key's last row: keep of the mean so far, the rest of the new value.

    A sum with weights by the distance from the end. The distance comes from a window over the key, which one task sorts; with rows that are numbered, ema_rows() spreads a key.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    weighed = rows.select(*keys, value, back.alias("_back"), n.alias("_n"))
    weight = F.pow(F.lit(keep), F.col("_back")) * F.when(F.col("_back") == F.col("_n") - 1, 1.0).otherwise(1.0 - keep)
    return weighed.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias("ema"))


def ema_rows(rows: DataFrame, keys: list[str], place: str, value: str, keep: float, name: str = "ema") -> DataFrame:
    """rows with the exponential mean up to each; place: a key's rows in order, numbered from 0 without gaps.

    Rows are cut into chunks after which a value's weight is below a double's last bit, so a mean is its own chunk's part and the decayed end of
    the one before, and a key with very many rows is spread over many tasks.
    """
    size = max(2, ceil(60 * log(2) / -log(keep)))
    chunk, at = F.floor(F.col(place) / size), F.col(place) % size
    first = F.when(F.col(place) == 0, 1.0).otherwise(1.0 - keep)
    run = Window.partitionBy(*keys, "_chunk").orderBy(place)
    part = rows.withColumn("_chunk", chunk).withColumn("_part", F.pow(F.lit(keep), at) * F.sum(F.col(value) * first * F.pow(F.lit(keep), -at)).over(run))
    ends = part.where((F.col(place) + 1) % size == 0).select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_part").alias("_end"))
    whole = F.col("_part") + F.coalesce(F.col("_end"), F.lit(0.0)) * F.pow(F.lit(keep), at + 1)
    return part.join(ends, [*keys, "_chunk"], "left").withColumn(name, whole).drop("_chunk", "_part", "_end")
