"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, slot


def stars(links: DataFrame) -> DataFrame:
    """(hi, lo) for each linked vertex that isn't its component's smallest: lo is the smallest.

    links: two columns a, b of vertices. Large stars hang a vertex's larger neighbours on its
    smallest one, small stars its smaller neighbours; links never grow in number, and rounds
    grow with the logarithm of the number of vertices. A round is one checkpoint; the last is the one that
    leaves stars only. What a centre's links hang on next reaches them through slots, so no task meets all of them.
    """
    a, b = links.columns
    now = checkpointed(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct().withColumn("slot", slot())
    )
    while True:
        ends = _twice(now, ("hi", F.lit(1)), ("lo", F.lit(0)), "u", "up")
        # In a star a vertex hangs on one other, or others hang on it.
        if ends.groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and n > 1").isEmpty():
            return now.drop("slot")
        both = _twice(now, ("hi", F.col("lo")), ("lo", F.col("hi")), "u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").toDF("lo", "m")
        told = now.select("slot", "lo").distinct().join(least, "lo")
        large = now.join(told, ["slot", "lo"], "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        now = checkpointed(_twice(small, ("hi", F.col("m")), ("lo", F.col("m")), "hi", "lo").where(F.col("hi") != F.col("lo")).distinct().withColumn("slot", slot()))


def _twice(rows: DataFrame, first: tuple[str, Column], second: tuple[str, Column], *names: str) -> DataFrame:
    """Two rows for each one; a union would run all that rows come from a second time."""
    pair = lambda of: F.struct(*(x.alias(n) for x, n in zip((F.col(of[0]), of[1]), names, strict=True)))
    return rows.select(F.explode(F.array(pair(first), pair(second))).alias("x")).select("x.*")
