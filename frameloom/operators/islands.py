"""Runs of ordered rows: gaps and islands, frame groups, run-length masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island(rows: DataFrame, keys: list[str], order: list[str], changed: Column, name: str = "island") -> DataFrame:
    """rows with the number of changes up to each; changed may look back with lag over the same order."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_changed", F.coalesce(changed, F.lit(True)).cast("long")).withColumn(name, F.sum("_changed").over(line)).drop("_changed")


def coalesce_gaps(rows: DataFrame, keys: list[str], frame: str, gap: int = 1) -> DataFrame:
    """Distinct frames as inclusive ranges (keys, first, last, frames); frames at most ``gap`` apart share one."""
    line = Window.partitionBy(*keys).orderBy(frame)
    some = rows.select(*keys, frame).distinct()
    some = island(some, keys, [frame], F.col(frame) - F.lag(frame).over(line) > gap)
    return some.groupBy(*keys, "island").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("frames")).drop("island")


def frame_groups(rows: DataFrame, clip: str, frame: str, topology: str, most: int) -> DataFrame:
    """(clip, gop, frame_start, frame_count, intra): runs of equal topology cut to at most ``most`` frames.

    Single-frame runs that follow each other share intra-coded groups of at most ``most`` frames.
    """
    line = Window.partitionBy(clip).orderBy(frame)
    runs = island(rows.select(clip, frame, topology), [clip], [frame], F.col(topology) != F.lag(topology).over(line), "run")
    place = F.row_number().over(Window.partitionBy(clip, "run").orderBy(frame)) - 1
    cut = runs.withColumn("block", F.floor(place / most))
    cut = cut.groupBy(clip, "run", "block").agg(F.min(frame).alias("first"), F.count("*").alias("n"))
    order = Window.partitionBy(clip).orderBy("first")
    single = F.col("n") == 1
    cut = cut.withColumn("single", single)
    cut = island(cut, [clip], ["first"], (F.col("single") != F.lag("single").over(order)) | ~F.col("single"), "batch")
    within = F.row_number().over(Window.partitionBy(clip, "batch").orderBy("first")) - 1
    cut = cut.withColumn("part", F.when(F.col("single"), F.floor(within / most)).otherwise(F.lit(0)))
    groups = cut.groupBy(clip, "batch", "part").agg(F.min("first").alias("frame_start"), F.sum("n").alias("frame_count"), F.first("single").alias("intra"))
    return groups.select(clip, (F.row_number().over(Window.partitionBy(clip).orderBy("frame_start")) - 1).cast("long").alias("gop"), "frame_start", "frame_count", "intra")


def run_lengths(bits: Column) -> Column:
    """Alternating run lengths of an array of 0 and 1, beginning with the zeros, so perhaps with 0."""
    n = F.size(bits)
    # A lambda must not index another array: it would be made again for each element.
    changed = F.zip_with(bits, F.slice(F.concat(F.array(F.lit(0)), bits), F.lit(1), n), lambda b, p: b != p)
    turns = F.filter(F.transform(changed, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    ends = F.concat(turns, F.array(n))
    starts = F.concat(F.array(F.lit(0)), turns)
    return F.zip_with(ends, starts, lambda e, s: (e - s).cast("long"))


def run_bits(runs: Column, size: Column) -> Column:
    """The bits of run lengths, cut or filled with zeros to a size."""
    parts = F.transform(runs, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int")))
    bits = F.flatten(parts)
    return F.slice(F.concat(bits, F.array_repeat(F.lit(0), F.greatest(size - F.size(bits), F.lit(0)))), F.lit(1), size)
