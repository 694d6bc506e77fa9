"""Splat frames as changes against the frame before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _wrapped(d: Column, bits: int) -> Column:
    """d as a signed number of so many bits; adding it modulo 2 ** bits undoes the difference."""
    half = 1 << (bits - 1)
    return F.pmod(d + half, F.lit(1 << bits)) - half


def encode_deltas(frames: DataFrame, words: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """(frame, slot, kind, gap, words, codes): every frame but the first as changes of the one before.

    frames: frame (without gaps), slot, words (16-bit numbers) and codes (bytes). A splat whose slot the frame before holds survives: its words are differences as signed 16-bit numbers, its codes differences
    modulo 256. New slots are births and have their own values; lost ones are deaths, of which only gap, the number of slots between it and the death before in
    the old frame's order, is kept.
    """
    line = Window.partitionBy("frame").orderBy("slot")
    old = frames.select((F.col("frame") + 1).alias("frame"), "slot", (F.row_number().over(line) - 1).alias("_at"), *(F.col(c).alias("_" + c) for c in (*words, *codes)), F.lit(True).alias("_old"))
    new = frames.select("frame", "slot", *words, *codes, F.lit(True).alias("_new"))
    follows = frames.select("frame").distinct()
    first = frames.agg(F.min("frame").alias("_first"))
    both = new.join(old, ["frame", "slot"], "full").join(follows, "frame", "left_semi").join(F.broadcast(first)).where("frame > _first")
    kind = F.when(F.col("_old").isNull(), "birth").when(F.col("_new").isNull(), "death").otherwise("survivor")
    told = both.withColumn("kind", kind)
    dead = Window.partitionBy("frame", "kind").orderBy("slot")
    gap = F.when(F.col("kind") == "death", F.col("_at") - F.coalesce(F.lag("_at").over(dead), F.lit(-1)) - 1)
    kept = F.col("kind") == "survivor"
    values = [F.when(kept, _wrapped(F.col(c) - F.col("_" + c), 16)).otherwise(F.col(c)).alias(c) for c in words]
    values += [F.when(kept, F.pmod(F.col(c) - F.col("_" + c), F.lit(256))).otherwise(F.col(c)).alias(c) for c in codes]
    return told.select("frame", "slot", "kind", gap.cast("long").alias("gap"), *values)


def decode_deltas(first: DataFrame, deltas: DataFrame, words: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """The frames that encode_deltas() was given: first, the first frame, and all later ones.

    A slot lives from a birth to its death; its values are running sums since, modulo 65,536 and 256, so no frame waits for the one before.
    """
    columns = ["frame", "slot", *words, *codes]
    rows = first.select(*columns, F.lit("birth").alias("kind")).unionByName(deltas.select(*columns, "kind")).where("kind != 'death'")
    life = F.sum(F.when(F.col("kind") == "birth", 1).otherwise(0)).over(Window.partitionBy("slot").orderBy("frame"))
    since = Window.partitionBy("slot", "_life").orderBy("frame")
    sums = [F.pmod(F.sum(c).over(since), F.lit(n)).cast("long").alias(c) for cs, n in ((words, 1 << 16), (codes, 256)) for c in cs]
    return rows.withColumn("_life", life).select("frame", "slot", *sums)
