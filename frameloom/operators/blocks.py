"""Rows in blocks that lie together in space, and blocks of two tables that meet in tasks, so that pairs are never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..session import checkpointed

AXES = ("x", "y", "z")
#: Rows of a block of those that search, and of those that are searched.
SEARCHING, SEARCHED = 4096, 1024


def _gap(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes."""
    sides = [F.greatest(F.col(other_low + c) - F.col(high + c), F.col(low + c) - F.col(other_high + c), F.lit(0.0)) for c in AXES]
    return sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]


def blocked(rows: DataFrame, keys: Sequence[str], centre: Sequence[Column], size: int) -> DataFrame:
    """rows with a number ``_at`` of their own and ``_block``: at most ``size`` neighbours along a Morton curve of their key."""
    keys, spark = list(keys), rows.sparkSession
    rows = checkpointed(rows)
    bounds = rows.groupBy(*keys).agg(*(f(m).alias(n + c) for f, n in ((F.min, "_l"), (F.max, "_h")) for c, m in zip(AXES, centre, strict=True)))
    curve = E.morton(*(E.morton_level(m, F.col("_l" + c), F.col("_h" + c)) for c, m in zip(AXES, centre, strict=True)))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // size))
    told = rows.join(bounds, keys).withColumn("_m", curve).select(*rows.columns, "_m")
    ordered = told.repartitionByRange(parts, *keys, "_m").sortWithinPartitions(*keys, "_m").withColumn("_at", F.monotonically_increasing_id())
    # Kept, as a range partition that is made again could be cut elsewhere.
    return checkpointed(ordered.withColumn("_block", F.floor(F.col("_at") / size).cast("long")).drop("_m"))


def boxes(rows: DataFrame, keys: Sequence[str], prefix: str, low: Sequence[Column], high: Sequence[Column] | None = None, sure: Column | None = None) -> DataFrame:
    """(keys, block, l and h of each axis, n, with a prefix) of blocked() rows; n counts the rows that whoever searches may find, all unless ``sure`` tells which."""
    sides = [f(m).alias(prefix + n + c) for f, n, side in ((F.min, "l", low), (F.max, "h", high or low)) for c, m in zip(AXES, side, strict=True)]
    return rows.groupBy(*keys, F.col("_block").alias(prefix + "block")).agg(*sides, F.count_if(F.lit(True) if sure is None else sure).alias(prefix + "n"))


def near_blocks(searching: DataFrame, searched: DataFrame, keys: Sequence[str], reach: float | None = None, few: int = 1) -> DataFrame:
    """(keys, p_block, t_block, _g, _low): pairs of boxes p_ and t_ that may hold the ``few`` nearest neighbours within a reach; _g numbers the searching blocks.

    Any row of a searched block is within the farthest corners of the two boxes, so where the blocks up to such a distance surely hold few rows, what is farther is left out.
    """
    keys = list(keys)
    own = checkpointed(searching.withColumn("_g", F.monotonically_increasing_id()))
    pairs = own.join(searched, keys).withColumn("_low", _gap("p_l", "p_h", "t_l", "t_h"))
    if reach is not None:
        pairs = pairs.where(F.col("_low") <= reach * reach * (1 + 1e-9))
    wide = [F.greatest(F.col("p_h" + c) - F.col("t_l" + c), F.col("t_h" + c) - F.col("p_l" + c)) for c in AXES]
    pairs = checkpointed(pairs.select(*keys, "p_block", "t_block", "_g", "_low", "t_n", (wide[0] * wide[0] + wide[1] * wide[1] + wide[2] * wide[2]).alias("_far")))
    up_to = pairs.withColumn("_n", F.sum("t_n").over(Window.partitionBy("_g").orderBy("_far")))
    bound = up_to.where(F.col("_n") >= few).groupBy("_g").agg(F.min("_far").alias("_bound"))
    return pairs.join(bound, "_g", "left").where(F.col("_bound").isNull() | (F.col("_low") <= F.col("_bound") * (1 + 1e-9))).select(*keys, "p_block", "t_block", "_g", "_low")


def meet(searching: DataFrame, searched: DataFrame, near: DataFrame, keys: Sequence[str], width: int, work: Callable[[np.ndarray, np.ndarray, Iterator[tuple]], np.ndarray]) -> DataFrame:
    """(_at, _found): for each blocked() row that searches what ``work`` finds among the rows of near blocks, null where it is negative.

    Both tables have columns _n, _o (whole numbers) and _v (``width`` doubles). A searching block goes to one task, which holds it alone; searched rows stream by, those of the nearest
    blocks first and mixed inside equally near ones. work(_n, _v of the block, parts) returns a whole number for each row; a part is (least squared distance, _n, _o, _v) of some hundreds of rows.
    """
    return _met(searching, searched, near, keys, width, "_found long", lambda n, v, parts: [pa.array(found := work(n, v, parts), pa.int64(), mask=found < 0)])


def meet_few(searching: DataFrame, searched: DataFrame, near: DataFrame, keys: Sequence[str], width: int, work: Callable[[np.ndarray, np.ndarray, Iterator[tuple]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(_at, _found, _far): as meet(), but work returns some whole numbers and distances for each row, of which arrays hold those at finite distances."""

    def told(n: np.ndarray, v: np.ndarray, parts: Iterator[tuple]) -> list[pa.Array]:
        found, far = work(n, v, parts)
        real = np.isfinite(far)
        ends = pa.array(np.concatenate([[0], real.sum(1).cumsum()]), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x[real])) for x in (found, far)]

    return _met(searching, searched, near, keys, width, "_found array<long>, _far array<double>", told)


def _met(searching: DataFrame, searched: DataFrame, near: DataFrame, keys: Sequence[str], width: int, schema: str, work: Callable[[np.ndarray, np.ndarray, Iterator[tuple]], list[pa.Array]]) -> DataFrame:
    """(_at and the columns of a schema) that work makes for the rows of each searching block."""
    keys, names = list(keys), ["_at", *(part.split()[0] for part in schema.split(", "))]
    parts = int(searching.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = lambda rows, low: rows.select("_g", low.alias("_low"), "_at", "_n", "_o", "_v")
    asks = sent(searching.join(near.select(*keys, F.col("p_block").alias("_block"), "_g").distinct(), [*keys, "_block"]), F.lit(-1.0))
    given = sent(searched.join(near.select(*keys, F.col("t_block").alias("_block"), "_g", "_low"), [*keys, "_block"]), F.col("_low"))
    # Dealt by a hash: an exchange by _g itself is left out where both sides seem to lie so, though their partitions may have been read together differently.
    lined = asks.union(given).repartition(parts, F.hash("_g")).sortWithinPartitions("_g", "_low", F.xxhash64("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(batches, width)
        part = next(parts, None)
        while part is not None:
            g, asked = part[0], []
            while part is not None and part[0] == g and part[1] < 0:
                asked.append(part)
                part = next(parts, None)

            def stream(g: int = g) -> Iterator[tuple]:
                nonlocal part
                while part is not None and part[0] == g:
                    told, part = part, next(parts, None)
                    yield told[1], *told[3:]

            rest = stream()
            at, n, _, v = (np.concatenate([p[k] for p in asked]) for k in range(2, 6))
            found = work(n, v, rest)
            for _ in rest:
                pass
            yield pa.RecordBatch.from_arrays([pa.array(at), *found], names)

    return lined.mapInArrow(run, f"_at long, {schema}")


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(group, distance, _at, _n, _o, _v) of rows of one group and distance; parts of searched rows grow from 32 to 512, as early ones leave most work."""
    last, size = None, 32
    for batch in batches:
        g, low, *numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_low", "_at", "_n", "_o"))
        v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | ((low[1:] < 0) != (low[:-1] < 0))) + 1
        for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if a == b:
                continue
            last, size = (last, size) if g[a] == last and low[a] >= 0 else (g[a], 32)
            while a < b:
                end = b if low[a] < 0 else min(b, a + size)
                yield g[a], low[a], *(c[a:end] for c in (*numbers, v))
                a, size = end, size if low[a] < 0 else min(512, 2 * size)
