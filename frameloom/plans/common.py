"""Query registry, and the tables that stand for frames, points and triangles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# How SQL twins see the same stand-ins.
_COMPONENTS = "x y z o s0 s1 s2 q0 q1 q2 q3 r g b".split()
PTS = "pts AS (SELECT vec_id AS vid, CAST(label AS BIGINT) AS frame, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(_COMPONENTS)) + " FROM embeddings)"
TRI = PTS + (
    ", tri AS (SELECT p.vid AS tid, p.frame, p.vid AS a, q.vid AS b, s.vid AS c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS \"by\", q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz"
    " FROM pts p JOIN pts q ON q.vid = p.vid + 1 JOIN pts s ON s.vid = p.vid + 2)"
)
SEQ = "seq AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, event_type, value, ts FROM events)"


def r6(sql: str, digits: int = 6) -> str:
    """SQL of rounded()."""
    return f"floor(({sql}) * {10**digits}.0 + 0.5) / {10**digits}.0"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL twin where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, frame and 14 components of each vector: position, opacity, scales, quaternion, colour."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("vid"), F.col("label").cast("long").alias("frame"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_COMPONENTS)))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip over the points: triangle tid has the corners tid, tid + 1, tid + 2, with their positions."""
    p = points(spark, sf_dir)
    corner = lambda n, k: p.select((F.col("vid") - k).alias("tid"), F.col("vid").alias(n), *(F.col(c).alias(n + c) for c in "xyz"))
    first = p.select(F.col("vid").alias("tid"), "frame", F.col("vid").alias("a"), *(F.col(c).alias("a" + c) for c in "xyz"))
    return first.join(corner("b", 1), "tid").join(corner("c", 2), "tid")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, event_id, event_type, value, ts: a user's events in order."""
    e = table(spark, sf_dir, "events")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("clip"), (F.row_number().over(line) - 1).cast("long").alias("frame"), "event_id", "event_type", "value", "ts")


def out(*columns: Column | str, **computed: Column) -> list[Column]:
    """Columns to select: names as they are, computed ones rounded."""
    return [F.col(c) if isinstance(c, str) else c for c in columns] + [rounded(v).alias(k) for k, v in computed.items()]
