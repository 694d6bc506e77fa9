"""Exponential means over the supplied events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import windows as W
from ..session import table
from .common import SEQ, query, r6, sequences

_SWEEP = "sum(b.value * pow(0.7, abs(a.frame - b.frame)) * CASE WHEN b.frame = {} THEN 1.0 ELSE 0.3 END)"


@query("g10_bidirectional_ema", f"WITH {SEQ}, l AS (SELECT clip, max(frame) AS last FROM seq GROUP BY clip), f AS (SELECT a.clip, a.frame, {_SWEEP.format('0')} AS v FROM seq a JOIN seq b ON b.clip = a.clip AND b.frame <= a.frame GROUP BY ALL), r AS (SELECT a.clip, a.frame, {_SWEEP.format('any_value(l.last)').replace('any_value(l.last)', 'l.last')} AS v FROM seq a JOIN l USING (clip) JOIN seq b ON b.clip = a.clip AND b.frame >= a.frame GROUP BY ALL) SELECT f.clip, f.frame, {r6('(f.v + r.v) / 2', 4)} AS value FROM f JOIN r USING (clip, frame)")
def bidirectional_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a forward and a backward exponential mean that give a new value the weight 0.3."""
    s = sequences(spark, sf).select("clip", "frame", "value")
    s = s.withColumn("back", F.max("frame").over(Window.partitionBy("clip")) - F.col("frame"))
    both = W.ema_rows(W.ema_rows(s, ["clip"], "frame", "value", 0.7, "forth"), ["clip"], "back", "value", 0.7, "backward")
    return both.select("clip", "frame", rounded((F.col("forth") + F.col("backward")) / 2, 4).alias("value"))


@query("f35_ema_by_type", f"WITH o AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, event_type, {r6('list_reduce(v, lambda m, x: m * 0.9 + x * 0.1)', 4)} AS ema FROM o")
def ema_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential means of the values of each event type of a user."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return W.last_ema(e, ["user_id", "event_type"], ["ts", "event_id"], "value", 0.9).select("user_id", "event_type", rounded(F.col("ema"), 4).alias("ema"))
