"""Structured Streaming jobs: late packets, idle sessions, groups held back, and the tracking writer's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def on_time_packets(packets: DataFrame, delay: str, window: str) -> DataFrame:
    """Packets counted by window (clip, ts); what comes after the watermark is dropped."""
    return packets.withWatermark("ts", delay).groupBy("clip", F.window("ts", window)).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))


def trim_late(start: str, end: str, now: str):
    """Start of what is left of a buffer that is partly in the past; null if it is wholly so."""
    return F.when(F.col(end) > F.col(now), F.greatest(F.col(start), F.col(now)))


def sessions(events: DataFrame, idle: str, delay: str) -> DataFrame:
    """Sessions of a user that end after an idle time."""
    return events.withWatermark("ts", delay).groupBy("user", F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("events"))


def hold_back_groups(frames: DataFrame, length: int) -> DataFrame:
    """Whole groups of ``length`` frames per clip as they fill (clip, gop, frames); the last one stays in the state until it is full.

    frames: clip, frame, in any order within a batch.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = sorted({*held, *(int(f) for p in parts for f in p["frame"])})
        out = []
        for gop in sorted({f // length for f in held}):
            members = [f for f in held if f // length == gop]
            if len(members) == length:
                out.append((key[0], gop, length))
                held = [f for f in held if f // length != gop]
        state.update((held,))
        yield pd.DataFrame(out, columns=["clip", "gop", "frames"])

    return frames.groupBy("clip").applyInPandasWithState(work, "clip long, gop long, frames long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def track_runs(masks: DataFrame) -> DataFrame:
    """Runs of frames in which an object has a mask (object, first, last, own), again whenever they change.

    masks: object, frame, own (set by the user). Neighbouring frames join a run, a frame between two runs joins both, and
    a user's frame is never replaced by a derived one, so a reverse leg may repeat its seed.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        before = dict(known)
        for p in parts:
            for frame, own in zip(p["frame"], p["own"], strict=True):
                known[int(frame)] = bool(own) or known.get(int(frame), False)
        frames = sorted(known)
        state.update((frames, [known[f] for f in frames]))
        if known == before:
            return
        rows, first = [], None
        for k, f in enumerate(frames):
            first = f if first is None else first
            if k + 1 == len(frames) or frames[k + 1] > f + 1:
                rows.append((key[0], first, f, sum(known[x] for x in range(first, f + 1))))
                first = None
        yield pd.DataFrame(rows, columns=["object", "first", "last", "own"])

    return masks.groupBy("object").applyInPandasWithState(work, "object long, first long, last long, own long", "frames array<long>, own array<boolean>", "update", GroupStateTimeout.NoTimeout)
