"""Hierarchical packing of token sequences into windows of several context sizes.

A document's ids and an end id are cut into whole long windows and a tail. Tails are
routed to tiers: the shortest window that holds them. Tiers are packed from the longest
down: each tail opens a window of its tier, and the gap is filled from shorter
tiers, by the longest tail that fits, or else by the front of one that doesn't, whose
rest is routed anew. Windows of the last tier are filled by cutting, too, so all windows
but the last of a partition are full. What is left at a partition's end is cut into
windows of the tiers' sizes; only ids fewer than the shortest tier are padded.

Step groups: windows of one tier are dealt into groups of equal token count, the costliest
(by the sum of squared piece lengths, as attention costs) first to the cheapest group.

Packing happens where a document is read, without a shuffle: pieces of one document
never depend on another partition, and a lost executor's partitions are packed again alike.

Cases: null and empty texts are a document of the end id alone. Repeated rows and rows with
a null id are documents of their own; ``row`` tells pieces of equal ids apart. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import REMEMBERED, SLICE_BYTES, TokenizerSpec, batches, encoder

#: Windows of a step group hold so many tokens together, and so many groups are balanced at a time.
STEP_TOKENS, STEP_POOL = 1 << 14, 8


class Packer:
    """Packs one partition's documents; ids of windows and groups start at ``base``."""

    def __init__(self, tiers: tuple[int, ...], base: int) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.base = base
        self.made = 0
        self.groups = 0
        # Tails by tier: (length, number, row, start, ids), kept in order of length.
        self.tails: list[list[tuple]] = [[] for _ in self.tiers]
        self.number = 0
        self.rows: list[tuple] = []
        self.pool: list[list[tuple[int, int]]] = [[] for _ in self.tiers]
        self.group_of: dict[int, int] = {}

    def add(self, row: tuple, ids: np.ndarray) -> None:
        """row: what identifies the document in each piece's row."""
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for at in range(0, whole, longest):
            self._window(0, [(row, at, ids[at : at + longest])])
        if whole < len(ids):
            self._route(row, whole, ids[whole:])

    def _route(self, row: tuple, start: int, ids: np.ndarray) -> None:
        tier = max(i for i, size in enumerate(self.tiers) if size >= len(ids))
        if self.tiers[tier] == len(ids):
            self._window(tier, [(row, start, ids)])
        else:
            insort(self.tails[tier], (len(ids), self.number, row, start, ids))
            self.number += 1

    def _window(self, tier: int, pieces: list[tuple]) -> None:
        number = self.base + self.made
        self.made += 1
        offset, cost = 0, 0
        for row, start, ids in pieces:
            n = len(ids)
            self.rows.append((*row, start, n, zlib.crc32(ids), number, offset, self.tiers[tier]))
            offset += n
            cost += n * n
        self.pool[tier].append((cost, number))

    def flush(self, final: bool = False) -> None:
        """Pack the tails; those that find no fillers stay for later, unless it is the end."""
        last = len(self.tiers) - 1
        for tier, size in enumerate(self.tiers[:-1]):
            kept = []
            while self.tails[tier]:
                length, number, row, start, ids = self.tails[tier].pop()
                pieces, gap = [(row, start, ids)], size - length
                while gap:
                    piece = self._filler(tier + 1, gap)
                    if piece is None:
                        break
                    pieces.append(piece)
                    gap -= len(piece[2])
                if not gap:
                    self._window(tier, pieces)
                elif final:
                    # No shorter tail is left: all pieces go down, cut at the next tier's size.
                    half = self.tiers[tier + 1]
                    for row, start, ids in pieces:
                        for at in range(0, len(ids), half):
                            self._route(row, start + at, ids[at : at + half])
                else:
                    kept += [(len(i), self.number + k, r, s, i) for k, (r, s, i) in enumerate(pieces)]
                    self.number += len(pieces)
            for tail in kept:
                insort(self.tails[max(i for i, t in enumerate(self.tiers) if t >= tail[0])], tail)
        tails, size = self.tails[last], self.tiers[last]
        held = sum(t[0] for t in tails)
        while held >= size or (final and tails):
            pieces, gap = [], size
            while gap and tails:
                length, _, row, start, ids = tails.pop()
                pieces.append((row, start, ids[:gap]))
                if length > gap:
                    self._route(row, start + gap, ids[gap:])
                gap -= len(pieces[-1][2])
            held -= size - gap
            self._window(last, pieces)
        self._balance(final)

    def _filler(self, tier: int, gap: int) -> tuple | None:
        """The longest shorter tail that fits, or the front of the shortest one that doesn't."""
        for below in range(tier, len(self.tiers)):
            at = bisect_right(self.tails[below], (gap, float("inf")))
            if at:
                _, _, row, start, ids = self.tails[below].pop(at - 1)
                return row, start, ids
        for below in range(len(self.tiers) - 1, tier - 1, -1):
            if self.tails[below]:
                _, _, row, start, ids = self.tails[below].pop(0)
                self._route(row, start + gap, ids[gap:])
                return row, start, ids[:gap]
        return None

    def _balance(self, final: bool) -> None:
        for tier, size in enumerate(self.tiers):
            each = max(1, STEP_TOKENS // size)
            while len(self.pool[tier]) >= each * STEP_POOL or (final and self.pool[tier]):
                some = sorted(self.pool[tier][: each * STEP_POOL], reverse=True)
                self.pool[tier] = self.pool[tier][each * STEP_POOL :]
                n = -(-len(some) // each)
                room, cost = [each] * n, [0] * n
                for c, number in some:
                    g = min((g for g in range(n) if room[g]), key=lambda g: cost[g])
                    room[g] -= 1
                    cost[g] += c
                    self.group_of[number] = self.base + self.groups + g
                self.groups += n

    def take(self) -> list[tuple]:
        """Finished piece rows whose step group is known: (*row, start, length, crc32, window, offset, tier, group)."""
        done = [(*r, self.group_of[r[-3]]) for r in self.rows if r[-3] in self.group_of]
        self.rows = [r for r in self.rows if r[-3] not in self.group_of]
        self.group_of.clear()
        return done


def pack(
    docs: DataFrame,
    spec: TokenizerSpec,
    end_id: int = 1,
    tiers: tuple[int, ...] = (2048, 1024, 512, 256),
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, row.

    tiers: window sizes, powers of two; a sequence that isn't full is padded to the longest.
    slice_bytes, remembered: text encoded at a time and pieces a worker remembers; less of both saves memory and costs time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, row long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, tier int, step_group long"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(spec, remembered)
        # A partition has fewer than 2^40 windows and documents.
        base = TaskContext.get().partitionId() << 40
        packer = Packer(tiers, base)
        types = [f.type for f in pa.schema([("row", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])]
        names = ["row", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "tier", "step_group"]
        number, id_arrow = 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [[] for _ in range(10)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], ["id", *names])

        for doc_ids, texts in batches(parts, "id", "text", slice_bytes):
            id_arrow = doc_ids.type
            ids, before = encode.ids(texts, end_id)
            for doc, a, b in zip(doc_ids.to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                packer.add((doc, base + number, b - a), ids[a:b])
                number += 1
            packer.flush()
            # Tails that stay must not hold the whole batch's ids.
            packer.tails = [[(n, k, row, start, ids.copy()) for n, k, row, start, ids in tier] for tier in packer.tails]
            yield out()
        if id_arrow is not None:
            packer.flush(final=True)
            yield out()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    packed = docs.select(F.col(id_col).alias("id"), text).mapInArrow(work, schema)
    return packed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "row")
