"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node with its k + 1 smallest ids, so copies neither crowd the graph nor
hide each other. Nodes are hashed into as many shards as there are shuffle partitions, fewer where nodes are few and more where a
shard would outgrow a task's memory, and each shard is a partition of its own. A shard's graph is flat
arrays: for each layer a matrix of neighbour numbers and one of similarities. Layers are built from
the top down; nodes enter a layer in blocks, which search the graph so far and each other, keep
neighbours that are closer to them than to an already kept one, and are linked back. Queries are
dealt to every shard of their length in blocks, and the shards' best are merged.

Cases: vectors that are null, empty, zero or hold null or non-finite components are left out, as
queries and as candidates; so are rows with a null id. Vectors are compared with those of their own length. Rows
that repeat an id and vector count once; an id with two vectors has each as a candidate. Fewer candidates
than k are all returned. Equal scores go to the smaller id. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions, slot

#: A shard has at most so many bytes of vectors, and so many rows at least where that makes more shards than tasks.
SHARD_BYTES, SHARD_ROWS = 1 << 28, 8192
#: Neighbours in the lowest and other layers, beam widths while building and searching, and nodes or queries at a time.
LINKS, UPPER_LINKS, BUILD_BEAM, BEAM, BLOCK = 32, 16, 64, 128, 256


class Layer:
    """One layer: which nodes it has, and each one's neighbours in it."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, links: int) -> None:
        self.vectors, self.nodes, self.links = vectors[nodes], nodes, links
        self.neighbours = np.full((len(nodes), links), -1, np.int32)
        self.similar = np.full((len(nodes), links), -np.inf, np.float32)

    def beam(self, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the layer, similarities) of up to width near nodes of each query, nearest first, -1 where none.

        entries: places to start from, -1 where none; several queries walk the graph in step.
        """
        n, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n, len(self.nodes) + 1), bool)
        seen[:, -1] = True  # place -1
        found = np.full((n, width), -1, np.int32)
        score = np.full((n, width), -np.inf, np.float32)
        m = min(width, entries.shape[1])
        found[:, :m] = entries[:, :m]
        score[:, :m] = np.where(found[:, :m] >= 0, np.einsum("bmd,bd->bm", self.vectors[found[:, :m]], queries), -np.inf)
        seen[rows, found] = True
        todo = found >= 0
        while True:
            live = np.flatnonzero(todo.any(1))
            if not len(live):
                break
            # The nearest node of each beam whose neighbours haven't been looked at.
            best = np.where(todo[live], score[live], -np.inf).argmax(1)
            todo[live, best] = False
            near = self.neighbours[found[live, best]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            sims = np.where(fresh, np.matmul(self.vectors[near], queries[live][:, :, None])[:, :, 0], -np.inf)
            ids = np.concatenate([found[live], np.where(fresh, near, -1)], 1)
            all_scores = np.concatenate([score[live], sims], 1)
            open_ = np.concatenate([todo[live], fresh], 1)
            top = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
            at = np.arange(len(live))[:, None]
            found[live], score[live], todo[live] = ids[at, top], all_scores[at, top], open_[at, top]
        order = np.argsort(-score, axis=1, kind="stable")
        return found[rows, order], score[rows, order]

    def select(self, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates, nearest first, those nearer than to any kept before; then the nearest others."""
        some = self.vectors[ids]
        between = np.matmul(some, some.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            rival = np.where(kept[:, :c], between[:, c, :c], -np.inf).max(1) if c else np.full(len(ids), -np.inf)
            kept[:, c] = (ids[:, c] >= 0) & (sims[:, c] > rival) & (kept.sum(1) < self.links)
        order = np.argsort(np.where(ids < 0, 2, ~kept), axis=1, kind="stable")[:, : self.links]
        rows = np.arange(len(ids))[:, None]
        ids, sims = ids[rows, order], sims[rows, order]
        return ids, np.where(ids >= 0, sims, -np.inf)

    def link(self, places: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give the places their neighbours, and these a link back; full ones choose again."""
        ids, sims = self.select(ids, sims)
        self.neighbours[places, : ids.shape[1]], self.similar[places, : ids.shape[1]] = ids, sims
        ok = ids >= 0
        target, source, s = ids[ok], np.broadcast_to(places[:, None], ids.shape)[ok].astype(np.int32), sims[ok]
        order = np.lexsort((source, -s, target))
        target, source, s = target[order], source[order], s[order]
        who, first = np.unique(target, return_index=True)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        new_ids = np.full((len(who), self.links), -1, np.int32)
        new_sims = np.full((len(who), self.links), -np.inf, np.float32)
        in_row, fits = np.searchsorted(who, target), rank < self.links
        new_ids[in_row[fits], rank[fits]], new_sims[in_row[fits], rank[fits]] = source[fits], s[fits]
        # Links within a block may exist already.
        known = (new_ids[:, :, None] == self.neighbours[who][:, None, :]).any(2)
        new_ids[known], new_sims[known] = -1, -np.inf
        for i in range(0, len(who), BLOCK):
            w = who[i : i + BLOCK]
            ids = np.concatenate([self.neighbours[w], new_ids[i : i + BLOCK]], 1)
            sims = np.concatenate([self.similar[w], new_sims[i : i + BLOCK]], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            rows = np.arange(len(w))[:, None]
            self.neighbours[w], self.similar[w] = self.select(ids[rows, order], sims[rows, order])


class Graph:
    """The layers of a shard's unit vectors, uppermost first."""

    def __init__(self, vectors: np.ndarray, seed: int = 0) -> None:
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(UPPER_LINKS)).astype(int)
        self.layers: list[Layer] = []
        for at in range(int(level.max(initial=0)), -1, -1):
            # Nodes of higher layers enter first.
            nodes = np.flatnonzero(level >= at)
            nodes = nodes[np.argsort(-level[nodes], kind="stable")]
            self._build(Layer(vectors, nodes, UPPER_LINKS if at else LINKS))

    def _build(self, layer: Layer) -> None:
        done = 0
        while done < len(layer.nodes):
            places = np.arange(done, min(len(layer.nodes), done + BLOCK))
            q = layer.vectors[places]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            ids = np.where(np.isfinite(own), places[None, :], -1).astype(np.int32)
            sims = own.astype(np.float32)
            if done:
                near, s = layer.beam(q, self._entries(q, layer, done), BUILD_BEAM)
                ids, sims = np.concatenate([near, ids], 1), np.concatenate([s, sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            rows = np.arange(len(places))[:, None]
            layer.link(places, ids[rows, order], sims[rows, order])
            done += len(places)
        self.layers.append(layer)

    def _entries(self, queries: np.ndarray, layer: Layer, done: int) -> np.ndarray:
        """Places in a layer to start from, found through the layers above; nodes there have the same places here."""
        entries = np.zeros((len(queries), 1), np.int32)
        for upper in self.layers:
            if upper is layer:
                break
            entries = upper.beam(queries, entries, 8)[0][:, :4]
        return np.where(entries < done, entries, 0)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Numbers of near vectors of each query, -1 where none."""
        last = self.layers[-1]
        found = last.beam(queries, self._entries(queries, last, len(last.nodes)), min(width, max(1, len(last.nodes))))[0]
        return np.where(found >= 0, last.nodes[found], -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles, each scaled by a power of two, which no cosine feels, so that squares neither overflow nor vanish."""
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def _best(shard: tuple, graph: Graph, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of the k best of each query in a shard."""
    vectors, norms, members = shard
    out = []
    # A node has k + 1 ids, so k + 1 nodes are enough; the beam is wider for recall.
    near = graph.search(_unit(queries), BEAM)
    for query, v, some in zip(ids.tolist(), queries, near, strict=True):
        some = some[some >= 0]
        cosine = np.einsum("nd,d->n", vectors[some], v) / (norms[some] * np.sqrt(np.einsum("d,d->", v, v)))
        found = sorted((-float(c), m) for c, s in zip(cosine, some.tolist(), strict=True) for m in members[s] if m != query)
        out += [(query, m, -c) for c, m in found[:k]]
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest other rows of each query row by cosine, as far as the graphs find them."""
    spark = rows.sparkSession
    id_type = rows.schema[id_col].dataType.simpleString()
    v = F.col("v")
    usable = v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = checkpointed(
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), slot().alias("slot"))
        .where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    )
    # First within slots, so a vector with very many copies is never collected whole.
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    nodes = checkpointed(
        valid.groupBy("v", "slot")
        .agg(smallest(F.collect_set("id")).alias("ids"))
        .groupBy("v")
        .agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
        .withColumn("d", F.size("v"))
    )
    # One row for each vector length.
    shards, base = {}, 0
    for r in nodes.groupBy("d").count().orderBy("d").collect():
        least = -(-r["count"] * r["d"] * 8 // SHARD_BYTES)
        shards[r["d"]] = (base, max(least, min(shuffle_partitions(spark), -(-r["count"] // SHARD_ROWS))))
        base += shards[r["d"]][1]
    out_schema = f"query_id {id_type}, {id_col} {id_type}, score double"
    if not shards:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    # One row for each vector length.
    told = F.broadcast(spark.createDataFrame([(d, b, s) for d, (b, s) in shards.items()], "d int, base int, shards int"))
    placed = nodes.join(told, "d").select((F.col("base") + F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "v", "ids")
    asked = valid.where("asks").select("id", "v", F.size("v").alias("d")).distinct().join(told, "d")
    dealt = asked.select(F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v", F.array().cast(f"array<{id_type}>").alias("ids"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, members, graph, shard = None, [], [], None, None
        for batch in parts:
            numbers, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if numbers[a] != now:
                    now, vectors, members, graph = numbers[a], [], [], None
                if kinds[a] == 0:
                    vectors.append(_matrix(some.column("v")))
                    members += some.column("ids").to_pylist()
                    continue
                if not members:
                    continue
                if graph is None:
                    whole = np.concatenate(vectors)
                    shard = (whole, np.sqrt(np.einsum("nd,nd->n", whole, whole)), members)
                    graph = Graph(_unit(whole), int(now))
                ids = some.column("id")
                for i in range(0, len(ids), BLOCK):
                    found = _best(shard, graph, ids.slice(i, BLOCK).to_numpy(zero_copy_only=False), _matrix(some.column("v").slice(i, BLOCK)), k)
                    columns = list(zip(*found, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], ids.type), pa.array(columns[2], pa.float64())], ["query_id", id_col, "score"])

    searched = placed.unionByName(dealt).repartitionById(base, F.col("shard")).sortWithinPartitions("shard", "kind", F.xxhash64("v"), "id").mapInArrow(work, out_schema)
    # At most k rows for each query and shard.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    merged = searched.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
