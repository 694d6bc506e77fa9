"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by their
membership pattern; a flow routes the patterns' words to the sources' quotas. The
k-th use of a word costs k - 1, so a word is repeated only where no unused word of
a fitting pattern is left, and repetition is spread evenly. The flow network has one node
for each pattern and source: it grows with the configuration, not with the corpus.

A pattern that is to give x words of its S words gives each document floor(x / S)
times, and documents holding the rest once more. Those are chosen by a seeded hash:
histograms of ever finer hash buckets find the place where the running sum reaches the
rest. What still lacks is filled from unchosen documents that fit in it until none does. No documents are
ordered or gathered: a choice is a few ranges of sizes and hashes for each pattern.

Cases: a null text has size 0 and is never needed. A null source is a source of
its own, ordered last; an empty or null membership array is the pattern of the null
source. A source without words gets target 0. Rows with equal id, size and sources are
interchangeable: which of them are taken isn't told apart. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from heapq import heappop, heappush
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

INF = float("inf")
#: Sizes and places in the hash order that are taken: from least to most, and from a place to before another; END is behind all places.
RANGE, END = "struct<least:long,most:long,fu:long,fw:long,tu:long,tw:long>", 1 << 60


def word_count(text_col: str) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(n: int, cycle: Sequence[int] = (1, 2, 3)) -> list[int]:
    """Weights of n ordered sources."""
    return [cycle[i % len(cycle)] for i in range(n)]


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.0, max_repeat: int = 3) -> list[float]:
    """Shares of ``share`` times all words by weight; none above max_repeat times its source's size.

    What capped sources leave goes to the others by weight, until none is above.
    """
    target = [0.0] * len(sizes)
    free = [i for i, w in enumerate(weights) if w > 0]
    rest = share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if rest * weights[i] / total > max_repeat * sizes[i]]
        if not above:
            for i in free:
                target[i] = rest * weights[i] / total
            break
        for i in above:
            target[i] = float(max_repeat * sizes[i])
            rest -= target[i]
        free = [i for i in free if i not in above]
    return target


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], max_repeat: int = 3) -> dict[tuple[int, int], int]:
    """Words that each pattern gives to each source: (pattern, source) -> words.

    patterns: (the sources it belongs to, its words). The routing fills as much of the
    quotas as can be filled, at the least cost of repetition. Patterns and sources that no
    overlap connects are routed apart.
    """
    root = list(range(len(quotas)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    parts: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        parts.setdefault(find(members[0]), []).append(p)
    out = {}
    for part in parts.values():
        sources = sorted({s for p in part for s in patterns[p][0]})
        at = {s: i for i, s in enumerate(sources)}
        flow = _flow([([at[s] for s in patterns[p][0]], patterns[p][1]) for p in part], [quotas[s] for s in sources], max_repeat)
        out |= {(part[p], sources[s]): w for (p, s), w in flow.items() if w > 0}
    return out


def _flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], max_repeat: int) -> dict[tuple[int, int], int]:
    """Min-cost flow by successive shortest paths, with potentials that keep all costs from being negative."""
    n, m = len(patterns), len(quotas)
    sink = n + m + 1
    to: list[int] = []
    room: list[float] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, most: float, c: int) -> None:
        for x, y, r, k in ((a, b, most, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    routes = {}
    for p, (members, words) in enumerate(patterns):
        for k in range(max_repeat):
            arc(0, 1 + p, words, k)
        for s in members:
            routes[p, s] = len(to)
            arc(1 + p, 1 + n + s, INF, 0)
    for s, q in enumerate(quotas):
        arc(1 + n + s, sink, q, 0)
    height = [0.0] * (sink + 1)
    while True:
        far, by = [INF] * (sink + 1), [-1] * (sink + 1)
        far[0] = 0.0
        heap = [(0.0, 0)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                new = d + cost[e] + height[a] - height[to[e]]
                if room[e] > 0 and new < far[to[e]]:
                    far[to[e]], by[to[e]] = new, e
                    heappush(heap, (new, to[e]))
        if far[sink] == INF:
            return {k: int(room[e ^ 1]) for k, e in routes.items()}
        height = [h + min(d, far[sink]) for h, d in zip(height, far, strict=True)]
        path, v = [], sink
        while v:
            path.append(by[v])
            v = to[by[v] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def _taken() -> Column:
    """Whether one of the row's ranges of sizes and places holds it."""
    place = F.struct("pu", "pw")
    return F.exists(
        F.coalesce("takes", F.array().cast(f"array<{RANGE}>")),
        lambda t: F.col("size").between(t["least"], t["most"]) & (place >= F.struct(t["fu"], t["fw"])) & (place < F.struct(t["tu"], t["tw"])),
    )


def _open(rows: DataFrame, takes: dict[str, list[tuple]], gaps: dict[str, int]) -> DataFrame:
    """Rows that aren't chosen yet, of patterns that lack words; gap: these words."""
    # One row for each pattern, so the side to broadcast is as small as the configuration.
    told = rows.sparkSession.createDataFrame([(p, g, takes.get(p, [])) for p, g in gaps.items()], f"pattern string, gap long, takes array<{RANGE}>")
    return rows.join(F.broadcast(told), "pattern").where((F.col("size") > 0) & ~_taken())


def _choose(rows: DataFrame, rest: dict[str, int]) -> dict[str, list[tuple]]:
    """For each pattern the ranges (least and most size, first and end place) of rows that hold its rest.

    rows: (pattern, size, pu, pw), the last two a row's place in the hash order. Each step takes, of the rows that
    fit in what a pattern lacks: all, if together they still fit; else the largest one, if it is no small part; else
    those before a place in the hash order. When nothing fits, the smallest row is taken if that comes closer.
    """
    takes: dict[str, list[tuple]] = {}
    gaps = {p: g for p, g in rest.items() if g > 0}
    while gaps:
        fitting = _open(rows, takes, gaps).where("size <= gap")
        largest = F.min(F.struct((-F.col("size")).alias("size"), "pu", "pw"))
        found = {r["pattern"]: r for r in fitting.groupBy("pattern").agg(F.sum("size").alias("words"), largest.alias("one")).collect()}
        gaps = {p: g for p, g in gaps.items() if p in found}
        many = {}
        for p, r in found.items():
            size, one = -r["one"]["size"], r["one"]
            if r["words"] <= gaps[p]:
                takes.setdefault(p, []).append((1, gaps[p], 0, 0, END, 0))
                gaps[p] -= r["words"]
            elif 8 * size >= gaps[p]:
                takes.setdefault(p, []).append((size, size, one["pu"], one["pw"], one["pu"], one["pw"] + 1))
                gaps[p] -= size
            else:
                many[p] = gaps[p]
        for p, (tu, tw, words) in _places(_open(rows, takes, many).where("size <= gap"), many).items() if many else ():
            takes.setdefault(p, []).append((1, gaps[p], 0, 0, tu, tw))
            gaps[p] -= words
        gaps = {p: g for p, g in gaps.items() if g > 0}
    short = {p: g - sum_ for p, g, sum_ in _sums(rows, takes, rest) if g > sum_}
    if short:
        smallest = _open(rows, takes, short).groupBy("pattern").agg(F.min(F.struct("size", "pu", "pw")).alias("one"))
        for r in smallest.collect():
            if r["one"]["size"] < 2 * short[r["pattern"]]:
                size, pu, pw = r["one"]
                takes.setdefault(r["pattern"], []).append((size, size, pu, pw, pu, pw + 1))
    return takes


def _places(rows: DataFrame, gaps: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """For each pattern the place (pu, pw) before which its rows hold as much of its gap as can be, and these rows' words.

    Each pass sums sizes by the next 12 bits of the places in the bucket that reaches the gap.
    """
    state = {p: (0, 0, 0, True) for p in gaps}
    for level in range(10):
        going = [(p, tu, tw, gaps[p] - words) for p, (tu, tw, words, on) in state.items() if on]
        if not going:
            break
        told = rows.sparkSession.createDataFrame(going, "pattern string, tu long, tw long, lacks long")
        shift = 48 - 12 * (level % 5)
        upper = lambda c: F.shiftright(c, shift + 12)  # noqa: E731, B023
        inside = upper("pu") == upper("tu") if level < 5 else (F.col("pu") == F.col("tu")) & (upper("pw") == upper("tw"))
        digit = F.shiftright("pu" if level < 5 else "pw", shift).bitwiseAND(F.lit(4095)).cast("int").alias("digit")
        sums = rows.join(F.broadcast(told), "pattern").where(inside).groupBy("pattern", digit, "lacks").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        # 64 times 64 sums at most for each pattern.
        some = sums.groupBy("pattern", "lacks", F.shiftright("digit", 6).alias("high")).agg(F.array_sort(F.collect_list(F.struct("digit", "words", "n"))).alias("few"))
        line = some.groupBy("pattern", "lacks").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("high", "few"))), lambda x: x["few"])).alias("all"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("edge"), F.lit(0).cast("long").alias("n"))

        def step(a: Column, x: Column) -> Column:
            over = a["before"] + x["words"] > F.col("lacks")
            here = F.struct(a["before"].alias("before"), x["digit"].alias("edge"), x["n"].alias("n"))
            on = F.struct((a["before"] + x["words"]).alias("before"), F.lit(None).cast("int").alias("edge"), F.lit(0).cast("long").alias("n"))
            return F.when(a["edge"].isNotNull(), a).when(over, here).otherwise(on)

        for r in line.select("pattern", F.aggregate("all", start, step).alias("e")).collect():
            tu, tw, words, _ = state[r["pattern"]]
            before, edge, n = r["e"]
            if level < 5:
                tu += edge << shift
            else:
                tw += edge << shift
            state[r["pattern"]] = (tu, tw, words + before, n > 1)
    return {p: (tu, tw, words) for p, (tu, tw, words, _) in state.items()}


def _sums(rows: DataFrame, takes: dict[str, list[tuple]], rest: dict[str, int]) -> list[tuple[str, int, int]]:
    """(pattern, its rest, words that are taken of it) of every pattern that is to give a rest."""
    wanted = {p: g for p, g in rest.items() if g > 0}
    if not wanted:
        return []
    told = rows.sparkSession.createDataFrame([(p, t) for p, t in takes.items()], f"pattern string, takes array<{RANGE}>")
    got = {r["pattern"]: r["words"] for r in rows.join(F.broadcast(told), "pattern").where(_taken()).groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    return [(p, g, got.get(p, 0)) for p, g in wanted.items()]


def mix(
    docs: DataFrame,
    size: Column,
    sources: Column,
    targets: Callable[[list[str | None], list[int]], Sequence[float]],
    max_repeat: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: id, size, sources, copies, taken, source_size, target.

    sources: a string, or an array of strings for overlapping sources.
    targets: from the ordered source names (null last) and their sizes to their words. A
    document of several sources counts for each of them in a source's size; source_size
    and target are those of the first. Patterns and sources are part of the configuration and are solved on the driver.
    """
    spark = docs.sparkSession
    single = not docs.select(sources.alias("s")).schema["s"].dataType.typeName() == "array"
    members = F.array(sources.cast("string")) if single else F.sort_array(F.array_distinct(sources), asc=True)
    members = F.when(F.coalesce(F.size(members), F.lit(0)) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), members.alias("members")).withColumn("pattern", F.to_json(F.struct("members")))
    # The second hash parts rows of equal id and size, which are interchangeable.
    order = {"pu": F.xxhash64("id", "size", F.lit(seed)), "pw": F.xxhash64(F.monotonically_increasing_id())}
    rows = checkpointed(rows.select("*", *(F.shiftrightunsigned(h, 4).alias(c) for c, h in order.items())))
    found = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: r["pattern"])
    names = sorted({m for r in found for m in r["members"]}, key=lambda m: (m is None, m or ""))
    at = {m: i for i, m in enumerate(names)}
    sizes = [sum(r["words"] for r in found if m in r["members"]) for m in names]
    wanted = list(targets(names, sizes))
    patterns = [([at[m] for m in r["members"]], r["words"]) for r in found]
    flow = route(patterns, [floor(t + 1e-6) for t in wanted], max_repeat)
    gives = [0] * len(found)
    for (p, _), w in flow.items():
        gives[p] += w
    whole = [g // r["words"] if r["words"] else 0 for g, r in zip(gives, found, strict=True)]
    rest = {r["pattern"]: g - k * r["words"] for r, g, k in zip(found, gives, whole, strict=True)}
    # Of a rest of more than half the words, those that aren't in it are chosen, as there are more documents to choose them from.
    without = {r["pattern"]: 2 * rest[r["pattern"]] > r["words"] for r in found}
    takes = _choose(rows, {r["pattern"]: r["words"] - rest[r["pattern"]] if without[r["pattern"]] else rest[r["pattern"]] for r in found})
    told = spark.createDataFrame(
        [
            (r["pattern"], k, sizes[at[r["members"][0]]], float(wanted[at[r["members"][0]]]), takes.get(r["pattern"], []), without[r["pattern"]])
            for r, k in zip(found, whole, strict=True)
        ],
        f"pattern string, whole int, source_size long, target double, takes array<{RANGE}>, without boolean",
    )
    # As many rows as patterns.
    return (
        rows.join(F.broadcast(told), "pattern")
        .withColumn("copies", F.col("whole") + ((F.col("size") > 0) & (_taken() != F.col("without"))).cast("int"))
        .select(F.col("id").alias(id_col), "size", "members", "copies", (F.col("size") * F.col("copies")).alias("taken"), "source_size", "target")
    )
