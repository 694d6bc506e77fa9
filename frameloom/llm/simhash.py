"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints: each word shingle's XXH64 votes on 64 bits. Distinct fingerprints are
searched for links of at most three differing bits:

* upper nodes of the index are shared masked patterns. Two fingerprints within three
  bits agree on one of four 16-bit blocks, so a fingerprint hangs below its four
  block patterns, and Spark deals out the subtrees by pattern. A pattern with very
  many fingerprints is split by one of four 12-bit blocks of the other bits; there
  are at most 4 * 65536 patterns, which bounds the list of crowded ones.
* below a pattern, fingerprints are sorted by Gray rank, so neighbours differ in few
  bits. Runs of them form nodes that keep the bits all their fingerprints share.
  The differences of two nodes' shared bits are a lower bound for all their pairs;
  pairs of nodes above three are pruned whole, others descend one level.
* a subtree reports a spanning forest of its links, at most one link for each
  fingerprint, and pairs of nodes whose fingerprints are already connected are skipped.
  Alternating stars join the forests into components.

Cases: null and empty texts, and texts of white space only, have fingerprint zero and
link like any other. Texts with fewer words than a shingle hash their whole word
sequence. Null ids are kept; a component of only null ids has a null component id.
Repeated rows each get their row. An empty table gives an empty result. Other columns
are not read.

Near duplicates by Jaccard similarity take fingerprints as a search for candidate groups only:
within a group every link is checked on the two sets of shingles before it joins anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stars
from .shared import checkpointed, lookup, shuffle_partitions, slot, text_or_empty
from .tokenizer import batches

LEAF, FAN = 16, 8
#: Fingerprints below one 16-bit pattern from which it is split: by further bits within three bits, else into sections.
CROWDED, SECTION = 4096, 1 << 15
#: Pairs that are compared at a time, index rows or bytes that are searched at a time, and hashes whose bits are counted at a time.
PAIRS, ROWS, BYTES, COUNTED = 1 << 19, 1 << 16, 1 << 25, 1 << 13
#: Texts, and hashes of their shingles, of a section of a candidate group.
TEXTS, HASHES = 4096, 1 << 22


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, ASCII-lower-cased and joined by single spaces."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII letters and the six ASCII white-space bytes only.
    line = b" ".join(text.lower().split())
    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    if len(gaps) < words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    starts = [0, *(g + 1 for g in gaps[: len(gaps) - words + 1])]
    ends = [*gaps[words - 1 :], len(line)]
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: list[np.ndarray], count: int = 1) -> np.ndarray:
    """Of each array of hashes, for each of ``count`` independent families the 64 bits set in over half of them, as a signed number."""
    out = np.zeros((len(hashes), count), np.int64)
    sizes = np.array([len(h) for h in hashes])
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        # Arrays of like size are counted together, filled up with zeros; a long one is counted in parts.
        to = at + 1
        while to < len(order) and (to + 1 - at) * sizes[order[to]] <= COUNTED:
            to += 1
        some, n = order[at:to], sizes[order[to - 1]]
        votes = np.zeros((count, len(some), 64), np.int64)
        for i in range(0, n, COUNTED):
            width = min(COUNTED, n - i)
            part = np.zeros((len(some), width), np.uint64)
            for row, k in zip(part, some, strict=True):
                row[: max(0, sizes[k] - i)] = hashes[k][i : i + width]
            real = i + np.arange(width) < sizes[some][:, None]
            votes += _set_bits(np.stack([np.where(real, family(part, k), np.uint64(0)) for k in range(count)]))
        out[some] = np.packbits(2 * votes > sizes[some][:, None], axis=2, bitorder="little").view("<i8")[:, :, 0].T
        at = to
    return out


def _set_bits(words: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set along the last axis; adders count all bits of three words at once."""
    total = np.zeros((*words.shape[:-1], 64), np.int64)
    level, weight = words, 1
    while level.shape[-1]:
        carries = []
        while (third := level.shape[-1] // 3) > 0:
            a, b, c = (level[..., k * third : (k + 1) * third] for k in range(3))
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            level = np.concatenate([ab ^ c, level[..., 3 * third :]], -1)
        bits = np.unpackbits(np.ascontiguousarray(level).astype("<u8", copy=False).view(np.uint8).reshape(*level.shape, 8), axis=-1, bitorder="little")
        total += weight * bits.sum(-2, dtype=np.int64)
        level, weight = np.concatenate([words[..., :0], *carries], -1), 2 * weight
    return total


def family(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the k-th independent fingerprint; the 0th keeps them."""
    if k:
        # Two rounds of a 64-bit finaliser with a seed; overflow is wanted.
        hashes = hashes ^ np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes = hashes ^ (hashes >> np.uint64(31))
    return hashes


def _bytes(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def fingerprints(docs: DataFrame, words: int = 3, count: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slot, f0, f1, ...): ``count`` independent fingerprints of every row, as signed longs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f"f{k}" for k in range(count)]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(parts, "id", "text", 2 << 20):
            found = majority([shingle_hashes(text.as_py() or b"", words) for text in _bytes(texts)], count)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[:, k]) for k in range(count))], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(work, ", ".join([f"id {id_type}", *(f"{n} long" for n in names)]))
    return checkpointed(out.select("id", slot().alias("slot"), *names))


def sets(docs: DataFrame, words: int, count: int) -> DataFrame:
    """(id, t, slot, d0, d1, f0, f1, ...) of every row of (id, text, t): a digest and fingerprints of its set of shingles."""
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["d0", "d1", *(f"f{k}" for k in range(count))]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for keys, texts in batches(parts, "key", "text", 2 << 20):
            hashes = [np.unique(shingle_hashes(text.as_py() or b"", words)) for text in _bytes(texts)]
            digests = np.array([np.frombuffer(xxh128_digest(h.tobytes()), np.int64) for h in hashes]).reshape(-1, 2)
            found = np.concatenate([digests, majority(hashes, count)], 1)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(found[:, k]) for k in range(count + 2))], ["key", *names])

    rows = docs.select(F.struct("id", "t").alias("key"), "text")
    out = rows.mapInArrow(work, ", ".join([f"key struct<id:{id_type},t:string>", *(f"{n} long" for n in names)]))
    return checkpointed(out.select("key.id", "key.t", slot().alias("slot"), *names))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(v, s) of every row of (v, text): its distinct shingle hashes."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(parts, "v", "text", 1 << 20):
            found = [np.unique(shingle_hashes(text.as_py() or b"", words)).view(np.int64) for text in _bytes(texts)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, np.concatenate(found))], ["v", "s"])

    return docs.select("v", "text").mapInArrow(work, "v long, s array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _nodes(starts: np.ndarray, keys: np.ndarray, fan: int) -> np.ndarray:
    """First member of each node when up to fan neighbours of one key form a node; members are given by their keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.arange(len(keys))
    return np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % fan == 0)


def forest(
    prints: np.ndarray, keys: np.ndarray, radius: int = 3, wide: np.ndarray | None = None, wide_radius: int = 0, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root), as indices, that connect all fingerprints of equal key within radius of each other.

    wide: further words of each fingerprint; then a pair must also differ in at most wide_radius of these bits.
    check: tells which of the pairs (a, b), as indices, are links after all; the nearest are asked about first, and
    pairs that are connected already never are.
    """
    order = np.lexsort((gray_rank(prints), keys))
    prints, keys = prints[order], keys[order]
    wide = None if wide is None else wide[order]
    n = len(prints)
    label = np.arange(n)

    def join(x: np.ndarray, y: np.ndarray) -> None:
        while (label[x] != label[y]).any():
            np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
            while (label != label[label]).any():
                label[:] = label[label]

    # Levels from the leaves up: first member, end, and the bits set in all and in any member.
    levels = []
    all_set, any_set, node_keys, fan = prints, prints, keys, LEAF
    while True:
        starts = _nodes(all_set, node_keys, fan)
        ends = np.append(starts[1:], len(node_keys))
        all_set = np.bitwise_and.reduceat(all_set, starts)
        any_set = np.bitwise_or.reduceat(any_set, starts)
        node_keys, fan = node_keys[starts], FAN
        levels.append((starts, ends, all_set, any_set))
        if not (node_keys[1:] == node_keys[:-1]).any():
            break
    top = np.arange(len(node_keys))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, i, j = stack.pop()
        starts, ends = levels[level][:2]
        if level == 0:
            # Leaves whose fingerprints are connected already have nothing to add.
            low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            open_ = ~((low[i] == high[j]) & (high[i] == low[j]))
            i, j = i[open_], j[open_]
        width = ends[j] - starts[j]
        many = np.cumsum((ends[i] - starts[i]) * width)
        if not len(many):
            continue
        if many[-1] > PAIRS and len(i) > 1:
            cut = max(1, int(np.searchsorted(many, PAIRS)))
            stack.append((level, i[cut:], j[cut:]))
            i, j, width, many = i[:cut], j[:cut], width[:cut], many[:cut]
        each = np.diff(many, prepend=0)
        pair = np.repeat(np.arange(len(i)), each)
        at = np.arange(many[-1]) - np.repeat(many - each, each)
        a, b = starts[i][pair] + at // width[pair], starts[j][pair] + at % width[pair]
        if level:
            below = levels[level - 1]
            shared = ~(below[2] ^ below[3])
            keep = (a <= b) & (np.bitwise_count((below[2][a] ^ below[2][b]) & shared[a] & shared[b]) <= radius)
            if keep.any():
                stack.append((level - 1, a[keep], b[keep]))
            continue
        keep = (a < b) & (label[a] != label[b]) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
        a, b = a[keep], b[keep]
        if wide is not None:
            far = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64)
            near = np.flatnonzero(far <= wide_radius)
            near = near[np.argsort(far[near], kind="stable")]
            a, b = a[near], b[near]
        if check is None:
            join(a, b)
            continue
        most = 1
        while len(a):
            # Of each component's pairs the nearest ``most``; more of them where these were no links.
            asked = (_rank(label[a]) < most) | (_rank(label[b]) < most)
            x, y = a[asked], b[asked]
            good = check(order[x], order[y])
            join(x[good], y[good])
            left = ~asked & (label[a] != label[b])
            a, b, most = a[left], b[left], 4 * most
    child = np.flatnonzero(label != np.arange(n))
    return order[child], order[label[child]]


def _rank(groups: np.ndarray) -> np.ndarray:
    """Of each member, how many of its group come before it."""
    by = np.argsort(groups, kind="stable")
    new = np.ones(len(groups), bool)
    new[1:] = groups[by][1:] != groups[by][:-1]
    at = np.arange(len(groups))
    out = np.empty(len(groups), np.int64)
    out[by] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _hung(vertices: DataFrame, prints: list[str], others: list[str], rest: bool) -> DataFrame:
    """vertices below each of their patterns: v, others, p, key (fingerprint, block and its 16 bits) and, if wanted, the other 48 bits."""
    each = vertices.select("v", *others, F.posexplode(F.array(*prints)).alias("f", "p"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"))
    key = F.expr("shiftleft(CAST(f AS BIGINT), 56) + shiftleft(CAST(b AS BIGINT), 16) + (shiftrightunsigned(p, 16 * b) & 65535L)")
    # The fourth block's upper part is none: a shift by 64 would be one by 0.
    others48 = F.expr("(p & (shiftleft(1L, 16 * b) - 1L)) | IF(b < 3, shiftleft(shiftrightunsigned(p, 16 * b + 16), 16 * b), 0L)")
    return each.select("v", *others, "p", key.alias("key"), *([others48.alias("rest")] if rest else []))


def links(vertices: DataFrame, prints: list[str], radius: int = 3, wide_radius: int | None = None, wide: list[str] | None = None) -> DataFrame:
    """(a, b) links that connect near vertices; vertices: v, a long, and the columns ``prints``.

    Two vertices are near where one of their fingerprints differs in at most radius bits and, if wide_radius is
    given, all of them, or those of ``wide``, together in at most wide_radius bits. With a radius of at most three no pair is lost;
    a wider radius finds the pairs that agree on one of a fingerprint's 16-bit blocks, however many agree on it:
    a crowded block's vertices are cut into sections, and every two sections are searched together.
    """
    n = shuffle_partitions(vertices.sparkSession)
    others = (wide or prints) if wide_radius is not None else []
    exact = radius <= 3
    hung = _hung(vertices, prints, others, exact)
    # At most 4 * 65536 keys exist for each of a few fingerprints.
    crowded = F.broadcast(hung.groupBy("key").count().where(F.col("count") > (CROWDED if exact else SECTION)).select("key", F.ceil(F.col("count") / SECTION).alias("sections")))
    hung = hung.join(crowded, "key", "left")
    if exact:
        # Three differing bits leave one of four 12-bit blocks of the others alone.
        split = F.array(*(F.col("key") + ((s + 1) << 20) + F.shiftleft(F.shiftrightunsigned("rest", 12 * s).bitwiseAND(F.lit(0xFFF)), 24) for s in range(4)))
    else:
        split = F.transform(_meetings(F.col("v"), F.col("sections")), lambda m: F.col("key") + F.shiftleft(m["low"], 20) + F.shiftleft(m["high"], 38))
    hung = hung.select("v", *others, "p", F.explode(F.when(F.col("sections").isNotNull(), split).otherwise(F.array("key"))).alias("key"))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, p, key, *rest in _by_key(parts, ["v", "p", "key", *others]):
            words = np.stack([np.asarray(c) for c in rest], 1).view(np.uint64) if rest else None
            child, root = forest(np.asarray(p).view(np.uint64), np.asarray(key), radius, words, wide_radius or 0)
            yield _hanging(np.asarray(v), child, root)

    return hung.repartition(n, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def _hanging(v: np.ndarray, child: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(a, b): a forest's links by their vertices, where all of a tree hang on its smallest one, so that those of several blocks or sections repeat each other."""
    roots, tree = np.unique(root, return_inverse=True)
    least = v[roots]
    np.minimum.at(least, tree, v[child])
    a, b = np.concatenate([v[child], v[roots]]), np.concatenate([least[tree], least])
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def _meetings(v: Column, sections: Column) -> Column:
    """The pairs of sections, (low, high), in which a vertex is searched: its own with each other, or with itself if there is one only."""
    own = F.pmod(F.xxhash64(v), sections)
    elsewhere = F.filter(F.sequence(F.lit(0).cast("long"), sections - 1), lambda t: (t != own) | (sections == 1))
    return F.transform(elsewhere, lambda t: F.struct(F.least(own, t).alias("low"), F.greatest(own, t).alias("high")))


def _by_key(parts: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.Array]]:
    """Columns of about ROWS rows, or of BYTES; names hold ``key``, which batches are ordered by, and a key's rows stay together."""
    held: list[list[pa.Array]] = []
    rows = size = 0
    at = names.index("key")

    def whole() -> list[pa.Array]:
        return [pa.concat_arrays(c) for c in zip(*held, strict=True)]

    for part in parts:
        if not part.num_rows:
            continue
        held.append([part.column(n) for n in names])
        rows, size = rows + part.num_rows, size + part.get_total_buffer_size()
        if rows < ROWS and size < BYTES:
            continue
        # The last key may go on in the next batch.
        last = held[-1][at][-1].as_py()
        if held[0][at][0].as_py() == last:
            continue
        columns = whole()
        cut = int(np.searchsorted(np.asarray(columns[at]), last))
        yield [c.slice(0, cut) for c in columns]
        held = [[c.take(pa.array(np.arange(cut, len(c)))) for c in columns]]
        rows, size = len(held[0][0]), sum(c.nbytes for c in held[0])
    if held:
        yield whole()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id of its component)."""
    rows = fingerprints(docs, words, 1, id_col, text_col).withColumnRenamed("f0", "p")
    distinct = checkpointed(rows.groupBy("p").agg(F.min("id").alias("least")).withColumn("slot", slot()))
    roots = stars(links(distinct.select(F.col("p").alias("v"), "p"), ["p"], radius)).toDF("p", "root")
    known = distinct.join(roots, "p", "left").withColumn("root", F.coalesce("root", "p"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = lookup(known.select("slot", "p", "root"), least, ["root"]).select("p", "component_id")
    return lookup(rows, found, ["p"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, count: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id and text: id, text_md5 (null as the empty text), keep_id (smallest id of its group), kept.

    One row of each group is kept: of those with the smallest id the one with the smallest digest; null ids come last.
    Rows of different texts are judged apart even where they share an id. Groups are connected by pairs of texts whose sets of shingles
    have a Jaccard similarity of at least ``similarity``.

    Candidates agree on one of 4 * ``count`` blocks of 16 bits and differ in at most as many bits of the first four
    fingerprints as such a pair does, and 3.2 standard deviations more; the angle of two sets that are as similar gives the
    share of bits. A pair at 0.8 shares none of 64 blocks in under one case of a hundred. Candidates connect texts into candidate groups, and
    within a group every pair that isn't connected by links yet and differs in few enough of all bits is checked on the sets themselves.
    A large group is cut into sections, and every two sections meet in one task.
    """
    names = [f"f{k}" for k in range(count)]
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = lambda bits: int(bits * share + 3.2 * np.sqrt(bits * share * (1 - share)))
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("t", F.md5("text"))
    rows = sets(docs, words, count)
    firsts = [F.first(n).alias(n) for n in names]
    vertices = rows.groupBy("d0", "d1").agg(F.min(_place("id", "t")).alias("least"), F.min("t").alias("t"), *firsts)
    vertices = checkpointed(vertices.withColumn("v", F.monotonically_increasing_id()).withColumn("slot", slot()))
    # A pair that shares a block differs in the other 48 bits only.
    candidates = stars(links(vertices.select("v", *names), names, most(48), most(256), names[:4]))
    grouped = candidates.select(F.col("hi").alias("v"), F.col("lo").alias("root")).union(candidates.select("lo", "lo").distinct())
    roots = stars(_verified(docs, vertices.join(grouped, "v").select("v", "t", "root", *names), names, words, similarity, most(64), most(64 * count)))
    settled = vertices.join(roots.select(F.col("hi").alias("v"), F.col("lo").alias("root")), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = settled.groupBy("root").agg(F.min("least").alias("best"))
    found = lookup(settled.select("slot", "d0", "d1", "root"), least, ["root"]).select("d0", "d1", "best")
    kept = F.col("best").eqNullSafe(_place("id", "t"))
    return lookup(rows, found, ["d0", "d1"]).select(F.col("id").alias(id_col), F.col("t").alias("text_md5"), F.col("best.id").alias("keep_id"), kept.alias("kept")).distinct()


def _place(id_: str, digest: str) -> Column:
    """The order in which a group's rows are kept."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(digest).alias("t"))


def _verified(docs: DataFrame, grouped: DataFrame, names: list[str], words: int, similarity: float, radius: int, wide_radius: int) -> DataFrame:
    """(a, b) links that connect all vertices of a candidate group, (v, t, root, names), whose sets of shingles are similar."""
    n = shuffle_partitions(docs.sparkSession)
    texts = docs.select("t", "text").join(grouped.select("v", "t"), "t")
    known = shingle_sets(texts, words).dropDuplicates(["v"])
    members = checkpointed(grouped.join(known, "v").withColumn("slot", slot()))
    size = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("s").cast("long")).alias("hashes"))
    sections = size.select("root", F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("hashes") / HASHES)).alias("sections"))
    dealt = lookup(members, sections, ["root"]).select("v", "s", *names, "root", F.explode(_meetings(F.col("v"), F.col("sections"))).alias("m"))
    # Two groups of one key would only be searched together.
    dealt = dealt.select("v", "s", *names, F.xxhash64("root", "m.low", "m.high").alias("key"))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, key, s, *prints in _by_key(parts, ["v", "key", "s", *names]):
            ends = np.asarray(s.offsets).tolist()
            flat = s.values.to_numpy(zero_copy_only=False)

            def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                good = np.zeros(len(a), bool)
                for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    x, y = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]  # noqa: B023
                    if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                        both = np.sort(np.concatenate([x, y]))
                        shared = int((both[1:] == both[:-1]).sum())
                        good[k] = shared >= similarity * (len(both) - shared) - 1e-9
                return good

            bits = np.stack([np.asarray(c) for c in prints], 1).view(np.uint64)
            # A group of one section is a star already, and takes no round.
            yield _hanging(np.asarray(v), *forest(bits[:, 0].copy(), np.asarray(key), radius, bits, wide_radius, similar))

    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")
