"""The training-data operators against brute force, and their defined results for odd inputs."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import ann, components, exact_dedup, html_text, mixing, packing, quality, repair, simhash, token_binary, token_counts, tokenizer, warc
from frameloom.llm.tokenizer import encoder, public_spec

DATA = "/root/testdata/sf0.001"
#: Columns that operators use inside, to clash with.
EXTRA = "slot string, digest string, p string, key string, v string, copies string, score string, row string, size string, pattern string, u string, b string"


def frame(spark, columns, rows):
    """rows with extra columns whose names clash with inner ones."""
    n = len(EXTRA.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], f"{columns}, {EXTRA}")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [
        (1, "same text here now", "a"), (2, "same text here now", "b"), (2, "same text here now", "b"), (3, None, None), (4, "", "a"),
        (5, " \t\n ", "c"), (6, "word " * 30000, "a"), (None, "null id", "b"), (None, "null id", "b"), (7, "One\ttwo  three", None), (8, "é ü <|endoftext|> x", "c"),
    ]
    return frame(spark, "doc_id long, text string, source string", rows)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def text(r):
    return r["text"] or ""


# Exact dedup.


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, odd, empty, keep):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[text(r)].append(r["doc_id"])
    want = Counter()
    for r in rows:
        ids = [i for i in groups[text(r)] if i is not None]
        stays = (max if keep == "max" else min)(ids) if ids else None
        want[r["doc_id"], stays, len(groups[text(r)]), r["doc_id"] == stays, hashlib.sha256(text(r).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd, keep=keep).collect())) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


# SimHash.


def fingerprint(t, words=3):
    w = t.encode().lower().split()
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, odd, empty):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(6):
            rows.append(" ".join(base))
            base[rng.randrange(400)] = rng.choice(vocabulary)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(odd.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = simhash.simhash_components(docs).collect()
    texts = docs.collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter((r["doc_id"], fingerprint(text(r))) for r in texts)
    prints = sorted({int(r["fingerprint"], 16) for r in got})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for r in got:
        k = find(int(r["fingerprint"], 16))
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(find(int(r["fingerprint"], 16))) for r in got)
    assert len({r["component_id"] for r in got}) < len(prints)  # some were linked
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("count", [1, 3])
def test_majority_counts_every_bit(monkeypatch, count):
    monkeypatch.setattr(simhash, "COUNTED", 64)
    rng = np.random.default_rng(count)
    hashes = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (0, 1, 2, 3, 5, 31, 64, 65, 1000, 4)]
    got = simhash.majority(hashes, count)
    for i, h in enumerate(hashes):
        for k in range(count):
            f = simhash.family(h, k).tolist()
            assert int(got[i, k]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in f) > len(f))


def test_stars_find_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(3050, 3000 + i) for i in range(50)]
    root = {v: v for link in links for v in link}
    for a, b in links:
        a, b = root[a], root[b]
        root = {v: min(a, b) if r in (a, b) else r for v, r in root.items()}
    got = components.stars(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["hi"]: r["lo"] for r in got} == {v: r for v, r in root.items() if v != r} and len(got) == len({r["hi"] for r in got})


def test_forest_asks_until_all_links_are_found():
    """Random pairs are links after all; what they connect is connected, and nothing else."""
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 1 << 10, (300, 2), dtype=np.uint64)
    keys = rng.integers(0, 4, 300)
    linked = np.triu(rng.random((300, 300)) < 0.004, 1)
    linked &= (np.bitwise_count(wide[:, None] ^ wide[None, :]).sum(2) <= 12) & (keys[:, None] == keys[None, :])
    asked = set()

    def check(a, b):
        a, b = np.minimum(a, b), np.maximum(a, b)
        new = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(new) == len(a) and not new & asked
        asked.update(new)
        return linked[a, b]

    a, b = simhash.forest(wide[:, 0].copy(), keys, 64, wide, 12, check)

    def labels(pairs):
        root = list(range(300))
        for i, j in pairs:
            x, y = root[i], root[j]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert labels(zip(a.tolist(), b.tolist(), strict=True)) == labels(np.argwhere(linked).tolist()) and 0 < len(a) < 300


def test_a_candidate_group_takes_no_round(spark, monkeypatch):
    """Texts that are chained by their similarity: what one task has linked hangs on one vertex, so only candidates are searched in rounds."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 200])) for k in range(20)]
    made = []
    monkeypatch.setattr(simhash, "stars", lambda links: made.append(links.distinct().collect()) or components.stars(links))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    candidates, linked = made
    assert set(got.values()) == {0} and len({r["b"] for r in linked}) == 1 and len(linked) == 19


@pytest.mark.parametrize("bits,n", [(64, 300), (12, 900)])
def test_forest_is_complete(bits, n):
    rng = np.random.default_rng(bits)
    prints = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    for _ in range(3):
        prints = np.concatenate([prints, prints ^ (np.uint64(1) << rng.integers(0, 64, len(prints), dtype=np.uint64))])[: 2 * n]
    keys = rng.integers(0, 3, len(prints))
    a, b = simhash.forest(prints, keys)
    assert len(a) < len(prints) and (keys[a] == keys[b]).all()
    near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3) & (keys[:, None] == keys[None, :])
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(1)
        if (new == label).all():
            break
        label = new
    mine = np.arange(len(prints))
    for _ in range(len(prints)):
        before = mine.copy()
        np.minimum.at(mine, a, mine[b])
        np.minimum.at(mine, b, mine[a])
        if (mine == before).all():
            break
    assert (mine == label).all()


def test_near_duplicates_keep_clean_documents(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        if g % 2:
            base[rng.randrange(300)] = "changed"
            rows.append((2 * g + 1, " ".join(base)))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def five_words(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates_hold_the_similarity(spark):
    """Appended, replaced and scattered edits at a five-word Jaccard of 0.8 to 0.85 are grouped, those just below are not."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, near, far = [], [], []
    for kind in ("append", "replace", "scatter"):
        for g in range(80):
            base = [word() for _ in range(404)]
            low = g % 4 == 3
            copy = list(base)
            if kind == "append":
                copy += [word() for _ in range(108 if low else rng.randrange(75, 99))]
            elif kind == "replace":
                k = 48 if low else rng.randrange(33, 41)
                copy[100 : 100 + k] = [word() for _ in range(k)]
            else:
                for i in range(10 if low else 8):
                    copy[20 + 35 * i] = word()
            a, b = five_words(" ".join(base)), five_words(" ".join(copy))
            similar = len(a & b) / len(a | b)
            assert 0.7 < similar < 0.8 if low else 0.8 <= similar <= 0.86
            (far if low else near).append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i, _ in rows[::2])
    assert not any(got[i + 1] == i for i in far)
    assert sum(got[i + 1] == i for i in near) >= 0.97 * len(near)


def test_keys_stay_together_in_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "ROWS", 10)
    rng = random.Random(2)
    keys = sorted(rng.randrange(12) for _ in range(200))
    table = pa.table({"v": range(200), "s": [[k] * (k % 3) for k in keys], "key": keys})
    got = [(k.to_pylist(), v.to_pylist(), s.to_pylist()) for k, v, s in simhash._by_key(iter(table.to_batches(max_chunksize=7)), ["key", "v", "s"])]
    assert [k for part, _, _ in got for k in part] == keys and [v for _, part, _ in got for v in part] == list(range(200))
    assert [s for _, _, part in got for s in part] == table["s"].to_pylist()
    assert sum(len(set(part)) for part, _, _ in got) == len(set(keys)) and len(got) > 4


@pytest.mark.parametrize("section,rows", [(4096, 1 << 16), (7, 20)])
def test_near_pairs_that_a_forest_hides(spark, monkeypatch, section, rows):
    """Of a chain only neighbours are similar enough; candidates that are not must not keep the links from it."""
    monkeypatch.setattr(simhash, "TEXTS", section)
    monkeypatch.setattr(simhash, "ROWS", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10" if rows == 20 else "10000")
    rng = random.Random(9)
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 304])) for i in range(30)] + [(100 + i, " ".join(rng.sample(words, 300))) for i in range(30)]
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 30 else i for i, _ in rows}


# Quality.


@pytest.mark.parametrize("radius,wide", [(3, None), (12, 20)])
def test_crowded_blocks_lose_no_link(spark, monkeypatch, radius, wide):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, (60, 2), dtype=np.int64)
    base[:, 0] &= ~np.int64(0xFFFF)  # all share a block of the first fingerprint
    noise = [sum(1 << int(b) for b in rng.choice(60, 5, replace=False)) & ~0xFFFF for _ in range(60)]
    rows = [(2 * i + k, int(a) ^ (n if k else 0), int(b) ^ (1 << 7 if k else 0)) for i, ((a, b), n) in enumerate(zip(base, noise, strict=True)) for k in (0, 1)]
    vertices = spark.createDataFrame(rows, "v long, f0 long, f1 long")

    def groups():
        root = {v: v for v, _, _ in rows}
        for r in simhash.links(vertices, ["f0", "f1"], radius, wide).collect():
            a, b = root[r["a"]], root[r["b"]]
            root = {v: min(a, b) if x in (a, b) else x for v, x in root.items()}
        return root

    whole = groups()
    assert all(whole[2 * i] == whole[2 * i + 1] for i in range(60))
    monkeypatch.setattr(simhash, "CROWDED", 8)
    monkeypatch.setattr(simhash, "SECTION", 16)
    assert groups() == whole


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{DATA[:-5]}0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (7, None), (None, 1), (99, 1), (4, 5)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}


def test_quality_gradient():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 126, n, dtype=np.uint8)) for n in (3, 200, 700, 128)]
    data, starts = quality.pack(texts)
    repeats = quality.repetition(data, starts)
    w = {
        "embed": rng.normal(0, 1, (256, quality.EMBED)), "first": rng.normal(0, 0.3, (16, 16)), "second": rng.normal(0, 0.3, (16, 16)), "bias": rng.normal(0, 0.1, 16),
        "hidden": rng.normal(0, 0.5, (17, 16)), "hidden_bias": rng.normal(0, 0.1, 16), "out": rng.normal(0, 0.5, 16), "out_bias": np.zeros(()),
    }
    y = np.array([0, 1, 1, 0])

    def loss():
        p = quality._probability(w, np.maximum.reduceat(quality._forward(w, data, starts, repeats)["h"], starts[:-1]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradient(w, data, starts, quality._forward(w, data, starts, repeats), y)
    for name in ("first", "second", "bias", "hidden", "out", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        e = 1e-5
        w[name][at] += e
        up = loss()
        w[name][at] -= 2 * e
        down = loss()
        w[name][at] += e
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def naive_score(w, text):
    """The network on one text, chunk by chunk."""
    cells = max(1, -(-len(text) // quality.CELL))
    data = np.frombuffer(text + bytes(cells * quality.CELL - len(text)), np.uint8)
    steps = w["embed"][data].astype(float).reshape(-1, quality.STEP * quality.EMBED)
    units = []
    for c in range(cells):
        at = [i for i in range(32 * c, min(len(steps), 32 * c + 64)) if data[4 * i]]
        a = [np.maximum(steps[i] @ w["first"] + w["bias"] + (steps[i + 1] @ w["second"] if i + 1 < len(steps) else 0), 0) for i in at]
        chars = [i for i in range(128 * c, min(len(data), 128 * c + 256)) if data[i]]
        repeats = max(sum(i >= lag and data[i] == data[i - lag] for i in chars) for lag in quality.LAGS) * 4 / max(len(chars), 64)
        v = np.append(np.sum(a, 0) / len(a) if a else np.zeros(quality.FILTERS), repeats)
        units.append(np.maximum(v @ w["hidden"] + w["hidden_bias"], 0))
    return 1 / (1 + np.exp(-(np.max(units, 0) @ w["out"] + w["out_bias"])))


def test_quality_scores_depend_on_the_text_alone(monkeypatch):
    rng = np.random.default_rng(6)
    words = [b"a", b"the ", b"zq", b"\n", b"0.5 ", "é".encode(), b"word of more "]
    texts = [b"", b"x", bytes(rng.integers(97, 123, 256, dtype=np.uint8)), *(b"".join(words[i] for i in rng.integers(0, len(words), n)) for n in (5, 40, 128, 700, 3000))]
    net = quality.fit(texts, [0, 1, 1, 0, 1, 0, 1, 0], epochs=3)
    alone = np.array([quality.scores(net, [t])[0] for t in texts])
    assert np.allclose(alone, [naive_score(net.weights, t) for t in texts], atol=1e-5)
    for _ in range(5):
        order = rng.permutation(len(texts))
        assert np.array_equal(quality.scores(net, [texts[i] for i in order]), alone[order])
    for block in (256, 384, 1024, 5120):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.array_equal(quality.scores(net, texts), alone)
    import pyarrow as pa

    column = pa.array([None, *["ä" * 300, "", "b"]]).slice(1)
    assert [b.tobytes() for b in quality._buffers(column)] == [("ä" * 300).encode(), b"", b"b"]


# Tokenizers, counts, packing and files.


@cache
def library(name):
    path = public_spec(name).path
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda t: model.encode(t, add_special_tokens=False).ids


def library_ids(name, t):
    return library(name)(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_give_the_library_ids(name):
    import pyarrow as pa

    rng = random.Random(3)
    letters = [*"abcXYZ", "é", "ß", "\n", "'", "'s", "***", "%", "1", ".", ",", "!!", "-", "\t", "ﬁ", "日", "İ", "▁", "<|endoftext|>", "\x00", *" " * 8]
    texts = ["", " ", "a", " a", "a ", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(400))]
    ids, before = encoder(public_spec(name)).ids(pa.array(texts), 1)
    counts = encoder(public_spec(name)).counts(pa.array(texts))
    for t, a, b, n in zip(texts, before, before[1:], counts, strict=False):
        assert ids[a:b].tolist() == [*library_ids(name, t), 1] and n == b - a - 1


def test_token_counts(spark, odd, empty, tmp_path):
    spec = public_spec("piece_bpe_32k.model")
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds everything in the cache
        got = token_counts.count_tokens(odd, spec, cache, limit=3).collect()
        want = Counter((r["doc_id"], len(text(r).encode()), n := len(library_ids("piece_bpe_32k.model", text(r))), n > 3) for r in odd.collect())
        assert Counter(map(tuple, got)) == want
        assert spark.read.parquet(cache).count() == len({text(r) for r in odd.collect()})
    assert token_counts.count_tokens(empty, spec).count() == 0


def test_packing(spark, odd, empty):
    docs = odd.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    got = packing.pack(docs, public_spec("byte_bpe_50k.json")).collect()
    by_row, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r["row"]].append(r)
        by_window[r["sequence_id"]].append(r)
    found = Counter()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
        found[pieces[0]["doc_id"], tuple((p["start"], p["length"], p["ids_crc32"]) for p in pieces)] += 1
    for r in docs.collect():
        ids = np.array([*library_ids("byte_bpe_50k.json", text(r)), 1], "<u4")
        assert any(k[0] == r["doc_id"] and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in k[1]) and k[1][-1][0] + k[1][-1][1] == len(ids) for k in found)
    assert sum(found.values()) == docs.count()
    padding = 0
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        n = sum(p["length"] for p in pieces)
        assert n <= pieces[0]["tier"] <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    assert packing.pack(empty, public_spec("byte_bpe_50k.json")).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 4000):
        ids = rng.choice([3, 4, 5, 5, 5, 1], n).astype(np.uint32)
        ends = np.flatnonzero(ids == 1) + 1
        ends = ends if n and len(ends) and ends[-1] == n else np.append(ends, n)
        symbols, at, rules, lengths = repair.compress(ids, ends, 10)
        assert np.array_equal(repair.expand(symbols, rules, lengths, 10), ids)
        for a, b, x, y in zip([0, *at], at, [0, *ends], ends, strict=False):
            assert np.array_equal(repair.expand(symbols[a:b], rules, lengths, 10), ids[x:y])
        assert len(rules) == 0 or lengths.tolist() == [len(repair.expand(np.array([10 + k], np.uint32), rules, lengths, 10)) for k in range(len(rules))]
        for a, b in zip([0, *at], at, strict=False):  # nothing that pays is left
            few = Counter(zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist(), strict=False))
            assert max(few.values(), default=0) < 2 * repair.LEAST
    assert len(symbols) < n / 2 and len(rules)
    # A run, and copies of one document.
    run = np.full(30_000, 7, np.uint32)
    symbols, _, rules, _ = repair.compress(run, np.array([30_000]), 10)
    assert len(symbols) < 3 * repair.LEAST
    one = rng.integers(0, 10, 500).astype(np.uint32)
    symbols, at, rules, lengths = repair.compress(np.tile(one, 40), np.arange(500, 20_001, 500), 10)
    assert len(symbols) == 40 and np.array_equal(repair.expand(symbols[:1], rules, lengths, 10), one)


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 24])
def test_planes(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    content = b"123" + token_binary.to_planes(x, width)
    assert len(content) == 3 + token_binary.planes_size(1001, width)
    for a, b in ((0, 1001), (0, 0), (5, 6), (7, 900), (1000, 1001), (1001, 1001)):
        assert np.array_equal(token_binary.from_planes(lambda at, n: content[at : at + n], 3, 1001, width, a, b), x[a:b])


def test_token_binary(spark, odd, empty, tmp_path):
    spec = public_spec("word_bpe_49k.json")
    got = token_binary.token_binary(odd, spec, f"file://{tmp_path}/ids").collect()
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, text(r)) for r in odd.collect())
    start, want = 0, Counter()
    for known, i, t in rows:
        ids = np.array([*library_ids("word_bpe_49k.json", t), 1], "<u4")
        want[i if known else None, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, got)) == want
    files = sorted((tmp_path / "ids").glob("*.ids"))
    whole = token_binary.load(files[0].read_bytes())
    assert np.array_equal(np.concatenate([whole.ids(k, k + 1) for k in range(len(whole.doc_ids))]), whole.ids())
    few = token_binary.open_shard(f"file://{files[0]}")
    for k in range(len(whole.doc_ids)):
        ids = whole.ids(k, k + 1)
        assert np.array_equal(few.ids(k, k + 1), ids)
        for start, n in ((0, 1), (0, len(ids)), (len(ids) // 2, 3), (len(ids) - 1, 5)):
            assert np.array_equal(few.part_of(k, start, n), ids[start : start + n])
    with pytest.raises(ValueError, match="damaged"):
        token_binary.load(files[0].read_bytes()[:-5] + b"12345")
    assert token_binary.token_binary(empty, spec).count() == 0


# WARC.


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/\n", None), (4, "b", ""), (5, "c", "long " * 5000), (None, "d", "solo"), (None, "e", "<p>one</p>"), (6, "f", "é"), (6, "f", "é")]
    pages = frame(spark, "page_id long, url string, html string", rows)
    got = warc.archive(pages, f"file://{tmp_path}/w").collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        b = best.get(h or "")
        again = b is not None and b != i
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", b if again else None] += 1
    assert Counter(map(tuple, got)) == want
    content = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    assert content[:4] == bytes.fromhex("5d2a4d18")
    assert {r["record_type"] for r in warc.archive(pages, f"file://{tmp_path}/v", min_revisit_bytes=10**6).collect()} == {"response"}
    assert warc.archive(pages.where("false")).count() == 0


def test_warc_string_ids_and_sample_bytes(spark, tmp_path, monkeypatch):
    """Line feeds, colons, empty and null ids come back as they were; a page beyond the sample's bytes isn't fetched for it."""
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 100)
    ids = ["a\nb", "", None, "x: y", "%41", "é ", "a\r\n\r\nWARC/1.1"]
    rows = [(i, "u", f"page {k}") for k, i in enumerate(ids)] + [("big", "u", "z" * 5000), ("copy", "u", "page 0")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(pages, f"file://{tmp_path}/w").collect()), key=str)
    want = [(i, "response", None) for i in ids if i != "a\nb"] + [("big", "response", None), ("copy", "response", None), ("a\nb", "revisit", "copy")]
    assert got == sorted(want, key=str)


def test_warc_dictionary_helps():
    pages = [f"<html><head><title>{i}</title></head><body><p>common words of all pages {i * 7919}</p></body></html>".encode() * 3 for i in range(150)]
    made = [warc.record(i, "http://a/", p, warc._sha1(p), None, False, "1970-01-01T00:00:00Z") for i, p in enumerate(pages)]
    with_one, without = warc.ArchiveWriter(warc.build_dictionary(made)), warc.ArchiveWriter(b"")
    for m in made:
        with_one.add(m)
        without.add(m)
    assert sum(map(len, with_one.parts[2:])) < sum(map(len, without.parts[2:])) / 2
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.records(with_one.content())] == pages


# Mixing.


def test_capped_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.capped_targets([10, 300, 290], [1, 1, 1])
    assert got[0] == 30 and abs(sum(got) - 600) < 1e-9 and got[1] == got[2] == 285
    assert mixing.capped_targets([], []) == [] and mixing.capped_targets([0, 0], [1, 2]) == [0, 0]


def test_route_overlapping_sources():
    # Pattern 0 belongs to both sources; using it for source 1 avoids all repetition.
    flow = mixing.route([((0, 1), 100), ((0,), 100), ((1,), 20)], [100, 120])
    assert flow == {(0, 1): 100, (1, 0): 100, (2, 1): 20}
    assert sum(mixing.route([((0,), 10)], [100], 3).values()) == 30


def test_mix(spark, odd, empty):
    rng = random.Random(0)
    rows = [(i, "w " * rng.choice([1, 5, 50, 400]), rng.choice(["a", "b", "c", None])) for i in range(3000)]
    docs = frame(spark, "doc_id long, text string, source string", rows)
    plan = lambda names, sizes: mixing.capped_targets(sizes, mixing.cycle_weights(len(names)))
    run = lambda d: mixing.mix(d, mixing.word_count("text"), F.col("source"), plan, seed=7)
    got = run(docs).collect()
    assert len(got) == 3000
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = r["members"][0]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
    want = dict(zip(["a", "b", "c", None], mixing.capped_targets([size[s] for s in ("a", "b", "c", None)], [1, 2, 3, 1]), strict=True))
    assert target == want and all(r["source_size"] == size[r["members"][0]] for r in got)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert Counter((r["doc_id"], r["taken"]) for r in run(docs.repartition(7)).collect()) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert run(odd).count() == odd.count() and run(empty).count() == 0


def least_cost(patterns, quotas, repeat):
    """Most words that fill the quotas, and their least cost, by trying every split of small patterns."""
    import itertools

    best = None
    splits = [[x for x in itertools.product(range(repeat * w + 1), repeat=len(m)) if sum(x) <= repeat * w] for m, w in patterns]
    for split in itertools.product(*splits):
        got = [0] * len(quotas)
        for (m, _), x in zip(patterns, split, strict=True):
            for s, n in zip(m, x, strict=True):
                got[s] += n
        if all(g <= q for g, q in zip(got, quotas, strict=True)):
            cost = sum(k * min(w, max(0, sum(x) - k * w)) for (_, w), x in zip(patterns, split, strict=True) for k in range(repeat))
            best = min(best or (0, 0), (-sum(got), cost))
    return best


def test_mix_of_overlapping_sources(spark):
    """One-word documents, so what the mix takes is the flow itself: as much as can be, at the least cost of repetition."""
    rng = random.Random(12)
    for k in range(4):
        groups = [(["a"], rng.randrange(1, 5)), (["a", "b"], rng.randrange(1, 4)), (["b"], rng.randrange(1, 4))]
        quotas = [rng.randrange(3, 10), rng.randrange(3, 10)]
        rows = [(i, "w", m) for i, m in enumerate(m for m, n in groups for _ in range(n))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
        got = mixing.mix(docs, mixing.word_count("text"), F.col("sources"), lambda names, sizes: quotas, max_repeat=3, seed=k).collect()  # noqa: B023
        want = least_cost([([ord(s) - 97 for s in m], n) for m, n in groups], quotas, 3)
        assert (-sum(r["taken"] for r in got), sum(c * (c - 1) // 2 for c in (r["copies"] for r in got))) == want


def test_mix_comes_near_whatever_the_sizes(spark):
    """A few long documents, ids that repeat or are null, and sizes without small change."""
    rng = random.Random(13)
    rows = [(None if i % 3 else i % 50, "w " * rng.choice([7, 90, 3000]), "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = lambda names, sizes: mixing.capped_targets(sizes, mixing.cycle_weights(len(names)))
    run = lambda d: mixing.mix(d, mixing.word_count("text"), F.col("source"), plan, seed=3).collect()
    got = run(docs)
    taken, target = Counter(), {}
    for r in got:
        taken[r["members"][0]] += r["taken"]
        target[r["members"][0]] = r["target"]
    # Of ids that are null all rows of a size stand together, so a source may lack up to half a long document.
    assert all(abs(taken[s] - target[s]) <= 1500 for s in target)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in run(docs.repartition(5, "text"))) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


# Pages.


def zoned(html):
    lines, zones = html_text.page_lines(html)
    return [[x for x, z in zip(lines, zones, strict=True) if z == zone] for zone in (html_text.DECLARED, html_text.OPEN)]


def test_page_zones():
    declared, rest = zoned(
        '<html><head><title>t</title></head><body><header>site</header><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p><b>one<br>two</b>  three'
        '<div class="ad">buy</div><p>more <span class="ad">x</span>text<div id="comments"><p>reader</div><form>f</form><script>var a="</p>";</script></article><div class="cookie-notice">n</div><footer>f</footer></body></html>'
    )
    assert declared == ["A & B", "one two three", "more", "text"] or declared == ["A & B", "one two three", "more text"]
    assert rest == []
    assert zoned("") == [[], []] and zoned("<p>a<!-- b") == [[], ["a"]]
    assert zoned("<p>1 &lt; 2&nbsp;&quot;x") == [[], ['1 < 2 "x']]


def test_class_words_are_whole_names():
    main = zoned('<main><p class="social-science">a</p><div id="related-work">b</div><div class="x related-posts">no</div><div id="siteFooter">no</div><p class="no-ads">c</p></main>')
    assert main == [["a", "b", "c"], []]
    assert zoned('<div class="has-sidebar"><article>body</article></div>')[0] == ["body"]
    assert zoned('<form><label>q</label><article>body</article></form>')[0] == ["body"]
    assert zoned('<div class="sidebar"><main>body</main></div>')[0] == ["body"]
    assert zoned('<aside><article>teaser</article></aside><p>body</p>') == [[], ["body"]]
    text = lambda html: html_text.main_text(*html_text.page_lines(html))
    assert text('<h1>Title</h1><p>the body of the page</p><article class="comment">a reader says</article>') == "Title\nthe body of the page"
    assert text('<h1>Title</h1><p>the body of the page</p><article>teaser</article>') == "Title\nthe body of the page\nteaser"
    assert text('<p>open</p><article>longer declared text</article>') == "open\nlonger declared text"


def test_texts_written_by_hand(spark):
    """Expected texts come from reading the pages, not from the parser."""
    long = "An article of two hundred characters or more, told at length. " * 4
    pages = {
        f"<div><h1>Title of the story</h1><p>Lead paragraph.</p><article><p>{long}</p></article><p>Second part.</p></div>": f"Title of the story\nLead paragraph.\n{long.strip()}\nSecond part.",
        '<main><h2 id="comments">Comments on the law</h2><p class="social">Social rules</p><p class="comment">A remark</p><div class="comments"><p>reader</p></div><ul class="share"><li>post</li></ul></main>': "Comments on the law\nSocial rules\nA remark",
        '<body><nav><a>Home</a></nav><article><header><h1>News</h1><p>by A</p></header><p>Body &amp; soul<br>here</p><aside>More</aside></article><div class="cookie-banner">OK?</div><footer>(c)</footer>': "News\nBody & soul here",
        '<p class="comment">a reader</p><p>Open text</p>': "Open text",
        "<table><tr><td>one<td>two<tr><td>three</table><pre>a\n  b</pre>": "one\ntwo\nthree\na b",
        "<script>var x = '<p>no</p>'</script><style>p {}</style><p>yes</p><!-- <p>no</p> -->": "yes",
    }
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values())


def test_shared_lines_is_longest():
    rng = random.Random(2)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        i, j = html_text.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(i) == len(j) == longest(a, b) and [a[x] for x in i] == [b[y] for y in j] and sorted(set(i)) == i and sorted(set(j)) == j
    a, b = ([rng.randrange(2) for _ in range(1600)] for _ in range(2))  # takes the halving path
    i, j = html_text.shared_lines(np.array(a), np.array(b))
    assert len(i) == longest(a, b) and sorted(set(i)) == i and sorted(set(j)) == j


def test_differencing(spark):
    page = lambda lines: "<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"
    rows = [
        (1, "http://h/a/1", page(["menu", "first article", "end"])), (2, "http://h/a/2", page(["menu", "second article", "end"])), (3, "http://h/a/3", page(["menu", "third", "end"])),
        (4, "http://alone/x", page(["menu", "kept whole"])), (5, "http://copy/1", page(["same"])), (6, "http://copy/2", page(["same"])), (7, None, None), (8, "http://h8/b", "<article>declared<nav>no</nav></article>"),
        (None, "::", page(["null id"])), (5, "http://copy/1", page(["same"])), (9, "http://z/1", "<p>shared menu</p><article>shared passage<p>one</article>"), (10, "http://z/2", "<p>shared menu</p><article>shared passage<p>two</article>"),
    ]
    pages = frame(spark, "page_id long, url string, html string", rows)
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    texts = {1: "first article", 2: "second article", 3: "third", 4: "menu\nkept whole", 5: "same", 6: "same", 7: "", 8: "declared", None: "null id", 9: "shared passage\none", 10: "shared passage\ntwo"}
    assert got == Counter((i, u, texts[i], len(texts[i])) for i, u, _ in rows)
    assert html_text.extract(pages.where("false")).count() == 0


def brute_force_texts(rows):
    """Whole pages, without Spark: hosts in turn, pages in order of path, pairs by place, textbook alignment."""
    from urllib.parse import urlsplit

    hosts = defaultdict(list)
    for i, u, h in sorted(set(rows)):
        hosts[urlsplit(u).netloc.lower()].append((urlsplit(u).path, i, u, h))
    out = {}
    for pages in hosts.values():
        pages.sort()
        groups = [pages[k : k + 2] for k in range(0, len(pages), 2)]
        if len(groups) > 1 and len(groups[-1]) == 1:
            last = groups.pop()
            groups[-1] += last
        for group in groups:
            parsed = [html_text.page_lines(h) for *_, h in group]
            gone = [set() for _ in group]
            for k in range(len(group) - 1):
                a, b = parsed[k][0], parsed[k + 1][0]
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for x in range(len(a) - 1, -1, -1):
                    for y in range(len(b) - 1, -1, -1):
                        best[x][y] = best[x + 1][y + 1] + 1 if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
                x = y = 0
                while x < len(a) and y < len(b):
                    if a[x] == b[y]:
                        gone[k].add(x)
                        gone[k + 1].add(y)
                        x, y = x + 1, y + 1
                    elif best[x + 1][y] >= best[x][y + 1]:
                        x += 1
                    else:
                        y += 1
            for (_, i, u, _), (lines, zones), less in zip(group, parsed, gone, strict=True):
                open_ = {k for k, z in enumerate(zones) if z == html_text.OPEN}
                if open_ <= less and html_text.DECLARED not in zones:
                    less = set()
                out[i, u] = "\n".join(x for k, (x, z) in enumerate(zip(lines, zones, strict=True)) if z == html_text.DECLARED or (k in open_ and k not in less))
    return out


def test_extract_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        host, site = rng.choice([("a.com", 1), ("B.com", 2), ("c.org", 3)])
        body = "".join(f"<p>{i} says {rng.random()}</p>" for _ in range(rng.randrange(4)))
        menu = f"<p>home of {site}</p><ul><li>one<li>two {site}</ul>"
        wrap = rng.choice(["<div>{}</div>", "<article>{}</article>", "<div class='ad'>x</div><section>{}</section>"])
        rows.append((i, f"http://{host}/{rng.randrange(40)}/x", menu + wrap.format(body + "<p>shared passage</p>") + f"<footer>f{i}</footer><p>end of {site}</p>"))
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_force_texts(rows)
    supplied = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    assert got == brute_force_texts(supplied)


# Nearest neighbours.


@pytest.mark.parametrize("rows", [ann.SHARD_ROWS, 300])
def test_nearest(spark, monkeypatch, rows):
    """In one shard, and in as many as there are shuffle partitions."""
    monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, 1, 16).astype(np.float32).tolist() for i in range(1500)}
    for i in range(40, 60):
        vectors[i] = vectors[40]  # copies
    rows = list(vectors.items()) + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2050, [1.0, 2.0]), (2051, [2.0, 1.0]), (None, [1.0] * 16), (50, vectors[50])]
    df = frame(spark, "vec_id long, embedding array<float>", rows)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([vectors[i] for i in range(1500)], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        cosine = (v @ v[q]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        cosine[q] = -9
        best = set(np.lexsort((np.arange(1500), -np.round(unit @ unit[q], 12) + 99 * (np.arange(1500) == q)))[:5].tolist())
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(cosine[i] - s) < 1e-12 for _, i, s in got[q])
        hits += len(best & {i for _, i, _ in got[q]})
    assert hits / 150 >= 0.9
    assert [i for _, i, _ in got[50]] == [40, 41, 42, 43, 44]
    assert [i for _, i, _ in got[2050]] == [2051] and set(got) == {*range(0, 1500, 50), 2050}
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_of_huge_and_tiny_vectors(spark):
    rows = [(0, [3e200, 4e200]), (1, [4e-200, 3e-200]), (2, [-1e300, 0.0]), (3, [1e-310, 1e-310])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 1, 2] and np.allclose([r["score"] for r in got], [7 / 50**0.5, 24 / 25, -3 / 5], atol=1e-12)


def test_an_encoder_looks_each_piece_up_once():
    """Pieces that are known already take one lookup each, and new ones no second."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

        def __contains__(self, key):
            Counted.looked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    encode = tokenizer._Encoder(tokenizer.public_spec("word_bpe_49k.json"))
    encode.known[0] = Counted()
    texts = pa.array(["one two three", "three four one"])
    for n in (4, 8):
        ids, before = encode.ids(texts)
        want = encode.library(texts.to_pylist())
        assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == want and Counted.looked == n
