"""Centroid clustering, fill-in-middle and language identification against brute force, and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import clusters, fim, language, queries
from frameloom.llm.tokenizer import public_spec

DATA = "/root/testdata/sf0.001"
PATH = public_spec("piece_bpe_32k.model").path


@pytest.mark.parametrize("name", ["op11_clusters", "op12_fill_in_middle"])
def test_twins(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


# Clusters.


def lloyd(rows, k, rounds, seed, scale=256):
    """Each round compares every vector with every centroid, in Python's integers."""
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [v for _, _, v in sorted((digest(i), i if i is not None else -1, v) for i, v in ints)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in ints]
        groups = [[v for (_, v), f in zip(ints, found, strict=True) if f == j] for j in range(len(cents))]
        cents = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    return Counter((i, near(v)[1], min(near(v)[0], (1 << 63) - 1)) for i, v in ints), cents


@pytest.mark.parametrize("kind", ["spread norms", "ties", "huge", "few"])
def test_clusters_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (300, 4)) * rng.choice([0.01, 1, 30, 700], (300, 1))
    if kind == "ties":
        v = rng.integers(-2, 3, (300, 4)) / 256
    if kind == "huge":
        v[::3] *= 1e4
        v[7], v[8] = 1e30, -3e38
    rows = [(i // 2, [float(x) for x in a]) for i, a in enumerate(v.tolist())][: 3 if kind == "few" else None]
    if kind == "ties":
        rows += [(None, [0.5, 0.5, 0.25, 0.25])]
    df = spark.createDataFrame([(i, a, None) for i, a in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got, cents = clusters.cluster(df, k=9, rounds=3, dims=4, seed=2)
    want, want_cents = lloyd(rows, 9, 3, 2)
    assert cents == want_cents
    assert Counter(map(tuple, got.collect())) == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = clusters.with_inertia(*clusters.cluster(df, k=40, rounds=5, dims=2)).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got] == [(7, 0, 0, 0)] * 2
    none = clusters.with_inertia(*clusters.cluster(df.where("vec_id < 7"), k=40, rounds=5, dims=2))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_ring_prunes_and_keeps_its_border():
    """A vector between two centroids of the farthest norms that its bound allows takes the smaller number."""
    search = clusters.Annulus([[0, 10], [0, 0], [100, 0], [0, -10]])
    c, d, wide = search.nearest(np.array([[0.0, 5.0], [0.0, 0.0], [60.0, 0.0], [0.0, -5.0]]))
    assert (c.tolist(), d.tolist(), wide) == ([0, 1, 2, 1], [25, 0, 1600, 25], {})


# Fill-in-middle.


def fim_of(i, t, seed=1):
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[j : j + 8], 16) for j in range(0, 32, 8)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return i, len(u), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle(spark):
    rng = random.Random(4)
    odd = ["", None, "<", "<<P", "a<P>b", "x<S", "<M>", "é🙂z ñ", "word " * 30000, "ab" * 5, "\x00\n\r\t", "日本語 abc"]
    rows = [(i, rng.choice(odd)) for i in range(400)] + [(None, "null id"), (None, "null id"), (7, "twice"), (7, "twice")]
    rows += [(1000 + i, "the same text in a third of all rows") for i in range(2500)]
    rows += [(9000 + i, "".join(rng.choice("ab <>PSMé\n🙂") for _ in range(rng.randrange(60)))) for i in range(2000)]
    extra = "digest string, slot string, n string, form string, often string, h1 string"
    df = spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"doc_id long, text string, {extra}").repartition(6)
    got = fim.fill_in_middle(df, seed=1).withColumn("again", fim.restored())
    found = got.collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(fim_of(i, t or "") for i, t in rows)
    by_output = {fim_of(i, t or "")[5]: t or "" for i, t in rows}
    assert all(by_output[r["output"]] == r["again"] for r in found)
    assert fim.fill_in_middle(df.where("false"), seed=1).count() == 0


def test_elias_fano_lists():
    rng = random.Random(2)
    for _ in range(300):
        values = np.cumsum([0] + [rng.choice([1, 1, 2, 9, 400]) for _ in range(rng.randrange(200))])
        packed = fim.elias_fano(values)
        at = [rng.randrange(len(values)) for _ in range(5)]
        assert fim.select(packed, at) == values[at].tolist()
    assert fim.select(fim.elias_fano(np.array([0])), [0]) == [0]
    # A list of a long text's units takes little more than the information in it.
    units = fim.boundaries(np.frombuffer(b"words of some length, " * 5000, np.uint8))
    assert len(fim.elias_fano(units)) < 4.5 * len(units) / 8


# Language.


def all_cuts(word, p, pieces):
    """The sum over all segmentations, one by one."""

    @lru_cache(None)
    def rest(at):
        if at == len(word):
            return 1.0
        return sum(p[pieces[word[at:end]]] * rest(end) for end in range(at + 1, len(word) + 1) if word[at:end] in pieces)

    return rest(0)


def pieces_of(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = {}
    for i in vocab.ids.tolist():
        piece = model.id_to_piece(i)
        found[bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()] = i
    return found


def test_words_sum_all_segmentations():
    vocab = language.vocabulary(PATH)
    pieces = pieces_of(vocab)
    rng = np.random.default_rng(1)
    p = rng.random((vocab.size, 3)) * language.start_model(vocab)
    words = ["a", "the", "segmentation", "häuser", "straße", "日本語", "ñandú", "x" * 70, "internationalization", "ⅷ"]
    got = language.log_words(vocab, words, p)
    for w, g in zip(words, got, strict=True):
        want = [all_cuts(b" " + w.encode(), p[:, k], pieces) for k in range(3)]
        assert np.allclose(g, np.log(want), rtol=1e-9)
    # No sum leaves a float's range: a word of twice the letters has about twice the logarithm.
    long = language.log_words(vocab, ["ab" * 200, "ab" * 400], p)
    assert np.isfinite(long).all() and np.allclose(long[1] / long[0], 2, rtol=0.02)


def test_expected_pieces_add_up():
    vocab = language.vocabulary(PATH)
    p = language.start_model(vocab)
    words, counts = ["nation", "été", "zz" * 300], np.array([[1, 0], [2, 5], [0, 3]])
    got = language.expected_pieces(vocab, words, counts, p) / (1 << language.UNIT)
    # Every byte of a word, its start included, lies in exactly one piece.
    size = np.zeros(vocab.size)
    for piece, i in pieces_of(vocab).items():
        size[i] = len(piece)
    bytes_of = np.array([len(w.encode()) + 1 for w in words])
    assert np.allclose(size @ got, bytes_of @ counts, rtol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op13_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out and lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["right"] >= 0.97


def test_language_odd_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the house is in the town", "en"), ("das Haus ist in der Stadt", "de"), (None, "de"), ("", "en"), ("12 34 ²", "fr"), ("la maison est dans la ville", "fr")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.learn(docs, PATH)
    assert model.languages == ["de", "en", "fr"]
    odd = [(1, None), (2, ""), (3, "123 ² ."), (4, "the house"), (4, "the house"), (None, "die Stadt"), (5, "la maison dans " * 20000), (6, "x" * 5000), (7, "DAS HAUS")]
    df = spark.createDataFrame([(*r, None) for r in odd], "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify(df, model).collect())
    assert [g for g in got if g[0] != 6] == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr"), (7, "de")]
    assert language.identify(df.where("false"), model).count() == 0
    nothing = language.learn(docs.where("false"), PATH)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df, nothing).collect()} == {("und", 0.0)}


def test_learning_and_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, many = (language.learn(docs.repartition(n), PATH) for n in (1, 7))
    assert (one.p == many.p).all() and (one.prior == many.prior).all()
    a, b = ({tuple(r) for r in language.identify(d, one).collect()} for d in (docs, docs.repartition(9)))
    assert a == b
