"""The corpus pipeline: stages against brute force on their own inputs, and odd inputs."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from frameloom.llm import mixing, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("Copies", F.lit("extra")).withColumn("quality_score", F.lit(1))
    out = [docs]
    for k, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    net = quality.train(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = stages[0].collect()
    want = {r["doc_id"] for r, s in zip(rows, quality.scores(net, [(r["text"] or "").encode() for r in rows]), strict=True) if s >= 0.5}
    assert {r["doc_id"] for r in stages[1].collect()} == want and len(want) < len(rows)


def test_dedup_stage(stages):
    best = {}
    for r in stages[1].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(best.values())


def test_near_stage_drops_only_near_copies(stages):
    def shingles(t, k=3):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    before, after = ({r["doc_id"]: shingles(r["text"]) for r in s.collect()} for s in stages[2:4])
    similar = lambda a, b: len(a & b) / len(a | b)
    for i in before.keys() - after.keys():
        assert max(similar(before[i], s) for s in after.values()) > 0.5
    kept = list(after.values())
    assert not any(similar(a, b) > 0.95 for n, a in enumerate(kept) for b in kept[:n])


def test_mixing_and_packing_stages(stages):
    counts = Counter(r["doc_id"] for r in stages[4].collect())
    known = {r["doc_id"] for r in stages[3].collect()}
    assert set(counts) <= known and max(counts.values()) <= 3
    pieces = stages[5].collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert tokens == Counter({i: n * whole[i] for i, n in counts.items()})


def test_odd_rows(spark, tmp_path):
    rows = [(1, "plain words of a text", "en", "s", 5), (1, "plain words of a text", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id at all here", "en", None, 3), (4, "word " * 20000, "de", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = pipe.dedup(spark, docs, DATA).collect()
    assert Counter(hashlib.sha1((r["text"] or "").encode()).digest() for r in once).most_common(1)[0][1] == 1 and len(once) == 4
    # Null and empty texts are one text; rows that repeat id and text stay together.
    assert sorted(str(r["doc_id"]) for r in pipe.near_dedup(spark, docs, DATA).collect()) == ["1", "1", "2", "4", "None"]
    known = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    good = Counter((r["doc_id"], r["text"]) for r in pipe.quality(spark, docs, DATA).collect())
    assert all(good[k] == known[k] for k in good)
    mixed = Counter((r["doc_id"], r["text"]) for r in pipe.mixture(spark, docs, DATA).collect())
    assert all(n <= 3 * known[k] for k, n in mixed.items()) and sum(mixed.values()) > 0
    pieces = pipe.packing(spark, docs, DATA).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0


def test_rows_that_share_an_id(spark):
    """Null and repeated ids: unrelated texts stay, near copies go, and each row has its own place in the mix."""
    word = lambda k, n: " ".join(f"t{k}w{i}" for i in range(n))
    first = word(0, 200)
    rows = [(1, first, "a"), (None, first + " more", "a"), (None, word(1, 200), "a"), (None, word(1, 200) + " more", "b"), (None, word(2, 200), "b"), (5, word(3, 200), "a"), (5, first + " other", "b"), (5, word(4, 200), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in pipe.near_dedup(spark, docs, DATA).collect()]
    pair = min(rows[2:4], key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    assert Counter(kept) == Counter((r[0], r[1]) for r in [rows[0], pair, rows[4], rows[5], rows[7]])
    docs = spark.createDataFrame([(k % 2 or None, word(k, 40), "abc"[k % 3]) for k in range(60)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs.withColumn("k", F.col("text")), mixing.word_count("text"), F.col("source"), lambda names, sizes: mixing.capped_targets(sizes, mixing.cycle_weights(len(names))), max_repeat=3, seed=7, id_col="k")
    want = mixed.groupBy(F.element_at("members", 1).alias("source")).agg(F.sum("taken").alias("n")).collect()
    got = pipe.mixture(spark, docs, DATA).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {r["source"]: r["n"] for r in want if r["n"]}


def test_run(spark):
    assert pipe.run(spark, DATA).count() > 0
