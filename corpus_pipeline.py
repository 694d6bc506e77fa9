"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage keeps the columns of documents, those beyond the known five too, and works on all rows its
predecessor kept; the last returns packed pieces. Rows that repeat id and text are one document from the
second stage on. Null texts are empty documents. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.exact_dedup import exact_dedup
from frameloom.llm.mixing import capped_targets, cycle_weights, mix, word_count
from frameloom.llm.packing import pack
from frameloom.llm.quality import train, with_score
from frameloom.llm.shared import checkpointed, shared_path, text_or_empty
from frameloom.llm.simhash import near_duplicates
from frameloom.llm.tokenizer import public_spec
from frameloom.session import table


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have; Spark compares names without case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    net = train(docs, table(spark, sf_dir, "labels"), "quality")
    score = _free("quality_score", docs)
    return with_score(docs, net, score).where(F.col(score) >= 0.5).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id, once."""
    found = checkpointed(exact_dedup(docs, keep="max").where("kept").groupBy(F.col("doc_id").alias("own_id"), "text_sha256").agg(F.count("*").alias("times")))
    digest = F.sha2(text_or_empty("text"), 256)
    kept = docs.join(found.drop("times"), docs["doc_id"].eqNullSafe(found["own_id"]) & (digest == found["text_sha256"]), "left_semi")
    # Only repeated rows need the texts to be compared again.
    return kept if found.where("times > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; texts that share an id are judged apart."""
    found = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("own_id"), "text_md5")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["own_id"]) & (F.md5(text_or_empty("text")) == found["text_md5"]), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    key, times = _free("row_key", docs), _free("copies", docs)
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("own_id"), F.md5(text_or_empty("text")).alias("text_md5"), F.col("source").alias("own_source")))
    mixed = mix(keyed, word_count("text"), F.col("source"), lambda names, sizes: capped_targets(sizes, cycle_weights(len(names))), max_repeat=3, seed=7, id_col=key)
    told = mixed.groupBy(*(F.col(f"{key}.{c}") for c in ("own_id", "text_md5", "own_source"))).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    same = docs["doc_id"].eqNullSafe(told["own_id"]) & (F.md5(text_or_empty("text")) == told["text_md5"]) & docs["source"].eqNullSafe(told["own_source"])
    return docs.join(told, same).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*(docs[c] for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; workers that ran earlier stages have less memory left."""
    return pack(docs, public_spec("byte_bpe_50k.json"), end_id=1, tiers=(2048, 1024, 512, 256), slice_bytes=2 << 20, remembered=120_000)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]

#: A trained network, fingerprint groups and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
