"""Token counts with a stored digest cache.

A count is stored under (SHA-256 of the normalised text, digest of the tokenizer
file and library version). A run computes the digests, joins them to the stored
counts, encodes one document for each distinct digest that has none, appends
those counts to the cache and joins again. Texts are read twice and shuffled once,
by document id, so copies of one text never meet in one task.

Normalisation must not change a count, so it only replaces null by the empty text.

Cases: a null or empty text has 0 bytes and 0 tokens. Null ids are allowed; the
representative of a digest is one of its rows whose id is not null, and texts that
only occur with null ids are encoded where they are. Repeated rows each get their
row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, lookup, shared_path, slot, text_or_empty
from .tokenizer import TokenizerSpec, batches, encoder


def tokenizer_version(spec: TokenizerSpec) -> str:
    """Digest of the tokenizer's file, its library and that library's version."""
    import importlib.metadata as meta

    with open(spec.path, "rb") as f:
        body = hashlib.sha256(f.read())
    body.update(f"{spec.library} {meta.version(spec.library)}".encode())
    return body.hexdigest()


def count_tokens(
    docs: DataFrame,
    spec: TokenizerSpec,
    cache_path: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache_path: the cache's Parquet folder, shared by all runs that should profit
    from each other. Without it a new one below the shared folder is used.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    version = tokenizer_version(spec)
    cache_path = cache_path or shared_path(spark, "token-cache")
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), slot().alias("slot"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))

    def cached() -> DataFrame:
        try:
            found = spark.read.schema("version string, digest binary, n_tokens long").parquet(cache_path)
        except AnalysisException as e:  # a cache that nothing was appended to yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "digest binary, n_tokens long")
        # Two runs at once may both have appended a digest; the counts are equal then.
        return found.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = rows.groupBy("digest").agg(F.max("id").alias("id")).join(cached(), "digest", "left_anti")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # A digest is computed again beside the text, as ids may repeat.
    wanted = texts.join(misses, texts["id"].eqNullSafe(misses["id"])).select("digest", "text").where(digest == F.col("digest"))

    def count(parts):
        encode = encoder(spec)
        for digests, column in batches(parts, "digest", "text"):
            yield pa.RecordBatch.from_arrays([digests, pa.array(encode.counts(column), pa.int64())], ["digest", "n_tokens"])

    # Rows that repeat an id and its text come twice.
    counted = wanted.mapInArrow(count, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    return lookup(rows, cached(), ["digest"]).select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
