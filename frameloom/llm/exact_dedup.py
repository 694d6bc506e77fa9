"""Exact deduplication by a tree merge of sorted digest runs.

Every scan partition starts a run of (digest, size, best row). The runs meet in
binomial rounds: in round r a run's slot gets its r-th base-8 digit from the
digest, so eight partitions exchange an eighth of their digests each, sort what
they receive and merge the sorted runs, keeping for each digest the row that
stays so far. After the last round a digest's slot depends on the digest alone,
and every digest has met all of its rows. No round holds more than one row for a
digest and slot, so a text with a third of all rows costs as much as any other.

Equality is verified at each level: rows merge only where SHA-256, byte length
and an independent 64-bit hash all agree.

Cases: a null text is the empty text. A null id never beats another id; if all ids
of a text are null, its ``keep_id`` is null and all its rows count as kept. Rows
that repeat id and text all report the same result. An empty table gives an empty
result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions, text_or_empty

RADIX = 8
KEY = ["digest", "n_bytes", "proof"]


def _rounds(partitions: int) -> int:
    rounds = 1
    while RADIX**rounds < partitions:
        rounds += 1
    return rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", the id that stays of equal texts.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rounds = _rounds(n)
    text = text_or_empty(text_col)
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.pmod(F.spark_partition_id(), F.lit(RADIX**rounds)).alias("slot"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).alias("n_bytes"),
            F.xxhash64(text).alias("proof"),
        )
    )
    best = F.max if keep == "max" else F.min
    # A struct in the aggregate makes Spark merge the sorted rows instead of hashing them. For the smallest
    # id the flag sends null ids behind all others.
    present = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    runs = rows.select("slot", *KEY, F.struct(present.alias("flag"), "id").alias("stays"), F.lit(1).cast("long").alias("size"))
    for r in range(rounds):
        unit = RADIX**r
        digit = F.pmod(F.shiftright("proof", 3 * r), F.lit(RADIX)).cast("int")
        own = F.pmod(F.floor(F.col("slot") / unit), F.lit(RADIX)).cast("int")
        runs = (
            runs.withColumn("slot", (F.col("slot") + (digit - own) * unit).cast("int"))
            .repartition(n, "slot")
            .sortWithinPartitions("slot", *KEY)
            .groupBy("slot", *KEY)
            .agg(best("stays").alias("stays"), F.sum("size").alias("size"))
        )
    merged = runs.select(*KEY, F.col("stays.id").alias("keep_id"), F.col("size").alias("group_size"))
    # Back down the tree: first to one row for each digest and starting slot, then to the rows of that slot.
    told = rows.select("slot", *KEY).distinct().join(merged, KEY)
    return rows.join(told, ["slot", *KEY]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
