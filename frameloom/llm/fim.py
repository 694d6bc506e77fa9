"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are grouped by verified content (their SHA-256; only one text of a group travels on). A group's unit boundaries, the code points after which a
unit ends, are computed once and kept as an Elias-Fano list of about two bits more than the
logarithm of the mean unit length for each unit. Documents are joined back to the index without
their own texts, and each selects its two seeded cuts from the list.

A text with more than 1/HOT of all rows is indexed once for each of a number of slots, which its rows' ids
choose, so its documents spread over tasks; there are fewer than HOT such texts.

Cases: a null text is the empty text, which stays plain. A null id is hashed as no digits, and all its rows
of one text go to one slot. Rows that repeat an id each get their row. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions, text_or_empty

HOT = 1024
KEY = ["digest", "slot"]
_HEAD = struct.Struct("<IIB")


def boundaries(text: np.ndarray) -> np.ndarray:
    """Of UTF-8 bytes: code points before each unit ([A-Za-z]+ or one other code point), and of the whole."""
    lead = (text & 0xC0) != 0x80
    letter = ((text | 0x20) - np.uint8(97)) < 26
    inner = np.zeros(len(text), bool)
    inner[1:] = letter[1:] & letter[:-1]
    points = np.cumsum(lead)
    return np.append(points[lead & ~inner] - 1, points[-1] if len(text) else 0)


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list as low bits, packed, and high bits in unary."""
    n, top = len(values), int(values[-1])
    low = max(0, (top // n).bit_length() - 1)
    v = values.astype(np.int64)
    lows = np.packbits((v[:, None] >> np.arange(low)) & 1 if low else np.zeros(0, np.uint8), bitorder="little")
    highs = np.zeros((top >> low) + n, np.uint8)
    highs[(v >> low) + np.arange(n)] = 1
    return _HEAD.pack(n, top, low) + lows.tobytes() + np.packbits(highs, bitorder="little").tobytes()


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def select(packed: bytes, at: list[int]) -> list[int]:
    """The values at some places of an Elias-Fano list."""
    n, _, low = _HEAD.unpack_from(packed)
    n_low = -(-n * low // 8)
    lows = np.frombuffer(packed, np.uint8, n_low, _HEAD.size)
    highs = np.frombuffer(packed, np.uint8, -1, _HEAD.size + n_low)
    ones = np.cumsum(_ONES[highs])
    out = []
    for i in at:
        byte = int(np.searchsorted(ones, i, "right"))
        left = i - (int(ones[byte - 1]) if byte else 0)
        bit = int(np.flatnonzero(np.unpackbits(highs[byte : byte + 1], bitorder="little"))[left])
        value = byte * 8 + bit - i
        start = i * low
        word = int.from_bytes(lows[start // 8 : (start + low + 7) // 8].tobytes(), "little") >> (start % 8) & ((1 << low) - 1)
        out.append(value << low | word)
    return out


def _index(texts: pa.Array) -> pa.Array:
    lists = [boundaries(np.frombuffer(t.as_buffer() or b"", np.uint8)) for t in texts]
    return pa.StructArray.from_arrays([pa.array([len(x) - 1 for x in lists], pa.int64()), pa.array([elias_fano(x) for x in lists], pa.binary())], ["n", "list"])


def _cuts(lists: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = [select(packed, [a, b]) for packed, a, b in zip(lists.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["first", "second"])


def fill_in_middle(
    docs: DataFrame,
    seed: int,
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars, output.

    marks: what stands before prefix, suffix and middle; a text that contains one stays plain.
    """
    spark = docs.sparkSession
    slots = shuffle_partitions(spark)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), digest))
    least = rows.count() // HOT
    # Fewer than HOT digests have more than a HOT-th of all rows.
    hot = [r["digest"] for r in rows.groupBy("digest").count().where(F.col("count") > max(least, 1)).orderBy(F.desc("count")).limit(HOT).collect()] if least else []
    often = F.broadcast(spark.createDataFrame([(bytes(d), True) for d in hot], "digest binary, often boolean"))

    def dealt(part: DataFrame) -> DataFrame:
        told = part.join(often, "digest", "left")
        return told.withColumn("slot", F.when(F.col("often"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(slots)).cast("int")).otherwise(0)).drop("often")

    index_of, cuts_of = F.arrow_udf(_index, "struct<n: long, list: binary>"), F.arrow_udf(_cuts, "struct<first: long, second: long>")
    texts = dealt(docs.select(F.col(id_col).alias("id"), digest, text.alias("text"))).groupBy(*KEY).agg(F.first("text").alias("text"))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(h, 8 * i - 7, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    lists = texts.select(*KEY, marked.alias("marked"), index_of("text").alias("index"))
    told = dealt(rows).join(lists, KEY).withColumns({f"h{i}": group(i) for i in range(1, 5)})
    n = F.col("index.n")
    places = [F.col(f"h{i}") % (n + 1) for i in (1, 2)]
    form = F.when((n == 0) | F.col("marked") | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    # Exchanges carry little: the lists of distinct texts, then two numbers a document. The texts' exchange is used again: they are shuffled once, and never reach Python beside a document.
    cut = told.select("id", *KEY, n.alias("n"), form.alias("form"), cuts_of(F.col("index.list"), F.least(*places), F.greatest(*places)).alias("cut")).join(texts, KEY)
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix, middle = F.substring("text", F.lit(1), first.cast("int")), F.substring("text", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring("text", (second + 1).cast("int"), F.lit((1 << 31) - 1))
    p, s, m = (F.lit(x) for x in marks)
    plain = F.col("form") == "plain"
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return cut.select(F.col("id").alias(id_col), "n", "form", F.when(~plain, first).alias("prefix_chars"), F.when(~plain, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The exact text, from output and form alone; a text that isn't plain holds no mark of its own."""
    out, (p, s, m) = F.col(output), marks
    head, middle = F.substring_index(out, m, 1), F.substring_index(out, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
