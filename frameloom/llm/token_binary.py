"""Token ids in binary shard files, compressed by a Re-Pair grammar for each shard.

Documents are range-partitioned by id and written in ascending order; a partition becomes
one or more shard files of about SHARD_IDS ids. A file holds, little-endian:

    magic, version, bits of a symbol and of a rule's length, vocabulary size, end id, partition and number of the
    shard, counts of documents, ids, symbols, rules and of the tokens that occur;
    the tokens that occur (uint32), which are the first symbols; rules follow them in number;
    for each document its id (int64), whether that is null (uint8), and its numbers of ids and of symbols (uint32 each);
    the rules' left symbols, their right ones and their expansion lengths, then the documents' symbols, all as planes, and
    the CRC-32 of all before it.

Planes of n numbers of w bits are w // 8 runs of n bytes, the lowest first, and a run of n bits for each further bit, so a slice
of them is a few slices of the file. A document's ids, or some of them, are read alone: its symbols are such a slice, and
symbols are expanded by the rules.
A file is written under another name and renamed, so a retried task replaces it whole.

Cases: null and empty texts are a document of the end id alone. Null ids come first, and rows of one
id are ordered by their text's hash. An empty table writes no file. Ids must be integers.
Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repair
from .shared import checkpointed, filesystem, shared_path, shuffle_partitions, write_file
from .tokenizer import TokenizerSpec, batches, encoder

MAGIC, VERSION = b"FLOOMIDS", 2
HEADER = struct.Struct("<8s7I5Q")
SHARD_IDS = 4 << 20


def planes_size(n: int, width: int) -> int:
    return width // 8 * n + width % 8 * -(-n // 8)


def to_planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits as byte and bit planes."""
    x = np.ascontiguousarray(x, "<u4")
    parts = [x.view(np.uint8)[k::4] for k in range(width // 8)]
    parts += [np.packbits((x & np.uint32(1 << k)) != 0, bitorder="little") for k in range(width // 8 * 8, width)]
    return b"".join(p.tobytes() for p in parts)


def from_planes(read: Callable[[int, int], bytes], start: int, n: int, width: int, a: int, b: int) -> np.ndarray:
    """The numbers a to b - 1 of n that begin at byte ``start``; read: bytes by place and length."""
    out = np.zeros(b - a, np.uint32)
    for k in range(width // 8):
        out |= np.frombuffer(read(start + k * n + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * k)
    start, each = start + width // 8 * n, -(-n // 8)
    for k in range(width % 8):
        bits = np.unpackbits(np.frombuffer(read(start + k * each + a // 8, -(-b // 8) - a // 8), np.uint8), bitorder="little")
        out |= bits[a % 8 : a % 8 + b - a].astype(np.uint32) << np.uint32(width // 8 * 8 + k)
    return out


class Shard:
    """A shard file; reads its tables, and of the symbols only those that are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self._read = read
        head = read(0, HEADER.size)
        if len(head) < HEADER.size or head[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, version, self._width, width, self.vocabulary, self.end_id, self.part, self.number, n_docs, n_ids, self._symbols, n_rules, n_tokens = HEADER.unpack(head)
        if version != VERSION:
            raise ValueError(f"token shard of version {version}")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(read(at, n * np.dtype(kind).itemsize), kind)
            at += out.nbytes
            return out

        def numbers(n: int, width: int) -> np.ndarray:
            nonlocal at
            at += planes_size(n, width)
            return from_planes(read, at - planes_size(n, width), n, width, 0, n)

        self.tokens = take("<u4", n_tokens)
        ids, missing = take("<i8", n_docs).tolist(), take("u1", n_docs).tolist()
        self.doc_ids = [None if m else x for x, m in zip(ids, missing, strict=True)]
        self.id_ends, self.symbol_ends = (np.cumsum(take("<u4", n_docs), dtype=np.int64) for _ in range(2))
        left, right, self.lengths = numbers(n_rules, self._width), numbers(n_rules, self._width), numbers(n_rules, width)
        self.rules, self._start = np.stack([left, right], 1), at
        if (int(self.id_ends[-1]) if n_docs else 0) != n_ids:
            raise ValueError("damaged token shard")

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the documents first to last - 1."""
        last = len(self.doc_ids) if last is None else last
        a = int(self.symbol_ends[first - 1]) if first else 0
        b = int(self.symbol_ends[last - 1]) if last else 0
        return self._expand(from_planes(self._read, self._start, self._symbols, self._width, a, b))

    def part_of(self, doc: int, start: int, n: int) -> np.ndarray:
        """Up to n ids of one document from its id number ``start`` on; only symbols that reach into them are expanded."""
        a = int(self.symbol_ends[doc - 1]) if doc else 0
        symbols = from_planes(self._read, self._start, self._symbols, self._width, a, int(self.symbol_ends[doc]))
        ends = np.cumsum(np.concatenate([np.ones(len(self.tokens), np.int64), self.lengths])[symbols])
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n) + 1
        skip = start - (int(ends[low - 1]) if low else 0)
        return self._expand(symbols[low:high])[skip : skip + n]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.tokens[repair.expand(symbols, self.rules, self.lengths, len(self.tokens))]


def dump(part: int, number: int, vocabulary: int, end_id: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard file of ids; ends: the index behind each document's last id."""
    used = np.zeros(int(ids.max(initial=0)) + 1, bool)
    used[ids] = True
    tokens = np.flatnonzero(used).astype(np.uint32)
    dense = (np.cumsum(used) - 1).astype(np.uint32)
    symbols, symbol_ends, rules, lengths = repair.compress(dense[ids], ends.astype(np.int64), len(tokens))
    width, long = int(len(tokens) + len(rules)).bit_length(), int(lengths.max(initial=0)).bit_length()
    body = b"".join(
        [
            HEADER.pack(MAGIC, VERSION, width, long, vocabulary, end_id, part, number, len(doc_ids), len(ids), len(symbols), len(rules), len(tokens)),
            tokens.astype("<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.diff(ends, prepend=0).astype("<u4").tobytes(),
            np.diff(symbol_ends, prepend=0).astype("<u4").tobytes(),
            to_planes(rules[:, 0], width),
            to_planes(rules[:, 1], width),
            to_planes(lengths, long),
            to_planes(symbols, width),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def load(content: bytes) -> Shard:
    """The shard of a whole file; ValueError if it isn't one, or not whole."""
    if len(content) < HEADER.size + 4 or content[:8] != MAGIC:
        raise ValueError("not a token shard")
    if zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("damaged token shard")
    view = memoryview(content)
    return Shard(lambda at, n: view[at : at + n])


def open_shard(uri: str) -> Shard:
    """The shard of a file of which only what is asked for is read."""
    system, path = filesystem(uri)
    file = system.open_input_file(path)
    return Shard(lambda at, n: file.read_at(n, at))


def write_tokens(
    docs: DataFrame, spec: TokenizerSpec, folder: str, end_id: int = 1, vocabulary: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the shard files; one row per file: part, number, docs, ids, base (ids of all shards before it).

    vocabulary: above all ids of the tokenizer.
    """
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(spec)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes))
            write_file(f"{folder}/part-{part:06d}-{number:06d}.ids", dump(part, number, vocabulary, end_id, doc_ids, ids, ends))
            row = [part, number, len(doc_ids), len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["part", "number", "docs", "ids"])

        for some, texts in batches(parts, "id", "text"):
            ids, before = encode.ids(texts, end_id)
            doc_ids += some.to_pylist()
            held.append(ids)
            sizes.append(np.diff(before))
            n += len(ids)
            if n >= SHARD_IDS:
                yield close()
                doc_ids, held, sizes, n, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id", F.xxhash64("text"))
    made = checkpointed(ordered.mapInArrow(work, "part long, number long, docs long, ids long"))
    # One row for each partition, then one for each of its shards.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = made.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before), zero).alias("first"))
    return made.join(parts, "part").select("part", "number", "docs", "ids", (F.col("first") + F.coalesce(F.sum("ids").over(within), zero)).alias("base"))


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, part, number, local_start, n_tokens, ids_crc32."""
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column("content"):
                shard = load(content.as_buffer().to_pybytes())
                ids = memoryview(shard.ids()).cast("B")
                ends = shard.id_ends.tolist()
                starts = [0, *ends[:-1]] if ends else []
                columns = [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(np.full(len(ends), shard.part, np.int64)),
                    pa.array(np.full(len(ends), shard.number, np.int64)),
                    pa.array(starts, pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "number", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("content")
    out = files.mapInArrow(work, "id long, part long, number long, local_start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_binary(docs: DataFrame, spec: TokenizerSpec, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back: id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    made = write_tokens(docs, spec, folder, end_id, id_col=id_col, text_col=text_col)
    if made.isEmpty():
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    rows = read_tokens(spark, folder, id_col)
    return rows.join(made.select("part", "number", "base"), ["part", "number"]).select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
