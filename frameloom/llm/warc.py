"""WARC archives with one Zstandard dictionary per job, embedded in every file.

A .warc.zst file starts with a skippable frame (0x184D2A5D) that holds the dictionary, itself
a Zstandard frame; each record follows as a frame of its own. The dictionary is built on the driver from a
bounded number of the records to be archived, those of smallest id hash that fit in bounded bytes.

Rows of equal payload are grouped by SHA-1 and length: the row of the largest id is a response, the others
revisit it. A group's rows are told through slots, so a page with a third of all copies is no hot key.

Cases: null html is the empty payload. A null URL is written as ``urn:null``; control characters and
spaces in a URL are percent-encoded. Ids are percent-encoded, and a null id has no field; if all ids of a
payload are null, all its rows are responses. Repeated rows of one id and payload get the same type and
record id. An empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, lookup, shared_path, slot, text_or_empty, write_file

SKIPPABLE = 0x184D2A5D
#: Records that the dictionary is built from at most, and their bytes; its size, and bytes of a file before the next is begun.
SAMPLES, SAMPLE_BYTES, DICTIONARY, FILE_BYTES = 200, 8 << 20, 112_640, 32 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def record_id(page_id: int | str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, revisit: bool, date: str) -> bytes:
    """A response or revisit record; the HTTP head of either states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'urn:null' if url is None else quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    # A null id has no field; an empty one has an empty field.
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(str(page_id), safe='')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {quote(str(refers_to), safe='')}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too small samples themselves serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class ArchiveWriter:
    """Collects one file's records."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        self.parts = [struct.pack("<II", SKIPPABLE, len(packed)), packed]
        self.size = 8 + len(packed)
        # Level and tables are worked out once for all records.
        shared = zstandard.ZstdCompressionDict(dictionary)
        if dictionary:
            shared.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=shared if dictionary else None, level=LEVEL, write_checksum=True)

    def add(self, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.parts.append(frame)
        self.size += len(frame)

    def content(self) -> bytes:
        return b"".join(self.parts)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a .warc.zst file."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    lines = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=shared).stream_reader(memoryview(content)[8 + size :], read_across_frames=True), 1 << 18)
    while version := lines.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {version[:20]!r}")
        fields = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = lines.read(int(fields["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> int:
    """Write the pages to .warc.zst files; the number of records.

    min_revisit_bytes: smaller payloads are all responses. date: WARC-Date of all records, as pages have none.
    """
    spark = pages.sparkSession
    html = text_or_empty(html_col)
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("n_bytes"))
    rows = checkpointed(pages.select("id", slot().alias("slot"), "digest", "n_bytes"))
    best = rows.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest", "n_bytes").agg(F.max("id").alias("response"))
    told = lookup(rows, rows.select("digest", "n_bytes").distinct().join(best, ["digest", "n_bytes"], "left"), ["digest", "n_bytes"])
    # One row for each id and payload; the ids that revisit and what they refer to.
    revisits = told.where("id is distinct from response and response is not null").select(F.col("id").alias("own"), F.col("digest").alias("of"), "response").distinct()
    # Ids and digests of the sample first, so that no task sends its own candidates' pages to the driver.
    some = rows.where("n_bytes > 0").select("id", "digest", "n_bytes").distinct().orderBy(F.xxhash64("id"), "id", "digest").limit(SAMPLES).collect()
    taken, left = [], SAMPLE_BYTES
    for r in some:
        if r["n_bytes"] <= left:
            taken.append((r["id"], bytes(r["digest"])))
            left -= r["n_bytes"]
    chosen = F.broadcast(spark.createDataFrame(taken, f"own {dict(pages.dtypes)['id']}, of binary"))
    picked = pages.join(chosen, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left_semi")
    sample = [r["html"].encode() for r in picked.dropDuplicates(["id", "digest"]).orderBy(F.xxhash64("id"), "id", "digest").select("html").collect()]
    dictionary = build_dictionary([record(i, "http://example.com/", p, _sha1(p), None, False, date) for i, p in enumerate(sample)]) if sample else b""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, n, out = TaskContext.get().partitionId(), 0, 0, None
        for batch in parts:
            column = batch.column("html")
            payloads = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            for i, url, payload, digest, response in zip(*(batch.column(c).to_pylist() for c in ("id", "url")), payloads, *(batch.column(c).to_pylist() for c in ("digest", "response")), strict=True):
                out = out or ArchiveWriter(dictionary)
                out.add(record(i, url, payload.as_py(), base64.b32encode(digest).decode(), response, response is not None, date))
                n += 1
                if out.size >= FILE_BYTES:
                    write_file(f"{folder}/part-{part:06d}-{number:06d}.warc.zst", out.content())
                    out, number = None, number + 1
        if out:
            write_file(f"{folder}/part-{part:06d}-{number:06d}.warc.zst", out.content())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    joined = pages.join(revisits, pages["id"].eqNullSafe(revisits["own"]) & (pages["digest"] == revisits["of"]), "left")
    written = joined.select("id", "url", "html", "digest", "response").mapInArrow(work, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_warc(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record of the files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is checked against its digest.
    """
    whole = id_type in ("tinyint", "smallint", "int", "bigint", "long")

    def number(value: str | None) -> int | str | None:
        return None if value is None else int(value) if whole else unquote(value)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column("content"):
                found = []
                for fields, block in records(content.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
                        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                    found.append((number(fields.get("X-Page-ID")), size, digest, kind, number(fields.get("X-Refers-To-Page-ID"))))
                columns = list(zip(*found, strict=True)) or [[]] * 5
                ids = pa.int64() if whole else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ids, pa.int64(), pa.string(), pa.string(), ids), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(work, SCHEMA.format(id="long" if whole else "string"))


def archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Write the pages' archives and read them back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    if not write_warc(pages, folder, min_revisit_bytes, id_col=id_col):
        return spark.createDataFrame([], SCHEMA.format(id=kind))
    return read_warc(spark, folder, kind)
