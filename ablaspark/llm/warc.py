"""WARC archives compressed with a dictionary of their own (.warc.zst).

An archive starts with a skippable Zstandard frame that holds a dictionary trained on records of
this archive; every record follows as a frame of its own, so records can be read one by one.
Archives are rows (archive, content): ``content`` is the file, byte for byte. They are
kept as a Parquet table because Spark can write that to any store the cluster uses.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from this size on are stored once.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: A dictionary is trained on at most this many bytes, taken evenly over the archive's records.
SAMPLE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def record_bytes(row) -> bytes:
    """One WARC record. A revisit has the HTTP header of its payload but not the payload."""
    payload = row.payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if row.record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{row.record_id}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{row.payload_digest}", "Content-Type: application/http;msgtype=response"]
    if row.url is not None:
        head.append("WARC-Target-URI: " + row.url.replace("\r", "%0D").replace("\n", "%0A"))
    if row.record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{row.refers_to_id}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from an even sample of the records; none if they are too few or too alike to train on."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records[::step])
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    trained = dictionary(records)
    compressor = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True) if trained else \
        zstandard.ZstdCompressor(write_checksum=True)
    parts = []
    if trained:
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    parts += [compressor.compress(r) for r in records]
    return b"".join(parts)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            held.append(record_bytes(row))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield pd.DataFrame({"records": [len(held)], "content": [archive_bytes(held)]})
                held, size = [], 0
    if held:
        yield pd.DataFrame({"records": [len(held)], "content": [archive_bytes(held)]})


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per row and return the written table of archives (records, content).

    A null payload is empty, a null URL is left out. Of equal payloads of at least ``LEAST_REVISIT`` bytes
    the row with the smallest id (null last; ties: one of them) is the response, the others refer to it.
    """
    rows = stored(pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row_no"),
    ).withColumn("payload_digest", F.sha2("payload", 256)), "warc-pages")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"),
                    F.col("row_no").cast("string"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row_no", name.alias("id"))).alias("first")
    groups = stored(rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("payload_digest").agg(
        first, F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "warc-copies")
    revisit = F.col("first").isNotNull() & (F.col("first.row_no") != F.col("row_no"))
    judged = rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", name.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to_id"), "row_no")
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    dealt = judged.repartition(max(1, -(-total // ARCHIVE_BYTES)), "row_no")
    return stored(dealt.mapInPandas(_write, "records bigint, content binary"), "warc-archives")


def _page_id(name: str | None) -> int | None:
    """The id in urn:page:<id>:<row>, in angle brackets."""
    number = name.strip("<>").split(":")[2] if name else "-"
    return None if number == "-" else int(number)


def archive_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    known = {}
    start = 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        start = 8 + struct.unpack_from("<I", content, 4)[0]
        raw = content[8:start]
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        assert raw[:4] == DICTIONARY_MAGIC
        known = {"dict_data": zstandard.ZstdCompressionDict(raw)}
    packed = io.BytesIO(memoryview(content)[start:])
    with zstandard.ZstdDecompressor(**known).stream_reader(packed, read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        while stream.readline():
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                key, _, value = line.decode().partition(": ")
                fields[key] = value
            block = stream.read(int(fields["Content-Length"]))
            stream.read(4)
            yield fields, block


READ_SCHEMA = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
               "record_type string, refers_to bigint")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            out, held = [], 0
            for fields, block in archive_records(content):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                length = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                out.append((_page_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                            payload if kind == "response" else None, length, digest, kind,
                            _page_id(fields.get("WARC-Refers-To"))))
                held += len(payload)
                if held > 4 << 20:
                    yield _frame(out)
                    out, held = [], 0
            yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READ_SCHEMA.split(", ")], dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives. Payloads of responses are checked against their digest; a revisit has none."""
    return archives.select("content").mapInPandas(_read, READ_SCHEMA)
