"""Dictionary-compressed WARC archives.

Every page becomes a WARC record. Each archive starts with a skippable Zstandard frame that holds a dictionary built from its own
records, then come a ``warcinfo`` record and the page records, each compressed by itself with the dictionary, so that a reader can
seek to any record. Archives are written by Spark's own file writer (with its commit protocol, on any file system Spark can write
to) as raw bytes: a record is a row, and the row separator is an empty skippable frame, which every Zstandard reader passes over.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the largest page_id is the ``response`` and the
others are ``revisit`` records without a body that refer to it.

Defined cases: null html is an empty payload, null url an empty target; of rows that repeat both the largest page_id and its payload one
is the response, and the others revisit it; rows without an id count below all ids, and are responses where no record of their payload
has an id; the dictionary learns from the first 64 KB of each of an archive's first records, which bears on size only; very long payloads are one record each, whole; an empty table writes no archive; other columns are ignored. Where an
archive's records are too few or too alike to build a dictionary, it has no leading frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.common import Scratch, shared_dir

REVISIT_BYTES = 1000
#: Payload bytes of one archive, bytes of its records that its dictionary is built from, and bytes of the dictionary.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
LEVEL = 6
#: Skippable frames: the one that holds a dictionary, and an empty one (all its bytes are ASCII) that separates records.
DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
DATE = "2024-01-01T00:00:00Z"

FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, digest, record_type, refers_to, repeated) of each distinct page_id and payload; the html itself is not shuffled."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    small = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    last = small.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("last"))
    small = small.groupBy("page_id", "digest").agg(F.count("*").alias("n")).join(last, "digest", "left")
    visits = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    repeated = (F.col("n") > 1) & F.col("last").isNotNull() & ~visits
    return small.select("page_id", "digest", F.when(visits, "revisit").otherwise("response").alias("record_type"), F.when(visits, F.col("last")).alias("refers_to"), repeated.alias("repeated"))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, fields: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record; header values keep to one line."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {' '.join(v.split())}" for k, v in fields.items()), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + body + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, kind: str, refers_to: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {"WARC-Record-ID": urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": url or "", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/html"}
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(refers_to), "X-Payload-Length": str(len(payload))}
        payload = b""
    return record(kind, fields, payload)


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL)
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive. Only the records that the dictionary is built from are held back."""
    head, size = [], 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not head:
        return
    found = dictionary([r[: 64 << 10] for r in head])
    if found is not None:
        raw = found.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_checksum=True, write_content_size=True)
    yield packer.compress(record("warcinfo", {"WARC-Record-ID": "<urn:info>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
    for r in head:
        yield packer.compress(r)
    del head
    for r in records:
        yield packer.compress(r)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write all pages to archives under ``path``; pages are dealt to archives by a hash of id and payload."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    digest = F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    row = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), digest.alias("digest"))
    full = full.select("page_id", "url", "html", row.alias("row")).repartition(archives, "row")
    kinds = record_types(pages).select(row.alias("row"), "record_type", "refers_to", "repeated").repartition(archives, "row")
    joined = full.join(kinds, "row").select("page_id", "url", "html", "record_type", "refers_to", F.when(F.col("repeated"), F.col("row")).alias("again"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            seen: set[str] = set()  # of rows that repeat both id and payload, the first is the response
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for page_id, url, html, kind, refers_to, again in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to", "again")), strict=True):
                        if again is not None and again in seen:
                            kind, refers_to = "revisit", page_id
                        elif again is not None:
                            seen.add(again)
                        yield page_record(page_id, url, html, kind, refers_to)

        held, size = [], 0
        for frame in archive(records()):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    frames = joined.mapInArrow(pack, "frame binary")
    # A cast from binary to string keeps the bytes as they are, and the text writer writes them so. A session's limit on the rows of
    # a file would part an archive from its dictionary.
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option("lineSep", SEPARATOR.decode("ascii")).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, found by walking over its block headers."""
    start = data[at : at + 18]
    end = at + zstandard.frame_header_size(start)
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return end + 4 * zstandard.get_frame_parameters(start).has_checksum


def split_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one decompressed frame at a time."""
    known, at = None, 0
    view = memoryview(data)
    if len(data) >= 8 and (start := struct.unpack_from("<II", data))[0] == DICTIONARY_FRAME:
        known, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + start[1]])), 8 + start[1]
    opener = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + size
            continue
        end = frame_end(view, at)
        yield opener.decompress(view[at:end])
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(":", 1) for line in lines[1:])
    fields = {k: v.strip() for k, v in fields.items()}
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every page record.

    Bodies are hashed again and held against the digest in the record's header.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for raw in split_archive(data.as_py()):
                    fields, body = parse_record(raw)
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(body)
                    own, other = (fields.get(k, "<urn:page:>")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((int(own) if own else None, fields["WARC-Target-URI"], size, digest, kind, int(other) if other else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'warc').base}/archives"
    assert path.startswith(shared_dir(spark))
    write_archives(pages, path)
    return read_archives(spark, path)
