import hashlib
import io
import struct

import zstandard
from pyspark.sql import functions as F

from gapline.llm import warc


def brute(rows):
    last = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    out, taken = [], set()
    for i, _, h in rows:
        p = (h or "").encode()
        top = last.get(p)
        revisit = top is not None and (i is None or i < top or p in taken)
        if top is not None and i == top:
            taken.add(p)
        out.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def shown(df):
    return sorted(((str(r["page_id"]), *(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in df.collect()), key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert shown(warc.round_trip(pages)) == brute(rows)
    assert sorted((r["page_id"], r["url"]) for r in warc.round_trip(pages).collect()) == sorted((i, u) for i, u, _ in rows)


def test_archives_are_standard(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=60_000)
    files = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    assert len(files) > 1 and any(struct.unpack_from("<I", f)[0] == 0x184D2A5D for f in files)
    records = 0
    for data in files:
        size = struct.unpack_from("<II", data)[1] + 8 if struct.unpack_from("<I", data)[0] == 0x184D2A5D else 0
        known = zstandard.ZstdCompressionDict(data[8:size]) if size else None
        # A plain streaming reader passes over the separators too.
        plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(data[size:]), read_across_frames=True).read()
        assert plain == b"".join(warc.split_archive(data))
        records += sum(1 for r in warc.split_archive(data) if b"WARC-Type: warcinfo" not in r[:40])
    assert records == pages.count()


def test_edges(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nX: y", big), (4, "u", big), (4, "u", big), (5, "u", big[:300]), (6, "u", big[:300]), (None, "u", big), (None, "v", big), (None, "w", "n" * 2000), (None, "w", "n" * 2000), (12, "u", "t" * 1500), (12, "v", "t" * 1500), (12, "v", "t" * 1500), (11, "u", "t" * 1500), (7, "u", "x" * 3_000_000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (8, "u", "P*M\x18\0\0\0\0" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("last", F.lit("x"))
    assert shown(warc.round_trip(pages)) == brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
