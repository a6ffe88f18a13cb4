"""WARC archives with an index first: where each record lies is known before any archive is read, and reads are few ranges of bytes."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, save

#: Bytes of an archive; the widest gap that a read covers for the sake of one range; bytes of a range, and of the ranges of a task.
ARCHIVE_BYTES, GAP, RANGE_BYTES, TASK_BYTES = 64_000_000, 65_536, 1_000_000, 64_000_000
#: A multiple of any date would do; pages have none.
_DATE = "1970-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits make four of base 32."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _plan(pages: DataFrame, min_bytes: int) -> DataFrame:
    """A row for each record: its headers, and what the index tells of it. Payloads take part by digest and size alone."""
    rows = pages.select("row", "page_id", "url", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html")).alias("payload_digest"))
    rows = save(rows.dropDuplicates(["row"]), "digests")
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"))
    again = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    rows = rows.join(first, ["payload_digest", "payload_bytes"], "left").withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))

    url = F.col("url")
    for c in [*range(1, 32), 127]:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    if_revisit = lambda c: F.when(F.col("record_type") == "revisit", c)
    body = F.lit(len(_HTTP)) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        if_revisit(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        if_revisit(F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    rows = rows.withColumn("head", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n" + _HTTP)))
    return save(rows, "records")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, every_row: bool = False) -> DataFrame:
    """Write a record for each distinct row of pages (page_id, url, html), or with every_row for each row, to path/archives and the index to path/index, which
    is returned: page_id, url, file, offset, length, payload_digest, payload_bytes, record_type, refers_to. The index is complete before any archive is read.

    Of records with equal payloads of at least min_bytes, that of the largest page_id holds it and others revisit it; a null html is empty. Rows of unlike urls that
    share the largest page_id all hold it, and so do rows equal in all three columns, with every_row. A null page_id is written as such and revisits nothing.
    Control characters of a url are percent-encoded; a null one is a urn. Each record is a gzip member of its own, as WARC readers expect, so offset and length
    are those of the member. A task writes files of new names and tells the index of them: of a task that is tried again, the index has the files of
    the attempt that ended well alone, and no file is ever written twice."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # 128 bits, so that no two of any number of rows share a name by chance
    pages = pages.withColumn("row", F.struct(F.xxhash64("page_id", "url", "html").alias("a"), F.xxhash64(F.lit("second"), "html", "url", "page_id").alias("b")))
    written = pages if every_row else pages.dropDuplicates(["row"])
    rows = written.select("row", "html").join(_plan(pages, min_bytes), "row")
    rows = rows.select(*_KEPT, F.col("head").cast("binary").alias("head"), F.when(F.col("record_type") == "response", F.col("html")).otherwise("").cast("binary").alias("body"))
    index = rows.mapInArrow(_writer(f"{path}/archives"), _INDEX)
    index.write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(_INDEX).parquet(f"{path}/index")


_KEPT = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]
_INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes heads and bodies, a record after another, to files of about ARCHIVE_BYTES in folder; gives the other columns and each record's place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        out, file, offset = None, "", 0
        try:
            for batch in batches:
                places = []
                for head, body in zip(batch.column("head"), batch.column("body"), strict=True):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        file, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        fs, at = FileSystem.from_uri(file)
                        fs.create_dir(at.rpartition("/")[0])
                        out = fs.open_output_stream(at, compression=None)
                    member = gzip.compress(head.as_py() + body.as_py() + b"\r\n\r\n", 6, mtime=0)
                    out.write(member)
                    places.append((file, offset, len(member)))
                    offset += len(member)
                files, offsets, lengths = zip(*places, strict=True) if places else ((), (), ())
                columns = [*(batch.column(c) for c in _KEPT), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*_KEPT, "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return write


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; raises if a payload is not what its digest says."""
    head, _, body = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response":
        import base64

        if "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't what was written")
    return headers | {"payload": payload}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    number = lambda x: None if x is None or "none" in x else int(x.strip("<>").rpartition(":")[2])
    for ranges in batches:
        for file, records in zip(ranges["file"], ranges["records"], strict=True):
            fs, path = FileSystem.from_uri(file)
            start, end = records[0]["offset"], max(r["offset"] + r["length"] for r in records)
            with fs.open_input_file(path) as f:
                data = f.read_at(end - start, start)
            out = []
            for r in records:
                x = parse_record(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                held = x["WARC-Type"] == "response"
                out.append((number(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["payload"].decode() if held else None, int(x["X-Payload-Length"]), x["WARC-Payload-Digest"][5:], x["WARC-Type"], number(x.get("WARC-Refers-To"))))
            table = pd.DataFrame(out, columns=["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield table.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index's rows, all or selected: page_id, url, html (of responses), payload_bytes, payload_digest, record_type and refers_to, as the
    archives have them. Each file's selected records are sorted by offset, and those near one another are one range to read."""
    place = Window.partitionBy("file").orderBy("offset", "length")
    end = F.max(F.col("offset") + F.col("length")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    rows = index.select("file", "offset", "length").withColumn("apart", (F.col("offset") - F.coalesce(end, F.lit(0)) > GAP).cast("int"))
    rows = rows.withColumn("near", F.sum("apart").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = rows.groupBy("file", "near", F.floor(F.col("offset") / RANGE_BYTES).alias("block")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    # places are small beside what they stand for, so tasks are dealt by the bytes to read
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = ranges.repartition(max(-(-total // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism), "file", "near", "block")
    return ranges.select("file", "records").mapInPandas(_read, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """write_archives with a record for each row of pages, and read_records of all; nulls, empties and repeated rows as there."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"), every_row=True)
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's base 32 of SHA-1: five hexadecimal digits make four.
_SQL_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, {a}, 5) AS BIGINT) >> {b}) & 31 AS INT), 1)"
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, {" || ".join(_SQL_DIGIT.format(a=5 * k + 1, b=b) for k in range(8) for b in (15, 10, 5, 0))} AS payload_digest FROM h),
f AS (SELECT payload_bytes, payload_digest, max(page_id) AS first FROM d GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM d JOIN f USING (payload_bytes, payload_digest)
"""
