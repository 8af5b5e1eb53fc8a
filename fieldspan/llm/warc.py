"""WARC archives with revisit resolution."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import fresh_path, keep

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Date of all records: the pages have none, and reruns are to agree.
DATE = "2024-01-01T00:00:00Z"
#: Records of an archive file at most, and payload bytes above which records get files of their own.
FILE_RECORDS, LARGE = 5000, 1 << 18


def with_digest(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the bare upper-case base32 SHA-1 of a text column: 5 hex digits give 4 letters.

    The hash is a column of its own first, so that it is computed once, not once for each group of digits.
    """
    letters = []
    for i in range(8):
        number = F.conv(F.substring("_hex", 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr((F.shiftright(number, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return df.withColumn("_hex", F.sha1(F.col(text).cast("binary"))).withColumn(out, F.concat(*letters)).drop("_hex")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, bytes) -> the same with refers_to: the response that has the payload, null for a response.

    Of records with equal digests the one with the largest page_id is the response. Headers only: the largest page of
    a digest is found by sums combined before the shuffle, and joined to the headers, which are read twice.
    """
    heads = pages.select("page_id", "digest", "bytes")
    owners = keep(heads.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("_owner"), F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_d"), "_owner"), "warc_owners")
    refers = F.when((F.col("bytes") >= min_bytes) & (F.col("page_id") < F.col("_owner")), F.col("_owner"))
    return heads.join(owners, F.col("digest") == F.col("_d"), "left").select("page_id", "digest", "bytes", refers.alias("refers_to"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write a WARC/1.1 record for each page (page_id, url, html), and return the folder of the gzip files.

    Payloads are shuffled once, by page_id, to meet what was decided on their headers; a revisit has no payload. A
    record ends with two line ends, which is the line separator of Spark's text writer: any file system that
    Spark writes to will do. Line ends in a url are replaced by spaces. Only equal rows share a record id.

    A file holds at most FILE_RECORDS records of at most LARGE bytes each, or records above that, as many as make up
    the same number of bytes at their largest size (one, if that is more). Larger pages are written in a second pass,
    if there are any.
    """
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    raw = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), body.alias("html"))
    heads = keep(with_digest(raw, "html", "digest").select("page_id", "digest", F.octet_length("html").cast("long").alias("bytes")), "warc_heads")
    refers = resolve(heads, min_bytes).where("refers_to is not null").select(F.col("page_id").alias("_p"), F.col("refers_to").alias("_to"), F.col("digest").alias("_rd")).distinct()
    rows = with_digest(raw, "html", "_d").join(refers, (F.col("page_id") == F.col("_p")) & (F.col("_d") == F.col("_rd")), "left")
    revisit = F.col("_to").isNotNull()
    block = F.when(revisit, "").otherwise(F.col("html"))
    end = "\r\n"
    head = F.concat_ws(
        end,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("_d"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_d")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("_to"), F.col("_d")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    path = fresh_path(spark, "warc")
    most = heads.agg(F.max("bytes")).first()[0] or 0
    parts = [("common", rows, FILE_RECORDS)]
    if most > LARGE:
        size = F.octet_length("html")
        parts = [("common", rows.where(size <= LARGE), FILE_RECORDS), ("large", rows.where(size > LARGE), max(1, FILE_RECORDS * LARGE // most))]
    for name, part, records in parts:
        out = part.select(F.concat(head, F.lit(end * 2), block).alias("value"))
        out.write.option("compression", "gzip").option("lineSep", end * 2).option("maxRecordsPerFile", records).text(f"{path}/{name}")
    return path


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)


def parse(data: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a gzip archive, by Content-Length; decompressed step by step."""
    inflate, buf, at = zlib.decompressobj(31), b"", 0
    while True:
        cut = buf.find(b"\r\n\r\n")
        if cut >= 0:
            fields = {k.decode().lower(): v.decode().rstrip("\r") for k, v in _FIELD.findall(buf[:cut])}
            end = cut + 4 + int(fields["content-length"])
            while len(buf) < end + 4 and at < len(data):
                part = inflate.decompress(data[at : at + step])
                at += step
                buf += part
                if inflate.eof:
                    rest = inflate.unused_data
                    inflate = zlib.decompressobj(31)
                    buf += inflate.decompress(rest)
            yield fields, buf[cut + 4 : end]
            buf = buf[end + 4 :]
        elif at < len(data):
            buf += inflate.decompress(data[at : at + step])
            at += step
        else:
            return


def _read(batches):
    import base64
    import hashlib

    kinds = {"page_id": pa.int64(), "type": pa.string(), "digest": pa.string(), "to": pa.int64(), "bytes": pa.int64(), "url": pa.string(), "payload": pa.string()}
    number = lambda x: None if x is None or x.startswith("<urn:page:null:") else int(x.split(":")[2])
    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for f, block in parse(data.as_py()):
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                is_response = f["warc-type"] == "response"
                if is_response and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"payload digest of {f['warc-record-id']} does not hold")
                rows.append((number(f["warc-record-id"]), f["warc-type"], digest, number(f.get("warc-refers-to")), len(block), f["warc-target-uri"], block.decode() if is_response else None))
                size += len(block)
                if size > 4 << 20:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives of a folder: page_id, type, digest, to, bytes, url, payload (null for a revisit).

    Every payload is checked against its digest. An archive is one task's work; write_archives bounds its size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, type string, digest string, to long, bytes long, url string, payload string")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of pages, read them back, and resolve the revisits in them.

    pages has page_id, url and html. Returns page_id, payload_bytes, payload_digest, record_type and refers_to, one
    row for each row of pages, all from the archives. A revisit's bytes come from the response it refers to.

    Null html is empty. Rows that repeat a page_id and html are responses alike, or revisits alike. A null page_id is
    a response with no one to refer to it. Records below min_bytes are responses. An empty table gives an empty
    result. Other columns are ignored.
    """
    path = write_archives(pages, min_bytes)
    heads = keep(read_archives(pages.sparkSession, path).select("page_id", "type", "digest", "to", "bytes"), "warc_read")
    originals = heads.where("type = 'response' and page_id is not null").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("bytes").alias("_b")).distinct()
    same = (F.col("to") == F.col("_p")) & (F.col("digest") == F.col("_d"))
    # Only what is referred to can meet a revisit; responses keep their own length.
    out = heads.join(originals, same, "left")
    return out.select("page_id", F.coalesce("_b", "bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"))
