"""WARC archives: written from a table of pages, read back by boundary chains.

Writing uses Spark's own text writer, whose line separator is the two empty
lines that end a WARC record, so that archives are committed to the shared
store like any other Spark output. Payloads that occur again become revisit
records that refer to the record that holds them.

Reading doesn't trust the magic string: a task lists every place that looks like
the head of a record and the offset at which the record after it would begin.
These candidates are written down once. Pointer jumping from the start of the
file over their offsets alone then keeps those records that the chain reaches, so
a record head inside a payload is never taken for one. Damage is an error: a
chain that breaks, a file without a record, a payload that lacks its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialise, new_path

END = "\r\n\r\n"
#: Classes of payload size in bytes, and how many records of each an archive has at most: some 128 MB, or one record.
FILE_CLASSES = ((1 << 14, 8000), (1 << 18, 500), (1 << 22, 32), (None, 1))
#: Bytes of payload that a task hands on at once when it reads.
BATCH_BYTES = 16 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
# The base-32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# The version line of a record, its fields (a line that starts with a blank goes on with the one before), an empty line.
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n")


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a hexadecimal digest of a whole number of 5-digit groups."""
    group = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda g, k: F.substring(F.lit(BASE32), F.shiftright(g, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digest) / 5 - 1).cast("int")), lambda i: F.concat(*[letter(group(i), k) for k in range(4)])), "")


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """id, sha1, refers_to: pages that revisit another, without their payloads.

    Of pages with equal payloads of min_bytes or more, that with the smallest
    page_id is the response and the others revisit it; a repeated row of that
    smallest page_id is a response too. Pages without an id revisit the smallest
    id of their payload, if there is one.
    """
    rows = materialise(pages.select(F.col("page_id").cast("long").alias("id"), F.sha1(_payload().cast("binary")).alias("sha1"), F.octet_length(_payload()).alias("n")), "warc-digests")
    first = materialise(rows.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 AND refers_to IS NOT NULL").drop("c"), "warc-first")
    return materialise(rows.where(F.col("n") >= min_bytes).join(first, "sha1").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "sha1", "refers_to").distinct(), "warc-revisits")


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null html: empty), payload_bytes, digest, record_type, refers_to of every row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), _payload().alias("payload"), F.octet_length(_payload()).cast("long").alias("payload_bytes"), F.sha1(_payload().cast("binary")).alias("sha1"))
    again = revisits(pages, min_bytes).withColumnRenamed("sha1", "_sha1")
    both = rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("_sha1")), "left")
    return both.select("page_id", "url", "payload", "payload_bytes", base32_of_hex(F.col("sha1")).alias("digest"), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, classes: tuple[tuple[int | None, int], ...] = FILE_CLASSES, compressed: bool = True) -> None:
    """One record per row of pages (page_id, url, html; further columns are left alone) under path.

    Heads give page ids as urn:page:<id>; control characters in a url are
    percent-encoded. Repeated rows give repeated records. Archives are gzip files
    unless compressed is False; offsets count in what they hold. Payloads go to a
    folder by their size, whose archives have so many records at most: none
    grows beyond the memory of a task, but for a single very long page.
    """
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, F.col("payload")))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:unknown"))
    urn = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: <urn:page:"), c.cast("string"), F.lit(">\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"), urn("WARC-Record-ID", F.col("page_id")), F.lit("WARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), urn("WARC-Refers-To", F.col("refers_to")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    )
    rows, low = classified(pages, min_bytes), -1
    most = pages.agg(F.max(F.octet_length(_payload()))).first()[0] or 0
    for high, records in classes:
        inside = (F.col("payload_bytes") > low) & (F.lit(True) if high is None else F.col("payload_bytes") <= high)
        if low < 0 or most > low:
            rows.where(inside).withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(f"{path}/to={high}", compression="gzip" if compressed else "none")
        low = high


def candidates(content: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Offset, successor's offset, head and block of whatever looks like a record."""
    for m in _HEAD.finditer(content):
        fields = re.sub(rb"\r\n[ \t]+", b" ", m[1])
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in fields.split(b"\r\n") if line)}
        size = head.get(b"content-length", b"")
        if size.isdigit() and (end := m.end() + int(size)) + len(END) <= len(content) and content.startswith(END.encode(), end):
            yield m.start(), end + len(END), head, content[m.end() : end]


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which of a file's candidates the chain from offset 0 reaches, by pointer jumping.

    offsets: ascending. Raises ValueError if the chain breaks before the file's end.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) if n else np.zeros(0, bool)
    jump = np.append(np.where(hit, at, n), n)
    seen = np.zeros(n + 1, bool)
    seen[0 if n and offsets[0] == 0 else n] = True
    for _ in range(max(n, 1).bit_length() + 1):
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    seen = seen[:n]
    if size and (not seen.any() or successors[seen].max() != size):
        raise ValueError("an archive's chain of records breaks before its end")
    return seen


def _urn(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under path: file, offset, page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    payload is null for a revisit, whose digest and size are those its head
    declares; bytes that are no UTF-8 are replaced in it. An archive is read by
    one task. ValueError stops the read if a file cannot be unpacked, if its
    chain of records breaks before its end (an empty file has none), or if the
    payload of a reachable response lacks the digest that its head declares.
    """
    schema = "file string, offset long, successor long, size long, damaged boolean, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                # a row before all records, so that a file without any is told too
                rows, held = [(file, -1, 0, len(content), False, *[None] * 7)], 0
                for offset, successor, head, block in candidates(content):
                    http, _, payload = block.partition(END.encode())
                    declared = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                    if head.get(b"warc-type") == b"revisit":
                        m = re.search(rb"\r\nContent-Length: (\d+)", http)
                        size, digest, text, damaged = int(m[1]) if m else None, declared, None, False
                    else:
                        size, digest, text = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload.decode("utf-8", "replace")
                        damaged = bool(declared) and digest != declared
                    kind = head.get(b"warc-type", b"").decode("ascii", "replace")
                    rows.append((file, offset, successor, len(content), damaged, _urn(head.get(b"warc-record-id")), kind, head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), size, digest, _urn(head.get(b"warc-refers-to")), text))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        name, size = pdf["file"].iloc[0], int(pdf["size"].iloc[0])
        pdf = pdf[pdf["offset"] >= 0].sort_values("offset")
        try:
            seen = reachable(pdf["offset"].to_numpy(np.int64), pdf["successor"].to_numpy(np.int64), size)
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from None
        if pdf["damaged"][seen].any():
            raise ValueError(f"{name}: the payload at {pdf['offset'][seen][pdf['damaged'][seen]].iloc[0]} lacks its digest")
        return pdf[seen][["file", "offset"]]

    found = materialise(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content").mapInArrow(scan, schema), "warc-candidates")
    links = found.select("file", "offset", "successor", "size", "damaged").groupBy("file").applyInPandas(chain, "file string, offset long")
    return found.join(materialise(links, "warc-reachable"), ["file", "offset"], "left_semi").drop("successor", "size", "damaged")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder (or path) and reads them back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
