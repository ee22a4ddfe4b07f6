"""WARC archives: write pages as records, read records back.

Writing: a page becomes one record; of pages with equal payloads of at least ``revisit_bytes`` the one with the smallest id is
a ``response`` and the others are ``revisit`` records that name it.  The block is an HTTP response in chunked transfer
framing.  A block longer than ``segment_bytes`` is cut into a first record and ``continuation`` records.  Spark's text writer
puts the files in place: a record ends with CRLF CRLF, which is the writer's line end, so a file is WARC/1.1, compressed as a whole.

Reading: records are parsed by their Content-Length.  Records that stand alone are done where they are read; segments are
grouped by origin id, ordered by number and joined, their total length is checked against the declared one, and then the
chunked framing is taken off.

Null payloads are empty ones.  Rows may repeat: rows that share the smallest id of their payload are all responses.  Null
ids come last, so a payload that only null ids have is a response for each of them.  An empty table gives an archive without
records.  Columns besides id, url and payload are left out.  A long page is as long in memory as its payload, no longer:
files are bounded by ``records_per_file`` segments.
"""
from __future__ import annotations

import gzip
import hashlib
import uuid
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import shared_folder

CRLF = b"\r\n"
PARTS = ("page_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, origin string, segment int, "
         "total bigint, block binary")
PAGES = "page_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, verified boolean"


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """Pages with the digest of their payload and, for revisits, the page they refer to.

    The first page of a payload is a minimum, which combines before the shuffle; only payloads that several pages have take
    part in the join, whose skewed digests Spark splits."""
    keyed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"),
                         F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    shared = (keyed.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id"))
    told = keyed.join(shared, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return told.select("page_id", "url", F.when(other, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes",
                       F.when(other, F.col("first_id")).alias("refers_to"), F.when(~other, F.col("payload")).alias("payload"))


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; raises if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            break
        if framed[at + n:at + n + 2] != CRLF or at + n + 2 > len(framed):
            raise ValueError("a chunk does not end where its length says")
        out.append(framed[at:at + n])
        at += n + 2
    while True:                                      # trailer fields, up to the empty line
        end = framed.index(CRLF, at)
        if end == at:
            return b"".join(out)
        at = end + 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _plain(value: str | None) -> str | None:
    """A header value without line ends."""
    return None if value is None else " ".join(value.split())


def records(resolved: DataFrame, segment_bytes: int = 1 << 15, chunk_bytes: int = 4096, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """``record string``: the bytes of each record without its closing line ends, in the order of writing."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for p in b.to_pylist():
                # the row's own number tells repeated rows apart; all records of a page are made by one task
                own = hashlib.sha256(f"{p['row']}|{p['page_id']}|{p['payload_digest']}".encode()).digest()
                name = f"<urn:uuid:{uuid.UUID(bytes=own[:16])}>"
                if p["record_type"] == "revisit":
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % p["payload_bytes"]
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(p["payload"] or b"", chunk_bytes)
                cuts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                fields = [("WARC-Type", p["record_type"]), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _plain(p["url"])),
                          ("WARC-Payload-Digest", "sha256:" + p["payload_digest"]), ("X-Page-ID", p["page_id"]), ("X-Refers-To-Page", p["refers_to"]),
                          ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if p["record_type"] == "revisit" else None),
                          ("WARC-Segment-Number", "1" if len(cuts) > 1 else None), ("Content-Type", "application/http;msgtype=response")]
                out.append(_record(fields, cuts[0]))
                for k, c in enumerate(cuts[1:], 2):
                    part = hashlib.sha256(own + k.to_bytes(8, "big")).digest()
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=part[:16])}>"), ("WARC-Date", date),
                                        ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)),
                                        ("WARC-Segment-Total-Length", str(len(block)) if k == len(cuts) else None)], c))
                held += len(block)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = resolved.select(F.col("page_id").cast("string").alias("page_id"), "url", "record_type", "payload_digest", "payload_bytes",
                           F.col("refers_to").cast("string").alias("refers_to"), "payload", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("record"))


def write(resolved: DataFrame, path: str, segment_bytes: int = 1 << 15, records_per_file: int = 2048, **how) -> None:
    """WARC files under ``path``.  Files hold at most ``records_per_file`` records, hence a bounded number of bytes."""
    (records(resolved, segment_bytes, **how).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").mode("error").text(path))


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file."""
    at = 0
    while at < len(content):
        if content[at:at + 2] == CRLF:               # line ends after a record
            at += 2
            continue
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = content[end + 4:end + 4 + n]
        if len(block) != n:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + n


def parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, segments still apart."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, held = [], 0
                raw = content.as_buffer().to_pybytes()
                for f, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    n = f.get("warc-segment-number")
                    out.append({"page_id": f.get("x-page-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"],
                                "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha256:") or None, "payload_bytes": None, "refers_to": f.get("x-refers-to-page"),
                                "origin": f.get("warc-segment-origin-id") or f["warc-record-id"], "segment": int(n) if n else None,
                                "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "block": block})
                    held += len(block)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(split, PARTS)


_PARTS = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def reassemble(split: DataFrame) -> DataFrame:
    """Segments joined to whole records.  A group is the segments of one record; a gap in the numbers, a missing last segment
    or a wrong total length raises."""
    alone = split.where("segment IS NULL").drop("segment", "total", "origin")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment", kind="stable")
        head, block = group.iloc[0], b"".join(group["block"])
        if list(group["segment"]) != list(range(1, len(group) + 1)):
            raise ValueError(f"segments of {head['origin']} are missing or repeat: {list(group['segment'])[:20]}")
        if pd.isna(group["total"].iloc[-1]) or int(group["total"].iloc[-1]) != len(block):
            raise ValueError(f"the segments of {head['origin']} have {len(block)} bytes, not {group['total'].iloc[-1]}")
        out = group.iloc[:1].copy()
        out["block"] = [block]
        return out.drop(columns=["segment", "total", "origin"])

    schema = ", ".join(f"{x} {y}" for x, y in (c.rsplit(" ", 1) for c in PARTS.split(", ")) if x not in ("segment", "total", "origin"))
    whole = split.where("segment IS NOT NULL").groupBy("origin").applyInPandas(join, schema)
    return alone.unionByName(whole)


def decode(whole: DataFrame) -> DataFrame:
    """Payloads with their framing taken off, measured anew; ``verified``: the digest is the one that the header states.
    Revisits hold no payload; length and digest are those stated."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.to_pylist():
                head, _, rest = p.pop("block").partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                if p["record_type"] == "revisit":
                    p |= {"payload": None, "payload_bytes": int(fields[b"content-length"]), "verified": None}
                else:
                    payload = unchunked(rest) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else rest
                    digest = hashlib.sha256(payload).hexdigest()
                    p |= {"payload": payload, "payload_bytes": len(payload), "verified": p["payload_digest"] in (None, digest), "payload_digest": digest}
                out.append(p)
            yield pa.RecordBatch.from_pylist(out, schema=_PAGES)

    return whole.mapInArrow(body, PAGES)


_PAGES = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.string()), ("payload", pa.binary()), ("verified", pa.bool_())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives under ``path`` as pages."""
    got = decode(reassemble(parts(spark, path)))
    return got.withColumns({"page_id": F.col("page_id").cast("bigint"), "refers_to": F.col("refers_to").cast("bigint")})


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the pages to a new place in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(resolve(pages), path, **how)
    return read(spark, path)
