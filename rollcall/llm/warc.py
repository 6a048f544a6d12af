"""WARC archives: write one record per page, read them back, put segmented records
together.

Writing: a payload that was seen before (equal bytes, at least ``LEAST`` of them)
becomes a ``revisit`` of the page with the smallest id; every other one a
``response`` whose HTTP body is in chunked transfer framing. A block longer than
``SEGMENT`` bytes is cut: the first segment stays in the response, the rest become
``continuation`` records, the last with the total length. The files are written by
Spark into the shared folder, so their number and size follow the input.

Reading: records are cut out of the files by their stated lengths, continuations are
grouped by origin, put in the order of their segment numbers, checked against the
total length, and the chunked framing is decoded and its digest verified.

Defined results: a null html counts as empty; a null or odd URL is written in
percent-encoding; repeated page ids are records of their own, numbered within the
id; an empty table gives no archive and no rows. A broken record (missing segment,
wrong total, broken framing, wrong digest) raises an error that names its id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import in_batches, shared_dir, stored

#: Bytes that a payload needs to be revisited, of a segment and of a chunk; records
#: of an archive file at most (each is a segment at most).
LEAST, SEGMENT, CHUNK, FILE_RECORDS = 100, 32_768, 8_192, 2_000
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i: i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body. Chunk extensions are skipped, trailers too."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size: at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at: at + size])
        at += size + 2


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + CRLF + CRLF


def record_id(page_id, copy: str, segment: int = 1) -> str:
    return f"<urn:page:{page_id}:{copy}:{segment}>"


def records_of(page: dict, segment: int, chunk: int):
    """Records of one page: (bytes) for each segment."""
    uri = quote(page["url"] or "", safe="%/:=&?~#+!$,;'@()*[]-._")
    base = {"WARC-Type": page["kind"], "WARC-Record-ID": record_id(page["page_id"], page["copy"]), "WARC-Date": DATE, "WARC-Target-URI": uri,
            "WARC-Payload-Digest": f"sha256:{page['digest']}", "Content-Type": "application/http;msgtype=response"}
    if page["kind"] == "revisit":
        base |= {"WARC-Refers-To": f"<urn:page:{page['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record(base, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(page["payload"], chunk)
    if len(block) <= segment:
        yield record(base, block)
        return
    yield record(base | {"WARC-Segment-Number": "1"}, block[:segment])
    cuts = range(segment, len(block), segment)
    for number, at in enumerate(cuts, 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if at + segment >= len(block) else {}
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": record_id(page["page_id"], page["copy"], number), "WARC-Date": DATE, "WARC-Target-URI": uri,
                      "WARC-Segment-Origin-ID": record_id(page["page_id"], page["copy"]), "WARC-Segment-Number": str(number)} | last, block[at: at + segment])


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Add payload, digest, kind and refers_to. The smallest page of each payload is
    found by a partial aggregate over all pages; only payloads that occur again are
    joined, so a payload held by a third of all pages is an ordinary key that
    adaptive execution may split. The narrow side is hashed, so payloads are streamed
    through the join and never sorted."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    again = (
        p.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    p = p.join(again.hint("shuffle_hash"), "digest", "left")
    other = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    return p.select("page_id", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("kind"), F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write archives of ``pages`` (page_id, url, html) to the folder ``path``."""
    spark = pages.sparkSession
    in_batches(spark)
    p = with_revisits(pages, least)

    def build(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page in batch.to_pylist():
                page["copy"], number = f"{task}-{number}", number + 1
                # the text writer ends each row with a line feed, the last byte of a record
                for r in records_of(page, segment, chunk):
                    out.append(r[:-1])
                    size += len(r)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = p.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse(data: bytes):
    """Yield (headers, block) of each record of an archive file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        yield fields, data[start: start + size]
        at = start + size + 4


RECORDS = (
    "record_id string, record_type string, uri string, origin_id string, segment int, total_length long, refers_to_id string, payload_digest string, block binary"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``."""
    in_batches(spark)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 4 + [pa.int32(), pa.int64()] + [pa.string()] * 2 + [pa.binary()]

    def cut(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(zlib.decompress(data.as_py(), 47)):
                    number = int(h.get("warc-segment-number", 0))
                    total = h.get("warc-segment-total-length")
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-segment-origin-id", h["warc-record-id"]), number, int(total) if total else None,
                                 h.get("warc-refers-to"), h.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(cut, RECORDS)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per whole record: segments grouped by origin, in order, checked and
    joined; then the payload out of its framing. Only records in segments are
    shuffled; one group is one page."""
    first = ["record_id", "record_type", "uri", "refers_to_id", "payload_digest", "block"]
    none = "cast(null as array<struct<segment:int,block:binary>>)"
    whole = records.filter("segment = 0 and record_type != 'continuation'").select(*first, F.expr(none).alias("parts"), F.lit(None).cast("long").alias("total"))
    begun = records.filter("segment = 1 and record_type != 'continuation'").select(*first)
    more = (
        records.filter("record_type = 'continuation'")
        .groupBy(F.col("origin_id").alias("record_id"))
        .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total"))
    )
    schema = "record_id string, record_type string, uri string, refers_to_id string, payload_digest string, payload binary"

    def join(batches):
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("record_id", "record_type", "block", "payload_digest", "parts", "total")]
            payloads = []
            for name, kind, block, digest, parts, total in zip(*cols):
                if parts is not None:
                    if [p["segment"] for p in parts] != list(range(2, len(parts) + 2)):
                        raise ValueError(f"{name}: segments are missing")
                    block += b"".join(p["block"] for p in parts)
                    if len(block) != total:
                        raise ValueError(f"{name}: {len(block)} bytes instead of {total}")
                head, _, body = block.partition(b"\r\n\r\n")
                if kind == "revisit":
                    payloads.append(None)
                    continue
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
                    raise ValueError(f"{name}: the payload does not have the stated digest")
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_id"), batch.column("record_type"), batch.column("uri"), batch.column("refers_to_id"), batch.column("payload_digest"), pa.array(payloads, pa.binary())],
                ["record_id", "record_type", "uri", "refers_to_id", "payload_digest", "payload"],
            )

    return whole.unionByName(begun.join(more, "record_id", "left")).mapInArrow(join, schema)


def op5_warc(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and describe each page's record; what a
    revisit stands for comes from the response that it refers to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    back = reassembled(read_warc(spark, path))
    urn = F.split("record_id", ":")
    facts = back.select(
        F.element_at(urn, 3).try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to_id", "page:([0-9-]+)>", 1).try_cast("long").alias("refers_to"),
    )
    facts = stored(facts, "warc-records")
    # a revisit has no payload: its length is that of the response of the page that it
    # refers to, which has to have its digest
    needed = facts.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    origin = (
        facts.filter("record_type = 'response'")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("origin_bytes"))
        .join(needed, ["refers_to", "payload_digest"], "left_semi")
        .dropDuplicates(["refers_to", "payload_digest"])
    )
    out = facts.join(origin, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response with the digest of the revisit of page "), F.col("page_id").cast("string")))
    size = F.coalesce("payload_bytes", "origin_bytes")
    return out.select("page_id", F.when(size.isNull(), lost.cast("long")).otherwise(size).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
     q as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
     f as (select payload_digest, min(page_id) as first_id from q group by 1)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from q join f using (payload_digest)
"""
