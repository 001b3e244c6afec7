r"""Operator 6: WARC archives with segmented records, written and read back.

Writing: equal payloads are found by their SHA-256; of those long enough, the one with the largest page
id is a response and the others revisit it. A response's block is an HTTP message with chunked framing; a block
longer than a segment goes on in continuation records. Each record is a gzip member of its own and a row of Spark's text
writer, so archives are real WARC files made under Spark's commit protocol, of a bounded number of bounded records. Which rows
are revisits is found on digests and lengths alone; payloads move only if that list is too long for Catalyst to broadcast.

Reading: each archive is parsed where it is read, record by record as its members (one or many) are decompressed. Whole records
are decoded at once; segments are dealt by origin identifier, ordered by segment number, checked against the total
length, joined and decoded. Only one document's segments are held at a time, so a very long page costs its own length.

Defined results: a null page is an empty payload; a null page id stays null and is smaller than any
other. Of equal rows with the same largest id, one is the response. Damaged or missing segments, bad
framing and digests that do not hold raise an error (``strict``) or are told in ``problem``. An empty table gives no records and
no rows. page_id, url and html are selected by name, so other columns may have any names. ``pages`` is read twice: a stored table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

RECORD_END = b"\r\n\r\n"
FEED_BYTES = 65_536
SEGMENT_BYTES = 16_384
RECORDS_PER_ARCHIVE = 4096
CHUNK_BYTES = 4096
LEAST_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is not whole."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        if not size:
            return b"".join(parts)
        parts.append(body[line + 2 : at])
        at += 2


def decode_http(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP message, and its Content-Length if told."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body), None
    return body, int(fields[b"content-length"]) if b"content-length" in fields else None


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(row, page_id, url, payload, n, digest, keep, keep_row): keep is the response that a revisit refers to; it has no payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
    )
    n = F.octet_length("payload")
    long = rows.filter(n >= least).select("row", "page_id", n.alias("n"), F.unhex(F.sha2("payload", 256)).alias("same"))
    groups = (
        long.groupBy("same", "n").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("many"))
        .filter("many > 1").select(F.col("same").alias("g_same"), F.col("n").alias("g_n"), "last")
    )
    revisits = long.join(groups, (F.col("same") == F.col("g_same")) & (F.col("n") == F.col("g_n"))).filter("row <> last.row")
    # Stored, so that its size is known where the join below is planned.
    revisits = common.stage(
        revisits.select(F.col("row").alias("r_row"), F.col("last.page_id").alias("keep"), F.col("last.row").alias("keep_row")), "revisits"
    )
    return rows.join(revisits, F.col("row") == F.col("r_row"), "left").select(
        "row", "page_id", "url", F.when(F.col("keep_row").isNull(), F.col("payload")).alias("payload"), n.cast("long").alias("n"),
        F.sha1("payload").alias("digest"), "keep", "keep_row",
    )


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records: int = RECORDS_PER_ARCHIVE,
                   least: int = LEAST_REVISIT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives under ``path``."""

    def name(page_id: int | None, row: int, part: int = 1) -> str:
        return f"<urn:page:{'' if page_id is None else page_id}:{row}{f':{part}' if part > 1 else ''}>"

    def record(fields: dict[str, str], block: bytes) -> bytes:
        clean = {k: v.replace("\r", " ").replace("\n", " ") for k, v in fields.items()}
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()) + f"Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block

    def records_of(row: int, page_id: int | None, url: str, payload: bytes | None, n: int, digest: str, keep: int | None,
                   keep_row: int | None) -> Iterator[bytes]:
        fields = {
            "WARC-Type": "response" if keep_row is None else "revisit", "WARC-Record-ID": name(page_id, row),
            "WARC-Target-URI": url, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        }
        if keep_row is not None:
            more = {"WARC-Refers-To": name(keep, keep_row), "WARC-Profile": PROFILE}
            yield record(fields | more, _HTTP + b"Content-Length: %d\r\n\r\n" % n)
            return
        block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
        if len(block) <= segment_bytes:
            yield record(fields, block)
            return
        parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
        yield record(fields | {"WARC-Segment-Number": "1"}, parts[0])
        for k, part in enumerate(parts[1:], 2):
            more = {"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}
            yield record({
                "WARC-Type": "continuation", "WARC-Record-ID": name(page_id, row, k), "WARC-Date": fields["WARC-Date"],
                "WARC-Target-URI": url, "WARC-Segment-Origin-ID": name(page_id, row), "WARC-Segment-Number": str(k),
            } | more, part)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                columns = [c.to_pylist() for c in batch.slice(start, 256).columns]
                made = [member(r + RECORD_END) for row in zip(*columns, strict=True) for r in records_of(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    # A member's last byte is that of its length, 0 below 16 MB: it is the line separator. The bytes pass the writer as they are.
    written = plan_records(pages, least).mapInArrow(build, "record binary").select(F.col("record").cast("string"))
    written.write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


def member(record: bytes) -> bytes:
    """The record as a gzip member, without the zero byte that ends it; one of 16 MB and more is followed by an empty member."""
    made = gzip.compress(record, 6, mtime=0)
    return (made if not made[-1] else made + gzip.compress(b"", mtime=0))[:-1]


def decompressed(content: bytes) -> Iterator[bytes]:
    """The archive's bytes piece by piece, whether it is one gzip member, many, or not compressed."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + FEED_BYTES]
            yield unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields by lower-case name, and the block."""
    held, need, fields, start = bytearray(), 0, None, 0
    for piece in decompressed(content):
        held += piece
        at = 0
        while len(held) - at >= need:
            if fields is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                lines = held[at:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                start = end + 4 - at
                need = start + int(fields["content-length"]) + 4
            else:
                if held[at + need - 4 : at + need] != RECORD_END:
                    raise ValueError("a record is cut short")
                yield fields, bytes(held[at + start : at + need - 4])
                at, need, fields = at + need, 0, None
        del held[:at]
    if held:
        raise ValueError("a record is cut short")


def read_archives(spark: SparkSession, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, problem) of each archived page.

    An archive is read by one task, which holds it whole; one of more than 2 GB, such as ``write_archives`` never makes, must be split before. Without ``payloads`` they are decoded and checked, but not returned (null).
    """
    raw = "origin string, segment long, total long, kind string, url string, digest string, refers string, block binary"
    out = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
        "payload binary, problem string"
    )

    def page_of(uri: str | None) -> int | None:
        parts = (uri or "").strip("<>").split(":")
        return int(parts[2]) if len(parts) > 2 and parts[2] else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments, as they are."""
        common.trim()
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in
                            (x.split() for x in raw.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                for rows in some((f, block) for f, block in parse_archive(content.as_py()) if "warc-segment-number" in f):
                    made = [(
                        f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]),
                        int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f["warc-type"],
                        f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), block,
                    ) for f, block in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)

    def some(records: Iterator[tuple]) -> Iterator[list[tuple]]:
        """The records in lists that are bounded in number and, but for a longer record, in bytes."""
        rows, size = [], 0
        for record in records:
            if rows and (len(rows) == 512 or size + len(record[1]) > FEED_BYTES * 256):
                yield rows
                rows, size = [], 0
            rows.append(record)
            size += len(record[1])
        if rows:
            yield rows

    def page(origin: str, kind: str, url: str | None, digest: str | None, refers: str | None, block: bytes, problem: str | None) -> tuple:
        told = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None
        payload, n, found = None, None, told
        if not problem:
            try:
                payload, length = decode_http(block)
                if kind == "revisit":
                    payload, n = None, length
                else:
                    n, found = len(payload), hashlib.sha1(payload).hexdigest()
                    if told not in (None, found):
                        problem = "the digest does not hold"
            except ValueError as fault:
                problem = str(fault)
        if problem and strict:
            raise ValueError(f"{origin}: {problem}")
        return page_of(origin), n, found, kind, page_of(refers) if kind == "revisit" else None, url, payload if payloads else None, problem

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = [x.split()[0] for x in out.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for content in batch.column(0):
                # Other record types (warcinfo, request, metadata) hold no page.
                whole_ones = ((f, block) for f, block in parse_archive(content.as_py())
                              if "warc-segment-number" not in f and f["warc-type"] in ("response", "revisit"))
                for rows in some(whole_ones):
                    yield rows_out([
                        page(f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-payload-digest"),
                             f.get("warc-refers-to"), block, None)
                        for f, block in rows
                    ])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        first, parts, total, fault = None, [], None, None

        def done() -> tuple:
            problem = fault
            if total is None or total != sum(map(len, parts)):
                problem = problem or "the segments do not add up to the total length"
            return page(first[0], first[3], *first[4:7], b"".join(parts), problem)

        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first is None or row[0] != first[0]:
                    if first:
                        rows.append(done())
                    first, parts, total, fault = row, [], None, None
                if row[1] != len(parts) + 1:
                    fault = "a segment is missing or repeated"
                parts.append(row[7])
                total = row[2] if row[2] is not None else total
            yield rows_out(rows)
        if first:
            yield rows_out([done()])

    archives = spark.read.format("binaryFile").load(path).select("content")
    segments = archives.mapInArrow(parse, raw).repartition("origin").sortWithinPartitions("origin", "segment")
    return archives.mapInArrow(whole, out).unionAll(segments.mapInArrow(assemble, out))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.staging_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.keep IS NULL OR g.keep = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keep <> d.page_id THEN g.keep END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
