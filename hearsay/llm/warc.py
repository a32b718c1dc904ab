"""Web archives: records in segments, and their reassembly.

Pages become WARC/1.1 records. A payload is framed as a chunked HTTP response; blocks over SEGMENT_BYTES go on in
continuation records that name the first one. Of pages with equal payloads of at least REVISIT_BYTES, one is the
response, the others are revisits that refer to it. Archives are gzip files that Spark writes and commits:
each row of the writer is a record, and the record terminator is its line separator.

Reading groups continuation records by the identifier they come from, orders them by segment number, verifies
that none is missing and that the total length is as stated, decodes the chunks and verifies the digest.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id stays null and is
referred to by nothing, so that equal pages without one are all responses; repeated rows each have a record, and
those of the page referred to are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import shared_path, table, written

REVISIT_BYTES = 1000
SEGMENT_BYTES = 8192
CHUNK_BYTES = 2000
#: Bounds an archive, which is read as a whole.
RECORDS_PER_FILE = 4000
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """A record that can't be read or put together."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[at : at + size]), p) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        try:
            size = int(framed[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or size and framed[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ArchiveError("broken chunk")
        if not size:
            return b"".join(out)
        out.append(framed[line + 2 : line + 2 + size])
        at = line + 4 + size


def _header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END


def records(name: str, page_id: int | None, url: str, payload: bytes, digest: str, refers: tuple[str, int] | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without their terminators. name: of the record; refers: name and page_id of the response."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    same = [("WARC-Date", _DATE), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}")]
    own = [("Page-Id", str(page_id))] if page_id is not None else []
    if refers:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Refers-To", f"<{refers[0]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *same, *own, ("Refers-To-Page-Id", str(refers[1]))]
        return [_header(fields, 0)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *same, *own, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [_header(fields, len(block)) + block]
    out = [_header([*fields, ("WARC-Segment-Number", "1")], segment) + block[:segment]]
    for n, at in enumerate(range(segment, len(block), segment), 2):
        part = block[at : at + segment]
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}/{n}>"), *same, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(n))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_header(more, len(part)) + part)
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Archives of all rows of pages (page_id, url, html) below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                shared = f"urn:sha1:{r['digest']}"
                refers = (shared, r["to_page"]) if r["to_page"] is not None and r["page_id"] != r["to_page"] else None
                # others refer to one of the rows of the last page
                named = r["to_page"] is not None and not refers and (r["to_n"] == 1 or r["row"] == r["to_row"])
                out += records(shared if named else f"urn:page-row:{r['row']}", r["page_id"], r["url"] or "", r["payload"], r["digest"], refers, segment)
                if sum(map(len, out[-64:])) > 1 << 22 or len(out) > 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    numbered = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"), F.sha1(payload).alias("digest"))
    pages_of = numbered.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max("row").alias("row"))
    last = pages_of.groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("page_id", "n", "row")).alias("to")).where("all > 1")
    # written, so that its size is known when the join is planned: payloads move only if it is too large for a broadcast
    known, _ = written(last.select(F.col("digest").alias("of"), F.col("to.page_id").alias("to_page"), F.col("to.n").alias("to_n"), F.col("to.row").alias("to_row")), "repeated")
    # short payloads find none; their keys are dealt out
    key = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.col("digest")).otherwise(F.col("row").cast("string"))
    joined = numbered.withColumn("key", key).join(known, F.col("key") == F.col("of"), "left").drop("key", "of")
    rows = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    rows.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names lower-cased, and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        lines = data[at : max(end, at)].split(b"\r\n")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if end < 0 or not lines[0].startswith(b"WARC/") or not length.isdigit():
            raise ArchiveError(f"no record at byte {at}")
        stop = end + 4 + int(length)
        if data[stop : stop + 4] != _END:
            raise ArchiveError(f"record at byte {at} is not terminated")
        yield fields, data[end + 4 : stop]
        at = stop + 4


_PARTS = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("refers_page", pa.int64()), ("block", pa.binary())])
_PARTS_DDL = "origin string, segment int, total long, type string, page_id long, digest string, refers string, refers_page long, block binary"


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            out, size = [], 0
            for f, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                kind = f.get("warc-type", "")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                out.append({"origin": f.get("warc-segment-origin-id") or f.get("warc-record-id"), "segment": _number(f, "warc-segment-number"), "total": _number(f, "warc-segment-total-length"), "type": kind, "page_id": _number(f, "page-id"), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"), "refers": f.get("warc-refers-to"), "refers_page": _number(f, "refers-to-page-id"), "block": block})
                size += len(block)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, _PARTS)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, _PARTS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["segments"]:
                numbers = [s["segment"] for s in r["segments"]]
                block = b"".join(s["block"] for s in r["segments"])
                if numbers != list(range(1, len(numbers) + 1)) or r["total"] != len(block):
                    raise ArchiveError(f"{r['origin']}: segments {numbers}, {len(block)} of {r['total']} bytes")
            else:
                block = r["block"]
            head, _, body = block.partition(_END)
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            if hashlib.sha1(payload).hexdigest() != r["digest"]:
                raise ArchiveError(f"{r['origin']}: the payload is not that of its digest")
            out.append({"record": r["origin"], "page_id": r["page_id"], "payload": payload})
        yield pa.RecordBatch.from_pylist(out, schema)


def read_archives(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Responses (record, page_id, payload) and revisits (page_id, refers, refers_page, digest) of all archives below ``path``.

    Only records in several segments are grouped, each group no more than one record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    parts, _ = written(files.mapInArrow(_parse, _PARTS_DDL), "records")
    responses = parts.where("type <> 'revisit'")
    columns = ["origin", "page_id", "digest", "total", "block", "segments"]
    whole = responses.where("segment is null").withColumn("segments", F.expr("cast(null as array<struct<segment: int, block: binary>>)")).select(columns)
    grouped = (
        responses.where("segment is not null")
        .groupBy("origin")
        .agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"))
        .withColumn("block", F.lit(None).cast("binary"))
        .select(columns)
    )
    decoded = whole.union(grouped).mapInArrow(_decode, "record string, page_id long, payload binary")
    return decoded, parts.where("type = 'revisit'").select("page_id", "refers", "refers_page", "digest")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every page, written and read back."""
    path = shared_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    responses, revisits = read_archives(spark, path)
    sized = responses.select("record", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    sized, _ = written(sized, "responses")
    found = revisits.join(sized.select(F.col("record").alias("refers"), "payload_bytes", "payload_digest"), "refers", "left")
    lost = F.raise_error(F.concat(F.lit("no response of this digest: "), "refers"))
    checked = F.when(F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(False)), F.col("payload_bytes")).otherwise(lost.cast("long"))
    again = found.withColumn("payload_bytes", checked).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("refers_page").alias("refers_to"))
    return sized.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(again)


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM m
"""
