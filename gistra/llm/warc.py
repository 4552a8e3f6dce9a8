"""WARC archives of pages: segmented records written by Spark, read back, reassembled and decoded.

Writing: every page becomes a record. Of pages with equal payloads the one with the largest id becomes a
``response``, the others ``revisit`` records that refer to it. A response block is an HTTP message in chunked
transfer framing; blocks beyond ``SEGMENT`` bytes, or with a record's first line inside, go out as a first
segment and ``continuation`` records. Spark's text sink writes the archives (gzip), so they go to any file system.

Reading: Spark's text source splits archives at the first line of records, which segmentation keeps out of
blocks. That separator can't overlap itself, so a reader that meets half of it at a buffer's edge finds it
too; what stands before it is cut to its Content-Length, and anything but line ends beyond that raises.
Continuations are grouped by origin identifier, ordered by segment number, and their total length verified;
then the chunked framing is decoded and the payload's digest compared with the header's.

Scale: only digests are grouped (partial aggregation). Pages move once, by id and digest, so that a payload
that a third of all pages have is spread by their ids; only segmented records are shuffled at reassembly, a
record at a time. Archive files are bounded by a record count.

Defined cases: null html is an empty payload; repeated rows (same id and payload) are a record each, told
apart by a number in the record id, and all responses if their id is the largest; a null url has no target
header; null ids are kept, and are responses only if no equal payload has an id; extra columns are dropped; an
empty table gives an empty result. Broken records raise.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistra.llm.text import column, slices
from gistra.staging import cut, discard, fresh_path, remove

VERSION = b"WARC/1.1"
SEPARATOR = VERSION + b"\r\n"
SEGMENT, CHUNK, FILE_RECORDS = 32 << 10, 4 << 10, 4000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, turn: int = 1) -> str:
    """The id of a page's record; ``turn`` counts rows of one id and payload."""
    name = f"{page_id}/{payload_digest}" if turn == 1 else f"{page_id}/{payload_digest}/{turn}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for i in range(0, len(payload), CHUNK) if (c := payload[i : i + CHUNK])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 2 + n
        if len(out[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        at += 2


def segments(block: bytes) -> list[bytes]:
    """Cut a block so that no piece, with the line end that follows it in an archive, holds the record separator."""
    marks = [m.start() + 4 for m in re.finditer(rb"WARC/1\.1(?=\r\n|\r?\Z)", block)]
    cuts, at = [], 0
    while at < len(block):
        k = bisect_right(marks, at)
        stop = min(at + SEGMENT, len(block), *marks[k : k + 1])
        for tail in (VERSION, VERSION + b"\r"):
            if block[at:stop].endswith(tail):
                stop -= len(tail) - 4
        cuts.append(block[at:stop])
        at = stop
    return cuts or [b""]


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line end, which the sink adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return SEPARATOR + head.encode() + b"\r\n" + block + b"\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, response: bool, turn: int = 1) -> list[bytes]:
    code = digest(payload)
    # a header's value must not end a line as a record's first line does
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url).replace("WARC/", "WARC%2F") if url is not None else None
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{code}"), ("Content-Type", "application/http; msgtype=response")]
    own = record_id(page_id, code, turn)
    if not response:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id(refers_to, code)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *shared], b"")]
    block = HTTP + chunked(payload)
    parts = segments(block)
    number = lambda i: [("WARC-Segment-Number", i + 1)] if len(parts) > 1 else []
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, *number(0)], parts[0])]
    for i, p in enumerate(parts[1:], 1):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) - 1 else []
        rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, own + str(i))}>"
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), *number(i), *total], p))
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of what stands between two separators."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n"))}
    n = int(fields["content-length"])
    if not found or len(rest) < n or rest[n:].strip(b"\r\n"):
        raise ValueError(f"record {fields.get('warc-record-id')}: block has {len(rest)} bytes, header says {n}")
    return fields, rest[:n]


def decode(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each page to gzip archives under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body"))
    own = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.col("sha"))
    keyed = rows.select("id", F.sha1("body").alias("sha"))
    last = keyed.groupBy("sha").agg(F.max("id").alias("last"))
    roles = keyed.distinct().join(last, "sha").select(own.alias("own"), "last")
    # the pages themselves move once: rows of one id and payload are numbered and joined where they then are
    moved = rows.withColumn("sha", F.sha1("body")).select("id", "url", "body", own.alias("own")).repartition("own")
    whole = moved.withColumn("turn", F.row_number().over(Window.partitionBy("own").orderBy("url"))).join(roles, "own")

    def build(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                out = []
                for i, url, body, turn, top in zip(*(column(part, c).to_pylist() for c in ("id", "url", "body", "turn", "last"))):
                    out += page_records(i, url, body, top, i == top and (i is not None or turn == 1), turn)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = whole.select("id", "url", "body", "turn", "last").mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = "rid string, type string, id long, refers string, code string, segment int, total long, origin string, block binary, n long, found string"


def read_archives(spark, path: str) -> DataFrame:
    """Records of the archives under ``path``, whole: rid, type, id, refers, code (from the header), n, found (of the payload)."""
    raw = spark.read.option("lineSep", SEPARATOR.decode()).text(path).filter("value <> ''").select(F.col("value").cast("binary").alias("raw"))

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "raw"):
                out = []
                for text in column(part, "raw").to_pylist():
                    f, block = parse(text)
                    get = f.get
                    cutup = "warc-segment-number" in f
                    payload = decode(block) if get("warc-type") == "response" and not cutup else None
                    out.append((get("warc-record-id"), get("warc-type"), int(get("page-id")) if get("page-id") else None, get("warc-refers-to"), (get("warc-payload-digest") or "").removeprefix("sha1:") or None, int(get("warc-segment-number")) if cutup else None, int(get("warc-segment-total-length")) if get("warc-segment-total-length") else None, get("warc-segment-origin-id") or get("warc-record-id"), block if cutup else None, None if payload is None else len(payload), None if payload is None else digest(payload)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=types)

    names = [x.split()[0] for x in RECORD.split(", ")]
    types = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
    parsed = cut(raw.mapInArrow(rows, RECORD), "records")  # without payloads: small but for segments
    whole = parsed.filter("segment IS NULL").select("rid", "type", "id", "refers", "code", "n", "found")
    pieces = parsed.filter("segment IS NOT NULL").groupBy("origin").agg(
        F.min_by(F.struct("rid", "type", "id", "refers", "code"), "segment").alias("first"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces")
    )

    def join(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if [p["segment"] for p in row["pieces"]] != list(range(1, len(row["pieces"]) + 1)):
                    raise ValueError(f"{row['origin']}: segments are missing or repeated")
                block = b"".join(p["block"] for p in row["pieces"])
                if len(block) != row["total"]:
                    raise ValueError(f"{row['origin']}: {len(block)} bytes, {row['total']} announced")
                payload = decode(block)
                out = row["first"] | {"n": len(payload), "found": digest(payload)}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([types.field(c) for c in ("rid", "type", "id", "refers", "code", "n", "found")]))

    records = cut(whole.unionByName(pieces.mapInArrow(join, "rid string, type string, id long, refers string, code string, n long, found string")), "read")
    discard(parsed)
    return records


def resolved(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each page: payload size and digest, record type and, for revisits, the response's page."""
    ok = F.when(F.col("found") != F.col("code"), F.raise_error(F.concat(F.lit("payload digest of "), "rid"))).otherwise(F.col("found"))
    responses = records.filter("type = 'response'").select("rid", "id", "n", ok.alias("code"))
    revisits = records.filter("type = 'revisit'").select(F.col("id").alias("own"), F.col("refers"), F.col("code").alias("said"))
    back = revisits.join(responses, F.col("refers") == F.col("rid"), "left")
    known = F.when(~F.col("said").eqNullSafe(F.col("code")), F.raise_error(F.concat(F.lit("no response for revisit "), F.col("own").cast("string")))).otherwise(F.col("code"))
    one = responses.select(F.col("id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("code").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return one.unionByName(back.select(F.col("own").alias(id_col), F.col("n").alias("payload_bytes"), known.alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("id").alias("refers_to")))


def query(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_archives(spark, path)
    remove(spark, path)
    return resolved(records)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || sha[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM q
"""
