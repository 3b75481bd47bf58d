"""WARC archives: a writer and a splittable reader.

The writer turns rows into one gzip member per record; every task writes one archive and reports it
in a manifest that Spark commits, so archives of lost or repeated task attempts are never read.
Records with equal payloads of at least ``min_bytes`` bytes are written once: the smallest id is a
``response``, the others are ``revisit`` records that refer to it and carry no payload.

The reader cuts archives into byte ranges.  A task searches its range for the gzip magic, and takes a
candidate for a record only if the member there inflates, begins with a WARC version line, has
parsable headers and holds Content-Length bytes.  It owns the records that start inside its range and
reads past its end to finish the last one, so every record is read exactly once for any cutting.

Defined cases: a null payload is an empty one; a null id is written as such and read back as null
(it is a revisit if another row with an id has its payload); rows with equal ids and payloads are all
``response``; an empty table gives no rows; bytes that belong to no record are skipped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
#: Copies of a repeated payload's row in the join that marks revisits.
SALTS = 32
MANIFEST = "archive string, bytes long, records long"
RECORDS = ("archive string, offset long, record_id string, record_type string, target_uri string, "
           "refers_to string, payload_digest string, payload binary")


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _urn(key) -> str:
    return f"<urn:x-page:{key}>"


def _record(key, url, payload: bytes, digest: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + str(url).replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(rows: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, level: int = 5) -> DataFrame:
    """Write archives below ``folder`` and return their manifest (archive, bytes, records)."""
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    pages = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    holders = (pages.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
               .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    holders = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    other = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("first") < F.col("id")))
    marked = pages.join(holders, ["digest", "salt"], "left").select(
        "id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        size = count = 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(*(x.as_py() for x in row))) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    return stored(marked.mapInArrow(write, MANIFEST), f"{folder}-manifest")


def _headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) and where the block begins."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/"):
        return None
    out = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit() or "warc-type" not in out:
        return None
    return out, end + 4


def _member(stream, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, length of the member) of a record that starts at ``at``, else None."""
    inflate = zlib.decompressobj(31)
    stream.seek(at)
    parts, read = [], 0
    try:
        while not inflate.eof:
            data = stream.read(min(READ_BYTES, max(4096, 4 * read)))
            if not data:
                return None
            read += len(data)
            parts.append(inflate.decompress(data))
            if not parts[0].startswith(b"WARC/"[:len(parts[0])]):
                return None
    except zlib.error:
        return None
    raw = b"".join(parts)
    head = _headers(raw)
    if head is None:
        return None
    fields, start = head
    length = int(fields["content-length"])
    if len(raw) < start + length:
        return None
    return fields, raw[start:start + length], read - len(inflate.unused_data)


def records_in(stream, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    at, step = start, 4096  # the next record mostly begins right here; search in larger steps only where it doesn't
    while at < end:
        stream.seek(at)
        window = stream.read(min(step, end - at) + len(MAGIC) - 1)
        if len(window) < len(MAGIC):
            return
        found = window.find(MAGIC)
        if found < 0:
            at, step = at + len(window) - len(MAGIC) + 1, READ_BYTES
            continue
        at += found
        if at >= end:
            return
        member = _member(stream, at)
        if member is None:
            at += 1
            continue
        yield at, member[0], member[1]
        at, step = at + member[2], 4096


def _payload(block: bytes) -> bytes:
    """The body behind the HTTP head of a record's block."""
    end = block.find(b"\r\n\r\n")
    return block[end + 4:] if end >= 0 else block


def _own(urn: str | None) -> str | None:
    key = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return key if key and key != "None" else None


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the archives in a manifest (archive, bytes); see RECORDS."""
    spark = archives.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = archives.select("archive", "bytes", starts.alias("start"))
    n = max(1, archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    ranges = ranges.repartition(min(int(n), 100_000), "archive", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                            ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for archive, size, start in zip(*(batch.column(c).to_pylist() for c in ("archive", "bytes", "start")), strict=True):
                store, path = _open(archive)
                with store.open_input_file(path) as stream:
                    for offset, fields, block in records_in(stream, start, min(size, start + split_bytes)):
                        kind = fields["warc-type"]
                        payload = None if kind == "revisit" else _payload(block)
                        digest = (fields.get("warc-payload-digest", "").removeprefix("sha1:") if payload is None
                                  else base64.b32encode(hashlib.sha1(payload).digest()).decode())
                        rows.append((archive, offset, _own(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"),
                                     _own(fields.get("warc-refers-to")), digest, payload))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return ranges.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, *, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES, **columns) -> DataFrame:
    """Write ``pages`` as archives, read them back; one row per record with sizes and digests of the full payloads."""
    work = shared_dir(pages.sparkSession)
    manifest = write_warc(pages, f"{work}/warc", min_bytes=min_bytes, **columns)
    records = stored(read_warc(manifest, split_bytes).select(
        F.col("record_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")), f"{work}/records")
    full = (records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("bytes").alias("full_bytes")).distinct())
    return records.join(full, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages)


def _base32_sql(hexadecimal: str) -> str:
    """Bare upper-case base32 of a 40-digit hexadecimal number: five digits are four letters."""
    letters = []
    for k in range(8):
        five = f"CAST('0x' || substr({hexadecimal}, {5 * k + 1}, 5) AS INTEGER)"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


OP2_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN first < page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
FROM f
"""
