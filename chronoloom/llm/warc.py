"""WARC archives: writing captures, reading records back, assembling transactions.

A page is archived as a request, a response (or a revisit of an equal payload) and a
metadata record; the request and the metadata name the response in WARC-Concurrent-To.
Spark's own text writer puts the bytes of the records into gzipped files of about
FILE_BYTES, so archives can lie in any store that Spark writes to, and a lost task's file is
written anew. Spark's text reader streams archives, split where the next record's version
line may begin, and a parser on each file's stream takes records by their length: archives
of any size are read, plain or gzipped (as a whole or by record, known by the name's end),
with memory for one record. The records of a transaction are joined through their
concurrent-to identifiers into one nested row per capture.

A record without a valid length, type or identifier is skipped, and one that its file cuts
short; the reader goes on with the next one that starts after it. A length that is too large
takes the records that it covers with it. A plain archive of several splits whose payload
holds a whole record of its own may show that one if a split starts within the payload.

A null payload is the empty payload; a null url gives records without a target. Of
records with equal payloads the one with the smallest page id is the response (all rows
that share that id); a null page id counts as larger than any other. Rows are never
merged: each page row is one capture. Other columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from ..shared import forget, materialise, new_path
from .pieces import bound_batches

#: Bytes of payload in one archive file, on the average, and captures at most.
FILE_BYTES, CAPTURES_A_FILE = 64 << 20, 4096
#: What a record starts with; the text reader takes archives apart there.
START = b"WARC/1."
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, record_id string, type string, target string, concurrent_to array<string>, refers_to string, payload_digest string, headers map<string,string>, content_type string, status int, payload_bytes long, payload binary, fields map<string,string>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@arrow_udf(StringType())
def payload_digest(payloads: pa.Array) -> pa.Array:
    """Bare upper-case base32 SHA-1."""
    return pa.array([base32_sha1(p or b"") for p in payloads.to_pylist()], pa.string())


def record(kind: str, record_id: str, target: str | None, content_type: str, block: bytes, **more: str | None) -> bytes:
    """One record with its closing blank lines; named fields with ``None`` are left out."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": target}
    fields |= {k.replace("_", "-"): v for k, v in more.items()} | {"Content-Type": content_type, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _urn(*parts) -> str:
    h = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


@arrow_udf(BinaryType())
def capture_records(row: pa.Array, page_id: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, first: pa.Array) -> pa.Array:
    """The three records of each page, one after the other."""
    out = []
    for n, page, link, body, sha, origin in zip(*(a.to_pylist() for a in (row, page_id, url, payload, digest, first))):
        target, main, body = _clean(link), _urn("response", n), body or b""
        path = "/" + (target or "").partition("://")[2].partition("/")[2]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        if origin is None:
            answer = record("response", main, target, "application/http; msgtype=response", http + body, WARC_Payload_Digest=f"sha1:{sha}")
        else:
            answer = record("revisit", main, target, "application/http; msgtype=response", http, WARC_Payload_Digest=f"sha1:{sha}", WARC_Profile=SAME_PAYLOAD, WARC_Refers_To=f"<urn:page:{origin}>")
        request = record("request", _urn("request", n), target, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\n\r\n".encode(), WARC_Concurrent_To=f"<{main}>")
        about = b"" if page is None else f"page_id: {page}\r\n".encode()
        out.append(request + answer + record("metadata", _urn("metadata", n), target, "application/warc-fields", about, WARC_Concurrent_To=f"<{main}>"))
    return pa.array(out, pa.binary())


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archive every page under ``path``. Equal payloads of ``least_bytes`` or more are stored once."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", payload_digest("payload"))
    large = F.octet_length("payload") >= least_bytes
    # combined before the shuffle; only payloads with a second page id stay, and no payload travels
    firsts = materialise(rows.where(large).select("digest", "page_id").groupBy("digest")
                         .agg(F.min("page_id").alias("origin"), F.max("page_id").alias("last"), F.count_if(F.isnull("page_id")).alias("unnamed"))
                         .where("origin < last or (unnamed > 0 and origin is not null)").select("digest", "origin"), "firsts")
    known = rows.join(firsts, "digest", "left")
    revisits = F.col("origin").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("origin"))
    known = known.withColumn("origin", F.when(revisits, F.col("origin"))).withColumn("row", F.monotonically_increasing_id())
    blob = capture_records("row", "page_id", "url", "payload", "digest", "origin")
    # every record ends in a line feed: the writer's line end is the last byte of each row
    lines = known.select(blob.alias("b")).select(F.expr("cast(substring(b, 1, octet_length(b) - 1) as string)").alias("value"))
    mean = rows.agg(F.avg(F.octet_length("payload")).alias("n")).first().n or 0
    captures = max(1, min(CAPTURES_A_FILE, FILE_BYTES // (int(mean) + 1024)))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


def _fields(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if _]


class RecordStream:
    """The records of one archive from its bytes, taken apart at START."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.fields, self.begin, self.missing = [], 0, 0

    def feed(self, piece: bytes):
        """(fields, block) of the record that this piece completes, or None."""
        if self.pieces:
            self.pieces += [START, piece]
            self.missing -= len(START) + len(piece)
        else:
            stop = piece.find(b"\r\n\r\n")
            fields = _fields(piece[piece.find(b"\r\n") + 2 : stop]) if stop > 0 and piece[1:3] == b"\r\n" else []
            named = {k.lower(): v for k, v in fields}
            size = named.get("content-length", "")
            if not (size.isascii() and size.isdigit() and named.get("warc-type") and named.get("warc-record-id")):
                return None  # not a record: what comes next starts anew
            self.pieces, self.fields, self.begin, self.missing = [piece], fields, stop + 4, stop + 4 + int(size) - len(piece)
        if self.missing > 0:
            return None  # the block holds START itself
        data = self.pieces[0] if len(self.pieces) == 1 else b"".join(self.pieces)
        block = data[self.begin : len(data) + self.missing]
        self.pieces = []
        return self.fields, block


def parse_archive(data: bytes):
    """(fields, block) of each record of an archive, compressed as a whole, by record, or not at all."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    stream = RecordStream()
    for piece in data.split(START):
        if found := stream.feed(piece):
            yield found


def _bare(name: str | None) -> str | None:
    return None if name is None else name.strip().removeprefix("<").removesuffix(">")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``, with the parsed HTTP payload."""
    bound_batches(spark)
    pieces = spark.read.option("lineSep", START.decode()).option("recursiveFileLookup", "true").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    schema = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content_type", pa.string()), ("status", pa.int32()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])

    def parse(batches):
        file, stream, rows, held = None, RecordStream(), [], 0
        for batch in batches:
            for name, piece in zip(batch["file"].to_pylist(), batch["piece"]):
                if name != file:
                    file, stream = name, RecordStream()
                if found := stream.feed(piece.as_py()):
                    fields, block = found
                    named = {k.lower(): v for k, v in fields}
                    http, body, status = {}, block, None
                    if named.get("content-type", "").startswith("application/http"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        first, _, head = head.partition(b"\r\n")
                        http = {k.lower(): v for k, v in _fields(head)}
                        word = first.split(b" ")[1:2]
                        status = int(word[0]) if first.startswith(b"HTTP/") and word and word[0].isdigit() else None
                    revisit = named.get("warc-type") == "revisit"
                    length = int(http["content-length"]) if revisit and http.get("content-length", "").isdecimal() else len(body)
                    about = dict(_fields(block)) if named.get("content-type") == "application/warc-fields" else {}
                    rows.append({
                        "file": name, "record_id": _bare(named.get("warc-record-id")), "type": named.get("warc-type"), "target": named.get("warc-target-uri"),
                        "concurrent_to": [_bare(v) for k, v in fields if k.lower() == "warc-concurrent-to"], "refers_to": _bare(named.get("warc-refers-to")),
                        "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(body) if named.get("warc-type") == "response" else None,
                        "headers": list(named.items()), "content_type": named.get("content-type"), "status": status, "payload_bytes": length, "payload": None if revisit else body, "fields": list(about.items()),
                    })
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pieces.mapInArrow(parse, RECORD)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata.

    A capture is a response or revisit. A record belongs to it if either names the other
    in WARC-Concurrent-To. Captures without request or metadata keep nulls; of several
    requests or metadata records the one with the smallest id is taken. Records that name
    no capture are not part of any. Without ``payloads`` the archives are parsed once and
    the payload stays null; with them they are parsed again for the payloads.
    """
    heads = materialise(records.withColumn("fields", F.map_entries("fields")).drop("headers", "payload", "file"), "records")
    main = heads.where(F.col("type").isin("response", "revisit"))
    side = heads.where(F.col("type").isin("request", "metadata"))
    named = main.select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("main_id"))
    reverse = side.join(named, F.col("record_id") == F.col("side_id")).drop("side_id")
    linked = side.select("*", F.explode("concurrent_to").alias("main_id")).unionByName(reverse)

    def pick(kind: str) -> Column:
        return F.min(F.when(F.col("type") == kind, F.struct("record_id", "target", "content_type", "fields"))).alias(kind)

    sides = linked.groupBy("main_id").agg(pick("request"), pick("metadata"))
    if payloads:
        main = main.join(records.select("record_id", "payload").where(F.col("type").isin("response", "revisit")), "record_id")
    else:
        main = main.withColumn("payload", F.lit(None).cast("binary"))
    out = main.join(sides, F.col("record_id") == F.col("main_id"), "left")
    page = F.try_element_at(F.map_from_entries(F.col("metadata.fields")), F.lit("page_id"))
    response = F.struct("type", "target", "refers_to", "payload_digest", "status", "payload_bytes", "payload")
    return out.select("record_id", response.alias("response"), "request", "metadata", page.alias("page_id"))


def archive_and_read(pages: DataFrame, least_bytes: int = 0, payloads: bool = True, **names: str) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and return their captures."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes, **names)
    records = read_records(pages.sparkSession, path)
    captures = assemble(records, payloads)
    if not payloads:  # parsed once, and read no more
        records._written_to = path
        forget(records)
    return captures
