"""Web archives: records written as gzip members, and a reader that splits files anywhere.

Writing. A record is a WARC/1.1 ``response`` with the payload, or a ``revisit``
that names an earlier record with an equal payload. Equal payloads meet by their
digest in narrow rows; the payload itself is shuffled once, copies already
merged in the task that reads them. Digests with more than a ``HOT_GROUPS``-th of all rows
(so fewer than ``HOT_GROUPS``) are joined by broadcast, all others by shuffle. Tasks write
files of about ``file_bytes`` under new names; a manifest in the checkpoint
folder names the files of the attempts that count, so lost or repeated
attempts leave no record behind.

Reading. Files are cut into byte ranges, whatever is in them. A task looks for the
gzip magic from the start of its range, takes a candidate only if the bytes
behind it inflate to a WARC header, and owns the records that start inside its range;
the last one may end beyond it. Behind a record the next one is tried at once, and behind
damage the search begins again. Records that fail to inflate, are cut short or
differ from their digest come out with ``error`` set. A payload that itself holds
a whole stored archive can show its inner records to a range that starts inside
it; text in UTF-8 can't hold the magic.

Null payloads are empty, a null id or URL is left out of the record and reads back
as null, and the smallest id (null last, ties by URL) of equal payloads is the response. Equal rows
are interchangeable: one of them is the response. Control characters and others that a
header can't hold are kept beside the header in escaped form. A payload has to fit into a task's
memory. An empty table gives an empty manifest and no records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_folder, short_batches

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
MIN_REVISIT = 100           # smaller payloads are always responses
FILE_BYTES, SPLIT_BYTES = 256 << 20, 32 << 20
HOT_GROUPS = 1000
COPIES = 10_000             # equal rows that one row of the plan stands for
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLAIN_URL = re.compile(r"[!-~]*")
BLOCK, PIECE, STEP = 4 << 20, 16 << 10, 256
MANIFEST = "path string, size long, records long"
RECORD = ("path string, offset long, record_type string, record_id string, id string, url string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary, error string")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and ``file:`` are local (or mounted)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ---- records -----------------------------------------------------------------------------

def record_id(*parts) -> str:
    name = "\0".join("" if p is None else f"={p}" for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)}>"


def member(fields: list[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member; fields without a value are left out."""
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + "\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def named(prefix: str, page, url) -> list[tuple[str, object]]:
    """Header fields of a page; ``X-`` fields keep what the standard ones can't."""
    plain = url is not None and PLAIN_URL.fullmatch(url)
    return [(f"{prefix}Target-URI", None if url is None else url if plain else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
            (f"X-{prefix}Page-URL", None if url is None or plain else quote(url, safe="")),
            (f"X-{prefix}Page-ID", None if page is None else quote(str(page), safe=""))]


def page_member(page, url, digest: str, size: int, payload: bytes | None, copy: int, refers: tuple | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page, url, digest, copy)), ("WARC-Date", DATE),
              *named("WARC-", page, url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*refers, digest, 0)), *named("WARC-Refers-To-", *refers)]
    return member(fields, head + (payload or b""))


# ---- writing -----------------------------------------------------------------------------

def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(id, url, digest, size, payload, copy, refers_id, refers_url): the record of every row; revisits have no payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    small = F.when(F.col("size") < least, F.col("payload"))
    copies = saved(rows.select("digest", "id", "url", "size", small.alias("small")).groupBy("digest", "id", "url", "size", "small")
                   .agg(F.count("*").alias("k")))
    big = F.col("size") >= least
    groups = saved(copies.where(big).groupBy("digest").agg(F.min(order).alias("first"), F.sum("k").alias("n")).where("n > 1"))
    total = copies.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    hot = F.col("n") > total / HOT_GROUPS
    by_broadcast = F.broadcast(groups.where(hot).select("digest", F.col("first").alias("hot_first")))
    by_shuffle = groups.where(~hot).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    alone = F.concat(F.lit("="), F.xxhash64("digest", "id", "url").cast("string"))
    first = F.coalesce("hot_first", "cold_first")
    known = copies.join(by_broadcast, "digest", "left").withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(alone)) \
        .join(by_shuffle, "key", "left").withColumn("first", F.when(big, first))
    own = big & (F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url"))))
    # number 0 of a payload's first row is written with the payload itself
    begin = F.greatest(F.col("least"), F.col("block") * COPIES)
    blocks = known.withColumn("least", own.cast("long")).select(
        "id", "url", "digest", "size", "small", "first", "k", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / COPIES))).alias("block"))
    dealt = blocks.repartition("digest", "id", "url", "block")
    number = F.sequence(begin, F.least(F.col("k") - 1, (F.col("block") + 1) * COPIES - 1))
    narrow = dealt.where((begin < F.col("k")) & (begin < (F.col("block") + 1) * COPIES)).select(
        "id", "url", "digest", "size", F.col("small").alias("payload"), F.explode(number).alias("copy"),
        F.col("first").isNotNull().alias("revisit"), F.col("first.id").alias("refers_id"), F.col("first.url").alias("refers_url"))
    wide = rows.where(big).groupBy("digest").agg(F.min(order).alias("first"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    kind = rows.schema["id"].dataType
    return wide.select("first.id", "first.url", "digest", "size", "payload", F.lit(0).cast("long").alias("copy"), F.lit(False).alias("revisit"),
                       F.lit(None).cast(kind).alias("refers_id"), F.lit(None).cast("string").alias("refers_url")).unionByName(narrow)


def write(records: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records as archives; the saved manifest (path, size, records) of the files that count."""
    spark = records.sparkSession
    short_batches(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def written(batches):
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        part, out, done = TaskContext.get().partitionId(), None, []
        path, size, count = "", 0, 0
        for batch in batches:
            for page, url, digest, length, payload, copy, revisit, refers_id, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE),
                                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size, count = len(info), 0
                data = page_member(page, url, digest, length, payload, copy, (refers_id, refers_url) if revisit else None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))],
                                             ["path", "size", "records"])

    columns = ["id", "url", "digest", "size", "payload", "copy", "revisit", "refers_id", "refers_url"]
    return saved(records.select(columns).mapInArrow(written, MANIFEST))


# ---- reading -----------------------------------------------------------------------------

class Bytes:
    """Bytes of an open file from any place, a block held at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.block = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        end = min(pos + n, self.size)
        if pos < self.base or end > self.base + len(self.block):
            self.file.seek(pos)
            self.base, self.block = pos, self.file.read(min(max(n, BLOCK), self.size - pos))
        return self.block[pos - self.base:end - self.base]

    def magic(self, pos: int, end: int) -> int:
        """The next place of the gzip magic before ``end``, or ``end``."""
        while pos < end:
            found = self.at(pos, min(BLOCK, end + len(MAGIC) - 1 - pos)).find(MAGIC)
            if found >= 0:
                return pos + found
            pos += min(BLOCK, end + len(MAGIC) - 1 - pos) - len(MAGIC) + 1
        return end


def inflate(data: Bytes, pos: int):
    """(bytes of the record, end of the member, error) of the member at ``pos``; None if no record begins there.

    The header is inflated in short steps, so that it is known even if what follows is damaged."""
    unpack, raw, tail, valid, header = zlib.decompressobj(31), bytearray(), b"", False, False
    while not unpack.eof:
        piece = tail or data.at(pos, PIECE)
        pos += 0 if tail else len(piece)
        try:
            raw += unpack.decompress(piece, 0 if header else STEP)
        except zlib.error as e:
            return (bytes(raw), pos, f"gzip: {e}") if valid else None
        tail = unpack.unconsumed_tail
        if not valid and len(raw) >= 8:
            valid = raw.startswith(b"WARC/1.")
            if not valid:
                return None
        header = header or b"\r\n\r\n" in raw or len(raw) > BLOCK >> 6
        if not piece:
            return (bytes(raw), pos, "cut short") if valid else None
    return (bytes(raw), pos - len(unpack.unused_data), None) if valid else None


def parsed(raw: bytes) -> dict:
    """Fields of a record; its payload is the body of a response, or the whole block of other kinds."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields.setdefault(k.strip().lower(), v.strip())
    length = fields.get("content-length", "")
    size = int(length) if length.isascii() and length.isdigit() else -1
    block, kind = rest[:max(0, size)], fields.get("warc-type")
    error = None if found and size >= 0 and len(block) == size else "length"
    http, cut, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if kind in ("response", "revisit") and http and not cut:
        error = error or "http"
    digest = fields.get("warc-payload-digest")
    digest = digest[7:] if digest and digest.startswith("sha256:") else None
    payload, n = body, len(body)
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length: *([0-9]+)", http)
        payload, n = None, int(told[1]) if told else None
    else:
        own = hashlib.sha256(body).hexdigest()
        error = error or ("digest" if digest not in (None, own) else None)
        digest = own
    text = lambda k: None if (v := fields.get(k)) is None else unquote(v)
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "id": text("x-warc-page-id"),
            "url": text("x-warc-page-url") if "x-warc-page-url" in fields else fields.get("warc-target-uri"),
            "refers_to": text("x-warc-refers-to-page-id"), "payload_digest": digest, "payload_bytes": n, "payload": payload, "error": error}


def records_of(data: Bytes, start: int, end: int):
    """(offset, record) of the records that start in the range."""
    pos = data.magic(start, end)
    while pos < end:
        found = inflate(data, pos)
        if found is None:
            pos = data.magic(pos + 1, end)
            continue
        raw, after, error = found
        row = parsed(raw)
        yield pos, row | {"error": error or row["error"]}
        pos = data.magic(pos + 1 if error else after, end)


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the files (path, size) with its place, fields, payload and ``error``, read by byte ranges."""
    spark = files.sparkSession
    short_batches(spark)
    count = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(0))).first()[0]
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / split_bytes)))
    ranges = files.where("size > 0").select("path", "size", first.alias("part")).repartition(max(1, min(int(count), 50_000)), "path", "part")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def scanned(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for path, size, part in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = opened(path)
                rows, held = [], 0
                with store.open_input_file(at) as file:
                    for offset, row in records_of(Bytes(file, size), part * split_bytes, min(size, (part + 1) * split_bytes)):
                        rows.append(row | {"path": path, "offset": offset})
                        held += len(row["payload"] or b"") + 500
                        if held > BLOCK:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return ranges.mapInArrow(scanned, RECORD)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
             file_bytes: int = FILE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, record_type, refers_to, payload_digest, payload_bytes, ...) of all pages, written and read back; a damaged record is an error."""
    kind = pages.schema[page_id].dataType
    back = read(write(page_records(pages, page_id, url, html), folder, file_bytes), split_bytes).where("record_type in ('response', 'revisit') or error is not null")
    sound = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", "path", "offset", "error")).cast("boolean"))
    return back.where(sound).withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
