"""Legacy ARC archives: writer, parser, conversion to WARC, and a WARC reader.

ARC files state their version and field names in a ``filedesc:`` block; each record is a
line of these fields, the last of which is the length of what follows. The converter turns each record into a
WARC record: the identifier is a UUID derived from address, date and content, the
date is the ARC date in ISO form, the type follows from scheme and content, and block and
payload get SHA-1 digests. Records with equal payloads are stored once: the smallest key is the response, the others
revisit it.

Archives are gzipped record by record, so any member can be read alone. Files are written and read by Spark (text writer with
a separator that is an empty gzip member, binaryFile reader), so any file system of the cluster will do. An
archive row holds at most about CHUNK bytes and a file FILE_ROWS rows, so no reader needs a large file in memory. The
converter reads an archive twice: for the digests, and with the list of its revisits for the records; payloads stay inside one
function and go through no join or shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage, table

CHUNK = 2 << 20
FILE_ROWS = 4
#: Shared payloads, or revisits, up to which their table is broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST_PAYLOADS = 50_000
GZIP_LEVEL = 1
#: Bytes that a member is given at a time.
PIECE = 8 << 10
ARC_DATE = "20240101000000"
# Fixed values of the two ARC versions: names of the fields of a record's line.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PAGE = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_head(version: int, name: str, date: str = ARC_DATE) -> bytes:
    """The block that opens an archive of that version."""
    body = f"{version} 0 twinfold\n{ARC_FIELDS[version]}\n".encode()
    rest = f"0.0.0.0 {date} text/plain"
    if version == 2:
        rest += f" 200 - - 0 {name}"
    return f"filedesc://{name} {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, body: bytes, name: str, date: str = ARC_DATE, mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """One record; blanks in the address are escaped, as fields are parted by blanks."""
    rest = f"{ip} {date} {mime}"
    if version == 2:
        rest += f" 200 {digest(body)} - 0 {name}"
    return f"{re.sub(r'\s', '%20', url)} {rest} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an archive, or of several in a row, as field name to text, with version and body.

    Raises ValueError where a line lacks fields or a length goes beyond the end.
    """
    at, names, version = 0, None, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the record line at byte {at}")
        line = data[at:end].rstrip(b"\r")
        is_head = line.startswith(b"filedesc://")
        if names is None and not is_head:
            raise ValueError("the archive doesn't start with a filedesc block")
        length = line.rpartition(b" ")[2]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"bad length in the record line at byte {at}")
        body = data[end + 1 : end + 1 + int(length)]
        if is_head:
            first, second = body.split(b"\n")[:2]
            version, names = int(first.split(b" ")[0]), second.decode().split(" ")
        else:
            # a legacy address may hold blanks: the fields are counted from the right
            values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ValueError(f"{len(values)} of {len(names)} fields in the record line at byte {at}")
            yield dict(zip(names, values, strict=True)) | {"version": version, "body": body}
        at = end + 1 + int(length)


def iso_date(arc: str) -> str:
    """ARC's digits as a WARC date; missing places count from the start of the year 1970, or of the month and day."""
    d = arc if arc.isdigit() else ""
    d = d[:14] + "19700101000000"[len(d[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parts_of(body: bytes) -> tuple[bytes, bytes, int | None]:
    """HTTP head (empty if there is none), payload, and page id in the head."""
    cut = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
    head, payload = (body[:cut], body[cut:]) if cut >= 4 else (b"", body)
    page = _PAGE.search(head)
    return head, payload, int(page[1]) if page else None


def to_warc(rec: dict) -> dict:
    """An ARC record as the parts of an equivalent WARC record."""
    head, payload, page = parts_of(rec["body"])
    http, said = rec["body"].startswith(b"HTTP/"), digest(payload)
    return {
        "url": rec["URL"], "date": iso_date(rec["Archive-date"]), "ip": rec["IP-address"],
        "type": "response" if http else "resource", "mime": "application/http; msgtype=response" if http else rec["Content-type"],
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{rec['URL']} {rec['Archive-date']} {page} {said}")),
        "head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": said, "page_id": page,
    }


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; raises ValueError where a record is cut or not a WARC one."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC header at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        if end + 4 + n > len(data):
            raise ValueError(f"bad length in the record at byte {at}")
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def unpack(content: bytes) -> bytes:
    """The content, after gunzip of all members if it is compressed. Members get the content in pieces, so what follows them is not copied each time."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, view, at = [], memoryview(content), 0
    while at < len(view) and view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            piece = view[at : at + PIECE]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError(f"the member that ends at byte {at} is cut")
    return b"".join(out)


def pack(data: bytes) -> bytes:
    return zlib.compress(data, GZIP_LEVEL, 31)


def write_archive(chunks: DataFrame, path: str) -> None:
    """Writes binary rows (value) of gzip members; between them stand empty members."""
    text = chunks.select(F.col("value").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", pack(b"").decode("latin-1")).option("maxRecordsPerFile", FILE_ROWS).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


class Chunks:
    """Records gathered to archive rows that each start with head."""

    def __init__(self, head: bytes):
        self.head, self.parts, self.size = pack(head), [], 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        self.parts.append(pack(record))
        self.size += len(record)
        if self.size >= CHUNK:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([self.head, *self.parts])], pa.binary())], ["value"])
        self.parts, self.size = [], 0


def pages_to_arc(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as ARC archives, odd page_ids and those without one in version 1, even ones in version 2.

    Null html is empty, a null address is urn:page; other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = "pages.arc"
        archives = {v: Chunks(arc_head(v, name)) for v in ARC_FIELDS}
        for b in batches:
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version = 1 if page is None else 2 - page % 2
                payload = (html or "").encode()
                head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                yield from archives[version].add(arc_record(version, url or "urn:page", head.encode() + payload, name))
        for x in archives.values():
            yield from x.end()

    write_archive(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, "value binary"), path)


def arc_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, version, page_id, record_id, payload_bytes, payload_digest of the records of the ARC archives at path, as converted."""
    names = ("version", "page_id", "record_id", "payload_bytes", "payload_digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(rec["version"], *(w[c] for c in names[1:])) for rec in parse_arc(unpack(content.as_py())) for w in [to_warc(rec)]]
                if rows:
                    cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows)), *cols], ["path", *names])

    return read_archive(spark, path).mapInArrow(read, "path string, version int, page_id long, record_id string, payload_bytes long, payload_digest string")


def revisits(facts: DataFrame, min_bytes: int = 0) -> DataFrame:
    """path and list (digest, bytes, page, record) of the payloads in an archive of which another record is the response."""
    facts = facts.filter(F.col("payload_bytes") >= min_bytes)
    by = ["payload_digest", "payload_bytes"]
    first = facts.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")).alias("f"))
    first = stage(first.filter("n > 1").select(*by, F.col("f.page_id").alias("page"), F.col("f.record_id").alias("record")), "payloads")
    few = first.count() <= MAX_BROADCAST_PAYLOADS
    again = facts.join(F.broadcast(first) if few else first, by).filter(~F.col("page_id").eqNullSafe(F.col("page")))
    return again.select("path", F.struct(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"), "page", "record").alias("x")).groupBy("path").agg(F.collect_set("x").alias("list"))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Converts the archives at arc_path; of equal payloads of at least min_bytes only the one with the smallest page_id is stored.

    Rows that share that smallest page_id and payload are all responses; a null page_id comes after any other, and
    records of which none has a page_id are all responses.
    """
    lists = stage(revisits(stage(arc_facts(spark, arc_path), "facts"), min_bytes), "revisits")
    few = (lists.agg(F.sum(F.size("list"))).first()[0] or 0) <= MAX_BROADCAST_PAYLOADS
    archives = read_archive(spark, arc_path).join(F.broadcast(lists) if few else lists, "path", "left").select("content", "list")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:6a5fd5f0-0f5c-5d5e-9c4c-3c9b7a4ac2a1>"), ("WARC-Date", iso_date(ARC_DATE)), ("Content-Type", "application/warc-fields")], b"software: twinfold\r\nformat: WARC File Format 1.0\r\n")
        out = Chunks(info)
        for b in batches:
            for content, known in zip(b.column("content"), b.column("list").to_pylist(), strict=True):
                first = {(x["digest"], x["bytes"]): x for x in known or ()}
                for rec in parse_arc(unpack(content.as_py())):
                    r = to_warc(rec)
                    fields = [("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["date"]), ("WARC-IP-Address", r["ip"]), ("Content-Type", r["mime"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
                    f = first.get((r["payload_digest"], r["payload_bytes"]))
                    if f and r["page_id"] != f["page"]:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{f['record']}>"), ("X-Refers-To-Page", str(f["page"])), ("X-Payload-Length", str(r["payload_bytes"]))]
                        kind, block = "revisit", r["head"]
                    else:
                        kind, block = r["type"], rec["body"]
                    yield from out.add(warc_record([("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block))
        yield from out.end()

    write_archive(archives.mapInArrow(convert, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, payload_bytes, payload_digest, record_type, refers_to and payload (null of revisits) of the page records at path.

    Digests are computed anew; one that differs from its header raises ValueError.
    """
    ddl = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    cols = {"page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for f, block in parse_warc(unpack(content.as_py())):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    if f["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"block digest of {f['WARC-Record-ID']} differs")
                    _, payload, page = parts_of(block)
                    revisit = f["WARC-Type"] == "revisit"
                    said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != said:
                        raise ValueError(f"payload digest of {f['WARC-Record-ID']} differs")
                    rows.append((page, f["WARC-Target-URI"], f["WARC-Record-ID"].strip("<>"), int(f["X-Payload-Length"]) if revisit else len(payload), said, f["WARC-Type"], int(f["X-Refers-To-Page"]) if revisit else None, None if revisit else payload))
                    size += len(block)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), cols.values(), strict=True)], list(cols))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), cols.values(), strict=True)], list(cols))

    return read_archive(spark, path).select("content").mapInArrow(parse, ", ".join(f"{c} {ddl[t]}" for c, t in cols.items()))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC 1 or 2, by its id, to WARC and back."""
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    pages_to_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
g AS (SELECT *, '0x' || substr(hex, 1, 10) AS a1, '0x' || substr(hex, 11, 10) AS a2, '0x' || substr(hex, 21, 10) AS a3, '0x' || substr(hex, 31, 10) AS a4,
        min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(flatten(list_transform([a1, a2, a3, a4], lambda a: list_transform(range(8), lambda i: (a::BIGINT >> (35 - 5 * i)) & 31))), lambda v: substr('{_BASE32}', v::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
