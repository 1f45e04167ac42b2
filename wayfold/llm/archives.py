"""WARC (10): ZIP-packaged archives of web records, written in parallel and read by ranges, without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (a gzip member for each WARC record) and
``indexes/index.cdx`` (a line a record: id, offset, length, and the member if it is another). The reader takes the end of the file, the ZIP64
records where sizes or offsets need them, and the central directory; from it the places of the members; from the
index the places of the records (a member without one is read through); and then reads ranges of the file, neighbouring records together.

Writing: a task rolls to a new archive at ``roll_bytes``. It writes under a name of its own and renames at the
end, so an attempt that is lost leaves no half archive under a final name. Files are opened by their URI with
pyarrow's file systems, on executors and in shared folders only.

Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response; others
are revisits of it, with the payload's headers but not the payload.

Defined results: a null html is as empty; a null url gives no target; null page_ids come after all others: such
a record is a revisit if its payload has an id, else a response; rows that share the smallest page_id of a
payload are all responses; further columns stay out; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, scratch, small

ROLL_BYTES = 64 << 20
LEAST = 0
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Ranges nearer than this are read together, up to READ_BYTES at a time.
GAP, READ_BYTES = 1 << 12, 4 << 20

_URN = "urn:wayfold:page:"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ---------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC record; a revisit if it refers to a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class ArchiveWriter:
    """One archive; done() names it and tells its records and bytes."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key: str, rec: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = z.compress(rec) + z.flush()
        self.data.write(packed)
        self.lines.append(f"{key} {self.at} {len(packed)}\n")
        self.at += len(packed)

    def done(self) -> tuple[int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.lines), self.at


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as archives into a shared folder; returns path, records and bytes of each."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Only ids and digests are shuffled; what comes back are digests that occur more than once.
    firsts = rows.where(F.octet_length("html") >= least).select("key", "page_id").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    firsts = cut(firsts)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least), F.col("first"))
    rows = rows.join(F.broadcast(firsts) if small(firsts) else firsts, "key", "left").select("page_id", "url", "html", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, writer, out = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for page, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                if writer is None:
                    uri, n = f"{folder}/part-{task:06d}-{n:05d}.wacz", n + 1
                    writer = ArchiveWriter(uri)
                writer.add("-" if page is None else str(page), record(page, url, html.encode(), ref, date))
                if writer.at >= roll_bytes:
                    out.append((uri, *writer.done()))
                    writer = None
        if writer is not None:
            out.append((uri, *writer.done()))
        paths, records, sizes = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


# --- reading ---------------------------------------------------------------------------------------


class Ranges:
    """Byte ranges of a file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError(f"range {at}+{n} lies outside the archive of {self.size} bytes")
        self.file.seek(at)
        return self.file.read(n)


def members(f: Ranges) -> dict[str, tuple[int, int, int, int]]:
    """Of each member of a ZIP file: method, packed size, size, and where its local header is."""
    tail_at = max(0, f.size - 65_557)
    tail = f.read(tail_at, f.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (x := f.read(locator, 20))[:4] == b"PK\x06\x07":
        record_ = f.read(struct.unpack_from("<Q", x, 8)[0], 56)
        if record_[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, size, at = struct.unpack_from("<QQQ", record_, 32)
    directory, i, out = f.read(at, size), 0, {}
    for _ in range(count):
        if directory[i : i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, i + 10)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, i + 20)
        (local,) = struct.unpack_from("<I", directory, i + 42)
        name = directory[i + 46 : i + 46 + name_n].decode()
        j, stop = i + 46 + name_n, i + 46 + name_n + extra_n
        while j + 4 <= stop:
            tag, n = struct.unpack_from("<HH", directory, j)
            if tag == 1:  # ZIP64: just the fields that are full in the record, in this order
                k = j + 4
                if plain == 0xFFFFFFFF:
                    (plain,), k = struct.unpack_from("<Q", directory, k), k + 8
                if packed == 0xFFFFFFFF:
                    (packed,), k = struct.unpack_from("<Q", directory, k), k + 8
                if local == 0xFFFFFFFF:
                    (local,), k = struct.unpack_from("<Q", directory, k), k + 8
            j += 4 + n
        out[name] = (method, packed, plain, local)
        i = stop + comment_n
    return out


def _data_at(f: Ranges, member: tuple[int, int, int, int]) -> int:
    head = f.read(member[3], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the central directory says")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member[3] + 30 + name_n + extra_n


def _records(f: Ranges, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a stored member, read from its start: gzip members, or records as they are."""
    at, upto = start, start + size
    while at < upto:
        if f.read(at, 2) == b"\x1f\x8b":
            unpack, n = zlib.decompressobj(31), 0
            while not unpack.eof:
                part = f.read(at + n, min(1 << 20, upto - at - n))
                if not part:
                    raise ValueError("a record ends before its member's end")
                unpack.decompress(part)
                n += len(part)
            n -= len(unpack.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                part = f.read(at + len(head), min(1 << 14, upto - at - len(head)))
                if not part:
                    raise ValueError("a record without a head")
                head += part
            head = head[: head.index(b"\r\n\r\n") + 4]
            n = len(head) + int(next(x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:"))[15:]) + 4
        yield at, n
        at += n


def _entry(line: str) -> tuple[str | None, int, int]:
    """Member, offset and length that a line of an index tells; lines end in JSON, or are id, offset, length and maybe the member."""
    if line.endswith("}"):
        x = json.loads(line[line.index("{") :])
        return x.get("filename"), int(x["offset"]), int(x["length"])
    _, offset, length, *of = line.split(" ")
    return (of[0] if of else None), int(offset), int(length)


def places(f: Ranges) -> list[tuple[int, int]]:
    """Offset in the file and length of each record of all stored WARC members: by the indexes, gzip ones included, and by
    reading through a member that no index names."""
    found = members(f)
    data = {n: m for n, m in found.items() if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    if any(m[0] != 0 for m in data.values()):
        raise ValueError("an archive member is packed; it can't be read by ranges")
    starts = {n: _data_at(f, m) for n, m in data.items()}
    out, named = [], set()
    for name, m in found.items():
        if not name.startswith("indexes/"):
            continue
        raw = f.read(_data_at(f, m), m[1])
        raw = zlib.decompress(raw, -15) if m[0] == 8 else raw
        for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines():
            if not line.strip() or line.startswith("!"):
                continue
            of, offset, length = _entry(line.strip())
            member = DATA if of is None else of if of in data else f"archive/{of}"
            if offset + length > data[member][1]:
                raise ValueError("the index points beyond its member")
            named.add(member)
            out.append((starts[member] + offset, length))
    for name in data.keys() - named:
        out += _records(f, starts[name], data[name][1])
    return out


def parse(rec: bytes) -> dict[str, str | bytes]:
    """Headers of a WARC record by lower-case name, and its block under ''."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    out: dict[str, str | bytes] = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out[""] = rest[: int(out["content-length"])]
    return out


def _page(urn: str | bytes | None) -> int | None:
    number = str(urn).removeprefix(f"<{_URN}").removesuffix(">") if urn else ""
    return int(number) if number else None


def read_archives(paths: DataFrame) -> DataFrame:
    """A row of page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) for
    each record of the archives whose URIs are in the column path. A payload that does not give its digest is an error."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows(f: Ranges, some: list[tuple[int, int]]) -> list[tuple]:
        base = some[0][0]
        raw = f.read(base, some[-1][0] + some[-1][1] - base)
        out = []
        for at, n in some:
            rec = raw[at - base : at - base + n]
            r = parse(zlib.decompress(rec, 31) if rec[:2] == b"\x1f\x8b" else rec)
            http, _, payload = bytes(r[""]).partition(b"\r\n\r\n")
            digest, kind_ = str(r["warc-payload-digest"]).removeprefix("sha1:"), str(r["warc-type"])
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            if kind_ == "response" and (len(payload) != size or _digest(payload) != digest):
                raise ValueError(f"{r['warc-record-id']}: payload and digest differ")
            url = str(r["warc-target-uri"]).replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "warc-target-uri" in r else None
            out.append((_page(r["warc-record-id"]), url, size, digest, kind_, _page(r.get("warc-refers-to")), payload if kind_ == "response" else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                f, some = Ranges(uri), []
                for at, n in [*sorted(places(f)), (1 << 62, 0)]:
                    if some and (at > some[-1][0] + some[-1][1] + GAP or at + n - some[0][0] > READ_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(f, some), strict=True), schema.types, strict=True)], schema=schema)
                        some = []
                    if n:
                        some.append((at, n))

    return paths.select("path").mapInArrow(run, kind)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages written into the shared folder and read back, a row of page_id, payload_bytes, payload_digest, record_type and
    refers_to each."""
    spark = pages.sparkSession
    written = write_archives(pages, scratch(spark, "archives"), least)
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    back = read_archives(written.repartition(many))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
