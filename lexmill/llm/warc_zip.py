"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file whose members are stored as they are: the records, each a gzip member of its own after one that
describes the archive, and an index of record positions in lines of fixed width. The reader parses the end of the central
directory (the ZIP64 one where there is one), locates both members by their local headers, and reads a range of index lines and
the records that they name.
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
from array import array
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import STEP, blocks
from lexmill.session import Workspace

DATA, INDEX = "archive/data.warc.gz", "indexes/index.txt"
#: An index line: offset and length of a record.
LINE = "%020d %012d\n"
LINE_BYTES = len(LINE % (0, 0))
#: Bytes of records after which a writer begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Records that a reading task gets at a time, and bytes of them that are read at once (a larger record alone).
RANGE_RECORDS, READ_BYTES = 2_000, 8 << 20
#: Most partitions that ranges are dealt to.
MOST_PARTS = 20_000


def _fs(uri: str):
    """A pyarrow file system and the path in it; Hadoop's names of object stores are known."""
    from pyarrow import fs

    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(hadoop):
            uri = plain + uri[len(hadoop) :]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ZipReader:
    """Members of a ZIP file by name: (offset of the data, size, method), from its central directory."""

    def __init__(self, f, size: int):
        self.f = f
        self.members: dict[str, tuple[int, int, int]] = {}
        tail_at = max(0, size - (1 << 16) - 22)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, offset = struct.unpack_from("<10xHII", tail, at)
        if n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            where = tail_at + at - 20
            sig, z64 = struct.unpack("<4s4xQ", self.read(where, 16)) if where >= 0 else (b"", 0)
            if sig == b"PK\6\7":
                head = self.read(z64, 56)
                if head[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end of central directory")
                n, length, offset = struct.unpack_from("<32xQQQ", head)
        directory, at = self.read(offset, length), 0
        for _ in range(n):
            sig, method, packed, plain, name_n, extra_n, note_n, local = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, at)
            if sig != b"PK\1\2":
                raise ValueError("broken central directory")
            name = directory[at + 46 : at + 46 + name_n].decode("utf-8")
            packed, local = self._wide(directory[at + 46 + name_n : at + 46 + name_n + extra_n], plain, packed, local)
            self.members[name] = (local, packed, method)
            at += 46 + name_n + extra_n + note_n

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
        """Size and offset, from the ZIP64 field where the directory has only marks."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if plain == 0xFFFFFFFF:
                    values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if local == 0xFFFFFFFF:
                    local = values.pop(0)
            at += 4 + n
        return packed, local

    def read(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        sig, name_n, extra_n = struct.unpack("<4s22xHH", self.read(local, 30))
        if sig != b"PK\3\4":
            raise ValueError("broken local header")
        return local + 30 + name_n + extra_n, size


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and block, of a record in a gzip member or as it is.

    Names count in any case, space around values doesn't count, folded lines belong to the line before.
    """
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    name = ""
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and name:
            fields[name] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        name = name.strip().lower()
        fields[name] = value.strip()
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a record ends before its block does")
    return fields, rest[:n]


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _line(value) -> str:
    """A value that can stand in a header line."""
    return json.dumps(value, ensure_ascii=True)


def _uri(url: str) -> str:
    """The address with what can't stand in one quoted; quotes that it has stay."""
    return quote(url, safe="%:/?#[]@!$&'()*+,;=~")


def _record_id(folder: str, rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}#{rid}')}>"


class _Archive:
    """An archive being written: records go straight to the file, positions are kept for the index that close() writes."""

    def __init__(self, folder: str, name: str, stamp: str):
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        self.fs, self.path, self.uri = fs, f"{path}/{name}", f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{self.path}.tmp")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.index = array("Q"), array("Q")
        about = b"software: lexmill\r\nformat: WARC File Format 1.1\r\n"
        first = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", stamp), ("Content-Type", "application/warc-fields")], about)
        self.member.write(first)
        self.size = len(first)

    def add(self, rec: bytes) -> None:
        self.at.append(self.size)
        self.index.append(len(rec))
        self.member.write(rec)
        self.size += len(rec)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as m:
            for x in zip(self.at, self.index, strict=True):
                m.write((LINE % x).encode())
        self.zip.close()
        self.out.close()
        self.fs.move(f"{self.path}.tmp", self.path)
        return self.uri, len(self.index)


def write(
    df: DataFrame, folder: str, id_col: str = "page_id", url: str | None = "url", payload: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Writes a record for each row into archives below folder; returns the table (path, records) of archives, written there too.

    Of the rows with equal payloads of at least min_bytes bytes, the one with the largest id (of rows that repeat it, or that
    have no id at all, one of them) is a response, the others are revisits that refer to it; rows with smaller payloads are all
    responses. A null payload counts as empty; a null address is left to the record's own name. Records, revisits and what
    they refer to have names of their own; page id, address and length of the payload stand in fields besides the standard
    ones, as far as these don't state them. A task that is run again writes archives under other names, and only those of the
    finished run are listed. Records are written one by one, so that a task holds one payload and its index at a time.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), body.alias("p"))
    rows = ws.write(rows.withColumn("k", F.sha1("p")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    narrow = rows.select("rid", "id", "url", "k", F.octet_length("p").cast("long").alias("n"))
    first = narrow.where(F.col("n") >= min_bytes).groupBy("k").agg(F.max(F.struct("id", "rid", "url")).alias("w"), F.count("*").alias("c"))
    first = ws.write(first.where("c > 1").select("k", F.col("w.id").alias("to"), F.col("w.rid").alias("to_rid"), F.col("w.url").alias("to_url")), "first")
    again = ws.write(narrow.select("rid", "k", "n").join(first, "k").where(F.col("n") >= min_bytes).where("rid <> to_rid").select("rid", "to", "to_rid", "to_url"), "again")
    named = rows.join(again, "rid", "left")
    stamp = "2000-01-01T00:00:00Z"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, archive = uuid.uuid4().hex, None
        done: list[tuple[str, int]] = []
        for b in batches:
            for part in blocks(b):
                r = part.to_pydict()
                for rid, id_, link, p, to, to_rid, to_url in zip(*(r[c] for c in ("rid", "id", "url", "p", "to", "to_rid", "to_url")), strict=True):
                    kind, name = "response" if to_rid is None else "revisit", _record_id(folder, rid)
                    target = name[1:-1] if link is None else _uri(link)
                    fields = [
                        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", stamp), ("WARC-Target-URI", target),
                        ("WARC-Payload-Digest", f"sha1:{payload_digest(p)}"), ("Content-Type", "application/http; msgtype=response"),
                        ("Payload-Length", str(len(p))), ("Page-ID", _line(id_)),
                    ]
                    if target != link:
                        fields.append(("Page-Address", _line(link)))
                    if to_rid is not None:
                        other = _record_id(folder, to_rid)
                        fields += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", other),
                            ("WARC-Refers-To-Target-URI", other[1:-1] if to_url is None else _uri(to_url)), ("WARC-Refers-To-Date", stamp), ("Refers-To-Page-ID", _line(to)),
                        ]
                    archive = archive or _Archive(folder, f"{mine}-{len(done)}.zip", stamp)
                    archive.add(record(fields, _HTTP + (b"" if to_rid is not None else p)))
                    if archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    named.select("rid", "id", "url", "p", "to", "to_rid", "to_url").mapInArrow(run, "path string, records bigint").write.parquet(f"{folder}/listing")
    ws.drop("rows", "first", "again")
    return spark.read.schema("path string, records bigint").parquet(f"{folder}/listing")


FIELDS = "id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(spark: SparkSession, listing: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the listed archives: FIELDS, and with payloads the response's payload (null of a revisit).

    Archives are opened at their central directory and read by ranges; nothing is extracted. Raises where a response's payload
    differs from its length or digest, or where an archive holds another number of records than listed.
    """
    ranges = listing.select("path", "records", F.explode(F.sequence(F.lit(0), F.floor((F.col("records") - 1) / RANGE_RECORDS))).alias("part"))
    parts = listing.agg(F.sum(F.floor((F.col("records") - 1) / RANGE_RECORDS) + 1)).first()[0] or 1
    schema = FIELDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def records(path: str, total: int, part: int) -> Iterator[tuple]:
        fs, where = _fs(path)
        with fs.open_input_file(where) as f:
            z = ZipReader(f, f.size())
            at, n = z.stored(INDEX)
            if n != total * LINE_BYTES:
                raise ValueError(f"{path} has {n // LINE_BYTES} records, not {total}")
            count = min(RANGE_RECORDS, total - part * RANGE_RECORDS)
            lines = z.read(at + part * RANGE_RECORDS * LINE_BYTES, count * LINE_BYTES).decode().splitlines()
            places = [(int(x[:20]), int(x[21:])) for x in lines]
            base, size = z.stored(DATA)
            if places and sum(places[-1]) > size:
                raise ValueError(f"{path}: a record ends behind its member")
            k = 0
            while k < len(places):  # records that stand together are read together
                begin, to = places[k][0], k
                while to < len(places) and (to == k or sum(places[to]) - begin <= READ_BYTES):
                    to += 1
                held = z.read(base + begin, sum(places[to - 1]) - begin)
                for offset, length in places[k:to]:
                    yield page(path, *parse(held[offset - begin : offset - begin + length]))
                k = to

    def page(path: str, fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        length, kind = int(fields["payload-length"]), fields["warc-type"]
        if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
            raise ValueError(f"{path}: a payload differs from its digest")
        link = json.loads(fields["page-address"]) if "page-address" in fields else fields["warc-target-uri"]
        to = json.loads(fields["refers-to-page-id"]) if kind == "revisit" else None
        return json.loads(fields["page-id"]), link, length, digest, kind, to, payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, total, part in zip(*b.to_pydict().values(), strict=True):
                held: list[tuple] = []
                size = 0
                for x in records(path, total, part):
                    held.append(x[: len(names)])
                    size += x[2] if payloads else 0
                    if len(held) == STEP or size >= READ_BYTES:
                        yield _batch(held, names, types)
                        held, size = [], 0
                yield _batch(held, names, types)

    return ranges.repartition(min(parts, MOST_PARTS), "path", "part").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)
