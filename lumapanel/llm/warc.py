"""Web archives packed in ZIP files: written by tasks, read back by byte ranges.

One archive per task: a ZIP file whose members are *stored*, ``archive/data.warc.gz``
(one gzip member per WARC record), ``indexes/index.cdxj`` (offset and length of each
record) and ``datapackage.json``. The reader parses the end of the file, the ZIP64
and the central directory, finds the members' bytes and fetches only the ranges it
wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .store import attempt_name, located, new_folder, open_output

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # the tables have no fetch times; a fixed date keeps reruns equal
RANGE_BYTES = 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP directory -----------------------------------------------------------


def zip_directory(file: pa.NativeFile, size: int) -> dict[str, dict]:
    """Members by name: method, stored size and place of the data, from the directories at the end of the file."""
    tail_at = max(0, size - (65557 + 20))
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (record_at,) = struct.unpack_from("<Q", tail, locator + 8)
        record = _range(file, record_at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    elif 0xFFFF == count or 0xFFFFFFFF in (length, at):
        raise ValueError("ZIP64 locator is missing")
    members, directory, p = {}, _range(file, at, length), 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, p + 20)
        (local,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values, only of the fields that are full
                q = e + 4
                if plain == 0xFFFFFFFF:
                    (plain,), q = struct.unpack_from("<Q", extra, q), q + 8
                if packed == 0xFFFFFFFF:
                    (packed,), q = struct.unpack_from("<Q", extra, q), q + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", extra, q)
            e += 4 + n
        head = _range(file, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name2, n_extra2 = struct.unpack_from("<HH", head, 26)
        members[name] = {"method": method, "size": packed, "at": local + 30 + n_name2 + n_extra2}
        p += 46 + n_name + n_extra + n_note
    return members


def _range(file: pa.NativeFile, at: int, length: int) -> bytes:
    file.seek(at)
    data = file.read(length)
    if len(data) != length:
        raise ValueError("archive is cut short")
    return data


def stored_member(members: dict[str, dict], name: str) -> dict:
    member = members[name]
    if member["method"] != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is not stored, so its records can't be read by range")
    return member


# --- records -----------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    return None if record is None or record == "<urn:page:none>" else int(record[10:-1])


def build_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response record, or a revisit (``payload`` None) that keeps only the HTTP head."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "revisit" if payload is None else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; a response's payload must have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length: "))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


# --- jobs --------------------------------------------------------------------


def plan_records(pages: DataFrame, min_bytes: int = 0, row_id: str | None = None) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): payload null for a revisit.

    Of equal payloads of ``min_bytes`` or more, the row with the largest page_id
    (null smallest, then the later row) is the response; the others keep only
    its id. Digests are compared with their lengths. Null html is an empty
    payload. Without ``row_id`` the rows are told apart by their place in the
    input, which must then read the same each time, as files do.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), rid.alias("_row"))
    rows = rows.withColumn("_sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    best = rows.groupBy("_sha", "size").agg(F.max(F.struct("page_id", "_row")).alias("_best"))
    both = rows.join(best.withColumnsRenamed({"_sha": "_sha2", "size": "_size2"}), (F.col("_sha") == F.col("_sha2")) & (F.col("size") == F.col("_size2")))
    first = (F.col("_row") == F.col("_best._row")) | (F.col("size") < min_bytes)
    return both.select(
        "page_id",
        "url",
        F.when(first, F.col("payload")).alias("payload"),
        "size",
        F.unhex("_sha").alias("digest"),
        F.when(~first, F.col("_best.page_id")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the records of :func:`plan_records`, one archive per task; returns (path, records, bytes).

    The result is saved: it lists the archives of the attempts that finished.
    """
    folder = folder or new_folder(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, archive, member, index, at = attempt_name(folder, ".wacz"), None, None, None, io.StringIO(), 0
        count = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, size, digest, refers = (c[k].as_py() for c in batch.columns)
                if archive is None:
                    out = open_output(path)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
                raw = build_record(page, url, payload, size, base64.b32encode(digest).decode(), refers)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                member.write(packed)
                index.write(f"{count:012d} {json.dumps({'offset': at, 'length': len(packed)})}\n")
                at += len(packed)
                count += 1
        if archive is not None:
            member.close()
            archive.writestr(zipfile.ZipInfo(INDEX_MEMBER), index.getvalue())
            archive.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "records": count}))
            archive.close()
            total = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [total]})

    return saved(records.mapInArrow(write, "path string, records long, bytes long"), "archives")


def find_ranges(archives: DataFrame, limit: int = RANGE_BYTES) -> DataFrame:
    """(path, at, length): byte ranges of whole records, of about ``limit`` bytes, from each archive's own index."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, name = located(path)
                with fs.open_input_file(name) as file:
                    members = zip_directory(file, file.size())
                    index = stored_member(members, INDEX_MEMBER)
                    data = stored_member(members, WARC_MEMBER)
                    rows, low, high = [], 0, 0
                    for line in _range(file, index["at"], index["size"]).decode().splitlines():
                        entry = json.loads(line.split(" ", 1)[1])
                        if high > low and entry["offset"] + entry["length"] - low > limit:
                            rows.append((low, high - low))
                            low = entry["offset"]
                        high = entry["offset"] + entry["length"]
                    if high > low:
                        rows.append((low, high - low))
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path] * len(rows), "at": [data["at"] + a for a, _ in rows], "length": [n for _, n in rows]}
                    )

    wide = archives.select("path").repartition(max(1, archives.count()), "path")
    return saved(wide.mapInArrow(find, "path string, at long, length long"), "ranges")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """Parsed records of the byte ranges of :func:`find_ranges`; ``payload`` (binary) is null for revisits."""
    fields = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in fields.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in fields.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length in zip(*(batch[c].to_pylist() for c in ("path", "at", "length")), strict=True):
                fs, name = located(path)
                with fs.open_input_file(name) as file:
                    raw = _range(file, at, length)
                found = []
                while raw:
                    unpack = zlib.decompressobj(31)
                    found.append(parse_record(unpack.decompress(raw)))
                    raw = unpack.unused_data
                yield pa.RecordBatch.from_pydict({n: [x[n] for x in found] for n in names}, schema=schema)

    n = max(1, ranges.count())
    return ranges.repartition(n, "path", "at").mapInArrow(read, fields)


def archive_pages(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write every row of (page_id, url, html) as a WARC record and read the archives back.

    Repeated rows are records of their own. Null page_id and url stay null; an
    empty table writes no archive and gives no record.
    """
    archives = write_archives(plan_records(pages.select("page_id", "url", "html"), min_bytes))
    return read_records(find_ranges(archives), payloads)
