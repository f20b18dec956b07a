"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own, so an archive can be read from any of its members. The
reader's tasks get byte ranges of a file and know nothing of its members: a task looks for gzip's
magic bytes from the start of its range, takes a candidate for real if it decodes and begins with a
complete WARC header, and owns the records that start inside its range, reading past its end for the
last of them. No index is needed and no file is read by one task.

Files are written and read through pyarrow's file systems (local, HDFS, object stores) in the folder
that the cluster shares. A task writes under a name of its own and reports it; only reported files
are read, so a repeated or lost task leaves no double records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, step_path, stored

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 512 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 256 << 10
BROADCAST_ROWS = 500_000
TASKS_PER_CORE = 64
DATE = "2000-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, record_id string, refers_to_id string, problem string, path string, offset long"
)


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a location and the path in it."""
    if "://" not in uri:
        uri = re.sub("^file:", "", uri)
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of equal ones; lines that go on are joined, others left out."""
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    fields: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", text).splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunks, or None if it isn't one."""
    out, at = [], 0
    while True:
        line, end, _ = body[at : at + 64].partition(b"\r\n")
        size = line.partition(b";")[0].strip()
        if not end or not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        at += len(line) + 2
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if at + n > len(body):
            return None
        out.append(body[at : at + n])
        at += n + 2


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?[0-9]{1,19})>?", uri or "")
    return int(found[1]) if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _sha1(field: str | None) -> str | None:
    """The digest of a ``sha1:`` field as hexadecimal digits, from base 32 or 16; None for others."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def decode_records(data: bytes) -> Iterator[dict]:
    """The fields of the records of one uncompressed member, of whatever type and writer.

    What a record lacks is null: ``page_id`` and ``refers_to`` of records that ``write`` did not write (``record_id``
    and ``refers_to_id`` hold their identifiers as they stand). The payload is the body of an HTTP message, out of its
    chunks, and the whole block of other records. ``problem`` says what is wrong with a record that is given all
    the same.
    """
    while data.startswith(b"WARC/"):
        head, blank, rest = data.partition(b"\r\n\r\n")
        fields = _headers(head)
        kind = fields.get("warc-type", "").lower()
        size, problem = _number(fields.get("content-length")), None
        if not blank or size is None:
            problem, size = "no content length", len(rest)
        elif size > len(rest):
            problem = "cut off"
        block, data = rest[:size], rest[size:].lstrip(b"\r\n")
        payload, said = block, None
        if fields.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
            http, blank, payload = block.partition(b"\r\n\r\n")
            inner = _headers(http)
            said = _number(inner.get("content-length"))
            if inner.get("transfer-encoding", "").lower() == "chunked" and kind != "revisit":
                whole = _unchunked(payload)
                payload, problem = (payload, problem or "broken chunks") if whole is None else (whole, problem)
        revisit = kind == "revisit"
        yield {
            "page_id": _page(fields.get("warc-record-id")),
            "url": fields.get("warc-target-uri"),
            "record_type": kind or None,
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload_bytes": said if revisit else len(payload),
            "payload_digest": _sha1(fields.get("warc-payload-digest")) if revisit else hashlib.sha1(payload).hexdigest(),
            "payload": None if revisit else payload,
            "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"),
            "problem": problem if kind else problem or "no type",
        }


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_folder(folder)
        out, path, size, records = None, "", 0, 0

        def close() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(path, size, records)], columns=["path", "bytes", "records"])

        for batch in batches:
            ids, refs = batch["page_id"].astype("Int64"), batch["refers_to"].astype("Int64")
            for page_id, url, html, digest, ref in zip(ids, batch["url"], batch["html"], batch["digest"], refs):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    path, size, records = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = encode_record(
                    None if pd.isna(page_id) else int(page_id), url, html.encode(), digest, None if pd.isna(ref) else int(ref)
                )
                out.write(data)
                size += len(data)
                records += 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the stored list of files with their sizes.

    Of pages with equal payloads of ``MIN_REVISIT_BYTES`` bytes or more the one with the largest page_id
    is a response and the others revisit it; repeated rows of that page are responses too, and a null
    page_id is below all others. A null html is an empty payload, a null url is left out. Other columns
    are ignored. An empty table writes nothing.
    """
    folder = folder or step_path(pages.sparkSession, "archive")
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    long = rows.filter(F.octet_length("html") >= MIN_REVISIT_BYTES)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 AND winner IS NOT NULL").select("digest", "winner")
    marked = rows.join(small(stored(groups, "payloads"), BROADCAST_ROWS), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    out = marked.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stored(out.mapInPandas(_writer(folder), MANIFEST), "manifest")


def _member(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The uncompressed member that begins at ``at`` and its length, or None if none does."""
    unpack = zlib.decompressobj(31)
    out, pos = [], at
    checked = False
    f.seek(at)
    try:
        while not unpack.eof:
            data = f.read(min(READ_BYTES, size - pos)) if pos < size else b""
            if not data:
                return None
            out.append(unpack.decompress(data))
            pos += len(data)
            if not checked:
                head = b"".join(out)
                if len(head) >= 5 and not head.startswith(b"WARC/"):
                    return None
                checked = len(head) >= 5
    except zlib.error:
        return None
    data = b"".join(out)
    if b"\r\n\r\n" not in data or not data.startswith(b"WARC/"):
        return None
    return data, pos - len(unpack.unused_data) - at


def read_range(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, uncompressed bytes) of the records that start in ``start`` to ``end`` of an open file."""
    at = start
    window, base = b"", start
    while at < end:
        if not base <= at or at + len(MAGIC) > base + len(window):
            f.seek(at)
            # magic bytes may straddle the end of the range
            window, base = f.read(min(READ_BYTES, end + len(MAGIC) - 1 - at)), at
            if len(window) < len(MAGIC):
                return
        hit = window.find(MAGIC, at - base)
        if hit < 0:
            at = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= min(size, end + len(MAGIC) - 1):
                return
            continue
        at = base + hit
        if at >= end:
            return
        found = _member(f, at, size)
        if found:
            yield at, found[0]
            at += found[1]
        else:
            at += 1


def _reader(with_payload: bool):
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start, end in zip(batch["path"], batch["bytes"], batch["start"], batch["end"]):
                fs, base = open_folder(path)
                rows: list[dict] = []
                with fs.open_input_file(base) as f:
                    for offset, data in read_range(f, size, start, end):
                        for row in decode_records(data):
                            if not with_payload:
                                row["payload"] = None
                            rows.append(row | {"path": path, "offset": offset})
                            if len(rows) >= 200:
                                yield _frame(rows, columns)
                                rows = []
                if rows:
                    yield _frame(rows, columns)

    return run


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the files in ``files`` (path, bytes), as ``RECORD``; revisits have no payload.

    Every file is cut into ranges of ``split_bytes``, which are dealt over as many tasks, or ``TASKS_PER_CORE`` tasks
    for each core if there are more ranges. Archives of other writers are read too: records of every type are given,
    see ``decode_records``. A path without a scheme is a local one. Empty files and an empty table give no rows. A
    record is held in memory whole; bytes that begin no member are passed over.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    ranges = stored(ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes"))), "ranges")
    cores = files.sparkSession.sparkContext.defaultParallelism
    # a stated number: ranges weigh a few bytes each and would be merged into one task by their size
    tasks = max(1, min(ranges.count(), TASKS_PER_CORE * cores))
    return ranges.repartition(tasks).mapInPandas(_reader(with_payload), RECORD)
