"""WARC archives: one gzip member per record, written and read as a stream."""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A writer starts a new archive when the present one has so many compressed bytes.
ARCHIVE_BYTES = 4 << 20
READ_BYTES = 1 << 16
#: A head (of a record or of HTTP) that is longer is not one.
HEAD_BYTES = 1 << 20
ARCHIVES = "name string, content binary"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str, payload: bytes, kind: str, refers_to: str | None, payload_bytes: int | None = None, payload_digest: str | None = None) -> bytes:
    """One record with its closing blank lines; a revisit has the HTTP head only, and may be told its payload's length and digest."""
    length = len(payload) if payload_bytes is None else payload_bytes
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PLANNED = ("record_id", "uri", "html", "kind", "refers_to", "payload_bytes", "sha1")


def _members_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The gzip member of each planned record."""
    for record_id, uri, html, kind, refers_to, size, sha1 in zip(*(batch.column(c) for c in PLANNED), strict=True):
        target = (uri.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
        told = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
        raw = record_bytes(record_id.as_py(), target, (html.as_py() or "").encode(), kind.as_py(), refers_to.as_py(), size.as_py(), told)
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        yield packer.compress(raw) + packer.flush()


def write_archives(rows: DataFrame) -> DataFrame:
    """Archives of planned ``rows`` as a table (name, content), in their partitions' order.

    Null html is an empty payload, a null uri an empty one; CR and LF in a uri become %0D
    and %0A. An archive ends at ARCHIVE_BYTES or with its partition, so memory is bounded
    by that and one record. An empty table gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            content = b"".join(parts)
            return pa.RecordBatch.from_pydict({"name": [f"{hashlib.sha1(content).hexdigest()}.warc.gz"], "content": pa.array([content], pa.binary())})

        size = 0
        for batch in batches:
            for member in _members_of(batch):
                parts.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts.clear()
                    size = 0
        if parts:
            yield close()

    return rows.select(*PLANNED).mapInArrow(write, ARCHIVES)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of planned ``rows`` as .warc.gz files in ``folder``, which all executors share: (path, n_records, n_bytes) of each.

    Records are as in write_archives. Members go to the file as they are made, so memory is
    bounded by one record. A file's name is new each time, so what a lost or repeated task
    leaves behind is in no row; write the result to a table before reading from it.
    """
    place = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(place)
        store.create_dir(base, recursive=True)
        out, path, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{place}/{path}"], "n_records": [records], "n_bytes": [size]})

        for batch in batches:
            for member in _members_of(batch):
                if out is None:
                    path, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select(*PLANNED).mapInArrow(write, "path string, n_records long, n_bytes long")


class Truncated(ValueError):
    pass


class Archive:
    """Compressed bytes that arrive in pieces; each gzip member is inflated READ_BYTES at a time, at most."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held = iter(pieces), b""

    def more(self) -> bool:
        """Whether another byte is there."""
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held = piece
        return True

    def member(self) -> Iterator[bytes]:
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            if not self.more():
                raise Truncated("the archive ends inside a gzip member")
            out = inflater.decompress(self.held, READ_BYTES)
            self.held = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if out:
                yield out


@dataclass
class Body:
    """Inflated bytes, read forward."""

    pieces: Iterator[bytes]
    held: bytes = b""

    def take(self, most: int) -> bytes:
        """Up to ``most`` of the next bytes, empty only at the end."""
        while not self.held:
            self.held = next(self.pieces, None)
            if self.held is None:
                self.held = b""
                return b""
        out, self.held = self.held[:most], self.held[most:]
        return out

    def head(self) -> bytes | None:
        """What stands before the first blank line, which is skipped; None if there is none within HEAD_BYTES."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            piece = next(self.pieces, None) if len(self.held) <= HEAD_BYTES else None
            if piece is None:
                return None
            self.held += piece
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out


def fields_of(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the named fields: names in lower case, continuation lines joined, the last of equal names."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return first, found


def agrees(told: str, content: bytes) -> bool:
    """Whether a labelled digest is that of the content; labels that are not known agree with all."""
    label, _, value = told.partition(":")
    if label.lower() not in ("sha1", "sha256", "md5") or not value:
        return True
    made = hashlib.new(label.lower(), content).digest()
    return value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=") or value.lower() == made.hex()


def unchunked(body: bytes) -> bytes | None:
    """A body of HTTP chunks, joined; None if the framing is wrong."""
    at, out = 0, []
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


@dataclass
class Record:
    record_id: str | None = None
    record_type: str | None = None
    target_uri: str | None = None
    refers_to: str | None = None
    payload: bytes | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    problem: str | None = None
    fields: dict[str, str] = field(default_factory=dict, repr=False)

    def told(self) -> dict:
        return {k: getattr(self, k) for k in _RECORD.names}


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])


def read_record(pieces: Iterator[bytes]) -> Record:
    """One record from its inflated pieces, framed by Content-Length; ``problem`` names what is wrong, else null.

    The payload is the HTTP body of a response (chunks joined) or request, the block of other
    types; a revisit has none, its length is what its HTTP head says. A digest that the record
    does not tell is not verified; that of a payload is then computed.
    """
    body, out = Body(pieces), Record()

    def bad(problem: str) -> Record:
        out.problem = problem
        for _ in body.pieces:
            pass
        return out

    head = body.head()
    if head is None:
        return bad("head")
    version, out.fields = fields_of(head)
    named = out.fields
    out.record_id, out.record_type, out.target_uri = ((named.get(n) or None) for n in ("warc-record-id", "warc-type", "warc-target-uri"))
    out.record_id = out.record_id.strip("<>") if out.record_id else None
    out.target_uri = out.target_uri.strip("<>") if out.target_uri else out.target_uri if "warc-target-uri" not in named else ""
    out.refers_to = named["warc-refers-to"].strip("<>") if named.get("warc-refers-to") else None
    told = named.get("warc-payload-digest")
    out.payload_digest = told.partition(":")[2] if told else None
    if not version.startswith("WARC/"):
        return bad("version")
    if not out.record_id or not out.record_type:
        return bad("missing field")
    if not named.get("content-length", "").isdigit():
        return bad("content length")
    left = int(named["content-length"])
    parts = []
    while left and (piece := body.take(left)):
        parts.append(piece)
        left -= len(piece)
    block = b"".join(parts)
    end = b""
    while len(end) < 5 and (piece := body.take(5 - len(end))):
        end += piece
    if left or end != b"\r\n\r\n":
        return bad("framing")
    if "warc-block-digest" in named and not agrees(named["warc-block-digest"], block):
        return bad("block digest")
    http = named.get("content-type", "").lower().startswith("application/http")
    if not http:
        out.payload = None if out.record_type == "revisit" else block
    else:
        top, blank, raw = block.partition(b"\r\n\r\n")
        if not blank and out.record_type != "revisit":
            return bad("http head")
        _, said = fields_of(top)
        size = said.get("content-length", "")
        if out.record_type == "revisit":
            out.payload_bytes = int(size) if size.isdigit() else None
        else:
            chunked = "chunked" in said.get("transfer-encoding", "").lower()
            out.payload = unchunked(raw) if chunked else raw
            if out.payload is None:
                return bad("chunks")
            if told and not agrees(told, raw) and not agrees(told, out.payload):
                return bad("payload digest")
            if size.isdigit() and not chunked and int(size) != len(raw):
                return bad("payload length")
    if out.payload is not None:
        out.payload_bytes = len(out.payload)
        if not http and told and not agrees(told, block):
            return bad("payload digest")
        out.payload_digest = out.payload_digest or digest(out.payload)
    return out


def records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive, one gzip member each; where a member is damaged or cut off, the last one says so."""
    archive = Archive(pieces)
    while archive.more():
        try:
            yield read_record(archive.member())
        except (Truncated, zlib.error, binascii.Error) as e:
            yield Record(problem=str(e) or "gzip")
            return


def members(content: bytes) -> Iterator[bytes]:
    """Each gzip member's bytes."""
    archive = Archive([content])
    while archive.more():
        yield b"".join(archive.member())


def parse_record(raw: bytes) -> dict:
    """Fields of one record whose bytes are at hand."""
    return read_record(iter([raw])).told()


def _batched(found: Iterable[Record]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for record in found:
        held.append(record.told())
        size += len(record.payload or b"") + 256
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pylist(held, _RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of ``archives``: any table with a binary ``content``, such as the binaryFile source.

    An archive is read from its first byte to its last, one record in memory at a time
    beside the compressed bytes. A record that is damaged is returned with its ``problem``, as
    is the place where an archive ends too soon.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batched(records([content.as_py() or b""]))

    return archives.select("content").mapInArrow(read, RECORDS)


def read_files(files: DataFrame) -> DataFrame:
    """Records of the .warc.gz files whose ``path`` the rows name: as read_archives, but READ_BYTES of a file in memory at a time.

    Paths are of a file system that pyarrow reads (file, hdfs, s3, gs). Files are dealt one by
    one to as many tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                with store.open_input_stream(name, compression=None) as source:
                    yield from _batched(records(iter(lambda: source.read(READ_BYTES), b"")))

    paths = files.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, RECORDS)


def plan_records(pages: DataFrame) -> DataFrame:
    """Rows to write (PLANNED): of pages with equal payloads the smallest page_id is the response, the rest revisit it.

    The first holder of a digest is found by an aggregate with partial sums. Responses are met
    by digest and id together, so the pages' text is not dealt by a digest that many share;
    revisits need no text, and join by digest in narrow rows, which AQE splits where hot. Rows
    that repeat the smallest page_id are all responses; a null id counts after all others.
    """
    text = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", F.col("url").alias("uri"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"))
    first = marked.groupBy(F.col("sha1").alias("_sha1")).agg(F.min("page_id").alias("_first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    same, holder = F.col("sha1") == F.col("_sha1"), F.col("page_id").eqNullSafe(F.col("_first"))
    size = F.octet_length("html").cast("long").alias("payload_bytes")
    responses = marked.join(first, same & holder).select(urn(F.col("page_id")).alias("record_id"), "uri", "html", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers_to"), size, "sha1")
    others = marked.select("page_id", "uri", size, "sha1").join(first, same).where(~holder)
    revisits = others.select(urn(F.col("page_id")).alias("record_id"), "uri", F.lit(None).cast("string").alias("html"), F.lit("revisit").alias("kind"), urn(F.col("_first")).alias("refers_to"), "payload_bytes", "sha1")
    return responses.unionByName(revisits)
