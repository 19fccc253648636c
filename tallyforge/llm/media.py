"""Media columns: signatures located by Aho-Corasick, confirmed by format validators."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Magic bytes of each format and its media type.
SIGNATURES = {
    "wav": (b"RIFF", "audio/wav"),
    "png": (b"\x89PNG\r\n\x1a\n", "image/png"),
    "gif87": (b"GIF87a", "image/gif"),
    "gif89": (b"GIF89a", "image/gif"),
    "jpeg": (b"\xff\xd8\xff", "image/jpeg"),
    "gzip": (b"\x1f\x8b\x08", "application/gzip"),
    "pdf": (b"%PDF-", "application/pdf"),
}
#: The marks that end a PDF's body, located in the same pass.
TRAILERS = {"startxref": b"startxref", "eof": b"%%EOF"}
UNKNOWN = "application/octet-stream"
#: Compressed bytes inside this type are not looked into.
OPAQUE = "application/gzip"
PARTS = T.ArrayType(T.StructType().add("media_type", "string").add("start", "long").add("length", "long").add("parent", "integer").add("depth", "integer"))


def wav_bytes(samples: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM, lossless; an odd number of samples gets RIFF's pad byte."""
    pad = b"\0" * (len(samples) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(blob: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


class Located:
    """The bytes of one value, where its signatures and trailers lie, and what validators have learned.

    A validator walks from block to block. Where a walk that passed a place ends is kept, so the
    walks from all signatures together visit each place once.
    """

    def __init__(self, blob: bytes, finder):
        self.blob = blob
        self.starts: list[tuple[int, str]] = []
        self.trailers: dict[str, list[int]] = {name: [] for name in TRAILERS}
        for last, (name, size) in finder.iter(blob.decode("latin-1")):
            if name in self.trailers:
                self.trailers[name].append(last - size + 1)
            else:
                self.starts.append((last - size + 1, name))
        self.starts.sort()
        self.pdfs = [at for at, name in self.starts if name == "pdf"]
        self.ends: dict[tuple[str, int], int | None] = {}
        self._marks: np.ndarray | None = None
        self._zeros: np.ndarray | None = None
        self._chains: Chains | None = None
        self.sums: Checksums | None = None

    def walk(self, kind: str, at: int, step: Callable[[bytes, int], tuple[int, bool] | None]) -> int | None:
        """Where the chain of blocks that begins at ``at`` ends: ``step`` gives the next block, and whether it is the end."""
        passed = []
        end = None
        while True:
            if (kind, at) in self.ends:
                end = self.ends[kind, at]
                break
            passed.append(at)
            found = step(self.blob, at)
            if found is None:
                break
            at, last = found
            if last:
                end = at
                break
        for place in passed:
            self.ends[kind, place] = end
        return end

    def chains(self) -> Chains:
        """The chunk chains behind all RIFF heads of the value."""
        if self._chains is None:
            self._chains = Chains(self.blob, [at + 12 for at, name in self.starts if name == "wav" and self.blob[at + 8 : at + 12] == b"WAVE"])
        return self._chains

    def zero_from(self, at: int) -> int:
        """The first zero byte from ``at`` on, or the end; each stretch is searched once."""
        if self._zeros is None:
            self._zeros = np.flatnonzero(np.frombuffer(self.blob, np.uint8) == 0)
        i = int(np.searchsorted(self._zeros, at))
        return int(self._zeros[i]) if i < len(self._zeros) else len(self.blob)

    def next_mark(self, at: int) -> int | None:
        """The first 0xFF from ``at`` on that begins a JPEG marker: not stuffed, filled or a restart."""
        if self._marks is None:
            b = np.frombuffer(self.blob, np.uint8)
            after = b[1:] if len(b) else b
            self._marks = np.flatnonzero((b[: len(after)] == 0xFF) & (after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7)))
        i = int(np.searchsorted(self._marks, at))
        return int(self._marks[i]) if i < len(self._marks) else None


class Chains:
    """Chains of RIFF chunks from many starts, as a forest in which each place leads to the next chunk.

    Each place is visited once, however many chains pass it. ``between`` tells in constant time whether the chain from one place
    passes another, and what chunks it meets before.
    """

    def __init__(self, b: bytes, starts: list[int]) -> None:
        onward: dict[int, int | None] = {}
        for at in starts:
            while at not in onward:
                if at + 8 > len(b):
                    onward[at] = None
                    break
                size = struct.unpack_from("<I", b, at + 4)[0]
                to = at + 8 + size + (size & 1)
                onward[at] = to if to <= len(b) else None
                if onward[at] is None:
                    break
                at = to
        self.seen: dict[int, tuple[int, int]] = {}
        before: dict[int, list[int]] = {}
        roots = []
        for at in sorted(onward, reverse=True):  # chains only lead on to later places
            to = onward[at]
            name = b[at : at + 4]
            fmt, data = self.seen[to] if to is not None else (0, 0)
            self.seen[at] = (fmt + (name == b"fmt "), data + (name == b"data"))
            (roots if to is None else before.setdefault(to, [])).append(at)
        self.enter: dict[int, int] = {}
        self.leave: dict[int, int] = {}
        clock, stack = 0, [(r, False) for r in roots]
        while stack:
            at, done = stack.pop()
            if done:
                self.leave[at] = clock
                continue
            self.enter[at] = clock
            clock += 1
            stack.append((at, True))
            stack += [(x, False) for x in before.get(at, ())]

    def between(self, at: int, end: int) -> tuple[int, int] | None:
        """How many format and data chunks the chain from ``at`` meets before ``end``; None if it does not pass there."""
        if end not in self.enter or not self.enter[end] <= self.enter[at] < self.leave[end]:
            return None
        return self.seen[at][0] - self.seen[end][0], self.seen[at][1] - self.seen[end][1]


def _wav(m: Located, at: int) -> int | None:
    b = m.blob
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or end < at + 12:
        return None
    met = m.chains().between(at + 12, end)
    return end if met and min(met) > 0 else None


class Checksums:
    """CRC-32 of any stretch of a value, from sums of its beginnings kept every STEP bytes.

    A CRC without its constants is linear, so that of a stretch is that of the value up to its end, less that of the
    value up to its start moved on by the stretch's length: a product of polynomials modulo the CRC's.
    """

    STEP = 1 << 11
    _moves: list[list[list[int]]] = []

    def __init__(self, b: bytes) -> None:
        self.b, self.kept = b, [0]
        for at in range(0, len(b), self.STEP):
            self.kept.append(zlib.crc32(b[at : at + self.STEP], self.kept[-1]))

    def _up_to(self, at: int) -> int:
        k = at // self.STEP
        return zlib.crc32(self.b[k * self.STEP : at], self.kept[k])

    def _table(self, level: int) -> list[list[int]]:
        """For each byte of a sum and its value, that byte moved on by 2**level zero bytes."""
        while len(self._moves) <= level:
            if not self._moves:
                one = lambda x: zlib.crc32(b"\0", x ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            else:
                last = self._moves[-1]
                one = lambda x, last=last: self._apply(last, self._apply(last, x))
            self._moves.append([[one(v << 8 * k) for v in range(256)] for k in range(4)])
        return self._moves[level]

    @staticmethod
    def _apply(table: list[list[int]], x: int) -> int:
        return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]

    def of(self, start: int, end: int) -> int:
        if end - start <= 4 * self.STEP:
            return zlib.crc32(self.b[start:end])
        moved, n, level = self._up_to(start), end - start, 0
        while n:
            if n & 1:
                moved = self._apply(self._table(level), moved)
            n, level = n >> 1, level + 1
        return self._up_to(end) ^ moved


def _png(m: Located, at: int) -> int | None:
    if m.blob[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    m.sums = m.sums or Checksums(m.blob)

    def chunk(b: bytes, at: int) -> tuple[int, bool] | None:
        if at + 12 > len(b):
            return None
        size, name = struct.unpack_from(">I4s", b, at)
        end = at + 12 + size
        if end > len(b) or m.sums.of(at + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        return end, name == b"IEND"

    return m.walk("png", at + 8, chunk)


def _sub_block(b: bytes, at: int) -> tuple[int, bool] | None:
    if at >= len(b):
        return None
    return (at + 1, True) if b[at] == 0 else (at + 1 + b[at], False)


def _gif(m: Located, at: int) -> int | None:
    b = m.blob
    if at + 13 > len(b):
        return None
    flags = b[at + 10]

    def block(b: bytes, at: int) -> tuple[int, bool] | None:
        if at >= len(b):
            return None
        mark = b[at]
        if mark == 0x3B:
            return at + 1, True
        if mark == 0x21:
            to = m.walk("gif-sub", at + 2, _sub_block)
        elif mark == 0x2C and at + 10 <= len(b):
            to = m.walk("gif-sub", at + 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0), _sub_block)
        else:
            return None
        return None if to is None else (to, False)

    return m.walk("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), block)


def _jpeg(m: Located, at: int) -> int | None:
    """Segments with lengths, fill bytes before markers, coded data after each scan header; at least one scan."""

    def segment(b: bytes, at: int) -> tuple[int, bool] | None:
        while at + 1 < len(b) and b[at] == 0xFF and b[at + 1] == 0xFF:
            at += 1
        if at + 2 > len(b) or b[at] != 0xFF:
            return None
        if b[at + 1] == 0xD9:
            return at + 2, True
        if at + 4 > len(b) or (size := struct.unpack_from(">H", b, at + 2)[0]) < 2:
            return None
        to: int | None = at + 2 + size
        if b[at + 1] == 0xDA:
            to = m.next_mark(to)
        return None if to is None else (to, False)

    return m.walk("jpeg", at + 2, segment) if m.blob[at + 3 : at + 4] != b"\xd9" else None


def _gzip(m: Located, at: int) -> int | None:
    """A member's head, its deflated data, and the sum and length behind it; of false starts little is read."""
    b, flags, to = m.blob, m.blob[at + 3] if at + 3 < len(m.blob) else 0xFF, at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        to += 2 + (struct.unpack_from("<H", b, to)[0] if to + 2 <= len(b) else len(b))
    for bit in (8, 16):
        to = m.zero_from(to) + 1 if flags & bit else to
    to += 2 if flags & 2 else 0
    inflater, size, crc, n = zlib.decompressobj(-15), 256, 0, 0
    try:
        while not inflater.eof and to < len(b):
            held = b[to : to + size]
            to, size = to + len(held), min(2 * size, 1 << 16)
            while held and not inflater.eof:
                made = inflater.decompress(held, 1 << 20)
                crc, n, held = zlib.crc32(made, crc), n + len(made), inflater.unconsumed_tail
    except zlib.error:
        return None
    end = to - len(inflater.unused_data) + 8
    return end if inflater.eof and end <= len(b) and struct.unpack_from("<II", b, end - 8) == (crc, n & 0xFFFFFFFF) else None


_VERSION = re.compile(rb"%PDF-\d\.\d")
_OFFSET = re.compile(rb"startxref\s+(\d+)\s+$")


def _pdf(m: Located, at: int) -> int | None:
    """To the last end mark before the next PDF's head, if a cross-reference offset stands before it."""
    if not _VERSION.match(m.blob, at):
        return None
    following = bisect_right(m.pdfs, at)
    limit = m.pdfs[following] if following < len(m.pdfs) else len(m.blob)
    i = bisect_left(m.trailers["eof"], limit) - 1
    if i < 0 or (end := m.trailers["eof"][i]) < at:
        return None
    j = bisect_left(m.trailers["startxref"], end) - 1
    if j < 0 or (start := m.trailers["startxref"][j]) < at or end - start > 64:
        return None
    found = _OFFSET.match(m.blob[start:end])
    return end + 5 if found and int(found[1]) <= start - at else None


_CONFIRM = {"wav": _wav, "png": _png, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "gzip": _gzip, "pdf": _pdf}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for name, magic in [*((n, m) for n, (m, _) in SIGNATURES.items()), *TRAILERS.items()]:
        found.add_word(magic.decode("latin-1"), (name, len(magic)))
    found.make_automaton()
    return found


def nested(blob: bytes, finder) -> list[tuple[str, int, int, int, int]]:
    """(media type, start, length, parent, depth) of confirmed media, by start; parent is a number in this list, or -1.

    Signatures inside a confirmed medium are confirmed too, if their medium ends within it.
    """
    held = Located(blob, finder)
    out: list[tuple[str, int, int, int, int]] = []
    inside: list[int] = []
    for start, name in held.starts:
        while inside and out[inside[-1]][1] + out[inside[-1]][2] <= start:
            inside.pop()
        parent = inside[-1] if inside else -1
        if parent >= 0 and out[parent][0] == OPAQUE:
            continue
        end = _CONFIRM[name](held, start)
        if end is None or (parent >= 0 and end > out[parent][1] + out[parent][2]):
            continue
        out.append((SIGNATURES[name][1], start, end - start, parent, len(inside)))
        inside.append(len(out) - 1)
    return out


def locate(blob: bytes, finder) -> list[tuple[str, int, int]]:
    """(media type, start, length) of the confirmed media that lie in no other, leftmost first."""
    return [part[:3] for part in nested(blob, finder) if part[3] < 0]


def sniff(media: DataFrame) -> DataFrame:
    """Find what the bytes of ``media`` (declared, content and any other columns) are.

    Added are ``media_type``: the type confirmed at byte 0, else the declared one if no signature says
    otherwise and it has none of those known here, else UNKNOWN; ``corrected``: that it differs
    from the declared one (null counts as differing); and ``parts``: all confirmed media, those
    inside others included, with their parent's number and depth, to be carved. Null or empty
    content has no parts. Clashing columns of these names are replaced.
    """
    kept = media.drop("media_type", "corrected", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        fields = ("media_type", "start", "length", "parent", "depth")
        part = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("parent", pa.int32()), ("depth", pa.int32())]))
        for batch in batches:
            declared = batch.column("declared").to_pylist()
            parts = [nested(c.as_py() or b"", finder) for c in batch.column("content")]
            kinds = [p[0][0] if p and p[0][1] == 0 else sniffed(d) for p, d in zip(parts, declared, strict=True)]
            fixed = pa.array([k != d for k, d in zip(kinds, declared, strict=True)], pa.bool_())
            carved = pa.array([[dict(zip(fields, x, strict=True)) for x in p] for p in parts], part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), fixed, carved], names=[*batch.schema.names, "media_type", "corrected", "parts"])

    added = T.StructType().add("media_type", "string").add("corrected", "boolean").add("parts", PARTS)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))


def sniffed(declared: str | None) -> str:
    """The type of bytes that no signature explains: what they are declared as, unless a signature would have to show it."""
    return declared if declared and declared.startswith("text/") else UNKNOWN


def carve(blob: bytes, parts: list[dict]) -> list[bytes]:
    return [blob[p["start"] : p["start"] + p["length"]] for p in parts]


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a WAV declared to be plain text.

    Null texts are empty and so hold 64 zeros. One row per document; repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(text.as_py() or "").encode() for text in batch.column("text")]
            blobs = [wav_bytes(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raws), pa.int64()), pa.array(["text/plain"] * len(raws), pa.string()), pa.array(blobs, pa.binary())], names=["doc_id", "n_bytes", "declared", "content"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, content binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text, sniff the stored bytes, carve the container and what lies in its samples, and digest what is read back.

    ``feature`` names the container's type, whether that corrected the declared one, the type
    of the payload itself (that of a medium at its first byte, else plain text), and how many media
    of each type lie in the payload, at any depth.
    """

    def feature(row: dict, payload: bytes) -> str:
        whole, *inner = row["parts"]
        first = next((p["media_type"] for p in inner if p["start"] == row["parts"][0]["start"] + 44), "text/plain")
        kinds = sorted({p["media_type"] for p in inner})
        found = ",".join(f"{k}:{sum(p['media_type'] == k for p in inner)}:{sum(p['length'] for p in inner if p['media_type'] == k)}" for k in kinds)
        return f"{row['media_type']};corrected={int(row['corrected'])};parts={len(row['parts'])};length={whole['length']};payload={first};embedded={found};mean={int(np.frombuffer(payload, np.uint8).mean())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                blob = row["content"]
                payload = wav_samples(carve(blob, row["parts"][:1])[0])
                rows.append(
                    {
                        "doc_id": row["doc_id"],
                        "n_bytes": row["n_bytes"],
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-64:]),
                        "media_bytes": len(blob),
                        "media_sha256": hashlib.sha256(blob).hexdigest(),
                        "feature": feature(row, payload),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return sniff(store_texts(docs)).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
