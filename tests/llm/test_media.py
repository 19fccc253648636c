import gzip
import hashlib
import io
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import media
from tests.llm.conftest import same


def png():
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"data\xff\x00more\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"


def zipped():
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
        f.write(b"hello" * 100)
    return out.getvalue()


MEDIA = [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", PDF), ("application/gzip", zipped()), ("audio/wav", media.wav_bytes(b"abc"))]


@pytest.mark.parametrize(("kind", "blob"), MEDIA, ids=[m[0] for m in MEDIA])
def test_formats_and_carving(kind, blob):
    finder = media.automaton()
    assert media.locate(blob, finder) == [(kind, 0, len(blob))]
    inside = b"junk RIFF \xff\xd8\xff GIF89a" + blob + b"tail" + blob
    parts = [{"start": s, "length": n} for t, s, n in media.locate(inside, finder) if t == kind]
    assert media.carve(inside, parts) == [blob, blob]
    assert not [x for x in media.locate(blob[:-1], finder) if x[1] == 0 and x[0] == kind]


def test_a_damaged_body_is_not_confirmed():
    bad = bytearray(png())
    bad[20] ^= 1
    assert media.locate(bytes(bad), media.automaton()) == []


def test_wav_round_trip():
    for samples in (b"", b"a", b"ab" * 500):
        assert media.wav_samples(media.wav_bytes(samples)) == samples


def test_declared_types_are_corrected(spark):
    d = spark.createDataFrame([(0, "image/png", bytearray(GIF), "x"), (1, "image/gif", bytearray(GIF), "x"), (2, None, bytearray(b"text"), "x"), (3, "image/png", None, "x"), (4, "x", bytearray(b""), "x")], "id long, declared string, content binary, media_type string")
    got = {r.id: (r.media_type, r.corrected, len(r.parts)) for r in media.sniff(d).collect()}
    assert got == {0: ("image/gif", True, 1), 1: ("image/gif", False, 1), 2: ("application/octet-stream", True, 0), 3: ("application/octet-stream", True, 0), 4: ("application/octet-stream", True, 0)}


def test_digests(docs, rows):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    got = media.media_digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = texts[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(padded)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(media.wav_bytes(padded)).hexdigest() and r.media_bytes == len(padded) + 44
        assert r.feature.startswith("audio/wav;corrected=1;parts=1")


def test_zero_bytes_and_tables(spark, docs, crowded, empty):
    d = spark.createDataFrame([(1, "a\0\0")], "doc_id long, text string")
    assert media.media_digests(d).first().n_bytes == 3
    assert media.media_digests(empty).count() == 0
    assert same(media.media_digests(docs), media.media_digests(crowded))
    assert media.media_digests(docs.where(F.col("text") == "one")).select("media_sha256", "feature").distinct().count() == 1


def test_media_inside_others():
    finder = media.automaton()
    song = media.wav_bytes(b"x" * 7 + GIF + png() + b"yy" + JPEG)
    got = media.nested(b"ab" + song + GIF, finder)
    assert [(k, parent, depth) for k, _, _, parent, depth in got] == [("audio/wav", -1, 0), ("image/gif", 0, 1), ("image/png", 0, 1), ("image/jpeg", 0, 1), ("image/gif", -1, 0)]
    assert (b"ab" + song + GIF)[got[2][1] : got[2][1] + got[2][2]] == png()
    thumb = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(JPEG)) + JPEG + JPEG[2:]
    assert [(s, n, d) for _, s, n, _, d in media.nested(thumb, finder)] == [(0, len(thumb), 0), (6, len(JPEG), 1)]
    assert [k for k, *_ in media.nested(zipped() + GIF, finder)] == ["application/gzip", "image/gif"]


def test_updated_pdf_is_carved_whole():
    finder = media.automaton()
    updated = PDF + b"\n2 0 obj\nendobj\nstartxref\n9\n%%EOF"
    assert media.locate(updated + b" x " + PDF, finder) == [("application/pdf", 0, len(updated)), ("application/pdf", len(updated) + 3, len(PDF))]
    assert media.locate(b"%PDF-1.4 startxref %%EOF", finder) == []


def test_fill_bytes_and_progressive_scans():
    blob = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xff" + b"\xff\xda" + struct.pack(">H", 3) + b"xdata\xff\x00\xff\xd0more\xff\xda" + struct.pack(">H", 3) + b"ytail\xff\xd9"
    assert media.locate(blob + b"zz", media.automaton()) == [("image/jpeg", 0, len(blob))]


@pytest.mark.parametrize("piece", [b"%PDF-1.4 ", b"GIF89a" + bytes(6), b"\xff\xd8\xff\xda\x00\x03x", b"RIFF\0\0\0\0WAVE", PDF[:-5], b"GIF89a" + bytes(7) + b"\x21\x01\x05"])
def test_many_false_starts_take_linear_time(piece):
    import time

    blob, finder = piece * (4_000_000 // len(piece)), media.automaton()
    began = time.time()
    media.nested(blob, finder)
    assert time.time() - began < 15


def _adversary(kind, n):
    """Starts whose walk, CRC or stream would each go on to the end of the value."""
    if kind == "wav":
        return b"".join(b"RIFF" + struct.pack("<I", 4) + b"WAVE" if i % 2 else b"RIFF" + struct.pack("<I", n - 12 * i - 8) + b"WAVE" for i in range(n // 12))
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + bytes(13) + struct.pack(">I", zlib.crc32(b"IHDR" + bytes(13)))
    if kind == "png":
        return b"".join(head + struct.pack(">I4s", n - 41 * i - 53, b"IDAT") for i in range(n // 41 - 2)) + bytes(200)
    return b"\x1f\x8b\x08\x08\0\0\0\0\0\1" * (n // 10)


@pytest.mark.parametrize("kind", ["wav", "png", "gzip"])
def test_long_walks_take_linear_time(kind):
    import time

    finder, took = media.automaton(), []
    for n in (400_000, 4_000_000):
        blob = _adversary(kind, n)
        began = time.time()
        media.nested(blob, finder)
        took.append(time.time() - began)
    print(kind, took)
    assert took[1] < 40 * max(took[0], 0.05)


def test_wav_chains_and_checksums_equal_plain_walks():
    import random

    rng = random.Random(5)
    for _ in range(200):
        parts = [rng.choice([b"fmt ", b"data", b"junk", b"RIFF"]) + struct.pack("<I", rng.choice([0, 1, 2, 4, 12, 20])) + bytes(rng.choice([0, 2, 4])) for _ in range(30)]
        blob = b"".join(parts)
        chains = media.Chains(blob, list(range(0, len(blob), 4)))
        for start in range(0, len(blob), 4):
            for end in range(start, len(blob) + 1, 2):
                at, fmt, data = start, 0, 0
                while at < end and at + 8 <= len(blob):
                    size = struct.unpack_from("<I", blob, at + 4)[0]
                    fmt, data = fmt + (blob[at : at + 4] == b"fmt "), data + (blob[at : at + 4] == b"data")
                    at += 8 + size + (size & 1)
                assert chains.between(start, end) == ((fmt, data) if at == end else None)
    big = bytes(rng.randrange(256) for _ in range(60_000))
    sums = media.Checksums(big)
    for _ in range(200):
        i, j = sorted(rng.randrange(60_001) for _ in range(2))
        assert sums.of(i, j) == zlib.crc32(big[i:j])


def test_gzip_heads():
    finder = media.automaton()
    for flags, extra in ((0, b""), (8, b"name.txt\0"), (4, b"\3\0abc"), (16, b"said\0"), (2, b"\0\0"), (28, b"\1\0xn\0c\0")):
        blob = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + extra + zipped()[10:]
        assert media.locate(b"zz" + blob + b"zz", finder) == [("application/gzip", 2, len(blob))]
        for k in (len(blob) - 3, len(blob) - 6):
            assert not media.locate(blob[:k] + bytes([blob[k] ^ 1]) + blob[k + 1 :], finder)


def test_embedded_media_show_in_the_feature(spark):
    gif = "GIF89a" + "\x01\0" * 2 + "\0\0\0" + "," + "\0" * 4 + "\x01\0\x01\0\0" + "\x02\x02D\x01\0;"
    texts = ["plain prose", "plain " + gif, gif, "see " + PDF.decode() + " here", PDF.decode(), "plain prose"]
    got = {r.doc_id: r.feature for r in media.media_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[5] and "payload=text/plain;embedded=;" in got[0]
    assert f"payload=text/plain;embedded=image/gif:1:{len(gif)};" in got[1] and f"payload=image/gif;embedded=image/gif:1:{len(gif)};" in got[2]
    assert f"embedded=application/pdf:1:{len(PDF)};" in got[3] and "payload=application/pdf;" in got[4]
