from __future__ import annotations

import hashlib
import struct
import zlib

from rosterspark.llm import media


def png(width=3):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    raw = b"\0" + bytes(range(width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def bmp():
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xda\x00\x04\x01\x00" + b"ab\xff\x00c" + b"\xff\xd9"


def au():
    return struct.pack(">4sIIIII", b".snd", 24, 8, 2, 8000, 1) + bytes(8)


def aiff():
    body = b"AIFF" + b"COMM" + struct.pack(">I", 18) + bytes(18)
    return b"FORM" + struct.pack(">I", len(body)) + body


def test_each_format_is_found_whole_and_not_when_damaged():
    for kind, data in (("audio/wav", media.wav(bytes(64))), ("image/png", png()), ("image/gif", gif()), ("image/bmp", bmp()), ("image/jpeg", jpeg()), ("audio/basic", au()), ("audio/aiff", aiff())):
        assert media.sniff(data) == [(kind, 0, len(data))]
        assert (kind, 5, len(data)) in media.sniff(b"noise" + data + b"more")
        assert media.sniff(data[:-1]) == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == []
    assert media.sniff(None) == [] and media.sniff(b"") == [] and media.sniff(b"BM RIFF GIF89a FORM .snd") == []


def test_columns_are_corrected_and_media_carved(spark):
    rows = [(1, png(), "image/gif"), (2, media.wav(png() + bytes(7)), "audio/wav"), (3, None, "image/png"), (4, b"text", None), (5, gif(), None)]
    df = spark.createDataFrame(rows, "id int, data binary, declared string").selectExpr("*", "1 as embedded")
    out = {r["id"]: r for r in media.sniff_media(df, "data", "declared").collect()}
    assert (out[1]["media_type"], out[1]["corrected"]) == ("image/png", True)
    assert (out[2]["media_type"], out[2]["corrected"]) == ("audio/wav", False)
    assert [(e["type"], bytes(e["bytes"])) for e in out[2]["embedded"]] == [("image/png", png())]
    assert (out[3]["media_type"], out[3]["corrected"], out[4]["media_type"], out[5]["corrected"]) == ("image/png", False, None, True)


def test_texts_survive(docs, rows, empty):
    out = media.stored_texts(docs).collect()
    assert len(out) == len(rows)
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((str(r[0]), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == sorted(want)
    assert all("type=audio/wav;offset=0" in r["feature"] for r in out)
    assert len({(r["media_sha256"], r["feature"]) for r in out if r["n_bytes"] == 0}) == 1
    assert media.stored_texts(empty).count() == 0
