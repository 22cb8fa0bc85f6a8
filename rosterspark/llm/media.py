"""Media held in binary columns: what a value really is, and what else is in it.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass.  Each place found is only a candidate; a
validator of its format follows the structure (sizes, chunks, checksums, markers) and says how long the medium is.
A medium at the start of a value corrects its declared type, those further in are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import reserved

#: Magic bytes and the formats they announce.
MAGIC: tuple[tuple[bytes, str], ...] = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b".snd", "audio/basic"),
    (b"FORM", "audio/aiff"),
)
UNIT = 64
RATE = 8000

_AUTOMATON = None


def _automaton():
    """One for each Python worker; it works on text, so bytes are read as Latin-1."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for magic, kind in MAGIC:
            _AUTOMATON.add_word(magic.decode("latin-1"), (len(magic), kind))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def _riff(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) < at + 12:
        return None
    size, form = struct.unpack_from("<I", data, at + 4)[0] + 8, bytes(data[at + 8 : at + 12])
    if form not in (b"WAVE", b"WEBP", b"AVI ") or at + size > len(data):
        return None
    chunks = [name for name, _, _ in _chunks(data, at + 12, at + size, "<")]
    if not chunks or form == b"WAVE" and not {b"fmt ", b"data"} <= set(chunks):
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form], size


def _chunks(data: memoryview, at: int, end: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and size of each chunk; nothing more once one goes beyond the end."""
    while at + 8 <= end:
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if at + 8 + size > end:
            return
        yield bytes(data[at : at + 4]), at + 8, size
        at += 8 + size + (size & 1)


def _png(data: memoryview, at: int) -> tuple[str, int] | None:
    here = at + 8
    while here + 12 <= len(data):
        size, name = struct.unpack_from(">I", data, here)[0], bytes(data[here + 4 : here + 8])
        end = here + 12 + size
        if end > len(data) or zlib.crc32(data[here + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if (here == at + 8) != (name == b"IHDR"):
            return None
        if name == b"IEND":
            return "image/png", end - at
        here = end
    return None


def _gif(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) < at + 13:
        return None
    table_ = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    here = at + 13 + table_(data[at + 10])
    while here < len(data):
        mark = data[here]
        if mark == 0x3B:
            return "image/gif", here + 1 - at
        if mark == 0x21:
            here += 2
        elif mark == 0x2C and here + 10 < len(data):
            here += 11 + table_(data[here + 9])
        else:
            return None
        while here < len(data) and data[here]:
            here += data[here] + 1
        here += 1
    return None


def _jpeg(data: memoryview, at: int) -> tuple[str, int] | None:
    here, scans = at + 2, 0
    while here + 4 <= len(data) and data[here] == 0xFF:
        mark = data[here + 1]
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, here + 2)[0]
        if size < 2 or mark < 0xC0:
            return None
        here += 2 + size
        if mark == 0xDA:  # entropy-coded data up to a marker that is no stuffing and no restart
            scans += 1
            raw = bytes(data[here:])
            off = raw.find(b"\xff")
            while off >= 0 and off + 1 < len(raw) and (raw[off + 1] == 0 or 0xD0 <= raw[off + 1] <= 0xD7):
                off = raw.find(b"\xff", off + 2)
            if off < 0:
                return None
            here += off
    return ("image/jpeg", here + 2 - at) if scans and bytes(data[here : here + 2]) == b"\xff\xd9" else None


def _bmp(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) < at + 30:
        return None
    size, spare, begin, header = struct.unpack_from("<IIII", data, at + 2)
    sound = not spare and header in (12, 40, 52, 56, 108, 124) and 14 + header <= begin <= size and at + size <= len(data)
    return ("image/bmp", size) if sound else None


def _au(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) < at + 24:
        return None
    begin, size, coding, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    sound = begin >= 24 and 1 <= coding <= 27 and 0 < rate <= 768_000 and 0 < channels <= 64
    return ("audio/basic", begin + size) if sound and size != 0xFFFFFFFF and at + begin + size <= len(data) else None


def _aiff(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) < at + 12 or bytes(data[at + 8 : at + 12]) not in (b"AIFF", b"AIFC"):
        return None
    size = struct.unpack_from(">I", data, at + 4)[0] + 8
    if at + size > len(data):
        return None
    return ("audio/aiff", size) if b"COMM" in {n for n, _, _ in _chunks(data, at + 12, at + size, ">")} else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/basic": _au, "audio/aiff": _aiff}


def sniff(value: bytes | None) -> list[tuple[str, int, int]]:
    """Type, offset and length of every medium in ``value``, by offset; of those at one offset the longest.  Media
    inside others are listed too.  Null and empty values have none."""
    if not value:
        return []
    view, found = memoryview(value), {}
    for last, (size, kind) in _automaton().iter(value.decode("latin-1")):
        at = last - size + 1
        medium = VALIDATORS[kind](view, at)
        if medium and medium[1] > found.get(at, ("", 0))[1]:
            found[at] = medium
    return [(kind, at, size) for at, (kind, size) in sorted(found.items())]


def sniff_media(rows: DataFrame, data_col: str, declared_col: str) -> DataFrame:
    """``rows`` with ``media_type`` (what the value begins with; else the declared type), ``corrected`` (whether that
    is another than declared; comparison with null is true where a type was found) and ``embedded``, the media further
    in (type, offset, bytes).  Null values keep the declared type.  Columns of these names are replaced."""
    kind = T.StructType(
        [
            T.StructField("media_type", T.StringType()),
            T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("bytes", T.BinaryType())]))),
        ]
    )

    @F.pandas_udf(kind)
    def of(values: pd.Series) -> pd.DataFrame:
        out = []
        for value in values:
            media = sniff(value)
            first = media[0][0] if media and media[0][1] == 0 else None
            out.append((first, [{"type": k, "offset": at, "bytes": value[at : at + n]} for k, at, n in media if at]))
        return pd.DataFrame(out, columns=["media_type", "embedded"])

    plain = reserved(rows, "media_type", "corrected", "embedded", "__found")
    sniffed = plain.withColumn("__found", of(F.col(data_col)))
    actual = F.col("__found.media_type")
    return sniffed.select(
        *plain.columns,
        F.coalesce(actual, F.col(declared_col)).alias("media_type"),
        (actual.isNotNull() & ~actual.eqNullSafe(F.col(declared_col))).alias("corrected"),
        F.col("__found.embedded").alias("embedded"),
    )


def wav(samples: bytes) -> bytes:
    """``samples`` as one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(value: bytes) -> bytes:
    """The samples of a file that the validator accepts."""
    view = memoryview(value)
    return next(bytes(view[at : at + size]) for name, at, size in _chunks(view, 12, len(view), "<") if name == b"data")


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of ``text`` (null: empty) filled up with zero bytes to a positive multiple of 64; its length before."""
    raw = ("" if text is None else text).encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as sound under a type that often is declared wrongly, found by sniffing, carved and read back.

    ``feature`` says the declared and the found type, offset and length of the medium, the number of media inside it
    and their types.  Equal texts give equal rows but for the id; repeated rows and null ids do no harm; null texts count as
    empty (64 zero bytes); a text of any length is stored whole, at about four times its size in memory; an empty table
    gives an empty one; other columns, whatever their names, are ignored."""
    kind = docs.schema[id_col].dataType
    longs = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = T.StructType([T.StructField("i", kind), *[T.StructField(n, T.LongType() if n in longs else T.StringType()) for n in names]])
    types = to_arrow_schema(schema)

    def digest(text: str | None) -> tuple:
        samples, size = payload(text)
        medium = wav(samples)
        declared = ("audio/wav", "image/png", "audio/basic", "image/bmp")[zlib.crc32(samples) % 4]
        media = sniff(medium)
        found, at, length = media[0]
        back = wav_samples(medium[at : at + length])
        inside = sorted({k for k, off, _ in media if off > at})
        feature = f"declared={declared};type={found};offset={at};length={length};corrected={int(found != declared)};embedded={len(media) - 1}:{'+'.join(inside)}"
        return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(medium), hashlib.sha256(medium).hexdigest(), feature

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(digest, batch.column("t").to_pylist()))) or [()] * len(names)
            made = [pa.array(list(c), types.field(n).type) for n, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *made], schema.names)

    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return plain.mapInArrow(apply, schema).withColumnRenamed("i", id_col)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as 8-bit samples and read back; see :func:`stored_texts`."""
    return stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
