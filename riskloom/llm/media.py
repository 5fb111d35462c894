"""Media columns: lossless PNG images in binary columns, checked on reading, with a perceptual hash of their low frequencies.

`store_png` writes byte strings as 8-bit RGB images, `read_png` reads images back and describes them. Both work row by
row within a partition, without a shuffle. Row filters are chosen per image among none, sub and up; the reader undoes
all five filters of the format.

Cases: a null payload is an empty one. An empty payload becomes one row of blanks. A broken image (bad signature,
checksum, chunk order, size or filter) raises `BadImage`. Images that the reader does not cover (interlaced, palette,
other depths than 8) raise it too. Very long texts make tall images, none is cut. Null identifiers and repeated rows pass
through, row by row; only doc_id and the text are read, so extra columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

WIDTH = 64
ROW_BYTES = 3 * WIDTH
SIDE, LOW = 32, 8


class BadImage(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(payload: bytes, multiple: int = ROW_BYTES) -> bytes:
    """The payload with blanks up to a positive multiple of `multiple` bytes."""
    return payload + b" " * (-len(payload) % multiple or (0 if payload else multiple))


def encode_png(samples: bytes, width: int = WIDTH, colour: int = 2, level: int = 6, row_filter: int | None = None) -> bytes:
    """An 8-bit PNG of the samples. Without `row_filter` (0 none, 1 sub, 2 up), the one of least absolute sum is taken."""
    pixel = CHANNELS[colour]
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width * pixel)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, pixel:] = rows[:, :-pixel]
    above[1:] = rows[:-1]
    choices = {0: rows, 1: rows - left, 2: rows - above}
    if row_filter is None:
        row_filter = min(choices, key=lambda k: (int(np.abs(choices[k].view(np.int8).astype(np.int16)).sum()), k))
    lines = np.empty((len(rows), 1 + rows.shape[1]), np.uint8)
    lines[:, 0] = row_filter
    lines[:, 1:] = choices[row_filter]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data):
            raise BadImage("cut short")
        if struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(data[at + 4 : end - 4]):
            raise BadImage(f"checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise BadImage("no end")


def _unfilter(lines: np.ndarray, pixel: int) -> np.ndarray:
    kinds, raw = lines[:, 0], lines[:, 1:]
    out = np.empty_like(raw)
    if len(set(kinds.tolist())) == 1 and kinds[0] < 3:
        if kinds[0] == 0:
            return raw.copy()
        if kinds[0] == 2:
            return np.add.accumulate(raw, axis=0, dtype=np.uint8)
        return np.add.accumulate(raw.reshape(len(raw), -1, pixel), axis=1, dtype=np.uint8).reshape(raw.shape)
    above = np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 0:
            row = raw[y]
        elif kind == 1:
            row = np.add.accumulate(raw[y].reshape(-1, pixel), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = raw[y] + above
        elif kind in (3, 4):
            row = np.zeros_like(above)
            left = corner = np.zeros(pixel, np.int16)
            for x in range(0, len(row), pixel):
                up = above[x : x + pixel].astype(np.int16)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = left + up - corner
                    a, b, c = abs(near - left), abs(near - up), abs(near - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = (raw[y, x : x + pixel] + guess) & 255
                row[x : x + pixel] = left
                corner = up
        else:
            raise BadImage(f"filter {kind}")
        out[y] = above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels)."""
    header, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[2] != 8 or header[3] not in CHANNELS or any(header[4:]):
        raise BadImage("not an 8-bit image without interlacing")
    width, height, pixel = header[0], header[1], CHANNELS[header[3]]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise BadImage(str(error)) from error
    if lines.size != height * (1 + width * pixel):
        raise BadImage("wrong number of samples")
    return _unfilter(lines.reshape(height, -1), pixel).reshape(height, width, pixel)


@lru_cache(4096)
def _low_frequencies(n: int) -> np.ndarray:
    """LOW x n integers: n samples averaged by area into SIDE cells, then their LOW first cosine terms, in units of 2**-16."""
    edges, cells = np.arange(n + 1) * SIDE / n, np.arange(SIDE)[:, None]
    share = np.clip(np.minimum(edges[1:], cells + 1) - np.maximum(edges[:-1], cells), 0, None)
    waves = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1) / (2 * SIDE))
    return np.rint(waves @ share * 2**16).astype(np.int64)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine terms of the grey image exceed their median. Integers only, so equal images agree anywhere."""
    grey = samples.sum(axis=2, dtype=np.int64)
    terms = (_low_frequencies(grey.shape[0]) @ grey >> 8) @ _low_frequencies(grey.shape[1]).T
    flat = terms.ravel()
    bits = flat > np.median(flat[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def store_png(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Adds the column `media`: the binary column `payload` as an image; the payload's own length goes to `n_bytes`."""

    def work(batches):
        for batch in slices(batches, text=payload):
            payloads = batch.column(payload).to_pylist()
            images = [encode_png(padded(x or b"")) for x in payloads]
            kept = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != payload]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x or b"") for x in payloads], pa.int64()), pa.array(images, pa.binary())], names=names)

    rest = df.drop(payload, media, "n_bytes")
    names = [*rest.columns, "n_bytes", media]
    return df.select(*rest.columns, payload).mapInArrow(work, rest.withColumns({"n_bytes": F.lit(0).cast("long"), media: F.lit(b"")}).schema)


def read_png(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the images back: payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256, feature, width, height in place of `media`."""

    def describe(image: bytes) -> tuple:
        samples = decode_png(image)
        payload = samples.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples), samples.shape[1], samples.shape[0])

    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
    fields = [x.split(" ") for x in new.split(", ")]

    def work(batches):
        for batch in slices(batches, text=media):
            found = list(zip(*map(describe, batch.column(media).to_pylist()))) or [[]] * len(fields)
            kept = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != media]
            arrays = [pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, (_, kind) in zip(found, fields)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=names)

    rest = df.drop(media, *(x for x, _ in fields))
    names = [*rest.columns, *(x for x, _ in fields)]
    return df.select(*rest.columns, media).mapInArrow(work, rest.withColumns({x: F.lit(None).cast(kind) for x, kind in fields}).schema)


def documents_as_media(documents: DataFrame) -> DataFrame:
    """Every whole text as an image, read back."""
    return read_png(store_png(documents.select("doc_id", F.col("text").cast("binary").alias("payload"))))
