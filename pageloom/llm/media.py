"""Media columns: texts or samples stored as lossless WebP pictures, and pictures read back to pixel arrays.

A payload is the text's UTF-8 bytes and then zeros up to a positive multiple of 64. It is stored as grey pictures, 64
samples wide and at most 16,384 high, one after another if one is not enough. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import webp
from .common import small_batches

WIDTH = 64
PART = WIDTH * webp.MAX_SIDE
TOGETHER, SAMPLES_TOGETHER = 32, 1 << 17  # pictures that are written or read in step, and what they hold


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _groups(whole: Iterable[bytes], samples: Callable[[bytes], int]) -> Iterator[list[bytes]]:
    """Neighbours with SAMPLES_TOGETHER at most, or one alone if it has more."""
    group, size = [], 0
    for x in whole:
        more = samples(x)
        if group and (size + more > SAMPLES_TOGETHER or len(group) == TOGETHER):
            yield group
            group, size = [], 0
        group.append(x)
        size += more
    if group:
        yield group


def store(payload: bytes) -> bytes:
    """Each picture is stored in the smallest of several forms, whatever its size."""
    return next(stored_all([payload]))


def stored_all(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """store() of each."""
    for group in _groups(payloads, len):
        if len(group) > 1:
            yield from webp.in_step(webp.encoding_smallest(np.frombuffer(x, np.uint8), WIDTH) for x in group)
        else:
            data = np.frombuffer(group[0], np.uint8)
            yield b"".join(webp.encode_smallest(data[at : at + PART], WIDTH) for at in range(0, len(data), PART))


def files_of(stored: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(stored):
        if len(stored) - at < 8:
            raise webp.BadImage("bytes are left over")
        size = 8 + struct.unpack_from("<I", stored, at + 4)[0]
        yield stored[at : at + size]
        at += size


def _samples(px: np.ndarray) -> bytes:
    return px.view(np.uint8)[::4].tobytes()


def load(stored: bytes) -> bytes:
    return b"".join(_samples(webp.decode(f)[2]) for f in files_of(stored))


def _loading(stored: bytes) -> Generator:
    """load() for in_step()."""
    parts = []
    for f in files_of(stored):
        parts.append(_samples((yield from webp.decoding(f))[2]))
    return b"".join(parts)


def _said_samples(stored: bytes) -> int:
    """How many samples one picture's header says it has; what is no single picture as store() writes it stays alone."""
    if len(stored) < 25 or stored[12:16] != b"VP8L" or struct.unpack_from("<I", stored, 4)[0] + 8 != len(stored):
        return SAMPLES_TOGETHER
    sides = struct.unpack_from("<I", stored, 21)[0]
    return ((sides & 0x3FFF) + 1) * ((sides >> 14 & 0x3FFF) + 1)


def loaded_all(stored: Iterable[bytes]) -> Iterator[bytes | webp.BadImage]:
    """load() of each, or why it fails."""
    for group in _groups(stored, _said_samples):
        yield from webp.in_step(map(_loading, group))


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored pictures) of each row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                media = list(stored_all(map(payload_of, texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def features(media: DataFrame) -> DataFrame:
    """Reads the stored pictures of doc_id, n_bytes, media back and describes what they hold.

    A null or broken picture has an error and no other feature but the size and digest of its bytes, if there are any.
    """

    def feature(data: bytes) -> str:
        v = np.frombuffer(data, np.uint8)
        counts = np.bincount(v)
        return f"rows={len(v) // WIDTH};distinct={np.count_nonzero(counts)};sum={int(counts @ np.arange(len(counts)))};max={len(counts) - 1};changes={np.count_nonzero(v[1:] != v[:-1])}"

    def one(stored: bytes | None, data: bytes | webp.BadImage) -> tuple:
        if stored is None:
            return (None, None, None, None, None, None, "no bytes")
        own = (len(stored), hashlib.sha256(stored).hexdigest())
        if isinstance(data, webp.BadImage):
            return (None, None, None, *own, None, str(data))
        if not data:
            return (None, None, None, *own, None, "no samples")
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), *own, feature(data), None)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            stored = [x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(2)]
            cols = list(zip(*map(one, stored, loaded_all(x or b"" for x in stored)), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *FEATURES])

    rows = media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col("media").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def decode_pictures(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height, pixels (binary, 4 bytes a pixel: red, green, blue, alpha) and error (null if all is well).

    A null or broken picture has null width, height and pixels. Columns of df with one of those four names are replaced.
    """
    added = ("width", "height", "pixels", "error")
    df = df.select(*[c for c in df.columns if c == media or c.lower() not in added])
    at, names = df.columns.index(media), df.columns

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                out: list[list] = [[], [], [], []]
                for x in part.column(at):
                    try:
                        if not x.is_valid:
                            raise webp.BadImage("no bytes")
                        w, h, px = webp.decode(x.as_buffer().to_pybytes())
                        row = (w, h, np.ascontiguousarray(px.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]).tobytes(), None)
                    except webp.BadImage as e:
                        row = (None, None, None, str(e))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=[*names, *added])

    schema = StructType(list(df.schema.fields))
    for c, kind in zip(added, ("integer", "integer", "binary", "string"), strict=True):
        schema = schema.add(c, kind)
    return df.mapInArrow(run, schema)
