"""Media columns over documents: store texts in baseline JPEG files and read features back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .jpeg import decode, encode

UNIT = 192


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes (null: none) and these bytes, filled up with spaces to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def _in_parts(payloads: list[bytes], most: int) -> Iterator[slice]:
    start = total = 0
    for i, p in enumerate(payloads):
        if total and total + len(p) > most:
            yield slice(start, i)
            start, total = i, 0
        total += len(p)
    if payloads:
        yield slice(start, len(payloads))


def text_media(docs: DataFrame, id_col: str, text_col: str, with_media: bool = False, part_bytes: int = 1 << 20) -> DataFrame:
    """Store every whole text as a grey baseline JPEG, read it back and compute its features.

    Returns the id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (both of what was read back), media_bytes,
    media_sha256, width, height, thumbnail_sha256, feature (dimensions and the thumbnail's average hash) and, on demand,
    media binary. A null text counts as empty; equal texts give equal values; repeated rows give repeated results; an
    empty table gives none; other columns are not read. About `part_bytes` of payload are held at a time, or one text.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail_sha256", "feature"] + ["media"] * with_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.binary()] * with_media

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sized = [payload_of(t) for t in batch.column(1).to_pylist()]
        payloads, rows = [p for _, p in sized], []
        for part in _in_parts(payloads, part_bytes):
            files = encode(payloads[part])
            for (n, _), file, m in zip(sized[part], files, decode(files)):
                back = m.payload
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), m.width, m.height, m.thumbnail_sha256, f"{m.width}x{m.height}:{m.average_hash}"]
                rows.append(row + [file] * with_media)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["id", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_sha256 string, feature string" + ", media binary" * with_media
    return map_batches(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)
