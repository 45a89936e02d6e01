"""Numbers and bytes of discs as Column builders (survey F23-F26, P14, V2, V3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_u64_hex(size: Column) -> Column:
    """a size as eight little-endian bytes in hex."""
    big = F.lpad(F.hex(size.cast("bigint")), 16, "0")
    return F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))


def ticks(start: Column, end: Column) -> Column:
    """length of a play item in 45 kHz ticks, never negative."""
    return F.greatest(end - start, F.lit(0).cast("bigint"))


def tick_seconds(t: Column) -> Column:
    """F23."""
    return F.floor(t / 45000).cast("bigint")


def fraction(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def dvd_region(mask: Column) -> Column:
    """P14: '0' for every region, null for none, else the lowest region whose bit is clear."""
    out = F.when(mask == 0, "0")
    for n in range(8):
        out = out.when(mask.bitwiseAND(1 << n) == 0, str(n + 1))
    return out


#: Fixed values of the conversion tables: format, slug, width factor, height factor.
FORMATS = [("full_sbs", "fsbs", 2, 1), ("half_sbs", "hsbs", 1, 1), ("full_tab", "ftab", 1, 2), ("half_tab", "htab", 1, 1), ("frame_sequential", "fs", 1, 1)]


def output_size(fmt: Column, width: Column, height: Column) -> Column:
    """V2: struct<width, height> of a converted picture."""
    w, h = width, height
    for name, _, fw, fh in FORMATS:
        w = F.when(fmt == name, width * fw).otherwise(w) if fw > 1 else w
        h = F.when(fmt == name, height * fh).otherwise(h) if fh > 1 else h
    return F.struct(w.alias("width"), h.alias("height"))


def clamp_quality(q: Column) -> Column:
    """V3."""
    return F.greatest(F.lit(12), F.least(F.lit(32), q))
