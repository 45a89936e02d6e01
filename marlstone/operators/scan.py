"""Typed scans from records (survey S2, P1-P8, A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, parse_duration

#: Attribute codes of the log by column.
DISC_CODES = {1: "content_type", 2: "name", 28: "language_code", 29: "language_name", 32: "volume_label"}
TITLE_CODES = {2: "name", 8: "chapter_count", 9: "duration_text", 10: "display_size", 11: "size_bytes", 16: "source_file", 25: "segment_count", 26: "segment_map", 27: "output_file", 28: "language_code"}
STREAM_CODES = {
    1: "kind", 2: "name", 3: "language_code", 4: "language_name", 5: "codec_id", 6: "codec_short", 7: "codec_long", 13: "bitrate", 14: "channels", 17: "sample_rate", 18: "sample_size", 19: "video_size", 20: "aspect_ratio", 21: "frame_rate",
}


def last_write_pivot(df: DataFrame, keys: list[str], code: str, value: str, seq: Column, columns: dict) -> DataFrame:
    """A1: a row per key with a column per code; of several values of a code the last by seq counts, null or not.

    One aggregation with map-side combine; no order of rows is relied on.
    """
    picks = [F.max_by(F.when(F.col(code) == k, F.struct(F.col(value).alias("v"))), F.when(F.col(code) == k, seq))["v"].alias(name) for k, name in columns.items()]
    return df.groupBy(*keys).agg(*picks)


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^\+?[0-9]{1,18}$"), c.cast("bigint"))


def typed_records(records: DataFrame) -> DataFrame:
    """Records (scan_id, seq, kind, fields) with code, title, stream, value; malformed ones are left out."""
    f = F.col("fields")
    need = F.when(F.col("kind") == "SINFO", 4).when(F.col("kind") == "TINFO", 3).when(F.col("kind") == "CINFO", 2).otherwise(1)
    at = lambda i: F.get(f, F.lit(i))
    ints = {"SINFO": (0, 1, 2, 3), "TINFO": (0, 1, 2), "CINFO": (0, 1), "MSG": (0, 1, 2), "TCOUNT": (0,), "PRGT": (0, 1), "PRGC": (0, 1), "PRGV": (0, 1, 2), "DRV": (0, 1, 2, 3)}
    good = F.lit(True)
    for kind, places in ints.items():
        ok = F.lit(True)
        for i in places:
            ok = ok & F.coalesce(_number(at(i)).isNotNull() & (_number(at(i)) <= 4294967295), F.lit(False))
        good = F.when(F.col("kind") == kind, ok).otherwise(good)
    k = F.col("kind")
    title = F.when(k.isin("TINFO", "SINFO"), _number(at(0)))
    stream = F.when(k == "SINFO", _number(at(1)))
    code = F.when(k == "SINFO", _number(at(2))).when(k == "TINFO", _number(at(1))).when(k.isin("CINFO", "MSG"), _number(at(0)))
    value = F.when(k == "SINFO", at(4)).when(k == "TINFO", at(3)).when(k == "CINFO", at(2)).when(k == "MSG", at(3))
    return records.where(good & (F.size(f) >= need)).withColumns({"title_index": title, "stream": stream, "code": code, "value": F.coalesce(value, F.lit(""))})


def scan_titles(typed: DataFrame) -> DataFrame:
    """scan_title: a row per title in order of first appearance; a stream's record makes its title."""
    rows = typed.where("title_index is not null")
    seen = rows.groupBy("scan_id", "title_index").agg(F.min("seq").alias("ord"))
    flat = last_write_pivot(rows.where("kind = 'TINFO'"), ["scan_id", "title_index"], "code", "value", F.col("seq"), TITLE_CODES)
    out = seen.join(flat, ["scan_id", "title_index"], "left").withColumn("duration_seconds", parse_duration(F.col("duration_text")))
    return out.withColumns({c: _number(F.col(c)) for c in ("chapter_count", "size_bytes", "segment_count")})


def scan_streams(typed: DataFrame) -> DataFrame:
    """scan_stream."""
    return last_write_pivot(typed.where("kind = 'SINFO'"), ["scan_id", "title_index", "stream"], "code", "value", F.col("seq"), STREAM_CODES)


def scan_discs(typed: DataFrame) -> DataFrame:
    """scan_disc with the tool's version (P2: message 1005, the last wins)."""
    flat = last_write_pivot(typed.where("kind = 'CINFO'"), ["scan_id"], "code", "value", F.col("seq"), DISC_CODES)
    found = F.regexp_extract("value", r"v(\d+\.\d+(?:\.\d+)?)", 1)
    version = typed.where("kind = 'MSG' and code = 1005").withColumn("found", found).where("found <> ''").groupBy("scan_id").agg(F.max_by("found", "seq").alias("tool_version"))
    return typed.select("scan_id").distinct().join(flat, "scan_id", "left").join(version, "scan_id", "left")


def version_at_least(version: Column, major: int, minor: int, patch: int = 0) -> Column:
    """Lexicographic comparison of version triples; a missing patch is 0."""
    parts = F.split(version, r"\.")
    own = F.struct(*(F.coalesce(F.get(parts, F.lit(i)).cast("int"), F.lit(0)).alias(f"p{i}") for i in range(3)))
    return own >= F.struct(F.lit(major).alias("p0"), F.lit(minor).alias("p1"), F.lit(patch).alias("p2"))


def has_mvc(streams: Column) -> Column:
    """Any stream with a multi-view codec, whatever the case."""
    return F.exists(streams, lambda s: F.contains(ascii_lower(F.concat_ws(" ", s["codec_short"], s["codec_long"])), F.lit("mvc")))


def disc_type(content_type: Column, mvc: Column, hevc: Column) -> Column:
    """P6."""
    return F.when(F.contains(ascii_lower(content_type), F.lit("dvd")), "Dvd").when(mvc, "BluRay3D").when(hevc, "UltraHdBluRay").otherwise("BluRay")


def disc_type_with_markers(aacs2: Column, ssif: Column, video_ts: Column, bdmv: Column, otherwise: Column) -> Column:
    """What the directories show comes first."""
    return F.when(aacs2, "UltraHdBluRay").when(ssif, "BluRay3D").when(video_ts & ~bdmv, "Dvd").otherwise(otherwise)


def stream_kind(label: Column) -> Column:
    """Video is the default."""
    return F.when(label == "Audio", "Audio").when(label.isin("Subtitle", "Subtitles"), "Subtitle").otherwise("Video")


#: What stream_fingerprint makes, as a list.
STREAMS = "array<struct<index: bigint, kind: string, codec: string, language_code: string, channels: int, title: string>>"


def title_fingerprint(index: Column, seconds: Column, size: Column, source_file: Column, segment_map: Column, chapters: Column, streams: Column) -> Column:
    """A title with 0 and empty texts for what the scan leaves out; streams are those of stream_fingerprint."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        index.alias("index"), number(seconds).alias("duration_seconds"), number(size).alias("size_bytes"), text(source_file).alias("source_file"), text(segment_map).alias("segment_map"), number(chapters).alias("chapter_count"),
        F.coalesce(streams, F.array().cast(STREAMS)).alias("streams"),
    )


def stream_fingerprint(index: Column, kind: Column, codec: Column, language_code: Column, channels: Column, title: Column) -> Column:
    """A stream with its kind, Video for unknown ones, an empty codec for none and at most 255 channels."""
    return F.struct(
        index.cast("bigint").alias("index"), stream_kind(kind).alias("kind"), F.coalesce(codec, F.lit("")).alias("codec"), language_code.alias("language_code"),
        F.when(channels.isNotNull(), F.least(channels, F.lit(255))).cast("int").alias("channels"), title.alias("title"),
    )


def has_mvc_exact(streams: Column) -> Column:
    """P5: like has_mvc in this case only; what disc typing asks."""
    return F.exists(streams, lambda s: F.contains(F.concat_ws(" ", s["codec_short"], s["codec_long"]), F.lit("MVC")))


def input_kind(path: Column) -> Column:
    """Iso, mkv or unknown, by the extension in any case."""
    ext = ascii_lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(ext.isin("iso", "mkv"), ext).otherwise("unknown")


def widest_stream(streams: Column) -> Column:
    """The widest video stream, of equals the last; streams are structs with kind and width."""
    video = F.filter(streams, lambda s: s["kind"] == "Video")
    best = F.array_max(F.transform(video, lambda s, i: F.struct(F.coalesce(s["width"], F.lit(0)).alias("w"), i.alias("i"))))
    return F.when(F.size(video) > 0, F.get(video, best["i"]))
