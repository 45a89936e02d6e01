"""Catalogue trees, file listings and side files (survey S4-S9, S12-S18, S20, S21)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.conversion import ENCODERS
from ..functions.text import ascii_lower, format_duration_full, format_size, nonempty, octal_unescape, year_of_date
from ..operators.identify import first_candidate

CATALOGUE_DISC = """Index int, Slug string, Name string, Format string, ContentHash string, Titles array<struct<Index: int, Comment: string, SourceFile: string, SegmentMap: string, Duration: string, Size: bigint,
Item: struct<Title: string, Type: string, Season: int, Episode: int, Chapters: array<struct<Index: int, Title: string>>>>>"""
RELEASE = "Slug string, ImageUrl string, Title string, Year int"
METADATA = "Title string, Slug string, Type string, Year int, ImageUrl string, ExternalIds struct<Tmdb: string, Imdb: string, Tvdb: string>"
LOOKUP = """data struct<mediaItems: struct<nodes: array<struct<id: bigint, title: string, year: int, slug: string, imageUrl: string, releases: array<struct<slug: string, imageUrl: string,
discs: array<struct<index: int, name: string, contentHash: string, titles: array<struct<index: int, sourceFile: string, item: struct<title: string, season: int, episode: int, type: string>>>>>>>>>>>, errors array<struct<message: string>>"""
PROBE = "format struct<filename: string, duration: string, size: string>, streams array<struct<index: int, codec_type: string, codec_name: string, codec_long_name: string, width: int, height: int, channels: int, sample_rate: string, r_frame_rate: string, tags: map<string, string>>>, chapters array<struct<id: bigint, start_time: string, end_time: string>>"
UPC = "code string, items array<struct<title: string, brand: string, upc: string, ean: string>>"


def _json(spark: SparkSession, schema: str, path: str, glob: str) -> DataFrame:
    """The JSON files under path that match glob, with their path; no rows if there is no such folder."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    try:
        return reader.json(path).withColumn("path", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, path string")


def catalogue_identities(discs: DataFrame, releases: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue discs with the records of their release and title, found by folder, with fallbacks.

    discs, releases and items have path and the columns of CATALOGUE_DISC, RELEASE and METADATA.
    """
    up = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    discs = discs.withColumns({"release_dir": up(F.col("path")), "item_dir": up(up(F.col("path")))})
    releases = releases.select(up(F.col("path")).alias("release_dir"), F.col("Slug").alias("r_slug"), F.col("ImageUrl").alias("r_image"))
    items = items.select(up(F.col("path")).alias("item_dir"), F.col("Title").alias("item_title"), F.col("Slug").alias("i_slug"), F.col("Year").alias("i_year"), F.col("ImageUrl").alias("i_image"), "ExternalIds")
    out = discs.join(releases, "release_dir", "left").join(items, "item_dir", "left")
    tmdb = F.trim("ExternalIds.Tmdb")
    return out.select(
        "path", F.col("ContentHash").alias("content_hash"), F.coalesce("r_slug", name(F.col("release_dir"))).alias("release_slug"), F.coalesce("i_slug", name(F.col("item_dir"))).alias("media_item_id"), F.col("Index").alias("disc_index"),
        F.coalesce("item_title", name(F.col("item_dir"))).alias("item_title"), F.when(F.col("i_year") > 0, F.col("i_year")).alias("year"), F.when(tmdb.rlike(r"^\+?[0-9]{1,18}$"), tmdb.try_cast("bigint")).alias("tmdb_id"),
        nonempty(F.col("ExternalIds.Imdb")).alias("imdb_id"), nonempty(F.col("ExternalIds.Tvdb")).alias("tvdb_id"), nonempty(F.coalesce("i_image", "r_image")).alias("image_url"), F.col("Titles").alias("titles"),
    )


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The discs of the movie, series and sets folders under data; none, and no error, if there is no such tree."""
    kinds = root.rstrip("/") + "/data/{movie,series,sets}"
    return catalogue_identities(_json(spark, CATALOGUE_DISC, kinds, "disc*.json"), _json(spark, RELEASE, kinds, "release.json"), _json(spark, METADATA, kinds, "metadata.json"))


def catalogue_disc_count(spark: SparkSession, root: str) -> DataFrame:
    """A listing, without reading contents, of all discs under data, whatever their kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "disc*.json")
    try:
        return files.load(root.rstrip("/") + "/data").agg(F.count("path").alias("discs"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(0,)], "discs long")


def head_signature(spark: SparkSession, root: str) -> str | None:
    """K5: the commit that a tree is at, from its .git folder: a loose reference, a packed one, or the commit itself."""

    def lines(name: str) -> list[str]:
        try:
            return [r["value"].strip() for r in spark.read.option("wholetext", False).text(f"{root.rstrip('/')}/.git/{name}").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    head = next(iter(lines("HEAD")), "")
    if not head.startswith("ref:"):
        return head or None
    name = head.removeprefix("ref:").strip()
    loose = next(iter(lines(name)), "")
    packed = (x.split(" ", 1) for x in lines("packed-refs") if " " in x and x[0] not in "#^")
    return loose or next((sha for sha, ref in packed if ref == name), None)


#: The form of a written hash index; one of another version is not used.
INDEX_VERSION = 1


def hash_index_of(spark: SparkSession, root: str, index: str, signature: str | None) -> DataFrame:
    """hash_key (upper case) and path, relative to root, of all discs of a tree, from a written index if it is valid.

    The table at `index` is valid if its version and the tree's signature are those that were written last, after all its
    rows. Else the tree is read and the table written anew. Without a signature it can't be told whether a table is
    stale, so the tree is read each time and nothing is written. A tree without discs has no rows.
    """
    base = index.rstrip("/")

    def rebuilt() -> DataFrame:
        kinds = root.rstrip("/") + "/data/{movie,series,sets}"
        discs = _json(spark, "ContentHash string", kinds, "disc*.json")
        relative = F.regexp_extract("path", r"/(data/(?:movie|series|sets)/.*)$", 1)
        return discs.where("trim(ContentHash) <> ''").select(F.upper("ContentHash").alias("hash_key"), relative.alias("path"))

    if signature is None:
        return rebuilt()
    try:
        known = spark.read.schema("version int, signature string").parquet(f"{base}/state").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is None or (known["version"], known["signature"]) != (INDEX_VERSION, signature):
        rebuilt().sort("hash_key", "path").write.mode("overwrite").parquet(f"{base}/entries")
        spark.createDataFrame([(INDEX_VERSION, signature)], "version int, signature string").coalesce(1).write.mode("overwrite").parquet(f"{base}/state")
    return spark.read.schema("hash_key string, path string").parquet(f"{base}/entries")


def lookup_discs(raw: DataFrame) -> DataFrame:
    """A row per disc of each response (path and the columns of LOOKUP), and a status: ok, or the errors joined.

    A response whose list of titles is null has one row without a disc, and is ok.
    """
    status = F.when(F.size("errors") > 0, F.array_join("errors.message", "; ")).when(F.col("data").isNull(), "no data").otherwise("ok")
    rows = raw.select("path", status.alias("status"), F.explode_outer("data.mediaItems.nodes").alias("node")).select("path", "status", "node", F.explode_outer("node.releases").alias("release"))
    return rows.select("path", "status", F.col("node.id").alias("media_item_id"), F.col("node.title").alias("item_title"), F.col("release.slug").alias("release_slug"), nonempty(F.coalesce("node.imageUrl", "release.imageUrl")).alias("image_url"), F.explode_outer("release.discs").alias("disc"))


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses."""
    return lookup_discs(_json(spark, LOOKUP, path, "*.json"))


def matching_discs(discs: DataFrame, content_hash: Column) -> DataFrame:
    """Of lookup_discs' rows the discs with this hash, whatever its case."""
    return discs.where(ascii_lower(F.col("disc.contentHash")) == ascii_lower(content_hash))


def disc_files(listing: DataFrame, disc: str, path: str, size: str) -> DataFrame:
    """The files that make a disc's fingerprint, numbered by bytewise name: disc, idx, name, size, error.

    listing has the paths of files, from the disc's root, and may have those of folders (size null). Discs with a folder
    BDMV/STREAM have its .m2ts files, in any case and without folders in it; others all files of VIDEO_TS. A disc with
    neither folder has one row, with the error; one whose folder holds no such file has one with nulls.
    """
    bd, dvd = F.col("_p").rlike("^BDMV/STREAM(/|$)"), F.col("_p").rlike("^VIDEO_TS(/|$)")
    rows = listing.select(disc, F.regexp_replace(path, "^/+|/+$", "").alias("_p"), F.col(size).alias("size"))
    own = Window.partitionBy(disc)
    rows = rows.select("*", F.when(F.bool_or(bd).over(own), "BD").when(F.bool_or(dvd).over(own), "DVD").alias("_kind"))
    wanted = F.col("size").isNotNull() & F.when(F.col("_kind") == "BD", F.col("_p").rlike(r"^BDMV/STREAM/[^/]*\.(?i:m2ts)$")).otherwise(F.col("_p").rlike("^VIDEO_TS/[^/]+$"))
    rows = rows.select(disc, F.when(wanted, F.regexp_extract("_p", "([^/]*)$", 1)).alias("name"), F.when(wanted, F.col("size")).alias("size"), "_kind")
    rank = F.row_number().over(own.orderBy(F.col("name").asc_nulls_last()))
    rows = rows.select("*", (rank - 1).alias("idx"), F.count("name").over(own).alias("_n")).where("name is not null or _n = 0 and idx = 0")
    error = F.when(F.col("_kind").isNull(), "no BDMV/STREAM/ or VIDEO_TS/ directory found")
    return rows.select(disc, F.when(F.col("name").isNotNull(), F.col("idx")).alias("idx"), "name", "size", error.alias("error"))


def parse_playlist(data: bytes) -> list[tuple[str, int, int]] | None:
    """(clip, in, out) of each play item; None if it is no playlist or ends early."""
    be = lambda at, n: int.from_bytes(data[at : at + n], "big")
    if data[:4] != b"MPLS" or len(data) < 12:
        return None
    start = be(8, 4)
    if start + 10 > len(data):
        return None
    at, out = start + 10, []
    for _ in range(be(start + 6, 2)):
        if at + 22 > len(data):
            return None
        out.append((data[at + 2 : at + 7].decode("latin-1").strip(), be(at + 14, 4), be(at + 18, 4)))
        at += 2 + be(at, 2)
    return out


def play_items(playlists: DataFrame) -> DataFrame:
    """Path, ord, clip, in_time and out_time of each item of the playlists (path, content); broken ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, *x) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(parse_playlist(d or b"") or [])]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "ord", "clip", "in_time", "out_time"), r)) for r in rows], pa.schema([("path", pa.string()), ("ord", pa.int32()), ("clip", pa.string()), ("in_time", pa.int64()), ("out_time", pa.int64())]))

    return playlists.select("path", "content").mapInArrow(run, "path string, ord int, clip string, in_time long, out_time long")


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """The items of every playlist under path."""
    return play_items(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mpls").load(path))


def region_mask(content: Column) -> Column:
    """The byte of a video manager file that masks regions; null for other files."""
    return F.when((F.octet_length(content) >= 0x24) & (F.substring(content, 1, 12) == F.lit(b"DVDVIDEO-VMG")), F.conv(F.hex(F.substring(content, 0x24, 1)), 16, 10).cast("int"))


SIDE_FILE = StructType([StructField("disc_title", StringType()), StructField("num_sets", LongType()), StructField("set_number", LongType()), StructField("title_names", MapType(LongType(), StringType())), StructField("error", StringType())])


def parse_side_file(text: str | None) -> tuple:
    """disc_title, num_sets, set_number, title_names and error of a disc's XML record.

    Prefixes of names do not count. The title is the first name inside discinfo; of the numbers there the last counts,
    null if it is none; titleName counts inside tableofcontents, by the number of the title around it, and of equal
    numbers the last counts. A text that is no XML gives an error.
    """
    found: dict = {"names": {}}
    path: list[str] = []
    number: list[int | None] = [None]
    plain = lambda name: name.rpartition(":")[2]
    count = lambda t: int(t) if re.fullmatch(r"\+?[0-9]+", t, re.A) and int(t) < 1 << 32 else None

    def start(name: str, attributes: dict) -> None:
        if plain(name) == "title" and not {"tableofcontents", "titles"}.isdisjoint(path):
            own = next((count(v) for k, v in attributes.items() if plain(k) == "titleNumber"), None)
            number[0] = number[0] if own is None else own
        path.append(plain(name))

    def end(_: str) -> None:
        if path.pop() == "title" and not {"tableofcontents", "titles"}.isdisjoint(path):
            number[0] = None

    def data(piece: str) -> None:
        piece = piece.strip()
        if not piece or not path:
            return
        if "discinfo" in path and path[-1] == "name":
            found.setdefault("title", piece)
        elif "discinfo" in path and path[-1] in ("numSets", "setNumber"):
            found[path[-1]] = count(piece)
        elif path[-1] == "titleName" and "tableofcontents" in path and number[0] is not None:
            found["names"][number[0]] = piece

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse((text or "").encode(), True)
    except expat.ExpatError as e:
        return None, None, None, None, f"no side file: {e}"
    return found.get("title"), found.get("numSets"), found.get("setNumber"), found["names"], None


@F.pandas_udf(SIDE_FILE)
def side_file(texts: pd.Series) -> pd.DataFrame:
    """See parse_side_file; null for null. Side files are few and small, so they are parsed in Python."""
    rows = [(None,) * 5 if t is None else parse_side_file(t) for t in texts]
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c in ("num_sets", "set_number") else object) for i, c in enumerate(SIDE_FILE.names)})


def read_side_files(spark: SparkSession, root: str) -> DataFrame:
    """Disc (the folder above BDMV), path and what parse_side_file finds, of each disc under root.

    Of a disc's files the English one counts, else the one whose name sorts first.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "bdmt_*.[xX][mM][lL]")
    rows = files.text(root).select(F.col("_metadata.file_path").alias("path"), "value").withColumn("disc", F.regexp_extract("path", "^(.*)/BDMV/META/DL/[^/]*$", 1)).where("disc <> ''")
    best = F.row_number().over(Window.partitionBy("disc").orderBy(~F.col("path").endswith("/bdmt_eng.xml"), "path"))
    chosen = rows.withColumn("_rank", best).where("_rank = 1")
    return chosen.select("disc", "path", side_file("value").alias("s")).select("disc", "path", "s.*")


def media_probes(raw: DataFrame) -> DataFrame:
    """media_probe of path and the columns of PROBE."""
    return raw.select("path", F.round(F.expr("try_cast(format.duration as double)")).cast("bigint").alias("duration_seconds"), F.expr("try_cast(format.size as bigint)").alias("size_bytes"), "streams", "chapters")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Landed probes."""
    return media_probes(_json(spark, PROBE, path, "*.json"))


def products(raw: DataFrame) -> DataFrame:
    """The first item of each good answer; raw has path and the columns of UPC."""
    item = F.get("items", F.lit(0))
    return raw.where("code = 'OK' and size(items) > 0").select("path", nonempty(item["title"]).alias("title"), nonempty(item["brand"]).alias("brand"), F.coalesce(nonempty(item["upc"]), nonempty(item["ean"])).alias("upc"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers."""
    return products(_json(spark, UPC, path, "*.json"))


def optical_mounts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Device number, mount point and label of optical drives in a mount table."""
    parts = F.split(F.trim(value), r"\s+")
    rows = lines.select(F.regexp_extract(F.get(parts, F.lit(0)), r"^/dev/sr\+?([0-9]{1,9})$", 1).alias("drive"), F.get(parts, F.lit(1)).alias("mount")).where("drive <> '' and mount is not null")
    rows = rows.select(F.col("drive").cast("int").alias("drive"), octal_unescape("mount").alias("mount"))
    return rows.withColumn("label", F.nullif(F.nullif(F.regexp_extract("mount", "([^/]*)/*$", 1), F.lit("")), F.lit("..")))


#: Answers of movie and series services.
MOVIE = "id bigint, imdb_id string, title string, original_title string, release_date string, overview string, tagline string"
SERIES = "id bigint, external_ids struct<imdb_id: string>, name string, original_name string, first_air_date string, overview string, tagline string"
FIND = "movie_results array<struct<id: bigint>>, tv_results array<struct<id: bigint>>"
_IMAGE = "array<struct<file_path: string, vote_average: double, width: int, height: int>>"
IMAGES = f"posters {_IMAGE}, backdrops {_IMAGE}, logos {_IMAGE}"
LIBRARIES = {
    "movie": "title string, year int, tmdbId bigint, imdbId string, overview string, status string, path string, hasFile boolean, runtime int",
    "series": "id bigint, title string, year int, tvdbId bigint, imdbId string, overview string, status string, path string",
    "episode": "id bigint, seriesId bigint, seasonNumber int, episodeNumber int, title string, airDate string, overview string, hasFile boolean",
}


def _details(raw: DataFrame, imdb: str, title: Column, date: str, kind: str) -> DataFrame:
    filled = lambda c: F.nullif(c, F.lit(""))
    return raw.select("path", F.col("id").alias("tmdb_id"), filled(F.col(imdb)).alias("imdb_id"), filled(title).alias("title"), year_of_date(F.col(date)).alias("year"), filled(F.col("overview")).alias("plot"), filled(F.col("tagline")).alias("tagline"), F.lit(kind).alias("content_type"))


def movie_details(raw: DataFrame) -> DataFrame:
    """Answers on movies (path and the columns of MOVIE); the title is chosen before it is tested for being empty."""
    return _details(raw, "imdb_id", F.coalesce("title", "original_title"), "release_date", "Movie")


def series_details(raw: DataFrame) -> DataFrame:
    """Answers on series (path and the columns of SERIES)."""
    return _details(raw, "external_ids.imdb_id", F.coalesce("name", "original_name"), "first_air_date", "Series")


def read_movie_details(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers on movies."""
    return movie_details(_json(spark, MOVIE, path, "*.json"))


def read_series_details(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers on series."""
    return series_details(_json(spark, SERIES, path, "*.json"))


def finds(raw: DataFrame) -> DataFrame:
    """Kind and tmdb_id of the first movie, else of the first series; null where neither was found; raw has path
    and the columns of FIND."""
    found = first_candidate(F.col("movie_results"), F.col("tv_results"))
    return raw.select("path", found["kind"].alias("kind"), found["hit"]["id"].alias("tmdb_id"))


def read_finds(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers to finds by id."""
    return finds(_json(spark, FIND, path, "*.json"))


def images(raw: DataFrame) -> DataFrame:
    """Images by kind, the best voted first and ties in their order (ord from 0); raw has path and the columns of
    IMAGES."""
    kinds = ("posters", "backdrops", "logos")
    raw = raw.select("path", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("images")) for k in kinds))).alias("x"))
    rows = raw.select("path", "x.kind", F.posexplode("x.images").alias("_pos", "image"))
    best = Window.partitionBy("path", "kind").orderBy(F.col("image.vote_average").desc_nulls_last(), "_pos")
    return rows.select("path", "kind", (F.row_number().over(best) - 1).alias("ord"), "image.*")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers on images."""
    return images(_json(spark, IMAGES, path, "*.json"))


def read_library(spark: SparkSession, path: str, kind: str, season: int | None = None) -> DataFrame:
    """Rows of landed lists of movies, series or episodes (of one season, if given)."""
    rows = _json(spark, LIBRARIES[kind], path, "*.json")
    return rows if season is None else rows.where(F.col("seasonNumber") == season)


def synthetic_scan(probes: DataFrame, path: str, mvc: Column) -> DataFrame:
    """read_probes' rows as scans of one title, with a stream that stands for the second view if mvc."""
    file = F.regexp_extract(path, "([^/]*)$", 1)
    name = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    kind = lambda t: F.when(t == "video", "Video").when(t == "audio", "Audio").when(t == "subtitle", "Subtitles").otherwise(t)

    def stream(s: Column) -> Column:
        size = F.concat(s["width"].cast("string"), F.lit("x"), s["height"].cast("string"))
        tag = lambda k: F.try_element_at(s["tags"], F.lit(k))
        rate = F.when(s["sample_rate"].rlike("^[+]?[0-9]{1,9}$"), s["sample_rate"].cast("int"))
        return F.struct(
            s["index"].alias("stream"), kind(s["codec_type"]).alias("kind"), tag("title").alias("name"), tag("language").alias("language_code"), s["codec_name"].alias("codec_short"), s["codec_long_name"].alias("codec_long"),
            s["channels"].alias("channels"), rate.alias("sample_rate"), size.alias("video_size"), s["r_frame_rate"].alias("frame_rate"),
        )

    no = lambda t: F.lit(None).cast(t)
    streams = F.transform(F.coalesce("streams", F.array()), stream)
    second = F.struct(
        F.size(streams).alias("stream"), F.lit("Video").alias("kind"), no("string").alias("name"), no("string").alias("language_code"), F.lit("Mpeg4-MVC-3D").alias("codec_short"), F.lit("Mpeg4 MVC").alias("codec_long"),
        no("int").alias("channels"), no("int").alias("sample_rate"), no("string").alias("video_size"), no("string").alias("frame_rate"),
    )
    return probes.select(
        F.lit("MKV file").alias("content_type"), name.alias("name"), F.lit(0).alias("title_index"), F.coalesce(F.size("chapters"), F.lit(0)).alias("chapter_count"), "duration_seconds", format_duration_full(F.col("duration_seconds")).alias("duration_text"),
        format_size(F.col("size_bytes")).alias("display_size"), "size_bytes", file.alias("source_file"), F.lit(1).alias("segment_count"), F.lit("1").alias("segment_map"), F.concat(name, F.lit(".mkv")).alias("output_file"),
        F.when(mvc, F.concat(streams, F.array(second))).otherwise(streams).alias("streams"),
    )


def loop_device(said: Column) -> Column:
    """The loop device that a mount tool names; null if none."""
    return F.nullif(F.regexp_extract(said, r"(/dev/loop[0-9]+)", 1), F.lit(""))


def mount_point(said: Column) -> Column:
    """The mount point in the first line that has one: quoted, or the rest of the line with its spaces."""

    def of_line(line: Column) -> Column:
        quoted = F.regexp_extract(line, "mounted at `(/[^']*)'", 1)
        rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, r"^.*? at (/.*)$", 1), r"(?U)\s+$", ""), r"\.+$", "")
        return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(rest, F.lit("")))

    return F.get(F.filter(F.transform(F.split(said, "\r?\n"), of_line), lambda p: p.isNotNull()), F.lit(0))


def encoders_in(said: Column) -> Column:
    """Which known encoders a listing names."""
    return F.filter(F.array(*(F.lit(e) for e in ENCODERS.values())), lambda e: F.contains(said, e))
