"""Registered queries of scalar rules, sources and streams over the driver's tables, each with its SQL twin.

Inputs of the forms that the rules read (labels, log lines, answers in JSON or XML, paths) are built from the tables'
columns, with the cases at the edge of each rule; the SQL tells what must come out of them without going through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversion, media, naming, text
from ..operators import discs, identify, scan, sinks
from ..sources import files, robot_log
from ..streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(values: list, index: Column) -> Column:
    """The value at index modulo their number; values are columns, texts or null."""
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.element_at(F.array(*columns), (index % len(columns) + 1).cast("int"))


def _text(c: Column) -> Column:
    return c.cast("string")


# Scalar rules ---------------------------------------------------------------------------------------------------------


@_query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7654321 + p_size ELSE p_partkey * 1777 END AS b FROM part)
SELECT p_partkey, CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1e9) ELSE printf('%.0f MB', b / 1e6) END AS shown,
CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1e9) WHEN b >= 1000000 THEN printf('%.0f MB', b / 1e6) ELSE b || ' B' END AS exact FROM b""")
def size_labels(spark, sf_dir):
    size = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") * 7654321 + F.col("p_size")).otherwise(F.col("p_partkey") * 1777)
    rows = _t(spark, sf_dir, "part").select("p_partkey", size.cast("bigint").alias("size"))
    return rows.select("p_partkey", text.format_size("size").alias("shown"), text.format_size_bytes("size").alias("exact"))


@_query("""SELECT page_id, translate(url, '/' || chr(92), '__') AS folder, regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') AS branch, '&lt;' || replace(url, '&', '&amp;') || '&gt;&amp;' AS escaped,
CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://img.example/a/' || page_id || '.jpg' WHEN 3 THEN 'https://img.example/x' END AS cover FROM pages""")
def safe_names(spark, sf_dir):
    url = F.col("url")
    shown = _nth([url, F.concat(F.lit("/a/"), _text(F.col("page_id")), F.lit(".jpg")), "   ", "  //x "], F.col("page_id"))
    return _t(spark, sf_dir, "pages").select(
        "page_id", text.sanitise_dir(url).alias("folder"), text.branch_slug(url).alias("branch"), text.xml_escape(F.concat(F.lit("<"), url, F.lit(">&"))).alias("escaped"), text.cover_url(shown, "https://img.example/").alias("cover")
    )


@_query("""SELECT p_partkey, p_name || ['%', '%', '%zz', chr(5), '%%41', 'Ã©'][p_partkey % 6 + 1] AS name, p_name || [chr(92) || '1', chr(92) || '08x', 'A', chr(511), chr(92) || chr(92) || '040'][p_partkey % 5 + 1] AS mount FROM part""")
def decoded_names(spark, sf_dir):
    key, name = F.col("p_partkey"), F.col("p_name")
    percent = F.concat(F.replace(name, F.lit(" "), F.lit("%20")), _nth(["%", "%4", "%zz", "%+5", "%%41", "%C3%A9"], key))
    octal = F.concat(F.replace(name, F.lit(" "), F.lit(r"\040")), _nth([r"\1", r"\08x", r"\101", r"\777", r"\\040"], key))
    rows = _t(spark, sf_dir, "part").select("p_partkey", percent.alias("p"), octal.alias("o"))
    return rows.select("p_partkey", text.percent_decode("p").alias("name"), text.octal_unescape("o").alias("mount"))


@_query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS added FROM events")
def epoch_dates(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.epoch_iso(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)).alias("added"))


@_query("""WITH r AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'Trailer' WHEN p_partkey % 3 = 0 THEN 'Featurette' WHEN p_partkey % 2 = 0 THEN 'Main' ELSE 'Other' END AS role,
CASE WHEN p_partkey % 3 = 1 THEN ' x ' WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 7 > 0 THEN p_name END AS display FROM part)
SELECT p_partkey, role, CASE role WHEN 'Main' THEN 'MainMovie' ELSE role END AS written, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'title_t' || lpad(p_size::VARCHAR, 2, '0') || '.mkv' END AS output,
CASE WHEN 1890 + p_size * 5 BETWEEN 1900 AND 2100 THEN 1890 + p_size * 5 END AS year, display, 'Title ' || p_size || coalesce(' — ' || display, '') AS label FROM r""")
def rip_fields(spark, sf_dir):
    key, c = F.col("p_partkey"), F.col
    role = identify.rip_role(F.when(key % 5 == 0, "Trailer"), F.when(key % 3 == 0, "Featurette"), key % 2 == 0)
    display = identify.rip_display(_nth(["  ", " x ", None], key), _nth([c("p_brand"), F.lit("")], key), F.when(key % 7 > 0, c("p_name")).otherwise(""))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", role.alias("role"), identify.role_name(role).alias("written"), identify.output_file(F.when(key % 4 == 0, c("p_name")), c("p_size")).alias("output"),
        text.valid_year(1890 + c("p_size") * 5, 1900, 2100).alias("year"), display.alias("display"), identify.rip_label(c("p_size"), display).alias("label"),
    )


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE 'Title ' || p_size END AS title, CASE p_partkey % 4 WHEN 0 THEN 'Scene' WHEN 1 THEN 'Short' ELSE 'Other' END AS role,
'Title ' || p_size || CASE p_partkey % 4 WHEN 0 THEN ' — ' || p_brand WHEN 1 THEN ' — ' || p_type WHEN 2 THEN ' — ' || p_name ELSE '' END AS row_title, CASE WHEN p_partkey % 5 = 1 THEN p_type WHEN p_partkey % 5 = 2 THEN 'r' END AS image FROM part""")
def submission_fields(spark, sf_dir):
    key, c, none = F.col("p_partkey"), F.col, F.lit(None).cast("string")
    title = identify.submission_title(F.when(key % 3 == 0, ""), F.when(key % 3 == 1, c("p_brand")).otherwise(""), none, c("p_size"))
    role = identify.submission_role(F.when(key % 4 == 0, "Scene"), F.when(key % 4 < 2, "Short"))
    row = identify.row_title(c("p_size"), F.when(key % 4 == 0, c("p_brand")), F.when(key % 4 < 2, c("p_type")), F.when(key % 4 < 3, c("p_name")).otherwise(""))
    image = identify.image_url(_nth([" ", c("p_type"), None, None, ""], key), _nth(["r", "r", "r", " ", "r"], key))
    return _t(spark, sf_dir, "part").select("p_partkey", title.alias("title"), role.alias("role"), row.alias("row_title"), image.alias("image"))


@_query("""WITH s AS (SELECT p_partkey, (p_size % 7)::VARCHAR AS a, (p_size % 5)::VARCHAR AS b, p_size || '/9' AS c FROM part) SELECT p_partkey, CASE WHEN a = b THEN a || ' ' || c ELSE a || ' ' || b || ' ' || c END AS tokens FROM s""")
def segment_maps(spark, sf_dir):
    a, b, c = _text(F.col("p_size") % 7), _text(F.col("p_size") % 5), _text(F.col("p_size"))
    said = F.concat(a, F.lit("+"), b, F.lit(", "), a, F.lit("+ +,"), c, F.lit("/9+"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.parse_segment_map(said), " ").alias("tokens"))


@_query("""SELECT p_partkey, 'data/' || CASE WHEN p_partkey % 2 = 0 THEN 'series' ELSE 'movie' END || '/a_b_' || p_name || CASE WHEN p_partkey % 3 > 0 THEN ' (' || (1950 + p_size) || ')' ELSE '' END || '/r_' || p_size || '/disc' || lpad(greatest(p_size % 12, 1)::VARCHAR, 2, '0') || '.json' AS path FROM part""")
def staging_paths(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    path = naming.staging_path(F.when(key % 2 == 0, "Series").otherwise("Movie"), F.concat(F.lit("a/b\\"), "p_name"), F.when(key % 3 > 0, 1950 + size), F.concat(F.lit("r/"), _text(size)), size % 12)
    return _t(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@_query("""SELECT p_partkey, ['iso', 'mkv', 'mkv', 'unknown', 'unknown', 'unknown'][p_partkey % 6 + 1] AS kind, p_size * 1000000 + p_partkey % 30 * 1000 + CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 ELSE 0 END >= 25017003 AS recent,
CASE p_partkey % 4 WHEN 0 THEN 'MvcWithBlockAdditions' WHEN 1 THEN 'MvcInlineLaced' WHEN 2 THEN 'MvcInlineLaced' END AS stereo, CASE WHEN p_partkey % 2 = 0 THEN 'libx264 hevc_vaapi' ELSE '' END AS encoders FROM part""")
def file_kinds(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.col("p_brand"), F.lit("/"), _nth(["x.ISO", "y.mkv", "z.tar.Mkv", "none", "d.iso/file", ".mkv"], key))
    version = F.concat_ws(".", _text(size), _text(key % 30), F.when(key % 2 == 0, _text(key % 9)))
    stereo = conversion.stereo_source(F.when(key % 4 == 0, F.lit("box")), _nth([F.lit(0), F.lit(13), F.lit(14), F.lit(1)], key))
    listed = F.when(key % 2 == 0, " V..... libx264 H.264\n V....D hevc_vaapi H.265").otherwise("libvpx")
    return _t(spark, sf_dir, "part").select("p_partkey", scan.input_kind(path).alias("kind"), scan.version_at_least(version, 25, 17, 3).alias("recent"), stereo.alias("stereo"), F.array_join(files.encoders_in(listed), " ").alias("encoders"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS mask, p_size // 45 AS seconds FROM part""")
def region_masks(spark, sf_dir):
    key = F.col("p_partkey")
    head = _nth(["DVDVIDEO-VMG", "DVDVIDEO-VMG", "DVDVIDEO-VTS"], key)
    content = F.concat(F.rpad(head, 35, "x").cast("binary"), F.unhex(F.lpad(F.hex("p_size"), 2, "0")), F.when(key % 3 == 1, F.lit(b"more")).otherwise(F.lit(b"")))
    return _t(spark, sf_dir, "part").select("p_partkey", files.region_mask(content).alias("mask"), media.tick_seconds(F.col("p_size") * 1000).alias("seconds"))


_LINES = "SELECT *, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS title FROM lineitem"


@_query(f"""SELECT l_orderkey, coalesce(string_agg(l_linenumber || ':' || title, ' ' ORDER BY l_linenumber, title) FILTER (WHERE title <> ''), '') AS kept, string_agg(n || ':' || title, ' ' ORDER BY n) AS numbered,
CASE WHEN l_orderkey % 2 = 0 THEN string_agg(l_linenumber || ':' || title, ' ' ORDER BY l_linenumber, title DESC) ELSE '1:own' END AS submitted
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, title) AS n FROM ({_LINES})) GROUP BY l_orderkey""")
def chapter_lists(spark, sf_dir):
    title = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    all_of = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("Index"), title.alias("Title"))))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(all_of.alias("c"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["Index"].cast("string"), F.lit(":"), x["Title"])), " ")
    own = F.array(F.struct(F.lit(1).alias("Index"), F.lit("own").alias("Title")))
    override = F.when(F.col("l_orderkey") % 2 == 0, F.filter("c", lambda x: F.lit(False))).otherwise(own)
    return rows.select("l_orderkey", shown(sinks.kept_chapters(F.col("c"))).alias("kept"), shown(sinks.numbered_chapters(F.col("c.Title"))).alias("numbered"), shown(identify.submission_chapters(override, F.reverse("c"))).alias("submitted"))


@_query("""WITH s AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'Mpeg4-MVC-3D' WHEN 'A' THEN 'mvc' ELSE 'AVC' END AS codec FROM lineitem)
SELECT l_orderkey, bool_or(l_returnflag IN ('R', 'A')) AS mvc, bool_or(l_returnflag = 'R') AS exact, arg_max(l_linenumber, (l_quantity::INT, l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_linestatus = 'F') AS widest FROM s GROUP BY l_orderkey""")
def stream_marks(spark, sf_dir):
    codec = F.when(F.col("l_returnflag") == "R", "Mpeg4-MVC-3D").when(F.col("l_returnflag") == "A", "mvc").otherwise("AVC")
    stream = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "F", "Video").otherwise("Audio").alias("kind"), codec.alias("codec_short"), F.lit(None).cast("string").alias("codec_long"), F.col("l_quantity").cast("int").alias("width"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(stream)).alias("s"))
    s = F.col("s")
    return rows.select("l_orderkey", scan.has_mvc(s).alias("mvc"), scan.has_mvc_exact(s).alias("exact"), scan.widest_stream(s)["l_linenumber"].alias("widest"))


@_query("""SELECT p_partkey, '<ChapterAtom><ChapterUID>1</ChapterUID><ChapterDisplay><ChapterString>' || p_name || ' &lt;&amp;</ChapterString><ChapterLanguage>eng</ChapterLanguage></ChapterDisplay></ChapterAtom><ChapterAtom><ChapterDisplay><ChapterString>' || p_brand
|| '</ChapterString></ChapterDisplay></ChapterAtom>' AS xml FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0""")
def chapter_titles(spark, sf_dir):
    xml = F.lit("<ChapterAtom><ChapterUID>1</ChapterUID></ChapterAtom><ChapterAtom><ChapterDisplay><ChapterString>old</ChapterString></ChapterDisplay></ChapterAtom>")
    titles = F.array(F.concat("p_name", F.lit(" <&")), F.col("p_brand"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", xml.alias("x"), F.when(F.col("p_partkey") % 3 == 0, F.slice(titles, 1, 1)).otherwise(titles).alias("t"))
    return rows.select("p_partkey", sinks.splice_chapters("x", "t").alias("xml"))


# Scans, joins and documents -------------------------------------------------------------------------------------------


@_query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INT) AS sel_ord FROM orders WHERE o_custkey % 5 > 0""")
def selections(spark, sf_dir):
    titles = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    asked = titles.where("o_custkey % 5 > 0").groupBy("o_custkey").agg(F.concat(F.array(F.lit(-1).cast("bigint")), F.sort_array(F.collect_list(F.col("o_orderkey").cast("bigint")), False)).alias("selected"))
    return identify.selected(titles, asked, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "sel_ord")


_RECORD_TEXT = "'He said \"' || o_orderpriority || chr(10) || '\", ok'"


@_query(f"""SELECT o_orderkey::VARCHAR AS scan_id, 0::BIGINT AS seq, 'TINFO' AS kind, o_orderkey || '|2|0|' || {_RECORD_TEXT} AS fields FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 1, 'CINFO', '1|' || chr(10) || '0|' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 2, 'PRGV', '1|2|' FROM orders WHERE o_orderkey % 2 = 0""")
def robot_records(spark, sf_dir):
    key = _text(F.col("o_orderkey"))
    last = F.when(F.col("o_orderkey") % 2 == 0, "PRGV:1,2,\\").otherwise('MSG:1,0,0,"open')
    lines = [F.concat(F.lit("TINFO:"), key, F.lit(',2,0,"He said ""'), "o_orderpriority"), F.lit('"", ok"\r'), F.lit("junk"), F.lit(""), F.lit("CINFO:1,\\"), F.concat(F.lit('0,"'), "o_orderstatus", F.lit('"')), last]
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*lines)).alias("at", "line"))
    found = robot_log.fold_lines(rows, "o_orderkey", "at", "line")
    return found.select("scan_id", "seq", "kind", F.array_join("fields", "|").alias("fields"))


def _log_records(spark: SparkSession, sf_dir: str, kind: str, fields: list[tuple[int, Column]], head: list[Column]) -> DataFrame:
    """Records of a kind, one for each code and order, the customer being the scan; a null text makes no record."""
    one = [F.struct(F.lit(code).alias("code"), v.cast("string").alias("v")) for code, v in fields]
    rows = _t(spark, sf_dir, "orders").select("*", F.explode(F.array(*one)).alias("r")).where("r.v is not null")
    parts = F.array(*(h.cast("string") for h in head), _text(F.col("r.code")), F.lit("0"), F.col("r.v"))
    return rows.select(_text(F.col("o_custkey")).alias("scan_id"), (F.col("o_orderkey") * 100 + F.col("r.code")).alias("seq"), F.lit(kind).alias("kind"), parts.alias("fields"))


@_query("""SELECT o_custkey::VARCHAR AS scan_id, o_orderkey AS title_index, CASE WHEN o_orderkey % 4 > 0 THEN 3723 ELSE 0 END AS duration_seconds, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 1000 ELSE 0 END AS size_bytes, CASE WHEN o_orderkey % 5 > 0 THEN '00800.mpls' ELSE '' END AS source_file,
o_orderkey % 9 AS chapter_count FROM orders WHERE o_orderkey % 13 > 0""")
def title_fingerprints(spark, sf_dir):
    key = F.col("o_orderkey")
    fields = [(8, key % 9), (9, F.when(key % 4 > 0, "1:02:03").otherwise("x")), (11, F.when(key % 3 == 0, _text(key * 1000)).otherwise(F.when(key % 3 == 1, "-5"))), (16, F.when(key % 5 > 0, "00800.mpls"))]
    records = _log_records(spark, sf_dir, "TINFO", fields, [F.when(key % 13 > 0, _text(key)).otherwise("x")])
    c = F.col
    print_ = scan.title_fingerprint(c("title_index"), c("duration_seconds"), c("size_bytes"), c("source_file"), c("segment_map"), c("chapter_count"), F.lit(None))
    found = scan.scan_titles(scan.typed_records(records)).select("scan_id", print_.alias("p"))
    return found.select("scan_id", F.col("p.index").alias("title_index"), "p.duration_seconds", "p.size_bytes", "p.source_file", "p.chapter_count")


@_query("""SELECT o_custkey::VARCHAR AS scan_id, o_orderkey AS title_index, o_orderkey % 3 AS stream, CASE o_orderkey % 4 WHEN 0 THEN 'Audio' WHEN 1 THEN 'Subtitle' ELSE 'Video' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'A_AC3' ELSE '' END AS codec,
CAST(CASE WHEN o_orderkey % 5 > 0 THEN least(o_orderkey % 400, 255) END AS INT) AS channels FROM orders""")
def stream_fingerprints(spark, sf_dir):
    key = F.col("o_orderkey")
    fields = [(1, _nth(["Audio", "Subtitles", "Data", None], key)), (5, F.when(key % 2 == 0, "A_AC3")), (14, F.when(key % 5 > 0, _text(key % 400))), (2, F.lit("n"))]
    records = _log_records(spark, sf_dir, "SINFO", fields, [key, key % 3])
    c = F.col
    found = scan.scan_streams(scan.typed_records(records))
    made = scan.stream_fingerprint(c("stream"), c("kind"), c("codec_id"), c("language_code"), c("channels").cast("int"), c("name"))
    return found.select("scan_id", "title_index", made.alias("p")).select("scan_id", "title_index", F.col("p.index").alias("stream"), "p.kind", "p.codec", "p.channels")


@_query("""WITH f AS (SELECT l_orderkey, l_orderkey % 3 AS k, lpad(l_linenumber::VARCHAR, 5, '0') || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity AS name, lpad(to_hex(l_partkey), 16, '0') AS x FROM lineitem),
b AS (SELECT *, substr(x,15,2)||substr(x,13,2)||substr(x,11,2)||substr(x,9,2)||substr(x,7,2)||substr(x,5,2)||substr(x,3,2)||substr(x,1,2) AS le FROM f)
SELECT l_orderkey, CASE WHEN k < 2 THEN upper(md5(unhex(string_agg(le, '' ORDER BY name)))) END AS content_hash, CASE WHEN k = 2 THEN 'no BDMV/STREAM/ or VIDEO_TS/ directory found' END AS error FROM b GROUP BY l_orderkey, k""")
def listed_hashes(spark, sf_dir):
    c, k = F.col, F.col("l_orderkey") % 3
    name = F.concat_ws("-", F.lpad(_text(c("l_linenumber")), 5, "0"), _text(c("l_partkey")), _text(c("l_suppkey")), _text(c("l_quantity")))
    noise = [F.struct(_nth(["BDMV/STREAM/SSIF/00001.m2ts", "VIDEO_TS", "readme.txt"], k).alias("p"), F.when(k != 1, 1).cast("bigint").alias("s")), F.struct(_nth(["VIDEO_TS/x.vob", "BDMV", "VIDEO_TSX/y"], k).alias("p"), F.when(k != 1, 1).cast("bigint").alias("s"))]
    own = F.struct(F.concat(_nth(["/BDMV/STREAM/", "VIDEO_TS/", "other/"], k), name, _nth([".M2TS", ".VOB", ".m2ts"], k)).alias("p"), c("l_partkey").cast("bigint").alias("s"))
    listing = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(own, *noise)).alias("f")).select("l_orderkey", "f.p", "f.s")
    listed = files.disc_files(listing, "l_orderkey", "p", "s")
    hashed = discs.content_hash(listed.where("name is not null"), ["l_orderkey"], F.col("idx"), "size")
    failed = listed.where("error is not null").select("l_orderkey", F.lit(None).cast("string").alias("content_hash"), "error")
    return hashed.select("l_orderkey", "content_hash", F.lit(None).cast("string").alias("error")).unionByName(failed)


@_query("""SELECT p_partkey % 100 AS drive, '/run/media/My Disc ' || p_partkey AS mount, 'My Disc ' || p_partkey AS label FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey % 100, '/', NULL FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey % 100, '/mnt/x' || p_partkey || '/', 'x' || p_partkey FROM part WHERE p_partkey % 4 = 2""")
def drive_mounts(spark, sf_dir):
    key, drive = _text(F.col("p_partkey")), _text(F.col("p_partkey") % 100)
    dev = F.concat(F.lit("/dev/sr"), drive)
    lines = [F.concat(dev, F.lit(r" /run/media/My\040Disc\040"), key, F.lit(" udf ro 0 0")), F.concat(dev, F.lit(" / iso9660 ro")), F.concat(F.lit("  "), dev, F.lit("\t /mnt/x"), key, F.lit("/")), F.concat(F.lit("/dev/sda"), drive, F.lit(" /home ext4 rw"))]
    return files.optical_mounts(_t(spark, sf_dir, "part").select(_nth(lines, F.col("p_partkey")).alias("value"))).select(F.col("drive").cast("bigint").alias("drive"), "mount", "label")


def _answers(rows: DataFrame, key: str, said: Column, schema: str) -> DataFrame:
    return rows.select(_text(F.col(key)).alias("path"), F.from_json(said, schema).alias("a")).select("path", "a.*")


@_query("""WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS path FROM customer) SELECT path, 'one; two' AS status, CAST(NULL AS BIGINT) AS media_item_id, CAST(NULL AS VARCHAR) AS release_slug, CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS hash FROM c WHERE c_custkey % 5 = 0
UNION ALL SELECT path, CASE c_custkey % 5 WHEN 1 THEN 'ok' ELSE 'no data' END, NULL, NULL, NULL, NULL FROM c WHERE c_custkey % 5 IN (1, 2)
UNION ALL SELECT path, 'ok', c_custkey, s, CASE WHEN c_custkey % 5 = 3 THEN NULL WHEN s = 'r' THEN 'u' END, h FROM c, (VALUES ('r', 'aa'), ('r', 'BB'), ('s', NULL)) v(s, h) WHERE c_custkey % 5 > 2""")
def lookup_answers(spark, sf_dir):
    key = F.col("c_custkey")
    image = F.when(key % 5 == 3, '"imageUrl":" ",').otherwise("")
    whole = F.concat(F.lit('{"data":{"mediaItems":{"nodes":[{"id":'), _text(key), F.lit(","), image, F.lit('"title":"t","releases":[{"slug":"r","imageUrl":"u","discs":[{"index":1,"contentHash":"aa"},{"index":2,"contentHash":"BB"}]},{"slug":"s","discs":[]}]}]}}}'))
    said = _nth(['{"data":null,"errors":[{"message":"one"},{"message":"two"}]}', '{"data":{"mediaItems":null}}', "{}", whole, whole], key)
    found = files.lookup_discs(_answers(_t(spark, sf_dir, "customer"), "c_custkey", said, files.LOOKUP))
    return found.select("path", "status", "media_item_id", "release_slug", "image_url", F.col("disc.contentHash").alias("hash"))


@_query("SELECT c_custkey::VARCHAR AS path, h AS hash FROM customer, (VALUES ('aB1'), ('Ab1')) v(h) WHERE c_custkey % 2 = 0")
def matching_discs(spark, sf_dir):
    key = F.col("c_custkey")
    discs_ = F.when(key % 2 == 0, '[{"contentHash":"aB1"},{"contentHash":"x"},{"contentHash":"Ab1"}]').otherwise('[{"contentHash":"y"},{}]')
    said = F.concat(F.lit('{"data":{"mediaItems":{"nodes":[{"id":1,"releases":[{"discs":'), discs_, F.lit("}]}]}}}"))
    found = files.lookup_discs(_answers(_t(spark, sf_dir, "customer"), "c_custkey", said, files.LOOKUP))
    return files.matching_discs(found, F.lit("AB1")).select("path", F.col("disc.contentHash").alias("hash"))


@_query("""SELECT p_partkey::VARCHAR AS path, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey ELSE 'e' || p_partkey END AS upc FROM part WHERE p_partkey % 5 > 1""")
def product_answers(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.concat(F.lit('{"title":" '), "p_name", F.lit(' ","brand":"'), F.when(key % 2 == 0, F.col("p_brand")).otherwise("  "), F.lit('","upc":"'), F.when(key % 3 == 0, F.concat(F.lit("u"), _text(key))).otherwise(""), F.lit('","ean":"e'), _text(key), F.lit('"}'))
    said = F.concat(F.lit('{"code":"'), F.when(key % 5 == 0, "EXCEED_LIMIT").otherwise("OK"), F.lit('","items":['), F.when(key % 5 != 1, F.concat(item, F.lit(',{"title":"second"}'))).otherwise(""), F.lit("]}"))
    return files.products(_answers(_t(spark, sf_dir, "part"), "p_partkey", said, files.UPC))


@_query("""SELECT p_partkey::VARCHAR AS path, p_partkey AS tmdb_id, CASE WHEN p_partkey % 2 = 0 THEN 'tt' || p_partkey END AS imdb_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand END AS title, CASE WHEN p_partkey % 4 > 0 THEN 1950 + p_size END AS year,
CASE WHEN p_partkey % 2 = 0 THEN 'Movie' ELSE 'Series' END AS content_type FROM part""")
def title_answers(spark, sf_dir):
    key, parts = F.col("p_partkey"), _t(spark, sf_dir, "part")
    date = F.when(key % 4 > 0, F.concat(_text(1950 + F.col("p_size")), F.lit("-01-02"))).otherwise("")

    def said(name: str, first: str, imdb: Column) -> Column:
        titles = _nth([F.concat(F.lit(f'"{name}":"'), "p_name", F.lit('",')), F.concat(F.lit(f'"original_{name}":"'), "p_brand", F.lit('",')), F.lit(f'"{name}":"","original_{name}":"o",')], key)
        return F.concat(F.lit('{"id":'), _text(key), F.lit(","), titles, F.lit(f'"{first}":"'), date, F.lit('",'), imdb, F.lit("}"))

    movies = files.movie_details(_answers(parts.where(key % 2 == 0), "p_partkey", said("title", "release_date", F.concat(F.lit('"imdb_id":"tt'), _text(key), F.lit('"'))), files.MOVIE))
    series = files.series_details(_answers(parts.where(key % 2 == 1), "p_partkey", said("name", "first_air_date", F.lit('"external_ids":{"imdb_id":""}')), files.SERIES))
    return movies.unionByName(series).select("path", "tmdb_id", "imdb_id", "title", "year", "content_type")


@_query("""SELECT 'My Film ' || doc_id AS name, CASE WHEN doc_id % 3 > 0 THEN CAST(round(n_chars * 0.5) AS BIGINT) END AS duration_seconds, n_chars * 1000000 AS size_bytes, 'My Film ' || doc_id || '.mkv' AS output_file, doc_id % 3 AS chapter_count, 2 + doc_id % 2 AS streams,
'Video AVC 1920x1080|Audio ac3 -' || CASE WHEN doc_id % 2 = 1 THEN '|Video Mpeg4-MVC-3D -' ELSE '' END AS shown FROM documents""")
def probe_scans(spark, sf_dir):
    key = F.col("doc_id")
    chapters = _nth(["", '{"id":1}', '{"id":1},{"id":-2}'], key)
    said = F.concat(
        F.lit('{"format":{"duration":"'), F.when(key % 3 > 0, _text(F.col("n_chars") * 0.5)).otherwise("N/A"), F.lit('","size":"'), _text(F.col("n_chars") * 1000000), F.lit('"},"streams":['),
        F.lit('{"index":0,"codec_type":"video","codec_name":"AVC","width":1920,"height":1080},{"index":1,"codec_type":"audio","codec_name":"ac3","channels":6,"sample_rate":"48000"}],"chapters":['), chapters, F.lit("]}"),
    )
    probes = files.media_probes(_answers(_t(spark, sf_dir, "documents"), "doc_id", said, files.PROBE)).withColumn("path", F.concat(F.lit("/m/My Film "), "path", F.lit(".mkv")))
    file = F.col("path")
    found = files.synthetic_scan(probes, file, F.regexp_extract(file, r"([0-9]+)\.mkv$", 1).cast("int") % 2 == 1)
    one = lambda s: F.concat_ws(" ", s["kind"], s["codec_short"], F.coalesce(s["video_size"], F.lit("-")))
    return found.select("name", "duration_seconds", "size_bytes", "output_file", F.col("chapter_count").cast("bigint").alias("chapter_count"), F.size("streams").cast("bigint").alias("streams"), F.array_join(F.transform("streams", one), "|").alias("shown"))


@_query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders) SELECT o_orderkey::VARCHAR AS content_hash, CASE WHEN y % 2 = 0 AND o_custkey % 4 > 0 THEN 'r-' || y ELSE 'R' || y END AS release_slug, CASE WHEN o_custkey % 3 = 1 THEN 's' || o_custkey ELSE 'I' || o_custkey END AS media_item_id,
CASE WHEN o_custkey % 3 > 0 THEN 'T' || o_custkey ELSE 'I' || o_custkey END AS item_title, CASE WHEN o_custkey % 3 = 2 THEN 1999 END AS year, CASE WHEN o_custkey % 3 = 1 THEN o_custkey END AS tmdb_id, CASE WHEN o_custkey % 3 = 2 THEN 'tt1' END AS imdb_id,
CASE WHEN y % 2 = 0 AND o_custkey % 4 > 0 AND o_custkey % 3 <> 2 THEN 'c.jpg' END AS image_url FROM o""")
def catalogue_rows(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    cust, year, c = F.col("o_custkey"), _text(F.col("y")), F.col
    item = F.concat(F.lit("/m/data/movie/I"), _text(cust))
    disc = orders.select(F.concat(item, F.lit("/R"), year, F.lit("/disc"), _text(c("o_orderkey")), F.lit(".json")).alias("path"), _text(c("o_orderkey")).alias("ContentHash"), F.lit(1).alias("Index"), F.lit(None).alias("Titles"))
    release = orders.where("y % 2 = 0 and o_custkey % 4 > 0").select(F.concat(item, F.lit("/R"), year, F.lit("/release.json")).alias("path"), F.concat(F.lit("r-"), year).alias("Slug"), F.lit(" c.jpg ").alias("ImageUrl")).distinct()
    ids = F.struct(F.when(cust % 3 == 1, F.concat(F.lit(" "), _text(cust), F.lit(" "))).otherwise("12x").alias("Tmdb"), F.when(cust % 3 == 2, " tt1").otherwise(" ").alias("Imdb"), F.lit(None).cast("string").alias("Tvdb"))
    items = orders.where("o_custkey % 3 > 0").select(F.concat(item, F.lit("/metadata.json")).alias("path"), F.concat(F.lit("T"), _text(cust)).alias("Title"), F.when(cust % 3 == 1, F.concat(F.lit("s"), _text(cust))).alias("Slug"), F.when(cust % 3 == 2, 1999).otherwise(0).alias("Year"), F.when(cust % 3 == 2, "  ").alias("ImageUrl"), ids.alias("ExternalIds")).distinct()
    found = files.catalogue_identities(disc, release, items)
    return found.select("content_hash", "release_slug", "media_item_id", "item_title", "year", "tmdb_id", "imdb_id", "image_url")


@_query("""SELECT p_partkey, 'r' || p_partkey AS slug, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN (1990 + p_size) || ' ' || p_name ELSE p_name END AS sort, CASE WHEN p_partkey % 2 = 0 THEN (1990 + p_size)::VARCHAR END AS year, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS first_name,
CASE WHEN p_partkey % 3 = 0 THEN 'github' END AS source, '[]' AS groups, CASE WHEN p_partkey % 5 = 0 THEN 'en-us' END AS locale FROM part""")
def release_records(spark, sf_dir):
    key, c = F.col("p_partkey"), F.col
    people = F.when(key % 3 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    doc = sinks.release_json(F.concat(F.lit("r"), _text(key)), c("p_name"), F.when(key % 2 == 0, 1990 + c("p_size")), F.lit("2020-01-01"), people, F.lit(None).cast("array<string>"), Locale=F.when(key % 5 == 0, "en-us"))
    of = lambda path: F.get_json_object("d", f"$.{path}")
    rows = _t(spark, sf_dir, "part").select("p_partkey", doc.alias("d"))
    return rows.select("p_partkey", of("Slug").alias("slug"), of("Title").alias("title"), of("SortTitle").alias("sort"), of("Year").alias("year"), of("Contributors[0].Name").alias("first_name"), of("Contributors[0].Source").alias("source"), of("Groups").alias("groups"), of("Locale").alias("locale"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS disc_title, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS num_sets, CASE WHEN p_partkey % 4 < 2 THEN 2 END AS set_number, CASE WHEN p_partkey % 4 = 0 THEN 'Last' WHEN p_partkey % 4 < 3 THEN 'First' END AS first_name, p_partkey % 4 = 3 AS failed FROM part""")
def side_files(spark, sf_dir):
    key = F.col("p_partkey")
    again = F.when(key % 4 == 0, '<d:title titleNumber="1"><d:titleName>Last</d:titleName></d:title>').otherwise('<d:title><d:titleName>None</d:titleName></d:title>')
    numbers = F.when(key % 4 == 0, F.concat(F.lit("<d:numSets>"), _text(F.col("p_size")), F.lit("</d:numSets><d:setNumber> 2 </d:setNumber>"))).when(key % 4 == 1, "<d:numSets>x</d:numSets><d:setNumber>9</d:setNumber><d:setNumber>2</d:setNumber>").otherwise("")
    xml = F.concat(
        F.lit('<l xmlns:d="u"><d:discinfo><d:title><d:name> '), "p_name", F.lit(" </d:name><d:name>Other</d:name></d:title>"), numbers, F.lit("</d:discinfo><d:name>Out</d:name><d:tableofcontents>"),
        F.lit('<d:title titleNumber="1"><d:titleName>First</d:titleName></d:title>'), again, F.lit("</d:tableofcontents><d:titleName>Out</d:titleName></l>"), F.when(key % 4 == 3, "<").otherwise(""),
    )
    s = _t(spark, sf_dir, "part").select("p_partkey", files.side_file(xml).alias("s"))
    return s.select("p_partkey", "s.disc_title", "s.num_sets", "s.set_number", F.try_element_at("s.title_names", F.lit(1)).alias("first_name"), F.col("s.error").isNotNull().alias("failed"))


@_query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS n FROM lineitem WHERE l_orderkey % 5 < 3)
SELECT l_orderkey::VARCHAR AS path, CAST(n AS INT) AS ord, lpad(l_linenumber::VARCHAR, 5, '0') AS clip, l_suppkey::BIGINT AS in_time, l_partkey::BIGINT AS out_time FROM i""")
def play_items(spark, sf_dir):
    c = F.col
    item = F.format_string("0014%s4D325453000001%s%s", F.hex(F.lpad(_text(c("l_linenumber")), 5, "0").cast("binary")), F.lpad(F.hex(c("l_suppkey")), 8, "0"), F.lpad(F.hex(c("l_partkey")), 8, "0"))
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", item.alias("x")))).alias("items"))
    whole = F.unhex(F.concat(F.hex(F.lit(b"MPLS0200")), F.lit("0000000C000000000000"), F.lpad(F.hex(F.size("items")), 4, "0"), F.lit("0000"), F.array_join(c("items.x"), "")))
    broken = F.when(c("l_orderkey") % 5 == 3, F.substring(whole, 1, F.length(whole) - 3)).when(c("l_orderkey") % 5 == 4, F.concat(F.lit(b"X"), whole)).otherwise(whole)
    return files.play_items(lists.select(_text(c("l_orderkey")).alias("path"), broken.alias("content")))


@_query("""SELECT o_custkey::VARCHAR AS scan_id, 'D' || max(o_orderkey) AS name, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'L' END AS volume_label, '1.' || max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) % 30 || '.3' AS tool_version FROM orders GROUP BY o_custkey""")
def disc_scans(spark, sf_dir):
    key = F.col("o_orderkey")
    flat = _log_records(spark, sf_dir, "CINFO", [(2, F.concat(F.lit("D"), _text(key))), (32, F.when(key % 3 == 0, "L"))], [])
    said = F.concat(F.lit("tool v1."), _text(key % 30), F.lit(".3 linux"))
    version = _t(spark, sf_dir, "orders").select(_text(F.col("o_custkey")).alias("scan_id"), (key * 100 + 99).alias("seq"), F.lit("MSG").alias("kind"), F.array(F.lit("1005"), F.lit("0"), F.when(key % 2 == 0, "1").otherwise("x"), said).alias("fields"))
    return scan.scan_discs(scan.typed_records(flat.unionByName(version))).select("scan_id", "name", "volume_label", "tool_version")


@_query("""SELECT p_partkey::VARCHAR AS path, kind, CAST(ord AS INT) AS ord, file_path FROM part, (VALUES ('posters', 0, 0), ('posters', 1, 1), ('posters', 2, 2), ('logos', 0, 3)) v(kind, ord, n), (SELECT ['a', 'b', 'c', 'l'] AS low, ['b', 'a', 'c', 'l'] AS high) f,
LATERAL (SELECT CASE WHEN p_size % 3 > 1 THEN high[n + 1] ELSE low[n + 1] END AS file_path)""")
def image_order(spark, sf_dir):
    said = F.concat(F.lit('{"posters":[{"file_path":"a","vote_average":1.0},{"file_path":"b","vote_average":'), _text(F.col("p_size") % 3), F.lit('},{"file_path":"c"}],"backdrops":[],"logos":[{"file_path":"l","vote_average":0.5}]}'))
    found = files.images(_answers(_t(spark, sf_dir, "part"), "p_partkey", said, files.IMAGES))
    return found.select("path", "kind", "ord", "file_path")


@_query("""SELECT p_partkey::VARCHAR AS path, CASE p_partkey % 4 WHEN 0 THEN 'Movie' WHEN 1 THEN 'Series' WHEN 2 THEN 'Movie' END AS kind, CASE WHEN p_partkey % 4 < 3 THEN p_partkey END AS tmdb_id FROM part""")
def find_answers(spark, sf_dir):
    key = F.col("p_partkey")
    own = F.concat(F.lit('{"id":'), _text(key), F.lit("}"))
    cases = [F.concat(F.lit('{"movie_results":['), own, F.lit(',{"id":-1}],"tv_results":[]}')), F.concat(F.lit('{"movie_results":[],"tv_results":['), own, F.lit("]}")), F.concat(F.lit('{"movie_results":['), own, F.lit('],"tv_results":[{"id":-2}]}')), F.lit('{"movie_results":[]}')]
    return files.finds(_answers(_t(spark, sf_dir, "part"), "p_partkey", _nth(cases, key), files.FIND))


@_query("""WITH p AS (SELECT *, 'data/' || CASE WHEN p_partkey % 2 = 0 THEN 'series' ELSE 'movie' END || '/' || p_name || ' (' || (1950 + p_size) || ')' AS title FROM part)
SELECT p_partkey, title || f AS path, octet_length(encode(content))::INT AS size FROM p, LATERAL (VALUES ('/metadata.json', '{' || p_name || '}'), ('/r_' || p_size || '/release.json', '{r}'), ('/r_' || p_size || '/disc0' || greatest(p_partkey % 5, 1) || '.json', '{d}'),
('/cover.jpg', CASE WHEN p_partkey % 3 = 0 THEN p_brand END), ('/r_' || p_size || '/front.jpg', CASE WHEN p_partkey % 4 = 0 THEN 'f' END), ('/tmdb.json', CASE WHEN p_partkey % 7 = 0 THEN '{t}' END)) v(f, content) WHERE content IS NOT NULL""")
def staged_files(spark, sf_dir):
    key, c = F.col("p_partkey"), F.col
    rows = _t(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, "Series").otherwise("Movie").alias("kind"), c("p_name").alias("title"), (1950 + c("p_size")).alias("year"), F.concat(F.lit("r/"), _text(c("p_size"))).alias("release"), (key % 5).cast("int").alias("index"),
        F.concat(F.lit("{"), "p_name", F.lit("}")).alias("metadata"), F.lit("{r}").alias("release_record"), F.lit("{d}").alias("disc"), F.when(key % 3 == 0, c("p_brand")).alias("cover"), F.when(key % 7 == 0, "{t}").alias("answer"), F.when(key % 4 == 0, "f").alias("front"), key,
    )
    return sinks.staged_files(rows, "p_partkey").select("p_partkey", "path", F.octet_length("content").alias("size"))


# Streams as tables ----------------------------------------------------------------------------------------------------


def _job_events(spark: SparkSession, sf_dir: str, kinds: dict[str, str]) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")]
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 7).alias("current"), (F.col("event_id") % 11).alias("total"), (F.col("event_id") % 5).alias("max"), (F.col("event_id") % 5).alias("item"), F.lit(5).cast("bigint").alias("items"))


@_query("""WITH l AS (SELECT user_id AS job, max(event_id) AS e FROM events WHERE event_type = 'view' GROUP BY 1) SELECT job, CASE WHEN e % 5 = 0 THEN 0.0::DOUBLE ELSE (e % 7)::DOUBLE / (e % 5) END AS current_fraction, CASE WHEN e % 5 = 0 THEN 0.0::DOUBLE ELSE (e % 11)::DOUBLE / (e % 5) END AS total_fraction FROM l""")
def latest_progress(spark, sf_dir):
    return progress.latest_progress(_job_events(spark, sf_dir, {"view": "PRGV", "click": "MSG"}))


@_query("""WITH j AS (SELECT user_id AS job, count(*) FILTER (WHERE event_type = 'view') AS done, count(*) FILTER (WHERE event_type = 'purchase') AS failed, max(event_id) FILTER (WHERE event_type = 'click') AS s, max(event_id) FILTER (WHERE event_type IN ('view', 'purchase')) AS e,
bool_or(event_type = 'signup') AS over FROM events GROUP BY 1) SELECT job, done, failed, CASE WHEN NOT over AND (s % 5) IS DISTINCT FROM (e % 5) THEN s % 5 END AS running, CASE WHEN over THEN 1.0::DOUBLE ELSE coalesce((e % 5 + 1)::DOUBLE / 5, 0) END AS fraction, (e % 5 + 1) || ' / 5' AS shown,
CASE WHEN over AND failed = 0 THEN 'complete' WHEN over THEN 'complete with failures' WHEN s IS NOT NULL THEN 'running' ELSE 'queued' END AS state FROM j""")
def job_states(spark, sf_dir):
    return progress.job_states(_job_events(spark, sf_dir, {"click": "started", "view": "finished", "purchase": "failed", "signup": "all_done"}))


@_query("""WITH v AS (SELECT event_id, event_type = 'signup' AS l, value::DOUBLE * 1.5 - 20 AS v FROM events) SELECT event_id, CASE WHEN NOT l THEN greatest(0, floor(v))::BIGINT END AS current, CASE WHEN NOT l THEN CASE WHEN event_id % 3 = 2 AND v > 0 THEN floor(v * 10)::BIGINT ELSE 0 END END AS max,
CASE WHEN NOT l THEN 'Encoding' END AS label, CASE WHEN l THEN 'line ' || event_id END AS message, CASE event_id % 4 WHEN 0 THEN event_id / 1e6 WHEN 1 THEN event_id / 1e6 END AS seconds FROM v""")
def conversion_events(spark, sf_dir):
    key, v = F.col("event_id"), F.col("value").cast("double") * 1.5 - 20
    kind = F.when(F.col("event_type") == "signup", "log").otherwise("progress")
    total = F.when(key % 3 == 1, F.lit(0.0)).when(key % 3 == 2, v * 10)
    said = F.concat(_nth(["out_time_us=", "out_time_us= +", "out_time_us=-", "out_time_ms="], key), _text(key))
    made = progress.conversion_progress(kind, v, total, F.lit("Encoding"), F.concat(F.lit("line "), _text(key)))
    return _t(spark, sf_dir, "events").select("event_id", made.alias("p"), progress.out_time_seconds(said).alias("seconds")).select("event_id", "p.current", "p.max", "p.label", "p.message", "seconds")
