"""Planning of conversions, landed answers, catalogue documents and captions on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import conversion, media, naming
from marlstone.operators import identify, scan, sinks
from marlstone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_encoder_args(spark):
    args = conversion.encoder_args(F.lit("vaapi"), F.lit("h264"), F.lit(20), F.lit("/dev/dri/renderD128"))
    got = one(spark, args)
    assert got["init"] == ["-vaapi_device", "/dev/dri/renderD128"]
    assert got["upload_filter"] == "format=nv12,hwupload"
    assert got["args"] == ["-c:v", "h264_vaapi", "-qp", "20", "-g", "48"]
    slow = one(spark, conversion.encoder_args(F.lit("auto"), F.lit("h265"), F.lit(21), F.lit(None).cast("string")))
    assert slow["init"] == [] and slow["args"][1] == "libx265" and "-x265-params" in slow["args"]


@pytest.mark.parametrize(("quality", "rate"), [(10, "24M"), (18, "24M"), (19, "23M"), (22, "18M"), (50, "0M")])
def test_bitrate_from_quality(spark, quality, rate):
    assert one(spark, conversion.encoder_args(F.lit("v4l2m2m"), F.lit("h264"), F.lit(quality), F.lit(None).cast("string"))["args"])[3] == rate


def test_quality_and_formats(spark):
    q = lambda *a, **k: one(spark, conversion.quality(*(F.lit(x) for x in a), **k))
    assert (q("higher", "software", "h264"), q("smaller", "amf", "h265"), q("balanced", "qsv", "h265")) == (15, 26, 18)
    assert q("higher", "software", "h264", override=F.lit(3)) == 3
    assert tuple(one(spark, media.output_size(F.lit("full_tab"), F.lit(1920), F.lit(1080)))) == (1920, 2160)
    assert one(spark, conversion.layout(F.lit("frame_sequential"))["stereo_mode"]) is None
    assert one(spark, naming.converted_path(F.lit("/a.3d/Avatar (2009)"), F.lit("fsbs"))) == "/a.3d/Avatar (2009).3d.fsbs.mkv"
    assert one(spark, naming.converted_path(F.lit("/x/Avatar (2009) - 3D"), F.lit("fs"))) == "/x/Avatar (2009) - 3D.fs.mkv"
    assert one(spark, naming.variant_name(F.lit("Directors"))) == "Director's Cut"


def test_stereo_source(spark):
    s = lambda b, m: one(spark, conversion.stereo_source(F.lit(b).cast("binary"), F.lit(m).cast("int")))
    assert (s(b"x", None), s(None, 13), s(None, 1), s(None, None)) == ("MvcWithBlockAdditions", "MvcInlineLaced", None, None)


@pytest.mark.parametrize(
    ("name", "role"), [("MainFeature", "Main"), ("BehindThe Scenes", "BehindTheScenes"), ("DeletedScenes", "DeletedScene"), ("Extra", "Other"), ("Episode", "Other"), (None, "Other")]
)
def test_roles(spark, name, role):
    assert one(spark, identify.parse_role(F.lit(name).cast("string"))) == role


def test_mount_tool(spark):
    said = "Mapped file x as /dev/loop3.\r\nMounted /dev/loop3 at /run/media/me/37. Four Steps 3D (2025)1 \r\n"
    assert one(spark, files.mount_point(F.lit(said))) == "/run/media/me/37. Four Steps 3D (2025)1"
    assert one(spark, files.loop_device(F.lit(said))) == "/dev/loop3"
    assert one(spark, files.mount_point(F.lit("already mounted at `/run/My Disc'."))) == "/run/My Disc"
    assert one(spark, files.mount_point(F.lit("nothing"))) is None
    assert one(spark, files.encoders_in(F.lit(" V..... hevc_qsv  x\n V libx264"))) == ["libx264", "hevc_qsv"]


def test_landed_answers(spark, tmp_path):
    put = lambda d, n, x: ((tmp_path / d).mkdir(exist_ok=True), (tmp_path / d / n).write_text(json.dumps(x)))
    put("m", "a.json", {"id": 5, "title": "", "original_title": "O", "release_date": "1982-08-13", "imdb_id": "", "overview": "p"})
    row = files.read_movie_details(spark, str(tmp_path / "m")).first()
    assert (row["tmdb_id"], row["title"], row["year"], row["imdb_id"], row["plot"]) == (5, None, 1982, None, "p")
    put("s", "a.json", {"id": 6, "name": None, "original_name": "S", "external_ids": {"imdb_id": "tt1"}, "first_air_date": ""})
    row = files.read_series_details(spark, str(tmp_path / "s")).first()
    assert (row["title"], row["imdb_id"], row["year"], row["content_type"]) == ("S", "tt1", None, "Series")
    put("f", "a.json", {"movie_results": [], "tv_results": [{"id": 9}]})
    assert tuple(files.read_finds(spark, str(tmp_path / "f")).select("kind", "tmdb_id").first()) == ("Series", 9)
    put("i", "a.json", {"posters": [{"file_path": "a", "vote_average": 1.0}, {"file_path": "b", "vote_average": 3.0}, {"file_path": "c", "vote_average": 3.0}], "backdrops": [], "logos": []})
    assert [r["file_path"] for r in files.read_images(spark, str(tmp_path / "i")).orderBy("ord").collect()] == ["b", "c", "a"]
    put("e", "a.json", [{"id": 1, "seasonNumber": 1, "episodeNumber": 2}, {"id": 2, "seasonNumber": 2, "episodeNumber": 1}])
    assert [r["id"] for r in files.read_library(spark, str(tmp_path / "e"), "episode", 2).collect()] == [2]


def test_synthetic_scan(spark, tmp_path):
    probe = {"format": {"filename": "x", "duration": "61.5", "size": "2500000000"}, "streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080}, {"index": 1, "codec_type": "audio", "sample_rate": "48000", "tags": {"language": "eng"}}], "chapters": [{"id": -1}]}
    (tmp_path / "p.json").write_text(json.dumps(probe))
    probes = files.read_probes(spark, str(tmp_path)).withColumn("path", F.lit("/v/Film.x.mkv"))
    row = files.synthetic_scan(probes, "path", F.lit(True)).first()
    assert (row["name"], row["output_file"], row["duration_text"], row["display_size"], row["chapter_count"]) == ("Film.x", "Film.x.mkv", "0:01:02", "2.5 GB", 1)
    assert [(s["kind"], s["video_size"], s["sample_rate"], s["language_code"]) for s in row["streams"]] == [("Video", "1920x1080", None, None), ("Audio", None, 48000, "eng"), ("Video", None, None, None)]
    assert row["streams"][2]["stream"] == 2 and "MVC" in row["streams"][2]["codec_long"]


def test_chapters():
    atom = "<ChapterAtom><ChapterTimeStart>0</ChapterTimeStart>{}</ChapterAtom>"
    shown = "<ChapterDisplay><ChapterString>Old</ChapterString></ChapterDisplay>"
    xml = "<E>" + atom.format(shown) + atom.format("<ChapterDisplay></ChapterDisplay>") + atom.format("\n ") + "</E>"
    want = "<E>" + atom.format("<ChapterDisplay><ChapterString>A &amp; \\1</ChapterString></ChapterDisplay>") + atom.format("<ChapterDisplay><ChapterString>B</ChapterString></ChapterDisplay>")
    want += atom.format("<ChapterDisplay><ChapterString>C</ChapterString><ChapterLanguage>eng</ChapterLanguage></ChapterDisplay>") + "</E>"
    assert sinks.titled_chapters(xml, ["A & \\1", "B", "C"]) == want
    assert sinks.titled_chapters(xml, ["A"]) is None
    assert sinks.titled_chapters("<E></E>", []) is None
    assert sinks.titled_chapters("<ChapterAtom>", ["A"]) is None


def test_splice_in_a_column(spark):
    rows = spark.createDataFrame([("<ChapterAtom></ChapterAtom>", ["T"]), ("<ChapterAtom></ChapterAtom>", []), (None, ["T"])], "x string, t array<string>")
    got = [r[0] for r in rows.select(sinks.splice_chapters("x", "t")).collect()]
    assert "<ChapterString>T</ChapterString>" in got[0] and got[1:] == [None, None]


def test_release_json(spark):
    none = F.lit(None).cast("string")
    doc = json.loads(one(spark, sinks.release_json(F.lit("s"), F.lit("Deluxe"), F.lit(2020), F.lit("2026-01-01T00:00:00+00:00"), F.array(F.lit("me")), F.array().cast("array<string>"), Upc=none, Locale=F.lit("en-us"))))
    assert doc == {"Slug": "s", "Title": "Deluxe", "SortTitle": "2020 Deluxe", "Year": 2020, "DateAdded": "2026-01-01T00:00:00+00:00", "Contributors": [{"Name": "me", "Source": "github"}], "Groups": [], "Locale": "en-us"}
    bare = json.loads(one(spark, sinks.release_json(F.lit("s"), F.lit("D"), F.lit(None).cast("int"), F.lit("t"), F.array().cast("array<string>"), F.array().cast("array<string>"))))
    assert bare == {"Slug": "s", "Title": "D", "SortTitle": "D", "DateAdded": "t", "Groups": []}


def test_newest_output(spark):
    want = spark.createDataFrame([("a", "a/x.mkv"), ("b", "b/x.mkv"), ("c", "c/x.mkv")], "folder string, want string")
    listing = spark.createDataFrame([("a", "a/x.mkv", 1), ("a", "a/y.mkv", 9), ("b", "b/2.mkv", 5), ("b", "b/1.mkv", 5), ("b", "b/3.txt", 9)], "folder string, path string, mtime int")
    got = {r["folder"]: r["output"] for r in identify.resolve_output(want, listing, "folder", "want", "path", "mtime").collect()}
    assert got == {"a": "a/x.mkv", "b": "b/1.mkv", "c": None}


def test_small_rules(spark):
    kind = lambda p: one(spark, scan.input_kind(F.lit(p)))
    assert [kind(p) for p in ("/a/X.ISO", "b.mkv", "c.iso/d", "e")] == ["iso", "mkv", "unknown", "unknown"]
    streams = F.expr("array(struct('Video' as kind, 10 as width), struct('Video' as kind, 10 as width), struct('Audio' as kind, 99 as width))")
    assert one(spark, scan.widest_stream(streams)) == ("Video", 10)
    assert one(spark, scan.widest_stream(F.expr("array(struct('Audio' as kind, 99 as width))"))) is None
    codecs = lambda c: F.expr(f"array(struct('{c}' as codec_short, '' as codec_long))")
    assert (one(spark, scan.has_mvc_exact(codecs("Mpeg4-MVC-3D"))), one(spark, scan.has_mvc_exact(codecs("mvc"))), one(spark, scan.has_mvc(codecs("mvc")))) == (True, False, True)
    none = F.lit(None).cast("string")
    assert one(spark, identify.submission_role(none, none)) == "Other"
    assert one(spark, identify.row_title(F.lit(3), none, none, F.lit(""))) == "Title 3"
    assert one(spark, identify.row_title(F.lit(3), none, F.lit("B"), F.lit("C"))) == "Title 3 — B"
    chapters = F.expr("array(struct(2 as Index, 'b' as Title), struct(1 as Index, 'a' as Title))")
    empty = F.filter(chapters, lambda c: F.lit(False))
    assert [c["Title"] for c in one(spark, identify.submission_chapters(empty, chapters))] == ["a", "b"]
