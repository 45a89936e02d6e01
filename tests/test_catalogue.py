"""Catalogue functions, operators, sources and streams on small inputs, and SQL twins at the smallest scale."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import media, naming, text
from marlstone.operators import discs, identify, scan
from marlstone.plans.registry import ORACLES, QUERIES
from marlstone.sources import files, robot_log
from marlstone.streaming import progress

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(frame):
    return sorted(tuple("null" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert values(got.toPandas()) == values(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize(
    "lines",
    [
        [(1, 5, 2, 3.0, "R"), (1, 5, 2, 3.0, "N"), (1, 5, 2, 3.0, "A"), (2, 5, 2, 3.0, "A"), (2, 5, 2, 3.0, "N"), (2, 5, 1, 3.0, "R")],
        [(1, 5, 1, 0.5, "N"), (1, 5, 2, 1.5, "R"), (2, 5, 1, 2.5, "A"), (3, 5, 1, 7.75, "A"), (4, 5, 1, -2.6, "A")],
        [(1, 5, 1, None, "N"), (1, 6, 1, 4.0, "R"), (2, 5, 1, None, "A"), (3, 6, 1, None, "N"), (3, 5, 1, 2.0, "A")],
        [(1, None, 1, 1.0, "R"), (1, 5, 1, 1.0, "N"), (2, 5, None, 1.0, "A"), (2, 5, 7, 1.0, "N"), (3, 5, None, 1.0, "A"), (4, 5, 1, None, "A"), (4, 5, 1, 9.0, "R")],
        [(None, 5, 1, 1.0, ""), (None, 6, 1, 1.0, None), (1, 5, 1, 1.0, "a\"\\\n\u20ac"), (1, 6, 1, 1.0, "null"), (1, 7, 1, 1.0, ""), (1, 7, 1, 1.0, "[1]")],
    ],
    ids=["ties", "fractions", "no quantity", "no number", "odd flags"],
)
def test_render_json_equals_sql_on_odd_lines(spark, tmp_path, lines):
    columns = {"l_orderkey": "Int64", "l_partkey": "Int64", "l_linenumber": "Int32", "l_quantity": "Float64", "l_returnflag": "object"}
    frame = pd.DataFrame(lines, columns=list(columns)).astype(columns)
    (tmp_path / "lineitem.parquet").mkdir()
    for n, part in enumerate((frame[:2], frame[2:])):  # ties go over the end of a file, too
        part.to_parquet(tmp_path / f"lineitem.parquet/part-{n}.parquet", index=False)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["render_json"]).fetchall()
    got = [tuple(r) for r in QUERIES["render_json"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("label", "title", "season"), [("DOBIEGILLIS_S1D1", "Dobiegillis", 1), ("the_expanse_s02d03", "The Expanse", 2), ("Buffy The Vampire Slayer S7", "Buffy The Vampire Slayer", 7), ("Random Disc", "Random Disc", None)])
def test_series_labels(spark, label, title, season):
    assert one(spark, text.series_title(F.lit(label))) == title
    assert one(spark, text.series_season(F.lit(label))) == season


@pytest.mark.parametrize(("raw", "clean"), [("Avatar:  The Way of Water", "Avatar The Way of Water"), ("M.A.S.H. ", "M.A.S.H"), ("a/b", "a b")])
def test_sanitise(spark, raw, clean):
    assert one(spark, text.sanitise(F.lit(raw))) == clean


@pytest.mark.parametrize(("raw", "seconds"), [("1:02:03", 3723), ("2:03", 123), ("59", 59), ("0:99:00", 5940), ("x", None), ("1:2:3:4", None), (" 1", None), ("", None)])
def test_durations(spark, raw, seconds):
    assert one(spark, text.parse_duration(F.lit(raw))) == seconds


def test_empty_and_single_hash(spark):
    rows = spark.createDataFrame([(1, 0, 0)], "d int, o int, s bigint")
    assert discs.content_hash(rows, ["d"], F.col("o"), "s").first()["content_hash"] == "7DEA362B3FAC8E00956A4952A3D4F474"


def test_relations(spark):
    rows = [(1, 0, "1,2"), (1, 1, "1"), (1, 2, "2"), (1, 3, "23/95"), (1, 4, "+,")]
    titles = spark.createDataFrame(rows, "d int, t int, m string").withColumn("s", text.parse_segment_map(F.col("m")))
    got = {r["t"]: (r["kind"], r["constituents"], r["containers"]) for r in discs.title_relations(titles, "d", "t", "s").collect()}
    assert got == {0: ("composite", [1, 2], None), 1: ("constituent", None, [0]), 2: ("constituent", None, [0]), 3: ("atomic", None, None), 4: ("atomic", None, None)}


def test_main_title_of_identity(spark):
    rows = [(d, i, t, f) for d in "abcdefg" for i, t, f in ((0, 50, None), (1, 10, "00001.MPLS"), (2, 90, "00002.mpls"), (3, 90, ""), (4, 5, "00001.mpls"))]
    titles = spark.createDataFrame(rows, "d string, i int, t int, source_file string")
    known = [
        ("a", 0, 0, 7, "Extra", "00002.mpls"), ("a", 0, 1, 8, "Main", "00001.mpls"), ("a", 0, 2, 9, "Main", "00002.mpls"), ("b", 0, 0, 1, "Main", None), ("c", 0, 0, 6, "Main", "x.mpls"),
        ("d", 0, 0, 0, "Main", ""), ("e", 0, 0, 1, "Extra", "00001.mpls"), ("e", 1, 0, 1, "Main", "00001.mpls"), ("f", 4, 0, 0, "Main", "00001.mpls"), ("f", 2, 5, 0, "Main", "00002.MPLS"), ("z", 0, 0, 5, "Main", None),
    ]
    identities = spark.createDataFrame(known, "d string, identity int, position int, index int, role string, source_file string")
    got = discs.main_title(titles, ["d"], "i", F.col("t"), F.col("i"), identities)
    assert {r["d"]: r["main_title"] for r in got.collect()} == {"a": 1, "b": 1, "c": 6, "d": 0, "e": 3, "f": 2, "g": 3, "z": 5}


def test_robot_log():
    lines = ['TINFO:0,2,0,"a ""b"", c"', "garbage", 'MSG:5,0,0,"two', 'lines"', "CINFO:1,\\", "2", 'SINFO:0,0,1,0,"open']
    assert list(robot_log.fold(lines)) == [("TINFO", ["0", "2", "0", 'a "b", c']), ("MSG", ["5", "0", "0", "two\nlines"]), ("CINFO", ["1", "\n2"])]


def test_scan_from_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text('MSG:1005,0,1,"v1.17.8 started"\nCINFO:2,0,"Disc"\nTINFO:0,9,0,"0:25:35"\nTINFO:0,9,0,"bad"\nTINFO:1,9,0,"1:00"\nSINFO:0,0,1,0,"Video"\nTINFO:x,9,0,"1"\n')
    typed = scan.typed_records(robot_log.read_robot_logs(spark, str(tmp_path)))
    titles = {r["title_index"]: r["duration_seconds"] for r in scan.scan_titles(typed).collect()}
    assert titles == {0: None, 1: 60}
    disc = scan.scan_discs(typed).first()
    assert (disc["name"], disc["tool_version"]) == ("Disc", "1.17.8")
    assert one(spark, scan.version_at_least(F.lit("1.18"), 1, 17, 9)) is True


def test_playlist_and_region(spark):
    item = lambda clip, a, b: (20).to_bytes(2, "big") + clip + b"M2TS" + b"\0\0\0" + a.to_bytes(4, "big") + b.to_bytes(4, "big")
    data = b"MPLS0200" + (12).to_bytes(4, "big") + b"\0" * 6 + (1).to_bytes(2, "big") + b"\0\0" + item(b"00001", 45000, 90000)
    assert files.parse_playlist(data) == [("00001", 45000, 90000)]
    assert files.parse_playlist(data[:-3]) is None and files.parse_playlist(b"") is None
    assert [one(spark, media.dvd_region(F.lit(m))) for m in (0, 0xFF, 0xFE, 0xFD)] == ["0", None, "1", "2"]


def test_paths_prefer_ids_by_scheme(spark):
    args = [F.lit(x) for x in ("/lib/Movies", "Movie", 1999, "tt1", 5)]
    none = F.lit(None).cast("string")
    assert one(spark, naming.movie_path("plex", *args, none)) == "/lib/Movies/Movie (1999) {imdb-tt1}/Movie (1999) {imdb-tt1}.mkv"
    assert one(spark, naming.movie_path("kodi", *args, F.lit("3D"))) == "/lib/Movies/Movie (1999) {tmdb=5}/Movie (1999) {tmdb=5} - 3D.mkv"


def test_precedence(spark):
    blank = F.lit(" ")
    assert one(spark, identify.display_title(blank, F.lit(""), F.lit("n"), F.lit(3))) == "n"
    assert one(spark, identify.submission_title(F.lit(""), F.lit("i"), F.lit("n"), F.lit(3))) == ""
    assert one(spark, identify.image_url(F.lit(""), F.lit("x"))) is None


def test_progress_stream(spark, tmp_path):
    schema = "job string, seq long, kind string, label string, current long, total long, max long"
    rows = [("j", 1, "PRGC", "a", 0, 0, 0), ("j", 2, "PRGV", None, 1, 2, 4), ("j", 3, "PRGT", "t", 0, 0, 0), ("j", 4, "PRGV", None, 2, 2, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.progress_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("progress_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.table("progress_rows").orderBy("seq").select("seq", "current_label", "total_label", "current_fraction").collect()]
    assert got == [(2, "a", None, 0.25), (4, "a", "t", 0.0)]
