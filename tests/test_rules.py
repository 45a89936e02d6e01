"""Sources, streams and sinks on files and streams made here, and fixed values of discs that are known."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import discs, identify, sinks
from marlstone.sources import files, robot_log
from marlstone.streaming import progress

#: Sizes of the files of two discs in order, and their published fingerprints.
KNOWN = {
    "A966EAA0901E2CA24F32F0E288AE91F7": [8596869120, 251904, 9452027904, 221184, 9720410112, 10277732352, 10671980544, 35241984, 55332864, 632832],
    "9288E0AA5B20A8ADBE53D905F769E3F4": [
        24576, 24576, 1718272, 18432, 18432, 229376, 10240, 14336, 14336, 7931904, 14336, 14336, 8257536, 12288, 12288, 30824448, 16384, 16384, 437796864, 16384, 16384, 434294784, 12288, 12288, 239616, 69632, 69632, 2168832,
        1073709056, 1073709056, 1073709056, 551598080,
    ],
}


def test_known_fingerprints(spark):
    rows = [(h, f"VIDEO_TS/{i:03d}.x", s) for h, sizes in KNOWN.items() for i, s in enumerate(sizes)]
    listed = files.disc_files(spark.createDataFrame(rows, "d string, p string, s bigint"), "d", "p", "s")
    got = discs.content_hash(listed, ["d"], F.col("idx"), "size").collect()
    assert len(got) == 2 and all(r["d"] == r["content_hash"] for r in got)


#: Segment maps of three discs, and what their titles are to each other.
RELATIONS = {
    "film": (["23/95", "24/50358", "22/138", "16", "17", "20"], {}),
    "reel": (["100", "200", "300+301+302", "300", "301", "302"], {2: [3, 4, 5]}),
    "series": (["1+2+3+4", "1", "2", "3", "4"], {0: [1, 2, 3, 4]}),
}


def test_known_relations(spark):
    rows = [(d, i, m) for d, (maps, _) in RELATIONS.items() for i, m in enumerate(maps)]
    titles = spark.createDataFrame(rows, "d string, t int, m string").withColumn("s", text.parse_segment_map(F.col("m")))
    got = {(r["d"], r["t"]): (r["kind"], r["constituents"], r["containers"]) for r in discs.title_relations(titles, "d", "t", "s").collect()}
    for d, (maps, whole) in RELATIONS.items():
        for t in range(len(maps)):
            inside = [w for w, parts in whole.items() if t in parts]
            assert got[d, t] == (("composite", whole[t], None) if t in whole else ("constituent", None, inside) if inside else ("atomic", None, None))


@pytest.mark.parametrize(
    ("label", "title", "season"),
    [("SHOW_S_1", "Show S 1", None), ("Gang of S 4", "Gang Of S 4", None), ("SHOW_S2001", "Show S2001", None), ("SHOW_S1 ", "Show", 1), ("Show Season_12-d1", "Show", 12), (" Show - Season 3", "Show", 3), ("S1", "S1", None), ("_S1", "", 1), ("A_S1_S2", "A S1", 2)],
)
def test_edges_of_series_labels(spark, label, title, season):
    row = spark.range(1).select(text.series_title(F.lit(label)).alias("t"), text.series_season(F.lit(label)).alias("s")).first()
    assert (row["t"], row["s"]) == (title, season)


def test_rip_label_keeps_what_was_typed(spark):
    c = F.lit
    row = spark.range(1).select(
        identify.rip_display(c(" x "), c("i"), c("n")).alias("a"), identify.rip_display(c("  "), c(""), c("n")).alias("b"), identify.rip_label(c(3), identify.rip_display(c(None), c(""), c(""))).alias("c"), identify.rip_label(c(3), c("d")).alias("d")
    ).first()
    assert tuple(row) == (" x ", "n", "Title 3", "Title 3 — d")


LOG = [
    'MSG:1005,0,1,"v1.17.8 started"', 'TINFO:0,2,0,"a ""b"", c"', "garbage", 'MSG:5,0,0,"two', "", 'lines"', "CINFO:1,\\", "2\r", "\\", "TCOUNT:1", 'DRV:0,1,1,0,"v","n","say \\', '"', "a:b:c", 'XTRA:"', ':"', 'PRGC:1,2,"label"', "PRGV:1,2,4", "PRGV:3,\\",
]
RECORDS = [
    ("MSG", ["1005", "0", "1", "v1.17.8 started"]), ("TINFO", ["0", "2", "0", 'a "b", c']), ("MSG", ["5", "0", "0", "two\n\nlines"]), ("CINFO", ["1", "\n2"]), ("TCOUNT", ["1"]), ("DRV", ["0", "1", "1", "0", "v", "n", "say \n"]), ("a", ["b:c"]),
    ("XTRA", ["\n:"]), ("PRGC", ["1", "2", "label"]), ("PRGV", ["1", "2", "4"]), ("PRGV", ["3", ""]),
]


def test_fold():
    assert list(robot_log.fold(LOG)) == RECORDS
    assert list(robot_log.fold([*LOG[:-1], 'MSG:1,0,0,"open', "still\\"])) == RECORDS[:-1]
    state = robot_log.Fold()
    for k, line in enumerate(LOG):  # what is pending can be carried on at any line
        state = robot_log.Fold(state.pending) if k % 2 else state
        state.push(line)
    assert state.finish() == RECORDS[-1]


def test_long_record_is_read_once():
    lines = ['MSG:1,0,0,"', *["x" * 50] * 40_000, '"']
    (record,) = robot_log.fold(lines)
    assert len(record[1][3]) == 51 * 40_000 + 1


def run_stream(spark, frame, name, folder):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_stream_equals_fold(spark, tmp_path):
    """Records are the same however their lines are spread over micro-batches; what stays open at the end is dropped."""
    schema = "job string, seq long, line string, ended boolean"
    logs = {"one": LOG, "two": [*LOG[:5], *LOG], "three": [*LOG[:-1], 'MSG:1,0,0,"open']}
    rows = [(job, i, line, False) for job, lines in logs.items() for i, line in enumerate(lines)]
    for part in range(4):
        own = [r for r in rows if r[1] * 4 // 24 == part or part == 3 and r[1] >= 24]
        if part == 3:
            own += [(job, 99, None, True) for job in logs]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in run_stream(spark, robot_log.stream_records(source), "record_rows", tmp_path / "cp").orderBy("scan_id", "seq").collect():
        got.setdefault(r["scan_id"], []).append((r["kind"], r["fields"]))
    assert got == {job: list(robot_log.fold(lines)) for job, lines in logs.items()}


def test_progress_over_batches(spark, tmp_path):
    """T-1 and T-2 in a row: labels hold from one micro-batch to the next, null labels too."""
    schema = "scan_id string, seq long, kind string, fields array<string>"
    batches = [
        [("j", 0, "PRGC", ["1", "2", "first"]), ("j", 1, "PRGT", ["1", "2", "all"])], [("j", 2, "PRGV", ["1", "2", "4"]), ("j", 3, "PRGV", ["x", "2", "4"]), ("j", 4, "TINFO", ["0", "1", "2"])],
        [("j", 5, "PRGC", ["1", "2"]), ("j", 6, "PRGV", ["1", "2", "0"]), ("j", 7, "MSG", ["1", "2", "3", "said"])],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = run_stream(spark, progress.progress_stream(progress.progress_records(source)), "label_rows", tmp_path / "cp").orderBy("seq").collect()
    assert [tuple(r)[1:] for r in rows] == [(2, "first", "all", 0.25, 0.5, None), (6, "", "all", 0.0, 0.0, None), (7, "", "all", None, None, "said")]


def test_job_states_of_a_stream(spark, tmp_path):
    schema = "job string, seq long, kind string, item long, items long"
    spark.createDataFrame([("a", 0, "started", 0, 2), ("a", 1, "failed", 0, 2), ("a", 2, "started", 1, 2), ("b", 0, "event", None, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    states = progress.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = states.writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == [("a", 0, 1, 1, 0.5, "1 / 2", "running"), ("b", 0, 0, None, 0.0, None, "queued")]


def tree(root, discs_):
    for path, body in discs_.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(body))


def test_catalogue_tree(spark, tmp_path):
    tree(tmp_path, {
        "data/movie/Film (1982)/r1/disc01.json": {"Index": 1, "ContentHash": "ab"}, "data/movie/Film (1982)/metadata.json": {"Title": "Film", "Year": 1982, "ExternalIds": {"Tmdb": "9728", "Imdb": "tt1"}},
        "data/movie/Film (1982)/r1/release.json": {"Slug": "first"}, "data/series/Show/r/disc02.json": {"Index": 2, "ContentHash": "AB"}, "data/other/x/r/disc03.json": {"ContentHash": "cd"}, "disc04.json": {"ContentHash": "ef"},
    })
    rows = {r["content_hash"]: r for r in files.read_catalogue(spark, str(tmp_path)).collect()}
    assert set(rows) == {"ab", "AB"}
    assert (rows["ab"]["item_title"], rows["ab"]["year"], rows["ab"]["tmdb_id"], rows["ab"]["release_slug"], rows["ab"]["imdb_id"]) == ("Film", 1982, 9728, "first", "tt1")
    assert (rows["AB"]["item_title"], rows["AB"]["release_slug"], rows["AB"]["media_item_id"]) == ("Show", "r", "Show")
    assert files.catalogue_disc_count(spark, str(tmp_path)).first()["discs"] == 3
    none = str(tmp_path / "none")
    assert files.read_catalogue(spark, none).count() == 0 and files.catalogue_disc_count(spark, none).first()["discs"] == 0


def test_hash_index(spark, tmp_path):
    root, index = tmp_path / "mirror", str(tmp_path / "index")
    tree(root, {"data/movie/A/r/disc01.json": {"ContentHash": "ab"}, "data/sets/B/r/disc01.json": {"ContentHash": "AB"}, "data/movie/C/r/disc01.json": {"ContentHash": " "}})
    read = lambda signature: sorted(tuple(r) for r in files.hash_index_of(spark, str(root), index, signature).collect())
    two = [("AB", "data/movie/A/r/disc01.json"), ("AB", "data/sets/B/r/disc01.json")]
    assert read("one") == two
    tree(root, {"data/movie/D/r/disc01.json": {"ContentHash": "cd"}})
    assert read("one") == two  # the written index is valid as long as the signature is
    three = [*two, ("CD", "data/movie/D/r/disc01.json")]
    assert read("two") == three and read("two") == three
    (root / "data/movie/D/r/disc01.json").unlink()
    assert read(None) == two and read("two") == three  # without a signature nothing is written
    spark.createDataFrame([(files.INDEX_VERSION + 1, "two")], "version int, signature string").write.mode("overwrite").parquet(f"{index}/state")
    assert read("two") == two  # another version
    scans = spark.createDataFrame([(1, "ab"), (2, "x")], "scan int, h string")
    found = discs.lookup(scans, files.hash_index_of(spark, str(root), index, "two"), "h")
    assert sorted((r["scan"], r["path"]) for r in found.collect()) == [(1, two[0][1]), (1, two[1][1]), (2, None)]
    assert files.hash_index_of(spark, str(tmp_path / "none"), str(tmp_path / "i2"), "s").count() == 0


def test_signature_of_a_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    assert files.head_signature(spark, str(tmp_path)) is None
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "one")
    head = git("rev-parse", "HEAD")
    assert files.head_signature(spark, str(tmp_path)) == head
    git("pack-refs", "--all")
    assert files.head_signature(spark, str(tmp_path)) == head
    git("checkout", "-q", "--detach")
    assert files.head_signature(spark, str(tmp_path)) == head


def test_side_files(spark, tmp_path):
    xml = lambda title: f'<disclib xmlns:di="urn:x"><di:discinfo><di:title><di:name>{title}</di:name></di:title></di:discinfo></disclib>'
    for disc, names in {"a": ["bdmt_deu.xml", "bdmt_eng.xml"], "b": ["bdmt_fra.XML", "bdmt_deu.xml"], "c": ["other.xml"]}.items():
        folder = tmp_path / disc / "BDMV/META/DL"
        folder.mkdir(parents=True)
        for name in names:
            (folder / name).write_text(xml(f"{disc} {name[5:8]}"))
    got = {r["disc"].rpartition("/")[2]: r["disc_title"] for r in files.read_side_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "a eng", "b": "b deu"}
    assert files.parse_side_file("<a><b></a>")[4] and files.parse_side_file(None)[4]


def test_staged_tree(spark, tmp_path):
    rows = [
        ("Movie", "A/B", 1999, "r1", 0, "{m}", "{r}", "{d1}", bytearray(b"\xff\xd8"), None, None), ("Movie", "A/B", 1999, "r1", 2, "{m}", "{r}", "{d2}", None, "{t}", None), ("Series", "S", None, "x\\y", 1, "{m}", "{r}", "{d}", None, None, bytearray(b"jpg")),
    ]
    schema = "kind string, title string, year int, release string, index int, metadata string, release_record string, disc string, cover binary, answer string, front binary"
    records = spark.createDataFrame(rows, schema)
    for _ in range(2):  # writing again changes nothing
        sinks.write_tree(sinks.staged_files(records), f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    film, show = "data/movie/A_B (1999)", "data/series/S"
    assert found == {
        f"{film}/metadata.json": b"{m}", f"{film}/cover.jpg": b"\xff\xd8", f"{film}/tmdb.json": b"{t}", f"{film}/r1/release.json": b"{r}", f"{film}/r1/disc01.json": b"{d1}", f"{film}/r1/disc02.json": b"{d2}",
        f"{show}/metadata.json": b"{m}", f"{show}/x_y/release.json": b"{r}", f"{show}/x_y/front.jpg": b"jpg", f"{show}/x_y/disc01.json": b"{d}",
    }


def test_disc_files(spark):
    listing = [
        ("bd", "BDMV/STREAM/00002.M2TS", 2), ("bd", "/BDMV/STREAM/00001.m2ts", 1), ("bd", "BDMV/STREAM/SSIF/00001.m2ts", 9), ("bd", "VIDEO_TS/A.VOB", 9), ("bd", "BDMV/STREAM/x.txt", 9), ("dvd", "VIDEO_TS", None), ("dvd", "VIDEO_TS/b", 2), ("dvd", "VIDEO_TS/B", 1),
        ("dvd", "VIDEO_TS/sub/c", 9), ("bare", "BDMV/STREAM", None), ("bare", "VIDEO_TS/x", 1), ("none", "readme", 1),
    ]
    got = sorted(map(tuple, files.disc_files(spark.createDataFrame(listing, "d string, p string, s bigint"), "d", "p", "s").collect()), key=str)
    assert got == sorted([("bd", 0, "00001.m2ts", 1, None), ("bd", 1, "00002.M2TS", 2, None), ("dvd", 0, "B", 1, None), ("dvd", 1, "b", 2, None), ("bare", None, None, None, None), ("none", None, None, None, "no BDMV/STREAM/ or VIDEO_TS/ directory found")], key=str)


def test_tolerance_bands(spark):
    features = spark.createDataFrame([(1, 1, 100.0), (2, 1, 8.0), (3, 2, 50.0)], "f int, g int, want double")
    titles = spark.createDataFrame([(1, 10, 104.9), (1, 11, 95.0), (1, 9, 105.1), (1, 12, 8.0), (1, 13, -1.0), (2, 1, 61.0)], "g int, o int, have double")
    got = discs.tolerance_match(features, titles, "g", "want", "have", "o", ["f"], F.lit(5.0), 3.0)
    assert {r["f"]: (r["o"], r["have"]) for r in got.collect()} == {1: (10, 104.9), 2: (12, 8.0)}


def test_newest_output(spark):
    files_ = spark.createDataFrame([("a", "x.mkv", 5), ("a", "y.mkv", 7), ("a", "b.mkv", 7), ("a", "z.txt", 9), ("b", "want.mkv", 1), ("b", "new.mkv", 9), ("c", "z.txt", 1)], "d string, p string, m int")
    wants = spark.createDataFrame([(d, "want.mkv") for d in "abcd"], "d string, w string")
    got = {r["d"]: r["output"] for r in identify.resolve_output(wants, files_.withColumn("m", F.timestamp_seconds("m")), "d", "w", "p", "m").collect()}
    assert got == {"a": "b.mkv", "b": "want.mkv", "c": None, "d": None}
