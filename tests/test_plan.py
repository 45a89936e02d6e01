"""Edits, prefilled fields, selections and paths on small inputs with nulls, blanks and ties."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import naming
from marlstone.operators import plan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(x):
    return F.lit(x).cast("string")


def n(x):
    return F.lit(x).cast("int")


def test_with_edits(spark):
    titles = spark.createDataFrame([("d", 0), ("d", 1), ("e", 0)], "disc string, index int")
    edits = spark.createDataFrame([("d", 0, " ", "", "Main", "full_sbs"), ("d", 1, " A ", "Pilot", None, "half_tab"), ("x", 0, "B", None, None, None)], "disc string, index int, display_title string, episode_title string, role string, format string")
    got = plan.with_edits(titles, edits, ["disc", "index"], F.col("index") == 0).orderBy("disc", "index").collect()
    assert [tuple(r) for r in got] == [("d", 0, None, None, "Main", "full_sbs"), ("d", 1, " A ", "Pilot", None, None), ("e", 0, None, None, None, None)]


@pytest.mark.parametrize(("typed", "item", "want"), [(" T ", "I", " T "), (" ", "I", "I"), (None, " ", "D"), ("", None, "D")])
def test_rip_title(spark, typed, item, want):
    assert one(spark, plan.rip_title(s(typed), s(item), F.lit("D"))) == want


def test_prefills(spark):
    assert tuple(one(spark, plan.prefilled_title(F.lit("Fawlty"), F.lit("LOST_S2")))) == ("Fawlty", None)
    assert tuple(one(spark, plan.prefilled_title(s(None), F.lit("LOST_S2D1")))) == ("Lost", 2)
    assert tuple(one(spark, plan.prefilled_title(s(None), s(None)))) == (None, None)
    assert [one(spark, plan.overwritten(s(a), s(b))) for a, b in (("a", "b"), ("a", None), (None, None))] == ["b", "a", None]
    assert [one(spark, plan.filled(s(a), s(b))) for a, b in (("a", "b"), (" ", "b"), (None, "b"), ("", None))] == ["a", "b", "b", ""]


def test_named_episodes(spark):
    rows = spark.createDataFrame([("s", 2, "b"), ("s", 1, None), ("s", 3, "c"), ("s", 2, "a"), ("t", 9, "z")], "show string, number int, title string")
    got = plan.named_episodes(rows, ["show"], "number", "title").orderBy("show", "episode_rank").collect()
    assert [tuple(r) for r in got] == [("s", 2, "a", 1), ("s", 2, "b", 2), ("s", 3, "c", 3), ("t", 9, "z", 1)]


def test_quick_selected(spark):
    rows = spark.createDataFrame([(m, r) for m in ("all", "main", "none", None) for r in (1, 2)], "mode string, display_rank int")
    got = plan.quick_selected(rows.withColumn("disc", F.coalesce("mode", F.lit("-"))), ["disc"], "display_rank", F.col("mode"))
    assert {(r.mode, r.display_rank) for r in got.collect() if r.selected} == {("all", 1), ("all", 2), ("main", 1)}


def test_is_encrypted(spark):
    rows = [(1, "/AACS/", True), (2, "bdmv/aacs", True), (3, "AACS", False), (4, "X/AACS", True), (5, None, None)]
    got = plan.is_encrypted(spark.createDataFrame(rows, "disc int, path string, is_dir boolean"), ["disc"], "path", "is_dir").collect()
    assert {r.disc for r in got if r.encrypted} == {1, 2} and len(got) == 5


def test_default_naming(spark):
    movie, show, plain = (one(spark, plan.default_naming(F.lit(k), F.lit(v))) for k, v in (("Movie", "ALIEN: S2"), ("Series", "THE_WIRE_SEASON_3"), ("Series", "THE_WIRE")))
    assert (movie.title, movie.season, movie.episode_start, movie.codec, movie.backend, movie.year) == ("ALIEN S2", 1, 1, "h265", "auto", None)
    assert (show.title, show.season, plain.title, plain.season) == ("The Wire", 3, "The Wire", 1)


@pytest.mark.parametrize(
    ("scheme", "kind", "role", "stereo", "want"),
    [
        ("jellyfin", "Movie", "Main", False, "/v/Movies/A B (2009) [imdbid-tt1]/A B (2009) [imdbid-tt1].mkv"),
        ("emby", "Movie", "Main", True, "/v/Movies/A B (2009) [imdbid-tt1]/A B (2009) [imdbid-tt1] - 3D.mkv"),
        ("plex", "Movie", "DeletedScene", False, "/v/Movies/A B (2009) {imdb-tt1}/Deleted Scenes/X.mkv"),
        ("emby", "Movie", "Other", True, "/v/Movies/A B (2009) [imdbid-tt1]/extras/X.mkv"),
        ("kodi", "Movie", "Trailer", False, "/v/Movies/A B (2009) {tmdb=7}/A B (2009) {tmdb=7}-trailer.mkv"),
        ("kodi", "Movie", "Short", None, "/v/Movies/A B (2009) {tmdb=7}/extras/X.mkv"),
        ("kodi", "Series", "Main", True, "/v/Shows/A B (2009)/Season 02/A B S02E01.mkv"),
        ("plex", "Series", "Trailer", False, "/v/Shows/A B (2009) {imdb-tt1}/Season 02/A B (2009) - s02e01.mkv"),
    ],
)
def test_library_path(spark, scheme, kind, role, stereo, want):
    flag = F.lit(stereo).cast("boolean")
    path = plan.library_path(scheme, F.lit("/v/"), F.lit(kind), F.lit(role), F.lit("A: B"), n(2009), F.lit("tt1"), n(7), n(2), n(None), F.lit(" "), flag, F.lit("X"))
    assert one(spark, path) == want


@pytest.mark.parametrize(("scheme", "mark"), [("jellyfin", "T S01E02-E03 - N"), ("plex", "T - s01e02-e03 - N"), ("kodi", "T S01E02-E03 N")])
def test_episode_range(spark, scheme, mark):
    none = s(None)
    path = lambda name, last: one(spark, naming.episode_path(scheme, F.lit("/r"), F.lit("T"), n(None), n(1), n(2), s(name), none, none, none, n(last)))
    assert path("N", 3) == f"/r/T/Season 01/{mark}.mkv"
    assert path("N", None) == f"/r/T/Season 01/{mark.replace('-E03', '').replace('-e03', '')}.mkv"
    assert path("?.", 3) == f"/r/T/Season 01/{mark.removesuffix(' N').removesuffix(' -')}.mkv"
