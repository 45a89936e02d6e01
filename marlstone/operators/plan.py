"""Planning of rips: user edits, prefilled fields, selections and paths (survey J8, C8, C12, N12, N13, W6, W9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming
from ..functions.text import nonempty, sanitise, series_season, series_title
from .identify import extras_folder


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def with_edits(titles: DataFrame, edits: DataFrame, keys: list[str], selected: Column) -> DataFrame:
    """Each title with the user's edits, if any: display_title and episode_title unless blank, role, and format of
    selected titles only. Edits of unknown titles are dropped; keys are unique in edits. Titles keep their count."""
    own = edits.select(*keys, *(F.when(~_blank(F.col(c)), F.col(c)).alias(c) for c in ("display_title", "episode_title")), "role", F.col("format").alias("_format"))
    return titles.join(own, keys, "left").withColumn("format", F.when(selected, F.col("_format"))).drop("_format")


def prefilled_title(authored: Column, label: Column) -> Column:
    """struct<title, season>: the title that the publisher wrote, else the label's, and only then the label's season."""
    return F.struct(F.coalesce(authored, series_title(label)).alias("title"), F.when(authored.isNull(), series_season(label)).alias("season"))


def rip_title(typed: Column, item: Column, disc: Column) -> Column:
    """What the user typed, else the matched item's title, each unless blank and untrimmed, else the disc's name."""
    return F.when(~_blank(typed), typed).when(~_blank(item), item).otherwise(disc)


def overwritten(shown: Column, found: Column) -> Column:
    """What a film lookup finds replaces what a field shows."""
    return F.coalesce(found, shown)


def filled(shown: Column, found: Column) -> Column:
    """What a product code or a disc's region tells fills blank fields only."""
    return F.when(_blank(shown), F.coalesce(found, shown)).otherwise(shown)


def named_episodes(episodes: DataFrame, group: list[str], number: str, title: str) -> DataFrame:
    """Episodes that have a title, with their place by number in `episode_rank` from 1; of equal numbers the smaller
    title comes first."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(number, title))
    return episodes.where(F.col(title).isNotNull()).withColumn("episode_rank", rank)


def quick_selected(titles: DataFrame, group: list[str], rank: str, mode: Column) -> DataFrame:
    """`selected` by mode: all, none, or main, which takes the group's first row. rank comes from display_rank."""
    first = F.col(rank) == F.min(rank).over(Window.partitionBy(*group))
    return titles.withColumn("selected", F.when(mode == "all", True).when(mode == "main", first).otherwise(False))


def is_encrypted(listing: DataFrame, disc: list[str], path: str, is_dir: str) -> DataFrame:
    """`encrypted` per disc: whether its listing, with paths from the disc's root, holds a folder AACS or BDMV/AACS.

    Case is ignored, as in lookups in an image.
    """
    mark = F.lower(F.regexp_replace(path, "^/+|/+$", "")).isin("aacs", "bdmv/aacs") & F.col(is_dir)
    return listing.groupBy(*disc).agg(F.coalesce(F.bool_or(mark), F.lit(False)).alias("encrypted"))


def default_naming(kind: Column, label: Column) -> Column:
    """Naming of an unidentified disc: sanitised label, or a label's series and season; the rest has defaults."""
    series = kind == "Series"
    none = F.lit(None)
    return F.struct(
        sanitise(F.when(series, series_title(label)).otherwise(label)).alias("title"), none.cast("int").alias("year"), none.cast("bigint").alias("tmdb_id"), none.cast("string").alias("imdb_id"),
        F.coalesce(F.when(series, series_season(label)), F.lit(1)).alias("season"), F.lit(1).alias("episode_start"), F.lit("h265").alias("codec"), F.lit("auto").alias("backend"),
    )


def library_path(
    scheme: str, root: Column, kind: Column, role: Column, title: Column, year: Column, imdb: Column, tmdb: Column, season: Column, episode: Column, episode_title: Column, stereo: Column, display: Column
) -> Column:
    """Where a title goes: episodes of series under Shows, main titles and extras under Movies.

    A main title with a second view gets the 3D variant, as its flat version would take the same path. Episodes count as
    the first if they have no number. display is that of display_title.
    """
    base = F.regexp_replace(root, "/+$", "")
    shows, movies = F.concat(base, F.lit("/Shows")), F.concat(base, F.lit("/Movies"))
    shown = naming.episode_path(scheme, shows, title, year, season, F.coalesce(episode, F.lit(1)), nonempty(episode_title), imdb, tmdb, F.lit(None).cast("string"))
    movie = naming.movie_path(scheme, movies, title, year, imdb, tmdb, F.when(stereo, naming.variant_name(F.lit("Stereo3d"))))
    folder = naming.movie_folder(scheme, title, year, imdb, tmdb)
    extra = naming.extras_path(scheme, movies, folder, role, extras_folder(role, scheme), display)
    return F.when(kind == "Series", shown).when(role == "Main", movie).otherwise(extra)
