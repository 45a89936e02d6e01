"""Matching and precedence (survey J2, J4, J8-J13, C1-C13, W1-W9, P9, P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import nonempty

#: Role names of the catalogue by role; anything else is Other.
ROLES = {
    "Main": ["MainMovie", "MainFeature", "Main", "Movie"], "Trailer": ["Trailer"], "BehindTheScenes": ["BehindTheScenes", "BehindThe Scenes"], "DeletedScene": ["DeletedScene", "DeletedScenes"], "Featurette": ["Featurette"], "Interview": ["Interview"],
    "Scene": ["Scene"], "Short": ["Short"],
}
#: Folders of extras by scheme and role; "" is the movie's own folder.
EXTRAS = {
    "jellyfin": {"Trailer": "trailers", "BehindTheScenes": "behindthescenes", "DeletedScene": "deleted", "Featurette": "featurettes", "Interview": "interviews", "Scene": "scenes", "Short": "shorts", "Other": "extras", "Main": ""},
    "plex": {"Trailer": "Trailers", "BehindTheScenes": "Behind The Scenes", "DeletedScene": "Deleted Scenes", "Featurette": "Featurettes", "Interview": "Interviews", "Scene": "Scenes", "Short": "Shorts", "Other": "Other", "Main": ""},
    "kodi": {"Trailer": "", "Main": ""},
}


def parse_role(c: Column) -> Column:
    """P9."""
    out = F.lit("Other")
    for role, names in ROLES.items():
        out = F.when(c.isin(names), role).otherwise(out)
    return out


def role_name(c: Column) -> Column:
    """P10: the name under which a role is written."""
    return F.when(c == "Main", "MainMovie").otherwise(c)


def extras_folder(role: Column, scheme: str = "jellyfin") -> Column:
    """The folder of a role's extras; roles that a scheme does not name go to extras."""
    pairs = [F.lit(x) for kv in EXTRAS["jellyfin" if scheme == "emby" else scheme].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), role), F.lit("extras"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def two_tier_match(left: DataFrame, right: DataFrame, first: list[str], second: list[str], order: str, value: str) -> DataFrame:
    """Value of the first match by the keys of the first tier, else by those of the second.

    Two equi-joins with a side of one row a key each, instead of one join by either condition, which would compare all
    pairs.
    """
    one = first_by(right, first, [order]).select(*first, F.col(value).alias("_one"))
    two = first_by(right, second, [order]).select(*second, F.col(value).alias("_two"))
    return left.join(one, first, "left").join(two, second, "left").withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two")


def with_fallback(wanted: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """A local hit counts; a miss is looked up in the other source; status is local, remote or miss."""
    hits = wanted.join(local, key).select(key, F.lit("local").alias("status"), value)
    misses = wanted.join(local, key, "left_anti").join(remote, key, "left")
    return hits.unionByName(misses.select(key, F.when(F.col(value).isNotNull(), "remote").otherwise("miss").alias("status"), value))


def rip_role(override: Column, identity: Column, is_main: Column) -> Column:
    """C1."""
    return F.coalesce(override, identity, F.when(is_main, "Main").otherwise("Other"))


def rip_display(override: Column, identity: Column, name: Column) -> Column:
    """An override that is not blank, as it was typed, else the identity's or the scan's name unless empty, else null."""
    typed = F.when(F.trim(override) != "", override)
    return F.coalesce(typed, F.nullif(identity, F.lit("")), F.nullif(name, F.lit("")))


def rip_label(index: Column, display: Column) -> Column:
    """Title n, with what rip_display found."""
    return F.concat(F.lit("Title "), index.cast("string"), F.coalesce(F.concat(F.lit(" — "), display), F.lit("")))


def display_title(override: Column, identity: Column, name: Column, index: Column) -> Column:
    """The override trimmed; blank values give way."""
    return F.coalesce(nonempty(override), F.nullif(identity, F.lit("")), F.nullif(name, F.lit("")), F.concat(F.lit("Title "), index.cast("string")))


def submission_title(override: Column, identity: Column, name: Column, index: Column) -> Column:
    """C4: an override counts even if it is empty."""
    return F.coalesce(override, F.nullif(identity, F.lit("")), F.nullif(name, F.lit("")), F.concat(F.lit("Title "), index.cast("string")))


def image_url(item: Column, release: Column) -> Column:
    """Chosen first, then tested for blank."""
    return nonempty(F.coalesce(item, release))


def output_file(named: Column, index: Column) -> Column:
    """C9."""
    return F.coalesce(named, F.format_string("title_t%02d.mkv", index))


def number_episodes(df: DataFrame, group: list[str], order: list, start: int | Column) -> DataFrame:
    """Start, start + 1, ... in order; rows that do not exist take no number."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("episode", ((F.lit(start) if isinstance(start, int) else start) - 1 + n).cast("int"))


def selected(titles: DataFrame, requests: DataFrame, group: str, index: str) -> DataFrame:
    """Requested titles in the order of the request (sel_ord); unknown ones are dropped."""
    asked = requests.select(group, F.posexplode("selected").alias("sel_ord", index))
    return asked.join(titles, [group, index])


def forward_fill(df: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last value so far that is not null."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def display_rank(df: DataFrame, group: list[str], is_main: Column, order: list) -> DataFrame:
    """Main first, the rest in scan order."""
    return df.withColumn("display_rank", F.row_number().over(Window.partitionBy(*group).orderBy(is_main.desc(), *order)))


def numbered_name(names: Column, index: Column) -> Column:
    """A title's name in a map whose keys count from 1, else from 0."""
    return F.coalesce(F.try_element_at(names, index + 1), F.try_element_at(names, index))


def first_candidate(movies: Column, series: Column) -> Column:
    """struct<kind, hit> of the first movie, else of the first series; null if there is none."""
    movie, show = F.get(movies, F.lit(0)), F.get(series, F.lit(0))
    return F.when(movie.isNotNull(), F.struct(F.lit("Movie").alias("kind"), movie.alias("hit"))).when(show.isNotNull(), F.struct(F.lit("Series").alias("kind"), show.alias("hit")))


def zip_titles(rows: DataFrame, titles: DataFrame, group: list[str], row_order: list, title_order: list) -> DataFrame:
    """The n-th title beside the n-th row of a group, whatever its own number; rows beyond the titles get nulls."""
    at = lambda order: F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_at", at(row_order)).join(titles.withColumn("_at", at(title_order)), [*group, "_at"], "left").drop("_at")


def lookup_status(content_hash: Column, local_hits: Column, remote_error: Column) -> Column:
    """NotAttempted without a hash, Ok after a local hit or an answer, else Failed with the reason."""
    failed = F.concat(F.lit("Failed: "), remote_error)
    return F.when(content_hash.isNull(), "NotAttempted").when((F.coalesce(local_hits, F.lit(0)) > 0) | remote_error.isNull(), "Ok").otherwise(failed)


def resolve_output(expected: DataFrame, files: DataFrame, folder: str, want: str, path: str, mtime: str) -> DataFrame:
    """A10: the expected file of each folder, else its newest .mkv (of equally new ones the smallest path), else null.

    The listing meets the wishes by folder, and one aggregation with map-side combine, on that partitioning, decides; no
    folder's files are sorted or collected. mtime is a time, a date or a number of seconds.
    """
    seen = expected.select(folder, want).join(files.select(folder, F.col(path).alias("_path"), (-F.col(mtime).cast("timestamp").cast("double")).alias("_age")), folder, "left")
    mkv = F.col("_path").endswith(".mkv")
    newest = F.min_by(F.when(mkv, F.col("_path")), F.when(mkv, F.struct(F.coalesce("_age", F.lit(float("inf"))).alias("a"), F.col("_path").alias("p"))))
    return seen.groupBy(folder, want).agg(F.when(F.bool_or(F.col("_path") == F.col(want)), F.col(want)).otherwise(newest).alias("output"))


def success_summary(done: Column, failed: Column) -> Column:
    """struct<title, subtitle> of a finished queue."""
    n = lambda c: c.cast("string")
    total = n(done + failed)
    title = F.when(failed == 0, "All titles done").when(done == 0, "Rip failed").otherwise(F.concat(F.lit("Finished with "), n(failed), F.lit(" failure(s)")))
    some = F.concat(n(done), F.lit(" succeeded, "), n(failed), F.lit(" failed of "), total)
    none = F.concat(n(failed), F.lit(" of "), total, F.lit(" titles failed — see queue rows for details"))
    return F.struct(title.alias("title"), F.when(failed == 0, F.concat(n(done), F.lit(" succeeded"))).when(done == 0, none).otherwise(some).alias("subtitle"))


def byte_progress(chunks: DataFrame, job: list[str], order: list, size: str, total: Column, seconds: Column, step: int = 32 << 20) -> DataFrame:
    """A row whenever a job's bytes pass a multiple of step, with current_seconds: runtime scaled by bytes done."""
    done = F.sum(size).over(Window.partitionBy(*job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.withColumn("done", done).where((total > 0) & (F.floor(F.col("done") / step) > F.floor((F.col("done") - F.col(size)) / step)))
    return rows.withColumn("current_seconds", seconds * (F.col("done").cast("double") / total))


def relation_caption(kind: Column, constituents: Column, containers: Column) -> Column:
    """What a title's row says of its relation; null for atomic titles."""
    whole = F.concat(F.lit("contains "), F.size(constituents).cast("string"), F.lit(" other title(s)"))
    part = F.concat(F.lit("part of "), F.array_join(F.transform(containers, lambda i: F.concat(F.lit("#"), i.cast("string"))), ", "))
    return F.when(kind == "composite", whole).when(kind == "constituent", part)


def submission_role(override: Column, identity: Column) -> Column:
    """No title becomes main for being the longest."""
    return F.coalesce(override, identity, F.lit("Other"))


def submission_chapters(override: Column, identity: Column) -> Column:
    """The override as a whole unless it is empty, else the identity's chapters, by index and then by place."""
    chosen = F.when(F.size(override) > 0, override).otherwise(identity)
    keyed = F.transform(chosen, lambda c, i: F.struct(c["Index"].alias("k"), i.alias("o"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def row_title(index: Column, identity: Column, numbered: Column, name: Column) -> Column:
    """Title n, with the first of the identity's, the disc's own and the scan's name; an empty scan name is none."""
    shown = F.coalesce(identity, numbered, F.nullif(name, F.lit("")))
    return F.concat(F.lit("Title "), index.cast("string"), F.coalesce(F.concat(F.lit(" — "), shown), F.lit("")))
