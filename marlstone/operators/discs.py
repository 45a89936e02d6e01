"""Fingerprints, relations, classification and features of discs (survey A2-A6, J1, J3, J6, J7, A9-A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.media import le_u64_hex
from ..functions.text import ascii_lower


def content_hash(files: DataFrame, keys: list[str], order: Column, size: str) -> DataFrame:
    """A2: MD5, in upper-case hex, over the files' sizes as little-endian 64-bit numbers in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(size).alias("s"))))
    return files.groupBy(*keys).agg(F.upper(F.md5(F.unhex(F.array_join(F.transform(pairs, lambda x: le_u64_hex(x["s"])), "")))).alias("content_hash"))


def hash_index(discs: DataFrame, hash_col: str, path: str) -> DataFrame:
    """A row for each upper-case hash and path; blank hashes have none."""
    return discs.where(F.trim(hash_col) != "").select(F.upper(hash_col).alias("hash_key"), F.col(path).alias("path"))


def lookup(scans: DataFrame, index: DataFrame, hash_col: str) -> DataFrame:
    """Every scan with each path of its hash, or null if there is none. Spark broadcasts the index if its size allows."""
    return scans.withColumn("hash_key", F.upper(hash_col)).join(index, "hash_key", "left")


def hash_matches(index: DataFrame) -> DataFrame:
    """How many paths a hash has and the first of them: what a lookup needs to know without having them all."""
    return index.groupBy("hash_key").agg(F.count("*").alias("discs"), F.min("path").alias("first_path"))


def title_relations(titles: DataFrame, group: str, title: str, segments: str) -> DataFrame:
    """Kind (composite, constituent, atomic), constituents and containers of each title.

    A title contains another of its disc if the other's segments are a proper, non-empty part of its own. Segments are
    exploded and joined by disc and segment, so only titles that share one meet; a title is contained if as many segments
    are shared as it has.
    """
    base = titles.select(F.col(group).alias("g"), F.col(title).alias("t"), F.array_distinct(segments).alias("s")).withColumn("n", F.size("s"))
    parts = base.withColumn("x", F.explode("s")).select("g", "t", "n", "x")
    inner, outer = parts.alias("i"), parts.alias("o")
    both = inner.join(outer, (F.col("i.g") == F.col("o.g")) & (F.col("i.x") == F.col("o.x")) & (F.col("i.n") < F.col("o.n")))
    pairs = both.groupBy(F.col("i.g").alias("g"), F.col("i.t").alias("small"), F.col("o.t").alias("large"), F.col("i.n").alias("n")).agg(F.count("*").alias("c")).where("c = n")
    contains = pairs.groupBy("g", F.col("large").alias("t")).agg(F.array_sort(F.collect_list("small")).alias("constituents"))
    inside = pairs.groupBy("g", F.col("small").alias("t")).agg(F.array_sort(F.collect_list("large")).alias("containers"))
    out = base.select("g", "t").join(contains, ["g", "t"], "left").join(inside, ["g", "t"], "left")
    kind = F.when(F.col("constituents").isNotNull(), "composite").when(F.col("containers").isNotNull(), "constituent").otherwise("atomic")
    return out.select(F.col("g").alias(group), F.col("t").alias(title), kind.alias("kind"), "constituents", F.when(F.col("constituents").isNull(), F.col("containers")).alias("containers"))


def content_kind(titles: DataFrame, keys: list[str], duration: Column, least: int = 600, most: int = 5400) -> DataFrame:
    """A3: Series if at least three long titles are all about as long and none is very long, else Movie."""
    long = F.when(duration >= least, duration.cast("double"))
    n, low, high = F.count(long), F.min(long), F.max(long)
    return titles.groupBy(*keys).agg(F.when((n >= 3) & (high / low <= 1.2) & (high <= most), "Series").otherwise("Movie").alias("content_kind"))


def main_title(titles: DataFrame, keys: list[str], index: str, duration: Column, order: Column, identities: DataFrame | None = None, source_file: str = "source_file") -> DataFrame:
    """A4: the main title of the first identity, else the title with the longest duration; of equals the last.

    identities has keys, identity and position (the orders of a disc's identities and of an identity's titles), index,
    role and source_file. The first title with role Main of a disc's first identity is meant, without regard to later
    identities. Its source_file names the disc's first title, by `order`, with that source_file, in any case of ASCII
    letters; where it is null or empty or no title has it, the identity's own index counts.
    """
    longest = titles.groupBy(*keys).agg(F.max_by(index, F.struct(F.coalesce(duration, F.lit(0)).alias("d"), order.alias("o"))).alias("main_title"))
    if identities is None:
        return longest
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("identity"))
    mains = identities.withColumn("_rank", rank).where("_rank = 1 and role = 'Main'")
    mains = mains.groupBy(*keys).agg(F.min_by(F.struct(F.col("index").alias("own"), F.col("source_file").alias("file")), "position").alias("_m"))
    mains = mains.select(*keys, F.col("_m.own").alias("_own"), ascii_lower(F.col("_m.file")).alias("_file"), F.lit(True).alias("_has"))
    files = titles.groupBy(*keys, ascii_lower(F.col(source_file)).alias("_file")).agg(F.min_by(index, order).alias("_mapped")).where("_file <> ''")
    named = mains.join(files, [*keys, "_file"], "left").select(*keys, F.coalesce("_mapped", "_own").alias("_named"), "_has")
    return longest.join(named, keys, "full").select(*keys, F.when(F.col("_has"), F.col("_named")).otherwise(F.col("main_title")).alias("main_title"))


def feature_playlists(items: DataFrame, disc: str, playlist: str, length: Column, found: Column) -> DataFrame:
    """Per disc the longest playlist all of whose clips are there; of equals the first name."""
    lists = items.groupBy(disc, playlist).agg(F.sum(length).alias("total"), F.bool_and(F.coalesce(found, F.lit(False))).alias("whole")).where("whole")
    first = F.row_number().over(Window.partitionBy(disc).orderBy(F.desc("total"), playlist))
    return lists.withColumn("_rank", first).where("_rank = 1").drop("_rank", "whole")


def tolerance_match(features: DataFrame, titles: DataFrame, on: str, want: str, have: str, order: str, out: list[str], tolerance: Column, band: float) -> DataFrame:
    """The first title of the group, in queue order, whose length differs by no more than the tolerance; `out` are the
    keys of a feature, and the other columns of titles come along.

    Lengths are dealt to bands of width `band`: a title lies in one, a feature asks in each that its tolerance reaches, so
    a feature meets only titles of about its length, by an equi-join. The first is found with map-side combine. Choose
    band of the size of the tolerance: a feature asks 2 * tolerance / band + 1 times.
    """
    at = lambda c: F.floor(c / F.lit(band)).cast("bigint")
    asked = features.select("*", tolerance.alias("_tolerance")).withColumn("_band", F.explode(F.sequence(at(F.col(want) - F.col("_tolerance")), at(F.col(want) + F.col("_tolerance")))))
    both = asked.join(titles.withColumn("_band", at(F.col(have))), [on, "_band"]).where(F.abs(F.col(want) - F.col(have)) <= F.col("_tolerance"))
    rest = [c for c in both.columns if c not in (*out, "_band", "_tolerance")]
    best = both.groupBy(*out).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return best.select(*out, *(F.col("_first")[c].alias(c) for c in rest))
