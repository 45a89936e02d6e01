"""Catalogue documents (survey K1-K4, K6, W7, P11, F22)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.naming import staging_path
from ..functions.text import sanitise_dir, sort_title, title_slug


def kept_chapters(chapters: Column) -> Column:
    """Chapters with a title."""
    return F.filter(chapters, lambda c: F.coalesce(c["Title"], F.lit("")) != "")


def numbered_chapters(titles: Column) -> Column:
    """Chapters from 1 on."""
    return F.transform(titles, lambda t, i: F.struct((i + 1).alias("Index"), t.alias("Title")))


def disc_json(df: DataFrame, keys: list[str], fields: dict[str, Column], titles: Column, order: Column) -> DataFrame:
    """K1: a JSON document per disc; null fields are left out at every depth, titles come in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), titles.alias("t")))), lambda x: x["t"])
    grouped = df.groupBy(*keys).agg(items.alias("Titles"))
    return grouped.select(*keys, F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items())), "Titles")).alias("document"))


def write_documents(docs: DataFrame, path: str, kind: str) -> None:
    """Documents as a table partitioned by kind, a row each; staged_files and write_tree make a tree of files."""
    docs.write.mode("overwrite").partitionBy(kind).parquet(path)


def staged_files(records: DataFrame, *keep: str) -> DataFrame:
    """K4: path (from the tree's root) and content (binary) of the files of each record.

    records: kind, title, year, release, index, and as text or bytes metadata, release_record, disc, and cover, answer and
    front, which may be null. A title's folder holds metadata.json, cover.jpg and tmdb.json; its release's folder
    release.json, front.jpg and the disc's own file. Files without content are left out; columns named in `keep` come along.
    """
    disc = staging_path(F.col("kind"), F.col("title"), F.col("year"), sanitise_dir(F.col("release")), F.col("index"))
    release = F.regexp_replace(disc, "/[^/]*$", "")
    title = F.regexp_replace(release, "/[^/]*$", "")
    under = lambda folder, name: F.concat(folder, F.lit(f"/{name}"))
    files = [
        (under(title, "metadata.json"), "metadata"), (under(title, "cover.jpg"), "cover"), (under(title, "tmdb.json"), "answer"),
        (under(release, "release.json"), "release_record"), (under(release, "front.jpg"), "front"), (disc, "disc"),
    ]
    rows = records.select(*keep, F.explode(F.array(*(F.struct(p.alias("path"), F.col(c).cast("binary").alias("content")) for p, c in files))).alias("f"))
    return rows.select(*keep, "f.path", "f.content").where("content is not null")


def write_tree(files: DataFrame, root: str) -> None:
    """K4: write each file (path, content) under root, a folder or URI that all executors reach.

    Each file is written by one task, as a whole and under a name of its own until it is complete, so a task that runs
    again does no harm. Files of equal paths, as of a title with several discs, are taken to be equal: one is written.
    """

    def put(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for row in rows:
            path = f"{base.rstrip('/')}/{row['path']}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            system.move(part, path)

    files.dropDuplicates(["path"]).foreachPartition(put)


def _document(fields: dict[str, Column]) -> Column:
    """JSON with keys in order of name; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))))


def metadata_json(title: Column, year: Column, kind: Column, tmdb: Column, imdb: Column, tvdb: Column, plot: Column, tagline: Column) -> Column:
    """K2: the record of a movie or series; ids are left out if there are none."""
    ids = F.struct(imdb.alias("Imdb"), tmdb.cast("string").alias("Tmdb"), tvdb.alias("Tvdb"))
    ids = F.when(F.coalesce(imdb, tmdb.cast("string"), tvdb).isNotNull(), ids)
    groups = F.array().cast("array<string>")
    return _document({"Title": title, "FullTitle": title, "SortTitle": sort_title(title), "Slug": title_slug(title, year), "Type": kind, "Groups": groups, "Year": year, "ExternalIds": ids, "Plot": plot, "Tagline": tagline})


def release_json(slug: Column, title: Column, year: Column, added: Column, contributors: Column, groups: Column, **more: Column) -> Column:
    """K3: the record of a release; added is the time of staging as text; contributors are left out if there are none,
    groups never. More fields (Locale, RegionCode, Upc, Asin, ImageUrl, ReleaseDate) go by their names."""
    sort = F.trim(F.concat(F.coalesce(year.cast("string"), F.lit("")), F.lit(" "), title))
    people = F.when(F.size(contributors) > 0, F.transform(contributors, lambda n: F.struct(n.alias("Name"), F.lit("github").alias("Source"))))
    return _document({"Slug": slug, "Title": title, "SortTitle": sort, "Year": year, "DateAdded": added, "Contributors": people, "Groups": F.coalesce(groups, F.array().cast("array<string>")), **more})


def report_line(index: Column, seconds: Column, size: Column, chapters: Column, source: Column, segments: Column) -> Column:
    """K6: a title's line in the identification report."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    s = lambda c: F.coalesce(c, F.lit("?"))
    return F.format_string("  t%-2d dur=%6ds size=%11d chap=%-2d src=%-14s segmap=%-14s", index, n(seconds), n(size), n(chapters), s(source), s(segments))


_ATOM, _SHOWN, _TEXT = (re.compile(f"(<{t}>)(.*?)(</{t}>)", re.S) for t in ("ChapterAtom", "ChapterDisplay", "ChapterString"))


def titled_chapters(xml: str | None, titles: list[str] | None) -> str | None:
    """chapters with these titles, one an atom; None if there are no atoms or their count is another."""
    if xml is None or titles is None or not len(titles) or xml.count("<ChapterAtom>") != len(titles) or len(_ATOM.findall(xml)) != len(titles):
        return None
    left = iter(titles)

    def titled(atom: re.Match) -> str:
        text = next(left).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        string, body = f"<ChapterString>{text}</ChapterString>", atom[2]
        shown = _SHOWN.search(body)
        if shown is None:
            body = f"{body.rstrip()}<ChapterDisplay>{string}<ChapterLanguage>eng</ChapterLanguage></ChapterDisplay>"
        else:
            inner = _TEXT.sub(lambda _: string, shown[2], count=1) if "<ChapterString>" in shown[2] else string + shown[2]
            body = body[: shown.start(2)] + inner + body[shown.end(2) :]
        return atom[1] + body + atom[3]

    return _ATOM.sub(titled, xml)


@F.pandas_udf(StringType())
def splice_chapters(xml: pd.Series, titles: pd.Series) -> pd.Series:
    """see titled_chapters."""
    return pd.Series([titled_chapters(x, t) for x, t in zip(xml, titles)], dtype=object)
