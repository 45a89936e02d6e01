"""Library paths under the naming schemes (survey N1-N15), as Column builders. Names are sanitised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_3d_token, sanitise, sanitise_dir


def _tag(pairs: list[tuple[str, Column]], opening: str, closing: str) -> Column:
    """The first id that is not null, in brackets after a space; else nothing."""
    return F.coalesce(*(F.concat(F.lit(f" {opening}{name}"), v.cast("string"), F.lit(closing)) for name, v in pairs), F.lit(""))


def _dated(title: Column, year: Column) -> Column:
    return F.concat(sanitise(title), F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))


def _suffix(variant: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" - "), variant), F.lit(""))


def movie_folder(scheme: str, title: Column, year: Column, imdb: Column, tmdb: Column) -> Column:
    """The folder of a movie: its dated title with an id."""
    if scheme in ("jellyfin", "emby"):
        tag = _tag([("imdbid-", imdb), ("tmdbid-", tmdb)], "[", "]")
    elif scheme == "plex":
        tag = _tag([("imdb-", imdb), ("tmdb-", tmdb)], "{", "}")
    else:
        tag = _tag([("tmdb=", tmdb), ("imdb=", imdb)], "{", "}")
    return F.concat(_dated(title, year), tag)


def movie_path(scheme: str, root: Column, title: Column, year: Column, imdb: Column, tmdb: Column, variant: Column) -> Column:
    """N1, N4, N7."""
    folder = movie_folder(scheme, title, year, imdb, tmdb)
    return F.concat(root, F.lit("/"), folder, F.lit("/"), folder, _suffix(variant), F.lit(".mkv"))


def episode_path(
    scheme: str, root: Column, title: Column, year: Column, season: Column, episode: Column, name: Column, imdb: Column, tmdb: Column, tvdb: Column, last: Column | None = None
) -> Column:
    """Last is the last episode of a file that holds several; a name without usable characters is left out."""
    base = _dated(title, year)
    small = scheme == "plex"
    mark = F.format_string("s%02de%02d" if small else "S%02dE%02d", season, episode)
    if last is not None:
        mark = F.concat(mark, F.coalesce(F.when(last.isNotNull(), F.format_string("-e%02d" if small else "-E%02d", last)), F.lit("")))
    own = F.nullif(sanitise(name), F.lit(""))
    if scheme in ("jellyfin", "emby"):
        folder = F.concat(base, _tag([("imdbid-", imdb), ("tmdbid-", tmdb), ("tvdbid-", tvdb)], "[", "]"))
        file = F.concat(base, F.lit(" "), mark, F.coalesce(F.concat(F.lit(" - "), own), F.lit("")))
    elif small:
        folder = F.concat(base, _tag([("tvdb-", tvdb), ("imdb-", imdb), ("tmdb-", tmdb)], "{", "}"))
        file = F.concat(base, F.lit(" - "), mark, F.coalesce(F.concat(F.lit(" - "), own), F.lit("")))
    else:
        folder = base
        file = F.concat(sanitise(title), F.lit(" "), mark, F.coalesce(F.concat(F.lit(" "), own), F.lit("")))
    return F.concat(root, F.lit("/"), folder, F.format_string("/Season %02d/", season), file, F.lit(".mkv"))


def extras_path(scheme: str, root: Column, folder: Column, role: Column, role_folder: Column, name: Column) -> Column:
    """An extra in its role's folder under its movie's; one scheme keeps trailers beside the movie."""
    inside = F.when(role_folder == "", "").otherwise(F.concat(role_folder, F.lit("/")))
    path = F.concat(root, F.lit("/"), folder, F.lit("/"))
    named = F.concat(path, inside, sanitise(name), F.lit(".mkv"))
    if scheme != "kodi":
        return named
    return F.when(role == "Trailer", F.concat(path, folder, F.lit("-trailer.mkv"))).when(role == "Main", F.concat(path, folder, F.lit(".mkv"))).otherwise(named)


#: Names of movie variants.
VARIANTS = {"Uhd4k": "4K", "Stereo3d": "3D", "Extended": "Extended", "Theatrical": "Theatrical", "Directors": "Director's Cut"}


def variant_name(kind: Column) -> Column:
    """What movie_path takes as variant."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in VARIANTS.items() for x in kv)), kind)


def converted_path(stem: Column, slug: Column) -> Column:
    """Stem with slug, and with 3d unless the stem's name has that token."""
    token = F.when(has_3d_token(F.regexp_extract(stem, "([^/]*)$", 1)), ".").otherwise(".3d.")
    return F.concat(stem, token, slug, F.lit(".mkv"))


def staging_path(kind: Column, title: Column, year: Column, release: Column, index: Column) -> Column:
    """The disc's number is 1 at least; of the title only slashes are replaced."""
    folder = F.when(kind == "Series", "series").otherwise("movie")
    named = F.concat(title, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))
    return F.concat(F.lit("data/"), folder, F.lit("/"), sanitise_dir(named), F.lit("/"), sanitise_dir(release), F.format_string("/disc%02d.json", F.greatest(index, F.lit(1))))
