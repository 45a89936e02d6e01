"""Scalar text functions as Column builders (survey F1-F21); all stay in Catalyst but the two rounding formatters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """the key for comparisons that ignore case in ASCII only."""
    return F.translate(c, _UPPER, _LOWER)


def nonempty(c: Column) -> Column:
    """trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def parse_duration(c: Column) -> Column:
    """H:M:S, M:S or S in seconds; null for anything else."""
    ok = c.rlike(r"^\+?[0-9]{1,9}(:\+?[0-9]{1,9}){0,2}$")
    total = F.aggregate(F.split(F.when(ok, c), ":"), F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x.cast("bigint"))
    return F.when(ok, total)


def _hms(c: Column) -> tuple[Column, Column, Column]:
    s = c.cast("bigint")
    return F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60


def format_duration_full(c: Column) -> Column:
    """H:MM:SS."""
    return F.format_string("%d:%02d:%02d", *_hms(c))


def format_duration(c: Column) -> Column:
    """H:MM:SS, without the hour if it is 0."""
    h, m, s = _hms(c)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).when(c.isNotNull(), F.format_string("%d:%02d", m, s))


@F.pandas_udf(StringType())
def format_size(sizes: pd.Series) -> pd.Series:
    """decimal GB with one digit, else whole MB. Ties are rounded by the exact binary value, which Catalyst's formats don't do."""
    return sizes.map(lambda b: None if pd.isna(b) else f"{b / 1e9:.1f} GB" if b >= 1e9 else f"{b / 1e6:.0f} MB")


@F.pandas_udf(StringType())
def format_size_bytes(sizes: pd.Series) -> pd.Series:
    """like format_size, with bytes below 1 MB."""
    return sizes.map(lambda b: None if pd.isna(b) else f"{b / 1e9:.1f} GB" if b >= 1e9 else f"{b / 1e6:.0f} MB" if b >= 1e6 else f"{int(b)} B")


def parse_segment_map(c: Column) -> Column:
    """the distinct tokens between + and comma, trimmed; a slash belongs to a token."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[+,]"), lambda x: F.trim(x)), lambda x: x != ""))


def sanitise(c: Column) -> Column:
    """a name that file systems take."""
    spaced = F.regexp_replace(c, r"[<>:\"/\\|?*\x00]|\p{Cc}", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")), r"[. ]+$", "")


def title_slug(title: Column, year: Column | None = None) -> Column:
    """F8: lower case, letters and digits joined by single hyphens, and the year."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(title), r"[ -]", "-"), r"[^\p{IsAlphabetic}\p{N}-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "^-+|-+$", "")
    return slug if year is None else F.when(year.isNull(), slug).otherwise(F.concat(slug, F.lit("-"), year.cast("string")))


def sort_title(c: Column) -> Column:
    """without one leading article."""
    return F.regexp_replace(F.trim(c), "(?i)^(the|an|a) ", "")


def title_case(c: Column) -> Column:
    """a label's words in title case; a label of separators alone stays as it is."""
    words = F.trim(F.regexp_replace(F.translate(c, "_-", "  "), r"(?U)\s+", " "))
    return F.when(words == "", c).otherwise(F.initcap(words))


#: The first season mark that ends a label; `season`, but not `s`, may stand apart from its number.
_SERIES = r"(?iUs)^(.*?)[_\- ](?:s|season[_\- ]?)(\d{1,2})(?:[_\- ]?d\d+)?\s*$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def series_title(c: Column) -> Column:
    """the label's title without its season mark."""
    label = _trimmed(c)
    return F.when(label.rlike(_SERIES), title_case(F.rtrim(F.regexp_extract(label, _SERIES, 1), F.lit("_- ")))).otherwise(title_case(label))


def series_season(c: Column) -> Column:
    """the season in the label, if any."""
    label = _trimmed(c)
    return F.when(label.rlike(_SERIES), F.regexp_extract(label, _SERIES, 2).try_cast("int"))


def sanitise_dir(c: Column) -> Column:
    """F12."""
    return F.translate(c, "/\\", "__")


def branch_slug(c: Column) -> Column:
    """F13."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "-")


def cover_url(c: Column, host: str) -> Column:
    """absolute as it is, relative under host, blank to null."""
    t = nonempty(c)
    return F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit(host.rstrip("/") + "/"), F.regexp_replace(t, "^/+", "")))


_ESCAPED, _OCTAL = re.compile(r"%(.)(.)|%.?$", re.S), re.compile(r"\\(.)(.)(.)", re.S)


def _of_percent(m: re.Match) -> str:
    if m[2] is None:
        return "%"
    return chr(int(m[1] + m[2], 16)) if re.fullmatch("[0-9A-Fa-f+][0-9A-Fa-f]", m[1] + m[2]) else m[0]


def _of_octal(m: re.Match) -> str:
    return chr(int(m[0][1:], 8)) if re.fullmatch("[0-7]{3}", m[0][1:]) else m[0]


@F.pandas_udf(StringType())
def percent_decode(texts: pd.Series) -> pd.Series:
    """a percent sign and the two characters after it become the character of that hex number, or stay as they are
    if they are none; at the end, a percent sign swallows a single character."""
    return texts.map(lambda t: None if t is None else _ESCAPED.sub(_of_percent, t))


@F.pandas_udf(StringType())
def octal_unescape(texts: pd.Series) -> pd.Series:
    r"""F16: \NNN in mount tables; a backslash and the three characters after it stay if they are no octal number."""
    return texts.map(lambda t: None if t is None else _OCTAL.sub(_of_octal, t))


def epoch_iso(c: Column) -> Column:
    """F17."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def year_of_date(c: Column) -> Column:
    """the number before the first hyphen."""
    first = F.split(c, "-")[0]
    return F.when(first.rlike(r"^\+?[0-9]{1,9}$"), first.cast("int"))


def has_3d_token(c: Column) -> Column:
    """F19."""
    return F.array_contains(F.split(F.lower(c), r"[ ._\-\[\]()]"), "3d")


def xml_escape(c: Column) -> Column:
    """F21."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def valid_year(c: Column, low: int = 1, high: int = 2**31 - 1) -> Column:
    """Any year after 0 in the catalogue; 1900 to 2100 in what a user submits."""
    return F.when(c.between(low, high), c)
