"""Registered catalogue queries over the driver's tables, each with its SQL twin.

The tables hold no discs, so orders stand for discs, lines for files or titles, events for log records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversion, media, naming, text
from ..operators import discs, identify, plan, scan, sinks
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, lpad(to_hex(l_partkey), 16, '0') AS x FROM lineitem),
b AS (SELECT *, substr(x,15,2)||substr(x,13,2)||substr(x,11,2)||substr(x,9,2)||substr(x,7,2)||substr(x,5,2)||substr(x,3,2)||substr(x,1,2) AS le FROM h)
SELECT l_orderkey, upper(md5(unhex(string_agg(le, '' ORDER BY l_linenumber, l_partkey)))) AS content_hash FROM b GROUP BY l_orderkey""")
def content_hash(spark, sf_dir):
    return discs.content_hash(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.struct("l_linenumber", "l_partkey"), "l_partkey")


def _hashed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_suppkey") % 3)).alias("k"))
    return lists.select("l_orderkey", F.md5(F.array_join(F.transform("k", lambda x: x.cast("string")), "|")).alias("content_hash"))


@_query("""WITH h AS (SELECT l_orderkey, upper(md5(string_agg(CAST(l_suppkey % 3 AS VARCHAR), '|' ORDER BY l_suppkey % 3))) AS k FROM lineitem GROUP BY l_orderkey),
i AS (SELECT k, count(*) AS discs, min(l_orderkey) AS first_disc FROM h GROUP BY k)
SELECT l_orderkey, discs, first_disc FROM h JOIN i USING (k)""")
def hash_index_lookup(spark, sf_dir):
    orders = _hashed_orders(spark, sf_dir)
    index = discs.hash_matches(discs.hash_index(orders, "content_hash", "l_orderkey"))
    return discs.lookup(orders, index, "content_hash").select("l_orderkey", "discs", F.col("first_path").alias("first_disc"))


@_query("""WITH b AS (SELECT DISTINCT o_custkey, o_orderkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
s AS (SELECT o_custkey, o_orderkey, list(p_brand ORDER BY p_brand) AS l FROM b GROUP BY ALL),
p AS (SELECT x.o_custkey, x.o_orderkey AS small, y.o_orderkey AS large FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND len(x.l) < len(y.l) AND list_has_all(y.l, x.l))
SELECT o_custkey, o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM p WHERE large = o_orderkey) THEN 'composite' WHEN EXISTS (SELECT 1 FROM p WHERE small = o_orderkey) THEN 'constituent' ELSE 'atomic' END AS kind,
coalesce((SELECT count(*) FROM p WHERE large = o_orderkey), 0) AS n_constituents FROM s""")
def title_relations(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    titles = _t(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.collect_set("p_brand").alias("segments"))
    found = discs.title_relations(titles, "o_custkey", "o_orderkey", "segments")
    return found.select("o_custkey", "o_orderkey", "kind", F.coalesce(F.size("constituents"), F.lit(0)).cast("bigint").alias("n_constituents"))


_EVENTS = ("click", "view", "purchase", "signup")


@_query("SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{e}') AS last_{e}" for e in _EVENTS) + " FROM events GROUP BY user_id")
def eav_last_write_pivot(spark, sf_dir):
    return scan.last_write_pivot(_t(spark, sf_dir, "events"), ["user_id"], "event_type", "value", F.struct("ts", "event_id"), {e: f"last_{e}" for e in _EVENTS})


@_query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events""")
def progress_forward_fill(spark, sf_dir):
    filled = identify.forward_fill(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), "last_view")
    return filled.select("event_id", "user_id", "last_view")


@_query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity >= 10) >= 3 AND max(l_quantity) FILTER (WHERE l_quantity >= 10) / min(l_quantity) FILTER (WHERE l_quantity >= 10) <= 1.2::DOUBLE
AND max(l_quantity) FILTER (WHERE l_quantity >= 10) <= 45 THEN 'Series' ELSE 'Movie' END AS content_kind FROM lineitem GROUP BY l_orderkey""")
def content_kind(spark, sf_dir):
    return discs.content_kind(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity"), 10, 45)


@_query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, l_linenumber)) AS main_title FROM lineitem GROUP BY l_orderkey")
def main_title(spark, sf_dir):
    return discs.main_title(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity"), F.col("l_linenumber"))


@_query(r"""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*[:cntrl:]]', ' ', 'g'), '\s+', ' ', 'g')), '[. ]+$', '') AS name FROM pages""")
def sanitise_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.sanitise(F.col("url")).alias("name"))


@_query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[ -]', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') || '-' || p_size AS slug FROM part""")
def title_slug(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.title_slug(F.col("p_name"), F.col("p_size")).alias("slug"))


@_query("""SELECT doc_id, CASE WHEN n_chars >= 3600 THEN format('{:d}:{:02d}:{:02d}', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE format('{:d}:{:02d}', n_chars // 60, n_chars % 60) END AS duration,
format('{:d}:{:02d}:{:02d}', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS full_duration FROM documents""")
def format_duration(spark, sf_dir):
    n = F.col("n_chars")
    return _t(spark, sf_dir, "documents").select("doc_id", text.format_duration(n).alias("duration"), text.format_duration_full(n).alias("full_duration"))


_DURATIONS = ("{a}:{b}:{c}", "{a}:{b}", "{a}", "+{a}:0{b}:{c}", "{a}:{b}:{c}:{d}", " {a}:{b}", "{a}::{b}", "{a}:-{b}", "x{a}", "", "{a}.5")


@_query("""WITH t AS (SELECT doc_id, CAST(n_chars % 5 AS VARCHAR) AS a, CAST(n_chars % 97 AS VARCHAR) AS b, CAST(doc_id % 61 AS VARCHAR) AS c FROM documents),
l AS (SELECT doc_id, [a||':'||b||':'||c, a||':'||b, a, '+'||a||':0'||b||':'||c, a||':'||b||':'||c||':1', ' '||a||':'||b, a||'::'||b, a||':-'||b, 'x'||a, '', a||'.5'][doc_id % 11 + 1] AS s FROM t),
p AS (SELECT doc_id, s, string_split(s, ':') AS p FROM l) SELECT doc_id, s AS label, CASE WHEN NOT regexp_full_match(s, '\\+?[0-9]+(:\\+?[0-9]+){0,2}') THEN NULL
WHEN len(p) = 3 THEN CAST(p[1] AS BIGINT) * 3600 + CAST(p[2] AS BIGINT) * 60 + CAST(p[3] AS BIGINT) WHEN len(p) = 2 THEN CAST(p[1] AS BIGINT) * 60 + CAST(p[2] AS BIGINT) ELSE CAST(p[1] AS BIGINT) END AS seconds FROM p""")
def parse_duration(spark, sf_dir):
    a, b, c = ((F.col(x) % m).cast("string") for x, m in (("n_chars", 5), ("n_chars", 97), ("doc_id", 61)))
    shapes = [F.lit(x) for x in _DURATIONS]
    label = F.element_at(F.array(*shapes), (F.col("doc_id") % 11 + 1).cast("int"))
    for key, value in (("{a}", a), ("{b}", b), ("{c}", c), ("{d}", F.lit("1"))):
        label = F.replace(label, F.lit(key), value)
    return _t(spark, sf_dir, "documents").select("doc_id", label.alias("label")).select("doc_id", "label", text.parse_duration(F.col("label")).alias("seconds"))


@_query("""WITH f AS (SELECT * FROM events WHERE event_type = 'purchase'), m AS (SELECT f.event_id AS feature, t.event_id AS match, row_number() OVER (PARTITION BY f.event_id ORDER BY t.event_id) AS r FROM f JOIN events t ON t.user_id = f.user_id
AND t.event_type = 'view' AND abs(t.value - f.value) <= greatest(f.value / 20, 0.5)) SELECT feature, match FROM m WHERE r = 1""")
def tolerance_match(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    features = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("feature"), F.col("value").alias("want"))
    titles = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("match"), F.col("value").alias("have"))
    found = discs.tolerance_match(features, titles, "user_id", "want", "have", "match", ["feature"], F.greatest(F.col("want") / 20, F.lit(0.5)), 8.0)
    return found.select("feature", "match")


@_query("""WITH s AS (SELECT s_suppkey, s_nationkey, right(s_name, 1) AS d FROM supplier), a AS (SELECT s_nationkey, d, min(s_suppkey) AS k FROM s GROUP BY ALL), b AS (SELECT s_nationkey, min(s_suppkey) AS k FROM s GROUP BY ALL)
SELECT c_custkey, coalesce(a.k, b.k) AS s_suppkey FROM customer LEFT JOIN a ON a.s_nationkey = c_nationkey AND a.d = right(c_name, 1) LEFT JOIN b ON b.s_nationkey = c_nationkey""")
def first_match_two_tier(spark, sf_dir):
    left = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.right("c_name", F.lit(1)).alias("digit"))
    right = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.right("s_name", F.lit(1)).alias("digit"))
    return identify.two_tier_match(left, right, ["nation", "digit"], ["nation"], "s_suppkey", "s_suppkey").select("c_custkey", "s_suppkey")


@_query("""WITH l AS (SELECT l_orderkey AS o_orderkey, max(l_partkey) AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1), r AS (SELECT o_orderkey, o_custkey AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0)
SELECT o.o_orderkey, CASE WHEN l.v IS NOT NULL THEN 'local' WHEN r.v IS NOT NULL THEN 'remote' ELSE 'miss' END AS status, coalesce(l.v, r.v) AS found FROM orders o LEFT JOIN l USING (o_orderkey) LEFT JOIN r USING (o_orderkey)""")
def fallback_union(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    local = _t(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_partkey").alias("found"))
    remote = orders.join(_t(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("o_custkey").alias("found"))
    return identify.with_fallback(orders.select("o_orderkey"), local, remote, "o_orderkey", "found")


@_query("SELECT o_orderkey, CAST(6 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS episode FROM orders")
def episode_numbering(spark, sf_dir):
    return identify.number_episodes(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "episode")


_ROLE_SQL = "CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'MainMovie' WHEN 'SMALL' THEN 'Trailer' WHEN 'MEDIUM' THEN 'Featurette' WHEN 'LARGE' THEN 'DeletedScenes' ELSE p_type END"


def _role(c: Column) -> Column:
    first = F.split(c, " ")[0]
    return F.when(first == "STANDARD", "MainMovie").when(first == "SMALL", "Trailer").when(first == "MEDIUM", "Featurette").when(first == "LARGE", "DeletedScenes").otherwise(c)


@_query(f"""WITH r AS (SELECT p_partkey, {_ROLE_SQL} AS n FROM part), k AS (SELECT p_partkey, CASE n WHEN 'MainMovie' THEN 'Main' WHEN 'Trailer' THEN 'Trailer' WHEN 'Featurette' THEN 'Featurette' WHEN 'DeletedScenes' THEN 'DeletedScene' ELSE 'Other' END AS role FROM r)
SELECT p_partkey, role, CASE role WHEN 'Trailer' THEN 'trailers' WHEN 'Featurette' THEN 'featurettes' WHEN 'DeletedScene' THEN 'deleted' WHEN 'Main' THEN '' ELSE 'extras' END AS folder FROM k""")
def role_map(spark, sf_dir):
    role = identify.parse_role(_role(F.col("p_type")))
    return _t(spark, sf_dir, "part").select("p_partkey", role.alias("role"), identify.extras_folder(role).alias("folder"))


@_query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT doc_id, coalesce(CASE WHEN q = 1 THEN nullif(trim(source), '') END, nullif(lang, ''), 'Title ' || doc_id) AS display FROM documents LEFT JOIN l USING (doc_id)""")
def precedence_resolution(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return rows.select("doc_id", identify.display_title(F.when(F.col("q") == 1, F.col("source")).otherwise(F.lit(" ")), F.col("lang"), F.lit(None).cast("string"), F.col("doc_id")).alias("display"))


def _path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(
        "o_orderkey", F.concat("c_mktsegment", F.lit(": Part "), F.col("o_custkey").cast("string"), F.lit(".")).alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.year("o_orderdate")).alias("year"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("tt"), F.col("o_custkey").cast("string"))).alias("imdb"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("tmdb"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("3D")).alias("variant"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey")).alias("tvdb"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("season"), (F.col("o_orderkey") % 24 + 1).cast("int").alias("episode"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("name"),
    )


_PATH_SQL = """WITH r AS (SELECT o_orderkey, c_mktsegment || ' Part ' || o_custkey AS t, CASE WHEN o_orderkey % 3 > 0 THEN ' (' || year(o_orderdate) || ')' ELSE '' END AS y, CASE WHEN o_orderkey % 2 = 0 THEN 'tt' || o_custkey END AS imdb,
CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS tmdb, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END AS tvdb, CASE WHEN o_orderkey % 7 = 0 THEN ' - 3D' ELSE '' END AS v, o_orderkey % 30 + 1 AS s, o_orderkey % 24 + 1 AS e,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS n FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT *, {tag} AS tag FROM r) SELECT o_orderkey, {path} AS path FROM f"""
_MOVIE_TAGS = {
    "jellyfin": "coalesce(' [imdbid-' || imdb || ']', ' [tmdbid-' || tmdb || ']', '')", "plex": "coalesce(' {{imdb-' || imdb || '}}', ' {{tmdb-' || tmdb || '}}', '')", "kodi": "coalesce(' {{tmdb=' || tmdb || '}}', ' {{imdb=' || imdb || '}}', '')",
}
_EPISODE_TAGS = {
    "jellyfin": "coalesce(' [imdbid-' || imdb || ']', ' [tmdbid-' || tmdb || ']', ' [tvdbid-' || tvdb || ']', '')", "plex": "coalesce(' {{tvdb-' || tvdb || '}}', ' {{imdb-' || imdb || '}}', ' {{tmdb-' || tmdb || '}}', '')", "kodi": "''",
}
_SEASON = "'/Season ' || lpad(s::VARCHAR, 2, '0') || '/'"
_EPISODE_FILES = {
    "jellyfin": "t || y || ' S' || lpad(s::VARCHAR, 2, '0') || 'E' || lpad(e::VARCHAR, 2, '0') || coalesce(' - ' || n, '')", "plex": "t || y || ' - s' || lpad(s::VARCHAR, 2, '0') || 'e' || lpad(e::VARCHAR, 2, '0') || coalesce(' - ' || n, '')",
    "kodi": "t || ' S' || lpad(s::VARCHAR, 2, '0') || 'E' || lpad(e::VARCHAR, 2, '0') || coalesce(' ' || n, '')",
}


def _register_paths() -> None:
    for scheme in ("jellyfin", "plex", "kodi"):

        def movies(spark, sf_dir, scheme=scheme):
            c = F.col
            return _path_rows(spark, sf_dir).select("o_orderkey", naming.movie_path(scheme, F.lit("/lib/Movies"), c("title"), c("year"), c("imdb"), c("tmdb"), c("variant")).alias("path"))

        def episodes(spark, sf_dir, scheme=scheme):
            c = F.col
            return _path_rows(spark, sf_dir).select("o_orderkey", naming.episode_path(scheme, F.lit("/lib/Shows"), c("title"), c("year"), c("season"), c("episode"), c("name"), c("imdb"), c("tmdb"), c("tvdb")).alias("path"))

        QUERIES[f"path_{scheme}"], QUERIES[f"episode_path_{scheme}"] = movies, episodes
        ORACLES[f"path_{scheme}"] = _PATH_SQL.replace("{tag}", _MOVIE_TAGS[scheme]).replace("{path}", "'/lib/Movies/' || t || y || tag || '/' || t || y || tag || v || '.mkv'").replace("{{", "{").replace("}}", "}")
        ORACLES[f"episode_path_{scheme}"] = _PATH_SQL.replace("{tag}", _EPISODE_TAGS[scheme]).replace("{path}", f"'/lib/Shows/' || t || y || tag || {_SEASON} || {_EPISODE_FILES[scheme]} || '.mkv'").replace("{{", "{").replace("}}", "}")


_register_paths()


_ARTICLES = ("The ", "a ", "AN ", "", "The", "the the ", " an ", "A  ", "Theo ", "Ana ")


@_query("""WITH n AS (SELECT p_partkey, ['The ', 'a ', 'AN ', '', 'The', 'the the ', ' an ', 'A  ', 'Theo ', 'Ana '][p_partkey % 10 + 1] || p_name || ' ' AS n FROM part)
SELECT p_partkey, n AS name, CASE WHEN lower(trim(n)) LIKE 'the %' THEN substr(trim(n), 5) WHEN lower(trim(n)) LIKE 'an %' THEN substr(trim(n), 4) WHEN lower(trim(n)) LIKE 'a %' THEN substr(trim(n), 3) ELSE trim(n) END AS sorted FROM n""")
def sort_title(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*map(F.lit, _ARTICLES)), (F.col("p_partkey") % 10 + 1).cast("int")), "p_name", F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", text.sort_title(F.col("name")).alias("sorted"))


#: Ends of labels, each with the season that it gives; those without one belong to the title.
_SEASON_MARKS = (("_S1D1", 1), ("-s02d03", 2), (" season 7", 7), ("_SEASON_4", 4), (" s12 ", 12), ("_S_1", None), (" S 4", None), ("_S2001", None), ("S3", None), ("__s5-d12", 5), (" Season", None), ("_s1x", None), ("_S1_S2", 2))


@_query("""WITH l AS (SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS base, [""" + ", ".join(f"'{m}'" for m, _ in _SEASON_MARKS) + """][p_partkey % 13 + 1] AS mark, [""" + ", ".join("NULL" if s is None else str(s) for _, s in _SEASON_MARKS) + """][p_partkey % 13 + 1] AS season FROM part),
t AS (SELECT *, CASE WHEN season IS NULL THEN base || mark WHEN mark = '_S1_S2' THEN base || '_S1' ELSE base END AS shown FROM l)
SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(translate(shown, '_-', '  '), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS series, CAST(season AS INT) AS season FROM t""")
def series_label(spark, sf_dir):
    mark = F.element_at(F.array(*(F.lit(m) for m, _ in _SEASON_MARKS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    label = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), mark)
    return _t(spark, sf_dir, "part").select("p_partkey", text.series_title(label).alias("series"), text.series_season(label).alias("season"))


@_query("""WITH l AS (SELECT p_partkey, p_name || ['.3D[x]', '.3Dx', ' 3d', '(3D)', '_3D_', '3D', '-3-D', '.x3d.'][p_partkey % 8 + 1] AS l FROM part)
SELECT p_partkey, l AS label, len(list_filter(string_split_regex(lower(l), '[ ._\\-\\[\\]()]'), lambda w: w = '3d')) > 0 AS is_3d FROM l""")
def has_3d_token(spark, sf_dir):
    ends = F.array(*(F.lit(x) for x in (".3D[x]", ".3Dx", " 3d", "(3D)", "_3D_", "3D", "-3-D", ".x3d.")))
    label = F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select("p_partkey", "label", text.has_3d_token(F.col("label")).alias("is_3d"))


@_query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label FROM part""")
def title_case_label(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_-")))).alias("label"))


@_query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def year_from_date(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.year_of_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@_query("""WITH m AS (SELECT p_partkey, (p_size * 5) % 256 AS m FROM part) SELECT p_partkey, CASE WHEN m = 0 THEN '0' WHEN m = 255 THEN NULL ELSE CAST((SELECT min(i) + 1 FROM range(8) r(i) WHERE (m >> CAST(i AS INT)) & 1 = 0) AS VARCHAR) END AS region FROM m""")
def region_code(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", media.dvd_region((F.col("p_size") * 5) % 256).alias("region"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@_query("""WITH l AS (SELECT o_custkey, o_orderkey, sum(greatest(l_partkey - l_suppkey, 0)) AS total, bool_and(coalesce(s_acctbal > -800, false)) AS whole FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT o_custkey, o_orderkey, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, o_orderkey) AS r FROM l WHERE whole) WHERE r = 1""")
def playlist_feature(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    items = _t(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return discs.feature_playlists(items, "o_custkey", "o_orderkey", media.ticks(F.col("l_suppkey"), F.col("l_partkey")), F.col("s_acctbal") > -800)


@_query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'UltraHdBluRay' WHEN bool_or(l_returnflag = 'A') THEN 'BluRay3D' WHEN bool_or(l_linestatus = 'F') AND NOT bool_or(l_linestatus = 'O') THEN 'Dvd'
WHEN contains(lower(max(l_linestatus)), 'dvd') THEN 'Dvd' WHEN bool_or(l_quantity > 45) THEN 'BluRay3D' WHEN bool_or(l_quantity > 30) THEN 'UltraHdBluRay' ELSE 'BluRay' END AS disc_type FROM lineitem GROUP BY l_orderkey""")
def disc_type(spark, sf_dir):
    any_of = lambda c: F.bool_or(c)
    c = F.col
    plain = scan.disc_type(F.max("l_linestatus"), any_of(c("l_quantity") > 45), any_of(c("l_quantity") > 30))
    kind = scan.disc_type_with_markers(any_of(c("l_returnflag") == "R"), any_of(c("l_returnflag") == "A"), any_of(c("l_linestatus") == "F"), any_of(c("l_linestatus") == "O"), plain)
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(kind.alias("disc_type"))


@_query("""WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders GROUP BY o_custkey) SELECT *,
CASE WHEN failed = 0 THEN 'All titles done' WHEN done = 0 THEN 'Rip failed' ELSE 'Finished with ' || failed || ' failure(s)' END AS title,
CASE WHEN failed = 0 THEN done || ' succeeded' WHEN done = 0 THEN failed || ' of ' || failed || ' titles failed — see queue rows for details' ELSE done || ' succeeded, ' || failed || ' failed of ' || (done + failed) END AS subtitle FROM n""")
def success_summary(spark, sf_dir):
    counts = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"))
    return counts.select("*", identify.success_summary(F.col("done"), F.col("failed")).alias("s")).select("o_custkey", "done", "failed", "s.title", "s.subtitle")


_BACKENDS, _PRESETS = ("software", "nvenc", "qsv", "vaapi", "amf", "v4l2m2m"), ("higher", "balanced", "smaller")
_PARTS = """WITH p AS (SELECT p_partkey, p_size, ['software','nvenc','qsv','vaapi','amf','v4l2m2m'][p_partkey % 6 + 1] AS b, CASE WHEN p_partkey % 4 < 2 THEN 'h264' ELSE 'h265' END AS c, ['higher','balanced','smaller'][p_size % 3 + 1] AS pr,
['full_sbs','half_sbs','full_tab','half_tab','frame_sequential'][p_size % 5 + 1] AS f FROM part)"""


def _nth(names: tuple, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (index + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    codec = F.when(key % 4 < 2, "h264").otherwise("h265")
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", _nth(_BACKENDS, key % 6).alias("backend"), codec.alias("codec"), _nth(_PRESETS, size % 3).alias("preset"), _nth(tuple(f[0] for f in media.FORMATS), size % 5).alias("format"))


@_query(_PARTS + """ SELECT p_partkey, greatest(12, least(32, CASE WHEN b IN ('software', 'nvenc') AND c = 'h265' THEN 21 WHEN b = 'nvenc' THEN 19 WHEN b IN ('vaapi', 'amf') THEN CASE c WHEN 'h264' THEN 20 ELSE 22 END ELSE 18 END
+ CASE pr WHEN 'higher' THEN -3 WHEN 'smaller' THEN 4 ELSE 0 END)) AS quality, CASE WHEN f = 'full_sbs' THEN p_size * 2 ELSE p_size END AS width, CASE WHEN f = 'full_tab' THEN 2160 ELSE 1080 END AS height FROM p""")
def quality_table(spark, sf_dir):
    out = media.output_size(F.col("format"), F.col("p_size"), F.lit(1080))
    return _parts(spark, sf_dir).select("p_partkey", conversion.quality(F.col("preset"), F.col("backend"), F.col("codec")).alias("quality"), out["width"].alias("width"), out["height"].alias("height"))


@_query(_PARTS + """ SELECT p_partkey, CASE WHEN b = 'software' THEN CASE c WHEN 'h264' THEN 'libx264' ELSE 'libx265' END ELSE CASE c WHEN 'h264' THEN 'h264_' ELSE 'hevc_' END || b END AS encoder,
'-c:v ' || encoder || CASE b WHEN 'vaapi' THEN ' -qp ' || p_size WHEN 'nvenc' THEN ' -preset p5 -rc vbr -cq ' || p_size WHEN 'qsv' THEN ' -preset medium -global_quality ' || p_size
WHEN 'amf' THEN ' -quality balanced -rc cqp -qp_i ' || p_size || ' -qp_p ' || p_size || ' -qp_b ' || p_size WHEN 'v4l2m2m' THEN ' -b:v ' || greatest(0, 24 - greatest(p_size - 18, 0) * 3 // 2) || 'M'
ELSE ' -preset medium -crf ' || p_size || CASE c WHEN 'h265' THEN ' -x265-params open-gop=0:repeat-headers=1:info=0' ELSE '' END END || ' -g 48' AS args FROM p""")
def encoder_args(spark, sf_dir):
    backend, codec = F.col("backend"), F.col("codec")
    args = conversion.encoder_args(backend, codec, F.col("p_size"), F.lit(None).cast("string"))["args"]
    return _parts(spark, sf_dir).select("p_partkey", conversion.encoder(backend, codec).alias("encoder"), F.array_join(args, " ").alias("args"))


@_query(_PARTS + """, d AS (SELECT *, p_size % 2 = 0 AS nv, p_size % 3 = 0 AS va, p_size % 5 = 0 AS q FROM p), a AS (SELECT *, CASE WHEN nv THEN 'nvenc' WHEN q THEN 'qsv' WHEN va THEN 'vaapi' ELSE 'software' END AS best FROM d)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN best WHEN b = 'nvenc' AND nv OR b = 'qsv' AND q OR b = 'vaapi' AND va THEN b ELSE 'software' END AS backend FROM a""")
def resolve_backend(spark, sf_dir):
    size, codec = F.col("p_size"), F.col("codec")
    listed = F.concat(F.array(conversion.encoder(F.lit("nvenc"), codec), conversion.encoder(F.lit("vaapi"), codec)), F.when(size % 5 == 0, F.array(conversion.encoder(F.lit("qsv"), codec))).otherwise(F.array().cast("array<string>")))
    asked = F.when(F.col("p_partkey") % 7 == 0, "auto").otherwise(F.col("backend"))
    found = conversion.resolve_backend(asked, codec, listed, F.when(size % 3 == 0, F.lit("card")), size % 2 == 0, F.lit(True))
    return _parts(spark, sf_dir).select("p_partkey", found.alias("backend"))


@_query(_PARTS + """ SELECT p_partkey, CASE f WHEN 'full_sbs' THEN 'left_right' WHEN 'half_sbs' THEN 'left_right' WHEN 'full_tab' THEN 'top_bottom' WHEN 'half_tab' THEN 'top_bottom' END AS stereo_mode, CASE f WHEN 'full_sbs' THEN '[0:v][1:v]hstack=inputs=2[v]'
WHEN 'half_sbs' THEN '[0:v]scale=iw/2:ih[l];[1:v]scale=iw/2:ih[r];[l][r]hstack=inputs=2[v]' WHEN 'full_tab' THEN '[0:v][1:v]vstack=inputs=2[v]' WHEN 'half_tab' THEN '[0:v]scale=iw:ih/2[t];[1:v]scale=iw:ih/2[b];[t][b]vstack=inputs=2[v]'
ELSE '[0:v][1:v]framepack=frameseq[v]' END AS views_filter FROM p""")
def filter_graphs(spark, sf_dir):
    found = conversion.layout(F.col("format"))
    return _parts(spark, sf_dir).select("p_partkey", found["stereo_mode"].alias("stereo_mode"), found["views_filter"].alias("views_filter"))


@_query("""SELECT p_partkey, replace(p_name, ' ', '.') || CASE WHEN p_partkey % 2 = 0 THEN ' - 3D.' ELSE '.3d.' END || 'fsbs.mkv' AS path FROM part""")
def converted_path(spark, sf_dir):
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(F.col("p_partkey") % 2 == 0, F.lit(" - 3D")).otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", naming.converted_path(stem, F.lit("fsbs")).alias("path"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'b' WHEN p_size % 4 = 1 THEN 'c' WHEN p_size % 4 = 2 THEN 'c' END AS name FROM part""")
def numbered_name(spark, sf_dir):
    names = F.create_map(F.lit(1), F.lit("b"), F.lit(2), F.lit("c"))
    return _t(spark, sf_dir, "part").select("p_partkey", identify.numbered_name(names, F.col("p_size") % 4).alias("name"))


@_query("""WITH m AS (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_custkey) FILTER (WHERE c_acctbal > 9500) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS b FROM supplier GROUP BY 1)
SELECT n_nationkey, CASE WHEN a[1] IS NOT NULL THEN 'Movie' WHEN b[1] IS NOT NULL THEN 'Series' END AS kind, CAST(coalesce(a[1], b[1]) AS BIGINT) AS hit FROM nation LEFT JOIN m ON m.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def first_candidate(spark, sf_dir):
    movies = _t(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array(F.min("c_custkey")).alias("movies"))
    series = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array(F.min("s_suppkey")).alias("series"))
    found = identify.first_candidate(F.col("movies"), F.col("series"))
    return _t(spark, sf_dir, "nation").join(movies, "n_nationkey", "left").join(series, "n_nationkey", "left").select("n_nationkey", found["kind"].alias("kind"), found["hit"].cast("bigint").alias("hit"))


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT c_custkey, s_name AS title FROM r LEFT JOIN t ON s_nationkey = c_nationkey AND t.n = r.n""")
def zip_titles(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("season"))
    titles = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("season"), "s_suppkey", F.col("s_name").alias("title"))
    return identify.zip_titles(rows, titles, ["season"], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "title")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NotAttempted' WHEN o_orderkey % 3 > 0 OR o_orderstatus = 'F' THEN 'Ok' ELSE 'Failed: ' || o_orderstatus END AS status FROM orders""")
def lookup_status(spark, sf_dir):
    key = F.col("o_orderkey")
    status = identify.lookup_status(F.when(key % 5 > 0, F.lit("hash")), key % 3, F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@_query("""SELECT o_orderkey, coalesce(max(l_linenumber) FILTER (WHERE l_linenumber = 3), arg_max(l_linenumber, (l_shipdate, -l_linenumber, -l_partkey)))::VARCHAR || '.mkv' AS output FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def resolve_output(spark, sf_dir):
    files = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".mkv")).alias("path"), F.col("l_shipdate").alias("mtime"))
    want = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit("3.mkv").alias("want"))
    return identify.resolve_output(want, files, "o_orderkey", "want", "path", "mtime").select("o_orderkey", "output")


@_query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM lineitem)
SELECT l_orderkey, l_linenumber, done, 7200.0::DOUBLE * (done::DOUBLE / 400) AS current_seconds FROM d WHERE done // 32 > (done - q) // 32""")
def byte_progress(spark, sf_dir):
    chunks = _t(spark, sf_dir, "lineitem").withColumn("bytes", F.col("l_quantity").cast("bigint"))
    found = identify.byte_progress(chunks, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "bytes", F.lit(400), F.lit(7200.0), 32)
    return found.select("l_orderkey", "l_linenumber", "done", "current_seconds")


@_query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'contains 2 other title(s)' WHEN 1 THEN 'part of #' || o_custkey || ', #7' END AS caption FROM orders""")
def relation_caption(spark, sf_dir):
    kind = _nth(("composite", "constituent", "atomic"), F.col("o_orderkey") % 3)
    caption = identify.relation_caption(kind, F.array(F.lit(1), F.lit(2)), F.array(F.col("o_custkey"), F.lit(7)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", caption.alias("caption"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, printf('  t%-2d dur=%6ds size=%11d chap=%-2d src=%-14s segmap=%-14s', l_linenumber::INT, l_quantity::BIGINT, l_partkey::BIGINT, 0, src, '?') AS line
FROM (SELECT *, l_returnflag || '.m2ts' AS src FROM lineitem)""")
def report_line(spark, sf_dir):
    c = F.col
    line = sinks.report_line(c("l_linenumber"), c("l_quantity"), c("l_partkey"), F.lit(None), F.concat("l_returnflag", F.lit(".m2ts")), F.lit(None).cast("string"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/run/media/My Disc ' || doc_id WHEN doc_id % 3 = 0 THEN '/run/' || source END AS mount, CASE WHEN doc_id % 2 = 0 THEN '/dev/loop' || doc_id END AS device FROM documents""")
def mount_points(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    good = F.concat(F.lit("Found.\nMounted /dev/loop"), key, F.lit(" at /run/media/My Disc "), key, F.lit("."))
    said = F.when(F.col("doc_id") % 2 == 0, good).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Error: already mounted at `/run/"), F.col("source"), F.lit("'."))).otherwise("no such device")
    return _t(spark, sf_dir, "documents").select("doc_id", files.mount_point(said).alias("mount"), files.loop_device(said).alias("device"))


@_query("""WITH p AS (SELECT *, p_name AS t, 1990 + p_size AS y FROM part) SELECT p_partkey, '{' || CASE WHEN p_partkey % 2 = 0 THEN '"ExternalIds":{"Tmdb":"' || p_partkey || '"},' ELSE '' END || '"FullTitle":"' || t || '","Groups":[],"Slug":"'
|| regexp_replace(regexp_replace(lower(t), '[ -]', '-', 'g'), '[^a-z0-9-]', '', 'g') || '-' || y || '","SortTitle":"' || t || '","Title":"' || t || '","Type":"Movie","Year":' || y || '}' AS document FROM p""")
def metadata_json(spark, sf_dir):
    none = F.lit(None).cast("string")
    tmdb = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", sinks.metadata_json(F.col("p_name"), F.col("p_size") + 1990, F.lit("Movie"), tmdb, none, none, none, none).alias("document"))


def _register_extras() -> None:
    folders = {"jellyfin": ("trailers", "deleted", "extras"), "plex": ("Trailers", "Deleted Scenes", "Other")}
    for scheme in ("jellyfin", "plex", "kodi"):

        def extras(spark, sf_dir, scheme=scheme):
            c, role = F.col, _nth(("Trailer", "DeletedScene", "Other", "Main"), F.col("o_orderkey") % 4)
            folder = naming.movie_folder(scheme, c("title"), c("year"), c("imdb"), c("tmdb"))
            return _path_rows(spark, sf_dir).select("o_orderkey", naming.extras_path(scheme, F.lit("/lib/Movies"), folder, role, identify.extras_folder(role, scheme), F.concat(F.lit("a/b "), c("o_orderkey").cast("string"))).alias("path"))

        QUERIES[f"extras_path_{scheme}"] = extras
        own = "'a b ' || o_orderkey"
        if scheme == "kodi":
            end = f"CASE o_orderkey % 4 WHEN 0 THEN t || y || tag || '-trailer' WHEN 3 THEN t || y || tag ELSE 'extras/' || {own} END"
        else:
            a, b, c = folders[scheme]
            end = f"['{a}/', '{b}/', '{c}/', ''][o_orderkey % 4 + 1] || {own}"
        ORACLES[f"extras_path_{scheme}"] = _PATH_SQL.replace("{tag}", _MOVIE_TAGS[scheme]).replace("{path}", f"'/lib/Movies/' || t || y || tag || '/' || {end} || '.mkv'").replace("{{", "{").replace("}}", "}")


_register_extras()


@_query("""SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS disc, 'bluray' AS format, count(*) AS titles, count(*) FILTER (WHERE l_returnflag <> 'N') AS items, CAST(sum(l_quantity::BIGINT) AS BIGINT) AS size,
string_agg(l_linenumber::VARCHAR || ':' || coalesce(nullif(l_returnflag, 'N'), '-'), ' ' ORDER BY l_linenumber, l_partkey, l_quantity) AS shown FROM lineitem GROUP BY l_orderkey""")
def render_json(spark, sf_dir):
    # Nulls come last; lines equal in all three come as they stand in the files.
    lines = _t(spark, sf_dir, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index")
    title = F.struct(F.col("l_linenumber").alias("Index"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("Item"), F.rint("l_quantity").cast("bigint").alias("Size"))
    order = F.struct(*(x for n in ("l_linenumber", "l_partkey", "l_quantity") for x in (F.col(n).isNull().alias(f"no_{n}"), F.col(n))), "file_path", "row_index")
    docs = sinks.disc_json(lines, ["l_orderkey"], {"Index": F.col("l_orderkey"), "Format": F.lit("bluray")}, title, order)
    doc = F.col("document")
    back = docs.select("l_orderkey", doc, F.from_json(F.get_json_object(doc, "$.Titles"), "array<map<string,string>>").alias("t"))
    of = lambda name: F.get_json_object(doc, f"$.{name}")
    read = back.select(
        "l_orderkey", of("Index").alias("disc"), of("Format").alias("format"), F.size("t").cast("bigint").alias("titles"), F.size(F.filter("t", lambda t: F.map_contains_key(t, "Item"))).cast("bigint").alias("items"),
        F.filter(F.transform("t", lambda t: t["Size"].cast("bigint")), lambda x: x.isNotNull()).alias("sizes"), F.array_join(F.transform("t", lambda t: F.concat(t["Index"], F.lit(":"), F.coalesce(t["Item"], F.lit("-")))), " ").alias("shown"),
    )
    size = F.aggregate("sizes", F.lit(None).cast("bigint"), lambda s, x: F.coalesce(s, F.lit(0)) + x)
    return read.select("l_orderkey", "disc", "format", "titles", "items", size.alias("size"), F.when(F.col("shown") != "", F.col("shown")).alias("shown"))


@_query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate, o_orderkey) AS INT) AS display_rank FROM orders")
def stable_display_sort(spark, sf_dir):
    return identify.display_rank(_t(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "display_rank")


_ROLES_BY_KEY = ("Main", "Trailer", "Other", "Featurette")
_LIBRARY_SQL = _PATH_SQL.replace("CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END AS tvdb", "CAST(NULL AS BIGINT) AS tvdb").replace("o_orderkey % 24 + 1 AS e", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 24 + 1 ELSE 1 END AS e")
_LIBRARY_FOLDERS = {"jellyfin": ("trailers", "extras", "featurettes"), "plex": ("Trailers", "Other", "Featurettes"), "kodi": ("", "extras", "extras")}


def _register_library() -> None:
    for scheme, folders in _LIBRARY_FOLDERS.items():

        def paths(spark, sf_dir, scheme=scheme):
            c, key = F.col, F.col("o_orderkey")
            kind = F.when(key % 5 == 0, "Series").otherwise("Movie")
            path = plan.library_path(
                scheme, F.lit("/lib/"), kind, _nth(_ROLES_BY_KEY, key % 4), c("title"), c("year"), c("imdb"), c("tmdb"), c("season"), F.when(key % 3 > 0, c("episode")), c("name"), key % 6 == 0, F.concat(F.lit("Extra: "), key.cast("string"))
            )
            return _path_rows(spark, sf_dir).select("o_orderkey", path.alias("path"))

        QUERIES[f"library_path_{scheme}"] = paths
        shows = f"'/lib/Shows/' || t || y || {_EPISODE_TAGS[scheme]} || {_SEASON} || {_EPISODE_FILES[scheme]} || '.mkv'"
        inside = "CASE o_orderkey % 4 " + " ".join(f"WHEN {n + 1} THEN '{f}/'" for n, f in enumerate(folders)) + " END"
        extra = f"'/lib/Movies/' || t || y || tag || '/' || {inside} || 'Extra ' || o_orderkey || '.mkv'"
        if scheme == "kodi":
            extra = f"CASE o_orderkey % 4 WHEN 1 THEN '/lib/Movies/' || t || y || tag || '/' || t || y || tag || '-trailer.mkv' ELSE {extra} END"
        movie = "'/lib/Movies/' || t || y || tag || '/' || t || y || tag || CASE WHEN o_orderkey % 6 = 0 THEN ' - 3D' ELSE '' END || '.mkv'"
        path = f"CASE WHEN o_orderkey % 5 = 0 THEN {shows} WHEN o_orderkey % 4 = 0 THEN {movie} ELSE {extra} END"
        ORACLES[f"library_path_{scheme}"] = _LIBRARY_SQL.replace("{tag}", _MOVIE_TAGS[scheme]).replace("{path}", path).replace("{{", "{").replace("}}", "}")


_register_library()


@_query("""WITH e AS (SELECT l_orderkey AS o_orderkey, CASE WHEN max(l_returnflag) <> 'R' THEN max(l_returnflag) END AS display_title, min(l_returnflag) AS role, max(l_linestatus) AS format FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, display_title, role, CASE WHEN o_orderkey % 2 = 0 THEN format END AS format FROM orders LEFT JOIN e USING (o_orderkey)""")
def title_edits(spark, sf_dir):
    flag = F.max("l_returnflag")
    edits = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(flag == "R", "  ").otherwise(flag).alias("display_title"), F.lit("").alias("episode_title"), F.min("l_returnflag").alias("role"), F.max("l_linestatus").alias("format"),
    )
    return plan.with_edits(_t(spark, sf_dir, "orders").select("o_orderkey"), edits, ["o_orderkey"], F.col("o_orderkey") % 2 == 0).select("o_orderkey", "display_title", "role", "format")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS ripped, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END AS looked_up,
CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS filled FROM part""")
def title_precedence(spark, sf_dir):
    key, c = F.col("p_partkey"), F.col
    typed, item = F.when(key % 3 == 0, c("p_name")).otherwise(" "), F.when(key % 5 != 0, c("p_type"))
    shown = F.when(key % 2 == 0, F.lit(" ")).otherwise(c("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", plan.rip_title(typed, item, c("p_brand")).alias("ripped"), plan.overwritten(c("p_name"), F.when(key % 7 == 0, c("p_type"))).alias("looked_up"), plan.filled(shown, c("p_brand")).alias("filled"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE w END AS prefilled, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 2 = 1 THEN p_size END AS prefilled_season, CASE WHEN p_partkey % 2 = 1 THEN w ELSE replace(p_name, ' ', '_') END AS title,
CASE WHEN p_partkey % 2 = 1 THEN p_size ELSE 1 END AS season FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS w FROM part)""")
def unidentified_naming(spark, sf_dir):
    key, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    series = key % 2 == 1
    label = F.when(series, F.concat(name, F.lit("_S"), F.col("p_size").cast("string"))).otherwise(name)
    shown, given = plan.prefilled_title(F.when(key % 4 == 0, F.col("p_brand")), label), plan.default_naming(F.when(series, "Series").otherwise("Movie"), label)
    return _t(spark, sf_dir, "part").select("p_partkey", shown["title"].alias("prefilled"), shown["season"].alias("prefilled_season"), given["title"].alias("title"), given["season"].alias("season"))


@_query("""WITH e AS (SELECT user_id, event_id, value, CASE WHEN event_type <> 'signup' THEN event_type END AS t FROM events) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id, t) AS INT) AS episode_rank FROM e WHERE t IS NOT NULL""")
def named_episodes(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("t"))
    return plan.named_episodes(rows, ["user_id"], "event_id", "t").select("user_id", "event_id", "episode_rank")


@_query("""SELECT o_custkey, o_orderkey, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) ELSE false END AS selected FROM orders""")
def quick_selected(spark, sf_dir):
    mode = _nth(("all", "main", "none"), F.col("o_custkey") % 3)
    return plan.quick_selected(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", mode).select("o_custkey", "o_orderkey", "selected")


@_query("""SELECT l_orderkey, coalesce(bool_or(l_returnflag = 'R' AND l_linestatus = 'F'), false) AS encrypted FROM lineitem GROUP BY l_orderkey""")
def encrypted_discs(spark, sf_dir):
    path = F.when(F.col("l_returnflag") == "R", "BDMV/aacs").otherwise("BDMV/STREAM/AACS")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path"), (F.col("l_linestatus") == "F").alias("is_dir"))
    return plan.is_encrypted(rows, ["l_orderkey"], "path", "is_dir")
