"""Queries over links and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import posts as K
from ..functions import state as S
from ..functions import text as X
from ..functions import url as U
from ..functions import variant as V
from ..operators import dedup
from ..sources import lookup
from ..sources.tables import frame
from .registry import query, rows, spread, spread_sql, values

LINKS = [
    (-1, "https://www.tiktok.com/@ann/video/7301?_t=8&lang=en"), (-2, "https://vm.tiktok.com/ZM1/"), (-3, "https://www.instagram.com/reel/Cx_1-a/?igsh=1"), (-4, "https://youtu.be/abc_9?ref=x"),
    (-5, "https://m.youtube.com/watch?v=Q1&t=3"), (-6, "HTTPS://WWW.Yelp.com:443/biz/joe//#top"), (-7, "not a link/"), (-8, "https://www.tiktok.com/@bo/photo/99"), (-9, "https://www.instagram.com/bo/p/Zz1/?img_index=2&x=1"),
    (-10, "https://www.google.com/maps/place/Caf%C3%A9+A%2BB/@40.5,-73.25,17z/data=!1s0x89c2:0x1f"), (-11, "https://maps.google.com/?q=Joe%27s+Pizza&z=1"), (-12, "https://www.google.com/maps/@0,0,3z"), (-13, "http://localhost:8080/a/?b=1"), (-14, "https://x.com/t/1"),
]
_L = f"(SELECT id, url FROM <links> UNION ALL SELECT id, url FROM {values(LINKS, 'id', 'url')} v)"
_HEAD = r"regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+')"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_BARE = rf"regexp_replace({_HOST}, '^(.*?)www\.', '\1')"
_DOMAIN = f"CASE WHEN {_HEAD} THEN coalesce(nullif(split_part({_BARE}, '.', 1), ''), {_HOST}) ELSE 'unknown' END"
_APP = f"CASE {_DOMAIN} WHEN 'youtu' THEN 'youtube' WHEN 'x' THEN 'twitter' ELSE CASE WHEN {_DOMAIN} IN ('tiktok','instagram','youtube','twitter','facebook','reddit','tripadvisor','yelp','google') THEN {_DOMAIN} ELSE 'other' END END"


def _kept(names: tuple[str, ...]) -> str:
    path = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
    kept = r"array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN (" + ", ".join(f"'{n}'" for n in names) + ")), '&')"
    return f"{path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


_ORIGIN = rf"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || CASE WHEN regexp_matches(url, '^(?i:https)://[^/?#]*:443([/?#]|$)|^(?i:http)://[^/?#]*:80([/?#]|$)') THEN '' ELSE coalesce(':' || nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:(\d+)', 1), ''), '') END"
_NORMAL = rf"CASE WHEN {_HEAD} THEN regexp_replace({_ORIGIN}, '^(.*?)www\.', '\1') || {_kept(U.PARAMS)} ELSE regexp_replace(url, '/+$', '') END"
_CACHE = f"CASE WHEN {_HEAD} THEN {_ORIGIN} || {_kept(U.CACHE_PARAMS)} ELSE url END"
_CID = r"""coalesce('tiktok:' || nullif(regexp_extract(url, 'tiktok\.com.*/(?:video|photo)/(\d+)', 1), ''), 'instagram:' || nullif(regexp_extract(url, 'instagram\.com/(?:p|reel|tv)/([A-Za-z0-9_-]+)', 1), ''),
  'youtube:' || nullif(regexp_extract(url, '(?:youtube\.com/.*[?&]v=|youtu\.be/|youtube\.com/shorts/)([A-Za-z0-9_-]+)', 1), ''))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "links").select(F.col("id").cast("long").alias("id"), "url").unionAll(rows(spark, "id long, url string", LINKS))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "posts").unionAll(rows(spark, "post_id string, title string, description string", POSTS).select(F.col("post_id").cast("long"), "title", "description"))


POSTS = [
    ("-1", "Best ramen", "📍 Ippudo, 65 4th Ave #nyc @ippudo_ny and @annieats more https://x.y/z 12 likes"), ("-2", "Trip on TikTok", "We ate at Joe Pizza in Astoria, Queens. 'Lucali' was full | Reels"), ("-3", "", "Big Ben London, UK 10 Downing St. Great"),
    ("-4", "Tom &amp; Jerry&#39;s &#x41; &amp;lt;", "📍 Bar No. 5 (Original) 12 Main St"), ("-5", "Fish", "no signal here at all but some very plain words"), ("-6", "T", "@a_b.c @the_king @Zoo.Bar @zoo.bar @x1 @y22 @z33 @q44 @w55 #Food #food #2 #a_1"),
]
_P = f"(SELECT post_id, title, description FROM <posts> UNION ALL SELECT post_id::BIGINT, title, description FROM {values(POSTS, 'post_id', 'title', 'description')} v)"


@query(f"SELECT id::BIGINT AS id, {_DOMAIN} AS domain, {_APP} AS app FROM {_L}")
def url_domain(spark, sf_dir):
    return links(spark, sf_dir).select("id", U.domain(F.col("url")).alias("domain"), U.source_app(F.col("url")).alias("app"))


@query(f"SELECT id::BIGINT AS id, {_NORMAL} AS normal, {_CACHE} AS cache_form FROM {_L}")
def url_normalize(spark, sf_dir):
    return links(spark, sf_dir).select("id", U.normalize(F.col("url")).alias("normal"), U.cache_form(F.col("url")).alias("cache_form"))


@query(f"SELECT normal, min(id)::BIGINT AS id, arg_min(url, id) AS url FROM (SELECT id, url, {_NORMAL} AS normal FROM {_L}) GROUP BY normal")
def url_dedup_first(spark, sf_dir):
    keyed = links(spark, sf_dir).withColumn("normal", U.normalize(F.col("url")))
    return dedup.first_wins(keyed, ["normal"], ["id"]).select("normal", "id", "url")


@query(f"SELECT domain, count(*)::BIGINT AS pages, count(DISTINCT normal)::BIGINT AS links FROM (SELECT {_DOMAIN} AS domain, {_NORMAL} AS normal FROM {_L}) GROUP BY domain")
def pages_per_domain(spark, sf_dir):
    keyed = links(spark, sf_dir).select(U.domain(F.col("url")).alias("domain"), U.normalize(F.col("url")).alias("normal"))
    return keyed.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("normal").alias("links"))


@query(f"""SELECT id::BIGINT AS id, {_CID} AS content_id, CASE WHEN regexp_matches(url, 'tiktok\\.com/@[^/]+/photo/\\d+') THEN 'photo' WHEN regexp_matches(url, '(?i)instagram\\.com/(?:[A-Za-z0-9_.]+/)?p/[A-Za-z0-9_-]+') THEN 'post'
  WHEN regexp_matches(url, '(?i)instagram\\.com/(?:[A-Za-z0-9_.]+/)?reel/[A-Za-z0-9_-]+') THEN 'reel' WHEN contains(url, 'tiktok.com') OR contains(url, 'instagram.com') THEN 'social' ELSE 'page' END AS kind,
  contains(url, '/t/') OR contains(url, 'vm.tiktok') OR contains(url, 'instagr.am') AS short, nullif(regexp_extract(url, '(?i)instagram\\.com/(?:[A-Za-z0-9_.]+/)?(?:p|reel)/([A-Za-z0-9_-]+)', 1), '') AS shortcode,
  regexp_extract(url, '(?i)instagram\\.com/([A-Za-z0-9_.]+)/reel/', 1) AS uploader FROM {_L}""")
def content_id(spark, sf_dir):
    u = F.col("url")
    return links(spark, sf_dir).select("id", U.content_id(u).alias("content_id"), U.link_kind(u).alias("kind"), U.is_short(u).alias("short"), U.shortcode(u).alias("shortcode"), U.uploader(u).alias("uploader"))


@query(f"""WITH m AS (SELECT id, url, coalesce(nullif(replace(url_decode(replace(regexp_extract(url, '/place/([^/@]+)', 1), '+', '%2B')), '+', ' '), ''), replace(url_decode(replace(regexp_extract(url, '[?&]q=([^&]+)', 1), '+', '%2B')), '+', ' ')) AS name,
  TRY_CAST(regexp_extract(url, '@(-?\\d+\\.?\\d*),(-?\\d+\\.?\\d*)', 1) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(url, '@(-?\\d+\\.?\\d*),(-?\\d+\\.?\\d*)', 2) AS DOUBLE) AS lng FROM {_L}
  WHERE contains(url, 'google.com/maps') OR contains(url, 'maps.google') OR contains(url, 'goo.gl/maps') OR contains(url, 'maps.app.goo.gl'))
  SELECT id::BIGINT AS id, name, lat, lng, nullif(regexp_extract(url, '!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1), '') AS feature_id FROM m WHERE name <> '' OR (lat <> 0 AND lng <> 0)""")
def maps_url_parse(spark, sf_dir):
    got = links(spark, sf_dir).select("id", U.maps_place(F.col("url")).alias("m"), U.feature_id(F.col("url")).alias("feature_id")).filter("m is not null")
    return got.select("id", "m.name", "m.lat", "m.lng", "feature_id")


PAGES = [
    (-1, """<meta property="og:title" content="Joe's &amp; Co"><meta content='A place' name="description"><title> T </title>"""), (-2, """<meta name='twitter:title' content='Tw'><meta property="og:image" content="i.png"/>"""),
    (-3, """<TITLE lang="en"> Only &quot;title&quot; </TITLE>"""), (-4, "no head"),
]


def _meta(name: str) -> str:
    quote = """["'']"""
    k, v = f"(?:property|name)={quote}{name}{quote}", f"content={quote}([^{quote[1:-1]}]*){quote}"
    return rf"coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*{k}[^>]*{v}', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]*{v}[^>]*{k}', 1), ''))"


def _named(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&nbsp;', ' ')"


@query(f"""WITH h AS (SELECT page_id AS id, html FROM pages UNION ALL SELECT id, html FROM {values(PAGES, 'id', 'html')} v)
SELECT id::BIGINT AS id, coalesce({_named(_meta('og:title'))}, {_named(_meta('twitter:title'))}, {_named("trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), chr(32) || chr(9) || chr(10) || chr(13))")}, '') AS title,
  coalesce({_named(_meta('og:description'))}, {_named(_meta('twitter:description'))}, {_named(_meta('description'))}, '') AS description, coalesce({_named(_meta('og:image'))}, {_named(_meta('twitter:image'))}, '') AS image FROM h""")
def page_title_og(spark, sf_dir):
    pages = frame(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "html").unionAll(rows(spark, "id long, html string", PAGES))
    return pages.select("id", X.page_card(F.col("html"), F.lit("")).alias("c")).select("id", "c.title", "c.description", "c.image")


@query(f"""SELECT post_id::BIGINT AS post_id, array_to_string(list_filter(list_transform(regexp_extract_all(description, '@([a-zA-Z0-9_.]{{3,30}})', 1), lambda h: lower(h)), lambda h: true), ',') AS raw_handles FROM {_P} WHERE contains(description, '@')""")
def mention_handles(spark, sf_dir):
    raw = F.regexp_extract_all("description", F.lit(r"@([a-zA-Z0-9_.]{3,30})"), F.lit(1))
    return _posts(spark, sf_dir).filter(F.col("description").contains("@")).select("post_id", F.array_join(F.transform(raw, F.lower), ",").alias("raw_handles"))


@query(f"""WITH h AS (SELECT post_id, unnest(regexp_extract_all(description, '@([a-zA-Z0-9_.]{{3,30}})', 1)) AS x, generate_subscripts(regexp_extract_all(description, '@([a-zA-Z0-9_.]{{3,30}})', 1), 1) AS i FROM {_P}),
d AS (SELECT post_id, lower(x) AS x, min(i) AS i FROM h GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY i) AS n FROM d WHERE NOT regexp_matches(x, '^@?[a-z]+_?({X.CREATORS})$') AND NOT regexp_matches(x, '^@?(the_?)?[a-z]+(_?({X.PEOPLE}))$'))
SELECT p.post_id::BIGINT AS post_id, coalesce(string_agg(x, ',' ORDER BY n) FILTER (n <= 5), '') AS mentions FROM {_P} p LEFT JOIN k ON p.post_id = k.post_id GROUP BY p.post_id""")
def mentions(spark, sf_dir):
    return _posts(spark, sf_dir).select("post_id", F.array_join(X.mentions(F.col("description")), ",").alias("mentions"))


@query(f"""WITH h AS (SELECT post_id, lower(unnest(regexp_extract_all(description, '#([a-zA-Z][a-zA-Z0-9_]*)', 1))) AS x, generate_subscripts(regexp_extract_all(description, '#([a-zA-Z][a-zA-Z0-9_]*)', 1), 1) AS i FROM {_P}),
d AS (SELECT post_id, x, min(i) AS i FROM h GROUP BY 1, 2)
SELECT p.post_id::BIGINT AS post_id, coalesce(string_agg(x, ',' ORDER BY i), '') AS tags FROM {_P} p LEFT JOIN d ON p.post_id = d.post_id GROUP BY p.post_id""")
def hashtags(spark, sf_dir):
    return _posts(spark, sf_dir).select("post_id", F.array_join(X.hashtags(F.col("description")), ",").alias("tags"))


@query()
def location_query(spark, sf_dir):
    """No oracle: the other engine's patterns have no look-around; the tests hold known values against it."""
    return _posts(spark, sf_dir).select("post_id", X.location_query(F.col("title"), F.col("description")).alias("query"), X.pin_marker(X.decoded(F.col("description"))).alias("marker"))


@query(f"""SELECT post_id::BIGINT AS post_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{{9F}}<>]|\\p{{Cf}}') THEN left(t, 256) END AS display FROM (SELECT post_id, trim(title, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279) || chr(8203 - 1)) AS t FROM {_P})""")
def sanitize_display(spark, sf_dir):
    return _posts(spark, sf_dir).select("post_id", X.display_name(F.col("title")).alias("display"))


SUBTITLES = [
    (1, "WEBVTT\nKind: captions\n\n1\n00:01.0 --> 00:02.0\n<c>hello</c> there\nhello there\n\n2\n00:03.0 --> 00:04.0\nbye <b>now</b>\nhello there"), (2, "WEBVTT\n\n3\n"), (3, "plain\nplain\nplain text"),
]


_SUBTITLES = f"(SELECT k AS id, CASE WHEN k < 0 THEN body ELSE body || chr(10) || '<i>line ' || k || '</i>' || chr(10) || 'line ' || k || chr(10) || k END AS body FROM {spread_sql(SUBTITLES, 'id', 'body')} x)"


@query(f"""WITH l AS (SELECT id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM {_SUBTITLES}),
k AS (SELECT id, i, trim(regexp_replace(x, '<[^>]+>', '', 'g')) AS x FROM l WHERE NOT (starts_with(x, 'WEBVTT') OR starts_with(x, 'Kind:') OR starts_with(x, 'Language:') OR regexp_matches(x, '^\\d{{2}}:\\d{{2}}') OR regexp_matches(trim(x), '^\\d*$'))),
d AS (SELECT id, i, x, lag(x) OVER (PARTITION BY id ORDER BY i) AS p FROM k WHERE x <> '')
SELECT s.id::BIGINT AS id, left(string_agg(d.x, ' ' ORDER BY d.i) FILTER (d.x IS DISTINCT FROM d.p), 3000) AS transcript FROM {_SUBTITLES} s LEFT JOIN d ON d.id = s.id GROUP BY s.id""")
def transcript_clean(spark, sf_dir):
    """A subtitle file for every event."""
    k = F.col("k")
    more = F.concat("body", F.lit("\n<i>line "), k, F.lit("</i>\nline "), k, F.lit("\n"), k)
    return spread(spark, sf_dir, "id long, body string", SUBTITLES).select(k.alias("id"), X.transcript(F.when(k < 0, F.col("body")).otherwise(more)).alias("transcript"))


ERRORS = ["ETIMEDOUT 10.0.0.1", "Request timeout", "HTTP 429", "rate limit hit", "Quota exceeded", "403 Forbidden", "access denied", "JSON parse failed", "invalid body", "ENOTFOUND host", "network down", "weird", "", "ERROR: Unsupported URL: https://a.b/c?sig=1", "your IP address is blocked", "This video is private", "login required; cookie: abc=1", "Video not available"]
_ERRORS = [(k + 1, e) for k, e in enumerate(ERRORS)]
_E = f"(SELECT k AS id, CASE WHEN k < 0 THEN msg ELSE msg || ' #' || (k % 1000) || ' https://h.example/' || k || '?key=' || k END AS msg FROM {spread_sql(_ERRORS, 'id', 'msg')} x)"


@query(f"""SELECT id::BIGINT AS id, CASE WHEN regexp_matches(lower(msg), 'timeout|etimedout|esockettimedout') THEN 'dependency_timeout' WHEN regexp_matches(lower(msg), '429|rate.?limit|quota|exceeded') THEN 'quota_exhausted'
  WHEN regexp_matches(lower(msg), '403|forbidden|blocked|access.?denied') THEN 'blocked' WHEN regexp_matches(lower(msg), 'parse|json|invalid') THEN 'parse_error' ELSE 'dependency_error' END AS kind,
  CASE WHEN contains(lower(msg), 'unsupported url') THEN 'UNSUPPORTED_URL_TYPE' WHEN contains(lower(msg), 'ip address is blocked') THEN 'IP_BLOCKED' WHEN contains(lower(msg), 'private') THEN 'PRIVATE'
  WHEN regexp_matches(lower(msg), 'login required|not granting access|empty media response|rate-limit|rate limit') THEN 'BLOCKED' WHEN regexp_matches(lower(msg), 'deleted|not available') THEN 'DELETED' ELSE 'UNKNOWN' END AS code,
  left(regexp_replace(regexp_replace(msg, '(https?://[^\\s?]+)\\?[^\\s]*', '\\1?[redacted]', 'g'), '(?i)(authorization|cookie|set-cookie|x-api-key):\\s*[^\\s]+', '\\1: [redacted]', 'g'), 500) AS scrubbed FROM {_E}""")
def error_kind(spark, sf_dir):
    """A message for every event."""
    k, m = F.col("k"), F.col("msg")
    told = spread(spark, sf_dir, "id long, msg string", _ERRORS).select(k.alias("id"), F.when(k < 0, m).otherwise(F.concat(m, F.lit(" #"), k % 1000, F.lit(" https://h.example/"), k, F.lit("?key="), k)).alias("msg"))
    return told.select("id", S.error_kind(m).alias("kind"), S.extractor_code(m).alias("code"), U.scrub(m).alias("scrubbed"))


_SHARES = f"""SELECT o_orderkey::BIGINT AS pos, concat('U', o_custkey % 150) AS user_id, concat('PL', (o_orderkey * 7) % 700) AS place_id, concat('https://www.tiktok.com/@u', (o_custkey * 3) % 50, '/video/', o_orderkey % 900, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '/' END) AS url FROM orders"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a link shared again."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.concat(F.lit("https://www.tiktok.com/@u"), c * 3 % 50, F.lit("/video/"), k % 900, F.when(k % 2 == 0, "").otherwise("/"))
    return frame(spark, sf_dir, "orders").select(k.cast("long").alias("pos"), F.concat(F.lit("U"), c % 150).alias("user_id"), F.concat(F.lit("PL"), k * 7 % 700).alias("place_id"), url.alias("url"))


@query(f"""WITH s AS ({_SHARES}), p AS (SELECT pin_id, user_id, place_id, url, {_NORMAL} AS normal FROM <pins>), s2 AS (SELECT *, {_NORMAL} AS normal FROM s)
SELECT s2.pos, a.pin AS by_place, b.pin AS by_url, c.pin AS by_normal, coalesce(a.pin, b.pin, c.pin) AS existing_pin, CASE WHEN a.pin IS NOT NULL THEN 'place' WHEN b.pin IS NOT NULL THEN 'url' WHEN c.pin IS NOT NULL THEN 'normal_url' ELSE 'new' END AS via FROM s2
LEFT JOIN (SELECT user_id, place_id, min(pin_id) AS pin FROM p GROUP BY 1, 2) a ON a.user_id = s2.user_id AND a.place_id = s2.place_id
LEFT JOIN (SELECT user_id, url, min(pin_id) AS pin FROM p GROUP BY 1, 2) b ON b.user_id = s2.user_id AND b.url = s2.url
LEFT JOIN (SELECT user_id, normal, min(pin_id) AS pin FROM p GROUP BY 1, 2) c ON c.user_id = s2.user_id AND c.normal = s2.normal""".replace("SELECT s2.pos, a.pin AS by_place, b.pin AS by_url, c.pin AS by_normal,", "SELECT s2.pos,"))
def dedup_precedence(spark, sf_dir):
    return dedup.existing(shares(spark, sf_dir), frame(spark, sf_dir, "pins")).select("pos", "existing_pin", "via")


@query(f"""WITH s AS (SELECT *, {_NORMAL} AS normal, {_CID} AS cid FROM ({_SHARES})), p AS (SELECT pin_id, user_id, url, {_NORMAL} AS normal, {_CID} AS cid FROM <pins>)
SELECT s.pos, coalesce(b.pin, c.pin) AS pin_by_url, d.pin AS pin_by_content FROM s LEFT JOIN (SELECT user_id, url, min(pin_id) AS pin FROM p GROUP BY 1, 2) b ON b.user_id = s.user_id AND b.url = s.url
LEFT JOIN (SELECT user_id, normal, min(pin_id) AS pin FROM p GROUP BY 1, 2) c ON c.user_id = s.user_id AND c.normal = s.normal LEFT JOIN (SELECT user_id, cid, min(pin_id) AS pin FROM p GROUP BY 1, 2) d ON d.user_id = s.user_id AND d.cid = s.cid""")
def pin_by_url_and_content(spark, sf_dir):
    pins = frame(spark, sf_dir, "pins")
    return dedup.by_content(dedup.by_url(shares(spark, sf_dir), pins), pins).select("pos", "pin_by_url", "pin_by_content")


@query()
def write_batch(spark, sf_dir):
    """No oracle: each share sees what the ones before it inserted; the tests hold it against a loop."""
    return dedup.write_batch(shares(spark, sf_dir), frame(spark, sf_dir, "pins"))


@query(f"""WITH s AS ({_SHARES}), p AS (SELECT pin_id, url FROM <pins>), j AS (SELECT s.pos, p.url AS pin_url, s.url AS share FROM s LEFT JOIN p ON p.pin_id = concat('P', s.pos + 3)),
k AS (SELECT pos, pin_url, share, (SELECT {_NORMAL} FROM (SELECT pin_url AS url)) = (SELECT {_NORMAL} FROM (SELECT share AS url)) OR coalesce((SELECT {_CID} FROM (SELECT pin_url AS url)) = (SELECT {_CID} FROM (SELECT share AS url)), false) AS known FROM j)
SELECT pos, pin_url IS NOT NULL AND NOT known AS added, CASE WHEN pin_url IS NULL OR known THEN 0 ELSE 1 END::BIGINT AS n_sources, pin_url AS url FROM k""")
def source_append(spark, sf_dir):
    """A share of a pin that doesn't exist adds nothing."""
    pins = frame(spark, sf_dir, "pins").select(F.col("pin_id"), F.col("url").alias("pin_url"), F.lit(True).alias("there"))
    both = shares(spark, sf_dir).withColumn("pin_id", F.concat(F.lit("P"), F.col("pos") + 3)).join(pins, "pin_id", "left")
    r = both.select("pos", F.when(F.col("there"), dedup.source_append(F.col("pin_url"), F.array().cast("array<string>"), F.col("url"))).alias("r"))
    return r.select("pos", F.coalesce("r.added", F.lit(False)).alias("added"), F.coalesce(F.size("r.sources"), F.lit(0)).cast("long").alias("n_sources"), "r.url")


CACHE = [("https://www.yelp.com/biz/joe", "cached", "2024-02-01 00:00:00"), ("https://x.com/t/1", "old", "2024-01-01 00:00:00"), ("https://youtu.be/abc_9", "tube", "2024-03-01 00:00:00")]
REDIRECTS = [("https://vm.tiktok.com/ZM1/", "https://youtu.be/abc_9?ref=z"), ("https://x.com/t/1", "https://youtu.be/none")]
EXTRACTS = [("https://www.tiktok.com/@ann/video/7301?_t=8&lang=en", "video"), ("https://youtu.be/none", "fresh")]


@query(f"""WITH r AS (SELECT l.id, l.url AS raw, coalesce(t.target, l.url) AS target FROM {_L} l LEFT JOIN {values(REDIRECTS, 'url', 'target')} t ON t.url = l.url),
k AS (SELECT id, raw, target, (SELECT {_CACHE} FROM (SELECT raw AS url)) AS k1, CASE WHEN contains(raw, '/t/') OR contains(raw, 'vm.tiktok') OR contains(raw, 'instagr.am') THEN (SELECT {_CACHE} FROM (SELECT target AS url)) END AS k2 FROM r),
c AS (SELECT * FROM {values(CACHE, 'key', 'value', 'expires')} WHERE expires > '2024-01-15')
SELECT k.id::BIGINT AS id, k.target, coalesce(a.value, b.value, e.post) AS post, CASE WHEN a.value IS NOT NULL THEN 'cache' WHEN b.value IS NOT NULL THEN 'canonical' WHEN e.post IS NOT NULL THEN 'extracted' ELSE 'failed' END AS via
FROM k LEFT JOIN c a ON a.key = k1 LEFT JOIN c b ON b.key = k2 LEFT JOIN {values(EXTRACTS, 'url', 'post')} e ON e.url = k.target""")
def extract_chain(spark, sf_dir):
    cache = rows(spark, "key string, value string, expires_at string", CACHE).withColumn("expires_at", F.to_timestamp("expires_at"))
    got = lookup.extract_chain(links(spark, sf_dir), cache, rows(spark, "url string, target string", REDIRECTS), rows(spark, "url string, post string", EXTRACTS), F.lit("2024-01-15").cast("timestamp"))
    return got.select("id", "target", "post", "via")


@query()
def extracted_posts(spark, sf_dir):
    """A tool's record of every post. No oracle: the record has arrays; the tests hold known values against it, and extractor_chain holds records against SQL."""
    payload = '{"title":"T","entries":[{"thumbnail":"a.jpg","description":"d #Tag"},{"thumbnails":[{"url":"b.jpg"}]}],"channel":"c"}'
    known = rows(spark, "id long, body string", [(-1, payload), (-2, "not json"), (-3, "{}")])
    t, k = F.col("title"), F.col("post_id")
    first = F.array(F.struct(t.alias("title"), F.concat(F.lit("s"), k, F.lit(".jpg")).alias("thumbnail")), F.struct(t.alias("title"), F.lit(None).cast("string").alias("thumbnail")))
    record = F.struct(F.when(k % 2 == 0, t).alias("title"), F.when(k % 3 == 0, F.col("description")).alias("description"), F.when(k % 5 == 0, F.lit("up")).alias("uploader"), F.when(k % 2 == 1, first).alias("entries"))
    every = frame(spark, sf_dir, "posts").select(k.cast("long").alias("id"), F.to_json(record).alias("body"))
    return every.unionAll(known).select("id", V.post(F.col("body")).alias("p")).select("id", "p.*")


@query()
def clean_captions(spark, sf_dir):
    """No oracle: look-around; the tests hold known values against it."""
    return _posts(spark, sf_dir).select("post_id", X.cleaned(X.decoded(F.col("description"))).alias("text"), X.name_key(F.col("title")).alias("name_key"))


_PLAIN = "trim(regexp_replace(title, '[^A-Za-z0-9# ]', ' ', 'g'))"


def _first_tags(text: str) -> str:
    """The different hashtags of a text in order, lower-cased and joined."""
    found = f"list_transform(regexp_extract_all({text}, '#([a-zA-Z][a-zA-Z0-9_]*)', 1), lambda t: lower(t))"
    return f"array_to_string(list_filter({found}, lambda t, i: list_position({found}, t) = i), ',')"


@query(f"""SELECT post_id::BIGINT AS post_id, CASE WHEN k % 4 > 0 THEN CASE WHEN t <> '' THEN left(t, 80) ELSE 'Post by u' || k % 50 END END AS title, CASE WHEN k % 4 > 0 THEN 'u' || k % 50 END AS uploader, CASE WHEN k % 4 > 0 THEN 'https://www.instagram.com/p/C' || k || '/' END AS link,
  CASE WHEN k % 4 > 0 THEN k % 4 > 1 END AS carousel, CASE WHEN k % 4 > 0 THEN array_to_string(list_transform(range(1, k % 4 + 1), lambda i: 'https://scontent.x/' || (100000 + k) || '_' || i || '_2_n.jpg?s=a'), ',') END AS slides, CASE WHEN k % 4 > 0 THEN {_first_tags('t')} END AS tags FROM (SELECT post_id, post_id AS k, {_PLAIN} AS t FROM <posts>)""")
def carousel_posts(spark, sf_dir):
    """An embed page for every post, with no to three images, each in two sizes."""
    k, t = F.col("post_id").cast("long"), F.trim(F.regexp_replace("title", "[^A-Za-z0-9# ]", " "))
    name = lambda i, size: F.concat(F.lit('\\"display_url\\":\\"https:\\\\/\\\\/scontent.x\\\\/'), 100000 + k, F.lit("_"), i, F.lit(f'_2_n.jpg?s={size}\\",'))
    images = F.array_join(F.transform(F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(name(i, "a"), name(i, "b"))), "")
    html = F.concat(F.lit('<script>"{\\"owner\\":{\\"id\\":\\"1\\",\\"username\\":\\"u'), k % 50, F.lit('\\"},'), images, F.lit('\\"edge_media_to_caption\\":{\\"edges\\":[{\\"node\\":{\\"text\\":\\"'), t, F.lit('\\"}}]}}"</script>'))
    p = frame(spark, sf_dir, "posts").select("post_id", K.carousel_post(html, F.concat(F.lit("https://www.instagram.com/joe/p/C"), k, F.lit("/?x=1"))).alias("p"))
    return p.select(F.col("post_id").cast("long").alias("post_id"), "p.title", "p.uploader", F.col("p.webpage_url").alias("link"), F.col("p.is_carousel").alias("carousel"), F.array_join("p.slide_thumbnails", ",").alias("slides"), F.array_join("p.hashtags", ",").alias("tags"))


@query(f"""SELECT post_id::BIGINT AS post_id, CASE WHEN t <> '' OR k % 3 > 0 THEN left(CASE WHEN k % 3 > 0 AND t <> '' THEN t WHEN k % 3 > 0 THEN 'Title' ELSE t END, 80) END AS title, CASE WHEN t <> '' OR k % 3 > 0 THEN CASE WHEN k % 2 = 0 THEN 'bo' ELSE 'joe' END END AS uploader,
  CASE WHEN t <> '' OR k % 3 > 0 THEN CASE WHEN k % 2 = 0 THEN 'https://www.instagram.com/bo/reel/R' || k || '/' ELSE 'https://www.instagram.com/reel/R' || k || '/' END END AS link, CASE WHEN t <> '' OR k % 3 > 0 THEN {_first_tags("CASE WHEN t <> '' THEN t ELSE 'Title' END")} END AS tags FROM (SELECT post_id, post_id AS k, {_PLAIN} AS t FROM <posts>)""")
def reel_posts(spark, sf_dir):
    """A reel's page for every post: the caption after an engagement prefix, with or without a title and a canonical link."""
    k, t = F.col("post_id").cast("long"), F.trim(F.regexp_replace("title", "[^A-Za-z0-9# ]", " "))
    said = F.when(t != "", F.concat(F.lit('<meta property="og:description" content="'), k, F.lit(" likes - joe on May 1: &quot;"), t, F.lit('&quot;">'))).otherwise("")
    html = F.concat(said, F.when(k % 3 > 0, '<meta property="og:title" content="Title">').otherwise(""), F.when(k % 2 == 0, F.concat(F.lit('<meta property="og:url" content="https://www.instagram.com/bo/reel/R'), k, F.lit('/">'))).otherwise(""))
    p = frame(spark, sf_dir, "posts").select("post_id", K.reel_post(html, F.concat(F.lit("https://www.instagram.com/joe/reel/R"), k, F.lit("/"))).alias("p"))
    return p.select(F.col("post_id").cast("long").alias("post_id"), "p.title", "p.uploader", F.col("p.webpage_url").alias("link"), F.array_join("p.hashtags", ",").alias("tags"))
