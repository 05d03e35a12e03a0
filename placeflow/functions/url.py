"""Links: parts, source apps, normal forms, content ids and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of known apps, and parameters that only track
APPS = {
    "tiktok": "tiktok", "instagram": "instagram", "youtube": "youtube", "youtu": "youtube", "twitter": "twitter", "x": "twitter",
    "facebook": "facebook", "reddit": "reddit", "tripadvisor": "tripadvisor", "yelp": "yelp", "google": "google",
}
CACHE_PARAMS = ("_r", "_t", "_d", "_svg", "igsh", "igshid", "utm_source", "utm_medium", "utm_campaign", "fbclid", "ref", "share_id", "g_st", "g_ep", "entry", "coh", "skid")
PARAMS = (*CACHE_PARAMS, "ig_rid", "utm_content", "utm_term", "img_index")

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike(_HEAD + r"[^/?#\s]+"), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))


def without_www(text: Column) -> Column:
    """The text without the first www. in it."""
    return F.regexp_replace(text, r"^(.*?)www\.", "$1")


def domain(url: Column) -> Column:
    """The first label of the host without www.; 'unknown' where there is no host."""
    return F.when(valid(url), F.coalesce(F.nullif(F.split_part(without_www(host(url)), F.lit("."), F.lit(1)), F.lit("")), host(url))).otherwise("unknown")


def source_app(url: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in APPS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, domain(url)), F.lit("other"))


def _origin(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(url, _HEAD + r"(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    return F.concat(scheme, F.lit("://"), host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))


def _rest(url: Column, drop: tuple[str, ...]) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*drop)), "&")
    return F.concat(path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def normalize(url: Column) -> Column:
    """Origin without www., path without closing slashes, the query without tracking parameters, no fragment.

    A link without a host only loses its closing slashes. Query text is kept as it is written.
    """
    return F.when(valid(url), F.concat(without_www(_origin(url)), _rest(url, PARAMS))).otherwise(F.regexp_replace(url, r"/+$", ""))


def cache_form(url: Column) -> Column:
    """The key form: keeps www., drops fewer parameters; a link without a host stays as it is."""
    return F.when(valid(url), F.concat(_origin(url), _rest(url, CACHE_PARAMS))).otherwise(url)


# fixed values: the patterns below are the forms of these platforms' links
def content_id(url: Column) -> Column:
    """platform:id of a video, photo or post link, else null."""
    found = lambda name, pattern: F.concat(F.lit(f"{name}:"), F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")))
    return F.coalesce(
        found("tiktok", r"tiktok\.com.*/(?:video|photo)/(\d+)"),
        found("instagram", r"instagram\.com/(?:p|reel|tv)/([A-Za-z0-9_-]+)"),
        found("youtube", r"(?:youtube\.com/.*[?&]v=|youtu\.be/|youtube\.com/shorts/)([A-Za-z0-9_-]+)"),
    )


def is_maps(url: Column) -> Column:
    return url.contains("google.com/maps") | url.contains("maps.google") | url.contains("goo.gl/maps") | url.contains("maps.app.goo.gl")


def _decoded(text: Column) -> Column:
    """Percent escapes decoded, then every plus a space; null where an escape is malformed."""
    return F.replace(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit(" "))


# fixed values: the patterns below are the forms of these platforms' links
def maps_place(url: Column) -> Column:
    """struct(name, lat, lng) of a maps link, else null. A coordinate of exactly 0 counts as missing."""
    got = lambda pattern, k=1: F.nullif(F.regexp_extract(url, pattern, k), F.lit(""))
    name = F.coalesce(F.nullif(_decoded(got(r"/place/([^/@]+)")), F.lit("")), _decoded(got(r"[?&]q=([^&]+)")), F.lit(""))
    lat, lng = (got(r"@(-?\d+\.?\d*),(-?\d+\.?\d*)", k).try_cast("double") for k in (1, 2))
    some = (name != "") | F.coalesce((lat != 0) & (lng != 0), F.lit(False))
    return F.when(is_maps(url) & some, F.struct(name.alias("name"), lat.alias("lat"), lng.alias("lng")))


def feature_id(url: Column) -> Column:
    """The 0x..:0x.. feature id in a place link, else null."""
    return F.nullif(F.regexp_extract(url, r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", 1), F.lit(""))


# fixed values: the patterns below are the forms of these platforms' links
def shortcode(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)instagram\.com/(?:[A-Za-z0-9_.]+/)?(?:p|reel)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def uploader(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)instagram\.com/([A-Za-z0-9_.]+)/reel/", 1)


# fixed values: the patterns below are the forms of these platforms' links
def link_kind(url: Column) -> Column:
    """Which extractor a link goes to: photo, post, reel, social or page."""
    user = r"(?i)instagram\.com/(?:[A-Za-z0-9_.]+/)?"
    return (
        F.when(url.rlike(r"tiktok\.com/@[^/]+/photo/\d+"), "photo")
        .when(url.rlike(user + r"p/[A-Za-z0-9_-]+"), "post")
        .when(url.rlike(user + r"reel/[A-Za-z0-9_-]+"), "reel")
        .when(url.contains("tiktok.com") | url.contains("instagram.com"), "social")
        .otherwise("page")
    )


def is_short(url: Column) -> Column:
    return F.coalesce(url.contains("/t/") | url.contains("vm.tiktok") | url.contains("instagr.am"), F.lit(False))


def scrub(text: Column) -> Column:
    """Tool output whose links have no query and whose credentials are hidden, at most 500 characters."""
    bare = F.regexp_replace(text, r"(https?://[^\s?]+)\?[^\s]*", "$1?[redacted]")
    hidden = F.regexp_replace(bare, r"(?i)(authorization|cookie|set-cookie|x-api-key):\s*[^\s]+", "$1: [redacted]")
    return F.substring(F.coalesce(hidden, F.lit("")), 1, 500)
