"""Captions and names: cleaning, mentions, place signals, transcripts, page titles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space as browsers' scripts see it: 25 code points.
SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_IN, _OUT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# fixed values: neighbourhoods, and endings of handles that name people and not venues
AREAS = (
    "sunnyside", "astoria", "williamsburg", "bushwick", "greenpoint", "ridgewood", "flushing", "jackson heights", "elmhurst", "chinatown", "soho", "tribeca",
    "lower east side", "upper west side", "east village", "west village", "brooklyn", "queens", "bronx", "manhattan", "harlem", "midtown",
)
CREATORS = "eats|eater|foodie|foodies|tasteof|diaries|diary|adventures|travels|traveler|explores|official|real|fan|life|journey|blog|vlog|world|girl|guy|tv"
PEOPLE = "bun|boo|babe|bby|mama|dad|king|queen|ling"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def match_form(text: Column) -> Column:
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _numeric_entities(text: Column) -> Column:
    """&#65; and &#x41; as characters; what names no character stays as it is written."""

    def code(part: Column) -> Column:
        of = lambda pattern: F.nullif(F.regexp_extract(part, pattern, 1), F.lit(""))
        n = F.coalesce(F.conv(of(r"^x0*([0-9a-fA-F]{1,6});"), 16, 10), of(r"^0*([0-9]{1,7});")).cast("long")
        return F.struct(part.alias("part"), F.when((n < 0x110000) & ~n.between(0xD800, 0xDFFF), n).alias("n"))

    # the mark says which way round the bytes stand, and goes
    char = lambda n: F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    read = lambda x: F.when(x["n"].isNull(), F.concat(F.lit("&#"), x["part"])).otherwise(F.concat(char(x["n"]), F.regexp_replace(x["part"], "^[^;]*;", "")))
    return F.array_join(F.transform(F.split(text, "&#"), lambda part, i: F.when(i == 0, part).otherwise(_once(code(part), read))), "")


def decoded(text: Column) -> Column:
    """HTML entities decoded: numeric ones, then quot, amp, lt, gt, apos, nbsp in this order."""
    out = _numeric_entities(text)
    for name, char in (("quot", '"'), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("apos", "'"), ("nbsp", " ")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def _replaced(text: Column, pattern: str, to: str, need: str | None) -> Column:
    """A pattern replaced; it runs over the texts alone that hold what it needs, in letters of either case."""
    if need is None:
        return F.regexp_replace(text, pattern, to)
    cased = F.lower if need.isascii() and need.lower() != need.upper() else lambda t: t
    return _once(text, lambda t: F.when(cased(t).contains(need), F.regexp_replace(t, pattern, to)).otherwise(t))


# fixed values: the patterns below say what counts as such a part of a caption
def cleaned(text: Column) -> Column:
    """A caption without emoji, tags, handles, links, app names and like counts."""
    steps = (
        (r"[\x{1F600}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F300}-\x{1F5FF}]", ""), (r"#[A-Za-z0-9_]+", ""), (r"@[A-Za-z0-9_]+", ""), (r"https?://[^\s]+", ""), (r"[|•·—–]", " "),
        (rf"(?i){_IN}on Instagram{_OUT}", ""), (rf"(?i){_IN}on TikTok{_OUT}", ""), (rf"(?i){_IN}Reels?{_OUT}", ""),
        (rf"(?i){_IN}likes?,?\s*\d+\s*comments?{_OUT}", ""), (rf"(?i)\d+\s*likes?{_OUT}", ""),
    )
    needs = (None, "#", "@", "://", None, "on instagram", "on tiktok", "reel", "like", "like")
    for (pattern, to), need in zip(steps, needs):
        text = _replaced(text, pattern, to, need)
    return collapsed(text)


@pandas_udf(StringType())
def _plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ"), na_action="ignore")


def name_key(name: Column) -> Column:
    """A name's key: accents stripped, lower case, other marks spaces. Only names beyond ASCII are sent to Python."""
    plain = F.coalesce(_plain(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)
    return F.coalesce(collapsed(F.regexp_replace(F.lower(plain), rf"[^a-z0-9\s\x{{A0}}]", " ")), F.lit(""))


def mentions(text: Column) -> Column:
    """The first five distinct handles that look like venues."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"@([a-zA-Z0-9_.]{3,30})"), F.lit(1))
    handles = F.array_distinct(F.transform(raw, F.lower))
    person = lambda h: h.rlike(rf"^@?[a-z]+_?({CREATORS})$") | h.rlike(rf"^@?(the_?)?[a-z]+(_?({PEOPLE}))$")
    return F.slice(F.filter(handles, lambda h: ~person(h)), 1, 5)


def hashtags(text: Column) -> Column:
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#([a-zA-Z][a-zA-Z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.transform(raw, F.lower))


# fixed values: the patterns below say what counts as such a part of a caption
def pin_marker(text: Column) -> Column:
    """The name after a pin mark, cut where an address begins (past its fourth character); null under two characters."""
    kinds = "St|Ave|Blvd|Rd|Dr|Ln|Way|Pl|Ct|Sec|Lane|Alley"
    cuts = (rf"(?i){_IN}No\.\s*\d", rf"(?i){_IN}\d+\s+[A-Za-z0-9_]+\s+({kinds}){_OUT}", rf"(?i)\(\s*(Original|Main|Branch|Location){_OUT}", r",\s*\d")

    def marked(whole: Column) -> Column:
        name = F.regexp_extract(whole, r"📍\s*([^\n]{2,120})", 1)
        for pattern in (r"#[A-Za-z0-9_]+", r"@[A-Za-z0-9_]+", r"https?://[^\s]+"):
            name = F.regexp_replace(name, pattern, "")
        return F.when(whole.contains("📍"), trim(name))

    def ends(name: Column) -> Column:
        at = F.coalesce(*[F.nullif(F.greatest(F.regexp_instr(name, F.lit(p)), F.lit(4)), F.lit(4)) for p in cuts])
        return F.struct(name.alias("name"), at.alias("at"))

    cut = lambda x: F.when(x["at"].isNotNull(), F.regexp_replace(F.substr(x["name"], F.lit(1), x["at"] - 1), r"[,\s]+$", "")).otherwise(x["name"])
    # each step's result is computed once: they are used many times over
    return _once(_once(_once(_once(text, marked), ends), cut), lambda name: F.when(F.length(name) >= 2, name))


# fixed values: the patterns below say what counts as such a part of a caption
def place_signals(text: Column) -> Column:
    """array<struct<priority, name>>: quoted names (2), names after at, in or @ (3), pairs of capitalised words (4)."""
    as_ = lambda p, names: F.transform(names, lambda n: F.struct(F.lit(p).alias("priority"), n.alias("name")))
    quoted = F.transform(F.regexp_extract_all(text, F.lit("[\"']([^\"']{3,50})[\"']"), F.lit(1)), trim)
    after = F.transform(F.regexp_extract_all(text, F.lit(r"(?:at|in|@)\s+([A-Z][A-Za-z\s'&]{2,40})"), F.lit(1)), trim)
    proper = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1)), lambda n: (F.length(n) > 4) & (F.length(n) < 50))
    return F.concat(as_(2, quoted), as_(3, after), as_(4, proper))


def best_signal(signals: Column) -> Column:
    """The name of least priority, the longest of those, the first of those."""
    keyed = F.transform(signals, lambda s, i: F.struct(s["priority"].alias("p"), (-F.length(s["name"])).alias("l"), i.alias("i"), s["name"].alias("name")))
    return F.get(F.array_sort(keyed), F.lit(0))["name"]


# fixed values: the patterns below say what counts as such a part of a caption
def places_named(text: Column) -> Column:
    """Neighbourhoods, street addresses and City, ST in a text, in this order."""
    area = rf"(?i){_IN}({'|'.join(AREAS)}){_OUT}"
    street = rf"{_IN}(\d{{1,5}}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:St|Ave|Blvd|Rd|Dr|Ln|Way|Pl|Ct){_OUT}\.?)"
    town = rf"{_IN}([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{{2}}){_OUT}"
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), trim) for p in (area, street, town)])


def location_query(title: Column, description: Column) -> Column:
    """What to search for: a pin mark, else the best signal, with the first location; else locations; else seven words."""
    def clean(x: Column) -> Column:
        return F.struct(x["title"].alias("title"), x["text"].alias("text"), cleaned(x["title"]).alias("a"), cleaned(x["text"]).alias("b"))

    def found(x: Column) -> Column:
        both = F.concat_ws(" ", x["a"], x["b"])
        name = F.coalesce(pin_marker(x["text"]), pin_marker(x["title"]), best_signal(F.concat(place_signals(x["a"]), place_signals(x["b"]))), F.lit(""))
        return F.struct(both.alias("both"), name.alias("name"), places_named(both).alias("where"))

    def query(x: Column) -> Column:
        name, where, first = x["name"], x["where"], F.get(x["where"], F.lit(0))
        with_place = F.when(first.isNotNull() & ~F.lower(name).contains(F.lower(first)), F.concat(name, F.lit(" "), first)).otherwise(name)
        words = F.array_join(F.slice(F.filter(F.split(x["both"], " "), lambda w: F.length(w) > 2), 1, 7), " ")
        return F.substring(F.when(name != "", with_place).when(first.isNotNull(), F.array_join(where, " ")).otherwise(words), 1, 80)

    raw = F.struct(decoded(title).alias("title"), decoded(description).alias("text"))
    return _once(_once(_once(raw, clean), found), query)


def display_name(text: Column, most: int = 256) -> Column:
    """The trimmed text's first `most` code points, or null if it is empty or holds controls (a tab may stand), format characters or angle brackets."""
    t = trim(text)
    return F.when((t != "") & ~t.rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x9F<>]|\p{Cf}"), F.substring(t, 1, most))


def event_field(text: Column, most: int = 256) -> Column:
    return F.coalesce(display_name(F.substring(text, 1, most), most), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Raw content of a page's meta tag by property or name, in either order of attributes; ends at any quote."""
    key, value = rf"(?:property|name)=[\"']{re.escape(name)}[\"']", r"content=[\"']([^\"']*)[\"']"
    got = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (rf"(?i)<meta[^>]*{key}[^>]*{value}", rf"(?i)<meta[^>]*{value}[^>]*{key}")]
    return F.coalesce(*got)


def page_card(html: Column, url: Column) -> Column:
    """struct(title, description, image, url, site) of a page, '' where missing. All parts are decoded in one go."""
    title = F.nullif(trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))
    parts = {
        "title": (meta(html, "og:title"), meta(html, "twitter:title"), title),
        "description": (meta(html, "og:description"), meta(html, "twitter:description"), meta(html, "description")),
        "image": (meta(html, "og:image"), meta(html, "twitter:image")),
        "url": (meta(html, "og:url"), url),
        "site": (meta(html, "og:site_name"),),
    }
    joined = F.concat_ws("\x01", *[F.coalesce(*c, F.lit("")) for c in parts.values()])
    split = F.split(decoded(joined), "\x01")
    return F.element_at(F.transform(F.array(split), lambda x: F.struct(*[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(parts)])), 1)


def unescaped(text: Column) -> Column:
    """A JSON string body decoded; where it isn't one, common escapes are replaced."""
    by_hand = text
    for escape, char in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        by_hand = F.replace(by_hand, F.lit(escape), F.lit(char))
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>"), F.lit(0)), by_hand)


# fixed values: the patterns below say what counts as such a part of a caption
def caption(description: Column) -> Column:
    """The quoted caption after an engagement prefix, else the whole."""
    got = F.regexp_extract(description, r'(?s):\s*"(.*)"\s*\.?\s*$', 1)
    return trim(F.when(description.rlike(r'(?s):\s*".*"\s*\.?\s*$'), got).otherwise(F.coalesce(description, F.lit(""))))


def transcript(subtitles: Column) -> Column:
    """Spoken lines of a subtitle file: no headers, cues, numbers or tags; repeats of the line before go; at most 3000 characters."""
    head = lambda x: x.startswith("WEBVTT") | x.startswith("Kind:") | x.startswith("Language:") | x.rlike(r"^\d{2}:\d{2}") | trim(x).rlike(r"^\d*$")
    lines = F.filter(F.transform(F.filter(F.split(subtitles, "\n"), lambda x: ~head(x)), lambda x: trim(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")
    new = lambda every: F.filter(every, lambda x, i: (i == 0) | (x != F.get(every, i - 1)))
    return F.nullif(F.substring(F.array_join(_once(lines, new), " "), 1, 3000), F.lit(""))


def without_fences(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"```(?:json)?", ""))


def slide_links(links: Column) -> Column:
    """The first 20 images of different files: a file's name in the link, else the link without its query."""
    key = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"/(\d{6,}_\d+_\d+_n\.jpg)", 1), F.lit("")), F.substring_index(u, "?", 1))
    keyed = F.transform(links, lambda u: F.struct(key(u).alias("k"), u.alias("u")))
    return F.slice(F.transform(F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, 1, i), lambda y: y["k"] == x["k"])), lambda x: x["u"]), 1, 20)
