"""Records of social posts from their pages: carousels from an embed page, reels from a page's tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U
from .text import caption, decoded, hashtags, slide_links, trim, unescaped

# fixed values: a JSON string's body, and the patterns of an embed page
STRING = r"((?:[^\"\\]|\\.)*)"
DISPLAY = rf'"display_url":"{STRING}"'
CAPTION = rf'"edge_media_to_caption":\{{"edges":\[\{{"node":\{{"text":"{STRING}"'
OWNER = r'"owner":\{[^}]*?"username":"([^"]+)"'
TAG = '<meta property="og:{}"[^>]*content="([^"]+)"'


def once(value: Column, f) -> Column:
    """f of a value that is computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _record(title: Column, description: Column, uploader: Column, link: Column, slides: Column) -> Column:
    return F.struct(
        title.alias("title"), description.alias("description"), F.coalesce(F.get(slides, F.lit(0)), F.lit("")).alias("thumbnail_url"), uploader.alias("uploader"), hashtags(description).alias("hashtags"), link.alias("webpage_url"),
        F.lit(None).cast("string").alias("location"), (F.size(slides) > 1).alias("is_carousel"), F.size(slides).alias("slide_count"), slides.alias("slide_thumbnails"), F.lit(None).cast("string").alias("subtitles"),
    )


def carousel_post(html: Column, url: Column) -> Column:
    """The record of a post's embed page: its different images (at most 20), caption, owner and hashtags; null without a shortcode or an image.

    The page's JSON stands inside a script's string, so slashes and quotes are escaped twice; both layers are peeled.
    """
    peeled = F.replace(F.replace(F.replace(F.coalesce(html, F.lit("")), F.lit("\\\\/"), F.lit("/")), F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"'))
    code = U.shortcode(url)

    def read(page: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(page, F.lit(DISPLAY), F.lit(1)), unescaped), lambda u: u.startswith("https://scontent"))
        return F.struct(slide_links(found).alias("slides"), unescaped(F.regexp_extract(page, CAPTION, 1)).alias("said"), F.regexp_extract(page, OWNER, 1).alias("owner"))

    def record(p: Column) -> Column:
        title = F.coalesce(F.nullif(F.substring(p["said"], 1, 80), F.lit("")), trim(F.concat(F.lit("Post by "), p["owner"])))
        return F.when(F.size(p["slides"]) > 0, _record(title, p["said"], p["owner"], F.concat(F.lit("https://www.instagram.com/p/"), code, F.lit("/")), p["slides"]))

    return F.when(code.isNotNull(), once(once(peeled, read), record))


def reel_post(html: Column, url: Column) -> Column:
    """The record of a reel's page from its tags: the caption without its engagement prefix, owner and hashtags; null without a shortcode, or without title and description."""
    code = U.shortcode(url)
    tag = lambda k: F.regexp_extract(F.coalesce(html, F.lit("")), TAG.format(k), 1)
    raw = F.struct(*[decoded(tag(k)).alias(k) for k in ("description", "title", "image", "url")])

    def read(t: Column) -> Column:
        said = F.coalesce(F.nullif(caption(t["description"]), F.lit("")), t["title"])
        link = F.coalesce(F.nullif(t["url"], F.lit("")), F.concat(F.lit("https://www.instagram.com/reel/"), code, F.lit("/")))
        owner = F.coalesce(F.nullif(U.uploader(link), F.lit("")), U.uploader(url), F.lit(""))
        return F.struct(said.alias("said"), link.alias("link"), owner.alias("owner"), t["title"].alias("title"), t["image"].alias("image"), ((t["description"] != "") | (t["title"] != "")).alias("some"))

    def record(p: Column) -> Column:
        title = trim(F.coalesce(F.nullif(F.substring(p["said"], 1, 80), F.lit("")), F.nullif(p["title"], F.lit("")), F.concat(F.lit("Reel by "), p["owner"])))
        slides = F.when(p["image"] != "", F.array(p["image"])).otherwise(F.array().cast("array<string>"))
        return F.when(p["some"], _record(title, p["said"], p["owner"], p["link"], slides).withField("slide_count", F.lit(1)))

    return F.when(code.isNotNull(), once(once(raw, read), record))
