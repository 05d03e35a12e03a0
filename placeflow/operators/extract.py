"""Extraction of shared links: each step takes what the one before left, and what fails is told in a table beside the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import posts as K
from ..functions import state as S
from ..functions import text as X
from ..functions import url as U
from ..functions import variant as V
from ..session import written
from ..sources import lookup

POST = "struct<title:string,description:string,thumbnail_url:string,uploader:string,hashtags:array<string>,webpage_url:string,location:string,is_carousel:boolean,slide_count:int,slide_thumbnails:array<string>,subtitles:string>"
FIELDS = [f.split(":")[0] for f in POST[7:-1].split(",")]
# fixed values: the script of a photo post's page, and the messages of failed steps
PAYLOAD = r'(?s)<script[^>]*id="__UNIVERSAL_DATA_FOR_REHYDRATION__"[^>]*>(.*?)</script>'
FETCHED = {"photo": "TikTok fetch returned HTTP ", "post": "Instagram embed fetch returned HTTP ", "reel": "Instagram reel fetch returned HTTP "}
PHOTO = ("TikTok rehydration payload missing from page HTML", "Failed to parse TikTok rehydration JSON", "TikTok itemStruct not found in rehydration payload", "URL is not a TikTok photo post (no imagePost.images)")
NO_IMAGES, NO_TAGS, NO_CODE = "Instagram embed returned no carousel images", "Instagram reel page returned no OG metadata", "Could not extract Instagram shortcode"
TOOL = {"UNSUPPORTED_URL_TYPE": "This URL type is not supported yet.", "IP_BLOCKED": "Access blocked by the platform.", "PRIVATE": "This video is private.", "BLOCKED": "Temporarily blocked by the platform.", "DELETED": "This video is unavailable."}
TIMED_OUT, UNPARSED, FAILED = "Extraction timed out", "Failed to parse extraction output", "Extraction failed: "
STAGES = {"photo": "social_extraction", "post": "instagram_carousel", "reel": "instagram_reel"}
MISSING = "nothing was captured"


def _shaped(post: Column, **more: Column) -> Column:
    """A record with all fields of POST, in order."""
    return F.when(post.isNotNull(), F.struct(*[(more[f] if f in more else post[f]).alias(f) for f in FIELDS])).cast(POST)


def _photo(body: Column, link: Column) -> Column:
    """struct(post, error) of a photo post's page."""
    found = F.struct(body.rlike(PAYLOAD).alias("there"), F.regexp_extract(body, PAYLOAD, 1).alias("json"))

    def read(x: Column) -> Column:
        v = V.parsed(x["json"])
        at = lambda p, t: F.coalesce(*[F.try_variant_get(v, f'$["__DEFAULT_SCOPE__"]["{scope}"].itemInfo.itemStruct{p}', t) for scope in ("webapp.reflow.video.detail", "webapp.video-detail")])
        n = F.size(F.coalesce(at(".imagePost.images", "array<variant>"), F.array().cast("array<variant>")))
        error = F.when(~x["there"], PHOTO[0]).when(v.isNull(), PHOTO[1]).when(at("", "variant").isNull(), PHOTO[2]).when(n == 0, PHOTO[3])
        post = _shaped(V.photo_post(x["json"]), webpage_url=link, location=F.lit(None), is_carousel=n > 1, slide_count=n, subtitles=F.lit(None))
        return F.struct(F.when(error.isNull(), post).alias("post"), error.alias("error"))

    return K.once(found, read)


def _page(kind: Column, body: Column, link: Column) -> Column:
    """struct(post, error) of the page that a photo, post or reel link leads to."""
    of = lambda post, error: K.once(post, lambda p: F.struct(_shaped(p).alias("post"), F.when(p.isNull(), F.when(U.shortcode(link).isNull(), NO_CODE).otherwise(error)).alias("error")))
    return F.when(kind == "photo", _photo(body, link)).when(kind == "post", of(K.carousel_post(body, link), NO_IMAGES)).otherwise(of(K.reel_post(body, link), NO_TAGS))


def tool_error(status: Column, body: Column) -> Column:
    """The message of a tool that ended with a status other than 0 (null: it was stopped); body is what it said."""
    code, out = S.extractor_code(body), F.when(status.isNull(), TIMED_OUT)
    for name, message in TOOL.items():
        out = out.when(code == name, message)
    return out.otherwise(F.concat(F.lit(FAILED), U.scrub(body)))


def _tool(status: Column, body: Column, url: Column, subtitles: Column) -> Column:
    """struct(post, error) of the tool's answer: its JSON, or what it said when it failed."""
    ran = status.eqNullSafe(F.lit(0))
    fine = ~V.kind(V.parsed(body)).isin("absent", "null")
    post = K.once(V.post(body), lambda p: _shaped(p, webpage_url=F.coalesce(F.nullif(p["webpage_url"], F.lit("")), url), subtitles=X.transcript(subtitles)))
    error = F.when(~ran, tool_error(status, body)).when(~F.coalesce(fine, F.lit(False)), UNPARSED)
    return F.struct(F.when(error.isNull(), post).alias("post"), error.alias("error"))


def _captured(captures: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, captured, c) of some kinds: the newest capture of each link."""
    return captures.filter(F.col("kind").isin(kinds)).groupBy("kind", F.col("url").alias("captured")).agg(F.max_by(F.struct("status", "body"), "at").alias("c"))


def extract(links: DataFrame, captures: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of links (url): posts (url, canonical, via, post, title, description, image, site) and failures (url, stage, kind, message).

    Captures (url, kind, status, body, at) hold what outside services answered: pages of photo, post and reel links under
    the link that a short one leads to (kinds photo, post, reel; status is HTTP's), the tool's output and subtitles (kinds
    tool, subtitles; status is its exit code) and any link's page (kind page). Redirects (url, target) are followed once,
    for short social links. The steps:

    1. photo, post and reel links are read from their pages;
    2. other social links, and posts and reels that failed, from the tool's output;
    3. the rest, pages and all that failed, from the tags of its page, which never fails: without one all fields are empty.

    Each step is written and read again, and the next one takes those that failed. A failed step gives one row of failures;
    a missing capture is a failure. Each different link is extracted once; null links are left out. `via` says which step
    gave the post: page, tool or tags; post is null for tags.
    """
    r = lookup.resolved(links.filter("url is not null").select("url").distinct(), redirects)
    target = F.when(U.is_short(F.col("url")) & (U.link_kind(F.col("url")) != "page"), F.col("target")).otherwise(F.col("url"))
    r = r.select("url", target.alias("link")).withColumn("kind", F.when(U.link_kind(F.col("url")) == "page", "page").otherwise(U.link_kind(F.col("link"))))
    failed = lambda error: F.when(F.col("c").isNull(), MISSING).otherwise(error)

    first = r.filter(F.col("kind").isin(list(STAGES))).join(_captured(captures, list(STAGES)).withColumnRenamed("captured", "link"), ["kind", "link"], "left")
    answer = _page(F.col("kind"), F.col("c.body"), F.col("link"))
    http = F.when(F.col("kind") == "photo", FETCHED["photo"]).when(F.col("kind") == "post", FETCHED["post"]).otherwise(FETCHED["reel"])
    bad = F.when(~F.col("c.status").between(200, 299), F.concat(http, F.col("c.status").cast("string")))
    first = first.withColumn("r", F.when(F.col("c").isNotNull() & bad.isNull(), answer)).withColumn("error", failed(F.coalesce(bad, "r.error")))
    stage = F.when(F.col("kind") == "photo", STAGES["photo"]).when(F.col("kind") == "post", STAGES["post"]).otherwise(STAGES["reel"])
    first = written(first.select("url", "link", "kind", F.col("r.post").alias("post"), "error", stage.alias("stage")))

    again = r.filter(~F.col("kind").isin("page", *STAGES)).unionByName(first.filter("error is not null and kind <> 'photo'").select("url", "link", "kind"))
    said = _captured(captures, ["subtitles"]).select(F.col("captured").alias("url"), F.col("c.body").alias("subtitles"))
    second = again.join(_captured(captures, ["tool"]).select(F.col("captured").alias("url"), "c"), "url", "left").join(said, "url", "left")
    second = second.withColumn("r", _tool(F.col("c.status"), F.col("c.body"), F.col("url"), F.col("subtitles"))).withColumn("error", failed(F.col("r.error")))
    second = written(second.select("url", "link", "kind", F.when(F.col("error").isNull(), F.col("r.post")).alias("post"), "error", F.lit("social_extraction").alias("stage")))

    rest = r.filter("kind = 'page'").unionByName(first.filter("error is not null and kind = 'photo'").select(r.columns)).unionByName(second.filter("error is not null").select(r.columns))
    third = rest.join(_captured(captures, ["page"]).select(F.col("captured").alias("url"), F.col("c.body").alias("html")), "url", "left")
    third = third.withColumn("card", X.page_card(F.coalesce("html", F.lit("")), F.col("url")))

    def done(rows: DataFrame, via: str) -> DataFrame:
        p = F.col("post")
        return rows.filter("error is null").select("url", F.coalesce(F.nullif(p["webpage_url"], F.lit("")), "link").alias("canonical"), F.lit(via).alias("via"), "post", p["title"].alias("title"), p["description"].alias("description"), p["thumbnail_url"].alias("image"), U.domain(F.col("url")).alias("site"))

    tags = third.select("url", F.col("link").alias("canonical"), F.lit("tags").alias("via"), F.lit(None).cast(POST).alias("post"), *[F.col(f"card.{c}").alias(c) for c in ("title", "description", "image", "site")])
    failures = first.unionByName(second).filter("error is not null")
    message = F.substring("error", 1, 500)
    return done(first, "page").unionByName(done(second, "tool")).unionByName(tags), failures.select("url", "stage", S.error_kind(F.col("error")).alias("kind"), message.alias("message"))


def described(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """Jobs (job_id, url, caption) with their post's card: a caption stands in for a post's empty description, and is added to that of a page's tags.

    Posts (url, canonical, via, title, description, site) are those of extract: what a page's tags or nothing gave isn't a post.
    A link without a row has empty fields. Columns: those of jobs and of posts.
    """
    j = jobs.join(posts, "url", "left")
    text, said = F.coalesce("description", F.lit("")), F.coalesce("caption", F.lit(""))
    added = X.trim(F.concat(text, F.lit("\n"), said))
    shown = F.when(F.coalesce(F.col("via") != "tags", F.lit(False)), F.coalesce(F.nullif(text, F.lit("")), said)).when(said != "", added).otherwise(text)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "image", "site") if c in posts.columns}
    return j.withColumns({"canonical": F.coalesce("canonical", "url"), "description": shown, **blank})


def stage_failures(jobs: DataFrame, failures: DataFrame, at: Column) -> DataFrame:
    """(job_id, failures): of each job whose link failed a step, its different failures as stage, kind, message and time."""
    rows = jobs.select("job_id", "url").distinct().join(failures, "url")
    return rows.groupBy("job_id").agg(F.sort_array(F.collect_set(F.struct("stage", "kind", "message", at.alias("at")))).alias("failures"))
