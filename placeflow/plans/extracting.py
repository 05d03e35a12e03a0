"""The extractor chain over a link for every post: what was captured, what each step makes of it, and what failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import state as S
from ..operators import extract as E
from ..sources.tables import sql
from .registry import query

# one link a post, of six kinds; g varies which step fails, free of the kind
_LINKS = """SELECT k, g, t, CASE k % 6 WHEN 0 THEN concat('https://www.tiktok.com/@u/photo/', k) WHEN 1 THEN concat('https://www.instagram.com/p/C', k, '/') WHEN 2 THEN concat('https://www.instagram.com/joe/reel/R', k, '/')
  WHEN 3 THEN concat('https://www.tiktok.com/@u/video/', k) WHEN 4 THEN concat('https://vm.tiktok.com/', k) ELSE concat('https://www.a.example/', k) END AS url, concat('https://www.tiktok.com/@v/photo/', k) AS target, CASE WHEN k % 5 < 2 THEN concat('said ', k) ELSE '' END AS caption
  FROM (SELECT CAST(post_id AS BIGINT) AS k, CAST(floor(post_id / 6.0) AS BIGINT) AS g, trim({plain}) AS t FROM <posts>) x"""
_SPARK = _LINKS.replace("{plain}", "regexp_replace(title, '[^A-Za-z0-9# ]', ' ')")
_DUCK = _LINKS.replace("{plain}", "regexp_replace(title, '[^A-Za-z0-9# ]', ' ', 'g')")
_SCRIPT = '<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">{}</script>'
_ITEM = '{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":%s}}}}'
_SAID = ["ERROR: Unsupported URL: x", "ERROR: This video is private", "HTTP Error: rate-limit reached", "Video not available", "your IP address is blocked", "boom https://h.example/v?sig=1 Cookie: abc"]


def _json(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def inputs(spark, sf_dir):
    """Links, captures and redirects."""
    links = sql(spark, sf_dir, _SPARK)
    k, g, t, c = F.col("k"), F.col("g"), F.col("t"), F.col
    page = F.when(k % 6 == 4, c("target")).otherwise(c("url"))
    image = lambda i: F.concat(F.lit('{"imageURL":{"urlList":["p'), i.cast("string"), F.lit('.jpg"]}}'))
    images = F.array_join(F.transform(F.sequence(F.lit(1), (1 + g % 3).cast("int")), image), ",")
    begin, middle, end = _SCRIPT.format(_ITEM % '{"desc":"|","author":{"uniqueId":"u"},"challenges":[{"title":" Tag "}],"imagePost":{"images":[|]}}').split("|")
    photo = (
        F.when(g % 9 == 2, "<html></html>").when(g % 9 == 3, _SCRIPT.format("{not json")).when(g % 9 == 4, _SCRIPT.format('{"a":1}')).when(g % 9 == 5, _SCRIPT.format(_ITEM % '{"desc":"d"}'))
        .otherwise(_json(begin, t, middle, images, end))
    )
    shot = lambda i: F.concat(F.lit('"display_url":"https://scontent.x/'), (100000 + k).cast("string"), F.lit("_"), i.cast("string"), F.lit('_2_n.jpg",'))
    shots = F.array_join(F.transform(F.sequence(F.lit(1), (1 + g % 3).cast("int")), shot), "")
    post = _json('<script>{"owner":{"id":"1","username":"u"},', F.when(g % 5 == 1, "").otherwise(shots), '"edge_media_to_caption":{"edges":[{"node":{"text":"', t, '"}}]}}</script>')
    reel = F.when(g % 5 == 1, "<html>login</html>").otherwise(_json('<meta property="og:title" content="Reel ', k, '"><meta property="og:image" content="r.jpg">'))
    first = links.filter((k % 6 != 3) & (k % 6 != 5) & (g % 5 != 0)).select(page.alias("url"), F.when(k % 6 == 1, "post").when(k % 6 == 2, "reel").otherwise("photo").alias("kind"), F.when(g % 5 == 2, 429).otherwise(200).alias("status"), F.when(k % 6 == 1, post).when(k % 6 == 2, reel).otherwise(photo).alias("body"))
    said = F.get(F.array(*map(F.lit, _SAID)), (g % len(_SAID)).cast("int"))
    answer = F.when(g % 7 == 2, said).when(g % 7 == 3, "not json").when(g % 7 == 4, None).otherwise(_json('{"title":"Video ', k, '","webpage_url":"https://www.tiktok.com/@w/video/', k, '","entries":[]}'))
    tool = links.filter((k % 6).isin(1, 2, 3) & (g % 7 != 1)).select("url", F.lit("tool").alias("kind"), F.when(g % 7 == 2, 1).when(g % 7 == 4, None).otherwise(0).alias("status"), answer.alias("body"))
    spoken = links.filter((k % 6 == 3) & (g % 2 == 0)).select("url", F.lit("subtitles").alias("kind"), F.lit(0).alias("status"), _json("WEBVTT\n\n00:01 --> 00:02\n<i>word ", k, "</i>\nword ", k, "\nend").alias("body"))
    tags = links.filter(g % 4 != 0).select("url", F.lit("page").alias("kind"), F.lit(200).alias("status"), _json('<title>Page ', k, '</title><meta name="description" content="about ', t, '"><meta property="og:site_name" content="Site">').alias("body"))
    new = first.unionByName(tool).unionByName(spoken).unionByName(tags).withColumn("at", F.lit(2))
    old = new.filter(F.crc32("url") % 3 == 0).withColumn("body", F.lit("older")).withColumn("at", F.lit(1))
    return links, new.unionByName(old), links.filter(k % 6 == 4).select("url", "target")


_TOOLS = """CASE WHEN g % 7 = 1 THEN 'nothing was captured' WHEN g % 7 = 2 THEN CASE g % 6 WHEN 0 THEN 'This URL type is not supported yet.' WHEN 1 THEN 'This video is private.' WHEN 2 THEN 'Temporarily blocked by the platform.' WHEN 3 THEN 'This video is unavailable.' WHEN 4 THEN 'Access blocked by the platform.'
  ELSE 'Extraction failed: boom https://h.example/v?[redacted] Cookie: [redacted]' END WHEN g % 7 = 3 THEN 'Failed to parse extraction output' WHEN g % 7 = 4 THEN 'Extraction timed out' END"""
_STEPS = f"""WITH l AS ({_DUCK}),
a AS (SELECT *, CASE k % 6 WHEN 1 THEN 'instagram_carousel' WHEN 2 THEN 'instagram_reel' ELSE 'social_extraction' END AS stage1, CASE WHEN k % 6 IN (0, 1, 2, 4) THEN CASE WHEN g % 5 = 0 THEN 'nothing was captured' WHEN g % 5 = 2 THEN (CASE k % 6 WHEN 1 THEN 'Instagram embed' WHEN 2 THEN 'Instagram reel' ELSE 'TikTok' END) || ' fetch returned HTTP 429'
    WHEN k % 6 = 1 AND g % 5 = 1 THEN 'Instagram embed returned no carousel images' WHEN k % 6 = 2 AND g % 5 = 1 THEN 'Instagram reel page returned no OG metadata' WHEN k % 6 IN (0, 4) THEN CASE g % 9 WHEN 2 THEN 'TikTok rehydration payload missing from page HTML' WHEN 3 THEN 'Failed to parse TikTok rehydration JSON' WHEN 4 THEN 'TikTok itemStruct not found in rehydration payload' WHEN 5 THEN 'URL is not a TikTok photo post (no imagePost.images)' END END END AS error1 FROM l),
b AS (SELECT *, CASE WHEN k % 6 = 3 OR (k % 6 IN (1, 2) AND error1 IS NOT NULL) THEN {_TOOLS} END AS error2 FROM a),
v AS (SELECT *, CASE WHEN k % 6 IN (0, 1, 2, 4) AND error1 IS NULL THEN 'page' WHEN k % 6 IN (1, 2, 3) AND error2 IS NULL THEN 'tool' ELSE 'tags' END AS via FROM b)"""


@query(f"""{_STEPS} SELECT k AS id, via, CASE via WHEN 'tool' THEN 'https://www.tiktok.com/@w/video/' || k WHEN 'tags' THEN CASE WHEN k % 6 = 4 THEN target ELSE url END ELSE CASE k % 6 WHEN 1 THEN url WHEN 2 THEN 'https://www.instagram.com/reel/R' || k || '/' WHEN 4 THEN target ELSE url END END AS canonical,
  CASE via WHEN 'tool' THEN 'Video ' || k WHEN 'tags' THEN CASE WHEN g % 4 <> 0 THEN 'Page ' || k ELSE '' END ELSE CASE k % 6 WHEN 1 THEN CASE WHEN t = '' THEN 'Post by u' ELSE left(t, 80) END WHEN 2 THEN 'Reel ' || k ELSE left(t, 80) END END AS title,
  CASE via WHEN 'tool' THEN 'Video ' || k WHEN 'tags' THEN CASE WHEN caption = '' THEN CASE WHEN g % 4 <> 0 THEN 'about ' || t ELSE '' END ELSE trim(CASE WHEN g % 4 <> 0 THEN 'about ' || t ELSE '' END || chr(10) || caption, chr(10)) END ELSE CASE WHEN k % 6 = 2 THEN 'Reel ' || k WHEN t = '' THEN caption ELSE t END END AS description,
  CASE WHEN via = 'page' AND k % 6 <> 2 THEN 1 + g % 3 WHEN via = 'page' THEN 1 WHEN via = 'tool' THEN 0 END::BIGINT AS slides, CASE WHEN via = 'tool' AND k % 6 = 3 AND g % 2 = 0 THEN 'word ' || k || ' end' END AS subtitles FROM v""")
def extractor_chain(spark, sf_dir):
    """One post for every link, by the first step that gives one."""
    links, captures, redirects = inputs(spark, sf_dir)
    posts, _ = E.extract(links, captures, redirects)
    out = E.described(links, posts)
    return out.select(F.col("k").alias("id"), "via", "canonical", "title", "description", F.col("post.slide_count").cast("long").alias("slides"), F.col("post.subtitles").alias("subtitles"))


def _kind(message: str) -> str:
    out = "CASE"
    for kind, pattern in S.ERRORS.items():
        out += f" WHEN regexp_matches(lower({message}), '{pattern}') THEN '{kind}'"
    return out + " ELSE 'dependency_error' END"


@query(f"""{_STEPS}, f AS (SELECT k, stage1 AS stage, error1 AS message FROM v WHERE error1 IS NOT NULL UNION ALL SELECT k, 'social_extraction', error2 FROM v WHERE error2 IS NOT NULL)
SELECT k AS id, stage, {_kind('message')} AS kind, message FROM f""")
def extractor_failures(spark, sf_dir):
    """A row for every step that failed a link, as its job keeps it."""
    links, captures, redirects = inputs(spark, sf_dir)
    _, failures = E.extract(links, captures, redirects)
    kept = E.stage_failures(links.withColumn("job_id", F.col("k")), failures, F.lit("2024-01-15").cast("timestamp"))
    return kept.select("job_id", F.explode("failures").alias("f")).select(F.col("job_id").alias("id"), "f.stage", "f.kind", "f.message")
