"""The extractor chain on links that many jobs share, on links without captures, and on what tools say when they fail."""

from pyspark.sql import functions as F

from placeflow.operators import extract as E

CAPTURE, REDIRECT = "url string, kind string, status int, body string, at int", "url string, target string"
PHOTO = '<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__">{"__DEFAULT_SCOPE__":{"webapp.reflow.video.detail":{"itemInfo":{"itemStruct":%s}}}}</script>'


def run(spark, urls, captures, redirects=()):
    links = spark.createDataFrame([(u,) for u in urls], "url string")
    posts, failures = E.extract(links, spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(list(redirects), REDIRECT))
    return posts, failures, {r.url: r for r in posts.collect()}, sorted((r.url, r.stage, r.kind, r.message) for r in failures.collect())


def test_falls_through_step_by_step(spark):
    post, reel, video, photo = "https://instagram.com/p/A1/", "https://www.instagram.com/x/reel/B2/", "https://www.tiktok.com/@a/video/3", "https://www.tiktok.com/@a/photo/4"
    short = "https://vm.tiktok.com/Z"
    captures = [
        (post, "post", 403, "", 1), (post, "tool", 0, '{"title":"from tool","description":"","entries":[{"thumbnail":"1"},{"thumbnail":"2"}]}', 1), (post, "subtitles", 0, "WEBVTT\n00:01 --> 2\nhi\nhi\n<b>ho</b>\n", 1),
        (reel, "tool", 1, "WARNING\nERROR: Login required", 1), (reel, "page", 200, '<meta property="og:title" content="Tags &amp; more">', 1),
        (video, "tool", 0, "null", 2), (video, "tool", 0, '{"title":"older"}', 1),
        (photo, "photo", 200, PHOTO % '{"desc":"Hello #Tag","author":{"nickname":"n"},"imagePost":{"images":[{"imageURL":{"urlList":["1.jpg"]}},{"imageURL":{"urlList":["2.jpg"]}},{}]}}', 1),
    ]
    _, _, got, failed = run(spark, [post, reel, video, photo, short, None, post, "https://a.example/x"], captures, [(short, photo)])
    assert {u: (r.via, r.title) for u, r in got.items()} == {post: ("tool", "from tool"), reel: ("tags", "Tags & more"), video: ("tags", ""), photo: ("page", "Hello #Tag"), short: ("page", "Hello #Tag"), "https://a.example/x": ("tags", "")}
    assert got[post].post.subtitles == "hi ho" and got[post].post.is_carousel and got[post].canonical == post
    assert got[photo].post.slide_count == 3 and got[photo].post.slide_thumbnails == ["1.jpg", "2.jpg"] and got[photo].post.hashtags == ["tag"] and got[photo].post.uploader == "n"
    assert got[short].canonical == photo and got[reel].post is None and got["https://a.example/x"].site == ""
    assert failed == sorted([
        (post, "instagram_carousel", "blocked", "Instagram embed fetch returned HTTP 403"), (reel, "instagram_reel", "dependency_error", E.MISSING), (reel, "social_extraction", "blocked", "Temporarily blocked by the platform."),
        (video, "social_extraction", "parse_error", E.UNPARSED),
    ])


def test_many_jobs_share_a_link(spark):
    """The link is extracted once; every job gets its post with its own caption, and its failures once, though it repeats."""
    url = "https://www.tiktok.com/@a/video/9"
    jobs = spark.createDataFrame([(f"j{k % 250}", url, "me" if k % 2 else None) for k in range(300)] + [("n", None, "c"), ("p", "https://a.example/", "c")], "job_id string, url string, caption string")
    posts, failures = E.extract(jobs, spark.createDataFrame([(url, "page", 200, '<meta name="description" content="about">', 1)], CAPTURE), spark.createDataFrame([], REDIRECT))
    assert posts.count() == 2 and failures.count() == 1
    out = E.described(jobs, posts)
    assert out.count() == 302
    assert {(r.caption, r.description) for r in out.filter(F.col("url") == url).collect()} == {("me", "about\nme"), (None, "about")}
    assert {r.job_id: r.description for r in out.filter("job_id in ('n', 'p')").collect()} == {"n": "c", "p": "c"}
    kept = E.stage_failures(jobs, failures, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(kept) == 250 and all([f.stage for f in r.failures] == ["social_extraction"] for r in kept)


def test_empty(spark):
    posts, failures, got, failed = run(spark, [], [])
    assert got == {} and failed == [] and posts.columns == ["url", "canonical", "via", "post", "title", "description", "image", "site"]


def test_faults(spark):
    from placeflow.operators import replies as R

    bodies = [None, "{}", '{"types":null,"rating":5}', "null", "7", "{", '{"rating":"x"}', '{"types":["a"],"address_components":{}}', ""]
    got = [r.e for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(R.fault(F.col("b")).alias("e")).collect()]
    assert got == [None, None, None, "details is null, not object", "details is number, not object", "details is not JSON: {", "details.rating is string, not number", "details.address_components is object, not array", "details is not JSON: "]
    verdicts = spark.createDataFrame([("a", "complete", "p1"), ("b", "complete", "p2"), ("c", "duplicate", "p1"), ("d", "complete", None), ("e", "complete", "gone")], "job_id string, status string, place_id string")
    payloads = spark.createDataFrame([("p1", "["), ("p1", "{}"), ("p1", "7"), ("p2", "{}"), (None, "[")], "place_id string, body string")
    out = {r.job_id: (r.status, r.place_id, r.error) for r in R.fail_faulty(verdicts, payloads).collect()}
    assert out == {"a": ("failed", None, "details is not JSON: ["), "b": ("complete", "p2", None), "c": ("duplicate", "p1", None), "d": ("complete", None, None), "e": ("complete", "gone", None)}
    assert [r.e for r in spark.createDataFrame([('{"a b":1}',), ('{"a b":"x"}',)], "b string").select(R.fault(F.col("b"), {"a b": "string"}).alias("e")).collect()] == ["details.a b is number, not string", None]


def test_faults_read_what_jobs_name(spark):
    """Payloads are parsed after the join with the jobs' places, and jobs that can't fail don't share one key."""
    from placeflow.operators import replies as R

    verdicts = spark.range(400).selectExpr("concat('J', id) AS job_id", "if(id % 4 = 0, 'complete', 'duplicate') AS status", "if(id % 4 = 0, concat('p', id % 8), NULL) AS place_id")
    payloads = spark.range(100).selectExpr("concat('p', id) AS place_id", "if(id % 2 = 0, '[', '{}') AS body")
    out = R.fail_faulty(verdicts, payloads)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda word: [i for i, line in enumerate(plan) if word in line]
    assert at("LeftSemi") and at("parse") and max(at("parse")) < min(at("LeftSemi"))
    keys = next(line for line in plan if "LeftOuter" in line)
    assert "_at" in keys
    assert sorted((r.status, r.place_id, r.error, r["count"]) for r in out.groupBy("status", "place_id", "error").count().collect() if r.status == "failed") == [("failed", None, "details is not JSON: [", 100)]
    assert out.count() == 400 and out.columns == ["job_id", "status", "place_id", "error"]


def test_replies(spark):
    from placeflow.operators import replies as R

    rows = [("a", 'x {"places":["A","A",{"name":""},{"name":"B","region":"r"}]} y'), ("b", None), ("c", "[1]"), ("d", '{"places":{}}'), ("e", ""), ("f", "```\n{\"places\":[]}\n```")]
    got = sorted((r.job_id, r.pos, r.name, r.location, r.siblings) for r in R.reply_places(spark.createDataFrame(rows, "job_id string, reply string")).collect())
    assert got == [("a", 1, "A", "", ["A", "B"]), ("a", 2, "A", "", ["A", "B"]), ("a", 4, "B", "r", ["A"])]
