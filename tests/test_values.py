"""Known values of functions that the other engine can't express, and of the operators' rules."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from placeflow import plans
from placeflow.functions import posts as P
from placeflow.functions import state as S
from placeflow.functions import text as X
from placeflow.functions import url as U
from placeflow.functions import variant as V
from placeflow.operators import backfill, dedup, locks, members
from placeflow.sources.snapshots import Store
from placeflow.sources.tables import frame


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_entities(spark):
    get = lambda t: one(spark, X.decoded(F.col("t")), t=t)
    assert get("&#x41;&#66; &amp;lt; &nbsp;&quot;&apos;") == "AB <  \"'"
    assert get("&#99999999;") == "&#99999999;"
    assert get(None) is None


def test_captions(spark):
    get = lambda t: one(spark, X.cleaned(F.col("t")), t=t)
    assert get("Great 🍜 #ramen @joe https://x.y | Joe on Instagram  12 likes") == "Great Joe"
    assert get("éReels x Reel") == "é x"
    assert get("likes, 44 comments done") == "done"


def test_name_keys(spark):
    assert one(spark, X.name_key(F.col("t")), t="Café  Ôle!") == "cafe ole"
    assert one(spark, X.name_key(F.col("t")), t=None) == ""


def test_pin_marks(spark):
    get = lambda t: one(spark, X.pin_marker(F.col("t")), t=t)
    assert get("📍 Ippudo Ramen, 65 4th Ave #nyc") == "Ippudo Ramen"
    assert get("📍 Joe Pizza (Original) x\nmore") == "Joe Pizza"
    assert get("no mark") is None
    assert get("📍 #a") is None


def test_location_queries(spark):
    get = lambda a, b: one(spark, X.location_query(F.col("a"), F.col("b")), a=a, b=b)
    assert get("", "📍 Lucali\nAstoria") == "Lucali Astoria"
    assert get("", "we had 'The Long Name' in Soho") == "The Long Name Soho"
    assert get("plain words", "only some very small words here again") == "plain words only some very small words"


def test_captions_after_prefix(spark):
    assert one(spark, X.caption(F.col("t")), t='3 likes - a on May 1: "so: good"') == "so: good"
    assert one(spark, X.caption(F.col("t")), t="no quote") == "no quote"


def test_slides(spark):
    links = F.array(*[F.lit(x) for x in ("https://a/123456_1_2_n.jpg?x", "https://b/123456_1_2_n.jpg", "https://c/z.jpg?1", "https://c/z.jpg?2")])
    assert spark.range(1).select(X.slide_links(links).alias("x")).first()["x"] == ["https://a/123456_1_2_n.jpg?x", "https://c/z.jpg?1"]


def test_json(spark):
    get = lambda t: one(spark, V.first_json(F.col("t")), t=t)
    assert get('so: {"a": "}\\""} and {"b": 1}') == '{"a":"}\\""}'
    assert get("[1, 2] x") == "[1,2]"
    assert get("{bad}") is None
    assert get("none") is None
    assert one(spark, X.unescaped(F.col("t")), t="a\\u0026b") == "a&b"
    assert one(spark, X.unescaped(F.col("t")), t='a"\\n') == 'a"\n'


def test_photo_post(spark):
    body = '{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":{"desc":"d #T","author":{"nickname":"n"},"challenges":[{"title":" Food "}],"imagePost":{"images":[{"imageURL":{"urlList":["u1"]}},{}]}}}}}}'
    got = one(spark, V.photo_post(F.col("t")), t=body)
    assert (got.description, got.uploader, got.hashtags, got.slide_thumbnails, got.thumbnail_url, got.title) == ("d #T", "n", ["food", "t"], ["u1"], "u1", "d #T")


def test_source_append(spark):
    def get(pin, share, *sources):
        have = F.array(*map(F.lit, sources)) if sources else F.array().cast("array<string>")
        r = spark.range(1).select(dedup.source_append(F.lit(pin), have, F.lit(share)).alias("x")).first()["x"]
        return r.added, r.url

    short, video = "https://www.tiktok.com/t/ZT1/", "https://www.tiktok.com/@a/video/12"
    assert get(short, video) == (True, video)
    assert get(video, video + "?_t=1") == (False, video)
    assert get("https://maps.google.com/?q=x", video) == (True, "https://maps.google.com/?q=x")
    assert get("https://a.b/c", video, video) == (False, "https://a.b/c")


def test_write_batch_is_a_loop(spark, small):
    pins = frame(spark, small, "pins")
    shares = spark.createDataFrame([(k, f"U{k % 7}", f"Q{k % 5}" if k % 3 else None, f"https://a.b/{k % 4}{'/' * (k % 2)}") for k in range(60)], "pos long, user_id string, place_id string, url string")
    got = {r.pos: (r.pin_id, r.inserted) for r in dedup.write_batch(shares, pins).collect()}
    state = {}
    for r in sorted(shares.collect(), key=lambda r: r.pos):
        keys = [(r.user_id, "p", r.place_id) if r.place_id else None, (r.user_id, "u", r.url), (r.user_id, "n", r.url.rstrip("/"))]
        pin = next((state[k] for k in keys if k in state), None)
        assert got[r.pos] == (pin or f"N{r.pos}", pin is None)
        if pin is None:
            for k in keys:
                if k:
                    state.setdefault(k, f"N{r.pos}")


def test_write_batch_folds_wishes(spark):
    """Shares of one wish are folded once; empty and null places, links and users, stored pins, and wishes that find another pin later."""
    rng = random.Random(5)
    rows = [(k * 37 % 601, rng.choice(["U1", "U2", "U3", None]), rng.choice(["Q1", "Q2", "Q3", "", None]), rng.choice(["https://a.b/1", "https://a.b/1/", "https://a.b/2", "https://a.b/3", "", None, "x/"])) for k in range(601)]
    # at 702 the place of 700's link is inserted; from there on its wish finds that one, and before it the link's
    rows += [(699, "U9", "Q8", "https://c.d/1"), (700, "U9", "Q9", "https://c.d/1"), (701, "U9", "Q9", "https://c.d/1/"), (702, "U9", "Q9", "https://c.d/2"), (703, "U9", "Q9", "https://c.d/1"), (704, "U8", "Q9", "https://c.d/1")]
    shares = spark.createDataFrame(rows, "pos long, user_id string, place_id string, url string").repartition(5)
    pins = spark.createDataFrame([("P2", "U2", "Q1", "https://z.z/1"), ("P1", "U2", "Q1", "https://z.z/2"), ("P3", "U3", "Z", "https://a.b/3/?utm_source=x"), ("P4", None, "Q2", "https://a.b/2"), ("P5", "U1", "", "x")], "pin_id string, user_id string, place_id string, url string")
    stored = {r.pos: r.existing_pin for r in dedup.existing(shares, pins).collect()}
    normal = {r.url: r.n for r in shares.select("url").distinct().withColumn("n", U.normalize(F.col("url"))).collect()}
    state, want = {}, {}
    for pos, user, place, link in sorted(rows):
        keys = [(user, i, k) for i, k in enumerate((place, link, normal[link])) if k]
        pin = stored[pos] or next((state[k] for k in keys if k in state), None)
        want[pos] = (user, pin or f"N{pos}", pin is None)
        if pin is None:
            state |= {k: f"N{pos}" for k in keys}
    out = dedup.write_batch(shares, pins)
    got = {r.pos: (r.user_id, r.pin_id, r.inserted) for r in out.collect()}
    assert got == want and out.count() == len(rows)
    assert [stored[p] for p in (699, 700, 701, 702)] == [None] * 4 and set(stored.values()) == {None, "P1", "P3", "P5"}
    assert dict(out.dtypes) == {"user_id": "string", "pos": "bigint", "pin_id": "string", "inserted": "boolean"}
    # the shares are read once more for their pins; wishes come from their table
    every = spark.range(50).selectExpr("id AS pos", "'U' AS user_id", "'Q' AS place_id", "'https://a.b/1' AS url")
    plan = dedup.write_batch(every, pins)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_second_pass_changes_nothing(spark, small):
    lists, rows = frame(spark, small, "lists"), frame(spark, small, "members")
    first = members.reconciled(lists, rows)
    fixed = lists.drop("pin_count").join(first.select("list_id", F.col("actual").alias("pin_count")), "list_id")
    assert first.filter("outcome = 'updated'").count() > 0
    assert members.reconciled(fixed, rows).filter("outcome = 'updated'").count() == 0
    found = members.orphans(rows, frame(spark, small, "pin_lists"), frame(spark, small, "pins"))
    left = rows.join(members.deletions(found), ["list_id", "pin_id"], "left_anti")
    assert members.deletions(members.orphans(left, frame(spark, small, "pin_lists"), frame(spark, small, "pins"))).count() == 0


def test_orphans_of_gone_pins(spark):
    """A pin that is gone is an orphan though pin_lists still names it, and can't veto."""
    m = spark.createDataFrame([("L", "a"), ("L", "b"), ("M", "c"), ("M", "d")], "list_id string, pin_id string")
    pins = spark.createDataFrame([("a",), ("c",), ("d",)], "pin_id string")
    got = {(r.list_id, r.pin_id): (r.orphan, r.vetoed) for r in members.orphans(m, m, pins, spark.createDataFrame([("b",), ("d",)], "pin_id string")).collect()}
    assert got == {("L", "a"): (False, False), ("L", "b"): (True, False), ("M", "c"): (False, True), ("M", "d"): (False, True)}


def test_by_content_without_sources(spark):
    pins = spark.createDataFrame([("u", "p1", "https://youtu.be/a1", None), ("u", "p2", "https://a.b/c", ["https://youtu.be/b2"])], "user_id string, pin_id string, url string, sources array<string>")
    shares = spark.createDataFrame([("u", "https://www.youtube.com/watch?v=a1"), ("u", "https://www.youtube.com/watch?v=b2"), ("u", None)], "user_id string, url string")
    assert sorted((r.url or "", r.pin_by_content) for r in dedup.by_content(shares, pins).collect()) == [("", None), ("https://www.youtube.com/watch?v=a1", "p1"), ("https://www.youtube.com/watch?v=b2", "p2")]


def test_repeated_details_and_hits(spark):
    """Details and hits that repeat a key, or rank more than one hit, give one row for each pin and user."""
    pins = spark.createDataFrame([("p", "PL1", ["x"], None)], "pin_id string, place_id string, types array<string>, primary_type string")
    details = spark.createDataFrame([("PL1", ["bar"], "bar"), ("PL1", ["cafe"], "cafe")], "place_id string, types array<string>, primary_type string")
    assert [r.outcome for r in backfill.retype(pins, details).collect()] == ["updated"]
    users = spark.createDataFrame([("u", None, None, "Rome")], "user_id string, home_lat double, home_lng double, home_city string")
    hits = spark.createDataFrame([("Rome", "Rome", ["locality"], 41.9, 12.5, False, 1), ("Rome", "Roma", ["locality"], 0.0, 0.0, False, 2)], "query_key string, name string, types array<string>, lat double, lng double, failed boolean, rank int")
    got = backfill.resolve_homes(users, hits).collect()
    assert [(r.outcome, r.hit_lat) for r in got] == [("resolved", 41.9)]


def test_display_names(spark):
    get = lambda t: one(spark, X.display_name(F.col("t")), t=t)
    assert get(" a\tb ") == "a\tb"
    assert get("x" * 300) == "x" * 256
    assert [get(t) for t in ("", "  ", "a\x07b", "a<b", "a\u200bb", None)] == [None] * 6


def test_override_patch(spark):
    row = spark.range(1).select(F.try_parse_json(F.lit('{"category":"food","placeName":"A"}')).alias("stored"), V.edits(F.try_parse_json(F.lit('{"placeName":null,"formattedAddress":" x "}'))).alias("ops"))
    assert row.select(members.patched(F.col("stored"), V.effective(F.col("ops"), F.col("stored"))).alias("x")).first()["x"] == {"category": "food", "formattedAddress": "x"}


def test_raced(spark):
    planned = spark.createDataFrame([("a", "updated", "food"), ("b", "updated", "food"), ("c", "updated", "food")], "id string, outcome string, category string")
    now = spark.createDataFrame([("a", "food"), ("b", "bar")], "id string, category string")
    assert {r.id: r.outcome for r in backfill.still_same(planned, now, "id", ["category"]).collect()} == {"a": "updated", "b": "raced", "c": "raced"}


def test_locks(spark, tmp_path):
    """Locks in a stored control table: one holder, renewal and release by it alone, takeover of an old one, and the freeze around a migration."""
    store = Store(spark, f"file://{tmp_path}")
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    assert locks.acquire(store, "types", "a", at(0)) == "acquired"
    assert locks.acquire(store, "types", "b", at(10)) == "refused"
    assert locks.acquire(store, "types", "a", at(10)) == "refused"
    assert (locks.renew(store, "types", "b", at(11)), locks.renew(store, "types", "a", at(12)), locks.renew(store, "none", "a", at(12))) == ("not-owner", "renewed", "missing")
    assert locks.acquire(store, "types", "b", at(41)) == "refused"
    assert locks.acquire(store, "types", "b", at(42)) == "taken_over"
    assert not locks.release(store, "types", "a") and locks.release(store, "types", "b")
    assert locks.acquire(store, "types", "c", at(43)) == "acquired"
    assert locks.begin_migration(store, "m", at(1)) == "not_frozen"
    locks.freeze(store)
    assert (locks.begin_migration(store, "m", at(1)), locks.begin_migration(store, "n", at(2)), locks.unfreeze(store)) == ("acquired", "in_progress", "in_progress")
    assert not locks.end_migration(store, "n") and locks.end_migration(store, "m")
    assert (locks.unfreeze(store), locks.begin_migration(store, "n", at(3))) == ("unfrozen", "not_frozen")


def test_carousel_and_reel(spark):
    slash = "\\\\/"
    image = lambda name: f'\\"display_url\\":\\"https:{slash}{slash}scontent.x{slash}{name}\\"'
    page = f'<script>{{\\"owner\\":{{\\"id\\":1,\\"username\\":\\"ann\\"}},{image("123456_1_2_n.jpg?a")},{image("123456_1_2_n.jpg?b")},{image("z.jpg?u=1")},\\"edge_media_to_caption\\":{{\\"edges\\":[{{\\"node\\":{{\\"text\\":\\"Go #Now\\"}}}}]}}}}'
    got = one(spark, P.carousel_post(F.col("h"), F.col("u")), h=page, u="https://www.instagram.com/p/Ab_1/")
    assert (got.title, got.description, got.uploader, got.hashtags, got.webpage_url, got.is_carousel) == ("Go #Now", "Go #Now", "ann", ["now"], "https://www.instagram.com/p/Ab_1/", True)
    assert got.slide_thumbnails == ["https://scontent.x/123456_1_2_n.jpg?a", "https://scontent.x/z.jpg?u=1"]
    assert one(spark, P.carousel_post(F.col("h"), F.col("u")), h="login", u="https://www.instagram.com/p/Ab_1/") is None
    assert one(spark, P.carousel_post(F.col("h"), F.col("u")), h=page, u="https://a.b/c") is None
    page = '<meta property="og:description" content="3 likes - bo on May 1: &quot;so: #Good&quot;"><meta property="og:url" content="https://www.instagram.com/bo/reel/R1/"><meta property="og:image" content="i.jpg">'
    got = one(spark, P.reel_post(F.col("h"), F.col("u")), h=page, u="https://www.instagram.com/reel/R1/")
    assert (got.title, got.description, got.uploader, got.hashtags, got.slide_thumbnails, got.slide_count, got.webpage_url) == ("so: #Good", "so: #Good", "bo", ["good"], ["i.jpg"], 1, "https://www.instagram.com/bo/reel/R1/")
    assert one(spark, P.reel_post(F.col("h"), F.col("u")), h="login", u="https://www.instagram.com/reel/R1/") is None


def test_keys_and_items(spark):
    key = lambda what, **v: one(spark, what, **v)
    box = tuple(F.lit(x) for x in (1.004, 2.0, 3.5, 4.256))
    assert key(S.search_key(F.col("q"), box=box), q="Joe  ") == "places:search:joe  #rect:1.00,2.00-3.50,4.26"
    assert key(S.vision_key(F.col("c"), F.array(F.lit("u" * 70))), c="tiktok:1") == "ai:vision:v3:tiktok:1"
    assert key(S.vision_key(F.col("c"), F.array(F.lit("u" * 70))), c=None) == "ai:vision:v3:" + "u" * 60
    assert key(S.extract_key(F.col("t"), F.col("d")), t="a" * 60, d=None) == "ai:extract:" + "a" * 50 + ":"
    assert key(S.candidates_key(F.col("t"), F.lit(""), F.lit("s"), F.array(*map(F.lit, "abcdef"))), t="x") == "ai:places:x::s:a,b,c,d,e"
    item = lambda x: (lambda r: r and tuple(r))(one(spark, V.place_item(F.try_parse_json(F.col("x"))), x=x))
    assert [item(x) for x in ('" Joe "', '{"name":" A ","city":"Rome"}', '{"location":"","region":"R"}', "[1]", "null", '{"name":5}')] == [("Joe", ""), ("A", "Rome"), ("", "R"), None, None, ("5", "")]
    assert spark.range(1).select(S.context_names(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("x")).first()["x"] == ["b", "a", "c"]


def test_links_on_nulls(spark):
    row = spark.createDataFrame([(None,)], "t string").select(U.domain(F.col("t")).alias("a"), U.normalize(F.col("t")).alias("b"), U.content_id(F.col("t")).alias("c"), X.mentions(F.col("t")).alias("d")).first()
    assert tuple(row) == ("unknown", None, None, [])


def test_candidates_merge(spark, small):
    """Text before vision, the first of each name without case and accents; a name of marks alone goes."""
    got = [(r.job_id, r.name, r.city, r.address, r.source) for r in plans.QUERIES["candidate_merge"](spark, small).filter("job_id < 0").orderBy("job_id", "pos").collect()]
    assert got == [(-1, "Café Ôle", "NYC", "", "text"), (-1, "Bar", "", "x", "text"), (-1, "Neu", "Bonn", "", "vision")]


def test_extracted_posts(spark, small):
    c, b, a = plans.QUERIES["extracted_posts"](spark, small).filter("id < 0").orderBy("id").collect()
    assert (a.title, a.description, a.thumbnail_url, a.uploader, a.hashtags, a.is_carousel, a.slide_count, a.slide_thumbnails) == ("T", "d #Tag", "a.jpg", "c", ["tag"], True, 2, ["a.jpg", "b.jpg"])
    for r in (b, c):
        assert (r.title, r.description, r.thumbnail_url, r.uploader, r.hashtags, r.is_carousel, r.slide_count, r.slide_thumbnails, r.location) == ("", "", "", "", [], False, 0, [], None)


def test_entities_are_decoded_in_compiled_columns(spark):
    get = lambda t: one(spark, X.decoded(F.col("t")), t=t)
    assert get("&#x1F600;&#0065;&#xFEFF;a&#xD800;&#;&#x;&#x110000;&&#38;lt;") == "😀A﻿a&#xD800;&#;&#x;&#x110000;&<"
    page = spark.createDataFrame([("<title>a</title>", "https://www.instagram.com/reel/R1/")], "html string, url string")
    for card in (X.page_card(F.col("html"), F.col("url")), P.reel_post(F.col("html"), F.col("url"))):
        assert "Python" not in page.select(card.alias("c"))._jdf.queryExecution().executedPlan().toString()


def test_a_caption_and_a_transcript_are_worked_out_once(spark):
    text = spark.createDataFrame([("a",)], "t string")
    plan = lambda c: text.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X.pin_marker(F.col("t"))).count("regexp_extract(") == 1
    assert plan(X.transcript(F.col("t"))).count("split(") == 1
    assert one(spark, X.cleaned(F.col("t")), t="Ree😀ls at x@a 12 LIKES on InstaGRAM on TikTok #b https://a.b/c | d") == "at x d"
