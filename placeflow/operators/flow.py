"""From shared links to verdicts: every step of an enrichment job as joins over lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import state as S
from ..functions import taxonomy as T
from ..functions import text as X
from ..functions import url as U
from ..session import written
from . import dedup
from .enrich import candidates as merged
from .extract import described
from .places import once

# fixed values: names of platforms, which say nothing about a place
PLATFORMS = ("instagram", "tiktok", "youtube", "facebook", "twitter", "x")


def garbage(query: Column) -> Column:
    """Whether a search for it can't find a place: a platform's name, or under three characters."""
    q = X.trim(F.coalesce(query, F.lit("")))
    return F.lower(q).isin(*PLATFORMS) | (F.length(q) < 3)


def fallback_query(guess: Column, caption: Column, title: Column, description: Column) -> Column:
    """What to search for where no candidate was found: the single guess, else a pin marker, else a query from the caption, else from the page; null if garbage."""
    marker = F.coalesce(X.pin_marker(X.decoded(description)), X.pin_marker(X.decoded(title)))
    said = F.when(F.coalesce(caption, F.lit("")) != "", X.location_query(caption, F.lit("")))
    # each is worked out once: the first that is longer than its least
    options = F.array(*[F.struct(x.alias("q"), F.lit(n).alias("n")) for x, n in ((guess, 3), (marker, 2), (said, 3), (X.location_query(title, description), 3))])
    first = lambda o: F.get(F.filter(o, lambda x: F.coalesce(F.length(x["q"]) > x["n"], F.lit(False))), F.lit(0))["q"]
    return once(once(options, first), lambda q: F.when(~garbage(q), q))


def ranked(hits: DataFrame) -> DataFrame:
    """(query_key, place_id, name, address, ratings, n_hits) of the first hit of each query, and how many there are."""
    n = Window.partitionBy("query_key")
    top = hits.withColumn("n_hits", F.count("*").over(n)).filter("rank = 1").groupBy("query_key")
    return top.agg(F.min(F.struct("place_id", "name", "address", "ratings", "n_hits")).alias("h")).select("query_key", "h.*")


def maps_hits(jobs: DataFrame, top: DataFrame) -> DataFrame:
    """(job_id, maps_place): what a maps link points at (jobs: job_id, maps, feature), by name and feature id, else by name; jobs without one are left out. `top` is ranked()."""
    at = jobs.filter("maps is not null").select("job_id", F.col("maps.name").alias("name"), "feature")
    keys = F.array(F.when(F.col("feature").isNotNull(), F.struct(F.lit(0).alias("n"), F.concat_ws(" ", "name", "feature").alias("q"))), F.struct(F.lit(1).alias("n"), F.col("name").alias("q")))
    asked = at.select("job_id", F.explode(F.array_compact(keys)).alias("k")).select("job_id", "k.*")
    return asked.join(top.select(F.col("query_key").alias("q"), "place_id"), "q").groupBy("job_id").agg(F.min_by("place_id", "n").alias("maps_place"))


def pin_keys(pins: DataFrame) -> DataFrame:
    """(user_id, kind, key, pin): each user's least pin under every place, link, normal link and content id; pin is struct<pin_id, url, sources>."""
    links = F.concat(F.array("url"), F.coalesce("sources", F.array().cast("array<string>")))
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    contents = F.transform(F.array_distinct(F.transform(links, U.content_id)), lambda k: key("content", k))
    keys = F.concat(F.array(key("place", F.col("place_id")), key("url", F.col("url")), key("normal", U.normalize(F.col("url")))), contents)
    rows = pins.select("user_id", F.struct("pin_id", "url", "sources").alias("pin"), F.explode(keys).alias("k")).select("user_id", "k.*", "pin")
    return rows.filter("key is not null").groupBy("user_id", "kind", "key").agg(F.min_by("pin", "pin.pin_id").alias("pin"))


def _probed(asked: DataFrame, keys: Column, known: DataFrame, by: list[str]) -> DataFrame:
    """Of jobs' keys (use, n, kind, key) those that a pin has: by, use, n, pin. All uses meet the pins in one join."""
    each = asked.select(*by, "user_id", F.explode(F.array_compact(keys)).alias("_k")).select(*by, "user_id", "_k.*").filter("key is not null")
    return each.join(known, ["user_id", "kind", "key"]).select(*by, "use", "n", "pin")


def _key(use: str, n: int, kind: str, key: Column) -> Column:
    return F.struct(F.lit(use).alias("use"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), key.alias("key"))


def tallies(jobs: DataFrame, candidates: DataFrame, top: DataFrame, details: DataFrame, known: DataFrame) -> DataFrame:
    """Per job: n_new, n_existing, n_unresolved, new_place, and of the existing pins the first, and the first that takes the link as a new source.

    Candidates: job_id, pos, name, address, city. Jobs need user_id and canonical. A pin that two candidates match takes the link once.
    """
    c = candidates.join(jobs.select("job_id", "user_id", "canonical"), "job_id").withColumn("query", S.candidate_query(F.col("name"), F.col("address"), F.col("city")))
    c = c.join(top.select(F.col("query_key").alias("query"), "place_id"), "query", "left")
    c = c.join(details.select("place_id", F.lit(True).alias("_d")).distinct(), "place_id", "left")
    mine = known.filter("kind = 'place'").select("user_id", F.col("key").alias("place_id"), "pin")
    c = c.join(mine, ["user_id", "place_id"], "left")
    state = F.when(F.col("place_id").isNull(), "unresolved").when(F.col("pin").isNotNull(), "existing").when(F.col("_d").isNull(), "unresolved").otherwise("new")
    added = F.when(F.col("pin").isNotNull(), dedup.source_append(F.col("pin.url"), F.col("pin.sources"), F.col("canonical"))["added"])
    c = c.withColumn("state", state).withColumn("added", F.coalesce(added, F.lit(False)))
    count = lambda s: F.count_if(F.col("state") == s)
    least = lambda test, what: F.min_by(F.when(test, F.col(what)), F.when(test, F.col("pos")))
    return c.groupBy("job_id").agg(
        count("new").alias("n_new"), count("existing").alias("n_existing"), count("unresolved").alias("n_unresolved"), least(F.col("state") == "new", "place_id").alias("new_place"),
        least(F.col("state") == "existing", "pin.pin_id").alias("first_match"), least(F.col("added"), "pin.pin_id").alias("appended_pin"),
    )


def fallbacks(jobs: DataFrame, top: DataFrame, checks: DataFrame) -> DataFrame:
    """(job_id, fallback_place, score) of jobs with a `query`: the first hit scored against the page, verified under 60, gone under 30.

    Checks (place_id, matches, better_query) hold the verifier's answers; a better query's own first hit replaces the place at 60 or more.
    `top` is ranked().
    """

    def scored(rows: DataFrame, key: str, place: str, score: str) -> DataFrame:
        h = top.select(F.col("query_key").alias(key), F.struct("place_id", "name", "address", "ratings", "n_hits").alias("_h"))
        points = T.confidence(F.col("_h.name"), F.col("_h.address"), F.col("_h.ratings"), F.col("_h.n_hits"), F.col("title"), F.col("description"), F.col("site"))
        return rows.join(h, key, "left").withColumn(place, F.col("_h.place_id")).withColumn(score, F.when(F.col("_h").isNotNull(), points)).drop("_h")

    rows = scored(jobs.filter("query is not null").select("job_id", "query", "title", "description", "site"), "query", "p1", "s1")
    one = checks.groupBy("place_id").agg(F.min(F.struct("matches", "better_query")).alias("_c"))
    rows = rows.join(one.withColumnRenamed("place_id", "p1"), "p1", "left")
    ask = (F.col("s1") < 60) & ~F.coalesce("_c.matches", F.lit(True))
    rows = scored(rows.withColumn("better", F.when(ask, F.nullif("_c.better_query", F.lit("")))), "better", "p2", "s2")
    better = F.col("p2").isNotNull()
    out = rows.select("job_id", F.when(better, F.col("p2")).otherwise(F.col("p1")).alias("fallback_place"), F.when(better, F.greatest("s2", F.lit(60))).otherwise(F.col("s1")).alias("score"))
    return out.filter("score >= 30 and fallback_place is not null")


def run(jobs: DataFrame, posts: DataFrame, redirects: DataFrame, candidates: DataFrame, vision: DataFrame, guesses: DataFrame, checks: DataFrame, hits: DataFrame, details: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per job: job_id, status, pin (the existing one, or null), place_id (of a new pin), source_added, step.

    Jobs: job_id, user_id, url, caption. Posts (url, canonical, via, title, description, site) are what extraction gave; a
    caption is added to what tags gave and stands in for a post's empty description. Redirects (url, target) are followed for
    short maps links, and for short social links that no post answers. Candidates (job_id, pos, name, city, address, source)
    come from texts, vision (job_id, pos, name, location) from images; the first of each name in a job counts. Pins: user_id,
    pin_id, place_id, url, sources. The steps in order, the first that decides wins: the same link is pinned; a maps link's
    place (existing or new); the same content is pinned; candidates (all existing, one new, several new); the fallback
    search (existing or new), asked for undecided jobs alone; existing matches; failed. A verdict on an existing pin names
    the one that really took the link, if any did. Each lookup counts a key once; a job_id that repeats is one job, its least
    row. Null links match nothing.

    Hits, pins' keys, and the jobs with what is known of them are written once and read again, so each table is read once
    and every kind of pin key is looked up in one join.
    """
    c = F.col
    post = posts.groupBy("url").agg(F.min(F.struct("canonical", "via", "title", "description", "site")).alias("p")).select("url", "p.*")
    one = jobs.groupBy("job_id").agg(F.min(F.struct("user_id", "url", "caption")).alias("j")).select("job_id", "j.*")
    target = redirects.groupBy(c("url").alias("_from")).agg(F.min("target").alias("target"))
    j = described(one, post).join(target, c("url") == c("_from"), "left").drop("_from")
    short_maps = c("url").contains("goo.gl") | c("url").contains("maps.app")
    social = c("via").isNull() & U.is_short(c("url")) & (U.link_kind(c("url")) != "page")
    j = j.withColumn("canonical", F.when(social, F.coalesce("target", "url")).otherwise(c("canonical")))
    read = F.when(short_maps, F.coalesce("target", "url")).otherwise(c("url"))
    maps = F.when(U.is_maps(c("url")), U.maps_place(read))
    j = written(j.select("job_id", "user_id", "url", "canonical", "caption", "title", "description", "site", maps.alias("maps"), F.when(maps.isNotNull(), U.feature_id(read)).alias("feature")))
    top, known = written(ranked(hits)), written(pin_keys(pins))

    links = F.array(_key("url", 0, "url", c("url")), _key("url", 1, "normal", U.normalize(c("url"))), _key("content", 0, "content", U.content_id(c("canonical"))))
    found = _probed(j, links, known, ["job_id"]).groupBy("job_id").agg(F.min_by(F.when(c("use") == "url", c("pin")), F.when(c("use") == "url", c("n"))).alias("url_pin"), F.min_by(F.when(c("use") == "content", c("pin")), F.when(c("use") == "content", c("n"))).alias("content_pin"))
    said = tallies(j, merged(candidates, vision), top, details, known)
    j = j.join(found, "job_id", "left").join(maps_hits(j, top), "job_id", "left").join(said, "job_id", "left").fillna(0, ["n_new", "n_existing", "n_unresolved"])
    all_there = (c("n_new") == 0) & (c("n_existing") > 0) & (c("n_unresolved") == 0)
    step = F.when(c("url_pin").isNotNull(), "url").when(c("maps_place").isNotNull(), "maps").when(c("content_pin").isNotNull(), "content").when(all_there, "matches").when(c("n_new") == 1, "candidate").when(c("n_new") > 1, "candidates")
    j = written(j.withColumn("step", step))

    guess = guesses.groupBy("job_id").agg(F.min("guess").alias("guess"))
    open_ = j.filter("step is null").join(guess, "job_id", "left").withColumn("query", fallback_query(c("guess"), c("caption"), c("title"), c("description")))
    j = j.join(fallbacks(open_, top, checks).select("job_id", "fallback_place"), "job_id", "left")
    j = j.withColumn("step", F.coalesce("step", F.when(c("fallback_place").isNotNull(), "fallback").when(c("n_existing") > 0, "matches").otherwise("none")))
    place = F.when(c("step") == "maps", c("maps_place")).when(c("step") == "candidate", c("new_place")).when(c("step") == "fallback", c("fallback_place"))
    # a maps link is written as it is; what the others write carries the canonical link
    j = written(j.withColumn("place", place).withColumn("link", F.when(c("step") == "maps", c("url")).otherwise(c("canonical"))))
    writes = F.array(_key("write", 0, "place", c("place")), _key("write", 1, "url", c("link")), _key("write", 2, "normal", U.normalize(c("link"))))
    hit = _probed(j.filter("place is not null"), writes, known, ["job_id"]).groupBy("job_id").agg(F.min_by("pin", "n").alias("w"))
    j = j.join(hit, "job_id", "left")

    takes = lambda pin: F.coalesce(dedup.source_append(c(f"{pin}.url"), c(f"{pin}.sources"), c("link"))["added"], F.lit(False))
    took, w_added = c("appended_pin").isNotNull(), takes("w")
    # a write that hit a pin: that pin, unless it didn't take the link and an earlier match did; a maps link has no matches
    other = ~w_added & took & (c("step") != "maps")
    pin = (
        F.when(c("step") == "url", c("url_pin.pin_id")).when(c("step") == "content", c("content_pin.pin_id")).when(c("step") == "matches", F.coalesce("appended_pin", "first_match"))
        .when(c("w").isNotNull(), F.when(other, c("appended_pin")).otherwise(c("w.pin_id")))
    )
    added = F.when(c("step") == "content", takes("content_pin")).when(c("step") == "matches", took).when(c("w").isNotNull(), w_added | (took & (c("step") != "maps"))).otherwise(F.lit(False))
    status = F.when(c("step") == "none", "failed").when(c("step") == "candidates", "needs_selection").when(c("place").isNotNull() & c("w").isNull(), "complete").otherwise("duplicate")
    return j.select("job_id", status.alias("status"), pin.alias("pin"), F.when(c("w").isNull(), c("place")).alias("place_id"), added.alias("source_added"), "step")


def fail_if_pending(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Jobs (job_id, status, error) after failures (job_id, error): only one that is still pending turns to failed."""
    f = failures.groupBy("job_id").agg(F.min("error").alias("_e"))
    out = jobs.join(f, "job_id", "left")
    hit = F.col("_e").isNotNull() & F.coalesce(F.col("status") == "pending", F.lit(False))
    return out.withColumn("error", F.when(hit, F.col("_e")).otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("_e")
