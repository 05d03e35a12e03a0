"""Jobs: error kinds, outcomes, keys and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, trim

# fixed values: patterns of error messages by kind, first match wins
ERRORS = {
    "dependency_timeout": r"timeout|etimedout|esockettimedout",
    "quota_exhausted": r"429|rate.?limit|quota|exceeded",
    "blocked": r"403|forbidden|blocked|access.?denied",
    "parse_error": r"parse|json|invalid",
}
# fixed values: what the extractor's error output says, by code, first match wins
EXTRACTOR_CODES = {
    "UNSUPPORTED_URL_TYPE": ("unsupported url",),
    "IP_BLOCKED": ("ip address is blocked",),
    "PRIVATE": ("private",),
    "BLOCKED": ("login required", "not granting access", "empty media response", "rate-limit", "rate limit"),
    "DELETED": ("deleted", "not available"),
}
SAVE_REASONS = ("manual", "clone", "enrichment")
TERMINAL = ("complete", "duplicate", "failed", "needs_selection")


def error_kind(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F
    for kind, pattern in ERRORS.items():
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("dependency_error")


def extractor_code(stderr: Column) -> Column:
    low, out = F.lower(F.coalesce(stderr, F.lit(""))), F
    for code, phrases in EXTRACTOR_CODES.items():
        test = F.lit(False)
        for p in phrases:
            test = test | low.contains(p)
        out = out.when(test, code)
    return out.otherwise("UNKNOWN")


def assert_save_reason(reason: Column) -> Column:
    """The reason, or a failed query where it is none of the known ones."""
    return F.when(reason.isin(*SAVE_REASONS), reason).otherwise(F.raise_error(F.concat(F.lit("invalid saveReason: "), F.coalesce(reason, F.lit("null")))))


def signal_id(user: Column, city: Column, country: Column) -> Column:
    """user_city_country in lower case with separators as underscores; null where a part has nothing left. Accents stay."""

    def part(x: Column) -> Column:
        x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[/\\.\x00-\x1f]", "_")
        x = F.regexp_replace(F.regexp_replace(x, f"{SPACE}+", "_"), "_+", "_")
        return F.nullif(F.regexp_replace(x, "^_+|_+$", ""), F.lit(""))

    parts = [part(x) for x in (user, city, country)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat_ws("_", *parts))


def candidate_query(name: Column, address: Column, city: Column) -> Column:
    """What to search for a candidate; null (unresolved) under three characters."""
    q = F.concat_ws(" ", *[F.nullif(trim(x), F.lit("")) for x in (name, address, city)])
    return F.when(F.length(q) >= 3, q)


def search_key(query: Column, lat: Column | None = None, lng: Column | None = None, box: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """The key of a place search: of the query alone, near a point, or inside a box (low and high corner, two decimals)."""
    where = F.lit("")
    if box is not None:
        low, high = (F.concat(F.format_string("%.2f", a), F.lit(","), F.format_string("%.2f", b)) for a, b in (box[:2], box[2:]))
        where = F.concat(F.lit("#rect:"), low, F.lit("-"), high)
    elif lat is not None:
        where = F.concat(F.lit("@"), lat.cast("string"), F.lit(","), lng.cast("string"))
    return trim(F.lower(F.concat(F.lit("places:search:"), query, where)))


def details_key(place: Column) -> Column:
    return F.concat(F.lit("places:details:v3:"), place)


def extract_key(title: Column, description: Column) -> Column:
    head = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, 50)
    return F.concat_ws(":", F.lit("ai:extract"), head(title), head(description))


def candidates_key(title: Column, description: Column, subtitles: Column, mentions: Column) -> Column:
    head = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    return F.concat_ws(":", F.lit("ai:places"), head(title, 50), head(description, 50), head(subtitles, 30), head(F.array_join(F.slice(mentions, 1, 5), ","), 50))


def vision_key(content: Column, images: Column) -> Column:
    """By content id, which all shares of a post have, else by the head of its first image's link."""
    return F.concat(F.lit("ai:vision:v3:"), F.coalesce(F.nullif(content, F.lit("")), F.substring(F.get(images, F.lit(0)), 1, 60), F.lit("")))


def context_names(names: Column, siblings: Column) -> Column:
    """The different names of places and siblings in order."""
    return F.array_distinct(F.concat(names, siblings))


def ttl_lock(holder: Column, since: Column, now: Column, ttl_minutes: int = 30) -> Column:
    """What asking for a lock that expires does: acquired, taken_over (the holder's is as old as ttl, or of no known age) or refused, even to the holder itself."""
    old = F.coalesce(since <= now - F.expr(f"INTERVAL {ttl_minutes} MINUTES"), F.lit(True))
    return F.when(holder.isNull(), "acquired").when(old, "taken_over").otherwise("refused")


def renewal(holder: Column, job: Column) -> Column:
    """renewed, not-owner or missing: only the holder renews or releases a lock."""
    return F.when(holder.isNull(), "missing").when(holder != job, "not-owner").otherwise("renewed")


def must_stop(since: Column, now: Column, ttl_minutes: int = 30, margin_minutes: int = 2) -> Column:
    """Whether a job that last renewed at `since` is within the margin of losing its lock."""
    return now >= since + F.expr(f"INTERVAL {ttl_minutes - margin_minutes} MINUTES")


def migration_lock(freeze: Column, holder: Column) -> Column:
    """What asking for the migration lock does: it needs writes frozen (true, nothing like it) and no holder."""
    return F.when(~F.coalesce(freeze, F.lit(False)), "not_frozen").when(holder.isNotNull(), "in_progress").otherwise("acquired")


def unfreeze(holder: Column) -> Column:
    return F.when(holder.isNotNull(), "in_progress").otherwise("unfrozen")


# fixed values: the types, titles and texts of the messages
def push_message(status: Column, added: Column, name: Column) -> Column:
    """struct(type, title, body) of a finished job's message; null for other states."""
    named = F.nullif(name, F.lit(""))
    say = lambda t, title, body: F.struct(F.lit(t).alias("type"), F.lit(title).alias("title"), body.alias("body"))
    kept = F.when(added, F.coalesce(F.concat(named, F.lit(" — new link added")), F.lit("New link added to a place you saved")))
    return (
        F.when(status == "complete", say("pin_saved", "📍 Pin saved!", F.coalesce(F.concat(named, F.lit(" added to your map")), F.lit("Your link is on the map"))))
        .when(status == "duplicate", say("pin_duplicate", "Already on your map", F.coalesce(kept, F.concat(named, F.lit(" — already saved")), F.lit("This place is already saved"))))
        .when(status == "needs_selection", say("pin_needs_selection", "Multiple places found", F.lit("Tap to choose which to save")))
        .when(status == "failed", say("pin_failed", "Couldn't find a place", F.lit("Tap to see your failed link")))
    )


def stale(status: Column, updated: Column, created: Column, now: Column) -> Column:
    """Whether a sweep at `now` fails a job: processing, and silent for 2 minutes or 30 minutes old."""
    return F.coalesce((status == "processing") & (F.coalesce(updated < now - F.expr("INTERVAL 2 MINUTES"), F.lit(False)) | F.coalesce(created < now - F.expr("INTERVAL 30 MINUTES"), F.lit(False))), F.lit(False))


def created_outcome(status: Column, url: Column, user: Column, age_s: Column, http: Column) -> Column:
    """What the on-created handler does with a job: skip, fail with an error, accept or retry. Null http: no answer came."""
    some = lambda x: F.coalesce(x != "", F.lit(False))
    return (
        F.when(~F.coalesce(status == "pending", F.lit(False)), "skip")
        .when(~some(url) | ~some(user), "malformed_pending_doc")
        .when(age_s > 30 * 60, "cloud_function_max_retry_exceeded")
        .when(http.isin(200, 202), "ok")
        .when(http.between(400, 499), F.concat(F.lit("enrich_http_"), http.cast("string")))
        .otherwise("retry")
    )


def claim_outcome(found: Column, same: Column, status: Column, admin: Column) -> Column:
    """struct(code, run) of a claim: does the job exist, do user and link agree, its state, is the caller the dispatcher."""
    answer = lambda code, run: F.struct(F.lit(code).alias("code"), F.lit(run).alias("run"))
    return (
        F.when(found & ~F.coalesce(same, F.lit(False)), answer(403, False))
        .when(found & (status == "processing"), answer(202, False))
        .when(found & (F.coalesce(status, F.lit("")) != "") & (status != "pending"), answer(200, False))
        .when(found, answer(202, True))
        .when(admin, answer(403, False))
        .otherwise(answer(202, True))
    )
