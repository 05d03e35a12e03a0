"""Backfills of stored tables by pages: each page's rows and the place to go on are one commit, under a lock that is renewed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.snapshots import Conflict, Store
from . import locks
from .backfill import still_same

Derive = Callable[[DataFrame], DataFrame]


def backfill(
    store: Store, table: str, name: str, derive: Derive, writes: dict[str, str], compared: list[str], clock: Callable[[], datetime], job: str | None = None,
    size: int = 1, ttl_minutes: int = 30, margin_minutes: int = 5, dry: bool = False, tries: int = 5,
    planned: Callable[[set[int]], None] | None = None,
) -> dict:
    """Runs a backfill from where it stopped, and reports job, pages, counts by outcome, done, and aborted (the reason, or null).

    A page is `size` buckets of the table, so all pages together read and write it once, whatever its size. `derive` plans a
    page's rows: the table's key, `outcome`, the columns `compared`, and for rows marked updated what `writes` (column: plan's
    column) puts in. Plans are written before they are used, so what they ask of outside services is asked once.
    A planned row that somebody else changed since in a compared column, or removed, is left alone and counts as raced.

    With each page the version notes the next bucket and the counts so far. A run that was killed after any page goes on there; one that
    was killed within a page does that page again. The lock is renewed before each page and before its commit; one that is lost, or was not
    renewed in time, aborts the run. A finished backfill starts anew when called again. A dry run notes and writes nothing.
    """
    job = job or uuid.uuid4().hex
    report = {"job": job, "pages": 0, "counts": {}, "done": False, "aborted": None}
    if (got := locks.acquire(store, name, job, clock(), ttl_minutes)) == "refused":
        return {**report, "aborted": "lock refused"}
    alive, m = clock(), store.manifest(table)
    note = m.get("notes", {}).get(name) or {}
    at, report["counts"] = (0, {}) if dry or note.get("done") else (note.get("next", 0), note.get("counts", {}))

    def holds() -> bool:
        nonlocal alive
        if clock() - alive > timedelta(minutes=ttl_minutes - margin_minutes):
            report["aborted"] = "lock not renewed in time"
        elif (found := locks.renew(store, name, job, clock())) != "renewed":
            report["aborted"] = f"lock lost ({found})"
        else:
            alive = clock()
        return report["aborted"] is None

    try:
        while at < m["buckets"] and holds():
            page = set(range(at, min(at + size, m["buckets"])))
            plan = written(derive(store.read(table, None, page)))
            if planned:
                planned(page)
            for k in range(tries):
                if not dry and not holds():
                    return report
                base = store.version(table)
                now = store.read(table, base, page)
                checked = still_same(plan, now, m["key"], compared)
                found = {r["outcome"]: r["n"] for r in checked.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # as many as there are outcomes
                counts = {o: report["counts"].get(o, 0) + found.get(o, 0) for o in {*report["counts"], *found}}
                after = min(at + size, m["buckets"])
                if dry:
                    break
                try:
                    store.commit_buckets(table, _applied(now, checked, m["key"], writes), base, page, {name: {"job": job, "next": after, "counts": counts, "done": after == m["buckets"]}})
                    break
                except Conflict:
                    if k == tries - 1:
                        raise
            at, report["counts"], report["pages"] = after, counts, report["pages"] + 1
        report["done"] = at >= m["buckets"]
        return report
    finally:
        locks.release(store, name, job)


def _applied(now: DataFrame, plan: DataFrame, key: str, writes: dict[str, str]) -> DataFrame:
    new = plan.filter("outcome = 'updated'").select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(p).alias(f"_new_{c}") for c, p in writes.items()])
    out = now.join(new, now[key] == F.col("_key"), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(now[c]).alias(c) if c in writes else now[c] for c in now.columns])
