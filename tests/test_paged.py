"""A backfill that is killed, loses its lock or is raced ends as one whole run does."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placeflow.operators import locks
from placeflow.operators.paged import backfill
from placeflow.sources.snapshots import Store

START, BUCKETS = datetime(2024, 1, 1), 5


class Clock:
    def __init__(self):
        self.now, self.step = START, timedelta(seconds=1)

    def __call__(self):
        self.now += self.step
        return self.now


def stored(spark, path):
    store = Store(spark, f"file://{path}")
    rows = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"), F.lit(None).cast("long").alias("double"))
    store.commit("t", rows, 0, "key", BUCKETS)
    return store


def derive(rows):
    return rows.withColumn("new", F.col("n") * 2).withColumn("outcome", F.when(F.col("double").isNotNull(), "skipped").when(F.col("n") % 4 == 0, "none").otherwise("updated"))


def run(store, clock, f=derive, **more):
    return backfill(store, "t", "job", f, {"double": "new"}, ["n", "double"], clock, **more)


def rows(store):
    return sorted((r.key, r.n, r.double) for r in store.read("t").collect())


WANT = sorted((f"k{k}", k, 2 * k if k % 4 else None) for k in range(60))


@pytest.mark.parametrize("page", [0, 2, 4])
def test_killed_in_any_page(spark, tmp_path, page):
    store, clock, seen = stored(spark, tmp_path), Clock(), []

    def dies(rows):
        seen.append(1)
        if len(seen) == page + 1:
            raise RuntimeError("killed")
        return derive(rows)

    with pytest.raises(RuntimeError):
        run(store, clock, dies)
    assert store.manifest("t").get("notes", {}).get("job", {}).get("next", 0) == page
    report = run(store, clock)
    assert (report["pages"], report["done"], report["aborted"]) == (BUCKETS - page, True, None)
    assert report["counts"] == {"updated": 45, "none": 15} and rows(store) == WANT
    assert run(store, clock)["counts"] == {"skipped": 45, "none": 15}  # anew


def test_lock_lost_refused_or_late(spark, tmp_path):
    store, clock = stored(spark, tmp_path), Clock()
    stolen = []

    def steal(page):
        if page == {1} and not stolen:
            stolen.append(locks.acquire(store, "job", "thief", clock.now + timedelta(hours=1)))

    report = run(store, clock, planned=steal)
    assert stolen == ["taken_over"] and report["aborted"] == "lock lost (not-owner)" and report["pages"] == 1 and not report["done"]
    assert run(store, clock)["aborted"] == "lock refused"
    locks.release(store, "job", "thief")
    late = run(store, clock, planned=lambda page: setattr(clock, "now", clock.now + timedelta(minutes=26)))
    assert late["aborted"] == "lock not renewed in time" and late["pages"] == 0
    last = run(store, clock)
    assert last["done"] and last["counts"] == {"updated": 45, "none": 15} and rows(store) == WANT
    assert locks.acquire(store, "job", "next", clock.now) == "acquired"  # it was released


def test_raced_rows_are_left_alone(spark, tmp_path):
    """Others change some rows, remove one and add one between a page's plan and its commit; their writes stay."""
    store, clock = stored(spark, tmp_path), Clock()

    def meanwhile(page):
        now = store.read("t", None, page)
        store.upsert("t", now.filter("n in (1, 2, 3, 4)").withColumn("double", F.lit(-1).cast("long")))
        store.delete("t", now.filter("n = 5").select("key"))

    report = run(store, clock, planned=meanwhile)
    assert report["counts"] == {"updated": 41, "none": 15, "raced": 4}
    want = {k: (n, -1 if n in (1, 2, 3, 4) else d) for k, n, d in WANT if n != 5}
    assert {k: (n, d) for k, n, d in rows(store)} == want


def test_dry_and_plans_are_made_once(spark, tmp_path):
    store, clock = stored(spark, tmp_path), Clock()
    version, asked = store.version("t"), spark.sparkContext.accumulator(0)
    assert run(store, clock, dry=True)["counts"] == {"updated": 45, "none": 15} and store.version("t") == version

    def costly(batch):
        for b in batch:
            asked.add(len(b))
            yield b

    report = run(store, clock, lambda r: derive(r.mapInPandas(costly, r.schema)), size=2)
    assert report["pages"] == 3 and rows(store) == WANT and asked.value == 60


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = Store(spark, f"file://{tmp_path}")
        store.commit("t", spark.range(0, 200_000, 1, 8).selectExpr("cast(id as string) as k", "sha2(cast(id as string), 256) as v"), 0, "k", 2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list(tmp_path.glob("t/rows-*/_bucket=0/*.parquet"))) > 1 and store.read("t").select("k").distinct().count() == 200_000
