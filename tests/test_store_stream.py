"""Snapshots, and streams that give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from placeflow.plans import stored
from placeflow.sources.snapshots import Conflict, Store, bucket, merge, with_id
from placeflow.streaming import feed, jobs


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, t string")
    assert store.commit("t", rows, 0) == 1
    with pytest.raises(Conflict):
        store.commit("t", rows, 0)
    patch = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "id string, n int, t string")
    assert store.update("t", lambda now: merge(now, patch, "id")) == 2
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1, None), ("b", 2, "y"), ("c", 3, None)]
    assert sorted(map(tuple, store.read("t", 1).collect())) == [("a", 1, None), ("b", 2, "x")]


def test_two_writers_of_one_version(spark, tmp_path):
    """Both wrote their rows when the version was free; one commits, and its rows are whole."""
    a, b = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    a.commit("t", spark.range(3), 0)
    b.version = lambda table: 0
    with pytest.raises(Conflict):
        b.commit("t", spark.range(5), 0)
    assert a.read("t").count() == 3 and a.version("t") == 1


def test_ids(spark):
    rows = with_id(spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None)], "x string, y string"), "x", "y")
    assert len({r.id for r in rows.collect()}) == 3


def test_claim_stream(spark, tmp_path):
    events = [("j1", 1, "processing"), ("j1", 2, "pending"), ("j1", 3, "pending"), ("j2", 4, None), ("j2", 5, "pending"), ("j3", 6, "complete")]
    for k, part in enumerate((events[:2], events[2:5], events[5:])):
        spark.createDataFrame(part, "job_id string, pos long, status string").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("job_id string, pos long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.claims(stream).writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("claims").collect()
    assert len(got) == 6
    winners = [r.job_id for r in got if r.run]
    assert sorted(winners) == ["j1", "j2"]


def test_merge_stream_and_sweep(spark, tmp_path):
    schema = "job_id string, pos long, status string, updated_at timestamp, created_at timestamp, failure_reason string"
    rows = spark.sql("SELECT 'a' AS job_id, 1L AS pos, 'processing' AS status, timestamp'2024-01-01 00:00:00' AS updated_at, timestamp'2024-01-01 00:00:00' AS created_at, cast(NULL AS string) AS failure_reason UNION ALL SELECT 'b', 2L, 'processing', timestamp'2024-01-01 00:09:00', timestamp'2024-01-01 00:00:00', NULL")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/x")
    store = Store(spark, f"file://{tmp_path}/store")
    jobs.into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), store, "jobs", "job_id", f"{tmp_path}/cp").awaitTermination(120)
    jobs.swept(store, "jobs", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert {r.job_id: r.status for r in store.read("jobs").collect()} == {"a": "failed", "b": "processing"}


def test_handled(spark):
    rows = spark.createDataFrame([("pending", "u", "a", 0, 200), ("pending", "u", "a", 0, None)], "status string, url string, user_id string, age_s long, http int")
    assert [r.outcome for r in jobs.handled(rows).collect()] == ["ok", "retry"]


def keyed(spark, tmp_path, n=200, buckets=16):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit("t", spark.range(n).selectExpr("concat('k', id) AS id", "id AS n", "cast(NULL AS string) AS t"), 0, "id", buckets)
    return store


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_patch_writes_the_buckets_of_its_keys_alone(spark, tmp_path):
    store = keyed(spark, tmp_path)
    before, at = store.manifest("t")["folders"], tmp_path / "store/t"
    old = files(at)
    rows = spark.createDataFrame([("k3", 30, "x"), ("k4", None, "y"), ("new", 1, None)], "id string, n long, t string")
    touched = {str(r[0]) for r in rows.select(bucket(F.col("id"), 16)).collect()}
    assert store.upsert("t", rows) == 2
    after = store.manifest("t")["folders"]
    assert {b for b in after if after[b] != before.get(b)} == touched
    fresh = files(at) - old
    assert fresh and {f.split("_bucket=")[1].split("/")[0] for f in fresh} == touched and len(touched) <= 3
    got = {r.id: (r.n, r.t) for r in store.read("t").collect()}
    assert len(got) == 201 and got["k3"] == (30, "x") and got["k4"] == (4, "y") and got["k5"] == (5, None)
    assert store.delete("t", spark.createDataFrame([("k3",), ("nobody",)], "id string")) == 3
    assert store.read("t").count() == 200 and store.read("t", 1).count() == 200
    assert store.upsert("t", rows.limit(0)) == 3
    assert store.update("t", lambda now: now.filter("n < 10")) == 4 and store.read("t").count() < 12
    assert store.manifest("t")["buckets"] == 16


def test_patches_of_two_writers(spark, tmp_path):
    """The second writer of a version finds a conflict, reads again, and loses nothing of the first."""
    a, b = keyed(spark, tmp_path), Store(spark, f"file://{tmp_path}/store")
    rows = lambda k: spark.createDataFrame([(f"k{k}", -1, "z")], "id string, n long, t string")
    real, calls = b.version, []

    def late(table):
        found = real(table)
        if not calls:
            calls.append(1)
            a.upsert("t", rows(1))
        return found

    b.version = late
    assert b.upsert("t", rows(2)) == 3
    assert {r.id for r in a.read("t").filter("n = -1").collect()} == {"k1", "k2"}


def test_changes_and_vacuum(spark, tmp_path):
    store = keyed(spark, tmp_path, 20, 4)
    store.upsert("t", spark.createDataFrame([("k1", 100, None), ("k2", 2, None), ("k99", 9, "t")], "id string, n long, t string"))
    store.delete("t", spark.createDataFrame([("k5",)], "id string"))
    shown = lambda a, b: sorted((r.id, r.op, r.before and r.before.n, r.after and r.after.n) for r in store.changes("t", a, b).collect())
    assert shown(1, 2) == [("k1", "changed", 1, 100), ("k99", "created", None, 9)]
    assert shown(2, 3) == [("k5", "removed", 5, None)]
    assert shown(1, 3) == sorted(shown(1, 2) + shown(2, 3)) and shown(3, 3) == [] and len(shown(0, 1)) == 20
    (tmp_path / "store/t/rows-dead").mkdir()
    (tmp_path / "store/t/versions/4").touch()
    assert store.version("t") == 3 and store.vacuum("t", 1) == []
    gone = store.vacuum("t", 1, -1)
    assert {"1", "2", "4", "rows-dead"} <= set(gone) and store.versions("t") == [3]
    assert store.read("t").count() == 20


def test_commit_tells_other_errors_from_conflicts(spark, tmp_path):
    store = keyed(spark, tmp_path)
    (tmp_path / "store/u").mkdir()
    (tmp_path / "store/u/versions").touch()  # a file where the folder should be
    with pytest.raises(Exception) as e:
        store.commit("u", spark.range(2), 0)
    assert not isinstance(e.value, Conflict)


def test_feed_that_fails_in_the_middle(spark, tmp_path):
    """A batch of three versions dies at its second; started again it handles all, none twice, and later versions after a restart."""
    store = keyed(spark, tmp_path, 30, 4)
    add = lambda *ids: store.upsert("t", spark.createDataFrame([(i, 1, None) for i in ids], "id string, n long, t string"))
    add("a"), add("b", "k1")
    tries = []

    def handle(rows):
        tries.append(rows.first().version)
        if len(tries) == 2:
            raise RuntimeError("lost")
        return rows

    run = lambda: feed.feed(store, "t", f"{tmp_path}/cp", f"{tmp_path}/out", handle).awaitTermination(120)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    add("c")
    run()
    run()
    got = sorted((r.version, r.id, r.op) for r in spark.read.parquet(f"{tmp_path}/out").filter("version > 1").collect())
    assert got == [(2, "a", "created"), (3, "b", "created"), (4, "c", "created")]
    assert tries == [1, 2, 1, 2, 3, 4] and spark.read.parquet(f"{tmp_path}/out").filter("version = 1").count() == 30


def test_settled_jobs(spark, small, tmp_path):
    store = Store(spark, f"file://{tmp_path}/jobs")
    handled = stored.fed(spark, small, store, 8)
    why = {r.job_id: r.outcome for r in handled.filter("outcome is not null").collect()}
    jobs = store.read("jobs").collect()
    assert any(r.failure_reason for r in jobs) and all((r.failure_reason or why[r.job_id]) == why[r.job_id] for r in jobs)
    assert not [r for r in jobs if r.status == "pending" and why[r.job_id] not in ("ok", "retry")]
