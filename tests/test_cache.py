"""The cache's answers against a loop over an ordered dict, over restarts, with the state it keeps."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from placeflow.plans import stored
from placeflow.session import ship
from placeflow.streaming import caching as C

SCHEMA = "pos long, at timestamp, op string, key string, value string"


def loop(rows, most, ttl_s):
    """Rows (shard, pos, ms, op, key, value) in order; answers and what each shard holds in the end."""
    shards, last, out = {}, {}, []
    for shard, pos, ms, op, key, value in sorted(rows, key=lambda r: r[1]):
        held = shards.setdefault(shard, {})
        if shard in last and ms - last[shard] > ttl_s * 1000:
            held.clear()
        outcome, got, evicted = "miss", None, None
        if op == "get":
            if key in held and ms - held[key][1] > ttl_s * 1000:
                del held[key]
                outcome = "expired"
            elif key in held:
                outcome, got = "hit", held[key][0]
        else:
            if len(held) > most:
                evicted = next(iter(held))
                del held[evicted]
            held[key] = (value, ms)
            last[shard] = max(ms, last.get(shard, ms))
            outcome, got = "stored", value
        out.append((shard, pos, op, key, outcome, got, evicted))
    return sorted(out), shards


def asked(rows, shards):
    return rows.withColumn("shard", C.shard_of(F.col("key"), shards)).withColumn("ms", F.unix_millis("at")).select("shard", "pos", "ms", "op", "key", "value")


def test_query_by_a_loop(spark, small):
    got = sorted(tuple(r) for r in stored.cache_answers(spark, small).collect())
    rows = stored.cache_requests(spark, small).withColumn("pos", F.unix_micros("at"))
    want, _ = loop([tuple(r) for r in asked(rows, 8).collect()], 10, 3 * 24 * 3600)
    assert got == want and {r[4] for r in want} == {"hit", "miss", "expired", "stored"} and any(r[6] for r in want)


def test_batches_of_any_order_and_a_full_shard(spark, tmp_path):
    """Three runs from one checkpoint; within a run rows lie in any order, and one shard's rows fill several Arrow batches."""
    rng = random.Random(1)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, start + timedelta(seconds=20 * k), rng.choice(["get", "set", "set"]), f"k{rng.randrange(60)}", f"v{k}") for k in range(2500)]
    rows += [(2500 + k, start + timedelta(days=9, seconds=k), rng.choice(["get", "set"]), f"k{rng.randrange(60)}", f"v{k}") for k in range(300)]
    odd = [(9000, start, "get", None, ""), (9001, start, "drop", "k1", ""), (9002, start, None, "k1", "")]
    ship(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        for k, part in enumerate((rows[:1000], rows[1000:2500], rows[2500:])):
            part = part + (odd if k == 0 else [])
            spark.createDataFrame(rng.sample(part, len(part)), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/b{k}")
            C.answer(stream, f"{tmp_path}/out", f"{tmp_path}/cp", shards=2, most=10, ttl_s=4 * 3600)
            C.answer(stream, f"{tmp_path}/out", f"{tmp_path}/cp", shards=2, most=10, ttl_s=4 * 3600)  # nothing new
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted(tuple(r) for r in spark.read.schema(C.OUT).parquet(f"{tmp_path}/out").collect())
    want, held = loop([tuple(r) for r in asked(spark.createDataFrame(rows, SCHEMA), 2).collect()], 10, 4 * 3600)
    assert got == want and sum(r[6] is not None for r in want) > 500
    state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "entries").load()
    assert state.count() == sum(map(len, held.values())) <= 22
    assert spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "queue").load().count() <= 22


class _Held:
    """A state variable in memory that counts its calls."""

    calls = 0

    def __init__(self):
        self.held, self.one = {}, None

    def __getattr__(self, name):
        type(self).calls += 1
        return {
            "get": lambda: self.one, "update": lambda v: setattr(self, "one", v), "iterator": lambda: iter(list(self.held.items())), "getValue": self.held.get,
            "updateValue": self.held.__setitem__, "removeKey": lambda k: self.held.pop(k, None), "clear": lambda: (self.held.clear(), setattr(self, "one", None)),
            "getMapState": lambda *_: _Held(), "getValueState": lambda *_: _Held(), "registerTimer": lambda _: None, "deleteTimer": lambda _: None,
        }[name]


def test_a_shard_asks_its_state_once_a_batch_and_answers_in_parts():
    shard = C._Shard(10, 10**9)
    shard.init(_Held())
    rows = [(k, k, "set" if k % 3 else "get", f"k{k % 30}", f"v{k}") for k in range(40_000)]
    random.Random(2).shuffle(rows)
    frames = (pd.DataFrame(rows[i : i + 7000], columns=["pos", "ms", "op", "key", "value"]) for i in range(0, len(rows), 7000))
    _Held.calls = 0
    got = list(shard.handleInputRows((0,), frames, None))
    assert len(got) > 1 and max(map(len, got)) <= 10_000 and _Held.calls < 100
    want, held = loop([(0, *r) for r in rows], 10, 10**6)
    assert sorted(tuple(r) for f in got for r in f.astype(object).where(f.notna(), None).itertuples(index=False)) == want
    assert {k[0]: v[:2] for k, v in shard.entries.held.items()} == held[0] and len(shard.queue.held) == 11
