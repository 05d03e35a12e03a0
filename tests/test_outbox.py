"""No message is sent twice, whatever dies and whatever is written again."""

import pytest
from pyspark.sql import functions as F

from placeflow.sources.snapshots import Store
from placeflow.streaming import outbox as O

VERDICT = "job_id string, user_id string, status string, place_name string, pin_id string, source_added boolean"


def test_a_batch_that_dies_sends_nothing_twice(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    tokens = spark.createDataFrame([("u", "ExpoPushToken[a]"), ("v", None), ("w", "bad"), ("u", "ExpoPushToken[b]")], "user_id string, token string")
    rows = [(f"j{k}", "uvwx"[k % 4], "complete", "Joe", "P", False) for k in range(8)] + [("j9", "u", "processing", None, None, False), ("j0", "u", "complete", "Joe", "P", False)]
    O.messages(spark.createDataFrame(rows, VERDICT)).write.parquet(f"{tmp_path}/outbox")
    sent, deaths = [], ["after"]

    def provider(asked):
        got = asked.collect()
        sent.extend((r.job_id, r.token, r.body) for r in got)
        if deaths:
            deaths.pop()
            raise RuntimeError("lost")
        return spark.createDataFrame([(r.message_id, '[{"status":"ok"}]', None) for r in got], "message_id string, answer string, error string")

    run = lambda: O.drain(store, f"{tmp_path}/outbox", tokens, provider, f"{tmp_path}/cp").awaitTermination(120)
    with pytest.raises(Exception, match="lost"):
        run()
    assert sorted(sent) == [(f"j{k}", "ExpoPushToken[a]", "Joe added to your map") for k in (0, 4)]
    run()
    kept = lambda: {r.job_id: (r.status, r.error, r.token_present) for r in store.read("deliveries").collect()}
    assert kept() == {f"j{k}": ("dispatch_failed", O.INTERRUPTED, k % 4 in (0, 2)) for k in range(8)} and len(sent) == 2
    more = [*rows, ("j0", "u", "failed", None, None, False), ("j20", "w", "duplicate", "", "P", True), ("j21", "x", "failed", None, None, False), ("j22", "v", "failed", None, None, False)]
    O.messages(spark.createDataFrame(more, VERDICT)).write.mode("append").parquet(f"{tmp_path}/outbox")
    run()
    run()
    assert sorted(sent)[1:] == [("j0", "ExpoPushToken[a]", "Tap to see your failed link"), ("j4", "ExpoPushToken[a]", "Joe added to your map")]
    found = store.read("deliveries").filter("job_id in ('j0', 'j20', 'j21', 'j22') and error is distinct from '" + O.INTERRUPTED + "'")
    assert sorted((r.job_id, r.status, r.error, r.token_present) for r in found.collect()) == [("j0", "sent", None, True), ("j20", "no_token", "Invalid token format", True), ("j21", "no_token", None, False), ("j22", "no_token", None, False)]


def test_tickets(spark):
    tickets = [None, "[]", "nonsense", '[{"status":"ok"},{"status":"error"}]', '[{"status":"error","message":"m"},{"status":"error","details":{"error":"x"}}]', '[{"status":"error","details":{"error":"x"},"message":"m"}]']
    got = spark.createDataFrame([(t,) for t in tickets], "t string").select(O.ticket_error(F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == [None, None, None, "unknown", "m", "x"]
