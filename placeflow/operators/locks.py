"""Locks in a stored control table: locks that expire, and the migration lock behind a freeze of writes.

The table has a row per lock or flag (name, job_id, since). Every change is a commit of a new version, so of two jobs
that ask at once one finds a conflict, reads again and is refused.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import state as S
from ..sources.snapshots import Conflict, Store

TABLE, MIGRATION, FREEZE = "locks", "migrationInProgress", "freezeListMembershipWrites"
SCHEMA = "name string, job_id string, since timestamp_ntz"


def _decided(store: Store, name: str, decide, changes: dict[str, tuple | None], target: str | None = None, tries: int = 5) -> str:
    """The outcome that `decide` finds in a name's row; where `changes` has it, the row of `target` (the name's own) is replaced, or removed if None, in the same commit."""
    for k in range(tries):
        base = store.version(TABLE)
        now = store.read(TABLE, base) if base else store.spark.createDataFrame([], SCHEMA)
        found: DataFrame = store.spark.range(1).select(F.lit(name).alias("name")).join(now, "name", "left")
        frozen = now.agg(F.coalesce(F.max(F.col("name") == FREEZE), F.lit(False)).alias("freeze"))
        outcome = found.crossJoin(frozen).select(decide(F.col("job_id"), F.col("since"), F.col("freeze")).alias("o")).first()["o"]  # one row with one row
        if outcome not in changes:
            return outcome
        rest, row = now.filter(F.col("name") != (target or name)), changes[outcome]
        try:
            store.commit(TABLE, rest if row is None else rest.unionAll(store.spark.createDataFrame([row], SCHEMA)), base)
            return outcome
        except Conflict:
            if k == tries - 1:
                raise
    raise AssertionError


def acquire(store: Store, name: str, job: str, now: datetime, ttl_minutes: int = 30) -> str:
    """acquired, taken_over or refused."""
    mine = (name, job, now)
    return _decided(store, name, lambda holder, since, _: S.ttl_lock(holder, since, F.lit(now), ttl_minutes), {"acquired": mine, "taken_over": mine})


def renew(store: Store, name: str, job: str, now: datetime) -> str:
    """renewed, not-owner or missing."""
    return _decided(store, name, lambda holder, *_: S.renewal(holder, F.lit(job)), {"renewed": (name, job, now)})


def release(store: Store, name: str, job: str) -> bool:
    """Whether the lock was the job's own, and so is gone."""
    return _decided(store, name, lambda holder, *_: S.renewal(holder, F.lit(job)), {"renewed": None}) == "renewed"


def freeze(store: Store) -> None:
    _decided(store, FREEZE, lambda *_: F.lit("frozen"), {"frozen": (FREEZE, None, None)})


def unfreeze(store: Store) -> str:
    """unfrozen, or in_progress while a migration holds its lock."""
    return _decided(store, MIGRATION, lambda holder, *_: S.unfreeze(holder), {"unfrozen": None}, target=FREEZE)


def begin_migration(store: Store, job: str, now: datetime) -> str:
    """acquired, not_frozen or in_progress."""
    return _decided(store, MIGRATION, lambda holder, _, frozen: S.migration_lock(frozen, holder), {"acquired": (MIGRATION, job, now)})


def end_migration(store: Store, job: str) -> bool:
    return release(store, MIGRATION, job)
