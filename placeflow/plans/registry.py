"""Names of queries, and rows written out for branches that the tables don't reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import oracle as written_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name; <name> in the oracle stands for a table or view."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = written_out(oracle)
        return f

    return put


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], *names: str) -> str:
    """The same rows as SQL, in parentheses."""

    def show(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, list):
            return "[" + ", ".join(map(show, x)) + "]"
        return repr(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in data)}) AS t({', '.join(names)}))"


def spread(spark: SparkSession, sf_dir: str, schema: str, data: list[tuple]) -> DataFrame:
    """A written-out row for every event, in turn: k (the event's number, at least 0), then the row's columns but the first; and each row once by itself, its first column negated as k."""
    from pyspark.sql import functions as F

    from ..sources.tables import frame

    some = rows(spark, schema, data)
    key, *names = some.columns
    kind = some.schema[key].dataType
    events = frame(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("k"))
    turn = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"_turn long, {schema}")
    every = events.withColumn("_turn", F.col("k") % len(data)).join(F.broadcast(turn), "_turn").select("k", *names)  # a row per branch
    return every.unionAll(some.select((-F.col(key).cast(kind)).cast("long").alias("k"), *names))


def spread_sql(data: list[tuple], *names: str) -> str:
    """The same rows as SQL, in parentheses."""
    turn = values([(i, *r[1:]) for i, r in enumerate(data)], "turn", *names[1:])
    some = ", ".join(names[1:])
    return f"(SELECT event_id::BIGINT AS k, {some} FROM events JOIN {turn} t ON t.turn = event_id % {len(data)} UNION ALL SELECT -{names[0]}::BIGINT, {some} FROM {values(data, *names)})"
