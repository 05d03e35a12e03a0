"""Fields without a fixed type: their values, and that one look at a row gives them."""

import json

from pyspark.sql import functions as F

from placeflow.functions import variant as V

ARRAYS = [None, "null", "[]", '["a"]', '["a",null]', "[null]", '["a",""]', '["a",1]', '["a",["b"]]', '["a",{"b":1}]', "[1,2]", "[[]]", "[{}]", '"a"', "{}", '{"a":1}', "1.5", "true", "x"]


def test_kinds_and_string_arrays(spark):
    v = F.try_parse_json("x")
    got = spark.createDataFrame([(i, x) for i, x in enumerate(ARRAYS)], "i int, x string").select("i", V.kind(v).alias("kind"), V.string_array(v).alias("state"), V.string_array(v, 0).alias("none"), V.strings(v).alias("strings"), V.text_of(v).alias("text"), F.size(V.items(v)).alias("n"))
    for r in got.collect():
        x = ARRAYS[r.i]
        missing = x in (None, "x")
        val = None if missing else json.loads(x)
        kinds = {type(None): "null", list: "array", dict: "object", str: "string", bool: "boolean", float: "number"}
        fine = isinstance(val, list) and all(isinstance(e, str) and e for e in val)
        assert r.kind == ("absent" if missing else kinds[type(val)]), x
        assert r.state == ("absent" if missing else "authoritative" if fine else "malformed"), x
        assert r.none == ("absent" if missing else "authoritative" if val == [] else "malformed"), x
        assert r.strings == (val if fine else []) and r.text == (val if isinstance(val, str) else None), x
        assert r.n == (len(val) if isinstance(val, list) else None), x


def test_one_look_at_a_row(spark):
    """No branch works a schema out again, and no function in an array reads a variant: those aren't compiled."""
    rows = spark.createDataFrame([("{}", "{}")], "a string, b string").select(F.try_parse_json("a").alias("a"), F.try_parse_json("b").alias("b"))
    shown = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert shown(V.kind(F.col("a"))).count("schema_of_variant") == 1
    for c in (V.string_array(F.col("a")), V.strings(F.col("a")), V.effective(F.lit(None).cast("array<struct<key:string,op:string,value:string>>"), F.col("b")), V.bad_keys(F.col("b"))):
        assert "lambda" not in shown(c)
    assert shown(V.edits(F.col("a"))).count("lambdafunction(") == 1  # the keys that can't be edited, rejected by name
