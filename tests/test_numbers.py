"""Rounding by exact binary values, and joins that must be complete."""

import random
import struct

import pytest
from colloquy.functions import text as X
from colloquy.operators import joins as K
from pyspark.sql import functions as F


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_rounding_as_python_does(spark, digits):
    rng = random.Random(digits)
    values = [2.675, 0.0005, 0.0015, 1.0005, 0.5, 1.5, 2.5, 0.125, 0.375, 1e-300, 0.0, 4.35, 1e15 + 0.3, 1e300, 0.9999999999999999, 1234567.0005]
    values += [rng.randrange(10**7) / 1000 + 0.0005 for _ in range(20_000)] + [rng.randrange(10**6) / 16 for _ in range(5_000)]
    values += [rng.random() * 10 ** rng.randint(-6, 9) for _ in range(60_000)]
    values += [v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(20_000)) if abs(v) < 4e11]
    values += [-v for v in values[:2000]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r.v, r.got) for r in df.select("v", X.round_binary(F.col("v"), digits).alias("got")).collect() if r.got != round(r.v, digits)]
    assert not wrong, wrong[:5]


def test_rounding_what_is_no_number(spark):
    df = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "v double")
    got = [r.got for r in df.select(X.round_binary(F.col("v")).alias("got")).collect()]
    assert got[0] == float("inf") and got[1] is None and got[2] != got[2]


def test_joins_that_must_be_complete(spark):
    items = spark.createDataFrame([(1,), (2,)], "id int")
    responses = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "id int, n int, said string")
    assert sorted((r.id, r.said, r.missing) for r in K.completed(items, responses, "id", "n", must=True).collect()) == [(1, "b", False), (2, "c", False)]
    assert sorted((r.id, r.missing) for r in K.completed(items, responses.where("id = 1"), "id", "n").collect()) == [(1, False), (2, True)]
    with pytest.raises(Exception, match="no response to 2"):
        K.completed(items, responses.where("id = 1"), "id", "n", must=True).collect()
    records = spark.createDataFrame([("s", "r"), ("t", "r")], "source_id string, reference string")
    scopes = records.select("source_id", F.sha2("reference", 256).alias("reference_sha256"), F.lit("wide").alias("scope"))
    assert {r.scope for r in K.frozen_scope(records, scopes, must=True).collect()} == {"wide"}
    with pytest.raises(Exception, match="no frozen scope for t"):
        K.frozen_scope(records, scopes.where("source_id = 's'"), must=True).collect()
