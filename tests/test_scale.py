"""Window helpers against plain windows, with a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from atril.operators import scale


@pytest.fixture(scope="module")
def rows(spark):
    rnd, pos, out = random.Random(5), {}, []
    for i in range(900):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 12)
        pos[key] = pos.get(key, 0) + rnd.choice([1, 1, 2, 30])
        out.append((key, pos[key], f"v{i}" if rnd.random() < .4 else None, rnd.randrange(9)))
    return spark.createDataFrame(out, "k int, p long, v string, n int").repartition(7)


@pytest.mark.parametrize("span", [1, 7, 50, 100000])
def test_carry_last(rows, span):
    w = Window.partitionBy("k").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("o", F.last("v", ignorenulls=True).over(w)).select("k", "p", "o")
    got = scale.carry_last(rows, ["k"], F.col("p"), F.col("v"), "o", span).select("k", "p", "o")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("span", [1, 7, 50, 100000])
def test_preceding_rows(rows, span):
    w = Window.partitionBy("k").orderBy("p").rowsBetween(-4, -1)
    want = rows.withColumn("o", F.collect_list(F.struct("p", "n")).over(w)).select("k", "p", "o")
    got = scale.preceding_rows(rows, ["k"], F.col("p"), F.struct("p", "n"), 4, "o", span).select("k", "p", "o")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("width", [1, 13, 400])
def test_trailing_sum(rows, width):
    w = Window.partitionBy("k").orderBy("p").rangeBetween(-width, 0)
    want = rows.withColumn("o", F.sum("n").over(w)).select("k", "p", "o")
    got = scale.trailing_sum(rows, ["k"], F.col("p"), F.col("n"), width, "o").select("k", "p", "o")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_trailing_sum_is_linear(spark):
    """No frame with two moving ends, nulls as a plain window has them, and a hot key whose rows share positions."""
    rows = spark.createDataFrame([("a", None, 5), ("a", 3, None), ("b", 1, None), ("b", 2, 4), ("b", 2, 6), ("b", 9, None), (None, 2, 1)], "k string, p long, n long")
    hot = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") % 700).alias("p"), F.col("id").alias("n"))
    rows = rows.unionByName(hot)
    got = scale.trailing_sum(rows, ["k"], F.col("p"), F.col("n"), 3, "o").select("k", "p", "n", "o")
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString().replace("RangeFrame, unboundedpreceding$(), -1", "")
    w = Window.partitionBy("k").orderBy("p").rangeBetween(-3, 0)
    want = rows.where("p IS NOT NULL").withColumn("o", F.sum("n").over(w)).select("k", "p", "n", "o")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
