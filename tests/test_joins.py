"""Equi-join with a key that holds a third of the rows."""

from pyspark.sql import functions as F

from querylab.operators import relational as R


def sides(spark):
    left = spark.range(30_000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 5_000).alias("k"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (None, "n"), (8, "c"), (9_999, "d")] + [(k, f"v{k}") for k in range(0, 5_000, 3)],
                                  "rk long, v string")
    return left, right


def test_pairs_are_those_of_the_plain_join(spark):
    left, right = sides(spark)
    plain = left.join(right, F.col("k") == F.col("rk"))
    got = R.skew_join(left, right, "k", "rk", ["row"])
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert R.skew_join(left.limit(0), right, "k", "rk", ["row"]).count() == 0
    assert R.skew_join(left, right.limit(0), "k", "rk", ["row"]).count() == 0


def test_text_keys(spark):
    left, right = sides(spark)
    left, right = left.withColumn("k", F.col("k").cast("string")), right.withColumn("rk", F.col("rk").cast("string"))
    plain = left.join(right, F.col("k") == F.col("rk"))
    assert sorted(map(tuple, R.skew_join(left, right, "k", "rk", ["row"]).collect())) == sorted(map(tuple, plain.collect()))


def test_only_the_hot_key_is_spread(spark):
    left, _ = sides(spark)
    rows = R.salted(left, "k", R.hot_keys(left, "k", 100), ["row"], 32).groupBy("k", "__salt").count().collect()
    hot = [r["count"] for r in rows if r.k == 7]
    assert len(hot) == 32 and max(hot) < 2 * sum(hot) / 32
    assert {r["__salt"] for r in rows if r.k != 7} == {0}
