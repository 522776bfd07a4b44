from pyspark.sql import functions as F

from threadloom.llm import _hot


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(_hot, "HOT_KEYS", 4)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 7")
    got = _hot.salted_join(left, right, ["k"], right, "n", ["id"])
    assert got.columns == ["k", "id", "n"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert _hot.salted_join(left, right.where("k = 99"), ["k"], right.where("k = 99"), "n", ["id"]).count() == 0
