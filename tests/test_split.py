import pytest
from pyspark.sql import functions as F

from tabforge.operators import split as S


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(i, 20 + i % 40, float(i * 3 % 17), ["x", "y", "z"][i % 3], int(i % 4 == 0))
                                  for i in range(60)], "id int, age int, income double, city string, target int")


def test_random_split_sizes(frame):
    out = S.split_random(frame, "id", 0.2)
    assert out.count() == 60 and out.where("is_test").count() == 12
    again = S.split_random(frame.repartition(7), "id", 0.2)
    assert sorted(r.id for r in out.where("is_test").collect()) == sorted(r.id for r in again.where("is_test").collect())


def test_stratified_ratio(frame):
    out, method = S.split_stratified(frame, "id", "target", 0.2)
    assert method == "stratified" and out.where("is_test").count() == 12
    r = {row["target"]: row["c"] for row in out.where("is_test").groupBy("target").agg(F.count("*").alias("c")).collect()}
    assert abs(r[1] / 12 - 15 / 60) < 0.15


def test_stratified_fallback(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "id int, c string")
    out, method = S.split_stratified(df, "id", "c", 0.2)
    assert method == "random" and out.where("is_test").count() == 4


def test_bad_test_size(frame):
    for ts in (0.0, 1.0):
        with pytest.raises(ValueError):
            S.split_random(frame, "id", ts)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    w = {r["y"]: r["weight"] for r in S.class_weights(df, "y").collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}
