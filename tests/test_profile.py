from datetime import datetime

from pyspark.sql import functions as F

from tabforge.operators import profile as P


def _rows(df, key="name"):
    return {r[key]: r for r in df.collect()}


def test_profile_counts_and_ratios(spark):
    df = spark.createDataFrame(
        [(1, 20.0, "A", 0), (2, 30.0, "B", 1), (3, None, "A", 0), (4, 40.0, "B", 1), (5, 50.0, None, 1)],
        "id int, age double, city string, label int")
    p = _rows(P.profile(df))
    assert p["age"]["n_missing"] == 1 and p["city"]["n_missing"] == 1
    assert p["id"]["unique_ratio"] == 1.0
    assert p["city"]["n_unique"] == 2
    assert [r["name"] for r in P.suggest_excluded(P.profile(df)).collect()] == ["id"]


def test_profile_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = P.profile(df).first()
    assert r["n_missing"] == 2 and r["n_unique"] == 1


def test_profile_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "a int, b string")
    for r in P.profile(empty).collect():
        assert r["missing_ratio"] == 0.0 and r["unique_ratio"] == 0.0
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    assert P.suggest_excluded(P.profile(one)).count() == 0


def test_detect_datetime(spark):
    iso = [f"2024-01-{d:02d} 10:00:00" for d in range(1, 21)]
    n19 = iso[:19] + ["not-a-date"]
    n15 = iso[:15] + ["nope"] * 5
    nums = [str(i) for i in range(20)]
    rows = list(zip(iso, n19, n15, nums, [None] * 20))
    df = spark.createDataFrame(rows, "iso string, n19 string, n15 string, nums string, empty string").withColumn(
        "ts", F.lit(datetime(2024, 1, 1)))
    got = {r["name"]: r["is_datetime"] for r in P.detect_datetime(df).collect()}
    assert got == {"iso": True, "n19": True, "n15": False, "nums": False, "empty": False, "ts": True}


def test_detect_bool(spark):
    df = spark.createDataFrame(
        [(0, 0, "Y", "yes", "true", "maybe", True), (1, None, "N", "no", "false", "yes", False),
         (1, 1, "y", "Yes", "TRUE", "no", True)],
        "i01 int, i01_missing int, yn string, yesno string, tf string, maybe string, b boolean")
    got = {r["name"]: r["is_bool"] for r in P.detect_bool(df).collect()}
    assert got == {"i01": True, "i01_missing": False, "yn": True, "yesno": True, "tf": True, "maybe": False,
                   "b": True}


def test_detect_highcard(spark):
    df = spark.createDataFrame([(f"v{i}", f"w{i % 5}", "a" if i < 54 else "b") for i in range(60)],
                               "c60 string, c5 string, ab string")
    small = spark.createDataFrame([(f"v{i % 5}",) for i in range(10)], "c string")
    got = {r["name"]: r["is_highcard"] for r in P.detect_highcard(P.profile(df), ["c60", "c5", "ab", "zz"]).collect()}
    assert got == {"c60": True, "c5": False, "ab": False}
    assert P.detect_highcard(P.profile(small), ["c"]).first()["is_highcard"] is True  # 5/10 > 0.3


def test_skew_report(spark):
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(c)) for a, b, c in
                                zip([1, 1, 1, 2, 2, 2, 3, 3, 3, 1000], range(1, 11), [0, 0, 0, 0, 100] * 2)],
                               "skewed double, flat double, const double, spike double")
    got = {r["name"]: r["skew"] for r in P.skew_report(df, ["skewed", "flat", "const", "spike", "nope"]).collect()}
    assert set(got) == {"skewed", "spike"}
    import numpy as np
    x = np.array([1, 1, 1, 2, 2, 2, 3, 3, 3, 1000], dtype=float)
    n, m = len(x), x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    assert abs(got["skewed"] - round(g1 * np.sqrt(n * (n - 1)) / (n - 2), 6)) < 1e-6  # pandas .skew()


def test_category_vocab_sorted(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), (None, 2), ("c", 1)], "s string, n int")
    rows = P.category_vocab(df, ["s", "n"]).orderBy("column", "idx").collect()
    assert [(r["column"], r["value"], r["idx"]) for r in rows] == [
        ("n", "1", 0), ("n", "10", 1), ("n", "2", 2), ("s", "a", 0), ("s", "b", 1), ("s", "c", 2)]


def test_profile_store_round_trip(spark):
    import tempfile

    from tabforge.sources.profile_store import load_profile, save_profile
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, c string")
    prof = P.profile(df)
    path = tempfile.mkdtemp(prefix="tabforge-prof-") + "/p"
    save_profile(prof, path)
    back = {r["name"]: (r["n_missing"], r["n_unique"]) for r in load_profile(spark, path).collect()}
    assert back == {"id": (0, 3), "c": (1, 1)}


def test_value_counts_tell_values_apart(spark):
    df = spark.createDataFrame(
        [(0.0, "a", 1, [1, 2]), (-0.0, "a ", 1, [1, 2]), (float("nan"), None, None, [12]), (None, "", 2, None), (0.5, "a", 2, [])],
        "x double, s string, i int, l array<int>")
    got = {(r["column_idx"], r["whole"], r["real"], r["text"]): r["n"] for r in P.value_counts(df).collect()}
    assert sum(got.values()) == 20
    assert got[(0, None, 0.0, None)] == 2 and got[(0, None, None, None)] == 2 and got[(0, None, 0.5, None)] == 1
    assert got[(1, None, None, "a")] == 2 and got[(1, None, None, "")] == 1 and got[(2, 2, None, None)] == 2
    assert {r["name"]: (r["n_missing"], r["n_unique"]) for r in P.profile(df).collect()} == {
        "x": (2, 2), "s": (1, 3), "i": (1, 2), "l": (1, 3)}
    # given counts serve the profile without the data
    written = P.value_counts(df).persist()
    assert P.profile(df, counts=written).collect() and P.column_sizes(written).count() == 4


def test_profile_reads_the_table_once_without_expand(spark):
    df = spark.range(0, 1000, 1, 4).select(*[(F.col("id") % (k + 2)).alias(f"c{k}") for k in range(40)])
    plan = P.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Range (") == 1
    assert [r["n_unique"] for r in P.profile(df).orderBy("column_idx").collect()] == list(range(2, 42))


def test_profile_of_a_hot_value_and_no_columns(spark):
    hot = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    r = P.profile(hot).first()
    assert (r["n_rows"], r["n_missing"], r["n_unique"]) == (3000, 0, 1001)
    assert P.profile(spark.range(3).select()).collect() == []
