"""The grammar of datetimes in text."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabforge.functions.datetimes import day_first, parse_datetime, readings
from tabforge.operators import preprocess as PP
from tabforge.operators import profile as P

CASES = {
    "2024-01-31": (2024, 1, 31), "2024/1/3": (2024, 1, 3), "2024.12.01 7:05": (2024, 12, 1, 7, 5), " 2024-06-15 14:00:09 ": (2024, 6, 15, 14, 0, 9),
    "2024-06-15T14:00:09.25": (2024, 6, 15, 14, 0, 9, 250000), "2024-06-15T14:00:09Z": (2024, 6, 15, 14, 0, 9),
    "2024-06-15 14:00 +0230": (2024, 6, 15, 11, 30), "2024-06-15T00:30-05:00": (2024, 6, 15, 5, 30), "2024-06-15T14:00:00 UTC": (2024, 6, 15, 14),
    "06/15/2024": (2024, 6, 15), "6-5-2024 11:59 PM": (2024, 6, 5, 23, 59), "06.05.2024 12:00 a.m.": (2024, 6, 5),
    "Jan 5, 2024": (2024, 1, 5), "january 5th 2024 3:04 pm": (2024, 1, 5, 15, 4), "Sept. 30 2024": (2024, 9, 30),
    "5 March 2024": (2024, 3, 5), "05-Mar-2024 10:11:12": (2024, 3, 5, 10, 11, 12), "Sat, 15 Jun 2024 14:00:09 GMT": (2024, 6, 15, 14, 0, 9),
    "2024 Dec 24": (2024, 12, 24), "Tuesday, 2 Jan 2024 at 9:30": (2024, 1, 2, 9, 30),
    "2024-02-30": None, "13/13/2024": None, "not-a-date": None, "": None, "Foo 5, 2024": None, "2024-01-01 25:00": None, "2024-01-01 13:00 pm": None,
    "1": None, "20240131": None, "2024-01-01 10:00 +99:00": None, "5 2024": None, "marchy 5 2024": None,
}


def test_layouts(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "s string")
    got = {r["s"]: r["t"] for r in rows.select("s", parse_datetime(F.col("s")).alias("t")).collect()}
    assert got.pop(None) is None
    assert got == {k: None if v is None else datetime(*v) for k, v in CASES.items()}


def test_order_is_chosen_for_a_column(spark):
    rows = spark.createDataFrame([("13/04/2024", "04/13/2024", "x"), ("03/04/2024", "04/03/2024", "y"), ("03/04/2024", "bad", None)], "a string, b string, c string")
    assert day_first(rows, ["a", "b", "c"]) == ["a"] and day_first(rows, []) == []
    parts = rows.select(*PP.datetime_parts(rows, ["a", "b"], ["month", "day"], day_first=["a"])).collect()
    assert [tuple(r) for r in parts[:2]] == [(4, 13, 4, 13), (4, 3, 4, 3)]
    found = {r["name"]: r for r in P.detect_datetime(rows).collect()}
    assert found["a"]["is_datetime"] and found["a"]["datetime_ratio"] == 1.0
    assert not found["b"]["is_datetime"] and not found["c"]["is_datetime"]


@pytest.mark.parametrize("good, is_datetime", [(19, True), (15, False)])
def test_share_of_parsed_values(spark, good, is_datetime):
    values = [f"{d} Jan 2024" for d in range(1, good + 1)] + ["x"] * (20 - good)
    rows = spark.createDataFrame([(v, str(i)) for i, v in enumerate(values)], "s string, n string")
    assert {r["name"]: r["is_datetime"] for r in P.detect_datetime(rows).collect()} == {"s": is_datetime, "n": False}


def test_text_without_a_layout_has_no_reading(spark):
    values = ["{'k': 2024}", "view", "123456789", "Jan 5,\n2024", "x 2024-01-31", "5/6/2024", "13/1/2024", "2024-1-1", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r["i"]: r["r"] and tuple(r["r"]) for r in rows.select("i", readings(F.col("s")).alias("r")).collect()}
    none, other = None, (True, False, False)
    assert got == {0: none, 1: none, 2: none, 3: other, 4: none, 5: (False, True, True), 6: (False, False, True), 7: other, 8: none}
