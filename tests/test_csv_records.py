"""CSV files with quoted line breaks, read by several tasks a file, against Python's csv module."""

import csv
import io
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabforge.sources import csv as CSV


def _file(text: str) -> str:
    path = Path(tempfile.mkdtemp()) / "t.csv"
    path.write_text(text, newline="")
    return str(path)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _text(rows, end="\n") -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def _odd_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["x", "a,b", 'say ""hi""', "line\nbreak", "\n", "\n\n", '"', "é", "end\n", '"\n"', "1" * 40]
    return [(i, "".join(rng.choices(words, k=rng.randint(1, 6))), "z" + "\n".join("y" * 90 for _ in range(rng.choice([1, 1, 1, 9]))))
            for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_records_over_many_splits_are_python_csv_rows(small_splits, seed):
    rows = _odd_rows(60, seed)
    path = _file(_text([("a", "b", "c"), *rows]))
    assert CSV._lines(small_splits, path).rdd.getNumPartitions() > 10  # one file, many tasks
    got, rejected = CSV.read_tabular(small_splits, path, multi_line=True)
    assert [tuple(r) for r in got.orderBy("a").collect()] == rows
    assert rejected.count() == 0


def test_records_keep_their_place_and_blank_lines_are_left_out(spark):
    path = _file('h\r\n\r\n"a\r\nb"\r\nc\r\n')
    got = [(r["start"], r["place"], r["text"]) for r in CSV.csv_records(spark, path).orderBy("start", "place").collect()]
    assert got == [(0, 0, "h"), (0, 2, '"a\r\nb"'), (0, 3, "c")]


def test_one_record_longer_than_many_splits(small_splits):
    long = "\n".join("w" * 60 for _ in range(40))
    got, _ = CSV.read_tabular(small_splits, _file(_text([("a", "b"), (1, long), (2, "s"), (3, long)])), multi_line=True)
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, long), (2, "s"), (3, long)]


def test_header_with_a_line_break_and_several_files(small_splits):
    folder = Path(tempfile.mkdtemp())
    for k in range(3):
        (folder / f"p{k}.csv").write_text(_text([("a", "b\nc"), *((10 * k + i, f"v\n{i}") for i in range(5))]), newline="")
    got, _ = CSV.read_tabular(small_splits, str(folder), multi_line=True)
    assert got.columns == ["a", "b\nc"]
    assert [r[0] for r in got.orderBy("a").collect()] == [10 * k + i for k in range(3) for i in range(5)]


def test_rows_with_other_numbers_of_fields(small_splits):
    path = _file('a,b\n1,"x\ny"\n2,"p\nq",3\n4\n5,"NA"\n6,r,\n')
    got, rejected = CSV.read_tabular(small_splits, path, multi_line=True, strict=False)
    assert sorted((r["a"], r["b"]) for r in got.where(F.col("b").isNotNull()).collect()) == [(1, "x\ny")]
    assert sorted(r["a"] for r in got.where(F.col("b").isNull()).collect()) == [4, 5]
    assert sorted(r["line"] for r in rejected.collect()) == ['2,"p\nq",3', "6,r,"]
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(small_splits, path, multi_line=True)


def test_a_quote_that_is_never_closed_is_refused(spark):
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _file('a,b\n1,"x\n2,y\n'), multi_line=True)
    with pytest.raises(CSV.InputError):
        CSV.read_tabular(spark, _file('"a\n'), multi_line=True)


def test_quotes_survive_writing_and_reading(spark):
    df = spark.createDataFrame([(1, 'say "hi", you\\'), (2, "two\nlines")], "a bigint, b string")
    path = tempfile.mkdtemp() + "/w"
    CSV.write_csv(df, path)
    got, _ = CSV.read_tabular(spark, path, multi_line=True)
    assert sorted(map(tuple, got.collect())) == [(1, 'say "hi", you\\'), (2, "two\nlines")]
