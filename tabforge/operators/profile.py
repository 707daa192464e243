"""One-pass column profiling and type inference.

Every function reads the data once (or a small fixed number of times) with a
single multi-column aggregate and returns a small DataFrame; decisions that
depend on the result are made on those few rows, never on the data itself.
Distinct values and their frequencies of all columns are one table (``value_counts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import (
    coerce_number,
    is_datetime_type,
    is_integral_type,
    is_numeric_type,
    q,
)
from tabforge.functions.datetimes import readings
from tabforge.functions.stats import with_position

# Fixed values (reference thresholds and token sets).
ID_UNIQUE_RATIO_THRESHOLD = 0.95
DATETIME_PARSE_SUCCESS_RATIO = 0.95
NUMERIC_STRING_EXCLUSION_RATIO = 0.8
BOOL_TOKENS = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")
HIGHCARD_NUNIQUE = 50
HIGHCARD_RATIO = 0.3
SKEW_THRESHOLD = 1.0


def missing_expr(name: str, dt: T.DataType):
    """True where the value is missing (NULL, or NaN for floating columns)."""
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present_value(name: str, dt: T.DataType):
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _slots(name: str, dt: T.DataType) -> dict[str, Column]:
    """A column's value in the slot of its kind (``whole``, ``real`` or ``text``), all NULL where missing. Instants
    are microseconds, nested values JSON; grouping holds 0.0 and -0.0 for one value."""
    v = present_value(name, dt)
    slots = {"whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    if is_integral_type(dt) or isinstance(dt, T.BooleanType):
        slots["whole"] = v.cast("bigint")
    elif isinstance(dt, T.DateType):
        slots["whole"] = F.unix_date(v).cast("bigint")
    elif isinstance(dt, T.TimestampType):
        slots["whole"] = F.unix_micros(v)
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        slots["real"] = v.cast("double")
    elif isinstance(dt, T.BinaryType):
        slots["text"] = F.hex(v)
    elif isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
        slots["text"] = F.when(v.isNotNull(), F.to_json(v, {"ignoreNullFields": "false"}))
    else:
        slots["text"] = v.cast("string")
    return slots


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_idx, whole, real, text, n) over ``cols`` (all columns by default): each distinct value and its rows.

    One scan turns a row into slim (column, value) pairs, which are summed before they are shuffled, so a
    frequent value costs a task one row. A value stands in the slot of its kind; a missing one has none.
    Profiles, modes, vocabularies and frequencies are aggregates of this table; write it once where
    several of them are wanted.
    """
    names = df.columns if cols is None else list(cols)
    if not names:
        return df.sparkSession.createDataFrame([], "column_idx int, whole bigint, real double, text string, n bigint")
    pairs = F.array(*[F.struct(F.lit(i).alias("column_idx"), *(v.alias(k) for k, v in _slots(c, df.schema[c].dataType).items()))
                      for i, c in enumerate(names)])
    return df.select(F.inline(pairs)).groupBy("column_idx", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))


def column_sizes(counts: DataFrame) -> DataFrame:
    """(column_idx, n_rows, n_missing, n_unique) from ``value_counts``; a column without rows is absent."""
    missing = F.col("whole").isNull() & F.col("real").isNull() & F.col("text").isNull()
    return counts.groupBy("column_idx").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(~missing).alias("n_unique"))


def profile(df: DataFrame, *, approx: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Per column: name, dtype, n_missing, n_unique (missing excluded), ratios.

    All counts come from one ``value_counts`` table, given or made here. ``approx=True`` reads the data in
    one aggregate with HyperLogLog++ instead of exact distinct counts.
    """
    fields = df.schema.fields
    spark = df.sparkSession
    if not fields:
        return spark.createDataFrame([], "n_rows bigint, column_idx int, name string, dtype string, n_missing bigint, "
                                         "n_unique bigint, missing_ratio double, unique_ratio double")
    if approx:
        aggs = [F.struct(
            F.lit(i).alias("column_idx"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(missing_expr(f.name, f.dataType)).alias("n_missing"),
            F.approx_count_distinct(present_value(f.name, f.dataType)).alias("n_unique")) for i, f in enumerate(fields)]
        sizes = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    else:
        sizes = column_sizes(value_counts(df) if counts is None else counts)
    names = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                  "column_idx int, name string, dtype string")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "n_missing", "n_unique")}
    denom = F.greatest(F.col("n_rows"), F.lit(1))
    return (
        names.join(sizes, "column_idx", "left")
        .select(n["n_rows"], "column_idx", "name", "dtype", n["n_missing"], n["n_unique"])
        .withColumn("missing_ratio", F.round(F.col("n_missing") / denom, 6))
        .withColumn("unique_ratio", F.round(F.col("n_unique") / denom, 6))
    )


def suggest_excluded(prof: DataFrame, threshold: float = ID_UNIQUE_RATIO_THRESHOLD) -> DataFrame:
    """Identifier suspects: unique_ratio ≥ threshold; nothing when fewer than 2 rows."""
    return prof.where((F.col("n_rows") >= 2) & (F.col("unique_ratio") >= F.lit(threshold))).select(
        "column_idx", "name", "unique_ratio"
    )


def detect_datetime(df: DataFrame) -> DataFrame:
    """Datetime candidates: datetime-typed columns always; text columns whose
    non-null values are < 80 % numeric and ≥ 95 % parseable as datetimes, with day
    and month in the order that fits more of the column's values."""
    fields = df.schema.fields
    text = [(i, f) for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in text:
        c = q(f.name)
        aggs += [
            F.count(c).alias(f"nn{i}"),
            F.count(coerce_number(c)).alias(f"num{i}"),
            *(F.count_if(f"_read{i}.{n}").alias(f"{n}{i}") for n in ("other", "month_first", "day_first")),
        ]
    wide = df.select(*(q(f.name) for _, f in text), *(readings(q(f.name)).alias(f"_read{i}") for i, f in text)).agg(*aggs)
    items = []
    for i, f in enumerate(fields):
        if is_datetime_type(f.dataType):
            items.append(F.struct(F.lit(i).alias("column_idx"), F.lit(f.name).alias("name"),
                                  F.lit(None).cast("double").alias("numeric_ratio"),
                                  F.lit(None).cast("double").alias("datetime_ratio"),
                                  F.lit(True).alias("is_datetime")))
        elif isinstance(f.dataType, T.StringType):
            nn = F.col(f"nn{i}")
            num_ratio = F.when(nn > 0, F.col(f"num{i}") / nn)
            dt_ratio = F.when(nn > 0, (F.col(f"other{i}") + F.greatest(f"month_first{i}", f"day_first{i}")) / nn)
            flag = (F.col("_n") > 0) & (nn > 0) & (num_ratio < NUMERIC_STRING_EXCLUSION_RATIO) & (
                dt_ratio >= DATETIME_PARSE_SUCCESS_RATIO)
            items.append(F.struct(F.lit(i).alias("column_idx"), F.lit(f.name).alias("name"),
                                  F.round(num_ratio, 6).alias("numeric_ratio"),
                                  F.round(dt_ratio, 6).alias("datetime_ratio"),
                                  F.coalesce(flag, F.lit(False)).alias("is_datetime")))
    if not items:
        return df.sparkSession.createDataFrame([], "column_idx int, name string, numeric_ratio double, "
                                                   "datetime_ratio double, is_datetime boolean")
    return wide.select(F.inline(F.array(*items)))


def detect_bool(df: DataFrame) -> DataFrame:
    """Boolean candidates: boolean columns; integer columns without missing whose
    values are all 0/1; text columns whose trimmed lower-case values are all in
    the token set. All-missing columns are never candidates."""
    fields = df.schema.fields
    aggs = []
    items = []
    for i, f in enumerate(fields):
        c = q(f.name)
        if isinstance(f.dataType, T.BooleanType):
            flag = F.lit(True)
        elif is_integral_type(f.dataType):
            aggs += [F.count(c).alias(f"nn{i}"), F.count_if(c.isNull()).alias(f"na{i}"),
                     F.bool_and(c.isin(0, 1)).alias(f"ok{i}")]
            flag = (F.col(f"nn{i}") > 0) & (F.col(f"na{i}") == 0) & F.coalesce(F.col(f"ok{i}"), F.lit(False))
        elif isinstance(f.dataType, T.StringType):
            aggs += [F.count(c).alias(f"nn{i}"),
                     F.bool_and(F.when(c.isNotNull(), F.lower(F.trim(c)).isin(*BOOL_TOKENS))).alias(f"ok{i}")]
            flag = (F.col(f"nn{i}") > 0) & F.coalesce(F.col(f"ok{i}"), F.lit(False))
        else:
            flag = F.lit(False)
        items.append(F.struct(F.lit(i).alias("column_idx"), F.lit(f.name).alias("name"),
                              F.coalesce(flag, F.lit(False)).alias("is_bool")))
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*items)))


def detect_highcard(prof: DataFrame, cols: Sequence[str], nunique_threshold: int = HIGHCARD_NUNIQUE,
                    ratio_threshold: float = HIGHCARD_RATIO) -> DataFrame:
    """High-cardinality columns among ``cols`` (unknown names skipped, order kept)."""
    order = {c: i for i, c in enumerate(cols)}
    order_expr = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]) if order else None
    p = prof.where(F.col("name").isin(list(cols)))
    flag = (F.col("n_unique") > nunique_threshold) | (
        (F.col("n_rows") >= 2) & (F.col("n_unique") / F.col("n_rows") > ratio_threshold))
    return p.select(order_expr[F.col("name")].alias("request_idx"), "name", "n_unique",
                    flag.alias("is_highcard"))


def skew_report(df: DataFrame, cols: Sequence[str], threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """Adjusted (G1) sample skewness per numeric column; keep |skew| ≥ threshold.

    Spark's ``skewness`` is the population g1; G1 = g1·√(n(n−1))/(n−2).
    Constant, non-finite and non-numeric columns are skipped.
    """
    types = dict(df.dtypes)
    num = [c for c in cols if c in types and is_numeric_type(df.schema[c].dataType)]
    if not num:
        return df.sparkSession.createDataFrame([], "request_idx int, name string, skew double")
    aggs = []
    for i, c in enumerate(num):
        v = F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
        aggs += [F.skewness(v).alias(f"g{i}"), F.count(v).alias(f"n{i}"), F.stddev_pop(v).alias(f"s{i}")]
    wide = df.agg(*aggs)
    items = []
    for i, c in enumerate(num):
        n = F.col(f"n{i}").cast("double")
        adj = F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2)
        ok = (n > 2) & (F.col(f"s{i}") > 0)
        items.append(F.struct(F.lit(cols.index(c)).alias("request_idx"), F.lit(c).alias("name"),
                              F.when(ok, adj).alias("skew")))
    out = wide.select(F.inline(F.array(*items)))
    finite = F.col("skew").isNotNull() & ~F.isnan("skew") & (F.abs("skew") != float("inf"))
    return out.where(finite & (F.abs("skew") >= threshold)).withColumn("skew", F.round("skew", 6))


def text_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``value_counts`` of columns read as text, as vocabularies see them."""
    return value_counts(df.select(*[q(c).cast("string").alias(c) for c in cols]))


def category_vocab(df: DataFrame, cols: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Sorted distinct non-null values (as text) of each column, with 0-based index.

    The values come from one ``text_counts`` table over ``cols``, given or made here; positions come
    from range partitioning, so a column with a huge vocabulary is not ranked in one task.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, idx bigint")
    values = (text_counts(df, cols) if counts is None else counts).where(F.col("text").isNotNull())
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("column_idx") + 1)
    return with_position(values.select(name.alias("column"), F.col("text").alias("value")), ["column"], ["value"], out="idx")


def nunique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null counts of several columns in one scan (small dict)."""
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(q(c)).alias(f"u{i}") for i, c in enumerate(cols)]).first()
        return {c: int(row[f"u{i}"]) for i, c in enumerate(cols)}
    got = {r["column_idx"]: r["n_unique"] for r in column_sizes(value_counts(df, cols)).collect()}  # a row a column
    return {c: got.get(i, 0) for i, c in enumerate(cols)}
