"""Distributed building blocks for exact order statistics.

Spark's exact ``percentile`` keeps a value→count map of the whole column in one
buffer, and a window without ``partitionBy`` (or partitioned by a hot class) runs
in one task. These helpers give the same exact answers with work that stays
spread over the cluster:

* ``exact_quantiles`` — linear-interpolated quantiles (numpy / DuckDB
  ``quantile_cont`` semantics) of any number of columns and probabilities in a
  number of jobs that depends on neither. The value range of each wanted rank is
  narrowed with histograms until it holds at most ``direct_limit`` values, which are
  then sorted.
* ``with_position`` — 0-based position of each row within its group under a
  total order, via range partitioning + per-partition offsets.
* ``flag_smallest`` — mark the ``k`` rows with the smallest (32-bit hash, key)
  per class using two 16-bit histograms; only rows sharing the boundary hash
  value are ever ranked row by row, and data rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.columns import q, to_double

# Ranges with at most this many values are sorted in one task each.
DIRECT_LIMIT = 10_000
HIST_CUTS = 64
# Bounds of each class are held by the driver.
MAX_CLASSES = 10_000
# Groups with at most this many rows are ranked with one window (one task per
# group, bounded work); larger groups take the distributed paths below.
DIRECT_RANK_LIMIT = 1_000_000


def max_group_rows(df: DataFrame, group_cols: Sequence[str]) -> int:
    """Row count of the largest group (one aggregate)."""
    if not group_cols:
        return int(df.count())
    r = df.groupBy(*group_cols).count().agg(F.max("count")).first()[0]
    return int(r or 0)


# --------------------------------------------------------------------- quantiles


def _interp(v_lo: float, v_hi: float, pos: float) -> float:
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi:
        return v_lo
    return (hi - pos) * v_lo + (pos - lo) * v_hi


@dataclass(frozen=True)
class _Range:
    """Values of one column from ``low`` to ``high``: ``n`` of them, ``before`` smaller ones, and the wanted ranks."""

    column: str
    low: float
    high: float
    before: int
    n: int
    ranks: tuple[int, ...]


def _in_ranges(df: DataFrame, values: dict[str, Column], ranges: Sequence[_Range]) -> DataFrame:
    """(at, v): the values that lie in each range; one scan for all."""
    rows = [F.struct(F.lit(i).alias("at"), F.when(values[r.column].between(r.low, r.high), values[r.column]).alias("v"))
            for i, r in enumerate(ranges)]
    return df.select(F.inline(F.array(*rows))).where(F.col("v").isNotNull())


def _narrowed(df: DataFrame, values: dict[str, Column], ranges: Sequence[_Range]) -> list[_Range]:
    """Cut each range at about ``HIST_CUTS`` approximate quantiles; the pieces that hold wanted ranks. Two jobs."""
    rows = _in_ranges(df, values, ranges)
    grid = [i / HIST_CUTS for i in range(1, HIST_CUTS)]
    approx = rows.groupBy("at").agg(F.percentile_approx("v", grid, 10_000).alias("cuts")).collect()  # one row a range
    # a cut's own value gets a piece of its own, so a value that dominates cannot hold things up
    cuts = [(r["at"], sorted({x for c in r["cuts"] for x in (float(c), math.nextafter(float(c), math.inf))})) for r in approx]
    table = df.sparkSession.createDataFrame(cuts, "at int, cuts array<double>")
    piece = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
    hist = (
        rows.join(F.broadcast(table), "at").groupBy("at", piece.alias("piece"))
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("at", "piece").collect()
    )  # at most 2 * HIST_CUTS rows a range
    out = []
    before = {i: r.before for i, r in enumerate(ranges)}
    for h in hist:
        r, start = ranges[h["at"]], before[h["at"]]
        before[h["at"]] += h["n"]
        inside = tuple(k for k in r.ranks if start <= k < start + h["n"])
        if inside:
            out.append(_Range(r.column, h["low"], h["high"], start, h["n"], inside))
    return out


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    direct_limit: int = DIRECT_LIMIT,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of numeric columns (NULL/NaN ignored).

    Returns ``{col: [q(p) for p in probs]}``; ``None`` for all-missing columns.
    ``counts`` (non-missing values per column), when the caller knows them,
    saves the counting scan.
    """
    cols = list(cols)
    if not cols:
        return {}
    vals = {c: to_double(q(c)) for c in cols}
    if counts is not None and all(c in counts for c in cols):
        n = {c: int(counts[c]) for c in cols}
    else:
        row = df.agg(*[F.count(vals[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        n = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    places = {c: [(n[c] - 1) * float(p) for p in probs] for c in cols if n[c]}
    ranges = [_Range(c, -math.inf, math.inf, 0, n[c], tuple(sorted({f(x) for x in at for f in (math.floor, math.ceil)})))
              for c, at in places.items()]
    found: dict[tuple[str, int], float] = {}
    while ranges:
        for r in ranges:
            if r.low == r.high:
                found |= {(r.column, k): r.low for k in r.ranks}
        ranges = [r for r in ranges if r.low != r.high]
        wide = [r for r in ranges if r.n > direct_limit]
        if not wide:
            break
        ranges = [r for r in ranges if r.n <= direct_limit] + _narrowed(df, vals, wide)
    if ranges:
        wanted = df.sparkSession.createDataFrame(
            [(i, [k - r.before for k in r.ranks]) for i, r in enumerate(ranges)], "at int, places array<int>")
        rows = _in_ranges(df, vals, ranges).groupBy("at").agg(F.array_sort(F.collect_list("v")).alias("v"))
        got = rows.join(F.broadcast(wanted), "at").select("at", F.transform("places", lambda k: F.get("v", k)).alias("v"))
        for g in got.collect():  # one row a range
            r = ranges[g["at"]]
            found |= {(r.column, k): float(v) for k, v in zip(r.ranks, g["v"], strict=True)}
    return {
        c: [_interp(found[c, math.floor(x)], found[c, math.ceil(x)], x) for x in places[c]] if n[c] else [None] * len(probs)
        for c in cols
    }


# --------------------------------------------------------------------- positions


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's checkpoint folder. Used where later
    branches must see the very same partitioning (partition ids, row order):
    a recomputed range shuffle may sample different bounds, a checkpoint cannot."""
    from tabforge.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def with_position(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    out: str = "pos",
    num_partitions: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of the row within its group.

    ``order_cols`` must make a total order inside each group (end with a unique
    key). A hot group is spread over many range partitions; only per-partition
    counts (≤ groups + partitions rows) are aggregated and joined back.
    """
    spark = df.sparkSession
    orders = [F.col(o) if isinstance(o, str) else o for o in order_cols]
    if max_rows is None:
        max_rows = max_group_rows(df, group_cols)
    if max_rows <= DIRECT_RANK_LIMIT:
        w = Window.partitionBy(*group_cols).orderBy(*orders)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + orders
    s = materialize(
        df.repartitionByRange(n_part, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_loc", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    )
    stats = s.groupBy("_pid", *group_cols).agg(F.count("*").alias("_n"), F.min("_loc").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stats = stats.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    joined = s.join(stats, on=["_pid", *group_cols], how="inner")
    return joined.withColumn(out, F.col("_before") + F.col("_loc") - F.col("_first")).drop(
        "_pid", "_loc", "_first", "_before"
    )


# --------------------------------------------------------------------- k smallest


def flag_smallest(
    df: DataFrame,
    group_col: str | None,
    score_col: str,
    tie_col: str,
    take: Sequence[tuple[Any, int]],
    out: str = "selected",
) -> DataFrame:
    """Flag the ``k`` rows of each class with the smallest (score, tie) pair.

    ``score_col`` is an unsigned 32-bit hash; ``take`` lists (class, k), or one
    (None, k) when there are no classes. Equivalent to
    ``row_number() over (partition by class order by score, tie) <= k``. Three scans
    find each class's boundary: the upper and the lower half of the hash, then the tie
    value. The bounds, a row a class, are literals or a broadcast table; a class count
    above ``MAX_CLASSES`` is refused.
    """
    if len(take) > MAX_CLASSES:
        raise ValueError(f"{len(take)} classes; at most {MAX_CLASSES} can be split at once")
    spark = df.sparkSession
    g = [group_col] if group_col else []
    kind = [(group_col, df.schema[group_col].dataType.simpleString())] if group_col else []

    def small(rows: Sequence[tuple], *columns: tuple[str, str]) -> DataFrame:
        schema = ", ".join(f"`{n}` {t}" for n, t in [*kind, *columns])
        return F.broadcast(spark.createDataFrame([r if g else r[1:] for r in rows], schema))

    def attach(rows: DataFrame, bounds: Sequence[tuple], *columns: tuple[str, str], how: str = "inner") -> DataFrame:
        """The class's bounds as columns."""
        if g:
            return rows.join(small(bounds, *columns), g, how)
        return rows.withColumns({n: F.lit(v).cast(t) for (n, t), v in zip(columns, bounds[0][1:], strict=True)})

    def crossing(counts: DataFrame, place: str) -> dict[Any, tuple[int, int]]:
        """Per class: where the running count reaches k, and how many rows lie before."""
        run = Window.partitionBy(*g).orderBy(place)  # at most 65 536 rows a class
        counts = counts.withColumn("_upto", F.col("_below") + F.sum("_n").over(run))
        hit = counts.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        rows = hit.select(*g, F.col(place).alias("_at"), (F.col("_upto") - F.col("_n")).alias("_before")).collect()
        return {(r[0] if g else None): (r["_at"], r["_before"]) for r in rows}  # one row a class

    wanted = {c: int(k) for c, k in take if k > 0}
    if not wanted:
        return df.withColumn(out, F.lit(False))
    upper = F.shiftright(F.col(score_col), 16)
    how_many = ("_k", "bigint"), ("_below", "bigint")
    first = crossing(
        attach(df.groupBy(*g, upper.alias("_bucket")).agg(F.count("*").alias("_n")), [(c, k, 0) for c, k in wanted.items()], *how_many),
        "_bucket")
    whole = [c for c in wanted if c not in first]  # classes with fewer rows than are wanted
    bounds: list[tuple] = [(c, (1 << 32) - 1, None) for c in whole]
    if first:
        inside = attach(df, [(c, b) for c, (b, _) in first.items()], ("_bucket", "bigint")).where(upper == F.col("_bucket"))
        counts = inside.groupBy(*g, F.col(score_col).alias("_bound")).agg(F.count("*").alias("_n"))
        second = crossing(attach(counts, [(c, wanted[c], below) for c, (_, below) in first.items()], *how_many), "_bound")
        # Only rows whose score equals the boundary value are ranked one by one: about n / 2**32 rows a class.
        at = attach(df, [(c, h, wanted[c] - below) for c, (h, below) in second.items()], ("_bound", "bigint"), ("_rest", "bigint"))
        ranked = at.where(F.col(score_col) == F.col("_bound")).withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*g).orderBy(tie_col)))
        last = {(r[0] if g else None): r["_bound_tie"] for r in ranked.where(F.col("_rank") == F.col("_rest")).select(
            *g, F.col(tie_col).alias("_bound_tie")).collect()}  # one row a class
        bounds += [(c, second[c][0], last[c]) for c in second]
    marked = attach(df, bounds, ("_bound", "bigint"), ("_bound_tie", df.schema[tie_col].dataType.simpleString()), how="left")
    score = F.col(score_col)
    before = (score < F.col("_bound")) | ((score == F.col("_bound")) & (F.col("_bound_tie").isNull() | (F.col(tie_col) <= F.col("_bound_tie"))))
    return marked.withColumn(out, F.coalesce(before, F.lit(False))).drop("_bound", "_bound_tie")


# --------------------------------------------------------------------- prefix sums


def with_prefix_sums(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    value_cols: Sequence[str],
    suffix: str = "_before",
    num_partitions: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over rows of the same group with a
    smaller ``order_col`` (which must be unique within the group).

    Range partitioning keeps a big group spread over many tasks: each range
    partition computes local running sums, and per-partition totals (≤ groups +
    partitions rows) supply the offsets.
    """
    spark = df.sparkSession
    g = list(group_cols)
    if max_rows is None:
        max_rows = max_group_rows(df, g)
    if max_rows <= DIRECT_RANK_LIMIT:
        w = Window.partitionBy(*g).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        out = df
        for v in value_cols:
            out = out.withColumn(f"{v}{suffix}", F.coalesce(F.sum(v).over(w), F.lit(0)))
        return out
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = materialize(df.repartitionByRange(n_part, *[F.col(c) for c in g], F.col(order_col)).withColumn(
        "_pid", F.spark_partition_id()))
    w_local = Window.partitionBy("_pid", *g).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = s
    for v in value_cols:
        local = local.withColumn(f"_l_{v}", F.coalesce(F.sum(v).over(w_local), F.lit(0)))
    tot = s.groupBy("_pid", *g).agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for v in value_cols:
        tot = tot.withColumn(f"_o_{v}", F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)))
    tot = tot.select("_pid", *g, *[f"_o_{v}" for v in value_cols])
    out = local.join(tot, on=["_pid", *g], how="inner")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.col(f"_l_{v}")).drop(f"_o_{v}", f"_l_{v}")
    return out.drop("_pid")
