"""CSV input with header guards, and CSV/Parquet sinks.

Header problems are checked on the raw header line (Spark would silently rename
blank or duplicate names). Missing-value tokens (matched exactly, as pandas does)
are mapped to NULL on the text columns before types are inferred, so ``'NA'``
never turns a numeric column into text. Rows with too many fields, an empty extra
field included, fail the read, or are returned as raw lines when it is not
``strict``; rows with too few fields are kept, padded with NULLs. A quoted line break
needs ``multi_line``; without it such a file is rejected, never split. With it records are
cut by quote parity, split by split: one scan counts the quotes of every split, the
parity before a split follows from the splits before it, and each task then joins the lines
of its own records. Only the pieces of records that cross a split are shuffled.
"""

from __future__ import annotations

import csv as _csv
import io
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate
from operator import or_, xor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import NUMBER_PATTERN, q
from tabforge.session import scratch_path

# Text read as missing (the pandas default NA token list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class InputError(ValueError):
    """Rejected input file (empty, bad header, malformed rows)."""


def read_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Field names of the first record (its lines read, not the file)."""
    n, lines = 1, [r[0] for r in spark.read.text(path).limit(1).collect()]
    if not lines:
        raise InputError("empty file")
    # a quoted name may hold line breaks: read on until its quotes are closed
    while sum(v.count('"') for v in lines[:n]) % 2:
        n += 1
        if n > len(lines):
            more = [r[0] for r in spark.read.text(path).limit(2 * n).collect()]
            if len(more) < n:
                raise InputError("a quoted field is never closed")
            lines = more
    names = next(_csv.reader(io.StringIO("\n".join(lines[:n]), newline=""), delimiter=sep))
    return [n.strip() for n in names]


def check_header(names: list[str]) -> None:
    if not names or all(n == "" for n in names):
        raise InputError("file has no columns")
    bad = [n for n in names if n == "" or n.lower().startswith("unnamed")]
    if bad:
        raise InputError(f"blank or unnamed header fields: {bad}")
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise InputError(f"duplicate header names: {dup}")


# Types in the order they are tried: a column gets the first one that all of its values have.
_INTEGER = r"^\s*[+-]?\d+\s*$"
_TYPES = {
    "bigint": lambda v: v.rlike(_INTEGER) & F.trim(v).try_cast("bigint").isNotNull(),
    "decimal(38,0)": lambda v: v.rlike(_INTEGER) & F.trim(v).try_cast("decimal(38,0)").isNotNull(),
    "double": lambda v: v.rlike(NUMBER_PATTERN),
    "boolean": lambda v: v.isin("True", "TRUE", "true", "False", "FALSE", "false"),
}
# Set behind a line to see how many fields come before it.
_END = "\u0001"


def _infer_type(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Type of each text column by its non-null values, 'string' if there are none (one aggregate)."""
    aggs = [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(fits(q(c))).alias(f"{t}{i}") for i, c in enumerate(cols) for t, fits in _TYPES.items()]
    r = df.agg(*aggs).first()
    return {c: next((t for t in _TYPES if 0 < r[f"n{i}"] == r[f"{t}{i}"]), "string") for i, c in enumerate(cols)}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of a split keep their order within its partition."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _odd_quotes(value: pa.Array) -> np.ndarray:
    return pc.bit_wise_and(pc.count_substring(value, '"'), 1).to_numpy(zero_copy_only=False).astype(bool)


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("piece", pa.int32()),
                     ("text", pa.string())])


def _joined(open_before: set[tuple[str, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the lines of splits into records. ``open_before`` are the splits that start inside quotes.

    Rows: file, start, place in the split, piece (0 a whole record; 1 the lines that end a record of an
    earlier split, 2 the lines that begin one a later split ends, 3 a split without any end), text. A
    task holds one batch and the record that is open.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)]
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, held, inside, early = None, 0, [], False, False

        def rest() -> list[tuple]:
            return [(*split, place, 3 if early else 2, "\n".join(held))] if held else []

        for b in batches:
            odd = _odd_quotes(b.column("value"))
            same = split is not None and pc.all(pc.and_(pc.equal(b.column("file"), split[0]), pc.equal(b.column("start"), split[1]))).as_py()
            if same and not inside and not odd.any():  # whole lines of one split are records as they stand
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("file"), b.column("start"), pa.array(np.arange(place, place + n)), pa.array(np.zeros(n, "int32")),
                     b.column("value")], schema=_PIECES)
                place += n
                continue
            out = []
            for file, start, text, flips in zip(b.column("file").to_pylist(), b.column("start").to_pylist(),
                                                b.column("value").to_pylist(), odd):
                if (file, start) != split:
                    out += rest()
                    split, place, held = (file, start), 0, []
                    early = inside = split in open_before
                held.append(text)
                inside ^= bool(flips)
                if not inside:
                    out.append((file, start, place, 1 if early else 0, "\n".join(held)))
                    place, held, early = place + 1, [], False
            if out:
                yield batch(out)
        if last := rest():
            yield batch(last)

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, text): the records of CSV files whose quoted fields may hold line breaks.

    A record is the ``place``-th one of the split of its file where it begins; blank lines are left out. Quotes
    stand in quoted fields only and are doubled inside them; lines end in a line feed, a carriage return
    before it belongs to the line end outside quotes. The driver sees one row per split, as the scan itself does.
    """
    lines = _lines(spark, path)
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = sorted((r["file"], r["start"], r["p"]) for r in
                    lines.groupBy("file", "start").agg((F.sum(odd) % 2).alias("p")).collect())
    files: dict[str, list[tuple[int, int]]] = {}
    for file, start, p in splits:
        files.setdefault(file, []).append((start, p))
    open_before = set()
    for file, parts in files.items():
        parity = list(accumulate((p for _, p in parts), xor, initial=0))
        if parity[-1]:
            raise InputError("a quoted field is never closed")
        open_before |= {(file, start) for (start, _), p in zip(parts, parity) if p}
    pieces = lines.mapInArrow(_joined(open_before), "file string, start bigint, place bigint, piece int, text string")
    whole = pieces.where(F.col("piece") == 0).select("file", "start", "place", "text")
    # A record over several splits: its beginning, any splits in its midst, its end. They are few (at most two a split),
    # and the beginning's split names it.
    crossing = pieces.where(F.col("piece") != 0)
    began = F.last(F.when(F.col("piece") == 2, F.col("start")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("start", "piece"))
    glued = (crossing.withColumn("began", began).groupBy("file", "began")
             .agg(F.array_sort(F.collect_list(F.struct("start", "piece", "place", "text"))).alias("p"))
             .select("file", F.col("began").alias("start"), F.col("p.place")[0].alias("place"), F.array_join(F.col("p.text"), "\n").alias("text")))
    return whole.unionByName(glued).withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(F.trim("text") != "")


def read_tabular(spark: SparkSession, path: str, *, sep: str = ",", strict: bool = True, infer: bool = True,
                 multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) from a CSV file or folder with a header line.

    Rows with more fields than the header raise ``InputError``, or come back whole in
    ``rejected`` (line) when not ``strict``. Types: bigint, decimal(38,0) for integers
    beyond it, double, boolean, string. ``multi_line`` reads quoted line breaks, each file
    by as many tasks as it has splits.
    """
    names = read_header(spark, path, sep)
    check_header(names)
    n = len(names)
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise InputError("a quoted field holds a line break; read the file with multi_line")
    fields = [T.StructField(f"_f{i}", T.StringType()) for i in range(n)]
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"'}
    schema = T.StructType([*fields, T.StructField("_line", T.StringType())])
    if multi_line:
        header = (F.col("start") == 0) & (F.col("place") == 0)
        parsed = F.from_csv("text", F.lit(schema.toDDL()), {**options, "columnNameOfCorruptRecord": "_line"})
        written = scratch_path(spark, "csv-records")  # read by the checks, the types and the rows
        csv_records(spark, path).where(~header).select(parsed.alias("r")).select("r.*").write.parquet(written)
        raw = spark.read.schema(schema).parquet(written)
    else:
        raw = spark.read.schema(schema).options(
            header=True, enforceSchema=True, columnPruning=False, columnNameOfCorruptRecord="_line", **options).csv(path)
    # Lines with another number of fields come with their text. Only these are parsed again: with an end mark as one
    # more field, the mark is among the first n + 1 unless the line has too many (empty ones count).
    marked = F.from_csv(F.concat("_line", F.lit(sep + _END)), F.lit(", ".join(f"_f{i} string" for i in range(n + 1))), options)
    ends = [F.coalesce(marked[f"_f{i}"] == _END, F.lit(False)) for i in range(n + 1)]
    too_long = F.col("_line").isNotNull() & ~reduce(or_, ends)
    # always true; keeps a field in plans that need nothing but the line, which the reader refuses
    read = F.length(F.coalesce("_f0", F.lit(""))) >= 0
    rejected = raw.where(too_long & read).select(F.col("_line").alias("line"))
    good = raw.where(~too_long & read).drop("_line")
    if strict and not rejected.isEmpty():
        raise InputError("rows with more fields than the header")
    cleaned = good.select(*[F.when(F.col(f"_f{i}").isin(*NA_TOKENS) | F.col(f"_f{i}").isNull(), None)
                            .otherwise(F.col(f"_f{i}")).alias(name) for i, name in enumerate(names)])
    if cleaned.isEmpty():
        raise InputError("file has no data rows")  # header only, or every row malformed
    if infer:
        types = _infer_type(cleaned, names)
        cleaned = cleaned.select(*[(F.trim(q(c)).try_cast(t) if t != "string" else q(c)).alias(c)
                                   for c, t in types.items()])
    return cleaned, rejected


def write_csv(df: DataFrame, path: str, *, header: bool = True) -> str:
    # white space at a field's ends is kept
    df.write.mode("overwrite").options(header=header, escape='"', ignoreLeadingWhiteSpace=False,
                                       ignoreTrailingWhiteSpace=False).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
