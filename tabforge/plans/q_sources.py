"""Source / sink queries (§2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators.score import predict_batch
from tabforge.plans.registry import register
from tabforge.plans.standins import table
from tabforge.session import scratch_path
from tabforge.sources import bundle as BD
from tabforge.sources import csv as CSV

PREVIEW_DEFAULT, PREVIEW_MAX = 50, 500


@register("csv_scan", sql="""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_csv_scan(spark, sf):
    """customer written as CSV, read back through the header guards, NA tokens and type inference."""
    path = scratch_path(spark, "csv-customer")
    CSV.write_csv(table(spark, sf, "customer"), path)
    rows, _ = CSV.read_tabular(spark, path)
    return rows


@register("csv_quoted_breaks", sql="""
SELECT c_custkey, concat(c_name, chr(10), '"', c_mktsegment, '", ', chr(10)) AS note, c_acctbal FROM customer""")
def q_csv_quoted_breaks(spark, sf):
    """customer written as CSV with line breaks, quotes and commas inside a field, read back by quote parity."""
    path = scratch_path(spark, "csv-breaks")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", \n')).alias("note")
    CSV.write_csv(table(spark, sf, "customer").select("c_custkey", note, "c_acctbal"), path)
    rows, _ = CSV.read_tabular(spark, path, multi_line=True)
    return rows


@register("csv_malformed_rows", sql="""
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
  CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value,
  CASE WHEN event_type = 'error' THEN concat_ws(',', event_id, event_type, 'x', CASE WHEN event_id % 2 = 0 THEN 'extra,' ELSE '' END)
  END AS rejected
FROM events""")
def q_csv_malformed(spark, sf):
    """Raw event lines where error rows carry extra fields, empty ones too (rejected, returned whole),
    and signup rows lack the value field (kept, padded with NULL)."""
    ev = table(spark, sf, "events")
    extra = F.when(F.col("event_id") % 2 == 0, "extra,").otherwise("")
    line = (F.when(F.col("event_type") == "error", F.concat_ws(",", "event_id", "event_type", F.lit("x"), extra))
            .when(F.col("event_type") == "signup", F.concat_ws(",", "event_id", "event_type"))
            .otherwise(F.concat_ws(",", "event_id", "event_type", F.col("value").cast("string"))))
    path = scratch_path(spark, "csv-malformed")
    # one text column whose name is the header line; a tab separator never
    # occurs in the lines, so they are written verbatim in every part file
    ev.select(line.alias("event_id,event_type,value")).write.option("header", True).option("sep", "\t").csv(path)
    rows, rejected = CSV.read_tabular(spark, path, strict=False)
    return rows.unionByName(rejected.withColumnRenamed("line", "rejected"), allowMissingColumns=True)


@register("preview_rows", sql=f"""
SELECT c_custkey, to_json(c) AS json FROM customer c ORDER BY c_custkey LIMIT {PREVIEW_DEFAULT}""")
def q_preview_rows(spark, sf):
    """First 50 rows in key order as JSON records (n ≤ 0 rejected, capped at 500)."""
    return preview_rows(table(spark, sf, "customer"), ["c_custkey"], PREVIEW_DEFAULT).select("c_custkey", "json")


def preview_rows(df, order_cols, n: int = PREVIEW_DEFAULT):
    """First ``n`` rows in key order plus a JSON record per row (NaN → null)."""
    from pyspark.sql import types as T

    from tabforge.functions.columns import nan_to_null, q

    if n <= 0:
        raise ValueError("preview size must be >= 1")
    n = min(n, PREVIEW_MAX)
    fields = [(nan_to_null(q(f.name)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else q(f.name)).alias(f.name)
              for f in df.schema.fields]
    return df.orderBy(*order_cols).limit(n).select(
        "*", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def _sink_sql() -> str:
    from tabforge.plans.q_score import _BATCH_SQL

    body = _BATCH_SQL.replace("SELECT part.*, ", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
                                                "p_retailprice, ")
    return body


def _bundle_sql() -> str:
    from tabforge.plans.q_score import _BATCH_SQL

    return _BATCH_SQL.replace("SELECT part.*, ", "SELECT p_partkey, ")


@register("prediction_sink", sql=_sink_sql())
def q_prediction_sink(spark, sf):
    """Batch predictions written as CSV (input columns + prediction) and read back."""
    from tabforge.plans.q_score import _batch

    path = scratch_path(spark, "predictions")
    CSV.write_csv(_batch(spark, sf), path)
    rows, _ = CSV.read_tabular(spark, path)
    return rows


@register("bundle_save_load", sql=_bundle_sql())
def q_bundle(spark, sf):
    """A trained model saved as a bundle, loaded back and used to score every part row."""
    from tabforge.plans.q_score import scoring_bundle

    model, pre, schema, *_ = BD.load_bundle(spark, scoring_bundle(spark, sf))
    scored = predict_batch(model, pre, schema, table(spark, sf, "part").select("p_partkey"), id_col="p_partkey")
    return scored.withColumn("prediction", F.round("prediction", 6))
