"""Registered queries against their DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

from tabforge.plans.registry import load_all
from tabforge.plans.standins import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["profile", "detect_datetime", "detect_bool", "impute_median", "iqr_clip", "scale_robust", "encode_onehot",
        "encode_ordinal", "design_matrix", "split_stratified", "metric_roc_auc_ovr", "confusion_matrix",
        "training_history", "job_status_fold", "warn_unseen_categories", "csv_malformed_rows", "train_ridge"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(df):
    import math
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
                row.append(None)
            elif hasattr(v, "isoformat"):
                row.append(str(v)[:26])
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        out.append(tuple(row))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, duck, key):
    q = load_all()[key]
    got = _norm(q.fn(spark, SF).toPandas())
    want = _norm(duck.execute(q.sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_sql_key_is_registered():
    reg = load_all()
    assert len(reg) >= 100
    assert all(isinstance(q.doc, str) and q.doc for q in reg.values())
