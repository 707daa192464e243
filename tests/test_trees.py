"""Trees, forests, extra trees and boosting: laws, closed forms, any depth, missing values, distributed levels."""

import heapq
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.operators import boosting as B
from tabforge.operators import train as TR
from tabforge.operators import trees as T
from tabforge.plans.config import FeatureSchema
from tabforge.sources import bundle as BD


def frame(spark, x, y, parts=4, weight=None):
    x = np.asarray(x, float).reshape(len(y), -1)
    rows = [(i, r, float(v), 1.0 if weight is None else float(weight[i])) for i, (r, v) in enumerate(zip(x.tolist(), y, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, w double").repartition(parts, "id")
    return df.select("id", array_to_vector("x").alias("features"), "label", "w")


def forest(df, classes, **kw):
    return T.ForestEstimator(T.ForestParams(**kw), classes).fit_rows(df, key="id", label="label")


def predictions(model, df):
    return {r["id"]: r["prediction"] for r in model.transform(df).collect()}


@pytest.mark.parametrize("local_rows", [200_000, 100])
def test_random_cuts_are_uniform_in_the_node(spark, local_rows):
    rng = np.random.default_rng(0)
    x = np.concatenate([[2.0, 12.0], rng.normal(7, 0.01, 300)])  # the rows' own density must not matter
    df = frame(spark, x, rng.integers(0, 2, len(x)))
    model = forest(df, 2, trees=300, random_cuts=True, max_depth=2, local_rows=local_rows, together=300)
    cuts = np.sort([t.threshold[0] for t in model.trees])
    shares = (cuts - 2) / 10
    assert 0 < shares.min() and shares.max() < 1
    assert np.abs(shares - (np.arange(300) + 0.5) / 300).max() < 1.63 / math.sqrt(300)  # Kolmogorov, 1 %
    below = [(t.threshold[t.left[0]] - 2) / (t.threshold[0] - 2) for t in model.trees if t.threshold[0] < 6.5 and t.feature[t.left[0]] >= 0]
    assert not below  # a single row is left of most cuts: a leaf


def test_extra_trees_compare_features_and_agree_on_reruns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 3] > 0).astype(int)
    a, b = (forest(frame(spark, x, y, n), 2, trees=12, random_cuts=True) for n in (2, 7))
    for s, t in zip(a.trees, b.trees, strict=True):
        assert np.array_equal(s.feature, t.feature) and np.array_equal(s.threshold, t.threshold, equal_nan=True)
    assert np.mean([t.feature[0] == 3 for t in a.trees]) > 0.8  # the best of one cut a feature
    assert len({t.threshold[0] for t in a.trees}) == 12
    assert predictions(a, frame(spark, x, y)) == dict(enumerate(y.astype(float)))  # grown to the end


@pytest.mark.parametrize("local_rows", [200_000, 20])
def test_a_chain_of_depth_40_is_learned_exactly(spark, local_rows):
    x = np.arange(42)
    y = 3.0**x
    df = frame(spark, x, y)
    model = forest(df, 0, local_rows=local_rows)
    assert model.trees[0].depth() >= 40
    got = predictions(model, df)
    assert all(got[i] == pytest.approx(v) for i, v in enumerate(y))


def test_distributed_levels_and_local_ends_fit_all_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1500, 3)), rng.integers(0, 3, 1500)
    df = frame(spark, x, y)
    for kw in ({}, {"random_cuts": True}):
        model = forest(df, 3, local_rows=150, trees=2, **kw)
        assert predictions(model, df) == dict(enumerate(y.astype(float)))
    shallow = forest(df, 3, local_rows=150, max_depth=2).trees[0]
    assert shallow.depth() == 2 and len(shallow.feature) == 7
    counts = np.bincount(y, minlength=3) / 1500
    assert forest(df, 3, local_rows=150, max_depth=0).trees[0].value[0] == pytest.approx(counts)


def test_bootstrap_draws_rows_with_replacement():
    keys = np.arange(200_000, dtype=np.uint64)
    drawn = T._drawn(T.ForestParams(bootstrap=True), 3, keys, np.ones(len(keys)))
    assert drawn.mean() == pytest.approx(1, abs=0.01) and (drawn == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert not np.array_equal(drawn, T._drawn(T.ForestParams(bootstrap=True), 4, keys, np.ones(len(keys))))


def test_weights_and_missing_values_in_trees(spark):
    df = frame(spark, [0, 0, 1, 1, np.nan, np.nan], [0, 1, 1, 0, 1, 1], weight=[3, 1, 2, 1, 1, 1])
    model = T.ForestEstimator(T.ForestParams(), 2).fit_rows(df, key="id", label="label", weight="w")
    assert predictions(model, df) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    for cuts in (True, False):
        model = forest(df, 2, local_rows=1, random_cuts=cuts)
        assert predictions(model, df)[4] == 1
    with pytest.raises(ValueError):
        forest(df.limit(0), 2)


# --- boosting --------------------------------------------------------------------------------------------------------


def naive_best_first(bins, g, h, p):
    """Leaves as row sets, the best split of all leaves next."""
    def sums(rows):
        out = np.zeros((bins.shape[1], 256, 3))
        for f in range(bins.shape[1]):
            for c, v in enumerate((g, h, np.ones(len(g)))):
                out[f, :, c] = np.bincount(bins[rows, f], v[rows], 256)
        return out

    leaves, order, queue = [np.arange(len(g))], 0, []

    def enter(rows):
        nonlocal order
        s = B.best_split(sums(rows), p)
        if s is not None:
            heapq.heappush(queue, (-s.gain, order, s, rows))
            order += 1

    enter(leaves[0])
    while queue and len(leaves) < p.max_leaves:
        _, _, s, rows = heapq.heappop(queue)
        v = bins[rows, s.feature]
        left = np.where(v == 255, s.missing_left, v <= s.cut)
        parts = [rows[left], rows[~left]]
        leaves = [x for x in leaves if x is not rows] + parts
        for part in parts:
            enter(part)
    return sorted(tuple(x) for x in leaves)


def test_speculative_growth_equals_best_first():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 40, (3000, 3)).astype(np.uint8)
    bins[rng.random((3000, 3)) < 0.1] = 255
    g = rng.normal(size=3000) + (bins[:, 0] > 20) * 2.0 - (bins[:, 1] == 255)
    h = rng.uniform(0.1, 1, 3000)
    p = B.BoostParams(2, 1, max_leaves=31, min_rows=20)

    def sums(rows):
        out = np.zeros((3, 256, 3))
        for f in range(3):
            for c, v in enumerate((g, h, np.ones(3000))):
                out[f, :, c] = np.bincount(bins[rows, f], v[rows], 256)
        return out

    r = B.Round(p, sums(np.arange(3000)))
    jobs = 0
    while nodes := r.wanted():
        at = B.leaf_of_bins(r.tree.tree(), bins)
        r.answer({n: sums(np.flatnonzero(at == n)) for n in nodes})
        jobs += 1
    tree = r.finished(1.0)
    at = B.leaf_of_bins(tree, bins)
    assert sorted(tuple(np.flatnonzero(at == n)) for n in np.unique(at)) == naive_best_first(bins, g, h, p)
    assert (tree.feature == T.NO_CHILD).sum() == 31 and jobs <= 20
    for n in np.unique(at):
        assert tree.value[n, 0] == pytest.approx(g[at == n].sum() / h[at == n].sum())


@pytest.mark.parametrize("like", [0.0, 9.0])
def test_missing_values_take_the_better_side(spark, like):
    x = np.array([float(i % 10) for i in range(400)])
    y = (x > 4.5) * 10.0
    x[::8], y[::8] = np.nan, (like > 4.5) * 10.0
    model = B.BoostEstimator(B.BoostParams(0, 60, max_leaves=31, min_rows=20)).fit_rows(frame(spark, x, y), key="id", label="label")
    got = predictions(model, frame(spark, [0.0, 9.0, np.nan], [0, 0, 0]))
    assert got[0] == pytest.approx(0, abs=0.1) and got[1] == pytest.approx(10, abs=0.1)
    assert got[2] == pytest.approx(10.0 * (like > 4.5), abs=0.1)


def test_quantile_bins_cover_many_values(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(size=(4000, 2))
    x[:, 1] = np.round(x[:, 1])
    df = frame(spark, x, np.zeros(4000))
    blocks = T.write_blocks(df, key="id", features="features", label="label", weight=None)
    edges = B.bin_edges(blocks, df, 2)
    assert 200 <= len(edges[0]) <= 254 and len(edges[1]) == len(np.unique(x[:, 1])) - 1
    share = np.bincount(B.binned(x, edges)[:, 0], minlength=256) / 4000
    assert share.max() < 0.02


@pytest.mark.parametrize("kw", [{"max_leaves": 31, "min_rows": 20}, {"max_depth": 3, "newton": False}])
def test_three_classes_have_probabilities(spark, kw):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 2))
    y = np.where(x[:, 0] > 0.3, 2, np.where(x[:, 1] > 0, 1, 0))
    df = frame(spark, x, y)
    model = B.BoostEstimator(B.BoostParams(3, 25, **kw)).fit_rows(df, key="id", label="label")
    assert len(model.trees) == 75
    rows = model.transform(df).collect()
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.97
    assert all(sum(r["probability"]) == pytest.approx(1) and len(r["probability"]) == 3 for r in rows)


def test_boosting_stops_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(600, 1)), rng.integers(0, 2, 600)
    df = frame(spark, x, y).withColumn("_valid", F.col("id") % 5 == 0)
    model = B.BoostEstimator(B.BoostParams(2, 200, max_leaves=31, min_rows=20, patience=10)).fit_rows(
        df, key="id", label="label", valid="_valid")
    assert 10 <= len(model.trees) < 100


def test_scores_follow_from_the_trees_when_a_worker_forgets(spark, monkeypatch):
    tree = T.Tree(np.array([0, -1, -1]), np.array([0.0, np.nan, np.nan]), np.array([1, -1, -1]), np.array([2, -1, -1]),
                  np.array([[0.0], [1.0], [-1.0]]), np.zeros(3, bool))
    blobs = [__import__("pickle").dumps(tree)] * 3
    block = (b"name", np.array([[0], [1]], np.uint8))
    step = [B._scores("a", block, np.array([0.5]), blobs[:n]).copy() for n in (1, 2, 3)]
    B._SCORES.clear()
    assert np.array_equal(step[-1], B._scores("a", block, np.array([0.5]), blobs))
    assert step[-1].tolist() == [[3.5], [-2.5]]


# --- equal rows ------------------------------------------------------------------------------------------------------


def test_distinct_rows_take_zeros_and_missing_as_equal():
    x = np.array([[0.0, np.nan], [-0.0, np.nan], [1.0, 2.0], [0.0, np.nan], [2.0, 1.0]])
    first, number = T.distinct_rows(x)
    assert len(first) == 3 and len({*number[[0, 1, 3]]}) == 1
    assert np.array_equal(x[first][number], x, equal_nan=True)


def test_equal_rows_are_written_and_routed_once(spark):
    x = np.arange(9000) % 5
    df = frame(spark, x.astype(float), x % 2).repartition(3)
    blocks = T.write_blocks(df, key="id", features="features", label="label", weight=None)
    kept = blocks.selectExpr("sum(octet_length(y)) / 8 as kept", "sum(octet_length(w)) / 8 as n", "count(*) as blocks").first()
    assert kept["n"] == 9000 and kept["kept"] == 5 * kept["blocks"]
    # no node counts as large: a level's passes over the data are for distinct rows
    forest = T.Forest(blocks, 2, T.ForestParams(trees=3, bootstrap=True, local_rows=int(kept["kept"])))
    roots = {t: T.Growing(2) for t in range(3)}
    assert forest._large(roots, {t: {g.add(np.zeros(2)): 0} for t, g in roots.items()}) == {}
    model = T.ForestEstimator(T.ForestParams(trees=3, bootstrap=True), 2).fit_rows(df, key="id", label="label")
    assert {r["prediction"] - r["label"] for r in model.transform(df).collect()} == {0.0}


@pytest.mark.parametrize("classes", [0, 2])
def test_boosting_folds_rows_of_equal_bins(spark, classes):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=4000))
    y = (x > 0) * 1.0 if classes else x + rng.normal(size=4000)
    df = frame(spark, x, y).withColumn("w", F.when(F.col("id") % 10 == 0, -2.0).otherwise(2.0))
    blocks = T.write_blocks(df.coalesce(1), key="id", features="features", label="label", weight="w")
    rows = B.fold_blocks(blocks, B.bin_edges(blocks, df, 1), classes).collect()
    y_, w, n = (np.concatenate([np.frombuffer(bytes(r[c])) for r in rows]) for c in ("y", "w", "n"))
    fitted = np.arange(4000) % 10 > 0
    assert (w > 0).sum() == len(np.unique(x[fitted]))
    assert n.sum() == 4000 and (w * y_)[w > 0].sum() == pytest.approx(2 * y[fitted].sum())
    assert (w * y_**2)[w < 0].sum() == pytest.approx(-2 * (y[~fitted] ** 2).sum())  # watched rows keep their labels


# --- registry --------------------------------------------------------------------------------------------------------


def test_fits_use_all_rows_and_bounded_rows_keep_partitions(spark):
    rows = spark.range(0, 24_000, 1, 6).select("id", F.array((F.col("id") % 3).cast("double")).alias("x"), F.col("id").cast("double").alias("label"))
    rows = rows.select("id", array_to_vector("x").alias("features"), "label")
    fitted = TR.train_all(TR.get_specs("regression", ["decision_tree"]), rows, "regression", id_col="id")[0]
    got = {r["id"]: r["prediction"] for r in fitted.predict(rows.where("id < 3"), "id").collect()}
    assert got == {i: pytest.approx(np.arange(i, 24_000, 3).mean()) for i in range(3)}
    some = TR.bounded_rows(rows, "id", 10_000)
    assert some.count() == 10_000 and some.rdd.getNumPartitions() == 6


def test_tree_models_come_back_from_bundles(spark, tmp_path):
    from tabforge.operators.preprocess import PreprocessorModel
    from tabforge.plans.config import PreprocessingConfig

    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(size=(200, 2)), rng.integers(0, 3, 200))
    for name, small in (("extra_trees", {"numTrees": 3}), ("hist_gradient_boosting", {"maxIter": 3})):
        model = TR.train_all(TR.get_specs("classification", [name]), df, "classification", id_col="id", overrides={name: small})[0]
        assert model.is_success, model.error
        path = BD.save_bundle(spark, str(tmp_path / name), model=model, pre=PreprocessorModel({}, {}),
                              schema=FeatureSchema(numeric=("a",), categorical=(), target="label"), metrics={}, config=PreprocessingConfig())
        back = BD.load_bundle(spark, path)[0]
        assert sorted(back.predict(df, "id").collect()) == sorted(model.predict(df, "id").collect())
