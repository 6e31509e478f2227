"""Metrics, blending, stacking, calibration, boosting and diagnostics."""

import dataclasses
import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from gradeloom.operators import blocks, boost, calibrate, class_weights, diagnose, metrics, stack
from gradeloom.operators import blend as B
from gradeloom.operators.frequency import FrequencyLearner
from gradeloom.operators.encode import LabelEncoder
from gradeloom.operators.impute import Imputer, fit_scaler
from gradeloom.operators.meta_features import MetaLayout
from gradeloom.operators.scoring import score_in_batches
from gradeloom.plans import inputs as I
from gradeloom.plans.queries import ml_rows
from gradeloom.sources import predictions as stored
from gradeloom.sources.models import load_model, save_model

RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def labelled(spark, y, probs, **more):
    rows = [(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(y, probs))]
    return spark.createDataFrame(rows, "row_id int, y int, probs array<double>")


def wide(spark, n=60, k=3, models=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    blocks_ = [rng.dirichlet(np.ones(k), n) for _ in models]
    blocks_[0][np.arange(n), y] += 0.5
    blocks_[0] /= blocks_[0].sum(axis=1, keepdims=True)
    rows = [(i, int(y[i]), *[b[i].tolist() for b in blocks_]) for i in range(n)]
    schema = "row_id int, y int, " + ", ".join(f"{m} array<double>" for m in models)
    return spark.createDataFrame(rows, schema), y, blocks_


# ---------------------------------------------------------------- metrics


def test_report_by_hand(spark):
    """Class 2 is never predicted, class 3 is predicted but never true."""
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 3)], "y int, y_pred int")
    counts = metrics.confusion_counts(df)
    f1 = {r.label: r.f_score for r in metrics.class_scores(counts).collect()}
    assert f1 == pytest.approx({0: 0.8, 1: 2 / 3, 2: 0.0, 3: 0.0})
    row = metrics.summary_scores(counts).first()
    assert (row.n, row.accuracy) == (5, 0.6)
    assert row.f1_macro == pytest.approx((0.8 + 2 / 3) / 4)
    assert row.f1_weighted == pytest.approx((3 * 0.8 + 2 / 3) / 5)
    report = {r.label: r for r in metrics.classification_report(counts, names=("A", "B")).collect()}
    assert set(report) == {"A", "B", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert report["A"].precision == 1.0 and report["A"].recall == pytest.approx(2 / 3)
    assert report["accuracy"].precision is None and report["accuracy"].f1 == 0.6
    assert report["weighted avg"].support == 5
    assert {r.label for r in metrics.class_accuracy(counts).collect()} == {0, 1, 2, 3}
    assert {r.label for r in metrics.class_accuracy(counts, empty="skip").collect()} == {0, 1, 2}


@RELAXED
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_confusion_sums_to_rows(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, y_pred int")
    cells = metrics.confusion_matrix(metrics.confusion_counts(df), [0, 1, 2, 3]).collect()
    assert len(cells) == 16
    assert {(r.y, r.y_pred): r.n for r in cells} == {c: pairs.count(c) for c in itertools.product(range(4), range(4))}


def brute_auc(y, s, k):
    pos, neg = s[y == k, k], s[y != k, k]
    if not len(pos) or not len(neg):
        return None
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_with_ties(spark, digits):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 3, 50), rng.dirichlet(np.ones(3), 50).round(digits)
    got = {r.label: (r.auc, r.support) for r in metrics.auc_one_vs_rest(labelled(spark, y, p)).collect()}
    for k in range(3):
        assert got[k] == (pytest.approx(brute_auc(y, p, k)), int((y == k).sum()))


def test_auc_without_a_class(spark):
    per_class = metrics.auc_one_vs_rest(labelled(spark, [0, 1], [[0.9, 0.1, 0.0], [0.2, 0.7, 0.1]]))
    assert {r.label: r.auc for r in per_class.collect()} == {0: 1.0, 1: 1.0, 2: None}
    assert metrics.mean_auc(per_class).first().auc == 1.0


def test_log_loss_is_clipped_and_normalised(spark):
    row = metrics.model_report(labelled(spark, [0, 1], [[2.0, 2.0], [1.0, 0.0]]), 2, ()).first()
    assert row.log_loss == pytest.approx((math.log(2) - math.log(2.220446049250313e-16)) / 2)


def test_cross_entropy_against_numpy(spark):
    rng = np.random.default_rng(2)
    z, y, w = rng.normal(size=(30, 4)), rng.integers(0, 4, 30), np.array([0.5, 1.0, 2.0, 0.25])
    df = labelled(spark, y, z).withColumnRenamed("probs", "logits")
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    nll, spread = -logp[np.arange(30), y], -(logp * w).sum(axis=1)
    expected = (0.95 * (w[y] * nll).sum() + 0.05 / 4 * spread.sum()) / w[y].sum()
    assert metrics.cross_entropy(df, "logits", "y", list(w), 0.05).first()[0] == pytest.approx(expected)
    ce = (w[y] * nll).sum() / w[y].sum()
    row = metrics.focal_score(df, "logits", "y", list(w)).first()
    assert row.focal == pytest.approx((1 - math.exp(-ce)) ** 2 * ce)


def test_class_weights_with_empty_class(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "y int")
    rows = {r.label: r for r in class_weights.class_weights(df, "y", 3).collect()}
    assert [rows[k].n for k in range(3)] == [2, 1, 1]
    assert sum(r.inverse for r in rows.values()) == pytest.approx(3.0)
    assert rows[0].log == pytest.approx(math.log(1 + 4 / 2))


# ---------------------------------------------------------------- blocks and stores


def test_blocks_need_one_prediction_per_model(spark):
    df, _, _ = wide(spark, 10)
    pred = blocks.long_blocks(df, ["a", "b"])
    back = blocks.wide_blocks(pred, ["a", "b"], 3).orderBy("row_id").collect()
    assert back == df.orderBy("row_id").collect()
    for broken in (pred.filter("NOT (row_id = 3 AND model = 'b')"), pred.union(pred.filter("row_id = 3"))):
        with pytest.raises(Exception, match="exactly one prediction per model"):
            blocks.wide_blocks(broken, ["a", "b"], 3).collect()


def test_prediction_store_is_strict(spark, tmp_path):
    df, _, _ = wide(spark, 10)
    pred, path = blocks.long_blocks(df, ["a", "b"]), str(tmp_path / "p")
    stored.write_predictions(pred, path)
    assert stored.read_predictions(spark, path, ["b"], df).count() == 10
    with pytest.raises(ValueError, match="no stored predictions"):
        stored.read_predictions(spark, path, ["a", "c"])
    for rows in (df.filter("row_id < 9"), df.union(df.selectExpr("row_id + 50", "y", "a", "b"))):
        with pytest.raises(ValueError, match="do not match"):
            stored.read_predictions(spark, path, ["a"], rows)


def test_metadata(spark, tmp_path):
    path = str(tmp_path / "m")
    stored.write_stack_metadata(spark, path, ["a"], ["x", "y"])
    info = stored.read_stack_metadata(spark, path)
    stored.require_meta_dim(2, info)
    with pytest.raises(ValueError, match="mismatch"):
        stored.require_meta_dim(3, info)


# ---------------------------------------------------------------- blending


@pytest.mark.parametrize("k, points", [(1, 1), (2, 11), (3, 66), (4, 286)])
def test_simplex_grid_is_complete(k, points):
    grid = B.simplex_grid(k)
    assert len(grid) == points and all(sum(w) == pytest.approx(1.0) for w in grid)
    assert grid == sorted(grid)


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=5))
def test_weights_lie_on_simplex(w):
    out = B.normalise_weights(w)
    assert all(x >= 0 for x in out) and sum(out) == pytest.approx(1.0)


def test_grid_search_against_numpy(spark):
    df, y, (a, b) = wide(spark)
    grid = B.simplex_grid(2)
    accuracy = [float(((w[0] * a + w[1] * b).argmax(axis=1) == y).mean()) for w in grid]
    model = B.WeightedBlend(("a", "b"), 3, "grid_search").fit(df)
    assert model.fitted_score == pytest.approx(max(accuracy))
    assert list(model.weights) == pytest.approx(grid[accuracy.index(max(accuracy))])
    assert model.score(df) == pytest.approx(max(accuracy))


def test_grid_search_by_auc_is_exact(spark):
    df, y, (a, b) = wide(spark, 80)
    grid = B.simplex_grid(2)
    support = np.bincount(y)

    def auc(p):
        return sum(brute_auc(y, p, k) * support[k] for k in range(3)) / len(y)

    exact = [auc(w[0] * a + w[1] * b) for w in grid]
    rows = B.candidate_auc(df, ["a", "b"], 3, grid).collect()
    assert {r.candidate: r.auc for r in rows} == pytest.approx(dict(enumerate(exact)))
    for bins in (4, 256):
        assert int(np.argmax(exact)) in B.leading_candidates(df, ["a", "b"], 3, grid, bins=bins)
    best = B.best_weights(df, ["a", "b"], 3, grid, "auc").first()
    assert (best.candidate, best.score) == (int(np.argmax(exact)), pytest.approx(max(exact)))


def test_auc_of_one_class_is_null(spark):
    df, _, _ = wide(spark, 40)
    rows = B.candidate_auc(df.filter("y = 1"), ["a", "b"], 3, B.simplex_grid(2, 2)).collect()
    assert [r.auc for r in rows] == [None] * 3


def test_grid_of_five_models(spark):
    df, _, _ = wide(spark, 40)
    five = df.selectExpr("*", "a AS c", "b AS d", "a AS e")
    model = B.WeightedBlend(("a", "b", "c", "d", "e"), 3, "grid_search", "f1", steps=2).fit(five)
    assert sum(model.weights) == pytest.approx(1) and set(model.weights) <= {0.0, 0.5, 1.0}


def test_likelihood_never_falls(spark):
    df, _, _ = wide(spark)
    shares = B.true_class_shares(df, ["a", "b"], 3).persist()
    weights, seen = [0.5, 0.5], []
    for _ in range(5):
        row = B.em_step(shares, weights).first()
        seen.append(row.log_likelihood)
        weights = B.normalise_weights([row.w0, row.w1])
    assert all(b >= a - 1e-12 for a, b in zip(seen, seen[1:]))
    model = B.WeightedBlend(("a", "b"), 3, metric="auc").fit(df)
    assert sum(model.weights) == pytest.approx(1.0) and model.weights[0] > model.weights[1]
    assert model.fitted_score is not None and set(model.get_weights()) == {"a", "b"}


def test_blend_api_errors(spark):
    with pytest.raises(NotImplementedError):
        B.WeightedBlend(("a",), 3, use_proba=False)
    with pytest.raises(ValueError, match="unknown method"):
        B.WeightedBlend(("a",), 3, "guess")
    with pytest.raises(ValueError, match="unknown metric"):
        B.WeightedBlend(("a",), 3, metric="rmse")
    with pytest.raises(ValueError, match="at least one model"):
        B.WeightedBlend((), 3)


def test_validation_rows_are_used(spark):
    df, _, _ = wide(spark)
    worse = df.selectExpr("row_id", "y", "b AS a", "a AS b")
    model = B.WeightedBlend(("a", "b"), 3).fit(df, worse)
    assert model.weights[1] > model.weights[0]


# ---------------------------------------------------------------- out-of-fold models


def test_frequencies_leave_own_fold_out(spark):
    rows = [(0, "u", 0, 0), (1, "u", 1, 1), (2, None, 1, 0), (3, "u", 1, 0)]
    df = spark.createDataFrame(rows, "row_id int, k string, y int, fold int")
    learner = FrequencyLearner({"m": "k"}, 2)
    got = {r.row_id: r.m for r in learner.out_of_fold(df).collect()}
    assert got == {
        0: pytest.approx([1 / 3, 2 / 3]),
        1: pytest.approx([2 / 4, 2 / 4]),
        2: [0.5, 0.5],
        3: pytest.approx([1 / 3, 2 / 3]),
    }
    new = spark.createDataFrame([("u",), ("zzz",), (None,)], "k string")
    fitted = {r.k: r.m for r in learner.fit(df).transform(new).collect()}
    assert fitted["u"] == pytest.approx([2 / 5, 3 / 5]) and fitted["zzz"] == [0.5, 0.5]
    assert fitted[None] == pytest.approx([1 / 3, 2 / 3])


def test_stacking_with_estimators(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    base = {
        "forest": stack.random_forest(numTrees=3, maxDepth=4),
        "logistic": stack.logistic_meta(1000).setMaxIter(5),
    }
    train = rows.filter("split != 'test'").withColumn("fold", F.expr("fold % 2"))
    model = stack.StackingEnsemble(base, 5, 2).fit(train)
    out = model.transform(rows.filter("split = 'test'")).collect()
    assert len(out) == rows.filter("split = 'test'").count()
    assert all(sum(r.probs) == pytest.approx(1.0) for r in out)
    shares = model.get_model_weights(rows)
    assert set(shares) == set(base) and sum(shares.values()) == pytest.approx(1.0)
    assert model.evaluate(rows).first().accuracy > 0.25
    oof = stack.out_of_fold(train, base, 5, 2)
    assert oof.count() == train.count() and blocks.unscored_rows(train, oof).isEmpty()


def test_stored_models_need_out_of_fold_blocks(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    base = {"forest": stack.random_forest(numTrees=2)}
    with pytest.raises(ValueError, match="no out-of-fold blocks"):
        stack.StackingEnsemble(base, 5, 2, stored=("network",)).fit(rows)
    with pytest.raises(ValueError, match="at least two base models"):
        stack.StackingEnsemble(base, 5, 2).fit(rows)


def test_network_first_layer_gives_usage(spark):
    df, _, _ = wide(spark, 40)
    layout = MetaLayout(("a", "b"), 3)
    network = stack.network_meta(len(layout.slot_names()), 3, (4,), "_meta", max_iter=3)
    from pyspark.ml.functions import array_to_vector

    fitted = network.fit(layout.assemble(df, "_meta").select("y", array_to_vector("_meta").alias("_meta")))
    model = stack.StackingModel(stack.StackingEnsemble({}, 3), layout, {}, fitted)
    cells = model.coefficients(df)
    assert cells.count() == 4 * len(layout.slot_names())
    assert set(model.get_model_weights(df)) == {"a", "b"}
    impact = {r.ablated: r for r in diagnose.ablation_impact(df, ["a", "b"], 3, model.predict_blocks).collect()}
    assert set(impact) == {"none", "a", "b"} and impact["none"].accuracy_drop == 0.0


# ---------------------------------------------------------------- calibration and boosting


def test_temperature_against_search(spark, sf_dir):
    rows = I.signal_logits(spark, sf_dir)
    best = calibrate.TemperatureScaling(5).fit(rows).temperature
    near = [best * 0.99, best, best * 1.01]
    losses = {r.temperature: r.nll for r in calibrate.temperature_losses(rows, "logits", "y", 5, near).collect()}
    assert min(losses, key=losses.get) == best


def test_temperature_of_separable_and_of_contrary_logits(spark):
    """The loss has no inner minimum; the search stays within its bounds."""
    right = labelled(spark, [0, 1], [[2.0, 0.0], [0.0, 2.0]]).withColumnRenamed("probs", "logits")
    wrong = labelled(spark, [1, 0], [[2.0, 0.0], [0.0, 2.0]]).withColumnRenamed("probs", "logits")
    assert 1e-6 <= calibrate.TemperatureScaling(2).fit(right).temperature < 0.5
    assert 100 < calibrate.TemperatureScaling(2).fit(wrong).temperature <= 1e6


def test_isotonic_is_monotone_and_normalised(spark):
    df, _, _ = wide(spark, 60)
    rows = df.selectExpr("row_id", "y", "a AS probs")
    model = calibrate.IsotonicCalibration(3).fit(rows)
    steps = model.steps.orderBy("k", "lo").collect()
    for k in range(3):
        own = [r for r in steps if r.k == k]
        assert own and all(a.hi < b.lo and a.value < b.value for a, b in zip(own[:-1], own[1:]))
    out = model.transform(rows).collect()
    assert all(sum(r.probs) == pytest.approx(1.0) for r in out) and len(out) == 60


def test_boosting_against_numpy(spark):
    rng = np.random.default_rng(4)
    n, k = 80, 3
    y, g, h = rng.integers(0, k, n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    rows = [(i, int(y[i]), int(g[i]), int(h[i]), "valid" if i % 4 == 0 else "train") for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, y int, g int, h int, split string")
    model = boost.Booster((boost.GroupMean("g"), boost.GroupMean("h"), boost.GroupMean("g")), k, store_every=1).fit(df)
    train, onehot = np.arange(n) % 4 != 0, np.eye(k)[y]
    scores = np.zeros((n, k))
    for i, key in enumerate((g, h, g)):
        e = np.exp(scores)
        goal = onehot if i == 0 else 0.2 * (onehot - e / e.sum(axis=1, keepdims=True))
        means = np.array([goal[train & (key == v)].mean(axis=0) for v in range(key.max() + 1)])
        scores = scores + means[key]
        assert model.history[i][0] == pytest.approx((scores.argmax(axis=1) == y)[train].mean())
        assert model.history[i][1] == pytest.approx((scores.argmax(axis=1) == y)[~train].mean())
    got = np.array([r.scores for r in model.transform(df).orderBy("row_id").collect()])
    np.testing.assert_allclose(got, scores, atol=1e-12)


def test_boosting_checks_its_input():
    with pytest.raises(ValueError, match="at least one learner"):
        boost.Booster((), 3)
    with pytest.raises(ValueError, match="one learning rate per learner"):
        boost.Booster((boost.GroupMean("g"),), 3, (0.1, 0.2))


def test_boosting_with_trees(spark, sf_dir):
    rows = ml_rows(spark, sf_dir).withColumn("split", F.expr("if(split = 'test', 'valid', 'train')"))
    tree = boost.RegressorPerClass(DecisionTreeRegressor(featuresCol="features", maxDepth=3, seed=1))
    model = boost.Booster((tree, tree), 5).fit(rows)
    assert len(model.history) == 2 and model.history[1][0] >= model.history[0][0] - 0.05


# ---------------------------------------------------------------- predict-only models and search


def test_batch_scoring_checks_shape(spark):
    df = spark.range(10).selectExpr("id AS row_id", "cast(id AS double) AS x")
    good = score_in_batches(df, lambda: lambda b: np.c_[b["x"], -b["x"]], ["row_id"], ["x"], token="t")
    assert {r.row_id: r.logits for r in good.collect()} == {i: [float(i), -float(i)] for i in range(10)}
    with pytest.raises(Exception, match="one row of outputs per input row"):
        score_in_batches(df, lambda: lambda b: np.zeros((1, 2)), ["row_id"], ["x"]).collect()


def test_grid_search_refits_the_best(spark, sf_dir):
    rows = ml_rows(spark, sf_dir).withColumn("fold", F.expr("cast(fold % 2 AS int)"))
    forest = stack.random_forest(numTrees=2)
    grid = stack.parameter_grid(forest, {"maxDepth": (1, 5)})
    search = stack.grid_search(rows, forest, grid, k=2)
    table = stack.grid_table(rows, search).collect()
    assert [r.best for r in table] == [False, True]
    assert {r.split for r in stack.split_scores(rows, search.bestModel).collect()} == {"test", "train"}


def test_grids_fit_their_estimators():
    assert len(stack.parameter_grid(stack.random_forest(), stack.FOREST_GRID)) == 8
    assert len(stack.parameter_grid(stack.boosted_trees(), stack.DEEP_BOOSTED_GRID)) == 32
    assert len(stack.parameter_grid(stack.boosted_trees(), stack.SHALLOW_BOOSTED_GRID)) == 16


def test_grid_reaches_inner_classifier(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    trees = stack.boosted_trees()
    setting = stack.parameter_grid(trees, {"maxIter": (1,), "maxDepth": (2,)})[0]
    fitted = trees.fit(rows, setting)
    assert all(m.getNumTrees == 1 for m in fitted.models)


def test_methods_on_the_same_rows(spark):
    df, _, _ = wide(spark)
    methods = {
        "even": B.WeightedBlend(("a", "b"), 3, "uniform").fit(df).transform,
        "fitted": B.WeightedBlend(("a", "b"), 3).fit(df).transform,
    }
    report = {r.method: r for r in diagnose.compare_methods(df, methods, 3).collect()}
    assert set(report) == set(methods) and report["fitted"].log_loss < report["even"].log_loss


def test_weights_with_an_absent_class(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3, "y int")
    rows = {r.label: r for r in class_weights.class_weights(df, "y", 3).collect()}
    assert [rows[k].balanced for k in range(3)] == pytest.approx([9 / 12, 9 / 6, 9 / 2])
    assert class_weights.class_weights(df.limit(0), "y", 2).first().balanced == 1.0


def test_models_with_numbers_for_names(spark, tmp_path):
    pred = spark.createDataFrame([(1, 0, "1", 0, [1.0, 0.0]), (1, 0, "2", 0, [0.0, 1.0])], "row_id long, y int, model string, fold int, probs array<double>")
    stored.write_predictions(pred, str(tmp_path / "p"))
    out = stored.read_predictions(spark, str(tmp_path / "p"), ["1", "2"], pred.select("row_id").distinct())
    assert {(r.model, tuple(r.probs)) for r in out.collect()} == {("1", (1.0, 0.0)), ("2", (0.0, 1.0))}


def test_models_are_stored_and_read_again(spark, sf_dir, tmp_path):
    rows = ml_rows(spark, sf_dir).filter("split != 'test'")
    folds = rows.select("row_id", "y", "features", (F.col("row_id") % 3).cast("int").alias("fold"))
    bases = {"forest": stack.random_forest(numTrees=3, maxDepth=2), "logistic": stack.logistic_meta(300)}
    blocks_, _, _ = wide(spark, 50)
    plain = spark.createDataFrame([(float(k), "ab"[k % 2], k % 3) for k in range(30)], "v double, t string, y int")
    pairs = [
        (stack.StackingEnsemble(bases, 5, 3, enhanced=True).fit(folds), folds),
        (B.WeightedBlend(("a", "b"), 3).fit(blocks_), blocks_),
        (calibrate.IsotonicCalibration(3, "a").fit(blocks_), blocks_),
        (LabelEncoder(("t",)).fit(plain), plain),
        (Imputer(("v",), ("t",)).fit(plain), plain),
        (fit_scaler(plain, ["v"]), plain),
        (FrequencyLearner({"by_t": "t"}, 3).fit(plain), plain),
    ]
    for k, (model, df) in enumerate(pairs):
        save_model(spark, model, str(tmp_path / f"m{k}"))
        again = load_model(spark, str(tmp_path / f"m{k}"))
        assert type(again) is type(model)
        assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))
    with pytest.raises(TypeError):
        save_model(spark, (print,), str(tmp_path / "x"))


def test_layout_must_fit_the_meta_learner(spark, sf_dir):
    rows = ml_rows(spark, sf_dir).filter("split != 'test'")
    folds = rows.select("row_id", "y", "features", (F.col("row_id") % 2).cast("int").alias("fold"))
    bases = {"forest": stack.random_forest(numTrees=2, maxDepth=2), "logistic": stack.logistic_meta(200)}
    model = stack.StackingEnsemble(bases, 5, 2, enhanced=True).fit(folds)
    plain = dataclasses.replace(model, layout=MetaLayout((), 5, raw=("forest", "logistic")))
    with pytest.raises(ValueError, match="meta-feature mismatch"):
        plain.transform(folds)


def test_settings_of_learner_queries_are_in_the_declared_grids():
    """Results of learners are compared with SQL where they can be enumerated; these are the settings of the others."""
    from gradeloom.plans import learners, queries

    assert all(queries.FOREST[p] in values for p, values in stack.FOREST_GRID.items())
    assert all(queries.BOOSTED[p] in values for p, values in stack.SHALLOW_BOOSTED_GRID.items())
    for settings_, grid in ((learners.DEEP, stack.DEEP_BOOSTED_GRID), (learners.SHALLOW, stack.SHALLOW_BOOSTED_GRID)):
        assert all(settings_[p] in grid[p] for p in ("maxIter", "maxDepth", "stepSize", "subsamplingRate"))
    assert {s: tuple(v["hidden"]) for s, v in learners.NETWORKS.items()} == stack.HIDDEN_LAYERS
