"""Boosted trees, target statistics, networks, isotonic fits and the prediction store, against plain Python and NumPy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradeloom.operators import boosted, calibrate, isotonic, network, stack
from gradeloom.operators.boosted import SoftmaxBoostedModel, SoftmaxBoostedTrees
from gradeloom.operators.isotonic import CrossCalibration, IsotonicCalibration
from gradeloom.operators.network import NetworkClassifier, NetworkModel
from gradeloom.operators.target_statistics import OrderedTargetStatistics
from gradeloom.sources import predictions as stored
from gradeloom.sources.models import load_model, save_model


def table(spark, n=300, seed=1, missing=0.1):
    """Three classes told by two of three features, some of them missing."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 3)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    rows = [(k, int(y[k]), [None if rnd.random() < missing else float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, features array<double>")


def probabilities(model, rows):
    got = model.transform(rows).select("row_id", vector_to_array("probability").alias("p")).orderBy("row_id").collect()
    return np.array([r.p for r in got])


# ---------------------------------------------------------------- boosted trees


def plain_round(x, y, n, depth, rate, penalty, max_bins):
    """Class margins after one round, by enumerating all splits."""
    margins = np.zeros((len(x), n))
    unit = boosted.UNIT
    for c in range(n):
        g = np.rint((1 / n - (y == c)) * unit).astype(np.int64)
        h = np.full(len(x), int(np.rint(2 / n * (1 - 1 / n) * unit)))

        def grow(rows, level):
            gs, hs = g[rows].sum() / unit, h[rows].sum() / unit
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    values = np.unique(x[~np.isnan(x[:, f]), f])
                    for cut in [*(values[:-1] + (values[1:] - values[:-1]) / 2), np.inf]:
                        for side in (False, True):
                            nan = np.isnan(x[rows, f])
                            left = np.where(nan, side, x[rows, f] <= cut)
                            gl, hl = g[rows[left]].sum() / unit, h[rows[left]].sum() / unit
                            if hl < 1 or hs - hl < 1:
                                continue
                            gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                            if gain > best[0] + (0 if best[1] is None else 1e-9):
                                best = (gain, left)
            if best[1] is None:
                margins[rows, c] = -rate * gs / (hs + penalty)
            else:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)

        grow(np.arange(len(x)), 0)
    return margins


@pytest.mark.parametrize("depth", [1, 3])
def test_one_round_against_enumeration(spark, depth):
    rnd = np.random.default_rng(depth)
    x = rnd.integers(0, 6, (120, 3)).astype(float)
    x[rnd.random(x.shape) < 0.1] = np.nan
    y = rnd.integers(0, 3, 120)
    rows = [(k, int(y[k]), [None if np.isnan(v) else float(v) for v in x[k]]) for k in range(120)]
    df = spark.createDataFrame(rows, "row_id long, y int, features array<double>")
    model = SoftmaxBoostedTrees(numClasses=3, maxIter=1, maxDepth=depth, stepSize=0.5, maxBins=16).fit(df)
    expected = boosted.softmax_rows(plain_round(x, y, 3, depth, 0.5, 1.0, 16))
    assert probabilities(model, df) == pytest.approx(expected, abs=1e-12)


def test_boosting_does_not_depend_on_the_placement_of_rows(spark, monkeypatch):
    monkeypatch.setattr(boosted, "STORE_EVERY", 2)
    rows = table(spark)
    trees = SoftmaxBoostedTrees(numClasses=3, maxIter=5, maxDepth=3, subsamplingRate=0.6, featureShare=0.7, rowCol="row_id", maxBins=8)
    one, other = trees.fit(rows.coalesce(1)), trees.fit(rows.repartition(7))
    for k in ("feature", "cut", "missing_left", "value"):
        assert (one.arrays[k] == other.arrays[k]).all()
    monkeypatch.setattr(boosted, "TASK_CELLS", 50)
    again = trees.fit(rows.repartition(3))
    assert all((one.arrays[k] == again.arrays[k]).all() for k in ("feature", "cut", "value"))


def test_boosting_learns_follows_a_loss_and_stops(spark, tmp_path):
    rows = table(spark, 600).withColumn("held", F.col("row_id") % 4 == 0)
    trees = SoftmaxBoostedTrees(numClasses=3, maxIter=80, maxDepth=3, stepSize=0.5, validationIndicatorCol="held", patience=5)
    model = trees.fit(rows)
    train, held = zip(*model.history)
    assert train[0] == pytest.approx(math.log(3), abs=1e-6) and train[-1] < 0.3 and len(model.history) < 80
    assert len(model.arrays["feature"]) == int(np.argmin(held))
    scored = model.transform(rows.withColumn("features", array_to_vector(F.transform("features", lambda v: F.coalesce(v, F.lit(float("nan")))))))
    assert scored.where("held AND prediction = y").count() / scored.where("held").count() > 0.8
    model.write().overwrite().save(str(tmp_path / "m"))
    assert (probabilities(SoftmaxBoostedModel.load(str(tmp_path / "m")), rows) == probabilities(model, rows)).all()
    save_model(spark, {"trees": model}, str(tmp_path / "all"))
    assert (probabilities(load_model(spark, str(tmp_path / "all"))["trees"], rows) == probabilities(model, rows)).all()


def test_boosting_rejects_what_it_cannot_learn(spark):
    rows = table(spark, 20)
    for bad in (rows.withColumn("y", F.lit(7)), rows.withColumn("y", F.lit(None).cast("int"))):
        with pytest.raises(ValueError, match="label"):
            SoftmaxBoostedTrees(numClasses=3, maxIter=1).fit(bad)
    with pytest.raises(ValueError, match="no rows"):
        SoftmaxBoostedTrees(numClasses=3, maxIter=1).fit(rows.where("false"))
    with pytest.raises(ValueError, match="features"):
        SoftmaxBoostedTrees(numClasses=3).fit(rows.union(rows.selectExpr("row_id", "y", "array(1.0D)")))


def test_boosting_of_constant_and_missing_features(spark):
    rows = spark.createDataFrame([(k, k % 2, [1.0, None]) for k in range(10)], "row_id long, y int, features array<double>")
    model = SoftmaxBoostedTrees(numClasses=2, maxIter=2).fit(rows)
    assert probabilities(model, rows) == pytest.approx(np.full((10, 2), 0.5))
    # Whether a value is missing can be all that tells the classes.
    rows = spark.createDataFrame([(k, k % 2, [None if k % 2 else 1.0]) for k in range(20)], "row_id long, y int, features array<double>")
    p = probabilities(SoftmaxBoostedTrees(numClasses=2, maxIter=5, stepSize=0.5).fit(rows), rows)
    assert (p.argmax(axis=1) == np.arange(20) % 2).all()


def test_learners_in_a_pipeline_and_a_search(spark, tmp_path):
    rows = table(spark, 200).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    model = Pipeline(stages=[SoftmaxBoostedTrees(numClasses=3, maxIter=3, maxDepth=2)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert (probabilities(again, rows) == probabilities(model, rows)).all()
    trees = SoftmaxBoostedTrees(numClasses=3, maxDepth=2)
    search = stack.grid_search(rows, trees, stack.parameter_grid(trees, {"maxIter": (1, 4)}), k=2)
    table_ = stack.grid_table(rows, search).collect()
    assert [r.parameters for r in table_] == ["maxIter=1", "maxIter=4"] and sum(r.best for r in table_) == 1
    nets = NetworkClassifier(numClasses=3, hidden=[4], maxIter=5)
    assert nets.copy({nets.hidden: [7, 2]}).fit(rows).sizes == [3, 7, 2, 3]


# ---------------------------------------------------------------- target statistics


def test_ordered_statistics_against_plain_python(spark):
    import hashlib

    rnd = np.random.default_rng(3)
    rows = [(k, int(rnd.integers(0, 3)), str(rnd.choice(["a", "b", ""])) if k % 7 else None, int(rnd.integers(0, 2))) for k in range(90)]
    df = spark.createDataFrame(rows, "row_id long, y int, c string, d int").repartition(4)
    model, got = OrderedTargetStatistics(("c", "d"), 3, strength=0.5, seed=9).fit_transform(df)
    prior = [sum(r[1] == k for r in rows) / 90 for k in range(3)]
    order = sorted(rows, key=lambda r: (hashlib.md5(f"9:{r[0]}".encode()).hexdigest(), str(r[0])))
    expected = {}
    for at, r in enumerate(order):
        shares = []
        for column in (2, 3):
            before = [q for q in order[:at] if q[column] == r[column]]
            shares.append([(sum(q[1] == k for q in before) + 0.5 * prior[k]) / (len(before) + 0.5) for k in range(3)])
        expected[r[0]] = shares
    for r in got.collect():
        assert [r.c_shares, r.d_shares] == [pytest.approx(e) for e in expected[r.row_id]]
    new = spark.createDataFrame([(1, "a", None), (2, "new", 1)], "row_id long, c string, d int")
    scored = {r.row_id: r for r in model.transform(new).collect()}
    own = [r for r in rows if r[2] == "a"]
    assert scored[1].c_shares == pytest.approx([(sum(r[1] == k for r in own) + 0.5 * prior[k]) / (len(own) + 0.5) for k in range(3)])
    assert scored[2].c_shares == pytest.approx(prior) and scored[1].d_shares == pytest.approx(prior)
    with pytest.raises(ValueError, match="class"):
        OrderedTargetStatistics(("c",), 3).fit(df.where("false"))


# ---------------------------------------------------------------- networks


@pytest.mark.parametrize("unit", ["relu", "tanh", "logistic"])
def test_gradient_against_differences(unit):
    rnd = np.random.default_rng(2)
    sizes = [4, 5, 3, 3]
    x, y, w = rnd.normal(size=(20, 4)), rnd.integers(0, 3, 20), rnd.random(20) + 0.5
    flat = network.start_weights(sizes, unit, 1)
    loss, grad = network.loss_and_gradient(x, y, w, flat, sizes, unit)
    for k in rnd.choice(len(flat), 25, replace=False):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (network.loss_and_gradient(x, y, w, flat + s * step, sizes, unit)[0] for s in (1, -1))
        assert grad[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)
    assert network.penalty_mask(sizes).sum() == 4 * 5 + 5 * 3 + 3 * 3


def test_sums_of_many_tasks_equal_one(spark, monkeypatch):
    rows = table(spark, 200, missing=0).selectExpr("features", "y", "1.0D AS weight", "0 AS batch")
    sizes = [3, 4, 3]
    flat = network.start_weights(sizes, "tanh", 0)
    one = network._sums(rows.coalesce(1), flat, sizes, "tanh", 0, 1)
    monkeypatch.setattr(network, "SUM_TASKS", 2)
    many = network._sums(rows.repartition(9), flat, sizes, "tanh", 0, 9)
    x = np.array([r.features for r in rows.collect()])
    y = np.array([r.y for r in rows.collect()])
    loss, grad = network.loss_and_gradient(x, y, np.ones(200), flat, sizes, "tanh")
    assert one[0] == pytest.approx(loss) and one[1] == 200 and one[4:] == pytest.approx(grad)
    assert many == pytest.approx(one)


@pytest.mark.parametrize("settings_", [{"activation": "relu", "hidden": [16, 8]}, {"activation": "tanh", "hidden": [12]}, {"hidden": [], "batches": 3}])
def test_networks_learn_and_stop(spark, tmp_path, settings_):
    rows = table(spark, 800, missing=0)
    learner = NetworkClassifier(numClasses=3, stepSize=0.1, maxIter=300, patience=4, tol=1e-2, validationShare=0.2, **settings_)
    model = learner.fit(rows)
    assert len(model.history) < 300 and all(0 < held for _, held in model.history)
    scored = model.transform(rows)
    assert scored.where("prediction = y").count() > 0.75 * 800
    model.write().overwrite().save(str(tmp_path / "n"))
    assert (probabilities(NetworkModel.load(str(tmp_path / "n")), rows) == probabilities(model, rows)).all()


def test_network_rows_with_weights_and_faults(spark):
    rows = table(spark, 60, missing=0.2)
    whole = rows.withColumn("w", F.lit(2.0))
    a = NetworkClassifier(numClasses=3, hidden=[3], maxIter=4, validationShare=0.0, l2=0.0).fit(rows)
    b = NetworkClassifier(numClasses=3, hidden=[3], maxIter=4, validationShare=0.0, l2=0.0, weightCol="w").fit(whole)
    assert b.arrays["weights"] == pytest.approx(a.arrays["weights"])
    with pytest.raises(ValueError, match="label"):
        NetworkClassifier(numClasses=2).fit(rows)
    with pytest.raises(ValueError, match="activation"):
        NetworkClassifier(numClasses=3, activation="step").fit(rows)


def test_network_as_meta_learner(spark):
    rows = table(spark, 300, missing=0).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    rows = rows.withColumn("features", array_to_vector("features"))
    bases = {"trees": SoftmaxBoostedTrees(numClasses=3, maxIter=2, maxDepth=2), "logistic": LogisticRegression(labelCol="y")}
    metas = {"net": NetworkClassifier(featuresCol="_meta", numClasses=3, hidden=[6], maxIter=150, stepSize=0.05), "plain": None}
    models = stack.StackingEnsemble(bases, 3, 2, enhanced=True).fit_metas(rows, metas)
    for model in models.values():
        out = model.transform(rows)
        assert out.where("y = y_pred").count() > 200
        assert sum(model.get_model_weights(rows).values()) == pytest.approx(1.0)


# ---------------------------------------------------------------- isotonic fits


def plain_isotonic(pairs):
    """{score: value} of the isotonic fit of (score, hit)."""
    groups = {}
    for s, hit in pairs:
        n, h = groups.get(s, (0, 0))
        groups[s] = (n + 1, h + hit)
    scores = sorted(groups)
    n, h = (np.array([groups[s][k] for s in scores], float) for k in (0, 1))
    fit = {}
    for i, s in enumerate(scores):
        fit[s] = max(min(h[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(scores))) for a in range(i + 1))
    return fit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=30))
def test_pooling(pairs):
    expected = plain_isotonic(pairs)
    scores = sorted(expected)
    n = np.array([sum(s == t for t, _ in pairs) for s in scores])
    hits = np.array([sum(h for t, h in pairs if s == t) for s in scores])
    lo, hi, n, hits = isotonic.pooled(np.array(scores, float), np.array(scores, float), n, hits)
    for s in scores:
        at = np.flatnonzero((lo <= s) & (s <= hi))
        assert len(at) == 1 and hits[at[0]] / n[at[0]] == pytest.approx(expected[s])


@pytest.mark.parametrize("shape", ["rising", "falling", "random", "late"])
def test_isotonic_over_many_ranges(spark, monkeypatch, shape):
    """Ranges of four blocks: violators are pooled across their borders too."""
    monkeypatch.setattr(isotonic, "BLOCKS_PER_TASK", 4)
    rnd = np.random.default_rng(5)
    m = 60
    share = {"rising": np.arange(m) / m, "falling": 1 - np.arange(m) / m, "random": rnd.random(m), "late": np.r_[np.arange(m - 1) / m, 0.0]}[shape]
    pairs = [(k / m, int(v)) for k in range(m) for v in rnd.random(5) < share[k]]
    rows = [(k, hit, [1 - s, s]) for k, (s, hit) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_id long, y int, probs array<double>").repartition(5)
    model = IsotonicCalibration(2).fit(df)
    one, zero = plain_isotonic(pairs), plain_isotonic([(1 - s, 1 - hit) for s, hit in pairs])
    sent = model.transform(df).select("row_id", "probs").orderBy("row_id").collect()
    for r, (s, _) in zip(sent, pairs):
        total = one[s] + zero[1 - s]
        assert r.probs == pytest.approx([zero[1 - s] / total, one[s] / total] if total else [0.5, 0.5])
    monkeypatch.setattr(isotonic, "SENT_BLOCKS", 1)
    monkeypatch.setattr(isotonic, "RANGE_BLOCKS", 3)
    between = spark.createDataFrame([(k, [v, u]) for k, (v, u) in enumerate(rnd.uniform(-0.2, 1.2, (40, 2)).tolist())] + [(99, None)], "row_id long, probs array<double>")
    for some in (df.select("row_id", "probs"), between):
        joined = model.transform(some).select("row_id", "probs").orderBy("row_id").collect()
        monkeypatch.setattr(isotonic, "SENT_BLOCKS", 10**6)
        direct = model.transform(some).select("row_id", "probs").orderBy("row_id").collect()
        monkeypatch.setattr(isotonic, "SENT_BLOCKS", 1)
        assert [r.row_id for r in joined] == [r.row_id for r in direct]
        assert all(a.probs == (None if b.probs is None else pytest.approx(b.probs)) for a, b in zip(joined, direct))


def test_isotonic_leaves_out_rows_without_score_and_needs_all_classes(spark):
    rows = [(0, 0, [0.2, 0.8]), (1, 1, [0.1, 0.9]), (2, None, [0.5, 0.5]), (3, 1, None), (4, 1, [float("nan"), None])]
    df = spark.createDataFrame(rows, "row_id long, y int, probs array<double>")
    model = IsotonicCalibration(2).fit(df)
    assert model.steps.count() >= 2 and model.transform(df).where("row_id = 3").first().probs is None
    with pytest.raises(ValueError, match="classes"):
        IsotonicCalibration(3).fit(df)


def test_cross_calibration_inside_a_stack(spark, tmp_path):
    rows = table(spark, 240, missing=0).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    rows = rows.withColumn("features", array_to_vector("features"))
    base = LogisticRegression(labelCol="y", maxIter=20)
    calibrated = CrossCalibration(base, 3)
    model = calibrated.fit(rows.drop("fold"))
    out = model.transform(rows).select("probability").collect()
    assert len(model.parts) == 3 and all(sum(r.probability) == pytest.approx(1.0) for r in out)
    save_model(spark, model, str(tmp_path / "c"))
    again = load_model(spark, str(tmp_path / "c")).transform(rows)
    assert again.orderBy("row_id").select("probability").collect() == model.transform(rows).orderBy("row_id").select("probability").collect()
    stacked = stack.StackingEnsemble({"a": calibrated, "b": base}, 3, 2).fit(rows)
    assert stacked.transform(rows).where("y = y_pred").count() > 180


def test_temperature_reports_whether_it_converged(spark):
    inner = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0])] * 5, "y int, logits array<double>")
    assert calibrate.TemperatureScaling(2).fit(inner).converged
    separable = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 2.0])], "y int, logits array<double>")
    assert not calibrate.TemperatureScaling(2).fit(separable).converged


# ---------------------------------------------------------------- prediction store


def test_two_stores_in_turn_keep_both(spark, tmp_path):
    path = str(tmp_path / "store")

    def block(model, value, n=4):
        return spark.createDataFrame([(k, 0, model, 0, [value, 1 - value]) for k in range(n)], "row_id int, y int, model string, fold int, probs array<double>")

    stored.write_predictions(block("a", 0.1), path)
    stored.write_predictions(block("b b/1", 0.2), path)
    assert stored.stored_models(spark, path) == ["a", "b b/1"]
    stored.write_predictions(block("a", 0.3), path)
    fault = block("a", 0.9).withColumn("fold", F.expr("raise_error('lost')").cast("int"))
    with pytest.raises(Exception, match="lost"):
        stored.write_predictions(fault, path)
    rows = block("a", 0.0).select("row_id")
    for _ in range(2):
        got = stored.read_predictions(spark, path, ["a", "b b/1"], rows).groupBy("model").agg(F.min(F.col("probs")[0]).alias("p"), F.count("*").alias("n"))
        assert {(r.model, r.p, r.n) for r in got.collect()} == {("a", 0.3, 4), ("b b/1", 0.2, 4)}
        stored.remove_replaced(spark, path)
    assert len(list((tmp_path / "store" / "manifest").iterdir())) == 2


# ---------------------------------------------------------------- weights for a metric, model files


@pytest.mark.parametrize("metric", ["accuracy", "auc"])
def test_pattern_search_against_plain_python(spark, metric):
    from gradeloom.operators import blend as B

    rnd = np.random.default_rng(4)
    n, k = 70, 3
    y = rnd.integers(0, k, n)
    blocks = [rnd.dirichlet(np.ones(k), n).round(3) for _ in range(3)]
    blocks[0][np.arange(n), y] += 0.3
    rows = [(i, int(y[i]), *[b[i].tolist() for b in blocks]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, y int, a array<double>, b array<double>, c array<double>")

    def score(w):
        p = w[0] * blocks[0] + w[1] * blocks[1] + w[2] * blocks[2]
        if metric == "accuracy":
            return (p.argmax(axis=1) == y).mean()
        aucs = []
        for c in range(k):
            up, down = p[y == c, c], p[y != c, c]
            aucs.append(((up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()) * (y == c).sum())
        return sum(aucs) / n

    blend = B.WeightedBlend(("a", "b", "c"), k, "pattern_search", metric, steps=4, least_step=1 / 32)
    model = blend.fit(df)
    grid = B.simplex_grid(3, 4)
    weights = max([[1 / 3] * 3, *grid], key=score)
    step, best = 1 / 4, score(weights)
    while step >= 1 / 32:
        trials = B._moves(weights, step)
        there = max(trials, key=lambda w: round(score(w), 12))
        if score(there) > best + 1e-12:
            weights, best = there, score(there)
        else:
            step /= 2
    assert model.converged and model.fitted_score == pytest.approx(best) and model.weights == pytest.approx(weights)
    assert model.fitted_score >= max(model.uniform_score, max(score(w) for w in grid)) - 1e-12
    assert not B.WeightedBlend(("a", "b", "c"), k, "pattern_search", metric, steps=4, max_iter=1).fit(df).converged


def test_model_files_are_checked_and_read_in_chunks(spark, tmp_path):
    from gradeloom.operators.scoring import score_with_file, write_arrays

    rows = spark.createDataFrame([(i, float(i), None if i == 3 else 1.0) for i in range(25)], "row_id int, a double, b double").coalesce(1)
    path = str(tmp_path / "model-1.npz")
    checksum = write_arrays(spark, {"w": np.array([[1.0, 2.0], [10.0, 20.0]])}, path)

    def build(arrays):
        def predict(x):
            assert len(x) <= 10
            return np.column_stack([np.nan_to_num(x) @ arrays["w"], np.full(len(x), len(x))])

        return predict

    out = score_with_file(rows, path, checksum, build, ["row_id"], ["a", "b"], chunk_rows=10).orderBy("row_id").collect()
    assert [r.logits[2] for r in out] == [10.0] * 20 + [5.0] * 5
    assert out[2].logits[:2] == [12.0, 24.0] and out[3].logits[:2] == [3.0, 6.0]
    with pytest.raises(Exception, match="checksum"):
        score_with_file(rows, path, "0" * 64, build, ["row_id"], ["a", "b"]).collect()
