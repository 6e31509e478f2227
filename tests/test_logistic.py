"""Tight fits of the logistic meta-learner by Newton's steps, against MLlib and NumPy."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array

from gradeloom.operators import logistic, stack
from gradeloom.operators.logistic import LogisticModel, curvature
from gradeloom.sources.models import load_model, save_model


def shares(n=400, seed=5):
    """Three classes; inputs that depend on each other, as those of meta-learners do."""
    rnd = np.random.default_rng(seed)
    y = rnd.integers(0, 3, n)
    blocks = [rnd.uniform(0.1, 1, (n, 3)) + 0.8 * (y[:, None] == np.arange(3)) for _ in range(2)]
    blocks = [b / b.sum(axis=1, keepdims=True) for b in blocks]
    return np.hstack([*blocks, sum(blocks) / 2]), y


def table(spark, x, y, weight=None):
    weight = np.ones(len(y)) if weight is None else weight
    rows = [(k, None if y[k] is None else int(y[k]), [float(v) for v in x[k]], float(weight[k])) for k in range(len(y))]
    rows = spark.createDataFrame(rows, "row_id long, y int, x array<double>, weight double")
    return rows.withColumn("features", array_to_vector("x"))


def probabilities(model, rows):
    got = model.transform(rows).select("row_id", vector_to_array("probability").alias("p")).orderBy("row_id").collect()
    return np.array([r.p for r in got])


def test_curvature_is_the_change_of_the_gradient():
    x, y = shares(30)
    weight, at = np.linspace(0.5, 2, 30), np.random.default_rng(1).normal(size=(10, 3))
    _, gradient, second = curvature(x, y, weight, at)
    for k in range(30):
        moved = at.copy()
        moved[k % 10, k // 10] += 1e-5
        loss, other, _ = curvature(x, y, weight, moved)
        assert (other - gradient) / 1e-5 == pytest.approx(second[k], abs=1e-3)
        assert (loss - curvature(x, y, weight, at)[0]) / 1e-5 == pytest.approx(gradient[k], abs=1e-3)


@pytest.mark.parametrize("n", [200, 3000])
def test_few_passes_to_the_optimum(spark, n):
    x, y = shares(n)
    rows = table(spark, x, y)
    model = stack.logistic_meta(n, 0.2).setTol(1e-10).fit(rows)
    assert len(model.losses) <= 12
    assert model.losses == sorted(model.losses, reverse=True)
    p, coefficients = probabilities(model, rows), model.coefficientMatrix.toArray()
    slopes = (p - (y[:, None] == np.arange(3))).T @ x / n + coefficients / (0.2 * n)
    assert np.abs(slopes).max() < 1e-9
    assert (p - (y[:, None] == np.arange(3))).mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9)


def test_equals_mllib(spark):
    x, y = shares()
    rows = table(spark, x, y, np.random.default_rng(2).integers(0, 4, len(y)))
    settings = dict(labelCol="y", weightCol="weight", family="multinomial", regParam=0.01, standardization=False, maxIter=2000, tol=1e-12)
    theirs = LogisticRegression(**settings).fit(rows)
    ours = stack.logistic_meta(100, 1.0, weight="weight").setTol(1e-12).fit(rows)
    assert isinstance(ours, LogisticModel)
    assert ours.coefficientMatrix.toArray() == pytest.approx(theirs.coefficientMatrix.toArray(), abs=1e-5)
    assert ours.interceptVector.toArray() == pytest.approx(theirs.interceptVector.toArray(), abs=1e-5)
    assert (ours.numClasses, ours.numFeatures) == (theirs.numClasses, theirs.numFeatures) == (3, 9)
    assert probabilities(ours, rows) == pytest.approx(probabilities(theirs, rows), abs=1e-6)
    a, b = (
        m.transform(rows).orderBy("row_id").select("prediction", vector_to_array("rawPrediction").alias("r")).collect() for m in (ours, theirs)
    )
    assert [r.prediction for r in a] == [r.prediction for r in b]
    assert np.array([r.r for r in a]) == pytest.approx(np.array([r.r for r in b]), abs=1e-4)


def test_does_not_depend_on_blocks(spark, monkeypatch):
    x, y = shares()
    rows = table(spark, x, y)
    learner = stack.logistic_meta(400).setTol(1e-10)
    one = learner.fit(rows)
    for constant, value in (("BLOCK_ROWS", 30), ("CHUNK_ROWS", 7), ("TASK_BYTES", 3000), ("SUM_TASKS", 2)):
        monkeypatch.setattr(logistic, constant, value)
    assert learner.fit(rows.repartition(3)).arrays["weights"] == pytest.approx(one.arrays["weights"], abs=1e-8)


def test_classes_told_apart_come_to_an_end(spark):
    rows = table(spark, np.array([[0.0], [1.0], [2.0], [3.0]]), [0, 0, 1, 1])
    model = stack.logistic_meta(4, 1e9).setTol(1e-12).fit(rows)
    assert len(model.losses) < 100
    assert probabilities(model, rows)[[0, 1, 2, 3], [0, 0, 1, 1]] == pytest.approx(np.ones(4), abs=1e-4)


def test_mllib_keeps_its_cases(spark, monkeypatch):
    x, y = shares(60)
    rows, tight = table(spark, x, y), stack.logistic_meta(60).setTol(1e-10)
    assert isinstance(stack.logistic_meta(60).fit(rows), LogisticRegressionModel)
    assert isinstance(stack.logistic_meta(60, 1e12).setTol(1e-10).fit(rows), LogisticRegressionModel)
    assert isinstance(tight.fit(table(spark, x, np.ones(60))), LogisticRegressionModel)
    with pytest.raises(Exception, match="(?i)label"):
        tight.fit(table(spark, x, [None, *y[1:].tolist()]))
    monkeypatch.setattr(logistic, "MOST_WEIGHTS", 29)
    assert isinstance(tight.fit(rows), LogisticRegressionModel)


def test_stored(spark, tmp_path):
    x, y = shares(60)
    rows = table(spark, x, y)
    model = stack.logistic_meta(60).setTol(1e-10).fit(rows)
    save_model(spark, model, str(tmp_path / "model"))
    assert (probabilities(load_model(spark, str(tmp_path / "model")), rows) == probabilities(model, rows)).all()
