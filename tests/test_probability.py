"""Probability expressions against NumPy and by hand."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import probability as P
from gradeloom.operators.meta_features import MetaLayout

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")


def values(df, expression):
    return [r.x for r in df.orderBy("i").select(F.expr(expression).alias("x")).collect()]


@pytest.mark.parametrize(
    "row, index", [([0.2, 0.4, 0.4], 1), ([0.5, 0.0, 0.5], 0), ([0.0, 0.0, 1.0], 2)]
)
def test_argmax_takes_first_of_ties(spark, row, index):
    df = frame(spark, [row])
    assert values(df, P.argmax("v")) == [index]
    assert values(df, P.argmax_of(["v[0]", "v[1]", "v[2]"])) == [index]


@RELAXED
@given(st.lists(st.lists(st.floats(-300, 300), min_size=4, max_size=4), min_size=1, max_size=5))
def test_softmax(spark, rows):
    df = frame(spark, rows)
    got = np.array(values(df, P.softmax("v", 4)))
    z = np.array(rows)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    np.testing.assert_allclose(got, e / e.sum(axis=1, keepdims=True), atol=1e-12)
    np.testing.assert_allclose(got.sum(axis=1), 1.0)
    lse = np.array(values(df, P.log_sum_exp("v", 4)))
    np.testing.assert_allclose(lse, z.max(axis=1) + np.log(e.sum(axis=1)), atol=1e-9)


def test_temperature_keeps_argmax(spark):
    df = frame(spark, [[1.0, 3.0, 2.0], [5.0, -1.0, 0.0]])
    for t in ("0.1D", "1.0D", "50.0D"):
        assert values(df, P.argmax(P.softmax("v", 3, t))) == [1, 0]


def test_entropy_of_zeros_and_uniform(spark):
    df = frame(spark, [[1.0, 0.0, 0.0, 0.0, 0.0], [0.2] * 5])
    sure, even = values(df, P.entropy("v"))
    assert sure == pytest.approx(0.0, abs=1e-9)
    assert even == pytest.approx(math.log(5))


def test_margin_of_single_class(spark):
    assert values(frame(spark, [[0.7]]), P.margin("v", 1)) == [0.7]


def test_normalised_without_mass_is_uniform(spark):
    assert values(frame(spark, [[0.0, 0.0], [1.0, 3.0]]), P.normalised("v", 2)) == [[0.5, 0.5], [0.25, 0.75]]


def test_null_probability_stays_null(spark):
    df = frame(spark, [[None, 0.5]])
    assert values(df, P.entropy("v")) == [None]
    assert values(df, P.log_loss_term("v", "0", 2)) == [None]


def test_checked_width(spark):
    with pytest.raises(Exception, match="expected 3 classes but got 2"):
        values(frame(spark, [[0.5, 0.5]]), P.checked_width("v", 3))


def numpy_meta(blocks, mean_entropy=True):
    def figures(p):
        s = np.sort(p, axis=1)
        c = np.clip(p, 1e-12, 1.0)
        return np.c_[s[:, -1], s[:, -1] - s[:, -2], -(c * np.log(c)).sum(axis=1)]

    mean = np.mean(blocks, axis=0)
    parts = list(blocks) + [figures(b) for b in blocks] + [mean, figures(mean)[:, : 3 if mean_entropy else 2]]
    return np.hstack(parts)


@pytest.mark.parametrize("mean_entropy", [True, False])
def test_meta_features_against_numpy(spark, mean_entropy):
    rng = np.random.default_rng(3)
    blocks = [rng.dirichlet(np.ones(5), 20) for _ in range(3)]
    rows = [(i, *[b[i].tolist() for b in blocks]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, c array<double>")
    layout = MetaLayout(("a", "b", "c"), 5, mean_entropy=mean_entropy)
    got = np.array([r.meta for r in layout.assemble(df).orderBy("i").collect()])
    np.testing.assert_allclose(got, numpy_meta(blocks, mean_entropy), atol=1e-12)
    assert got.shape[1] == len(layout.slot_names()) == 3 * 5 + 9 + 5 + (3 if mean_entropy else 2)


def test_mixed_layout(spark):
    df = spark.createDataFrame(
        [([0.5, 0.5], [0.25, 0.75], [1.0, 0.0])], "a array<double>, b array<double>, t array<double>"
    )
    layout = MetaLayout(("a", "b"), 2, raw=("t",))
    row = layout.assemble(df).first().meta
    assert row[:4] == [0.5, 0.5, 0.25, 0.75] and row[-2:] == [1.0, 0.0]
    assert dict(layout.slot_table())["t_p0"] == "t"
    with pytest.raises(ValueError, match="two base models"):
        MetaLayout(("a",), 2).assemble(df)
