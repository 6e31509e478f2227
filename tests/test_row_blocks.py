"""Rows of the iterative learners are packed once into blocks; how they are cut changes nothing."""

import numpy as np
import pyarrow as pa
import pytest

from gradeloom.operators import boosted, network
from gradeloom.operators.boosted import SoftmaxBoostedTrees
from gradeloom.operators.learners import list_column
from gradeloom.operators.network import NetworkClassifier
from gradeloom.sources import shared


def table(spark, n=200):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(n, 3)).round(2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    rows = [(k, int(y[k]), [None if rnd.random() < 0.1 else float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, features array<double>")


def test_trees_do_not_depend_on_blocks(spark, monkeypatch):
    rows = table(spark)
    trees = SoftmaxBoostedTrees(numClasses=3, maxIter=3, maxDepth=3, subsamplingRate=0.7, rowCol="row_id", maxBins=8)
    one = trees.fit(rows)
    for constant, value in (("BLOCK_ROWS", 16), ("TASK_ROWS", 10), ("BEST_CELLS", 1), ("STORE_EVERY", 1)):
        monkeypatch.setattr(boosted, constant, value)
    many = trees.fit(rows)
    assert all((one.arrays[k] == many.arrays[k]).all() for k in ("feature", "cut", "missing_left", "value"))


def test_a_batch_of_rows_becomes_one_block():
    cuts = [np.array([0.5])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([0, 1, 0], pa.int32()), pa.array([False, False, True]), list_column(np.array([[0.0], [1.0], [np.nan]]))],
        names=["h", "y", "held", "features"],
    )
    blocks = list(boosted._to_bins(cuts, 2)(iter([batch, batch])))
    assert [b.num_rows for b in blocks] == [1]
    h, y, held, bins, margins = next(boosted._blocks(iter(blocks), 1))
    assert h.tolist() == [1, 2, 3] * 2 and y.tolist() == [0, 1, 0] * 2 and held.tolist() == [False, False, True] * 2
    assert bins.tolist() == [[1, 2, 0] * 2] and margins.shape == (6, 2)


def test_networks_hardly_depend_on_blocks(spark, monkeypatch):
    rows = table(spark)
    learner = NetworkClassifier(numClasses=3, hidden=[4], maxIter=6, batches=2, validationShare=0.2)
    one = learner.fit(rows)
    monkeypatch.setattr(network, "CHUNK_ROWS", 16)
    monkeypatch.setattr(network, "TASK_ROWS", 20)
    assert learner.fit(rows).arrays["weights"] == pytest.approx(one.arrays["weights"])
    held = rows.selectExpr("features", "y", "1.0D AS weight", "int(row_id % 3) - 1 AS batch").mapInArrow(network._packed(3), network.BLOCK)
    found = held.selectExpr("batch", "length(x) / 24 AS n").groupBy("batch").sum("n").collect()
    assert {r[0]: r[1] for r in found} == {-1: 67, 0: 67, 1: 66}


def test_blocks_are_handed_over_a_few_at_a_time(spark, monkeypatch):
    limits, plain = [], boosted._round
    monkeypatch.setattr(boosted, "_round", lambda *a, **k: (limits.append(spark.conf.get(shared._BATCH)), plain(*a, **k))[1])
    before = spark.conf.get(shared._BATCH)
    SoftmaxBoostedTrees(numClasses=3, maxIter=2, maxDepth=1).fit(table(spark, 40))
    assert limits == [str(4 << 20)] * 2 and spark.conf.get(shared._BATCH) == before
    spark.conf.set(shared._BATCH, "1000")
    try:
        with shared.bounded_batches(spark):
            assert spark.conf.get(shared._BATCH) == "1000"
    finally:
        spark.conf.unset(shared._BATCH)
