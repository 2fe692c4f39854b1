"""Results that hang on the order of a sum, and on silence."""

from __future__ import annotations

from tidemark.operators.clusters import cluster_stability
from tidemark.operators.delays import mode_delay, select_delay
from tidemark.operators.signals import levels, transients

#: In this order their mean is 64.49999999999999, in any other it is 64.5.
DELAYS = (63.83, 65.32, 64.35)


def rows(spark):
    own = [(1, i, v, round(v), True, 0) for i, v in enumerate((*DELAYS, 64.0, 200.0, 210.0, 220.0, 230.0, 240.0, 250.0, 260.0)) if v != 64.0]
    return spark.createDataFrame(own[::-1], "source_key long, window_idx int, raw_delay_ms double, delay_ms int, accepted boolean, label int").repartition(1)


def test_means_are_summed_in_the_windows_order(spark):
    assert {r.mode: r.delay_ms for r in select_delay(rows(spark)).collect()}["clustered"] == 64
    assert mode_delay(rows(spark), 1).first().raw_ms == 64.49999999999999


def test_outliers_of_clusters_are_held_against_that_mean(spark):
    found = cluster_stability(rows(spark).where("window_idx < 3"), outlier_ms=65.32 - 64.5).first()
    assert found.outliers == 1


def test_a_block_of_zeros(spark):
    samples = spark.createDataFrame([("a", i, 0.0 if i < 32 else 0.5) for i in range(48)], "signal string, sample_idx long, value double")
    assert [r.db for r in levels(samples).orderBy("block").collect()][:2] == [float("-inf")] * 2
    assert transients(levels(samples), 3.0).where("block = 2").count() == 1
