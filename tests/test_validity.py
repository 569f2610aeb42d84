"""Validity indices on fixtures worked out by hand."""

import math

import pytest

from lattica.operators import validate


@pytest.fixture(scope="module")
def two(spark):
    """{0, 2} and {10, 12}: means 1 and 11, the whole mean 6."""
    return spark.createDataFrame([(0, [0.0], 0), (1, [2.0], 0), (2, [10.0], 1), (3, [12.0], 1)], "sample_id long, x array<double>, cluster int")


def value(df):
    return df.first()[0]


def test_within_and_between(two):
    assert value(validate.wcss(two)) == 4.0
    assert value(validate.bcss(two)) == 25.0  # 1/2 * 5^2 + 1/2 * 5^2
    assert {r.cluster: r.ssd for r in validate.heterogeneity(two).collect()} == {0: 2.0, 1: 2.0}


def test_separation(two):
    assert value(validate.davies_bouldin(two)) == pytest.approx((1 + 1) / 10)
    assert value(validate.dunn(two)) == pytest.approx(8 / 2)
    s = [(11 - 2) / 11, (9 - 2) / 9, (9 - 2) / 9, (11 - 2) / 11]  # mean distances to the others: 11, 9, 9, 11
    assert value(validate.silhouette(two)) == pytest.approx(sum(s) / 4)
    # nearest two: 0 -> 2, 10; 2 -> 0, 10; 10 -> 12, 2; 12 -> 10, 2: one foreign second neighbour each
    assert value(validate.connectivity(two, 2)) == pytest.approx(4 * 1 / 2)


def test_summary(two):
    row = validate.summary(two).first().asDict()
    assert row["clusters"] == 2 and row["wcss"] == 4.0 and row["bcss"] == 25.0 and row["mean_qe"] == 1.0


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1)], "sample_id long, u int, v int")
    # joint counts 2, 1, 1; rows 2, 2; columns 3, 1
    i = 0.5 * math.log(2 * 4 / (2 * 3)) + 0.25 * math.log(4 / (2 * 3)) + 0.25 * math.log(4 / (2 * 1))
    hu, hv = math.log(2), -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert value(validate.nmi(df, "u", "v")) == pytest.approx(i / math.sqrt(hu * hv))
    # pairs together in both 1, in u 2, in v 3, of 6: expected 1
    assert value(validate.adjusted_rand(df, "u", "v")) == pytest.approx((1 - 1) / (2.5 - 1))
