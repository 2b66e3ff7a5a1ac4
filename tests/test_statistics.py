import math
import random

import pytest
from helpers import bundle, entity
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrygrid.functions import stats
from sentrygrid.operators.cohorts import cohorts, peer_stats


def z(spark, value, median, mad, std):
    return spark.range(1).select(stats.robust_z(*(F.lit(x).cast("double") for x in (value, median, mad, std)))).first()[0]


def test_robust_z(spark):
    assert z(spark, 5, 5, 0, 0) == 0 and z(spark, 6, 5, 0, 0) == 3 and z(spark, 4, 5, 0, 0) == -3
    assert z(spark, 1000, 5, 1, 9) == 10 and z(spark, None, 5, 1, 1) == 0 and z(spark, 1, None, None, None) == 0
    assert z(spark, 7, 5, 0, 2) == 1
    assert math.isclose(z(spark, 7, 5, 1, 9), 2 / 1.4826)


def test_percentiles_of_peers(spark):
    ents = spark.createDataFrame([entity(f"E{i}") for i in range(5)], "entity_id string, sector string, size_band string, soc_model string, a double, b double, c double, d double")
    values = spark.createDataFrame([(f"E{i}", float(10 * (i + 1))) for i in range(5)], "entity_id string, value double")
    got = {r.value: r.percentile for r in peer_stats(values, cohorts(ents)).collect()}
    assert got == pytest.approx({10.0: 0.1, 20.0: 0.3, 30.0: 0.5, 40.0: 0.7, 50.0: 0.9})


def test_cohort_levels(spark):
    b = bundle(spark, entities=[entity("E1"), entity("E2"), entity("E3"), entity("E4", band="Tier-2"), entity("E5", "energy", "Tier-3"), entity("E6", None, None)])
    got = {r.entity_id: (r.cohort_level, r.cohort_size) for r in cohorts(b.entities).collect()}
    assert got == {"E1": ("primary", 3), "E2": ("primary", 3), "E3": ("primary", 3), "E4": ("sector_fallback", 4), "E5": ("global_fallback", 6), "E6": ("global_fallback", 6)}


def test_too_few_peers_with_a_value_fall_back_to_all(spark):
    b = bundle(spark, entities=[entity("E1"), entity("E2"), entity("E3"), *(entity(f"X{i}", "energy") for i in range(3))])
    values = spark.createDataFrame([("E1", 1.0), ("E2", 2.0), ("X0", 3.0), ("X1", 4.0), ("X2", 5.0)], "entity_id string, value double")
    got = {r.entity_id: r.peers for r in peer_stats(values, cohorts(b.entities)).collect()}
    assert got == {"E1": 5, "E2": 5, "X0": 3, "X1": 3, "X2": 3}


def test_poisson_tail(spark):
    def cdf(k, mu):
        return spark.range(1).select(stats.poisson_cdf(F.lit(k), F.lit(float(mu)))).first()[0]

    assert cdf(0, 100) < 1e-10 and cdf(5, 0) == 1.0
    assert math.isclose(cdf(3, 2.5), sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(4)))
    assert math.isclose(cdf(1000, 1000), 0.508, abs_tol=1e-3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12))
def test_gini_and_entropy_match_their_definitions(spark, xs):
    df = spark.createDataFrame([("k", x) for x in xs], "k string, x int")
    n, total, ranked = len(xs), sum(xs), sorted(xs)
    want = 2 * sum((i + 1) * x for i, x in enumerate(ranked)) / (n * total) - (n + 1) / n if total else 0.0
    assert stats.gini(df, ["k"], "x", "g").first().g == pytest.approx(want)
    shares = [xs.count(v) / n for v in set(xs)]
    assert stats.entropy_bits(df, ["k"], "x", "h").first().h == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)


def test_spearman_with_ties(spark):
    random.seed(1)
    rows = [(float(i // 2), float(-i)) for i in range(10)]
    assert stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first().rho == pytest.approx(-0.9847, abs=1e-3)


@pytest.mark.parametrize(("rho", "n", "p"), [(0.5, 10, 0.14111328), (0.5, 3, 2 / 3), (0.5, 4, 0.5), (-0.3, 25, 0.14504), (1.0, 12, 0.0), (0.0, 7, 1.0)])
def test_p_value_of_a_correlation(spark, rho, n, p):
    row = spark.createDataFrame([(rho, n)], "rho double, n long").select(stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).first()
    assert row.p == pytest.approx(p, abs=2e-4)


def test_p_value_needs_three_pairs(spark):
    assert spark.createDataFrame([(1.0, 2)], "rho double, n long").select(stats.correlation_p(F.col("rho"), F.col("n")).alias("p")).first().p is None
