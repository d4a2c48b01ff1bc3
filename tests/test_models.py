"""Properties of the models: periods, calibration, and planted outliers."""

import numpy as np

from plumbline.functions import special
from plumbline.operators import models


def test_expected_values(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(p), f"c{i % 40}", float(x), ["a", "b"][k], float(np.exp(0.1 * x + k + rng.normal(0, 0.1)) * (100 if i == 777 else 1))) for i, (p, x, k) in enumerate(zip(rng.integers(1, 4, 3000), rng.uniform(0, 10, 3000), rng.integers(0, 2, 3000), strict=True))]
    df = spark.createDataFrame(rows, "id int, period int, cluster string, x double, k string, y double")
    done, registry = models.expected_values(df, "id", "period", "y", ["x"], ["k"], "cluster", s=models.Trees(depth=3, iterations=60))
    got = done.toPandas().set_index("id")
    assert len(got) == 3000 and got.expected.notna().all()
    assert [r["scheme"] for r in registry] == ["CROSS_FIT", "CROSS_FIT", "EARLIER_PERIODS", "EARLIER_PERIODS"]
    fit = np.log1p(got.y) - np.log1p(got.expected)
    assert fit.abs().median() < 0.2 and got.p_model[777] < 0.01
    assert 0.02 < (got.p_model <= 0.05).mean() < 0.1
    sizes = got.groupby("period").size()
    assert registry[2]["fitted_rows"] < sizes[1] and registry[3]["fitted_rows"] < sizes[1] + sizes[2]


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), "x") for i, (a, b) in enumerate(rng.uniform(5, 10, (400, 2)))] + [(999, 5000.0, 0.0, "x"), (1000, None, 7.0, None)]
    got = models.isolation_forest(spark.createDataFrame(rows, "id int, a double, b double, c string"), "id", ["a", "b"], ["c"]).toPandas()
    assert len(got) == 402 and got.sort_values("score").id.iloc[-1] in (999, 1000) and got.set_index("id").score[999] > got.score.quantile(0.98)


def test_lof(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 2))
    ref = np.unique(x, axis=0)
    score = models.lof_scores(np.array([[0.0, 0.0], [8.0, 8.0]]), ref, 20)
    assert 0.8 < score[0] < 1.3 and score[1] > 2
    rows = [(i, "g", float(a), float(b)) for i, (a, b) in enumerate(x)] + [(500, "g", 30.0, 30.0), (501, "few", 1.0, 1.0), (502, "g", None, 1.0)] + [(600 + i, "same", 1.0, 2.0) for i in range(40)]
    got = {r["id"]: (r["score"], r["reason"]) for r in models.peer_lof(spark.createDataFrame(rows, "id int, g string, a double, b double"), "id", ["g"], ["a", "b"]).collect()}
    assert len(got) == len(rows) and max((s, i) for i, (s, _) in got.items() if s is not None)[1] == 500
    assert (got[501][1], got[502][1], got[600][1]) == ("INSUFFICIENT_PEERS", "MISSING_FEATURE", "INSUFFICIENT_DISTINCT_VALUES")


def test_vectorised_tails(spark):
    import math

    for k, n, p in ((0, 5, 0.3), (3, 10, 0.2), (700, 1000, 0.6), (60_000, 100_000, 0.599)):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
        assert abs(special.binom_sf(k, n, p) - want) < 1e-7
    assert special.binom_two_sided(2, 10, 0.5) == special.binom_two_sided(8, 10, 0.5)
    assert abs(special.binom_two_sided(2, 10, 0.5) - 2 * 56 / 1024) < 1e-12
    df = spark.createDataFrame([(3.0, 10.0, 0.2), (None, 1.0, 0.1)], "k double, n double, p double")
    got = df.select(special.binom_sf_col("k", "n", "p").alias("s")).collect()
    assert abs(got[0]["s"] - special.binom_sf(3, 10, 0.2)) < 1e-12 and got[1]["s"] is None
