import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlab.operators import ensemble, stats
from answerlab.plans import quantiles, skew

inf = float("inf")


def test_statistics_use_finite_values_only(spark):
    frame = spark.createDataFrame(
        [("1", None), ("3", None), ("inf", None), ("-inf", None), (None, None), ("x", None), ("2d", None), ("NaN", None)],
        "metric string, empty double",
    )
    rows = {r.metric: r for r in stats.metric_statistics(frame, ["metric", "empty"]).collect()}
    assert (rows["metric"].mean, rows["metric"].std, rows["metric"].n) == (2.0, 1.0, 2)
    assert (rows["empty"].mean, rows["empty"].std, rows["empty"].n) == (None, None, 0)


def test_infinite_scores_do_not_count_in_means(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (inf, 0.0), (3.0, None)], "a double, acc double")
    rows = {r.metric: r for r in stats.run_summary(frame, ["a"], ["acc"]).collect()}
    assert (rows["a"].mean, rows["a"].std) == (2.0, None)
    assert (rows["acc"].mean, rows["acc"].std) == (0.5, 0.5)


@pytest.mark.parametrize("ranges", [8, 1, 97])
def test_exact_quantiles_also_of_large_groups(spark, ranges):
    rng = np.random.default_rng(1)
    data = {
        "uniform": rng.random(20_000),
        "heavy": np.exp(rng.normal(size=15_000) * 4),
        "ties": np.round(rng.random(9_000), 2),
        "zeros": np.r_[np.zeros(9_000), 1.0],
        "few": rng.random(7),
    }
    frame = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = quantiles.exact_quantiles(frame, "k", "x", probabilities).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(rows) == len(data)
    for row in rows:
        assert row.quantiles == pytest.approx(np.quantile(data[row.k], probabilities).tolist(), rel=1e-12)


def test_box_plot_statistics(spark):
    x = np.r_[np.arange(20.0), 100.0, -50.0]
    frame = spark.createDataFrame([("m", float(v)) for v in x] + [("m", inf), ("other", 1.0)], "metric string, value double")
    rows = {r.metric: r for r in stats.box_plot_statistics(frame, ["m", "none"]).collect()}
    m = rows["m"]
    assert (m.q1, m.median, m.q3) == tuple(np.quantile(x, [0.25, 0.5, 0.75]))
    assert m.mean == pytest.approx(x.mean())
    assert (m.whisker_low, m.whisker_high, m.outliers) == (0.0, 19.0, 2)
    assert set(rows) == {"m", "none"} and rows["none"].median is None


def confidence(models):
    """The definition for one group, in NumPy."""
    eps = 1e-12
    scale = lambda p: p / (p.sum() + eps)
    models = [scale(np.asarray(p, float)) for p in models]
    mean = np.mean(models, axis=0)
    limit = lambda p: np.clip(scale(p), eps, 1.0)
    kl = [float(np.sum(limit(p) * np.log(limit(p) / limit(mean)))) for p in models]
    return math.exp(-np.mean(kl))


def test_kl_confidence(spark):
    groups = {
        "same": [[0.2, 0.3, 0.5], [0.2, 0.3, 0.5]],
        "apart": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 4.0]],
        "one": [[0.1, 0.9, 0.0]],
        "nothing": [[0.0, 0.0, 0.0], [1.0, 1.0, 2.0]],
    }
    # Zero probabilities are left out of the rows, but every model has one row.
    rows = [(g, m, c, p) for g, ms in groups.items() for m, ps in enumerate(ms) for c, p in enumerate(ps) if p or c == 0]
    frame = spark.createDataFrame(rows, "grp string, model int, class int, prob double")
    got = {r.grp: r.confidence for r in ensemble.kl_confidence(frame, [0, 1, 2]).collect()}
    for name, models in groups.items():
        assert got[name] == pytest.approx(confidence(models), rel=1e-9)


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)], "k int, i int")
    values = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k int, v string")
    for how in ("inner", "left"):
        sizes = skew.measure_groups(rows, "k", 40)
        assert sizes.has_large and sizes.groups == 7
        salted = skew.salt(rows, sizes, rows["i"])
        assert salted.groupBy("k", "_salt").count().agg({"count": "max"}).first()[0] < 100
        joined = skew.attach(salted, values, sizes, how).drop("_salt").select("k", "i", "v")
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(
            map(tuple, rows.join(values, "k", how).select("k", "i", "v").collect()), key=str
        )


def test_large_groups_fit_their_list_and_none_is_left_out(spark, monkeypatch):
    frame = spark.range(10_000).selectExpr("if(id < 4000, 0, id % 100) AS k")
    sizes = skew.measure_groups(frame, "k", 10)
    assert sizes.rows_per_salt == 10 and sizes.large().count() == 100
    monkeypatch.setattr(skew, "LIST_BYTES", 5 * (2 + skew._ROW_BYTES))
    sizes = skew.measure_groups(frame, "k", 10)
    assert sizes.rows_per_salt == 2000 and [tuple(r) for r in sizes.large().collect()] == [(0, 3)]
    values = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    joined = skew.attach(skew.salt(frame.withColumn("i", F.monotonically_increasing_id()), sizes, F.col("i")), values, sizes)
    assert joined.count() == 10_000 and joined.where("v <> 2 * k").isEmpty()
