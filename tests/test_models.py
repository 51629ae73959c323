"""Forecasts, tests and forests against straight loops and injected faults."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.robust import median_and_mad
from gridloom.operators import evaluation, forecasting, forest
from gridloom.operators.windows import rolling_origin_folds
from gridloom.plans import pipelines

KEYS = ["meter_id"]


def hourly_frame(n, seed=1, meter="a"):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return pd.DataFrame({
        "meter_id": meter, "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
        "usage_kwh": np.maximum(1.0, 100 + 20 * np.sin(t * 2 * np.pi / 24) + rng.normal(0, 5, n)),
        "temp": 20 + 5 * np.cos(t * 2 * np.pi / 24),
    })


@pytest.fixture(scope="module")
def hours(spark):
    pdf = pd.concat([hourly_frame(400), hourly_frame(300, 2, "b")], ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=0)).cache()


def smoothing_loop(y, a, b, g, m, start, level, trend, season, h=0):
    sse = 0.0
    season = list(season)
    for t in range(start, len(y)):
        i = t % m
        sse += (y[t] - (level + trend + season[i])) ** 2
        old, level = level, a * (y[t] - season[i]) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[i] = g * (y[t] - level) + (1 - g) * season[i]
    return [max(0.0, level + (j + 1) * trend + season[(len(y) + j) % m]) for j in range(h)], sse


def start_state(y, m):
    level = np.mean(y[:m])
    return level, (np.mean(y[m : 2 * m]) - level) / m, [v - level for v in y[:m]]


def tune_loop(y, m=24):
    grid = [0.1, 0.3, 0.5, 0.7]
    errors = {
        (a, b, g): smoothing_loop(y, a, b, g, m, m, *start_state(y, m))[1] for a in grid for b in grid for g in grid
    }
    return min(errors, key=errors.get)


def test_holt_winters_and_tuning(hours):
    pdf, df = hours
    tuned = {r.meter_id: (r.alpha, r.beta, r.gamma) for r in forecasting.holt_winters_tune(df, KEYS, ["ts"]).collect()}
    ahead = forecasting.holt_winters(df, KEYS, ["ts"], 50).toPandas()
    for meter, g in pdf.groupby("meter_id"):
        y = g.sort_values("ts")["usage_kwh"].tolist()
        assert tuned[meter] == tune_loop(y)
        want = smoothing_loop(y, *tune_loop(y), 24, 0, *start_state(y, 24), h=50)[0]
        np.testing.assert_allclose(ahead[ahead.meter_id == meter].sort_values("step")["predicted"], want)


def test_short_series_use_default_smoothing(spark):
    df = spark.createDataFrame(hourly_frame(30))
    row = forecasting.holt_winters_tune(df, KEYS, ["ts"]).first()
    assert (row.alpha, row.beta, row.gamma) == (0.3, 0.1, 0.2) and row.mse is None


def adf_loop(y):
    best = None
    n, dy = len(y), np.diff(y)
    for lag in (c for c in (4, 12, 24, 48, 96, 168) if n > c + 20 and n - 1 - c > c + 3):
        x = np.array([[1.0, t, y[t]] + [dy[t - i] for i in range(1, lag + 1)] for t in range(lag, n - 1)])
        z = dy[lag:]
        beta = np.linalg.lstsq(x, z, rcond=None)[0]
        sse = ((z - x @ beta) ** 2).sum()
        aic = len(z) * np.log(max(1e-10, sse / len(z))) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            s2 = sse / (len(z) - x.shape[1])
            best = (aic, lag, beta[2] / np.sqrt(np.linalg.inv(x.T @ x)[2, 2] * s2))
    return best[1:]


def test_adf(spark):
    rng = np.random.default_rng(5)
    walk = pd.DataFrame({"meter_id": "walk", "ts": pd.date_range("2024-01-01", periods=260, freq="h"), "usage_kwh": rng.normal(0, 1, 260).cumsum()})
    noise = walk.assign(meter_id="noise", usage_kwh=rng.normal(0, 1, 260))
    got = {r.meter_id: r for r in forecasting.adf(spark.createDataFrame(pd.concat([walk, noise])), KEYS, ["ts"]).collect()}
    for name, frame in (("walk", walk), ("noise", noise)):
        lag, stat = adf_loop(frame["usage_kwh"].to_numpy())
        assert got[name].lag == lag
        assert got[name].t_stat == pytest.approx(stat, rel=1e-6)
    assert got["noise"].is_stationary and not got["walk"].is_stationary


@pytest.mark.parametrize("horizon", [24, 25, 48, 49])
def test_block_recursion_equals_stepwise(spark, hours, horizon):
    """One prediction per step, fed back, must equal the blocks of 24."""
    pdf, df = hours
    feats = forecasting.temporal_features(df, KEYS)
    model = forecasting.rf_fit(feats, trees=5, depth=5)
    last = pdf.groupby("meter_id")["ts"].max()
    future = pd.concat([
        pd.DataFrame({"meter_id": m, "ts": pd.date_range(t + pd.Timedelta("1h"), periods=horizon, freq="h"), "step": np.arange(horizon), "temp": 21.0})
        for m, t in last.items()
    ])
    got = forecasting.rf_forecast(model, df, spark.createDataFrame(future), KEYS, horizon).toPandas()

    from pyspark.ml.linalg import Vectors

    for meter, g in pdf.groupby("meter_id"):
        history = g.sort_values("ts")["usage_kwh"].tolist()
        for _, row in future[future.meter_id == meter].iterrows():
            t = row["ts"]
            x = [t.hour, t.dayofweek, t.month, int(t.dayofweek >= 5), history[-24], history[-168], 21.0]
            history.append(max(0.0, model.predict(Vectors.dense(x))))
        mine = got[got.meter_id == meter].sort_values("step")["predicted"]
        np.testing.assert_allclose(mine, history[-horizon:])


def test_folds_follow_the_rule(hours):
    pdf, df = hours
    got = rolling_origin_folds(df, KEYS, ["ts"], folds=3, horizon=10).groupBy("meter_id", "fold").agg(
        F.first("origin").alias("origin"), F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "validate").alias("validate")
    ).collect()
    for r in got:
        n = int((pdf.meter_id == r.meter_id).sum())
        held = int(n * 0.15)
        assert r.origin == n - held + r.fold * (held // 3) == r.train
        assert r.validate == 10


def test_exact_median_with_hot_value_and_key(spark):
    rng = np.random.default_rng(2)
    hot = np.concatenate([np.full(4000, 7.0), rng.lognormal(1, 2, 5001)])
    pdf = pd.concat([
        pd.DataFrame({"k": "hot", "v": hot}), pd.DataFrame({"k": "two", "v": [1.0, 4.0]}),
        pd.DataFrame({"k": "one", "v": [3.0]}), pd.DataFrame({"k": "wide", "v": np.r_[rng.normal(0, 1, 2000), 1e12, -1e12]}),
    ])
    got = {r.k: r for r in median_and_mad(spark.createDataFrame(pdf).repartition(6), ["k"], ["v"]).collect()}
    for k, g in pdf.groupby("k"):
        med = g["v"].median()
        assert got[k].median == pytest.approx(med, rel=1e-12)
        assert got[k].mad == pytest.approx((g["v"] - med).abs().median(), rel=1e-12, abs=1e-12)


def meter_frame(n=400):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({
        "meter_id": "a", "reading_id": np.arange(n), "ts": pd.date_range("2024-01-01", periods=n, freq="15min"),
        "usage_kwh": rng.uniform(50, 150, n), "reactive_lagging_kvarh": rng.uniform(10, 40, n),
        "reactive_leading_kvarh": rng.uniform(5, 20, n), "power_factor_lagging": rng.uniform(75, 95, n),
        "load_type": "Medium_Load", "week_status": "Weekday", "day_of_week": "Monday",
    })
    pdf.loc[10, "usage_kwh"] = 900.0
    return pdf


def test_injected_spike_is_found_and_named(spark):
    out = pipelines.detect_anomalies(spark.createDataFrame(meter_frame())).toPandas()
    assert 1 <= len(out) <= 17
    spike = out[out.reading_id == 10]
    assert spike["anomaly_type"].tolist() == ["Critical Power Spike"] and spike["severity"].tolist() == ["Critical"]
    assert (out["anomaly_score"] < 0).all()


@pytest.mark.parametrize("extended", [False, True])
def test_forest_does_not_depend_on_partitions(spark, extended):
    df = spark.createDataFrame(meter_frame())
    cols = ["usage_kwh", "reactive_lagging_kvarh"]

    def scores(frame):
        nodes = forest.fit(frame, cols, ["reading_id"], trees=20, extended=extended)
        return forest.score(frame, nodes, cols, extended=extended).select("reading_id", "score").toPandas().set_index("reading_id")["score"]

    a, b = scores(df.coalesce(1)).sort_index(), scores(df.repartition(9)).sort_index()
    pd.testing.assert_series_equal(a, b)
    assert a.idxmax() == 10


def test_forest_score_equals_path_walk(spark):
    """Scores from the node table by walking it row by row."""
    pdf = meter_frame(60)
    cols = ["usage_kwh", "reactive_lagging_kvarh"]
    df = spark.createDataFrame(pdf)
    nodes_df = forest.fit(df, cols, ["reading_id"], trees=8, sample=32)
    got = forest.score(df, nodes_df, cols, sample=32).toPandas().set_index("reading_id")["score"]
    nodes = {(r.tree, r.node): r for r in nodes_df.collect()}
    c = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    assert {n.size for (t, i), n in nodes.items() if i == 0} == {32}
    for _, row in pdf.iterrows():
        paths = []
        for tree in range(8):
            at = nodes[tree, 0]
            while at.left >= 0:
                at = nodes[tree, at.left if row[cols[at.feature]] <= at.cut else at.right]
            paths.append(at.depth + c(at.size))
        assert got[row["reading_id"]] == pytest.approx(2 ** (-np.mean(paths) / c(32)), abs=1e-6)


@pytest.mark.parametrize("rates", [[0.01, 0.05, 0.2]])
def test_cutoffs_are_exact_percentiles(spark, rates):
    values = np.round(np.random.default_rng(0).uniform(0.3, 0.8, 1003), 6)
    df = spark.createDataFrame(pd.DataFrame({"score": values}))
    got = {r.rate: r.cutoff for r in forest.score_cutoffs(df, rates).collect()}
    for rate in rates:
        assert got[rate] == pytest.approx(np.percentile(values, 100 * (1 - rate)))


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"y_true": rng.integers(0, 2, 800), "pred_a": rng.integers(0, 2, 800), "pred_b": rng.integers(0, 2, 800)})
    row = evaluation.bootstrap_far_difference(spark.createDataFrame(pdf), draws=2000).first()
    diffs = []
    for _ in range(2000):
        s = pdf.iloc[rng.integers(0, 800, 800)]
        far = lambda p: ((s[p] == 1) & (s.y_true == 0)).sum() / max((s[p] == 1).sum(), 1)
        diffs.append(far("pred_b") - far("pred_a"))
    assert row.mean_diff == pytest.approx(np.mean(diffs), abs=0.005)
    assert row.lower == pytest.approx(np.percentile(diffs, 2.5), abs=0.01)
    assert row.upper == pytest.approx(np.percentile(diffs, 97.5), abs=0.01)


def test_retrain_rejects_short_and_accepts_long(spark):
    pdf = pd.concat([hourly_frame(200), hourly_frame(20, 3, "short")])
    got = {r.meter_id: r for r in pipelines.retrain(spark.createDataFrame(pdf)).collect()}
    assert got["short"].status == "error" and got["short"].reason == "enough_rows"
    assert got["a"].status == "success" and got["a"].rows_processed == 200 and got["a"].best_model in ("hour_mean", "persistence")


def test_forecast_long_table(spark):
    out = pipelines.forecast(spark.createDataFrame(hourly_frame(400)), horizon=24)
    counts = {r.model: r["count"] for r in out.groupBy("model").count().collect()}
    assert counts == {"persistence": 24, "holt_winters": 24, "random_forest": 24}
    assert pipelines.forecast_summary(out).filter("is_best").count() == 1


@pytest.mark.parametrize("n", [100, 1_000, 50_000])
def test_trees_draw_from_the_whole_table(spark, n):
    df = spark.range(n).withColumnRenamed("id", "reading_id")
    drawn = forest.sample_per_tree(df, ["reading_id"], trees=100, sample=256, seed=1).toPandas()
    sizes = drawn.groupby("tree")["reading_id"].agg(["size", "nunique"])
    assert len(sizes) == 100 and (sizes == min(n, 256)).all().all()
    seen = drawn["reading_id"].nunique() / n
    assert seen > (0.99 if n <= 1_000 else 0.38)  # 25 600 draws meet 40 % of 50 000 rows
    halves = (drawn["reading_id"] < n // 2).mean()
    assert abs(halves - 0.5) < 0.02
    assert not drawn.groupby("tree")["reading_id"].apply(frozenset).duplicated().any() or n <= 256


def test_each_meter_is_forecast_on_its_own_level(spark):
    low, high = hourly_frame(400, 5, "low"), hourly_frame(400, 6, "high")
    high["usage_kwh"] = high["usage_kwh"] * 50 + 10_000
    out = pipelines.forecast(spark.createDataFrame(pd.concat([low, high])), horizon=24).filter("model = 'random_forest'").toPandas()
    for meter, frame in (("low", low), ("high", high)):
        mine = out[out.meter_id == meter]
        assert np.abs(mine["predicted"] - mine["actual"]).mean() < 0.6 * frame["usage_kwh"].std()


def test_report_adds_unit_root_and_backtest(spark):
    got = pipelines.forecast_report(spark.createDataFrame(hourly_frame(400)), horizon=24, folds=2).toPandas()
    assert set(got["model"]) == {"persistence", "holt_winters", "random_forest"}
    assert got["adf_p"].notna().all() and got["backtest_rmse"].notna().all() and got["is_best"].sum() == 1


def test_a_few_large_groups_are_not_shuffled_by_their_key(spark):
    """Statistics of a group are joined by measured size, though the estimate of their input is large."""
    from gridloom.functions.robust import median_and_mad
    from gridloom.operators.cleaning import classify_load, mean_impute
    from gridloom.operators.emissions import power_quality_proxy
    from gridloom.operators.evaluation import standard_scale

    df = spark.range(1_000, numPartitions=4).selectExpr(
        "concat('m', id % 2) AS meter_id", "id AS reading_id", "double(id % 77) AS usage_kwh", "double(id % 5) AS reactive_lagging_kvarh"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "9000")  # the table is larger, its statistics are not
    try:
        for out in (
            standard_scale(df, ["meter_id"], ["usage_kwh"]), classify_load(df, ["meter_id"]),
            mean_impute(df, ["meter_id"], ["usage_kwh"]), power_quality_proxy(df, ["meter_id"]),
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {r.meter_id: (r.n, r["median"], r.mad) for r in median_and_mad(df, ["meter_id"], ["usage_kwh"]).collect()}
    pdf = df.toPandas().groupby("meter_id")["usage_kwh"]
    assert got == {k: (len(v), v.median(), (v - v.median()).abs().median()) for k, v in pdf}


def test_rows_draw_no_more_once_they_are_past_the_last_tree(spark):
    """Draws of a row end with its hits: the sample of a tree is what hops to the end would give."""
    from gridloom.operators import forest

    df = spark.range(3_000).withColumnRenamed("id", "reading_id").withColumn("x", F.col("reading_id") % 91)
    got = {}
    for r in forest.sample_per_tree(df, ["reading_id"], 20, 16, 5).collect():
        got.setdefault(r.tree, set()).add(r.reading_id)
    rate, want = 2.0 * 16 / 3_000, {}
    for i in range(3_000):
        at, hop = -1, 0
        while True:
            at += 1 + math.floor(math.log(forest.draw(i, hop, 5) + 2.0**-52) / math.log(1.0 - rate))
            if at >= 20:
                break
            want.setdefault(at, []).append((forest.draw(i, at, 6), i))
            hop += 1
    assert got == {t: {i for _, i in sorted(v)[:16]} for t, v in want.items()}
