"""Chunked series operators and recurrences: equal to straight loops for any chunk size
and partition count, and with one key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates, recurrences, windows
from gridloom.operators.ranking import recent_rows
from gridloom.operators.series import chunk_rows, with_position

KEYS, ORDER = ["meter_id"], ["ts", "reading_id"]


@pytest.fixture(scope="module")
def series(spark):
    """A hot meter with equal time stamps among its rows, a short one and one of a single row."""
    rng = np.random.default_rng(7)
    frames = []
    for meter, n in (("hot", 3000), ("short", 30), ("one", 1)):
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 86400, n)) // 600 * 600, unit="s")
        drift = np.where(np.arange(n) > n * 0.6, 25.0, 0.0)
        frames.append(pd.DataFrame({
            "meter_id": meter, "reading_id": np.arange(n), "ts": ts,
            "usage_kwh": np.round(rng.gamma(2.0, 30.0, n) + drift, 2), "temp": np.round(rng.uniform(5, 40, n), 1),
        }))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1.0, random_state=1)).cache()


def ordered(df):
    return df.toPandas().sort_values(["meter_id", "ts", "reading_id"]).reset_index(drop=True)


def groups(pdf, make):
    pdf = pdf.sort_values(["meter_id", "ts", "reading_id"])
    return np.concatenate([make(g) for _, g in pdf.groupby("meter_id", sort=True)])


SIZES = pytest.mark.parametrize("target", [200, 50_000])


@SIZES
def test_position_and_chunk_bounds(series, target):
    pdf, df = series
    got = ordered(with_position(df, KEYS, ORDER, target=target))
    assert (got["_pos"] == groups(pdf, lambda g: np.arange(len(g)))).all()
    assert (got["_n"] == groups(pdf, lambda g: np.full(len(g), len(g)))).all()
    assert got.groupby(["meter_id", "_chunk"]).size().max() <= 2 * target


@pytest.mark.parametrize("halo", [1, 24, 168, 200])
def test_halo_reaches_back_exactly(series, halo):
    pdf, df = series
    got = ordered(windows.lags(df, KEYS, ORDER, "usage_kwh", {"back": halo}, target=200))
    want = pdf.sort_values(["meter_id", "ts", "reading_id"]).groupby("meter_id")["usage_kwh"].shift(halo)
    np.testing.assert_allclose(got["back"], want)
    assert len(got) == len(pdf)


def test_halo_must_fit_a_chunk(series):
    with pytest.raises(ValueError):
        chunk_rows(series[1], KEYS, ORDER, halo=300, target=200)


@pytest.fixture(scope="module")
def crowded(spark):
    """One meter with 400 000 rows in one hour, a tenth of them at one instant, and a thin one."""
    hour = F.to_timestamp(F.lit("2024-01-05 10:00:00"))
    spread = F.pmod(F.xxhash64("id"), F.lit(3_600_000_000))
    at = F.when(F.col("id") % 10 == 0, F.lit(1_800_000_000)).otherwise(spread)
    hot = spark.range(400_000).select(
        F.lit("hot").alias("meter_id"), F.col("id").alias("reading_id"),
        F.timestamp_micros(F.unix_micros(hour) + at).alias("ts"), (F.col("id") % 97).cast("double").alias("usage_kwh"),
    )
    thin = spark.range(50).select(
        F.lit("thin").alias("meter_id"), "id", F.timestamp_seconds(F.unix_seconds(hour) + F.col("id") * 86_400), F.lit(1.0)
    )
    return hot.union(thin).repartition(8).cache()


def test_crowded_hour_is_cut_and_halo_is_exact(crowded):
    target, halo = 5_000, 24
    sizes = chunk_rows(crowded, KEYS, ORDER, halo=halo, target=target).groupBy("meter_id", "_chunk").agg(
        F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("copied"), F.min("_start").alias("start")
    ).toPandas()
    assert sizes["own"].max() <= 2 * target and sizes["own"].min() > 0 and sizes["own"].sum() == 400_050
    hot = sizes[sizes["meter_id"] == "hot"]
    assert len(hot) >= 40 and hot["copied"].max() == halo and (hot["copied"] > 0).sum() == len(hot) - 1
    assert sizes[sizes["meter_id"] == "thin"]["copied"].sum() == 0


def test_crowded_hour_matches_straight_loops(crowded):
    got = ordered(windows.lags(crowded, KEYS, ORDER, "usage_kwh", {"back": 24}, target=5_000))
    np.testing.assert_allclose(got["back"], got.groupby("meter_id")["usage_kwh"].shift(24))
    assert len(got) == 400_050
    places = ordered(with_position(crowded, KEYS, ORDER, target=5_000))
    assert (places["_pos"] == places.groupby("meter_id").cumcount()).all()
    smooth = ordered(recurrences.ewma(crowded, KEYS, ORDER, "usage_kwh", target=5_000))
    want = groups(smooth, lambda g: g["usage_kwh"].ewm(alpha=0.2, adjust=False).mean().to_numpy())
    np.testing.assert_allclose(smooth["ewma"], want, rtol=1e-10)


@SIZES
def test_rolling(series, target):
    pdf, df = series
    got = ordered(windows.rolling(df, KEYS, ORDER, "usage_kwh", {"m": (16, "mean"), "s": (16, "std")}, target=target))
    roll = lambda f: groups(pdf, lambda g: f(g["usage_kwh"].rolling(16, min_periods=1)))
    np.testing.assert_allclose(got["m"], roll(lambda r: r.mean()))
    np.testing.assert_allclose(got["s"], roll(lambda r: r.std().fillna(0.0)), atol=1e-6)


@SIZES
def test_interpolation_over_chunk_borders(series, target):
    pdf, df = series
    gap = (pdf["reading_id"] % 1000 > 300) & (pdf["reading_id"] % 1000 < 900) | (pdf["reading_id"] < 5)
    marked = F.when(~((F.col("reading_id") % 1000 > 300) & (F.col("reading_id") % 1000 < 900) | (F.col("reading_id") < 5)), F.col("usage_kwh"))
    got = ordered(windows.interpolate_linear(df.withColumn("usage_kwh", marked), KEYS, ORDER, "usage_kwh", target=target))
    with_gaps = pdf.assign(usage_kwh=pdf["usage_kwh"].where(~gap))
    want = groups(with_gaps, lambda g: g["usage_kwh"].interpolate("linear").bfill().to_numpy())
    np.testing.assert_allclose(got["usage_kwh"], want)


@SIZES
@pytest.mark.parametrize("alpha", [0.2, 0.01])
def test_ewma(series, target, alpha):
    pdf, df = series
    got = ordered(recurrences.ewma(df, KEYS, ORDER, "usage_kwh", alpha=alpha, target=target))
    want = groups(pdf, lambda g: g["usage_kwh"].ewm(alpha=alpha, adjust=False).mean().to_numpy())
    np.testing.assert_allclose(got["ewma"], want, rtol=1e-10)


def test_ewma_goes_on_from_a_seed(series):
    pdf, df = series
    got = ordered(recurrences.ewma(df.withColumn("s0", F.lit(50.0)), KEYS, ORDER, "usage_kwh", seed="s0", target=200))

    def loop(g):
        s, out = 50.0, []
        for x in g["usage_kwh"]:
            s = 0.8 * s + 0.2 * x
            out.append(s)
        return np.array(out)

    np.testing.assert_allclose(got["ewma"], groups(pdf, loop), rtol=1e-10)


@SIZES
def test_thermal_state(series, target):
    pdf, df = series

    def loop(g):
        h, out = 150.0, []
        for p, amb in zip(g["usage_kwh"], g["temp"]):
            out.append(h)
            h = max(amb, h + 0.05 * p - 0.002 * (h - amb))
        return np.array(out)

    got = ordered(recurrences.thermal_state(df, KEYS, ORDER, target=target))
    np.testing.assert_allclose(got["thermal_state_c"], groups(pdf, loop), rtol=1e-10)


def cusum_loop(g, allowance, threshold):
    x = g["usage_kwh"].to_numpy()
    sd = x.std() or 1.0
    p = n = 0.0
    out = []
    for v in x:
        p = max(0.0, p + v - x.mean() - allowance * sd)
        n = max(0.0, n - (v - x.mean()) - allowance * sd)
        hit = p > threshold * sd or n > threshold * sd
        kind = ("Upper" if p > threshold * sd else "Lower") if hit else None
        level = ("Critical" if max(p, n) > 1.5 * threshold * sd else "Warning") if hit else None
        out.append((p, n, kind, level))
        if hit:
            p = n = 0.0
    return out


@pytest.mark.parametrize("target", [200, 50_000])
@pytest.mark.parametrize("allowance,threshold", [(0.5, 5.0), (0.0, 3.0), (0.2, 60.0), (1.0, 0.5)])
def test_cusum(series, target, allowance, threshold):
    pdf, df = series
    got = ordered(recurrences.cusum(df, KEYS, ORDER, allowance=allowance, threshold=threshold, target=target))
    want = []
    for _, g in pdf.sort_values(["meter_id", "ts", "reading_id"]).groupby("meter_id", sort=True):
        want += cusum_loop(g, allowance, threshold)
    np.testing.assert_allclose(got["cusum_pos"], [w[0] for w in want], atol=1e-6)
    np.testing.assert_allclose(got["cusum_neg"], [w[1] for w in want], atol=1e-6)
    assert [v if isinstance(v, str) else None for v in got["drift"]] == [w[2] for w in want]
    assert [v if isinstance(v, str) else None for v in got["drift_severity"]] == [w[3] for w in want]


def test_result_does_not_depend_on_partitions(series):
    _, df = series
    one = ordered(recurrences.cusum(df.coalesce(1), KEYS, ORDER, target=200))
    many = ordered(recurrences.cusum(df.repartition(13), KEYS, ORDER, target=200))
    pd.testing.assert_frame_equal(one, many)


def test_recent_rows_large_n(series):
    pdf, df = series
    got = recent_rows(df, KEYS, ORDER, 1500).groupBy("meter_id").agg(F.count("*").alias("n"), F.min("reading_id").alias("lo")).collect()
    want = pdf.sort_values(["meter_id", "ts", "reading_id"]).groupby("meter_id").tail(1500).groupby("meter_id")["reading_id"].agg(["size", "min"])
    assert {r.meter_id: (r.n, r.lo) for r in got} == {m: (r["size"], r["min"]) for m, r in want.iterrows()}


def test_gap_fill(spark):
    pdf = pd.DataFrame({"meter_id": "a", "ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 03:20", "2024-01-01 03:40"]), "usage_kwh": [None, 4.0, 8.0]})
    rows = aggregates.resample_filled(spark.createDataFrame(pdf, "meter_id string, ts timestamp, usage_kwh double"), KEYS).orderBy("ts").collect()
    assert [r.usage_kwh for r in rows] == [6.0, 6.0, 6.0, 6.0]


def dispatch_loop(load, sun, cap):
    soc, limit, out = cap * 0.5, cap * 0.5 * 0.25, []
    for x, s in zip(load, sun):
        net = x - s
        if net <= 0:
            e = min(-net, limit, cap - soc) if cap > 0 else 0.0
            if e > 0:
                soc += e * min(max(0.98 - 0.05 * (e / 0.25 / cap) ** 2, 0.70), 0.98)
            out.append((0.0, s + net + max(e, 0.0), soc))
        else:
            e = min(net, limit) if cap > 0 else 0.0
            if e > 0:
                eta = min(max(0.98 - 0.05 * (e / 0.25 / cap) ** 2, 0.70), 0.98)
                e = min(e, soc * eta)
                soc -= e / eta
            out.append((net - e, s, soc))
    return np.array(out)


@pytest.mark.parametrize("cap", [0.0, 50.0, 400.0])
def test_battery_dispatch(spark, cap):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({
        "meter_id": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "usage_kwh": rng.uniform(0, 60, n),
        "solar_kwh": rng.uniform(0, 60, n), "solar_kw": 100.0, "battery_kwh": cap,
    })
    got = recurrences.battery_dispatch(spark.createDataFrame(pdf), KEYS).toPandas().sort_values("ts")
    want = dispatch_loop(pdf["usage_kwh"], pdf["solar_kwh"], cap)
    np.testing.assert_allclose(got[["grid_draw", "solar_used", "soc_kwh"]].to_numpy(), want, atol=1e-9)
    assert (got["soc_kwh"] <= cap + 1e-9).all() and (got["grid_draw"] >= 0).all()
