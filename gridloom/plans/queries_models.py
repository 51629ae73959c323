"""Forecasts, tests, forests and evaluation on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import evaluation as V
from gridloom.operators import forecasting as T
from gridloom.operators import forest as I
from gridloom.operators import windows as W
from gridloom.plans import pipelines
from gridloom.plans.queries_base import KEYS, ORDER
from gridloom.plans.queries_series import severity_of
from gridloom.plans.registry import HOURLY, READINGS, SPINE, query, rounded
from gridloom.session import cut_lineage
from gridloom.sources.tables import detections, readings

PARTS = f"""{HOURLY}, {SPINE}, p AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY meter_id) AS n FROM filled),
tr AS (SELECT * FROM p WHERE pos < floor(n * 0.8)), te AS (SELECT * FROM p WHERE pos >= floor(n * 0.8)),
mu AS (SELECT meter_id, avg(usage_kwh) AS mu, count(*) AS n_train FROM tr GROUP BY meter_id),
hm AS (SELECT meter_id, hour(ts) AS h, avg(usage_kwh) AS hmu FROM tr GROUP BY ALL),
pers AS (SELECT p.meter_id, p.ts, p.pos, p.n, usage_kwh, coalesce(lag(usage_kwh, 24) OVER (PARTITION BY p.meter_id ORDER BY ts), mu) AS guess FROM p JOIN mu ON p.meter_id = mu.meter_id),
f_pers AS (SELECT meter_id, ts, usage_kwh, guess FROM pers WHERE pos >= floor(n * 0.8)),
f_hour AS (SELECT te.meter_id, ts, usage_kwh, CASE WHEN n_train >= 48 THEN coalesce(hmu, mu) ELSE mu END AS guess FROM te JOIN mu ON te.meter_id = mu.meter_id LEFT JOIN hm ON hm.meter_id = te.meter_id AND hm.h = hour(ts))"""


def hourly(spark, sf_dir):
    return A.resample_filled(readings(spark, sf_dir), KEYS)


def parts(spark, sf_dir):
    return W.split_by_position(hourly(spark, sf_dir), KEYS, ["ts"], 0.8)


@query("persistence_forecast", f"WITH {READINGS}, {PARTS} SELECT meter_id, ts, round(usage_kwh, 6) AS usage_kwh, round(guess, 9) AS predicted FROM f_pers")
def persistence_forecast(spark, sf_dir):
    out = T.persistence_forecast(parts(spark, sf_dir), KEYS, ["ts"])
    return rounded(rounded(out, 6, "usage_kwh"), 9, "predicted").select("meter_id", "ts", "usage_kwh", "predicted")


@query("hour_mean_forecast", f"WITH {READINGS}, {PARTS} SELECT meter_id, ts, round(usage_kwh, 6) AS usage_kwh, round(guess, 9) AS predicted FROM f_hour")
def hour_mean_forecast(spark, sf_dir):
    out = T.hour_mean_forecast(parts(spark, sf_dir), KEYS)
    return rounded(rounded(out, 6, "usage_kwh"), 9, "predicted").select("meter_id", "ts", "usage_kwh", "predicted")


@query("leaderboard", f"""WITH {READINGS}, {PARTS}, a AS (SELECT 'hour_mean' AS model, * FROM f_hour UNION ALL SELECT 'persistence', * FROM f_pers),
e AS (SELECT meter_id, model, sqrt(avg((usage_kwh - guess) * (usage_kwh - guess))) AS rmse, avg(abs(usage_kwh - guess)) AS mae,
  avg(abs((usage_kwh - guess) / greatest(usage_kwh, 1))) * 100 AS mape, count(*) AS n FROM a GROUP BY ALL)
SELECT meter_id, model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape, n, row_number() OVER (PARTITION BY meter_id ORDER BY rmse, model) AS rank FROM e""")
def leaderboard(spark, sf_dir):
    out = T.leaderboard(hourly(spark, sf_dir), KEYS, ["ts"])
    return rounded(out, 6, "rmse", "mae", "mape").select("meter_id", "model", "rmse", "mae", "mape", "n", "rank")


@query("standard_scale", f"""WITH {READINGS}, s AS (SELECT meter_id, avg(usage_kwh) AS m, stddev_pop(usage_kwh) AS d FROM readings GROUP BY meter_id)
SELECT reading_id, round((usage_kwh - m) / d, 6) AS usage_kwh_z, usage_kwh AS usage_kwh_back FROM readings JOIN s USING (meter_id)""")
def standard_scale(spark, sf_dir):
    scaled = V.standard_scale(readings(spark, sf_dir).select("meter_id", "reading_id", "usage_kwh"), KEYS, ["usage_kwh"])
    out = rounded(rounded(V.unscale(scaled, ["usage_kwh"]), 6, "usage_kwh_z"), 4, "usage_kwh_back")
    return out.select("reading_id", "usage_kwh_z", "usage_kwh_back")


@query("mcnemar", """WITH c AS (SELECT toxic = quality AS a, doc_id % 2 = quality AS b FROM labels),
t AS (SELECT count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong FROM c)
SELECT *, round(power(abs(only_a - only_b) - 1, 2) / (only_a + only_b), 8) AS chi2 FROM t""")
def mcnemar(spark, sf_dir):
    return rounded(V.mcnemar(detections(spark, sf_dir)), 8, "chi2")


# p = erfc(sqrt(chi2 / 2)): twice the normal tail beyond z = sqrt(chi2), by Simpson's rule on [z, z + 12]
@query("mcnemar_p_value", """WITH c AS (SELECT toxic = quality AS a, doc_id % 2 = quality AS b FROM labels),
t AS (SELECT count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong FROM c),
x AS (SELECT *, power(abs(only_a - only_b) - 1, 2) / (only_a + only_b) AS chi2 FROM t),
g AS (SELECT both_right, only_a, only_b, both_wrong, chi2, i, sqrt(chi2) + i * 0.003::DOUBLE AS z,
        CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS k FROM x, range(0, 4001) r(i))
SELECT both_right, only_a, only_b, both_wrong, round(chi2, 8) AS chi2,
  round(2 * sum(k * exp(-z * z / 2)) * 0.003::DOUBLE / 3 / sqrt(2 * pi()), 9) AS p_value FROM g GROUP BY ALL""")
def mcnemar_p_value(spark, sf_dir):
    out = V.mcnemar_p_value(V.mcnemar(detections(spark, sf_dir)))
    return rounded(rounded(out, 8, "chi2"), 9, "p_value")


@query("bootstrap_far_difference")
def bootstrap(spark, sf_dir):
    return V.bootstrap_far_difference(detections(spark, sf_dir))


@query("prediction_interval_80", f"""WITH {READINGS}, s AS (SELECT meter_id, stddev_pop(usage_kwh - reactive_lagging_kvarh) AS d FROM readings GROUP BY meter_id)
SELECT reading_id, round(reactive_lagging_kvarh - 1.2816 * d, 6) AS lower, round(reactive_lagging_kvarh + 1.2816 * d, 6) AS upper FROM readings JOIN s USING (meter_id)""")
def prediction_interval_80(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "meter_id", "reading_id", F.col("usage_kwh").alias("actual"), F.col("reactive_lagging_kvarh").alias("predicted")
    )
    return rounded(V.prediction_interval(df, KEYS, z=V.Z_80), 6, "lower", "upper").select("reading_id", "lower", "upper")


@query("prediction_interval", f"""WITH {READINGS}, s AS (SELECT meter_id, stddev_pop(usage_kwh - reactive_lagging_kvarh) AS d FROM readings GROUP BY meter_id)
SELECT reading_id, round(reactive_lagging_kvarh - 1.96 * d, 6) AS lower, round(reactive_lagging_kvarh + 1.96 * d, 6) AS upper FROM readings JOIN s USING (meter_id)""")
def prediction_interval(spark, sf_dir):
    df = readings(spark, sf_dir).select(
        "meter_id", "reading_id", F.col("usage_kwh").alias("actual"), F.col("reactive_lagging_kvarh").alias("predicted")
    )
    return rounded(V.prediction_interval(df, KEYS), 6, "lower", "upper").select("reading_id", "lower", "upper")


def tune_sql(src: str) -> str:
    """Best of 64 smoothing settings over ``src`` (meter_id, ts, usage_kwh)."""
    return f"""tl AS (SELECT meter_id, usage_kwh AS v, row_number() OVER (PARTITION BY meter_id ORDER BY ts) - 1 AS t FROM {src}),
t0 AS (SELECT meter_id, avg(v) FILTER (WHERE t < 24) AS m1, avg(v) FILTER (WHERE t >= 24 AND t < 48) AS m2, list(v ORDER BY t) FILTER (WHERE t < 24) AS c1, count(*) AS n FROM tl GROUP BY meter_id),
g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS x),
ts AS (SELECT meter_id, 23::BIGINT AS t, ga.x AS a, gb.x AS b, gg.x AS g, m1 AS level, (m2 - m1) / 24 AS trend, list_transform(c1, lambda v: v - m1) AS season, 0.0::DOUBLE AS sse
    FROM t0 CROSS JOIN g ga CROSS JOIN g gb CROSS JOIN g gg
  UNION ALL SELECT meter_id, t, a, b, g, lv, b * (lv - level) + (1 - b) * trend,
    list_transform(season, lambda v, i: CASE WHEN i = t % 24 + 1 THEN g * (y - lv) + (1 - g) * v ELSE v END), sse + power(y - (level + trend + season[t % 24 + 1]), 2)
  FROM (SELECT s.meter_id, tl.t, a, b, g, level, trend, season, sse, tl.v AS y, a * (tl.v - season[tl.t % 24 + 1]) + (1 - a) * (level + trend) AS lv
        FROM ts s JOIN tl ON tl.meter_id = s.meter_id AND tl.t = s.t + 1)),
tuned AS (SELECT ts.meter_id, a AS alpha, b AS beta, g AS gamma, sse / (n - 24) AS mse FROM ts JOIN t0 ON t0.meter_id = ts.meter_id AND ts.t = n - 1
  QUALIFY row_number() OVER (PARTITION BY ts.meter_id ORDER BY sse, a, b, g) = 1)"""


@query("holt_winters", f"""WITH RECURSIVE {READINGS}, {PARTS}, {tune_sql('tr')},
z AS (SELECT meter_id, usage_kwh AS v, pos AS t FROM tr),
z0 AS (SELECT meter_id, avg(v) FILTER (WHERE t < 24) AS m1, avg(v) FILTER (WHERE t >= 24 AND t < 48) AS m2, list(v ORDER BY t) FILTER (WHERE t < 24) AS c1, count(*) AS n FROM z GROUP BY meter_id),
hw AS (SELECT z0.meter_id, (-1)::BIGINT AS t, alpha AS a, beta AS b, gamma AS g, m1 AS level, (m2 - m1) / 24 AS trend, list_transform(c1, lambda v: v - m1) AS season FROM z0 JOIN tuned ON tuned.meter_id = z0.meter_id
  UNION ALL SELECT meter_id, t, a, b, g, lv, b * (lv - level) + (1 - b) * trend, list_transform(season, lambda v, i: CASE WHEN i = t % 24 + 1 THEN g * (y - lv) + (1 - g) * v ELSE v END)
  FROM (SELECT h.meter_id, z.t, a, b, g, level, trend, season, z.v AS y, a * (z.v - season[z.t % 24 + 1]) + (1 - a) * (level + trend) AS lv FROM hw h JOIN z ON z.meter_id = h.meter_id AND z.t = h.t + 1))
SELECT hw.meter_id, step, round(greatest(0, level + (step + 1) * trend + season[(n + step) % 24 + 1]), 6) AS predicted
FROM hw JOIN z0 ON z0.meter_id = hw.meter_id AND hw.t = n - 1 CROSS JOIN (SELECT unnest(range(0, 48)) AS step) st""")
def holt_winters(spark, sf_dir):
    train = parts(spark, sf_dir).filter("part = 'train'")
    return rounded(T.holt_winters(train, KEYS, ["ts"], 48), 6, "predicted")


@query("holt_winters_tune", f"""WITH RECURSIVE {READINGS}, {HOURLY}, {SPINE}, {tune_sql('filled')}
SELECT meter_id, alpha, beta, gamma, round(mse, 6) AS mse FROM tuned""")
def holt_winters_tune(spark, sf_dir):
    return rounded(T.holt_winters_tune(hourly(spark, sf_dir), KEYS, ["ts"]), 6, "mse")


@query("adf_test")
def adf_test(spark, sf_dir):
    return rounded(T.adf(hourly(spark, sf_dir), KEYS, ["ts"]), 6, "t_stat")


@query("rf_forecast")
def rf_forecast(spark, sf_dir):
    """Random forest fitted on all meters, 48 hours ahead in two blocks."""
    out = pipelines.forecast(readings(spark, sf_dir), KEYS, horizon=48).filter("model = 'random_forest'")
    return rounded(out, 4, "predicted", "actual").select("meter_id", "ts", "step", "actual", "predicted")


@query("forecast")
def forecast(spark, sf_dir):
    out = pipelines.forecast_report(readings(spark, sf_dir), KEYS)
    return rounded(out, 4, "rmse", "mae", "mape", "backtest_rmse", "backtest_mae")


@query("backtest")
def backtest(spark, sf_dir):
    hours = cut_lineage(hourly(spark, sf_dir))
    return rounded(T.backtest(hours, KEYS, 3, 48), 4, "rmse", "mae", "mape")


@query("retrain")
def retrain(spark, sf_dir):
    df = readings(spark, sf_dir).select("meter_id", "reading_id", "ts", "usage_kwh")
    return rounded(pipelines.retrain(df, KEYS, ORDER), 4, "rmse")


@query("detect_anomalies")
def detect_anomalies(spark, sf_dir):
    out = pipelines.detect_anomalies(load_typed(spark, sf_dir))
    return out.select("meter_id", "reading_id", "ts", "usage_kwh", "anomaly_type", "severity", "explanation", "anomaly_score")


def load_typed(spark, sf_dir):
    from gridloom.operators.cleaning import calendar_features, classify_load

    rows = classify_load(readings(spark, sf_dir), KEYS)
    return calendar_features(rows).drop("hour", "weekday", "month", "is_weekend", "nsm")


RAW_FEATURES = ["usage_kwh", "reactive_lagging_kvarh", "power_factor_lagging"]


def digest_sql(*parts: str) -> str:
    """The number in [0, 1) that the forest draws for the parts."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT)::DOUBLE / 4503599627370496"


def path_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END"


def forest_sql(extended: bool, trees=100, sample=256, seed=42, features=tuple(RAW_FEATURES)) -> str:
    """``scored`` (reading_id, the features, score): sample, split and score once more, in one recursive query each."""
    d = len(features)
    x = f"[{', '.join(f'coalesce({f}, 0.0)::DOUBLE' for f in features)}]"
    ends = ", ".join(f"{side}(x[{i + 1}]) OVER node AS {side}{i}" for i in range(d) for side in ("min", "max"))
    lo, hi = (f"[{', '.join(f'{side}{i}' for i in range(d))}]" for side in ("min", "max"))
    leaf = f"depth >= steps OR size <= 1 OR NOT ({' OR '.join(f'max{i} > min{i}' for i in range(d))})"
    if extended:
        u = lambda i, j: digest_sql("tree", "place", str(i), str(j), str(seed))
        normal = ", ".join(f"sqrt(-2 * ln({u(i, 0)} + 1.0::DOUBLE / 4503599627370496)) * cos(2 * pi() * ({u(i, 1)}))" for i in range(d))
        point = ", ".join(f"min{i} + ({u(i, 2)}) * (max{i} - min{i})" for i in range(d))
        split = f"[{normal}] AS v, [{point}] AS p"
        left = " + ".join(f"(x[{i + 1}] - p[{i + 1}]) * v[{i + 1}]" for i in range(d)) + " < 0"
    else:
        opened = f"list_filter(range(1, {d + 1}), lambda i: ({hi})[i] > ({lo})[i])"
        f = f"({opened})[1 + floor(({digest_sql('tree', 'place', quoted('feature'), str(seed))}) * len({opened}))::INT]"
        split = f"[{f}::DOUBLE, ({hi})[{f}]] AS v, [({lo})[{f}] + ({digest_sql('tree', 'place', quoted('cut'), str(seed))}) * (({hi})[{f}] - ({lo})[{f}])] AS p"
        left = "(x[v[1]::INT] <= p[1] AND x[v[1]::INT] < v[2])"
    return f"""base AS MATERIALIZED (SELECT reading_id, {', '.join(features)}, {x} AS x FROM readings),
n AS (SELECT count(*) AS n, 2.0::DOUBLE * {sample} / count(*) AS rate, CASE WHEN 2.0 * {sample} / count(*) < 0.5 THEN ln(1.0 - 2.0::DOUBLE * {sample} / count(*)) END AS ln_miss FROM base),
hops AS (SELECT reading_id, 0 AS i, floor(ln({digest_sql('reading_id', '0', str(seed))} + 1.0::DOUBLE / 4503599627370496) / ln_miss)::BIGINT AS tree FROM base, n WHERE rate < 0.5
  UNION ALL SELECT reading_id, i + 1, tree + 1 + floor(ln({digest_sql('reading_id', 'i + 1', str(seed))} + 1.0::DOUBLE / 4503599627370496) / ln_miss)::BIGINT FROM hops, n WHERE tree < {trees}),
hits AS (SELECT reading_id, tree FROM hops WHERE tree < {trees} UNION ALL SELECT reading_id, t FROM base, n, range({trees}) r(t) WHERE rate >= 0.5),
drawn AS MATERIALIZED (SELECT tree, x, count(*) OVER (PARTITION BY tree) AS got FROM (
  SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY {digest_sql('reading_id', 'tree', str(seed + 1))}, reading_id) AS rn FROM hits JOIN base USING (reading_id)) WHERE rn <= {sample}),
grown AS (SELECT tree, 1::BIGINT AS place, x, 0 AS depth, ceil(log2(greatest(got, 2))) AS steps FROM drawn
  UNION ALL SELECT tree, 2 * place + CASE WHEN goes_left THEN 0 ELSE 1 END, x, depth + 1, steps FROM (
    SELECT *, {left} AS goes_left FROM (SELECT *, {split} FROM (
      SELECT tree, place, x, depth, steps, count(*) OVER node AS size, {ends} FROM grown WINDOW node AS (PARTITION BY tree, place)) WHERE NOT ({leaf})))
    {'QUALIFY count(*) FILTER (WHERE goes_left) OVER (PARTITION BY tree, place) BETWEEN 1 AND size - 1' if extended else ''}),
sized AS (SELECT tree, place, x, depth, steps, count(*) OVER node AS size, {ends} FROM grown WINDOW node AS (PARTITION BY tree, place)),
nodes AS (SELECT DISTINCT tree, place, depth, steps, size, {split}, {leaf} AS ended FROM (SELECT DISTINCT tree, place, depth, steps, size, {', '.join(f'min{i}, max{i}' for i in range(d))} FROM sized)),
tree_nodes AS MATERIALIZED (SELECT a.*, b.place IS NULL AS leaf FROM nodes a LEFT JOIN nodes b ON b.tree = a.tree AND b.place = 2 * a.place),
walk AS (SELECT reading_id, x, t.tree::BIGINT AS tree, 1::BIGINT AS place, false AS done, 0.0::DOUBLE AS length FROM base, (SELECT DISTINCT tree FROM drawn) t
  UNION ALL SELECT reading_id, x, w.tree, CASE WHEN leaf THEN w.place ELSE 2 * w.place + CASE WHEN {left} THEN 0 ELSE 1 END END, leaf, CASE WHEN leaf THEN depth + {path_sql('size')} ELSE 0 END
  FROM walk w JOIN tree_nodes t ON t.tree = w.tree AND t.place = w.place WHERE NOT done),
fitted AS (SELECT {f'max({sample})' if extended else f'least({sample}, max(size))'} AS m FROM tree_nodes WHERE place = 1),
scored AS MATERIALIZED (SELECT b.*, s.score FROM base b JOIN (SELECT reading_id, round(power(2.0::DOUBLE, -avg(length) / (SELECT {path_sql('m')} FROM fitted)), 9) AS score FROM walk WHERE done GROUP BY reading_id) s USING (reading_id))"""


def quoted(text: str) -> str:
    return f"'{text}'"


def flagged_sql(extended: bool, rate: float, compare: str) -> str:
    return f"""WITH RECURSIVE {READINGS}, {forest_sql(extended)}, cut AS (SELECT quantile_cont(score, {1 - rate}) AS cutoff FROM scored)
SELECT reading_id, score, round(cutoff - score, 6) AS anomaly_score, score {compare} cutoff AS is_outlier FROM scored, cut"""


def _scored(spark, sf_dir, extended=False):
    """Scores are rounded far below their last meaning digit, so that equal paths give equal scores anywhere."""
    df = readings(spark, sf_dir).fillna(0.0, ["reactive_lagging_kvarh", "power_factor_lagging"]).select("meter_id", "reading_id", *RAW_FEATURES)
    nodes = I.fit(df, RAW_FEATURES, ["reading_id"], extended=extended)
    return rounded(I.score(df, nodes, RAW_FEATURES, extended=extended), 9, "score")


@query("isolation_forest", flagged_sql(False, 0.0247, ">"))
def isolation_forest(spark, sf_dir):
    out = I.flag(cut_lineage(_scored(spark, sf_dir)), 0.0247)
    return out.select("reading_id", "score", "anomaly_score", "is_outlier")


@query("extended_isolation_forest", flagged_sql(True, 0.0247, ">="))
def extended_isolation_forest(spark, sf_dir):
    out = I.flag(cut_lineage(_scored(spark, sf_dir, True)), 0.0247, inclusive=True)
    return out.select("reading_id", "score", "anomaly_score", "is_outlier")


@query("contamination_sweep", f"""WITH RECURSIVE {READINGS}, {forest_sql(False)},
cuts AS (SELECT unnest([0.005, 0.01, 0.02, 0.05]::DOUBLE[]) AS rate, unnest(quantile_cont(score, [0.995, 0.99, 0.98, 0.95])) AS cutoff FROM scored),
t AS (SELECT rate, count(*) FILTER (WHERE score > cutoff) AS flagged, count(*) FILTER (WHERE score > cutoff AND usage_kwh > 250) AS tp,
  count(*) FILTER (WHERE score > cutoff AND NOT usage_kwh > 250) AS fp, count(*) FILTER (WHERE usage_kwh > 250) AS hot FROM scored, cuts GROUP BY rate),
m AS (SELECT *, CASE WHEN flagged > 0 THEN tp / flagged ELSE 0 END AS p, CASE WHEN hot > 0 THEN tp / hot ELSE 0 END AS r, CASE WHEN flagged > 0 THEN fp / flagged ELSE 0 END AS f FROM t)
SELECT rate, flagged, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS far, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def contamination_sweep(spark, sf_dir):
    scored = cut_lineage(_scored(spark, sf_dir))
    labelled = scored.withColumn("y_true", (severity_of(F.col("usage_kwh")) == "Critical").cast("int"))
    return rounded(I.contamination_sweep(labelled, [0.005, 0.01, 0.02, 0.05]), 6, "precision", "recall", "far", "f1")
