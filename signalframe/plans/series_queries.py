"""Queries over sensor series."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.operators import series
from signalframe.operators.blocks import cumulative, moving_window, neighbours
from signalframe.plans.adapters import SIGNALS, signals
from signalframe.plans.point_queries import rounded

STEP = 6.0  # hours
GRID = f"""steps AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM signals WINDOW w AS (PARTITION BY source_id, axis ORDER BY idx)),
grid AS (SELECT source_id, axis, k, k * {STEP}::DOUBLE AS t, value + (k * {STEP}::DOUBLE - t) / (t2 - t) * (v2 - value) AS value
  FROM (SELECT *, unnest(range(ceil(t / {STEP})::BIGINT, ceil(t2 / {STEP})::BIGINT)) AS k FROM steps WHERE t2 > t))"""
PAIRS = """pairs AS (SELECT source_id, k, l.value AS a, r.value AS b FROM (SELECT * FROM grid WHERE axis = 'click') l JOIN (SELECT * FROM grid WHERE axis = 'view') r USING (source_id, k))"""
W = "WINDOW w AS (PARTITION BY source_id, axis ORDER BY idx)"


def select(df, *columns, digits=5):
    return rounded(df.select(*columns), digits)


def grid(spark, sf):
    return series.resampled(signals(spark, sf), STEP)


def pairs(spark, sf):
    return series.paired(grid(spark, sf), "click", "view")


def series_differences(spark, sf):
    return select(series.differences(series.clean(signals(spark, sf))), "source_id", "axis", "idx", "dt", "dv")


def series_rates(spark, sf):
    return rounded(series.rates(signals(spark, sf)), 5)


def series_relative_time(spark, sf):
    return select(series.relative_time(signals(spark, sf)), "source_id", "axis", "idx", "t")


def series_gradient(spark, sf):
    return select(series.gradient(series.clean(signals(spark, sf))), "source_id", "axis", "idx", "slope", digits=3)


def series_moving_average(spark, sf):
    rows = moving_window(signals(spark, sf), series.KEYS, "idx", 2, 2, {"smooth": (F.avg, F.col("value"))}, size=8)
    return select(rows, "source_id", "axis", "idx", "smooth")


def series_trailing_median(spark, sf):
    rows = moving_window(signals(spark, sf), series.KEYS, "idx", 4, 0, {"med": (lambda c: F.percentile(c, F.lit(0.5)), F.col("value"))}, size=8)
    return select(rows, "source_id", "axis", "idx", "med")


def series_cumulative(spark, sf):
    return select(cumulative(signals(spark, sf), series.KEYS, "idx", "value", "total", size=8), "source_id", "axis", "idx", "total")


def series_ema(spark, sf):
    return select(series.ema(signals(spark, sf), 1 / 3), "source_id", "axis", "idx", "ema", digits=7)


def series_gaussian(spark, sf):
    return select(series.weighted_window(signals(spark, sf), series.gaussian(1.0, 2.0), "smooth"), "source_id", "axis", "idx", "smooth")


def series_zscore(spark, sf):
    return select(series.zscore(signals(spark, sf)), "source_id", "axis", "idx", "z")


def series_minmax(spark, sf):
    return select(series.minmax(signals(spark, sf)), "source_id", "axis", "idx", "unit")


def series_robust(spark, sf):
    return select(series.robust(signals(spark, sf)), "source_id", "axis", "idx", "robust")


def series_trend(spark, sf):
    return rounded(series.trend(signals(spark, sf)), 5)


def series_detrended(spark, sf):
    return select(series.detrended(signals(spark, sf)), "source_id", "axis", "idx", "value", digits=4)


def series_statistics(spark, sf):
    return rounded(series.statistics(signals(spark, sf)), 7)


def series_peaks(spark, sf):
    return select(series.local_maxima(signals(spark, sf)), "source_id", "axis", "idx", "value")


def series_top_peaks(spark, sf):
    rows = series.local_maxima(signals(spark, sf))
    w = series.Window.partitionBy(*series.KEYS).orderBy(F.desc("value"), "idx")
    top = rows.withColumns({"rank": F.row_number().over(w), "best": F.first("value").over(w)}).where("rank <= 3")
    return select(top.withColumn("relative", 100 * F.col("value") / F.col("best")), "source_id", "axis", "rank", "value", "relative")


def series_resampled(spark, sf):
    return rounded(grid(spark, sf), 5)


def series_decimated(spark, sf):
    return select(series.decimated(signals(spark, sf), 3), "source_id", "axis", "idx", "value")


def series_cropped(spark, sf):
    rows = signals(spark, sf).where(F.col("t").between(100.0, 400.0))
    kept = rows.groupBy("source_id", "axis").count().where("count >= 2").drop("count")
    return select(rows.join(kept, series.KEYS).withColumn("scaled", F.col("value") * 2.5 - 1), "source_id", "axis", "idx", "scaled")


def series_mean_at_time(spark, sf):
    rows = signals(spark, sf).withColumn("hour", F.floor("t"))
    return rounded(rows.groupBy("source_id", "hour").agg(F.avg("value").alias("value")), 5)


def series_hold_last(spark, sf):
    return select(series.hold_last(signals(spark, sf), series.KEYS, "idx", F.col("value") > 20, ["value"]), "source_id", "axis", "idx", "held_value")


def series_jumps(spark, sf):
    rows = series.differences(signals(spark, sf)).withColumn("jump", F.abs("dv") > 30)
    return rounded(rows.groupBy("source_id", "axis").agg(F.sum(F.col("jump").cast("long")).alias("jumps"), F.max(F.abs("dv")).alias("largest")), 5)


def series_vector_magnitude(spark, sf):
    return rounded(pairs(spark, sf).select("source_id", "k", F.hypot("a", "b").alias("magnitude")), 5)


def pair_errors(spark, sf):
    return rounded(series.pair_metrics(pairs(spark, sf), ["source_id"]), 4)


def pair_lag_signed(spark, sf):
    return rounded(series.best_lag(series.lag_products(pairs(spark, sf), ["source_id"], 5), ["source_id"], True), 5)


def pair_lag_absolute(spark, sf):
    return rounded(series.best_lag(series.lag_products(pairs(spark, sf), ["source_id"], 5), ["source_id"], False), 5)


def pair_correlations(spark, sf):
    return rounded(series.lag_products(pairs(spark, sf), ["source_id"], 5), 5)


def pair_aligned(spark, sf):
    both = pairs(spark, sf)
    lags = series.best_lag(series.lag_products(both, ["source_id"], 5), ["source_id"], True)
    return rounded(series.pair_metrics(series.aligned(both, lags, ["source_id"]), ["source_id"]).select("source_id", "n", "pearson", "rmse"), 4)


def series_decay(spark, sf):
    rows = signals(spark, sf)
    return rounded(series.decay_start(rows, 0.3).join(series.decay_fit(rows).select("source_id", "axis", "slope", "r2"), series.KEYS), 4)


def residual_autocorrelation(spark, sf):
    rows = pairs(spark, sf).withColumn("e", F.col("b") - F.col("a"))
    rows = neighbours(rows, ["source_id"], "k", {"before": ("e", -1)})
    return rounded(rows.groupBy("source_id").agg(F.corr("e", "before").alias("r1")), 5)


def series_peaks_or_top(spark, sf):
    return select(series.maxima_or_top(signals(spark, sf)), "source_id", "axis", "idx", "value")


def series_free_decay(spark, sf):
    rows = signals(spark, sf)
    return rounded(series.free_decay_start(rows, 0.3, 200.0).join(series.free_decay_fit(rows), series.KEYS), 4)


def pair_standardised(spark, sf):
    return rounded(series.standardised_metrics(pairs(spark, sf), ["source_id"]), 5)


LAGS = f"""WITH {SIGNALS}, {GRID}, {PAIRS}, c AS (SELECT source_id, k, a - avg(a) OVER (PARTITION BY source_id) AS a, b - avg(b) OVER (PARTITION BY source_id) AS b FROM pairs),
norms AS (SELECT source_id, sqrt(sum(a * a) * sum(b * b)) AS norm FROM c GROUP BY 1),
products AS (SELECT l.source_id, lag, count(*) AS n, CASE WHEN any_value(norm) > 0 THEN sum(l.a * r.b) / any_value(norm) END AS r FROM c l, (SELECT unnest(range(-5, 6))::INT AS lag), c r, norms
  WHERE l.source_id = r.source_id AND r.k = l.k + lag AND norms.source_id = l.source_id GROUP BY 1, 2)"""
ERRORS = """count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 4) AS pearson, round(sqrt(avg((b - a)^2)), 4) AS rmse"""
GAUSS = series.gaussian(1.0, 2.0)
SMOOTH = " + ".join(f"{c!r}::DOUBLE * coalesce({'lag' if i < 2 else 'lead'}(value, {abs(i - 2)}) OVER w, {'first_value(value) OVER w' if i < 2 else 'last_value(value) OVER (PARTITION BY source_id, axis ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)'})" for i, c in enumerate(GAUSS))
IDS = "source_id, axis, idx"

QUERIES = {
    "series_differences": (series_differences, f"WITH {SIGNALS} SELECT {IDS}, round(t - lag(t) OVER w, 5) AS dt, round(value - lag(value) OVER w, 5) + 0.0 AS dv FROM signals {W}"),
    "series_rates": (series_rates, f"""WITH {SIGNALS}, d AS (SELECT *, t - lag(t) OVER w AS dt FROM signals {W}) SELECT source_id, axis, count(*) AS samples, round(min(t), 5) AS start, round(max(t), 5) AS "end",
        round(quantile_cont(dt, 0.5) FILTER (dt > 0), 5) AS step, round(1 / quantile_cont(dt, 0.5) FILTER (dt > 0), 5) AS rate FROM d GROUP BY 1, 2"""),
    "series_relative_time": (series_relative_time, f"WITH {SIGNALS} SELECT {IDS}, round(t - min(t) OVER (PARTITION BY source_id, axis), 5) AS t FROM signals"),
    "series_gradient": (series_gradient, f"""WITH {SIGNALS}, n AS (SELECT *, t - lag(t) OVER w AS h, lead(t) OVER w - t AS k, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM signals {W}),
        g AS (SELECT *, CASE WHEN h IS NULL THEN (hi - value) / k WHEN k IS NULL THEN (value - lo) / h ELSE (h * h * hi + (k * k - h * h) * value - k * k * lo) / (h * k * (h + k)) END AS slope FROM n)
        SELECT {IDS}, round(slope, 3) + 0.0 AS slope FROM g"""),
    "series_moving_average": (series_moving_average, f"WITH {SIGNALS} SELECT {IDS}, round(avg(value) OVER (PARTITION BY source_id, axis ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM signals"),
    "series_trailing_median": (series_trailing_median, f"WITH {SIGNALS} SELECT {IDS}, round(quantile_cont(value, 0.5) OVER (PARTITION BY source_id, axis ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS med FROM signals"),
    "series_cumulative": (series_cumulative, f"WITH {SIGNALS} SELECT {IDS}, round(sum(value) OVER (PARTITION BY source_id, axis ORDER BY idx), 5) AS total FROM signals"),
    "series_ema": (series_ema, f"""WITH RECURSIVE {SIGNALS}, e AS (SELECT {IDS}, value AS ema FROM signals WHERE idx = 0 UNION ALL
        SELECT s.source_id, s.axis, s.idx, 2 * e.ema / 3 + s.value / 3 FROM e JOIN signals s ON s.source_id = e.source_id AND s.axis = e.axis AND s.idx = e.idx + 1) SELECT {IDS}, round(ema, 7) AS ema FROM e"""),
    "series_gaussian": (series_gaussian, f"WITH {SIGNALS} SELECT {IDS}, round({SMOOTH}, 5) AS smooth FROM signals {W}"),
    "series_zscore": (series_zscore, f"WITH {SIGNALS}, m AS (SELECT source_id, axis, avg(value) AS m, stddev_pop(value) AS s FROM signals GROUP BY 1, 2) SELECT {IDS}, round(CASE WHEN s > 0 THEN (value - m) / s ELSE value END, 5) + 0.0 AS z FROM signals JOIN m USING (source_id, axis)"),
    "series_minmax": (series_minmax, f"WITH {SIGNALS}, m AS (SELECT source_id, axis, min(value) AS a, max(value) AS b FROM signals GROUP BY 1, 2) SELECT {IDS}, round(CASE WHEN b > a THEN (value - a) / (b - a) ELSE value END, 5) AS unit FROM signals JOIN m USING (source_id, axis)"),
    "series_robust": (series_robust, f"""WITH {SIGNALS}, m AS (SELECT source_id, axis, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM signals GROUP BY 1, 2)
        SELECT {IDS}, round(CASE WHEN s > 0 THEN (value - m) / s ELSE value END, 5) + 0.0 AS robust FROM signals JOIN m USING (source_id, axis)"""),
    "series_trend": (series_trend, f"WITH {SIGNALS} SELECT source_id, axis, round(regr_slope(value, t), 5) + 0.0 AS slope, round(regr_intercept(value, t), 5) + 0.0 AS intercept FROM signals GROUP BY 1, 2"),
    "series_detrended": (series_detrended, f"WITH {SIGNALS}, m AS (SELECT source_id, axis, regr_slope(value, t) AS s, regr_intercept(value, t) AS i FROM signals GROUP BY 1, 2) SELECT {IDS}, round(value - s * t - i, 4) + 0.0 AS value FROM signals JOIN m USING (source_id, axis)"),
    "series_statistics": (series_statistics, f"""WITH {SIGNALS} SELECT source_id, axis, count(*) AS n, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std, round(sqrt(avg(value * value)), 7) AS rms, min(value) AS low, max(value) AS high,
        round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 7) AS span90, round((quantile_cont(value, 0.95) - quantile_cont(value, 0.05)) / 2, 7) AS amplitude FROM signals GROUP BY 1, 2"""),
    "series_peaks": (series_peaks, f"WITH {SIGNALS}, n AS (SELECT *, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM signals {W}) SELECT {IDS}, value FROM n WHERE value > lo AND value >= hi"),
    "series_top_peaks": (series_top_peaks, f"""WITH {SIGNALS}, n AS (SELECT *, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM signals {W}), p AS (SELECT *, row_number() OVER q AS rank, first_value(value) OVER q AS best FROM n WHERE value > lo AND value >= hi
        WINDOW q AS (PARTITION BY source_id, axis ORDER BY value DESC, idx)) SELECT source_id, axis, rank, value, round(100 * value / best, 5) AS relative FROM p WHERE rank <= 3"""),
    "series_resampled": (series_resampled, f"WITH {SIGNALS}, {GRID} SELECT source_id, axis, k, t, round(value, 5) AS value FROM grid"),
    "series_decimated": (series_decimated, f"WITH {SIGNALS} SELECT {IDS}, value FROM signals WHERE idx % 3 = 0"),
    "series_cropped": (series_cropped, f"WITH {SIGNALS} SELECT {IDS}, round(value * 2.5 - 1, 5) AS scaled FROM signals WHERE t BETWEEN 100 AND 400 QUALIFY count(*) OVER (PARTITION BY source_id, axis) >= 2"),
    "series_mean_at_time": (series_mean_at_time, f"WITH {SIGNALS} SELECT source_id, floor(t)::BIGINT AS hour, round(avg(value), 5) AS value FROM signals GROUP BY 1, 2"),
    "series_hold_last": (series_hold_last, f"WITH {SIGNALS} SELECT {IDS}, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY source_id, axis ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held_value FROM signals"),
    "series_jumps": (series_jumps, f"WITH {SIGNALS}, d AS (SELECT *, abs(value - lag(value) OVER w) AS dv FROM signals {W}) SELECT source_id, axis, sum((dv > 30)::BIGINT)::BIGINT AS jumps, round(max(dv), 5) AS largest FROM d GROUP BY 1, 2"),
    "series_vector_magnitude": (series_vector_magnitude, f"WITH {SIGNALS}, {GRID}, {PAIRS} SELECT source_id, k, round(sqrt(a * a + b * b), 5) AS magnitude FROM pairs"),
    "pair_errors": (pair_errors, f"""WITH {SIGNALS}, {GRID}, {PAIRS} SELECT source_id, {ERRORS}, round(avg(abs(b - a)), 4) AS mae, round(max(abs(b - a)), 4) AS max_error, round(quantile_cont(abs(b - a), 0.5), 4) AS med_error, round(avg(b - a), 4) + 0.0 AS bias,
        round(stddev_pop(b - a), 4) AS residual_std, round(CASE WHEN max(a) > min(a) THEN sqrt(avg((b - a)^2)) / (max(a) - min(a)) END, 4) AS nrmse, round(CASE WHEN var_pop(a) > 0 THEN 1 - sum((b - a)^2) / (var_pop(a) * count(*)) END, 4) AS r2 FROM pairs GROUP BY 1"""),
    "pair_lag_signed": (pair_lag_signed, f"{LAGS} SELECT source_id, arg_max(lag, (round(r, 9), -lag)) AS lag, round(arg_max(r, (round(r, 9), -lag)), 5) + 0.0 AS r FROM products WHERE r IS NOT NULL GROUP BY 1"),
    "pair_lag_absolute": (pair_lag_absolute, f"{LAGS} SELECT source_id, arg_max(lag, (round(abs(r), 9), -lag)) AS lag, round(arg_max(r, (round(abs(r), 9), -lag)), 5) + 0.0 AS r FROM products WHERE r IS NOT NULL GROUP BY 1"),
    "pair_correlations": (pair_correlations, f"{LAGS} SELECT source_id, lag, n, round(r, 5) + 0.0 AS r FROM products"),
    "pair_aligned": (pair_aligned, f"""{LAGS}, best AS (SELECT source_id, arg_max(lag, (round(r, 9), -lag)) AS lag FROM products WHERE r IS NOT NULL GROUP BY 1),
        al AS (SELECT l.source_id, l.a, r.b FROM pairs l JOIN best USING (source_id) JOIN pairs r ON r.source_id = l.source_id AND r.k = l.k + lag) SELECT source_id, {ERRORS} FROM al GROUP BY 1"""),
    "series_decay": (series_decay, f"""WITH {SIGNALS}, top AS (SELECT source_id, axis, max(value) AS top, arg_min(t, (-value, t)) AS top_t FROM signals GROUP BY 1, 2),
        s AS (SELECT source_id, axis, min(t) AS start_t FROM signals JOIN top USING (source_id, axis) WHERE t >= top_t AND value <= 0.3::DOUBLE * top GROUP BY 1, 2),
        f AS (SELECT source_id, axis, regr_slope(ln(value), t) AS slope, regr_r2(ln(value), t) AS r2 FROM signals JOIN top USING (source_id, axis) WHERE value > 0 AND value BETWEEN 0.08::DOUBLE * top AND 0.98::DOUBLE * top GROUP BY 1, 2)
        SELECT source_id, axis, round(top, 4) AS top, round(top_t, 4) AS top_t, round(start_t, 4) AS start_t, round(slope, 4) + 0.0 AS slope, round(r2, 4) AS r2 FROM top LEFT JOIN s USING (source_id, axis) JOIN f USING (source_id, axis)"""),
    "series_peaks_or_top": (series_peaks_or_top, f"""WITH {SIGNALS}, n AS (SELECT *, coalesce(value > lag(value) OVER w AND value >= lead(value) OVER w, false) AS peak FROM signals {W}),
        m AS (SELECT source_id, axis, bool_or(peak) AS has_peak, arg_max(idx, (value, -idx)) AS top FROM n GROUP BY 1, 2) SELECT {IDS}, value FROM n JOIN m USING (source_id, axis) WHERE peak OR (NOT has_peak AND idx = top)"""),
    "series_free_decay": (series_free_decay, f"""WITH {SIGNALS}, m AS (SELECT source_id, axis, count(*) AS n, min(t) AS first, max(t) AS last, max(value) AS high, arg_min(t, (-value, t)) AS top_t, count(*) FILTER (value > 0) AS n_all FROM signals GROUP BY 1, 2),
        s AS (SELECT source_id, axis, CASE WHEN any_value(n) < 8 THEN any_value(first) ELSE least(coalesce(min(t) FILTER (t >= top_t AND value <= greatest(0.3::DOUBLE * high, 2.220446049250313e-16::DOUBLE)), any_value(top_t)), any_value(last) - 200) END AS start_t
          FROM signals JOIN m USING (source_id, axis) GROUP BY 1, 2),
        p AS (SELECT source_id, axis, t, ln(value) AS l, n_all, value BETWEEN 0.08::DOUBLE * high AND 0.98::DOUBLE * high AS inside FROM signals JOIN m USING (source_id, axis) WHERE value > 0),
        c AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY source_id, axis) AS n_in FROM p),
        f AS (SELECT source_id, axis, CASE WHEN any_value(n_in) >= 8 THEN any_value(n_in) WHEN any_value(n_all) >= 8 THEN any_value(n_all) END AS n, regr_slope(l, t) FILTER (n_in >= 8 AND inside OR n_in < 8 AND n_all >= 8) AS slope,
          regr_r2(l, t) FILTER (n_in >= 8 AND inside OR n_in < 8 AND n_all >= 8) AS r2 FROM c GROUP BY 1, 2)
        SELECT source_id, axis, round(start_t, 4) AS start_t, n, round(slope, 4) + 0.0 AS slope, round(r2, 4) AS r2, round(CASE WHEN slope < -2.220446049250313e-16::DOUBLE THEN -1 / slope END, 4) AS tau FROM s JOIN f USING (source_id, axis)"""),
    "pair_standardised": (pair_standardised, f"""WITH {SIGNALS}, {GRID}, {PAIRS}, m AS (SELECT source_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, sqrt(avg(a * a)) AS rms_a, sqrt(avg(b * b)) AS rms_b FROM pairs GROUP BY 1),
        z AS (SELECT source_id, n, rms_a, rms_b, CASE WHEN sa > 0 THEN (a - ma) / sa END AS a, CASE WHEN sb > 0 THEN (b - mb) / sb END AS b FROM pairs JOIN m USING (source_id))
        SELECT source_id, n, round(rms_a, 5) AS rms_a, round(rms_b, 5) AS rms_b, round(avg(a * b), 5) + 0.0 AS pearson, round(sqrt(avg((b - a)^2)), 5) AS rmse_z, round(avg(abs(b - a)), 5) AS mae_z, round(abs(avg(a * b)), 5) AS abs_pearson FROM z GROUP BY 1, 2, 3, 4"""),
    "residual_autocorrelation": (residual_autocorrelation, f"WITH {SIGNALS}, {GRID}, {PAIRS}, e AS (SELECT source_id, b - a AS e, lag(b - a) OVER (PARTITION BY source_id ORDER BY k) AS p FROM pairs) SELECT source_id, round(corr(e, p), 5) + 0.0 AS r1 FROM e GROUP BY 1"),
}
