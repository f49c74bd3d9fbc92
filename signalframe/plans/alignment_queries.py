"""Queries that search an archive, bring series together, and take flicker, aliases and other bands out, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalframe.operators import aligning, filtering, flicker, matching, series, spectral, studies
from signalframe.plans.adapters import SIGNALS, signals
from signalframe.plans.point_queries import rounded
from signalframe.plans.recording_queries import SPECTRA
from signalframe.plans.series_queries import GRID, LAGS, PAIRS, STEP, grid, pairs
from signalframe.plans.spectral_queries import spectra, spectrum_sql

VIDEO = (0.0, 12.0)  # hours
REFERENCE, LOW, TOP, PEAKS, THRESHOLD = 0.03, 0.005, 0.08, 5, 2.0
MARGINS = [3.0, 5.0, 10.0, 20.0, 30.0, 60.0]  # hours


def measured(spark, sf):
    peaks = matching.peak_lists(spectra(spark, sf, "linear", "symmetric"), REFERENCE, PEAKS, LOW, TOP, series.KEYS)
    return matching.measurements(signals(spark, sf), peaks, VIDEO)


def archive_measurements(spark, sf):
    rows = measured(spark, sf)
    return rounded(rows.withColumns({"n_axes": F.size("axes"), "n_ok": F.size(F.filter("axes", lambda x: x["status"] == "ok"))}).drop("axes"), 5)


def archive_axis_peaks(spark, sf):
    rows = measured(spark, sf).select("source_id", F.explode("axes").alias("a")).select("source_id", "a.axis", "a.status", "a.n", "a.mean", "a.rms", "a.span90", F.explode_outer("a.peaks").alias("p"))
    return rounded(rows.select("source_id", "axis", "status", "n", "mean", "rms", "span90", "p.rank", "p.frequency", "p.amplitude", "p.strength", "p.error"), 6)


def archive_windows(spark, sf):
    return rounded(matching.window_counts(measured(spark, sf), MARGINS, THRESHOLD), 5)


def archive_conclusion(spark, sf):
    return matching.search_summary(measured(spark, sf), 1.0, MARGINS, THRESHOLD)


def pair_synchronised(spark, sf):
    rows = signals(spark, sf)
    side = lambda axis: rows.where(F.col("axis") == axis).select("source_id", "t", "value")
    lags = aligning.lag_seconds(pairs(spark, sf), ["source_id"], STEP, "correlation", 5)
    return rounded(aligning.synchronised(side("click"), side("view"), lags, ["source_id"], 1 / STEP, 48.0), 5)


def by_axis(spark, sf):
    """One series of each axis over all sources: axis, idx, value."""
    order = Window.partitionBy("axis").orderBy("t", "source_id", "idx")
    return signals(spark, sf).select("axis", (F.row_number().over(order) - 1).cast("long").alias("at"), "value").withColumnRenamed("at", "idx")


BY_AXIS = f"{SIGNALS}, rows AS (SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY t, source_id, idx) - 1 AS idx, value FROM signals)"


def flicker_gains(spark, sf):
    return rounded(flicker.flicker_gain(by_axis(spark, sf), ["axis"], "idx", "value", 0.25), 5)


def sample_pairs(spark, sf):
    rows = by_axis(spark, sf)
    a, b = (rows.where(F.col("axis") == x).select(F.col("idx").alias("k"), F.col("value").alias(c)) for x, c in (("click", "a"), ("view", "b")))
    return a.join(b, "k").withColumn("pair", F.lit("click/view"))


def coherence_long(spark, sf):
    return rounded(spectral.coherence(sample_pairs(spark, sf), 256, 1.0, ["pair"]), 5)


def coherence_dominant(spark, sf):
    return rounded(spectral.dominant_densities(spectral.coherence(sample_pairs(spark, sf), 256, 1.0, ["pair"]), 0.1, 0.4, ["pair"]), 5)


def series_antialiased(spark, sf):
    return rounded(studies.anti_aliased(grid(spark, sf), [1, 2, 4], STEP, 10.0, taps=11), 5)


def pair_band_limited(spark, sf):
    return rounded(series.band_limited_metrics(sample_pairs(spark, sf), ["pair"], 4, 0.05, 0.2, 20, 50), 6)


WEIGHTS = ", ".join(f"({f}, {o}, {w!r}::DOUBLE)" for f in (2, 4) for o, w in enumerate(filtering.low_pass(11, 0.9 / (2 * f)), -5))
ERROR = f"100.0::DOUBLE * abs(frequency - {REFERENCE}::DOUBLE) / {REFERENCE}::DOUBLE"
FOUND = f"""{spectrum_sql('linear', 'symmetric')},
  inside AS (SELECT *, lag(amplitude) OVER w AS lo, lead(amplitude) OVER w AS hi FROM spectra WHERE frequency BETWEEN {LOW}::DOUBLE AND {TOP}::DOUBLE AND frequency > 0 WINDOW w AS (PARTITION BY source_id, axis ORDER BY bin)),
  flagged AS (SELECT *, coalesce(amplitude > lo AND amplitude >= hi, false) AS peak, bool_or(coalesce(amplitude > lo AND amplitude >= hi, false)) OVER g AS any_peak, arg_max(bin, (amplitude, -bin)) OVER g AS top FROM inside WINDOW g AS (PARTITION BY source_id, axis)),
  peaks AS (SELECT source_id, axis, frequency, amplitude, row_number() OVER (PARTITION BY source_id, axis ORDER BY round(amplitude, 9) DESC, bin) AS rank, {ERROR} AS error FROM flagged WHERE peak OR (NOT any_peak AND bin = top) QUALIFY rank <= {PEAKS}),
  strong AS (SELECT *, 100.0::DOUBLE * amplitude / nullif(first_value(amplitude) OVER (PARTITION BY source_id, axis ORDER BY rank), 0) AS strength FROM peaks),
  extent AS (SELECT source_id, count(*) AS rows, min(t) AS start, max(t) AS "end", count(DISTINCT axis)::INT AS n_axes FROM signals GROUP BY 1),
  placed AS (SELECT *, greatest(0.0::DOUBLE, least("end", {VIDEO[1]}::DOUBLE) - greatest(start, {VIDEO[0]}::DOUBLE)) AS overlap, greatest(0.0::DOUBLE, {VIDEO[0]}::DOUBLE - "end", start - {VIDEO[1]}::DOUBLE) AS gap FROM extent),
  best AS (SELECT source_id, count(DISTINCT axis)::INT AS n_ok, arg_min({{'axis': axis, 'frequency': frequency, 'error': error}}, (round(error, 9), axis)) FILTER (rank = 1) AS b, arg_min({{'axis': axis, 'rank': rank, 'frequency': frequency, 'strength': strength, 'error': error}}, (round(error, 9), axis, rank)) AS p FROM strong GROUP BY 1),
  found AS (SELECT placed.*, coalesce(n_ok, 0) AS n_ok, b, p, p.error AS any_error, b.error AS best_error FROM placed LEFT JOIN best USING (source_id))"""
COUNTED = f"""tallies AS (SELECT margin, count(*) FILTER (near) AS temporal, count(*) FILTER (near AND alike) AS simultaneous, min(gap) FILTER (near) AS best_gap, min(any_error) FILTER (near AND alike) AS best_error
  FROM (SELECT *, overlap > 0 OR gap <= margin AS near, coalesce(any_error <= {THRESHOLD}, false) AS alike FROM found, (SELECT unnest({MARGINS})::DOUBLE AS margin)) GROUP BY 1)"""

QUERIES = {
    "archive_measurements": (archive_measurements, f"""{FOUND} SELECT source_id, rows, round(start, 5) AS start, round("end", 5) AS "end", round("end" - start, 5) AS duration, round(overlap, 5) AS overlap, round(gap, 5) AS gap, round(start - {VIDEO[0]}, 5) AS start_difference, round("end" - {VIDEO[1]}, 5) AS end_difference,
        round(100.0::DOUBLE * overlap / {VIDEO[1] - VIDEO[0]}, 5) AS overlap_percent, n_axes, n_ok, b.axis AS best_axis, round(b.frequency, 5) AS best_frequency, round(b.error, 5) AS best_error, p.axis AS any_axis, p.rank::INT AS any_rank, round(p.frequency, 5) AS any_frequency, round(p.strength, 5) AS any_strength, round(p.error, 5) AS any_error FROM found"""),
    "archive_axis_peaks": (archive_axis_peaks, f"""{FOUND}, st AS (SELECT source_id, axis, count(*) AS n, avg(value) AS mean, sqrt(avg(value * value)) AS rms, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS span90 FROM signals GROUP BY 1, 2)
        SELECT source_id, axis, CASE WHEN rank IS NULL THEN 'no_peaks' ELSE 'ok' END AS status, n, round(mean, 6) AS mean, round(rms, 6) AS rms, round(span90, 6) AS span90, rank::INT AS rank, round(frequency, 6) AS frequency, round(amplitude, 6) AS amplitude, round(strength, 6) AS strength, round(error, 6) AS error FROM st LEFT JOIN strong USING (source_id, axis)"""),
    "archive_windows": (archive_windows, f"{FOUND}, {COUNTED} SELECT margin, temporal, simultaneous, round(best_gap, 5) AS best_gap, round(best_error, 5) AS best_error FROM tallies"),
    "archive_conclusion": (archive_conclusion, f"""{FOUND}, {COUNTED}, one AS (SELECT count(*) AS measurements, count(*) FILTER (near) AS temporal, count(*) FILTER (best_error <= {THRESHOLD}) AS dominant, count(*) FILTER (any_error <= {THRESHOLD}) AS any_peak, count(*) FILTER (near AND any_error <= {THRESHOLD}) AS simultaneous
          FROM (SELECT *, overlap > 0 OR gap <= 1 AS near FROM found)),
        m AS (SELECT min(margin) AS lo, max(margin) AS hi, arg_min(simultaneous, margin) AS n_lo, arg_max(simultaneous, margin) AS n_hi FROM tallies WHERE simultaneous > 0)
        SELECT measurements, temporal, dominant, any_peak, simultaneous, CASE WHEN simultaneous > 0 THEN 1.0::DOUBLE ELSE lo END AS earliest_margin, CASE WHEN simultaneous > 0 THEN simultaneous ELSE coalesce(n_lo, 0) END AS earliest_count,
        CASE WHEN simultaneous = 0 THEN hi END AS widest_margin, CASE WHEN simultaneous = 0 THEN n_hi END AS widest_count, CASE WHEN simultaneous > 0 THEN 'matched' WHEN lo IS NOT NULL THEN 'exploratory' ELSE 'none' END AS conclusion FROM one, m"""),
    "pair_synchronised": (pair_synchronised, f"""{LAGS}, best AS (SELECT source_id, arg_max(lag, (round(abs(r), 9), -lag)) * {STEP}::DOUBLE AS lag_s FROM products WHERE r IS NOT NULL GROUP BY 1),
        a AS (SELECT source_id, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM signals WHERE axis = 'click' WINDOW w AS (PARTITION BY source_id ORDER BY t)),
        b AS (SELECT source_id, lag_s, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM (SELECT source_id, lag_s, t - lag_s AS t, value FROM signals JOIN best USING (source_id) WHERE axis = 'view') WINDOW w AS (PARTITION BY source_id ORDER BY t)),
        e AS (SELECT source_id, any_value(b.lag_s) AS lag_s, greatest(min(a.t), min(b.t)) AS start, least(max(a.t), max(b.t)) AS stop FROM a JOIN b USING (source_id) GROUP BY 1),
        g AS (SELECT source_id, lag_s, start, k, start + k / (1 / {STEP}::DOUBLE) AS t FROM (SELECT *, unnest(range(0, floor((stop - start) * (1 / {STEP}::DOUBLE))::BIGINT + 1)) AS k FROM e WHERE stop > start)),
        ga AS (SELECT g.*, CASE WHEN a.t = g.t THEN a.value ELSE a.value + (g.t - a.t) / (t2 - a.t) * (v2 - a.value) END AS va FROM g ASOF JOIN a ON g.source_id = a.source_id AND g.t >= a.t)
        SELECT ga.source_id, k, round(ga.t - start, 5) AS t, ga.lag_s, round(va, 5) AS a, round(CASE WHEN b.t = ga.t THEN b.value ELSE b.value + (ga.t - b.t) / (b.t2 - b.t) * (b.v2 - b.value) END, 5) AS b FROM ga ASOF JOIN b ON ga.source_id = b.source_id AND ga.t >= b.t"""),
    "flicker_gains": (flicker_gains, f"""WITH RECURSIVE {BY_AXIS}, p AS (SELECT a.axis, a.idx, any_value(a.value) AS value, count(*) AS n, list(b.value ORDER BY b.idx DESC) AS v FROM rows a JOIN rows b ON a.axis = b.axis AND b.idx BETWEEN a.idx - 255 AND a.idx GROUP BY 1, 2),
        f AS (SELECT axis, idx, value, CASE WHEN n >= 32 THEN list_sum([v[i] * (2 * cos(2 * pi() * (((n + 1) // 4) * (i - 1) % n) / n) + cos(2 * pi() * (((n + 1) // 4 - 1) * (i - 1) % n) / n) + cos(2 * pi() * (((n + 1) // 4 + 1) * (i - 1) % n) / n)) / n FOR i IN range(1, n + 1)]) END AS flicker FROM p),
        e AS (SELECT axis, idx, value, flicker, value AS first, value AS target, 1.0::DOUBLE AS gain FROM f WHERE idx = 0 UNION ALL
          SELECT axis, idx, value, flicker, first, target, CASE WHEN value >= 1e-6::DOUBLE THEN target / value ELSE 1 END FROM (SELECT f.axis, f.idx, f.value, f.flicker, e.first, CASE WHEN f.idx < 31 THEN e.first ELSE 0.2::DOUBLE * (e.first - f.flicker) + 0.8::DOUBLE * e.target END AS target FROM e JOIN f ON f.axis = e.axis AND f.idx = e.idx + 1))
        SELECT axis, idx, value, round(flicker, 5) + 0.0 AS flicker, round(target, 5) + 0.0 AS target, round(gain, 5) + 0.0 AS gain FROM e"""),
    "coherence_long": (coherence_long, None),
    "coherence_dominant": (coherence_dominant, None),
    "series_antialiased": (series_antialiased, f"""WITH {SIGNALS}, {GRID}, z AS (SELECT source_id, axis, k - min(k) OVER g AS k, count(*) OVER g AS n, value FROM grid WINDOW g AS (PARTITION BY source_id, axis)), w(factor, o, c) AS (VALUES {WEIGHTS}),
        y AS (SELECT a.source_id, a.axis, factor, a.k // factor AS k, sum(c * b.value) AS value FROM z a, w, z b WHERE a.k % factor = 0 AND b.source_id = a.source_id AND b.axis = a.axis AND b.k = CASE WHEN a.k + o < 0 THEN -(a.k + o) WHEN a.k + o > a.n - 1 THEN 2 * (a.n - 1) - a.k - o ELSE a.k + o END GROUP BY 1, 2, 3, 4),
        f AS (SELECT source_id, axis, 1 AS factor, k, value FROM z UNION ALL SELECT * FROM y), {SPECTRA.format(keys='source_id, axis, factor', source='f')},
        q AS (SELECT source_id, axis, factor, count(*) AS n, (quantile_cont(value, 0.95) - quantile_cont(value, 0.05)) / 2 AS amplitude FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 3),
        r AS (SELECT q.*, 1 / ({STEP}::DOUBLE * q.factor) AS rate, frequency / ({STEP}::DOUBLE * q.factor) AS dominant FROM q LEFT JOIN d ON d.source_id = q.source_id AND d.axis = q.axis AND d.factor = q.factor),
        e AS (SELECT r.*, b.dominant AS f0, CASE WHEN abs(b.dominant) > 1e-12 THEN 100.0::DOUBLE * abs(r.dominant - b.dominant) / abs(b.dominant) END AS frequency_error, CASE WHEN abs(b.amplitude) > 1e-12 THEN 100.0::DOUBLE * abs(r.amplitude - b.amplitude) / abs(b.amplitude) END AS amplitude_error
          FROM r LEFT JOIN (SELECT * FROM r WHERE factor = 1) b ON b.source_id = r.source_id AND b.axis = r.axis)
        SELECT source_id, axis, factor, n, round(rate, 5) AS rate, round(dominant, 5) AS dominant, round(amplitude, 5) AS amplitude, round(frequency_error, 5) AS frequency_error, round(amplitude_error, 5) AS amplitude_error, coalesce(frequency_error <= 10, false) AS frequency_ok, coalesce(amplitude_error <= 10, false) AS amplitude_ok, coalesce(f0 < rate / 2, false) AS below_nyquist FROM e"""),
    "pair_band_limited": (pair_band_limited, None),
}

COHERENCE_LONG = f"""WITH {BY_AXIS}, x AS (SELECT l.idx AS k, l.value AS a, r.value AS b FROM rows l JOIN rows r USING (idx) WHERE l.axis = 'click' AND r.axis = 'view'), g AS (SELECT *, unnest([k // 128 - 1, k // 128]) AS segment FROM x),
  j AS (SELECT *, k - segment * 128 AS j, count(*) OVER (PARTITION BY segment) AS n FROM g WHERE segment >= 0),
  c AS (SELECT segment, j, (a - avg(a) OVER w) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 256)) AS a, (b - avg(b) OVER w) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 256)) AS b FROM j WHERE n = 256 WINDOW w AS (PARTITION BY segment)),
  t AS (SELECT m, cos(2 * pi() * m / 256) AS co, sin(2 * pi() * m / 256) AS si FROM range(256) r(m)),
  p AS (SELECT segment, bin, sum(a * co) AS ac, sum(a * si) AS as_, sum(b * co) AS bc, sum(b * si) AS bs FROM c, (SELECT unnest(range(1, 129))::INT AS bin), t WHERE m = bin * j % 256 GROUP BY 1, 2),
  s AS (SELECT bin, count(*) AS segments, avg(ac * ac + as_ * as_) AS aa, avg(bc * bc + bs * bs) AS bb, avg(ac * bc + as_ * bs) AS re, avg(as_ * bc - ac * bs) AS im FROM p GROUP BY 1),
  e AS (SELECT 'click/view' AS pair, bin, segments, bin / 256 AS frequency, aa / 96 * CASE WHEN bin = 128 THEN 1 ELSE 2 END AS psd_a, bb / 96 * CASE WHEN bin = 128 THEN 1 ELSE 2 END AS psd_b, (re * re + im * im) / (aa * bb) AS coherence FROM s)"""
QUERIES["coherence_long"] = (coherence_long, f"{COHERENCE_LONG} SELECT pair, bin, segments, round(frequency, 5) AS frequency, round(psd_a, 5) AS psd_a, round(psd_b, 5) AS psd_b, round(coherence, 5) AS coherence FROM e")
QUERIES["coherence_dominant"] = (coherence_dominant, f"""{COHERENCE_LONG}, d AS (SELECT pair, arg_max(frequency, (round(psd_a, 9), -bin)) AS dominant_a, max(psd_a) AS density_a, arg_max(frequency, (round(psd_b, 9), -bin)) AS dominant_b, max(psd_b) AS density_b, arg_max(frequency, (round(coherence, 9), -bin)) AS coherent_at
    FROM e WHERE frequency BETWEEN 0.1::DOUBLE AND 0.4::DOUBLE GROUP BY 1) SELECT pair, round(dominant_a, 5) AS dominant_a, round(density_a, 5) AS density_a, round(dominant_b, 5) AS dominant_b, round(density_b, 5) AS density_b, round(coherent_at, 5) AS coherent_at,
    round(abs(dominant_b - dominant_a), 5) AS difference, round(100.0::DOUBLE * abs(dominant_b - dominant_a) / dominant_a, 5) AS difference_percent FROM d""")
