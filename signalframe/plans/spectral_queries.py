"""Queries over spectra of resampled sensor series."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalframe.functions import scalars
from signalframe.operators import spectral
from signalframe.plans.adapters import SIGNALS
from signalframe.plans.point_queries import rounded
from signalframe.plans.series_queries import GRID, PAIRS, STEP, grid, pairs

HIGH = 0.0834  # just over the Nyquist frequency of the grid, so that all bins are there


def spectra(spark, sf, detrend="mean", kind="periodic"):
    return spectral.spectrum(spectral.prepared(grid(spark, sf), detrend=detrend), STEP, 0.0, HIGH, kind)


def spectrum_periodic(spark, sf):
    return rounded(spectra(spark, sf).select("source_id", "axis", "bin", "frequency", "amplitude"), 6)


def spectrum_symmetric_detrended(spark, sf):
    return rounded(spectra(spark, sf, "linear", "symmetric").select("source_id", "axis", "bin", "amplitude"), 5)


def spectrum_dominant(spark, sf):
    return rounded(spectral.dominant(spectra(spark, sf)), 6)


def spectrum_dominant_unwindowed(spark, sf):
    return rounded(spectral.dominant(spectra(spark, sf, "linear", "none")), 5)


def spectrum_features(spark, sf):
    return rounded(spectral.features(spectra(spark, sf)), 4)


def spectrum_band(spark, sf):
    return rounded(spectral.band(spectra(spark, sf), 0.01, 0.03), 6)


def spectrum_nearest(spark, sf):
    return rounded(spectral.nearest(spectra(spark, sf), 0.02), 6)


def spectrum_peaks(spark, sf):
    return rounded(spectral.peaks(spectra(spark, sf), 3), 6)


def spectrum_harmonics(spark, sf):
    return rounded(spectral.harmonics(spectra(spark, sf), 0.0071, 5, 0.002, 0.5 / STEP), 6)


def frequency_agreement(spark, sf):
    rows = spectral.dominant(spectra(spark, sf))
    a, b = (rows.where(F.col("axis") == x).select("source_id", F.col("frequency").alias(x)) for x in ("click", "view"))
    error = scalars.relative_error(F.col("view"), F.col("click"))
    return rounded(a.join(b, "source_id").withColumns({"error": error, "difference": scalars.relative_difference(F.col("view"), F.col("click"), 1e-6), "passed": error <= 10.0}), 6)


def pair_coherence(spark, sf):
    return rounded(spectral.coherence(pairs(spark, sf), 16, STEP, ["source_id"]), 5)


def hann(kind):
    return {"periodic": "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / n)", "symmetric": "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / greatest(n - 1, 1))", "none": "1.0::DOUBLE"}[kind]


def spectrum_sql(detrend="mean", kind="periodic"):
    x = "value - avg(value) OVER g" if detrend == "mean" else "value - regr_slope(value, i) OVER g * i - regr_intercept(value, i) OVER g"
    last = "n // 2" if kind == "symmetric" else "n / 2"
    return f"""WITH {SIGNALS}, {GRID}, numbered AS (SELECT source_id, axis, value, k - min(k) OVER g AS i, count(*) OVER g AS n FROM grid WINDOW g AS (PARTITION BY source_id, axis)),
      x AS (SELECT source_id, axis, i, n, {x} AS x, {hann(kind)} AS w FROM numbered WINDOW g AS (PARTITION BY source_id, axis)),
      b AS (SELECT *, unnest(range(0, least(n // 2, floor({HIGH}::DOUBLE * n * {STEP}::DOUBLE)::BIGINT) + 1)) AS bin FROM x),
      s AS (SELECT source_id, axis, n, bin, sum(w * x * cos(2 * pi() * ((bin * i) % n) / n)) AS re, sum(w * x * sin(2 * pi() * ((bin * i) % n) / n)) AS im, sum(w) AS weight FROM b GROUP BY 1, 2, 3, 4),
      spectra AS (SELECT source_id, axis, n, bin, bin / (n * {STEP}::DOUBLE) AS frequency, sqrt(re * re + im * im) / weight * CASE WHEN bin = 0 OR bin = {last} THEN 1 ELSE 2 END AS amplitude FROM s)"""


S = spectrum_sql()
DOMINANT = "dominant AS (SELECT source_id, axis, arg_max(frequency, (round(amplitude, 9), -bin)) AS frequency, arg_max(amplitude, (round(amplitude, 9), -bin)) AS amplitude FROM spectra WHERE bin > 0 GROUP BY 1, 2)"
COHERENCE = f"""WITH {SIGNALS}, {GRID}, {PAIRS}, i AS (SELECT *, k - min(k) OVER (PARTITION BY source_id) AS i FROM pairs), g AS (SELECT *, unnest([i // 8 - 1, i // 8]) AS segment FROM i),
  j AS (SELECT *, i - segment * 8 AS j, count(*) OVER (PARTITION BY source_id, segment) AS n FROM g WHERE segment >= 0),
  x AS (SELECT source_id, segment, j, (a - avg(a) OVER w) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) AS a, (b - avg(b) OVER w) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) AS b, a AS ra, b AS rb FROM j WHERE n = 16 WINDOW w AS (PARTITION BY source_id, segment)),
  p AS (SELECT source_id, segment, bin, sum(a * cos(2 * pi() * (bin * j % 16) / 16)) AS ac, sum(a * sin(2 * pi() * (bin * j % 16) / 16)) AS as_, sum(b * cos(2 * pi() * (bin * j % 16) / 16)) AS bc, sum(b * sin(2 * pi() * (bin * j % 16) / 16)) AS bs, 16e-24::DOUBLE * sum(ra * ra) AS ea, 16e-24::DOUBLE * sum(rb * rb) AS eb
    FROM x, (SELECT unnest(range(1, 9))::INT AS bin) GROUP BY 1, 2, 3),
  c AS (SELECT source_id, bin, count(*) AS segments, CASE WHEN avg(ac * ac + as_ * as_) > avg(ea) THEN avg(ac * ac + as_ * as_) ELSE 0 END AS aa, CASE WHEN avg(bc * bc + bs * bs) > avg(eb) THEN avg(bc * bc + bs * bs) ELSE 0 END AS bb, avg(ac * bc + as_ * bs) AS re, avg(as_ * bc - ac * bs) AS im FROM p GROUP BY 1, 2)
  SELECT source_id, bin, segments, round(bin / (16 * {STEP}::DOUBLE), 5) AS frequency, round(aa * {STEP}::DOUBLE / 6 * CASE WHEN bin = 8 THEN 1 ELSE 2 END, 5) AS psd_a, round(bb * {STEP}::DOUBLE / 6 * CASE WHEN bin = 8 THEN 1 ELSE 2 END, 5) AS psd_b,
    round((re * re + im * im) / nullif(aa * bb, 0), 5) AS coherence FROM c"""

QUERIES = {
    "spectrum_periodic": (spectrum_periodic, f"{S} SELECT source_id, axis, bin, round(frequency, 6) AS frequency, round(amplitude, 6) AS amplitude FROM spectra"),
    "spectrum_symmetric_detrended": (spectrum_symmetric_detrended, f"{spectrum_sql('linear', 'symmetric')} SELECT source_id, axis, bin, round(amplitude, 5) AS amplitude FROM spectra"),
    "spectrum_dominant": (spectrum_dominant, f"{S}, {DOMINANT} SELECT source_id, axis, round(frequency, 6) AS frequency, round(amplitude, 6) AS amplitude FROM dominant"),
    "spectrum_dominant_unwindowed": (spectrum_dominant_unwindowed, f"{spectrum_sql('linear', 'none')}, {DOMINANT} SELECT source_id, axis, round(frequency, 5) AS frequency, round(amplitude, 5) AS amplitude FROM dominant"),
    "spectrum_features": (spectrum_features, f"""{S}, p AS (SELECT source_id, axis, sum(amplitude^2) AS p, sum(amplitude^2 * frequency) AS pf, sum(amplitude^2 * frequency^2) AS pff, max(amplitude^2) AS top, quantile_cont(amplitude^2, 0.5) AS mid FROM spectra WHERE bin > 0 GROUP BY 1, 2)
        SELECT source_id, axis, round(pf / p, 4) AS centroid, round(sqrt(greatest(0, pff / p - (pf / p)^2)), 4) AS bandwidth, round(top / mid, 4) AS prominence FROM p"""),
    "spectrum_band": (spectrum_band, f"""{S} SELECT source_id, axis, round(max(amplitude), 6) AS top, round(arg_max(frequency, (round(amplitude, 9), -bin)), 6) AS "at", round(avg(amplitude), 6) AS mean, round(quantile_cont(amplitude, 0.5), 6) AS median, count(*) AS bins
        FROM spectra WHERE frequency BETWEEN 0.01::DOUBLE AND 0.03::DOUBLE GROUP BY 1, 2"""),
    "spectrum_nearest": (spectrum_nearest, f"""{S} SELECT source_id, axis, round(arg_min(frequency, (round(abs(frequency - 0.02::DOUBLE), 9), bin)), 6) AS frequency, round(arg_min(amplitude, (round(abs(frequency - 0.02::DOUBLE), 9), bin)), 6) AS amplitude FROM spectra GROUP BY 1, 2"""),
    "spectrum_peaks": (spectrum_peaks, f"""{S}, n AS (SELECT *, lag(amplitude) OVER w AS lo, lead(amplitude) OVER w AS hi FROM spectra WINDOW w AS (PARTITION BY source_id, axis ORDER BY bin)),
        p AS (SELECT *, row_number() OVER (PARTITION BY source_id, axis ORDER BY round(amplitude, 9) DESC, bin) AS rank FROM n WHERE amplitude > lo AND amplitude >= hi) SELECT source_id, axis, rank, round(frequency, 6) AS frequency, round(amplitude, 6) AS amplitude FROM p WHERE rank <= 3"""),
    "spectrum_harmonics": (spectrum_harmonics, f"""{S}, h AS (SELECT *, round(frequency / 0.0071::DOUBLE)::INT AS harmonic FROM spectra) SELECT source_id, axis, harmonic, round(arg_max(frequency, (round(amplitude, 9), -bin)), 6) AS frequency, round(arg_max(amplitude, (round(amplitude, 9), -bin)), 6) AS amplitude
        FROM h WHERE harmonic BETWEEN 1 AND 5 AND abs(frequency - harmonic * 0.0071::DOUBLE) <= 0.002::DOUBLE AND harmonic * 0.0071::DOUBLE <= 0.5::DOUBLE / {STEP}::DOUBLE GROUP BY 1, 2, 3"""),
    "frequency_agreement": (frequency_agreement, f"""{S}, {DOMINANT} SELECT a.source_id, round(a.frequency, 6) AS click, round(b.frequency, 6) AS view, round(100 * abs(b.frequency - a.frequency) / a.frequency, 6) AS error,
        round(abs(b.frequency - a.frequency) / greatest(abs(b.frequency), abs(a.frequency), 1e-6::DOUBLE), 6) AS difference, 100 * abs(b.frequency - a.frequency) / a.frequency <= 10 AS passed
        FROM dominant a JOIN dominant b ON a.source_id = b.source_id AND a.axis = 'click' AND b.axis = 'view'"""),
    "pair_coherence": (pair_coherence, COHERENCE),
}
