"""The library's operators as queries over the driver's tables, and their DuckDB equivalents.

Samples come from events, signals from orders; windows and bins are scaled to about ten hours between samples.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark import functions as fn
from foldspark.config import DatasetConfig, DetrendConfig, PreprocessingConfig, ProductConfig, RepresentationConfig, SearchConfig, SelectionConfig, SplitConfig, StarSelectionConfig
from foldspark.functions import sql as fsql
from foldspark.lineage import remove, settle, shared_folder
from foldspark.operators import labels, perturb, search, selection, splits, statistics, tensors, views
from foldspark.operators import timeseries as ts
from foldspark.operators.budget import spend
from foldspark.plans import api, jobs
from foldspark.plans import preprocess as prep
from foldspark.sources import products, tables
from foldspark.sources.testdata import catalog, light_curve, signals, table

GAP, WINDOW, POINTS, BINS, FACTOR = 1.0, 4.0, 3, 16, 1.5
#: Stars in a field that is searched as one source.
FIELD = 8
LABELLED = ("kepid", "kepoi_name", "label", "label_name", "training_status", "exclusion_reason")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded as the SQL rounds, by the nearest whole number of millionths, where ``round(c, 6)`` takes the decimal text."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in columns})


# SQL pieces: common table expressions that build on each other, and expressions.

_LC = """lc AS (SELECT user_id AS kepid, (epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE AS time, value AS flux, 1.0 + 0.01::DOUBLE * value AS flux_err,
  CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 16 ELSE 0 END::BIGINT AS quality,
  floor((epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE / 7)::BIGINT AS quarter, event_id FROM events)"""
_CLEAN = f"{_LC}, cl AS (SELECT * FROM lc WHERE isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND (quality & 1130799) = 0)"
_NORM = f"""{_CLEAN}, md AS (SELECT kepid, quarter, median(flux) AS median_flux FROM cl GROUP BY ALL),
nm AS (SELECT cl.kepid, time, flux / median_flux AS flux, flux_err / median_flux AS flux_err, quarter, event_id, median_flux FROM cl JOIN md USING (kepid, quarter))"""
_SEG = f"""{_NORM}, gp AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY kepid ORDER BY time, event_id) > {GAP} THEN 1 ELSE 0 END AS gap FROM nm),
sg AS (SELECT * EXCLUDE gap, (sum(gap) OVER (PARTITION BY kepid ORDER BY time, event_id ROWS UNBOUNDED PRECEDING))::INT AS segment FROM gp)"""
_CAT = """cat AS (SELECT o_custkey AS kepid, 'K' || lpad(o_orderkey::VARCHAR, 8, '0') AS kepoi_name,
  CASE o_orderstatus WHEN 'F' THEN 'FALSE POSITIVE' WHEN 'O' THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS koi_disposition,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CANDIDATE' WHEN '2' THEN 'FALSE POSITIVE' WHEN '3' THEN 'candidate ' WHEN '4' THEN 'NOT DISPOSITIONED' END AS koi_pdisposition,
  0.5::DOUBLE + (o_orderkey % 97) / 10.0::DOUBLE AS koi_period, (o_orderkey % 31) / 10.0::DOUBLE AS koi_time0bk,
  CASE WHEN o_orderkey % 23 <> 0 THEN 1.0::DOUBLE + o_orderkey % 7 END AS koi_duration, o_totalprice AS koi_depth, o_orderkey FROM orders)"""
_SIG = f"{_CAT}, sig AS (SELECT * FROM cat)"
_NORMAL = "nullif(trim(regexp_replace(upper({}), '\\s+', ' ', 'g')), '')"
_LAB = f"""{_CAT}, nrm AS (SELECT *, {_NORMAL.format("koi_disposition")} AS a, {_NORMAL.format("koi_pdisposition")} AS p FROM cat),
oc AS (SELECT *, CASE WHEN a IS NULL OR p IS NULL THEN 'missing_disposition' WHEN a = 'NOT DISPOSITIONED' OR p = 'NOT DISPOSITIONED' THEN 'not_dispositioned'
  WHEN a = 'CONFIRMED' AND p = 'CANDIDATE' THEN 'planet' WHEN a = 'FALSE POSITIVE' AND p = 'FALSE POSITIVE' THEN 'false_positive'
  WHEN a = 'CANDIDATE' AND p = 'CANDIDATE' THEN 'unresolved_candidate' ELSE 'disposition_conflict' END AS outcome FROM nrm),
lab AS (SELECT * EXCLUDE (a, p, outcome), CASE outcome WHEN 'planet' THEN 1 WHEN 'false_positive' THEN 0 END::TINYINT AS label,
  CASE WHEN outcome IN ('planet', 'false_positive') THEN outcome ELSE '' END AS label_name,
  CASE WHEN outcome IN ('planet', 'false_positive') THEN 'train_eligible' ELSE 'excluded' END AS training_status,
  CASE WHEN outcome IN ('planet', 'false_positive') THEN '' ELSE outcome END AS exclusion_reason, 'dr25_clean_v2' AS label_policy FROM oc)"""
_STRATA = f"""{_LAB}, ct AS (SELECT kepid, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) AS n_kois FROM lab GROUP BY kepid),
strata AS (SELECT *, n_kois - n_pos - n_neg AS n_excluded, CASE WHEN n_pos > 0 AND n_neg > 0 THEN 'mixed' WHEN n_pos > 0 THEN 'pos_only' WHEN n_neg > 0 THEN 'neg_only' ELSE 'unlabelled_only' END AS star_stratum FROM ct)"""
_SPLIT = f"""{_STRATA}, rk AS (SELECT *, row_number() OVER (PARTITION BY star_stratum ORDER BY md5('42:' || kepid), kepid) AS k, count(*) OVER (PARTITION BY star_stratum) AS n FROM strata),
cu AS (SELECT *, n * 0.7::DOUBLE AS s1, n * 0.15::DOUBLE AS s2, floor(n * 0.7::DOUBLE) AS f1, floor(n * 0.15::DOUBLE) AS f2 FROM rk),
sz AS (SELECT *, n - f1 - 2 * f2 AS spare, s1 - f1 AS r1, s2 - f2 AS r2 FROM cu),
sp AS (SELECT *, CASE WHEN k <= f1 + CASE WHEN (r2 > r1)::INT * 2 < spare THEN 1 ELSE 0 END THEN 'train'
  WHEN k <= f1 + CASE WHEN (r2 > r1)::INT * 2 < spare THEN 1 ELSE 0 END + f2 + CASE WHEN (r1 >= r2)::INT < spare THEN 1 ELSE 0 END THEN 'val' ELSE 'test' END AS split FROM sz),
mf AS (SELECT lab.*, split, star_stratum FROM lab JOIN (SELECT kepid, split, star_stratum FROM sp) USING (kepid))"""


def _mod(x: str, p: str) -> str:
    return f"(CASE WHEN ({x}) % ({p}) < 0 THEN (({x}) % ({p}) + ({p})) % ({p}) ELSE ({x}) % ({p}) END)"


def _fold(t: str, p: str, t0: str) -> str:
    return f"({_mod(f'{t} - {t0} + {p} / 2', p)} - {p} / 2)"


def _bin(x: str, lo: str, hi: str, n: int) -> str:
    step = f"(({hi} - {lo}) / {n})"
    g = f"floor(({x} - {lo}) / {step})"
    fixed = f"CASE WHEN {x} < {lo} + {g} * {step} THEN {g} - 1 WHEN {x} >= {lo} + ({g} + 1) * {step} THEN {g} + 1 ELSE {g} END"
    return f"greatest(0, least({n - 1}, {fixed}))::INT"


_EPH = ("koi_period", "koi_time0bk")
_FOLDED = _fold("time", *_EPH)
_JOINED = f"{_NORM}, {_SIG}, js AS (SELECT kepoi_name, koi_period, koi_time0bk, koi_duration, koi_depth, nm.* FROM nm JOIN sig USING (kepid))"


def _normalised(spark, d):
    return ts.normalize_per_quarter(ts.by_source(ts.clean(light_curve(spark, d))))


def _segmented(spark, d):
    return ts.segments(_normalised(spark, d), GAP, "event_id")


def _folded(spark, d):
    """Normalised samples of each of their star's signals."""
    known = signals(spark, d).select(
        "kepid", "kepoi_name", F.col("koi_period").alias("period"), F.col("koi_time0bk").alias("epoch"), F.col("koi_duration").alias("duration_hours"), F.col("koi_depth").alias("depth")
    )
    return _normalised(spark, d).join(known, "kepid")


def _labelled(spark, d):
    return labels.apply_label_policy(catalog(spark, d))


# Cleaning and time series.


@query(f"""WITH {_LC} SELECT kepid, count(*) AS input, count(*) FILTER (NOT (isfinite(time) AND isfinite(flux) AND isfinite(flux_err))) AS non_finite,
count(*) FILTER (isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND (quality & 1130799) <> 0) AS quality_flagged,
count(*) FILTER (isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND (quality & 1130799) = 0) AS kept FROM lc GROUP BY kepid""")
def clean_stats(spark, d):
    return ts.clean_stats(light_curve(spark, d))


@query(f"WITH {_CLEAN} SELECT kepid, event_id, round(time, 6) AS time, flux, round(flux_err, 6) AS flux_err, quality, quarter FROM cl")
def clean_rows(spark, d):
    return r6(ts.clean(light_curve(spark, d)), "time", "flux_err")


@query(f"WITH {_NORM} SELECT kepid, event_id, quarter, round(flux, 6) AS flux, round(flux_err, 6) AS flux_err, round(median_flux, 6) AS median_flux FROM nm")
def normalize_per_group(spark, d):
    return r6(_normalised(spark, d).select("kepid", "event_id", "quarter", "flux", "flux_err", "median_flux"), "flux", "flux_err", "median_flux")


@query(f"WITH {_SEG} SELECT kepid, event_id, segment FROM sg")
def segments(spark, d):
    return _segmented(spark, d).select("kepid", "event_id", "segment")


def _trend_sql(ctes: str, rows: str, usable: str) -> str:
    seen = f"CASE WHEN {usable} THEN flux END"
    frame = f"OVER (PARTITION BY kepid, segment ORDER BY time RANGE BETWEEN {WINDOW / 2}::DOUBLE PRECEDING AND {WINDOW / 2}::DOUBLE FOLLOWING)"
    part = "PARTITION BY kepid, segment"
    return f"""WITH {ctes}, sn AS (SELECT *, {seen} AS seen FROM {rows}),
es AS (SELECT *, CASE WHEN count(seen) {frame} >= {POINTS} THEN median(seen) {frame} END AS est,
  coalesce(median(seen) OVER ({part}), median(flux) OVER ({part})) AS fallback FROM sn),
nb AS (SELECT *, CASE WHEN est IS NOT NULL THEN time END AS et FROM es),
n2 AS (SELECT *, last_value(et IGNORE NULLS) OVER b AS pt, last_value(est IGNORE NULLS) OVER b AS pv, first_value(et IGNORE NULLS) OVER a AS nt, first_value(est IGNORE NULLS) OVER a AS nv FROM nb
  WINDOW b AS ({part} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({part} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT kepid, event_id, segment, round(coalesce(est, (nv - pv) / nullif(nt - pt, 0) * (time - pt) + pv, pv, nv, fallback), 6) AS trend FROM n2"""


@query(_trend_sql(_SEG, "sg", "true"))
def rolling_median_trend(spark, d):
    return r6(ts.running_median_trend(_segmented(spark, d), WINDOW, POINTS).select("kepid", "event_id", "segment", "trend"), "trend")


_ANY = f"EXISTS (SELECT 1 FROM sig WHERE sig.kepid = sg.kepid AND koi_duration IS NOT NULL AND abs({_FOLDED}) < 0.5::DOUBLE * {FACTOR} * koi_duration / 24.0::DOUBLE)"
_MASKED = f"{_SEG}, {_SIG}, mk AS (SELECT sg.*, {_ANY} AS masked FROM sg)"


def _masked(spark, d):
    return ts.mask_transits(_segmented(spark, d), prep.star_ephemerides(signals(spark, d)), FACTOR, "masked")


@query(_trend_sql(_MASKED, "mk", "NOT masked"))
def rolling_median_masked(spark, d):
    out = ts.running_median_trend(_masked(spark, d), WINDOW, POINTS, ~F.col("masked"))
    return r6(out.select("kepid", "event_id", "segment", "trend"), "trend")


@query(f"WITH {_MASKED} SELECT kepid, event_id, masked FROM mk")
def mask_all_signals(spark, d):
    return _masked(spark, d).select("kepid", "event_id", "masked")


@query(f"""WITH {_NORM}, m AS (SELECT kepid, median(flux) AS mid FROM nm GROUP BY kepid)
SELECT kepid, round(1.4826::DOUBLE * median(abs(flux - mid)), 6) AS robust_std FROM nm JOIN m USING (kepid) GROUP BY kepid""")
def robust_std(spark, d):
    return r6(statistics.robust_std(_normalised(spark, d), ["kepid"], "flux"), "robust_std")


@query(f"""WITH {_NORM}, df AS (SELECT kepid, flux - lag(flux) OVER (PARTITION BY kepid ORDER BY time, event_id) AS dv FROM nm),
m AS (SELECT kepid, median(dv) AS mid, count(*) AS n FROM df GROUP BY kepid)
SELECT kepid, any_value(n) AS n, CASE WHEN any_value(n) >= 3 THEN round(1.4826::DOUBLE * median(abs(dv - mid)) / sqrt(2.0::DOUBLE), 6) END AS sigma FROM df JOIN m USING (kepid) GROUP BY kepid""")
def point_to_point_sigma(spark, d):
    return r6(ts.point_to_point_sigma(_normalised(spark, d), tie="event_id"), "sigma")


@query(f"""WITH {_NORM}, m AS (SELECT kepid, median(flux) AS mid FROM nm GROUP BY kepid),
s AS (SELECT kepid, 1.4826::DOUBLE * median(abs(flux - mid)) AS sd FROM nm JOIN m USING (kepid) GROUP BY kepid)
SELECT kepid, event_id, flux > mid + 1.5::DOUBLE * sd AS is_outlier FROM nm JOIN m USING (kepid) JOIN s USING (kepid)""")
def upper_clip(spark, d):
    return ts.upper_outliers(_normalised(spark, d), 1.5, "flux").select("kepid", "event_id", "is_outlier")


@query(f"WITH {_JOINED} SELECT kepoi_name, event_id, round({_FOLDED}, 6) AS phase FROM js")
def phase_fold(spark, d):
    return _folded(spark, d).select("kepoi_name", "event_id", F.round(fn.phase_fold("time", "period", "epoch"), 6).alias("phase"))


@query(f"WITH {_JOINED} SELECT kepoi_name, event_id, abs({_FOLDED}) < 0.5::DOUBLE * {FACTOR} * koi_duration / 24.0::DOUBLE AS in_transit FROM js")
def in_transit_mask(spark, d):
    return _folded(spark, d).select("kepoi_name", "event_id", fn.in_transit("time", "period", "epoch", "duration_hours", FACTOR).alias("in_transit"))


@query(f"WITH {_JOINED} SELECT kepoi_name, event_id, round(1.0::DOUBLE - 0.01::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5::DOUBLE * koi_duration / 24.0::DOUBLE - abs({_FOLDED})) / (0.1::DOUBLE * 2 * (0.5::DOUBLE * koi_duration / 24.0::DOUBLE)))), 6) AS model FROM js WHERE koi_duration IS NOT NULL")
def trapezoid_transit(spark, d):
    rows = _folded(spark, d).filter("duration_hours IS NOT NULL")
    return rows.select("kepoi_name", "event_id", F.round(fn.trapezoid("time", "period", "epoch", "duration_hours", F.lit(0.01)), 6).alias("model"))


def _bins_sql(statistic: str) -> str:
    return f"""WITH {_NORM}, b AS (SELECT kepid, {_bin("time", "0.0::DOUBLE", "30.0::DOUBLE", BINS)} AS bin, flux FROM nm WHERE time >= 0 AND time <= 30),
g AS (SELECT kepid, bin, {statistic}(flux) AS value, count(*) AS n FROM b GROUP BY ALL),
a AS (SELECT kepid, bin::INT AS bin FROM (SELECT DISTINCT kepid FROM nm), range({BINS}) t(bin))
SELECT kepid, bin, 0.5::DOUBLE * ((bin * 1.875::DOUBLE) + (bin + 1) * 1.875::DOUBLE) AS centre, round(value, 6) AS value, coalesce(n, 0) AS count FROM a LEFT JOIN g USING (kepid, bin)"""


def _binned(spark, d, statistic):
    return r6(views.bin_curve(_normalised(spark, d), ["kepid"], "time", "flux", 0.0, 30.0, BINS, statistic), "value")


@query(_bins_sql("avg"))
def bin_curve_mean(spark, d):
    return _binned(spark, d, "mean")


@query(_bins_sql("median"))
def bin_curve_median(spark, d):
    return _binned(spark, d, "median")


@query(f"""WITH {_SEG}, tr AS ({_trend_sql("x AS (SELECT 1)", "sg", "true").replace("round(coalesce(", "(coalesce(").replace("fallback), 6)", "fallback))").replace("WITH x AS (SELECT 1),", "WITH")}), {_SIG},
dt AS (SELECT kepoi_name, {_FOLDED} / koi_period AS phase, flux / trend AS flat FROM sg JOIN tr USING (kepid, event_id) JOIN sig USING (kepid)),
b AS (SELECT kepoi_name, {_bin("phase", "(-0.5::DOUBLE)", "0.5::DOUBLE", BINS)} AS bin, flat FROM dt WHERE phase >= -0.5 AND phase <= 0.5 AND isfinite(flat)),
g AS (SELECT kepoi_name, bin, median(flat) AS value, count(*) AS n FROM b GROUP BY ALL),
a AS (SELECT kepoi_name, bin::INT AS bin FROM (SELECT DISTINCT kepoi_name FROM dt), range({BINS}) t(bin))
SELECT kepoi_name, bin, -0.46875::DOUBLE + bin / 16.0::DOUBLE AS centre, round(value, 6) AS value, coalesce(n, 0) AS count FROM a LEFT JOIN g USING (kepoi_name, bin)""")
def detrend_fold_bin(spark, d):
    """The flagship: clean, normalise, detrend, fold on each signal of the star, bin the phase."""
    flat = ts.running_median_trend(_segmented(spark, d), WINDOW, POINTS).select("kepid", "time", fn.quotient("flux", "trend").alias("flat"))
    known = signals(spark, d).select("kepid", "kepoi_name", "koi_period", "koi_time0bk")
    phases = flat.join(known, "kepid").withColumn("phase", fn.phase_fold("time", *_EPH) / F.col("koi_period"))
    sampled = ts.clean(light_curve(spark, d)).select("kepid").distinct()
    named = known.join(sampled, "kepid", "left_semi").select("kepoi_name")
    return r6(views.bin_curve(phases, ["kepoi_name"], "phase", "flat", -0.5, 0.5, BINS, groups=named), "value")


# Views of signals.

_VIEW = "WITH {ctes}, f AS (SELECT kepoi_name, {x} AS x, flux - 1.0::DOUBLE AS y FROM js WHERE {where}), c AS (SELECT bin::INT AS bin, {centre} AS c FROM range({n}) t(bin)) SELECT kepoi_name, bin, round(median(y), 6) AS value, count(*) AS count FROM f JOIN c ON x >= c - 0.5::DOUBLE * {width} AND x < c + 0.5::DOUBLE * {width} GROUP BY ALL"


@query(_VIEW.format(ctes=_JOINED, x=f"{_FOLDED} / koi_period", where="true", centre="-0.46875::DOUBLE + bin * 0.0625::DOUBLE", n=BINS, width="0.0625::DOUBLE"))
def global_view(spark, d):
    return r6(views.global_view(_folded(spark, d), ["kepoi_name"], BINS), "value")


@query(_VIEW.format(ctes=_JOINED, x=f"{_FOLDED} * 24.0::DOUBLE / koi_duration", where="koi_duration > 0", centre="-2.0::DOUBLE + bin * 0.25::DOUBLE", n=17, width="0.4::DOUBLE"))
def local_view(spark, d):
    return r6(views.local_view(_folded(spark, d), ["kepoi_name"], 17, 2.0, 0.4), "value")


_COUNTS = f"""{_JOINED}, c AS (SELECT bin::INT AS bin, -0.46875::DOUBLE + bin * 0.0625::DOUBLE AS c FROM range({BINS}) t(bin)),
k AS (SELECT DISTINCT kepoi_name, koi_period, koi_duration FROM js),
h AS (SELECT DISTINCT kepoi_name, bin FROM js JOIN c ON {_FOLDED} / koi_period >= c - 0.03125::DOUBLE AND {_FOLDED} / koi_period < c + 0.03125::DOUBLE),
g AS (SELECT k.*, c.bin, abs(c) AS away, h.bin IS NOT NULL AS hit, 0.5::DOUBLE * koi_duration / 24.0::DOUBLE / koi_period AS half FROM k CROSS JOIN c LEFT JOIN h ON h.kepoi_name = k.kepoi_name AND h.bin = c.bin),
q AS (SELECT *, count(*) FILTER (away < half) OVER (PARTITION BY kepoi_name) AS strict, min(away) OVER (PARTITION BY kepoi_name) AS nearest FROM g)"""


def _coverages(spark, d):
    rows = _folded(spark, d)
    wide = views.as_arrays(views.global_view(rows, ["kepoi_name"], BINS), ["kepoi_name"], BINS, "global")
    known = signals(spark, d).select("kepoi_name", "koi_period", "koi_duration")
    inside = views.transit_coverage(F.col("global_count"), F.col("koi_period"), F.col("koi_duration"), BINS)
    return wide.join(known, "kepoi_name").withColumn("global_coverage", views.coverage(F.col("global_count"))).withColumn("transit_coverage", inside)


@query(f"""WITH {_COUNTS} SELECT kepoi_name, round(avg(hit::INT), 6) AS global_coverage,
round(avg(hit::INT) FILTER (CASE WHEN strict > 0 THEN away < half ELSE away = nearest END), 6) AS transit_coverage FROM q GROUP BY kepoi_name""")
def transit_coverage(spark, d):
    return r6(_coverages(spark, d).select("kepoi_name", "global_coverage", "transit_coverage"), "global_coverage", "transit_coverage")


_INSIDE = f"abs({_FOLDED}) < 0.5::DOUBLE * 1.0 * koi_duration / 24.0::DOUBLE"


@query(f"WITH {_JOINED} SELECT kepoi_name, count(DISTINCT CASE WHEN {_INSIDE} THEN round_even((time - koi_time0bk) / koi_period, 0)::DOUBLE END) AS n_transits_observed FROM js GROUP BY kepoi_name")
def n_transits_observed(spark, d):
    return views.transits_observed(_folded(spark, d), ["kepoi_name"])


_CONTAM = f"""{_JOINED}, sib AS (SELECT kepid AS skepid, kepoi_name AS sname, koi_period AS sp, koi_time0bk AS st, koi_duration AS sd, koi_depth AS sdepth FROM sig WHERE koi_duration IS NOT NULL),
own AS (SELECT DISTINCT kepoi_name, koi_depth FROM js),
hit AS (SELECT kepoi_name, event_id, any_value(koi_period) AS p, any_value(koi_duration) AS du, any_value({_FOLDED}) AS ph,
  bool_or(abs({_fold("time", "sp", "st")}) < 0.5::DOUBLE * 1.0 * sd / 24.0::DOUBLE)::INT AS a, sum(CASE WHEN abs({_fold("time", "sp", "st")}) < 0.5::DOUBLE * 1.0 * sd / 24.0::DOUBLE THEN sdepth ELSE 0.0 END) AS dip
  FROM js JOIN sib ON skepid = kepid AND sname <> kepoi_name WHERE koi_duration IS NOT NULL GROUP BY kepoi_name, event_id),
nb AS (SELECT *, greatest(8, least(4096, ceil(2 * p * 24.0::DOUBLE / du)))::INT AS n FROM hit),
bn AS (SELECT *, greatest(0, least(n - 1, floor((ph / p + 0.5::DOUBLE) * n)))::INT AS bin FROM nb),
g AS (SELECT kepoi_name, n, p, du, bin, avg(a) AS a, avg(dip) AS dip FROM bn GROUP BY ALL),
t AS (SELECT kepoi_name, max(a) AS a, max(dip) AS m, max(dip) FILTER (abs(-0.5::DOUBLE + (bin + 0.5::DOUBLE) / n) < 0.5::DOUBLE * du / 24.0::DOUBLE / p + 0.5::DOUBLE / n) AS o FROM g GROUP BY kepoi_name)
SELECT kepoi_name, round(coalesce(a, 0.0), 6) AS contam_max_bin_fraction, round(coalesce(m, 0.0), 6) AS contam_max_expected_ppm, round(coalesce(o, 0.0), 6) AS contam_in_transit_expected_ppm,
round(CASE WHEN m IS NULL THEN 0.0 WHEN koi_depth > 0 THEN m / koi_depth END, 6) AS contam_max_relative_to_depth FROM own LEFT JOIN t USING (kepoi_name)"""


@query(f"WITH {_CONTAM}")
def contamination(spark, d):
    known = prep.signals_of(signals(spark, d)).select("kepid", "kepoi_name", "period", "epoch", "duration_hours", "depth")
    out = views.contamination(_normalised(spark, d), known)
    return r6(out, "contam_max_bin_fraction", "contam_max_relative_to_depth", "contam_max_expected_ppm", "contam_in_transit_expected_ppm")


@query(f"""WITH {_COUNTS}, np AS (SELECT kepid, count(*) AS n_points FROM nm GROUP BY kepid),
cv AS (SELECT kepoi_name, avg(hit::INT) AS gc, avg(hit::INT) FILTER (CASE WHEN strict > 0 THEN away < half ELSE away = nearest END) AS tc FROM q GROUP BY kepoi_name)
SELECT kepoi_name, CASE WHEN koi_duration IS NULL THEN 'missing_ephemeris' WHEN coalesce(n_points, 0) < 45 THEN 'insufficient_points' WHEN 2.0 * koi_duration / 24.0::DOUBLE > 0.5 THEN 'detrend_mask_too_long'
WHEN coalesce(gc, 0) < 0.9 THEN 'insufficient_global_coverage' WHEN coalesce(tc, 0) < 0.9 THEN 'insufficient_transit_coverage' ELSE 'ok' END AS example_status
FROM sig LEFT JOIN np USING (kepid) LEFT JOIN cv USING (kepoi_name)""")
def example_status(spark, d):
    r = RepresentationConfig(global_bins=BINS, local_bins=17, min_valid_points=45, min_global_coverage=0.9, min_transit_coverage=0.9, max_mask_window_days=0.5)
    sizes = _normalised(spark, d).groupBy("kepid").agg(F.count("*").alias("n_points"))
    rows = signals(spark, d).join(sizes, "kepid", "left").join(_coverages(spark, d).select("kepoi_name", "global_coverage", "transit_coverage"), "kepoi_name", "left")
    rows = rows.withColumns({"period": F.col("koi_period"), "duration_hours": F.col("koi_duration"), "mask_window_days": 2.0 * F.col("koi_duration") / 24.0})
    return rows.select("kepoi_name", prep.example_status(r).alias("example_status"))


@query(f"""WITH {_JOINED}, x AS (SELECT kepoi_name, flux, abs({_FOLDED}) * 24.0::DOUBLE / koi_duration AS x FROM js)
SELECT kepoi_name, CASE WHEN count(*) FILTER (x < 0.25) >= 3 AND count(*) FILTER (x > 1 AND x < 3) >= 10 THEN
round((median(flux) FILTER (x > 1 AND x < 3) - avg(flux) FILTER (x < 0.25)) * 1e6, 2) END AS depth_ppm FROM x GROUP BY kepoi_name""")
def folded_depth(spark, d):
    return views.folded_depth(_folded(spark, d), ["kepoi_name"]).withColumn("depth_ppm", F.round("depth_ppm", 2))


_TREND = _trend_sql(_MASKED, "mk", "NOT masked").replace("round(coalesce(", "(coalesce(").replace("fallback), 6)", "fallback))")


@query(f"""WITH t AS ({_TREND}), m AS (WITH {_MASKED} SELECT * FROM mk), j AS (SELECT m.*, trend FROM m JOIN t USING (kepid, event_id))
SELECT kepid, count(*) AS n_points, count(DISTINCT quarter) AS n_quarters, round(avg(masked::INT), 6) AS star_mask_fraction, round(stddev_pop(trend) * 1e6, 0) AS star_trend_rms_ppm FROM j GROUP BY kepid""")
def star_diagnostics(spark, d):
    rows = ts.running_median_trend(_masked(spark, d), WINDOW, POINTS, ~F.col("masked")).withColumnRenamed("masked", "in_known_transit_mask")
    return r6(prep.star_diagnostics(rows), "star_mask_fraction").withColumn("star_trend_rms_ppm", F.round("star_trend_rms_ppm", 0))


@query(f"""WITH t AS ({_TREND}), m AS (WITH {_MASKED} SELECT * FROM mk)
SELECT kepid, round(time, 6) AS time_bkjd, quarter::SMALLINT AS quarter, round(flux, 6) AS flux_norm, round(flux_err, 6) AS flux_err_norm, round(trend, 6) AS trend,
round(flux / trend, 6) AS flux_detrended, round(flux_err / trend, 6) AS flux_err_detrended, masked AS in_known_transit_mask FROM m JOIN t USING (kepid, event_id)""")
def processed_curves(spark, d):
    """Whole star processing: clean, normalise, segment, mask, detrend. Like its SQL it divides by every median."""
    detrend = DetrendConfig(window_days=WINDOW, gap_days=GAP, min_points=POINTS, mask_known_transits=True, mask_duration_factor=FACTOR)
    out = prep.preprocess(light_curve(spark, d), PreprocessingConfig(detrend=detrend, clip_upper_sigma=None), labels.apply_label_policy(signals(spark, d)), any_median=True)
    return r6(out, "time_bkjd", "flux_norm", "flux_err_norm", "trend", "flux_detrended", "flux_err_detrended")


# Catalog, labels and splits.


@query(f"WITH {_LAB} SELECT {', '.join(LABELLED)} FROM lab")
def label_policy(spark, d):
    return _labelled(spark, d).select(*LABELLED)


@query(f"WITH {_LAB} SELECT coalesce(nullif(label_name, ''), 'excluded') AS label_name, coalesce(nullif(exclusion_reason, ''), 'excluded') AS exclusion_reason, count(*) AS n FROM lab GROUP BY 1, 2")
def label_counts(spark, d):
    return labels.value_counts(_labelled(spark, d), "label_name", "exclusion_reason")


@query(f"""WITH {_CAT} SELECT koi_disposition, count(*) FILTER (koi_pdisposition = 'CANDIDATE') AS "CANDIDATE", count(*) FILTER (koi_pdisposition = 'FALSE POSITIVE') AS "FALSE POSITIVE",
count(*) FILTER (koi_pdisposition IS NULL) AS missing FROM cat GROUP BY 1""")
def disposition_crosstab(spark, d):
    return labels.crosstab(catalog(spark, d), "koi_disposition", "koi_pdisposition", ["CANDIDATE", "FALSE POSITIVE", "missing"])


@query(f"WITH {_STRATA} SELECT * FROM strata")
def star_strata(spark, d):
    return splits.star_strata(_labelled(spark, d))


@query(f"WITH {_SPLIT} SELECT kepid, star_stratum, split FROM sp")
def star_splits(spark, d):
    return splits.assign_star_splits(_labelled(spark, d)).select("kepid", "star_stratum", "split")


@query(f"WITH {_SPLIT} SELECT kepid, kepoi_name, split, star_stratum, label, label_name, training_status, exclusion_reason, label_policy, koi_disposition, koi_pdisposition FROM mf")
def split_manifest(spark, d):
    return splits.build_split_manifest(_labelled(spark, d))


@query(f"""WITH {_SPLIT}, s AS (SELECT split, count(DISTINCT kepid) AS n_kics, count(*) AS n_kois, count(*) FILTER (training_status = 'train_eligible') AS n_train_eligible_kois,
count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (training_status = 'excluded') AS n_excluded,
{", ".join(f"count(DISTINCT kepid) FILTER (star_stratum = '{s}') AS stars_{s}" for s in splits.STRATA)} FROM mf GROUP BY split)
SELECT *, round(n_positive::DOUBLE / n_train_eligible_kois, 4) AS positive_fraction, round(n_train_eligible_kois::DOUBLE / sum(n_train_eligible_kois) OVER (), 4) AS fraction_of_eligible_kois FROM s""")
def split_summary(spark, d):
    return splits.split_summary(splits.build_split_manifest(_labelled(spark, d)))


@query(f"""WITH {_SPLIT}, lk AS (SELECT kepid, kepoi_name, split FROM mf UNION ALL
SELECT kepid, kepoi_name, CASE split WHEN 'train' THEN 'val' WHEN 'val' THEN 'test' ELSE 'train' END FROM mf WHERE kepoi_name LIKE '%0'),
w AS (SELECT kepid, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM lk GROUP BY kepid)
SELECT count(*) FILTER (a AND b) AS shared_kic_train_val, count(*) FILTER (a AND c) AS shared_kic_train_test, count(*) FILTER (b AND c) AS shared_kic_val_test,
(SELECT count(*) - count(DISTINCT kepoi_name) FROM lk) AS duplicate_koi_ids FROM w""")
def leakage_check(spark, d):
    """The counts of a manifest that has been made to leak."""
    manifest = splits.build_split_manifest(_labelled(spark, d))
    moved = F.when(F.col("split") == "train", "val").when(F.col("split") == "val", "test").otherwise("train")
    return splits.leakage_counts(manifest.unionByName(manifest.filter(F.col("kepoi_name").endswith("0")).withColumn("split", moved)))


_SUBSET = f"{_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || kepoi_name), kepoi_name) AS k FROM lab WHERE label IS NOT NULL)"


@query(f"WITH {_SUBSET} SELECT kepid, kepoi_name, label, label_name, training_status, exclusion_reason FROM r WHERE k <= 30")
def select_subset(spark, d):
    return selection.select_subset(_labelled(spark, d), SelectionConfig(limit=60)).select(*LABELLED)


# 40 stars: 28, 6 and 6 by split, half of each from either pool.
_STARS = f"""{_SPLIT}, el AS (SELECT kepid, split, star_stratum, CASE star_stratum WHEN 'neg_only' THEN 'negative_only' ELSE 'has_positive' END AS pool FROM sp WHERE star_stratum <> 'unlabelled_only' AND kepid <> 1),
dr AS (SELECT *, row_number() OVER (PARTITION BY split, pool ORDER BY md5('42:' || kepid), kepid) AS r FROM el)
SELECT kepid, split, star_stratum, 'sampled' AS selection_reason FROM dr WHERE r <= CASE split WHEN 'train' THEN 14 ELSE 3 END
UNION ALL SELECT kepid, split, star_stratum, 'include_kepids' FROM sp WHERE kepid = 1"""


@query(f"WITH {_STARS}")
def select_stars(spark, d):
    return selection.select_stars(splits.build_split_manifest(_labelled(spark, d)), StarSelectionConfig(n_stars=40, include_kepids=(1,)))


@query("""WITH p AS (SELECT l_suppkey AS kepid, l_linenumber AS quarter, 'f' || lpad(l_orderkey::VARCHAR, 10, '0') AS filename FROM lineitem),
o AS (SELECT * FROM p WHERE quarter IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY kepid, quarter ORDER BY filename) = 1)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY kepid ORDER BY quarter, filename) <= 2""")
def select_products(spark, d):
    files = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("kepid"), F.col("l_linenumber").alias("quarter"), F.concat(F.lit("f"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("filename")
    )
    return selection.select_products(files, ProductConfig(quarters=(1, 3, 5), max_products_per_target=2))


@query("""SELECT o_custkey AS kepid, epoch_us(o_orderdate) AS batch, o_orderpriority AS status, o_orderkey AS "order" FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) = 1""")
def latest_status(spark, d):
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    batch = F.timestamp_diff("MICROSECOND", start, F.col("o_orderdate").cast("timestamp_ntz"))
    return selection.latest_status(table(spark, d, "orders").select(F.col("o_custkey").alias("kepid"), batch.alias("batch"), F.col("o_orderpriority").alias("status"), F.col("o_orderkey").alias("order")))


@query("""WITH n AS (SELECT 'KIC ' || lpad(o_custkey::VARCHAR, 9, '0') AS name, o_custkey FROM orders UNION ALL SELECT 'TIC ' || o_custkey, o_custkey FROM orders UNION ALL SELECT 'kic_' || o_custkey, o_custkey FROM orders)
SELECT name, nullif(regexp_extract(trim(name), '^(?:kic[\\s_-]?)?0*(\\d{1,9})$', 1, 'i'), '')::BIGINT AS kepid, 'kic_' || lpad(o_custkey::VARCHAR, 9, '0') AS dirname FROM n""")
def parse_target_id(spark, d):
    keys = table(spark, d, "orders").select("o_custkey")
    plain = F.col("o_custkey").cast("string")
    names = [F.concat(F.lit("KIC "), F.lpad(plain, 9, "0")), F.concat(F.lit("TIC "), plain), F.concat(F.lit("kic_"), plain)]
    rows = keys.select("o_custkey", F.explode(F.array(*names)).alias("name"))
    return rows.select("name", fn.target_id("name").alias("kepid"), fn.target_dirname("o_custkey").alias("dirname"))


@query(f"WITH {_CAT}, n AS (SELECT kepid, count(*) AS n_signals FROM cat GROUP BY kepid) SELECT n_signals, count(*) AS n_stars FROM n GROUP BY n_signals")
def signals_per_star(spark, d):
    return statistics.signals_per_star(catalog(spark, d))


@query(f"""WITH {_CAT} SELECT 'koi_duration' AS variable, count(*) FILTER (koi_duration IS NULL) AS missing FROM cat UNION ALL SELECT 'koi_period', 0 FROM (SELECT 1)
UNION ALL SELECT 'any', count(*) FILTER (koi_duration IS NULL) FROM cat""")
def missing_counts(spark, d):
    return statistics.missing_counts(catalog(spark, d), ["koi_duration", "koi_period"])


@query(f"WITH {_SIG} SELECT a.kepoi_name, b.kepoi_name AS sibling, b.koi_period AS sibling_period FROM sig a JOIN sig b ON a.kepid = b.kepid AND a.kepoi_name <> b.kepoi_name")
def sibling_signals(spark, d):
    listed = prep.signals_of(signals(spark, d)).select("kepoi_name", F.explode("siblings").alias("s"))
    return listed.select("kepoi_name", F.col("s.kepoi_name").alias("sibling"), F.col("s.period_days").alias("sibling_period"))


@query(f"""WITH {_SPLIT}, a AS (SELECT kepoi_name, label FROM lab WHERE kepoi_name NOT LIKE '%3'),
b AS (SELECT kepoi_name, CASE WHEN kepoi_name LIKE '%5' THEN 1 - label ELSE label END AS label FROM mf WHERE kepoi_name NOT LIKE '%7')
SELECT count(*) FILTER (b.kepoi_name IS NULL) AS only_in_catalog, count(*) FILTER (a.kepoi_name IS NULL) AS only_in_manifest,
count(*) FILTER (a.kepoi_name IS NOT NULL AND b.kepoi_name IS NOT NULL AND a.label IS DISTINCT FROM b.label) AS different_labels FROM a FULL JOIN b USING (kepoi_name)""")
def label_agreement(spark, d):
    """A catalog against a manifest that each lack signals of the other and differ in labels."""
    labelled, name = _labelled(spark, d), F.col("kepoi_name")
    manifest = splits.build_split_manifest(labelled).filter(~name.endswith("7"))
    return jobs.agree(labelled.filter(~name.endswith("3")), manifest.withColumn("label", F.when(name.endswith("5"), 1 - F.col("label")).otherwise(F.col("label"))))


# Reports of a dataset, on signals that stand for its examples.

_EXAMPLES = f"""{_SPLIT}, ex AS (SELECT mf.kepid, mf.kepoi_name, split, label, training_status, CASE WHEN kepoi_name LIKE '%1' THEN 'insufficient_points' ELSE 'ok' END AS example_status,
count(*) OVER (PARTITION BY mf.kepid) AS n_kois_on_star, cat.koi_depth / 1e5::DOUBLE AS contam FROM mf JOIN cat USING (kepoi_name))"""


def _example_rows(spark, d):
    rows = splits.build_split_manifest(_labelled(spark, d)).join(catalog(spark, d).select("kepoi_name", "koi_depth"), "kepoi_name")
    status = F.when(F.col("kepoi_name").endswith("1"), "insufficient_points").otherwise("ok")
    rows = rows.withColumn("example_status", status).withColumn("contam_max_relative_to_depth", F.col("koi_depth") / F.lit(1e5))
    return rows.withColumn("n_kois_on_star", F.count("*").over(Window.partitionBy("kepid")))


@query(f"""WITH {_EXAMPLES} SELECT kepoi_name, 'test' AS split, nullif(split, 'val') AS manifest_split FROM ex WHERE kepoi_name LIKE '%9' AND split <> 'test'""")
def split_mismatches(spark, d):
    """Examples that claim another split than the manifest, which lacks the validation split."""
    rows = _example_rows(spark, d)
    manifest = rows.filter((F.col("split") != "val") | ~F.col("kepoi_name").endswith("9"))
    claimed = rows.withColumn("split", F.when(F.col("kepoi_name").endswith("9"), "test").otherwise(F.col("split")))
    return jobs.split_mismatches(claimed, manifest)


@query(f"""WITH {_EXAMPLES}, ok AS (SELECT * FROM ex WHERE example_status = 'ok' AND training_status = 'train_eligible'),
pn AS (SELECT 'positive' AS panel, * FROM ok WHERE label = 1 UNION ALL SELECT 'negative', * FROM ok WHERE label = 0 UNION ALL SELECT 'multi', * FROM ok WHERE kepid = (SELECT min(kepid) FROM ok WHERE n_kois_on_star >= 3)),
pl AS (SELECT panel, row_number() OVER (PARTITION BY panel ORDER BY kepoi_name)::INT AS place, kepoi_name, kepid FROM pn) SELECT * FROM pl WHERE place <= 3""")
def shown_examples(spark, d):
    return jobs.shown_examples(_example_rows(spark, d))


@query(f"""WITH {_EXAMPLES}, st AS (SELECT kepid, max(contam) AS contamination FROM ex WHERE n_kois_on_star > 1 GROUP BY kepid),
pl AS (SELECT row_number() OVER (ORDER BY contamination DESC NULLS LAST, kepid)::INT AS place, * FROM st) SELECT place, kepid, round(contamination, 6) AS contamination FROM pl WHERE place <= 4""")
def contaminated_stars(spark, d):
    return r6(jobs.contaminated_stars(_example_rows(spark, d)), "contamination")


@query(f"""WITH {_LC}, {_CAT}, dl AS (SELECT kepid, quarter, flux - 22 AS flux FROM lc WHERE isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND (quality & 1130799) = 0 AND kepid % 11 <> 3),
qm AS (SELECT kepid, quarter, median(flux) AS m FROM dl GROUP BY ALL), bd AS (SELECT kepid, bool_or(m <= 0) AS bad FROM qm GROUP BY kepid),
rw AS (SELECT DISTINCT kepid FROM lc), ep AS (SELECT DISTINCT kepid FROM cat WHERE koi_period > 0 AND koi_time0bk IS NOT NULL)
SELECT c_custkey::BIGINT AS kepid, CASE WHEN rw.kepid IS NULL THEN 'no_lightcurve' WHEN bd.kepid IS NULL OR bad OR ep.kepid IS NULL THEN 'preprocessing_failed' ELSE 'ok' END AS status,
CASE WHEN rw.kepid IS NULL THEN 'no light-curve samples' WHEN bd.kepid IS NULL THEN 'all quarters were empty after cleaning' WHEN bad THEN 'a quarter''s median flux is not positive'
WHEN ep.kepid IS NULL THEN 'masking known transits needs an ephemeris' ELSE '' END AS message
FROM customer LEFT JOIN rw ON rw.kepid = c_custkey LEFT JOIN bd ON bd.kepid = c_custkey LEFT JOIN ep ON ep.kepid = c_custkey""")
def star_log(spark, d):
    """Every star processed by the masked spline or reported, with the curves shifted so that many can't be."""
    curve = light_curve(spark, d).withColumns({"flux": F.col("flux") - 22, "quality": F.when(F.col("kepid") % 11 == 3, 1).otherwise(F.col("quality")).cast("long")})
    stars = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("kepid"))
    config = PreprocessingConfig(detrend=DetrendConfig(method="robust_spline", gap_days=GAP, min_points=POINTS, knot_spacing_days=WINDOW, mask_known_transits=True))
    return prep.preprocess_stars(curve, stars, config, catalog(spark, d), "event_id")[1]


@query(f"""WITH {_SEG}, cb AS (SELECT *, 1 + 0.02::DOUBLE * x - 0.3::DOUBLE * x * x + 0.1::DOUBLE * x * x * x AS flux_cubic FROM (SELECT kepid, event_id, segment, (time - 15) / 10 AS x FROM sg))
SELECT kepid, event_id, round(CASE WHEN count(*) OVER w < 4 THEN median(flux_cubic) OVER w ELSE flux_cubic END, 6) AS trend FROM cb WINDOW w AS (PARTITION BY kepid, segment)""")
def spline_of_cubics(spark, d):
    """The clipped spline of curves that are cubics in time, whose trend is the cubic itself."""
    x = (F.col("time") - 15) / 10
    rows = _segmented(spark, d).withColumn("flux", 1 + 0.02 * x - 0.3 * x * x + 0.1 * x * x * x)
    return r6(ts.robust_spline_trend(rows, 2.0, POINTS).select("kepid", "event_id", "trend"), "trend")


@query(f"""WITH {_EXAMPLES} SELECT split, example_status, training_status, label, count(*) AS n, count(DISTINCT kepid) AS n_stars FROM ex GROUP BY ALL""")
def dataset_counts(spark, d):
    return tables.dataset_counts(_example_rows(spark, d))


@query(f"""WITH {_EXAMPLES}, ok AS (SELECT * FROM ex WHERE example_status = 'ok') SELECT round(median(contam), 6) AS median, count(*) FILTER (contam > 0.25) AS above_quarter, round(max(contam), 6) AS max FROM ok""")
def contamination_summary(spark, d):
    return r6(jobs.contamination_summary(_example_rows(spark, d)), "median", "max")


@query(f"""WITH {_CAT}, rn AS (SELECT kepid, 'r' || (o_orderkey % 5) AS run_id, (o_orderkey % 3) / 2.0::DOUBLE AS severity, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, koi_period AS period, kepoi_name FROM cat),
ok AS (SELECT * FROM rn WHERE kepid = (SELECT min(kepid) FROM rn WHERE status = 'ok') AND status = 'ok') SELECT * FROM ok WHERE run_id = (SELECT max(run_id) FROM ok)""")
def api_bls(spark, d):
    """All severities of the newest run with a result for a star."""
    key = F.col("o_orderkey")
    runs = catalog(spark, d).select("kepid", F.concat(F.lit("r"), (key % 5).cast("string")).alias("run_id"), ((key % 3) / F.lit(2.0)).alias("severity"), F.when(key % 7 == 0, "failed").otherwise("ok").alias("status"), F.col("koi_period").alias("period"), "kepoi_name")
    first = runs.filter("status = 'ok'").agg(F.min("kepid")).first()[0]
    return api.latest_runs(api.Tables(catalog(spark, d), runs=runs), f"KIC {first}")


# Products.

_FILES = """li AS (SELECT l_suppkey AS kepid, l_linenumber AS quarter, 'f' || lpad(l_orderkey::VARCHAR, 10, '0') AS filename, l_orderkey % 1000 AS size_bytes, l_orderkey FROM lineitem),
fl AS (SELECT DISTINCT filename FROM li WHERE l_orderkey % 3 <> 0),
mn AS (SELECT kepid, CASE WHEN kepid % 8 = 0 THEN 'p' ELSE 'other' END AS policy, filename FROM li WHERE kepid % 4 = 0 AND quarter = 7 AND l_orderkey % 6 <> 0),
ca AS (SELECT kepid, count(mn.filename) AS n FROM mn LEFT JOIN fl USING (filename) WHERE policy = 'p' GROUP BY kepid HAVING bool_and(fl.filename IS NOT NULL)),
o1 AS (SELECT * FROM li WHERE kepid % 5 <> 0 AND quarter IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY kepid, quarter ORDER BY filename) = 1),
o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY kepid ORDER BY quarter, filename) <= 2),
ch AS (SELECT kepid, count(*) AS n, sum(CASE WHEN fl.filename IS NULL THEN size_bytes ELSE 0 END) AS need FROM o2 LEFT JOIN fl USING (filename) GROUP BY kepid)"""


def _products(spark, d):
    """(products found, manifests, stored files) from the line items."""
    key = F.col("l_orderkey")
    name = F.concat(F.lit("f"), F.lpad(key.cast("string"), 10, "0"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("kepid"), F.col("l_linenumber").alias("quarter"), name.alias("filename"), (key % 1000).alias("size_bytes"), key.alias("key"))
    policy = F.when(F.col("kepid") % 8 == 0, "p").otherwise("other")
    manifests = rows.filter("kepid % 4 = 0 AND quarter = 7 AND key % 6 <> 0").select("kepid", policy.alias("policy"), "filename")
    return rows.filter("kepid % 5 <> 0").drop("key"), manifests, rows.filter("key % 3 <> 0").select("filename")


@query(f"WITH {_FILES} SELECT kepid, n AS n_products FROM ca")
def cached_products(spark, d):
    _, manifests, files = _products(spark, d)
    return products.cached_products(manifests, files, "p")


@query(f"""WITH {_FILES} SELECT s_suppkey AS kepid, CASE WHEN ca.kepid IS NOT NULL THEN 'cached' WHEN ch.kepid IS NULL THEN 'no_products' WHEN need > 600 THEN 'error' ELSE 'download' END AS status,
coalesce(ca.n, ch.n, 0) AS n_products, CASE WHEN ca.kepid IS NULL THEN coalesce(need, 0) ELSE 0 END::BIGINT AS needed_bytes FROM supplier LEFT JOIN ca ON ca.kepid = s_suppkey LEFT JOIN ch ON ch.kepid = s_suppkey""")
def fetch_status(spark, d):
    found, manifests, files = _products(spark, d)
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("kepid"))
    return products.fetch_status(targets, manifests, found, files, ProductConfig(quarters=(1, 3, 5), max_products_per_target=2), policy="p", budget=600)


_TURNS = """run AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS kepid, false AS fits, {budget}::BIGINT AS left_before, {budget}::BIGINT AS left_after
UNION ALL SELECT it.k, it.kepid, need <= left_after, left_after, CASE WHEN need <= left_after THEN left_after - cost ELSE left_after END FROM run JOIN it ON it.k = run.k + 1)"""


@query(f"""WITH RECURSIVE it AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey AS kepid, greatest(floor(c_acctbal), 0)::BIGINT AS need,
greatest(floor(c_acctbal), 0)::BIGINT + c_custkey % 5 AS cost FROM customer), {_TURNS.format(budget=300_000)} SELECT kepid, fits, left_before FROM run WHERE k > 0""")
def running_budget(spark, d):
    """Stars in turn against one budget, where one that doesn't fit is passed over."""
    need = F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("kepid"), need.alias("need"), (need + F.col("c_custkey") % 5).alias("cost"))
    return spend(rows, 300_000, "kepid", "need", "cost").select("kepid", "fits", "left_before")


@query(f"""WITH RECURSIVE {_FILES}, co AS (SELECT kepid, sum(size_bytes)::BIGINT AS cost FROM o2 GROUP BY kepid),
st AS (SELECT s_suppkey::BIGINT AS kepid, CASE WHEN ca.kepid IS NOT NULL THEN 'cached' WHEN ch.kepid IS NULL THEN 'no_products' ELSE 'download' END AS status,
coalesce(ca.n, ch.n, 0) AS n_products, CASE WHEN ca.kepid IS NULL THEN coalesce(need, 0) ELSE 0 END::BIGINT AS needed_bytes FROM supplier LEFT JOIN ca ON ca.kepid = s_suppkey LEFT JOIN ch ON ch.kepid = s_suppkey),
it AS (SELECT row_number() OVER (ORDER BY kepid) AS k, kepid, needed_bytes AS need, cost FROM st JOIN co USING (kepid) WHERE status = 'download'), {_TURNS.format(budget=6000)}
SELECT st.kepid, CASE WHEN run.kepid IS NULL THEN status WHEN fits THEN 'download' ELSE 'error' END AS status, n_products, needed_bytes, left_before AS left_bytes FROM st LEFT JOIN run ON run.kepid = st.kepid""")
def fetch_plan(spark, d):
    """A batch of targets in turn: each against what those before it have left of the batch's budget."""
    found, manifests, files = _products(spark, d)
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("kepid"))
    config = ProductConfig(quarters=(1, 3, 5), max_products_per_target=2)
    return products.plan_fetch(targets, manifests, found, files, 6000, config, policy="p").drop("message")


def _refuse(uri: str) -> bytes:
    """The bytes of a product's address; one in forty can't be had."""
    if int(uri.rsplit("f", 1)[1]) % 40 == 0:
        raise OSError(f"refused {uri}")
    return uri.encode()


@query(f"""WITH {_FILES}, wt AS (SELECT kepid, filename, quarter, 'mast:' || kepid || '/' || filename AS uri, l_orderkey % 40 = 0 AS bad, row_number() OVER (PARTITION BY kepid ORDER BY quarter, filename) AS k FROM o2),
ft AS (SELECT kepid, min(k) FILTER (bad) AS stop FROM wt GROUP BY kepid)
SELECT kepid, CASE WHEN stop IS NULL THEN 'downloaded' ELSE 'error' END AS status, coalesce(stop - 1, max(k))::BIGINT AS n_products, sum(strlen(uri)) FILTER (stop IS NULL OR k < stop)::BIGINT AS new_bytes,
CASE WHEN stop IS NOT NULL THEN 'download failed: refused ' || max(uri) FILTER (k = stop) END AS message, CASE WHEN stop IS NULL THEN min(sha256(uri)) END AS first_sha256 FROM wt JOIN ft USING (kepid) GROUP BY kepid, stop""")
def stored_fetch(spark, d):
    """Products written to the shared folder by the executors, with manifests of those stars that have all of theirs."""
    found, _, _ = _products(spark, d)
    chosen = selection.select_products(found, ProductConfig(quarters=(1, 3, 5), max_products_per_target=2))
    wanted = chosen.withColumn("data_uri", F.concat(F.lit("mast:"), F.col("kepid").cast("string"), F.lit("/"), "filename"))
    root = f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}"
    done = products.fetch(wanted, root, _refuse, "p")
    listed = products.read_manifests(spark, root, done).groupBy("kepid").agg(F.min("sha256").alias("first_sha256"))
    bytes_ = F.nullif("new_bytes", F.lit(0)).alias("new_bytes")
    out = settle(done.join(listed, "kepid", "left").select("kepid", "status", "n_products", bytes_, "message", "first_sha256"))
    remove(spark, root)
    return out


# Statistics.

_BIAS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_BIAS_SQL = f"""WITH lg AS ({" UNION ALL ".join(f"SELECT '{v}' AS variable, l_returnflag = 'A' AS pos, {v} AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')" for v in _BIAS)}),
su AS (SELECT variable, count(x) FILTER (pos) AS n_pos, count(*) FILTER (pos AND x IS NULL) AS missing_pos, median(x) FILTER (pos) AS median_pos, quantile_cont(x, 0.1) FILTER (pos) AS p10_pos, quantile_cont(x, 0.9) FILTER (pos) AS p90_pos,
count(x) FILTER (NOT pos) AS n_neg, count(*) FILTER (NOT pos AND x IS NULL) AS missing_neg, median(x) FILTER (NOT pos) AS median_neg, quantile_cont(x, 0.1) FILTER (NOT pos) AS p10_neg, quantile_cont(x, 0.9) FILTER (NOT pos) AS p90_neg FROM lg GROUP BY variable),
vl AS (SELECT variable, x, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM lg WHERE x IS NOT NULL GROUP BY ALL),
cm AS (SELECT variable, p, q, (sum(p) OVER w)::BIGINT AS pu, (sum(q) OVER w)::BIGINT AS qu FROM vl WINDOW w AS (PARTITION BY variable ORDER BY x ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT variable, max(abs(pu::DOUBLE / n_pos - qu::DOUBLE / n_neg)) AS ks, sum(p * (2 * qu - q))::DOUBLE / (2.0::DOUBLE * any_value(n_pos) * any_value(n_neg)) AS auc FROM cm JOIN su USING (variable) GROUP BY variable)
SELECT variable, n_pos, n_neg, missing_pos, missing_neg, {", ".join(f"round({c}, 6) AS {c}" for c in ("median_pos", "median_neg", "p10_pos", "p90_pos", "p10_neg", "p90_neg"))},
round(ks, 6) AS ks_statistic, round(auc, 6) AS univariate_auc, round(greatest(auc, 1 - auc), 6) AS separability FROM su JOIN cv USING (variable)"""


@query(_BIAS_SQL)
def bias_table(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).withColumn("label", F.when(F.col("l_returnflag") == "A", 1).otherwise(0))
    out = statistics.bias_table(rows, list(_BIAS))
    return r6(out, "median_pos", "median_neg", "p10_pos", "p90_pos", "p10_neg", "p90_neg", "ks_statistic", "univariate_auc", "separability")


@query("""WITH v AS (SELECT l_returnflag, least(floor((l_quantity - 1.0::DOUBLE) / 49.0::DOUBLE * 20), 19)::INT AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50),
g AS (SELECT l_returnflag, bin, count(*) AS n FROM v GROUP BY ALL) SELECT l_returnflag, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 6) AS weight FROM g""")
def histogram(spark, d):
    return r6(statistics.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 1.0, 50.0, 20), "weight")


_RESULTS = "SELECT l_returnflag AS \"case\", l_linestatus AS method, l_discount - 0.05::DOUBLE AS relative_depth_error, l_tax AS trend_error_rms_ppm FROM lineitem"


def _results(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("method"), (F.col("l_discount") - 0.05).alias("relative_depth_error"), F.col("l_tax").alias("trend_error_rms_ppm"))


@query(f"""WITH r AS ({_RESULTS}) SELECT "case", method, round(avg(relative_depth_error), 6) AS mean_error, round(sqrt(avg(relative_depth_error * relative_depth_error)), 6) AS rms_error,
round(max(abs(relative_depth_error)), 6) AS max_abs_error, round(avg(trend_error_rms_ppm), 6) AS mean_trend_error_rms_ppm FROM r GROUP BY ALL""")
def synthetic_summary(spark, d):
    return r6(statistics.error_summary(_results(spark, d), ["case", "method"]), "mean_error", "rms_error", "max_abs_error", "mean_trend_error_rms_ppm")


@query(f"""WITH r AS ({_RESULTS}) SELECT "case", round(avg(relative_depth_error) FILTER (method = 'F'), 6) AS "F", round(avg(relative_depth_error) FILTER (method = 'O'), 6) AS "O" FROM r GROUP BY ALL""")
def pivot_methods(spark, d):
    return r6(statistics.pivot_methods(_results(spark, d), "case", "method", "relative_depth_error", ["F", "O"]), "F", "O")


@query("""SELECT round(median(l_discount), 6) AS median_l_discount, round(median(l_tax), 6) AS median_l_tax, round(median(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 6) AS median_ratio,
round(avg(CASE WHEN l_tax <> 0 THEN (l_discount / l_tax > 1)::INT END), 6) AS fraction_greater FROM lineitem""")
def ratio_summary(spark, d):
    return r6(statistics.ratio_summary(table(spark, d, "lineitem"), "l_discount", "l_tax"), "median_l_discount", "median_l_tax", "median_ratio", "fraction_greater")


# Arrays.

_ARRAY = """v AS (SELECT vec_id, embedding AS e, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings),
o AS (SELECT *, CASE WHEN i % 7 <> 0 THEN i END AS oi FROM v),
w AS (SELECT *, max(oi) OVER (PARTITION BY vec_id ORDER BY i) AS pi, min(oi) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
min(oi) OVER (PARTITION BY vec_id) AS first, max(oi) OVER (PARTITION BY vec_id) AS last FROM o),
f AS (SELECT vec_id, i, n, oi, coalesce(pi, last - n) AS pi, coalesce(ni, first + n) AS ni, e[coalesce(pi, last) + 1]::DOUBLE AS pv, e[coalesce(ni, first) + 1]::DOUBLE AS nv, e[i + 1]::DOUBLE AS x FROM w)"""


def _gappy(spark, d):
    counts = F.transform("embedding", lambda v, i: F.when(i % 7 == 0, 0).otherwise(1))
    return table(spark, d, "embeddings").select("vec_id", "embedding", counts.alias("count"))


@query(f"WITH {_ARRAY} SELECT vec_id, i::INT AS bin, round(CASE WHEN oi IS NOT NULL THEN x ELSE (nv - pv) / (ni - pi) * (i - pi) + pv END, 6) AS filled FROM f")
def fill_missing(spark, d):
    out = tensors.fill_missing(_gappy(spark, d), ["vec_id"], "embedding", "count", circular=True)
    return out.select("vec_id", F.posexplode("embedding_filled").alias("bin", "filled")).withColumn("filled", F.round("filled", 6))


@query(f"""WITH {_ARRAY}, s AS (SELECT vec_id, median(x) FILTER (oi IS NOT NULL) AS m, min(x) FILTER (oi IS NOT NULL) AS l FROM f GROUP BY vec_id)
SELECT vec_id, i::INT AS bin, round((x - m) / (m - l), 5) AS scaled FROM f JOIN s USING (vec_id)""")
def normalize_view(spark, d):
    rows = _gappy(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rows.select("vec_id", F.posexplode(tensors.normalize_view(F.col("embedding"), F.col("count"))).alias("bin", "scaled")).withColumn("scaled", F.round("scaled", 5))


# Period search.


@query(f"""WITH {_LC}, b AS (SELECT kepid, max(time) - min(time) AS baseline FROM lc GROUP BY kepid),
n AS (SELECT *, ceil(ln(10.0::DOUBLE / 0.5::DOUBLE) / (0.5::DOUBLE / (2.0::DOUBLE * baseline)))::BIGINT + 1 AS n FROM b), k AS (SELECT kepid, n, unnest(range(n)) AS k FROM n)
SELECT kepid, k, round(exp(ln(0.5::DOUBLE) + k * ((ln(10.0::DOUBLE) - ln(0.5::DOUBLE)) / greatest(n - 1, 1))), 6) AS period FROM k""")
def period_grid(spark, d):
    spans = light_curve(spark, d).groupBy("kepid").agg((F.max("time") - F.min("time")).alias("baseline"))
    return r6(search.period_grid(spans, 0.5, 10.0, 0.5, 2.0).select("kepid", "k", "period"), "period")


_RATIO = "(0.5::DOUBLE + (o_orderkey % 89) / 10.0::DOUBLE) / koi_period"


def _relation_sql(what: Callable[[int, int], str], none: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({_RATIO} - {n / m!r}::DOUBLE) / {n / m!r}::DOUBLE <= 0.01 THEN {what(n, m)}" for n, m in fn.fractions()) + f" ELSE {none} END"


_RELATED = f"""{_CAT}, rel AS (SELECT kepid, kepoi_name, {_RATIO} AS ratio, {_relation_sql(lambda n, m: "'match'" if n == m else "'harmonic'", "'none'")} AS relation,
{_relation_sql(lambda n, m: f"'{n}/{m}'", "NULL")} AS harmonic, {_relation_sql(lambda n, m: f"abs({_RATIO} - {n / m!r}::DOUBLE) / {n / m!r}::DOUBLE", f"abs({_RATIO} - 1.0)")} AS relative_error FROM cat)"""


def _related(spark, d):
    rows = catalog(spark, d).withColumn("found", F.lit(0.5) + (F.col("o_orderkey") % 89) / F.lit(10.0))
    return rows.select("kepid", "kepoi_name", fn.relate_periods("found", "koi_period", rel_tol=0.01).alias("c")).select("kepid", "kepoi_name", "c.*")


@query(f"WITH {_RELATED} SELECT kepid, kepoi_name, round(ratio, 6) AS ratio, relation, harmonic, round(relative_error, 6) AS relative_error FROM rel")
def compare_periods(spark, d):
    return r6(_related(spark, d), "ratio", "relative_error")


@query(f"WITH {_RELATED} SELECT kepid, kepoi_name, relation, round(relative_error, 6) AS relative_error FROM rel QUALIFY row_number() OVER (PARTITION BY kepid ORDER BY relative_error, kepoi_name) = 1")
def closest_signal(spark, d):
    one = F.min(F.struct("relative_error", "kepoi_name", "relation")).alias("c")
    return r6(_related(spark, d).groupBy("kepid").agg(one).select("kepid", "c.*"), "relative_error")


_SERIES = f"{_LC}, se AS (SELECT kepid, row_number() OVER (PARTITION BY kepid ORDER BY time, event_id) - 1 AS k, time AS period, flux AS power FROM lc)"


_GRID = f"""ceil(ln(20.0::DOUBLE) / (0.5::DOUBLE / (2.0::DOUBLE * baseline)))::BIGINT + 1"""


@query(f"""WITH {_NORM}, sp AS (SELECT kepid, max(time) - min(time) AS baseline, count(*) AS n FROM nm GROUP BY kepid), gd AS (SELECT kepid, {_GRID} AS size FROM sp WHERE baseline > 0),
pr AS (SELECT kepid, size, unnest(range(size)) AS k FROM gd), fm AS (SELECT js.kepid, kepoi_name, koi_period AS period, koi_time0bk AS epoch, koi_duration AS duration_hours, time, flux FROM js),
st AS (SELECT kepid, median(flux) AS mid FROM nm GROUP BY kepid), sd AS (SELECT nm.kepid, 1.4826::DOUBLE * median(abs(flux - mid)) AS s FROM nm JOIN st USING (kepid) GROUP BY nm.kepid),
inn AS (SELECT kepid, count(*) FILTER (abs({_fold("time", "period", "epoch")}) < 0.5 * 1.5 * duration_hours / 24) AS in_transit FROM fm GROUP BY kepid)
SELECT pr.kepid, count(*) AS n_periods, round(sum(exp(ln(0.5::DOUBLE) + k * ((ln(10.0::DOUBLE) - ln(0.5::DOUBLE)) / greatest(size - 1, 1)))), 4) AS sum_periods, round(any_value(s), 6) AS robust_std, coalesce(any_value(in_transit), 0) AS in_transit
FROM pr JOIN sd USING (kepid) LEFT JOIN inn USING (kepid) GROUP BY pr.kepid""".replace(_NORM, _JOINED))
def sql_functions(spark, d):
    """The registered functions in SQL text: a lateral join with the grid's table function, an aggregate and a predicate."""
    fsql.register(spark)
    _normalised(spark, d).createOrReplaceTempView("fs_curve")
    signals(spark, d).createOrReplaceTempView("fs_signals")
    return spark.sql("""
        WITH spans AS (SELECT kepid, max(time) - min(time) AS baseline, robust_std(collect_list(flux)) AS s FROM fs_curve GROUP BY kepid),
        grids AS (SELECT kepid, s, k, period FROM spans, LATERAL period_grid(baseline, 0.5D, 10D, 0.5D, 2D)),
        hits AS (SELECT c.kepid, count_if(in_transit(time, koi_period, koi_time0bk, koi_duration)) AS in_transit FROM fs_curve c JOIN fs_signals USING (kepid) GROUP BY c.kepid)
        SELECT kepid, count(*) AS n_periods, round(sum(period), 4) AS sum_periods, round(any_value(s), 6) AS robust_std, coalesce(any_value(in_transit), 0L) AS in_transit
        FROM grids LEFT JOIN hits USING (kepid) GROUP BY kepid""")


def _series(spark, d):
    k = F.row_number().over(Window.partitionBy("kepid").orderBy("time", "event_id")).cast("long") - 1
    return light_curve(spark, d).select("kepid", k.alias("k"), F.col("time").alias("period"), F.col("flux").alias("power"))


@query(f"""WITH {_SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY kepid) AS n FROM se), r AS (SELECT *, CASE WHEN n <= 20 THEN k ELSE ((k + 1) * 20 - 1) // n END AS run FROM n)
SELECT kepid, run, round(period, 6) AS period, power FROM r QUALIFY row_number() OVER (PARTITION BY kepid, run ORDER BY power DESC, k) = 1""")
def periodogram_pool(spark, d):
    return r6(search.pool_periodogram(_series(spark, d), ["kepid"], 20), "period")


@query(f"""WITH {_SERIES}, s AS (SELECT kepid, max(power) AS mx, avg(power) AS mn, stddev_pop(power) AS sd, count(*) AS n FROM se GROUP BY kepid)
SELECT kepid, round(period, 6) AS period, power, n AS n_periods, round((mx - mn) / sd, 6) AS sde FROM se JOIN s USING (kepid) WHERE power = mx QUALIFY row_number() OVER (PARTITION BY kepid ORDER BY k) = 1""")
def best_peak(spark, d):
    return r6(search.best_peaks(_series(spark, d), ["kepid"]).select("kepid", "period", "power", "n_periods", "sde"), "period", "sde")


# Read side.


def _tables(spark, d):
    curve = _normalised(spark, d)
    processed = curve.select("kepid", F.col("time").alias("time_bkjd"), "quarter", F.col("flux").alias("flux_norm"), F.lit(1.0).alias("trend"), F.col("flux").alias("flux_detrended"))
    return api.Tables(catalog(spark, d), processed)


@query(f"WITH {_CLEAN} SELECT true AS catalog_available, count(DISTINCT kepid) AS n_processed FROM cl")
def api_health(spark, d):
    return api.health(_tables(spark, d))


@query(f"""WITH {_CAT}, {_CLEAN} SELECT kepid, 'KIC ' || kepid AS target_id, count(*) AS n_kois, string_agg(DISTINCT koi_disposition, ',' ORDER BY koi_disposition) AS dispositions,
kepid IN (SELECT kepid FROM cl) AS has_lightcurve, false AS has_bls FROM cat GROUP BY kepid""")
def api_targets(spark, d):
    return api.targets(_tables(spark, d)).withColumn("dispositions", F.array_join("dispositions", ","))


@query(f"WITH {_CAT} SELECT kepid, count(*) AS n_kois, string_agg(kepoi_name, ',' ORDER BY kepoi_name) AS kois FROM cat WHERE kepid = 1 GROUP BY kepid")
def api_target(spark, d):
    return api.target(_tables(spark, d), "KIC 1").withColumn("kois", F.array_join(F.transform("kois", lambda k: k["kepoi_name"]), ","))


@query(f"WITH {_NORM} SELECT kepid, round(time, 6) AS time_bkjd, round(flux, 6) AS flux_norm, 1.0::DOUBLE AS trend, round(flux, 6) AS flux_detrended, quarter FROM nm WHERE kepid = 1")
def api_lightcurve(spark, d):
    return r6(api.light_curve(_tables(spark, d), "1"), "time_bkjd", "flux_norm", "flux_detrended")


@query(f"""WITH {_NORM}, f AS (SELECT kepid // {FIELD} AS kepid, time, flux, quarter FROM nm WHERE kepid // {FIELD} = 1), s AS (SELECT min(time) AS lo, max(time) AS hi FROM f),
b AS (SELECT f.*, {_bin("time", "lo", "hi", 100)} AS bin FROM f, s)
SELECT kepid, bin, round(avg(time), 6) AS time_bkjd, round(avg(flux), 6) AS flux_norm, 1.0::DOUBLE AS trend, round(avg(flux), 6) AS flux_detrended, round_even(avg(quarter), 0)::INT AS quarter FROM b GROUP BY kepid, bin""")
def api_lightcurve_binned(spark, d):
    """The second field of stars, whose samples are more than the points asked for."""
    tables = _tables(spark, d)
    field = tables.processed.withColumn("kepid", F.floor(F.col("kepid") / FIELD).cast("long"))
    return r6(api.light_curve(api.Tables(tables.catalog, field), "1", max_points=100), "time_bkjd", "flux_norm", "flux_detrended")


@query(f"""WITH {_NORM}, e AS (SELECT -(least(24.0::DOUBLE, 12.0::DOUBLE * koi_period)) AS lo, koi_period AS p, koi_time0bk AS t0 FROM (SELECT * FROM ({"WITH " + _CAT} SELECT * FROM cat) WHERE kepid = 1 ORDER BY kepoi_name LIMIT 1)),
h AS (SELECT kepid, {_fold("time", "p", "t0")} * 24.0::DOUBLE AS x, flux, lo FROM nm, e WHERE kepid = 1), i AS (SELECT * FROM h WHERE abs(x) <= -lo),
b AS (SELECT kepid, {_bin("x", "lo", "(-lo)", 12)} AS bin, flux FROM i), g AS (SELECT kepid, bin, median(flux) AS v, count(*) AS n FROM b GROUP BY ALL),
a AS (SELECT 1::BIGINT AS kepid, bin::INT AS bin FROM range(12) t(bin))
SELECT kepid, bin, round(v, 6) AS value, coalesce(n, 0) AS count FROM a LEFT JOIN g USING (kepid, bin)""")
def api_phase_folded(spark, d):
    _, binned = api.phase_folded(_tables(spark, d), "KIC 1", bins=12)
    return r6(binned.select("kepid", "bin", "value", "count"), "value")


# Kernels that SQL can't express: rows only, with property tests.


@query()
def robust_spline_trend(spark, d):
    return ts.robust_spline_trend(_segmented(spark, d), knot_spacing_days=5.0, min_points=POINTS).select("kepid", "event_id", "segment", "trend")


@query()
def gaussian_noise(spark, d):
    return perturb.gaussian_noise(_normalised(spark, d).drop("median_flux"), 0.5)


def _fields(spark, d):
    """Fields of eight neighbouring stars, as one star's samples are too few to search; fields grow with the stars."""
    return _normalised(spark, d).withColumn("kepid", F.floor(F.col("kepid") / FIELD).cast("long"))


_SEARCH = SearchConfig(min_period_days=1.0, max_period_days=10.0, durations_hours=(6.0, 12.0), chunk=256)


@query()
def bls_search(spark, d):
    inputs = settle(search.search_inputs(_fields(spark, d), ["kepid"], _SEARCH))
    found = search.periodogram(inputs, ["kepid"], _SEARCH)
    return inputs.select("kepid", "status", "n_points").join(search.best_peaks(found, ["kepid"]), "kepid", "left")


@query(f"""WITH RECURSIVE {_SERIES}, o AS (SELECT kepid, period, power, row_number() OVER (PARTITION BY kepid ORDER BY power DESC, period DESC) AS r FROM se WHERE period > 0),
g AS (SELECT kepid, r, [{{'p': period, 'q': power}}] AS taken FROM o WHERE r = 1 UNION ALL
SELECT o.kepid, o.r, CASE WHEN len(taken) >= 5 OR len(list_filter(taken, lambda t: abs(period - t.p) / t.p <= 0.01)) > 0 THEN taken ELSE list_append(taken, {{'p': period, 'q': power}}) END
FROM g JOIN o ON o.kepid = g.kepid AND o.r = g.r + 1), e AS (SELECT kepid, arg_max(taken, r) AS taken FROM g GROUP BY kepid), u AS (SELECT kepid, taken, unnest(range(len(taken))) AS i FROM e)
SELECT kepid, i::INT AS place, round(taken[i + 1].p, 6) AS period_days, taken[i + 1].q AS power FROM u""")
def top_peaks(spark, d):
    found = search.top_peaks(_series(spark, d).filter("period > 0"), ["kepid"], k=5, apart=0.01)
    return r6(found.select("kepid", F.posexplode("top_peaks").alias("place", "peak")).select("kepid", "place", "peak.*"), "period_days")


@query()
def examples(spark, d):
    r = RepresentationConfig(global_bins=BINS, local_bins=11, local_bin_width_durations=1.0, min_valid_points=45)
    detrend = DetrendConfig(window_days=WINDOW, gap_days=GAP, min_points=POINTS, mask_known_transits=True)
    config = DatasetConfig(preprocessing=PreprocessingConfig(detrend=detrend), representation=r, stars=StarSelectionConfig(all_eligible=True), splits=SplitConfig())
    known = signals(spark, d)
    manifest = splits.build_split_manifest(labels.apply_label_policy(known), config.splits)
    return jobs.build_dataset(light_curve(spark, d), known, manifest, config)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
