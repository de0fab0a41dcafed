"""Queries of signal preparation and feature extraction over events and embeddings, with their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions import arrays as A
from rillwave.operators import signal as S

from .tables import SAMPLES_SQL, WINDOWS_SQL, annotations, annotations_sql, r6, samples, table, windows

DAYS = 30 * 86400.0
RATE = 128.0
KERNEL = np.array([1, 2, 3, 2, 1]) / 9


def _labelled(spark: SparkSession, d: str, length: float, step: float, label: S.Label) -> DataFrame:
    return S.label_grid(table(spark, d, "events").select("user_id").distinct(), annotations(spark, d), ["user_id"], length, step, F.lit(DAYS), label)


def window_label_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, 14400, 7200, S.overlap_label(1800, 14400)).select("user_id", "t_start", "label")


def window_label_fraction(spark: SparkSession, d: str) -> DataFrame:
    out = _labelled(spark, d, 3600, 1800, S.fraction_label(3600, 0.5, 9000))
    return out.groupBy("user_id", "label").agg(F.count("*").alias("windows"), F.min("t_start").alias("first_start"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = S.sliding_windows(samples(spark, d), 16, 8, ["user_id"])
    return out.select("user_id", F.col("window_index").cast("long").alias("window_index"), F.col("start").cast("long").alias("start"), r6(A.mean(F.col("x"))).alias("mean"), r6(F.element_at("x", 1)).alias("first"), "exclusive")


def short_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.long_enough(samples(spark, d), ["user_id"], 64).groupBy("user_id").agg(F.count("*").alias("n"))


def index_map(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    offsets = S.row_offsets(ev.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    rows = ev.count()
    wanted = ev.select((F.col("event_id") * 3 - rows).alias("index"))
    return S.locate(wanted, offsets, "user_id", "index", rows, 64)


def car_reference(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    return S.average_reference(s, ["user_id", "day"]).select("event_id", r6(F.col("value")).alias("value"))


def fir_smooth(spark: SparkSession, d: str) -> DataFrame:
    return S.fir_filter(samples(spark, d), KERNEL, ["user_id"], chunk=32).select("event_id", r6(F.col("filtered")).alias("filtered"))


def resample(spark: SparkSession, d: str) -> DataFrame:
    low = S.fir_filter(samples(spark, d), KERNEL, ["user_id"])
    return S.decimate(low, 4).select("user_id", "idx", r6(F.col("filtered")).alias("value"))


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return S.resample_linear(samples(spark, d), 1.5, ["user_id"]).select("user_id", F.col("idx").cast("long").alias("idx"), r6(F.col("value")).alias("value"))


def band_filters(spark: SparkSession, d: str) -> DataFrame:
    """Band pass 0.5 to 40 Hz, then a 50 Hz notch, at 256 Hz."""
    s = samples(spark, d).select("user_id", "idx", "value")
    for kernel in (S.sinc_kernel(256, 0.5, 40, 845), S.notch_kernel(256, 50, 2, 845)):
        s = S.fir_filter(s, kernel, ["user_id"]).select("user_id", "idx", F.col("filtered").alias("value"))
    return s.select("user_id", "idx", r6(F.col("value")).alias("value"))


def resample_rational(spark: SparkSession, d: str) -> DataFrame:
    """250 Hz to 128 Hz: 64 phases, every 125th of them."""
    kernel = S.resampling_kernel(64, 125, 250, 2080)
    return S.resample_rational(samples(spark, d).select("user_id", "idx", "value"), 64, 125, kernel, ["user_id"]).select("user_id", "idx", r6(F.col("value")).alias("value"))


def preictal_interval(spark: SparkSession, d: str) -> DataFrame:
    return S.preictal_intervals(annotations(spark, d)).select("user_id", *[r6(F.col(c)).alias(c) for c in ("onset", "window_start", "window_end", "window_duration")])


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    out = _labelled(spark, d, 14400, 7200, S.overlap_label(1800, 14400))
    return out.groupBy("user_id").agg(F.count("*").alias("n_windows"), *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n_{c}") for c in range(3)])


def fit_shape(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumn("s", A.fit_shape(F.array("x"), 2, 80)).withColumn("t", A.fit_shape(F.array("x", "x", "x"), 2, 40))
    flat = lambda c: r6(A.total(F.flatten(c)))
    return w.select("vec_id", F.size("s").alias("channels"), F.size(F.element_at("s", 1)).alias("length"), flat("s").alias("padded"), F.size(F.element_at("t", 2)).alias("cut_length"), flat("t").alias("cut"))


def zscore(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d)
    parts = [w.select("vec_id", F.lit(m).alias("mode"), A.zscore(F.col("x"), m).alias("z")) for m in "abcde"]
    return reduce(DataFrame.unionByName, parts).select("vec_id", "mode", r6(F.element_at("z", 1)).alias("first"), r6(F.element_at("z", -1)).alias("last"), r6(A.power_sum(F.col("z"), F.lit(0.0), 2)).alias("sum_squares"))


def nonfinite(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a value that is not finite; every seventh is made so by a division by zero as floats do it."""
    w = windows(spark, d).withColumn("x", F.transform("x", lambda v: F.when(F.col("vec_id") % 7 == 0, F.when(v > 0, float("inf")).otherwise(v)).otherwise(v)))
    return w.groupBy("patient").agg(F.count("*").alias("windows"), F.sum(F.when(A.all_finite(F.col("x")), 0).otherwise(1)).alias("rejected"))


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return S.welch_psd(windows(spark, d).withColumn("x", A.zscore(F.col("x"), "d")), "x", RATE)


def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    p = _spectra(spark, d)
    return p.select("vec_id", "psd_step", F.posexplode("psd").alias("bin", "power")).select("vec_id", "bin", r6(F.col("bin") * F.col("psd_step")).alias("hz"), r6(F.col("power")).alias("power"))


def band_power(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("vec_id", *[r6(A.band_power(F.col("psd"), F.col("psd_step"), b)).alias(b) for b in A.BANDS])


def spectral_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("vec_id", r6(A.spectral_entropy(F.col("psd"), F.col("psd_step"))).alias("spectral_entropy"))


def hjorth(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("vec_id", r6(A.mobility(F.col("x"))).alias("mobility"), r6(A.complexity(F.col("x"))).alias("complexity"))


def line_length(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("vec_id", r6(A.line_length(F.col("x"))).alias("line_length"))


def skew_kurt(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("vec_id", r6(A.skewness(F.col("x"))).alias("skewness"), r6(A.kurtosis(F.col("x"))).alias("kurtosis"))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, patient, label, the eleven features) of the normalised windows."""
    made = A.features(F.col("x"), F.col("psd"), F.col("psd_step"))
    return _spectra(spark, d).select("vec_id", "patient", "label", *[v.alias(k) for k, v in made.items()])


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """Long form of the vectors: name is <channel>__<feature>."""
    t = feature_table(spark, d)
    names = F.array(*[F.lit(f"ch1__{k}") for k in A.FEATURES])
    pairs = F.arrays_zip(names.alias("name"), F.array(*A.FEATURES).alias("value"))
    return t.select("vec_id", F.inline(pairs)).withColumn("value", r6(F.col("value")))


def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per patient and in total: windows, class counts, all features finite; patient NULL is the total."""
    t = feature_table(spark, d)
    ok = reduce(lambda a, b: a & b, [A.is_finite(F.col(k)) for k in A.FEATURES])
    return t.rollup("patient").agg(F.count("*").alias("n_windows"), *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n_{c}") for c in range(3)], F.bool_and(ok).alias("all_finite"), r6(F.avg("line_length")).alias("mean_line_length"))


def standardise(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation from training patients; deviations under 1e-8 count as 1; summed over the others."""
    t = windows(spark, d).select("patient", "vec_id", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"), F.lit(3.0).alias("c"))
    stats = t.where("patient % 4 <> 0").agg(*[f(k).alias(f"{n}_{k}") for k in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = t.where("patient % 4 = 0").crossJoin(F.broadcast(stats))
    z = {k: (F.col(k) - F.col(f"m_{k}")) / F.when(F.col(f"s_{k}") < 1e-8, 1.0).otherwise(F.col(f"s_{k}")) for k in "abc"}
    return out.select("vec_id", *[r6(v).alias(f"z_{k}") for k, v in z.items()])


QUERIES = {
    f.__name__: f
    for f in (
        window_label_overlap, window_label_fraction, sliding_windows, short_filter, index_map, car_reference, fir_smooth, resample, resample_rational, resample_linear, band_filters, preictal_interval, class_counts,
        fit_shape, zscore, nonfinite, welch_psd, band_power, spectral_entropy, hjorth, line_length, skew_kurt, feature_vector, feature_summary, standardise,
    )
}


def _grid_sql(length: float, step: float) -> str:
    return f"grid AS (SELECT user_id, k*{step}::DOUBLE AS t_start, k*{step}::DOUBLE+{length}::DOUBLE AS t_end FROM (SELECT DISTINCT user_id FROM events), range({int((DAYS - length) // step) + 1}) g(k))"


_LABELLED = f"""{_grid_sql(14400, 7200)}, {annotations_sql()}, lab AS (SELECT g.user_id, t_start, coalesce(max(CASE WHEN t_start<"offset" AND t_end>onset THEN 2 WHEN onset-t_end BETWEEN 1800 AND 14400 THEN 1 ELSE 0 END),0)::INT AS label FROM grid g LEFT JOIN ann a ON g.user_id=a.user_id AND onset<t_end+14401 AND "offset">t_start GROUP BY g.user_id, t_start)"""
_FIR = "fir AS (SELECT *, (coalesce(lag(value,2) OVER w,0)*1+coalesce(lag(value,1) OVER w,0)*2+value*3+coalesce(lead(value,1) OVER w,0)*2+coalesce(lead(value,2) OVER w,0)*1)/9 AS filtered FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY idx))"
_Z = "z AS (SELECT vec_id, patient, label, CASE WHEN list_aggregate(x,'stddev_pop')<1e-12 THEN list_transform(x, lambda v: 0.0::DOUBLE) ELSE list_transform(x, lambda v: (v-list_avg(x))/list_aggregate(x,'stddev_pop')) END AS x FROM win)"
_PSD = f"""{WINDOWS_SQL}, {_Z}, h AS (SELECT vec_id, patient, label, x, list_transform(range(64), lambda i: (0.5-0.5*cos(2*pi()*i/64))*(x[i+1]-list_avg(x))) AS y FROM z),
 k AS (SELECT vec_id, patient, label, b, x, list_sum(list_transform(range(64), lambda i: y[i+1]*cos(2*pi()*b*i/64))) AS re, list_sum(list_transform(range(64), lambda i: y[i+1]*sin(2*pi()*b*i/64))) AS im FROM h, range(33) g(b)),
 psd AS (SELECT vec_id, patient, label, b, x, (re*re+im*im)/(128.0::DOUBLE*24.0::DOUBLE)*(CASE WHEN b IN (0,32) THEN 1 ELSE 2 END) AS power FROM k)"""


def _trap(low: float, high: float, closed: bool = False) -> str:
    cond = f"b*2>={low} AND b*2<{'=' if closed else ''}{high}"
    return f"CASE WHEN count(*) FILTER ({cond})>1 THEN (sum(power) FILTER ({cond}) - (min_by(power,b) FILTER ({cond})+max_by(power,b) FILTER ({cond}))/2)*2 ELSE 0 END"


_BANDS = ", ".join(f"({_trap(*v)})/greatest({_trap(*A.TOTAL, True)},1e-12) AS {k}" for k, v in A.BANDS.items())
_IN = "b*2>=0.5 AND b*2<=45"
_ENT = f"SELECT vec_id, CASE WHEN max(s)>1e-12 THEN sum(-greatest(power/s,1e-12)*ln(greatest(power/s,1e-12)))/ln(count(*)) ELSE 0 END AS spectral_entropy FROM (SELECT vec_id, power, sum(power) OVER (PARTITION BY vec_id) AS s FROM psd WHERE {_IN}) GROUP BY vec_id"
_DIFF = lambda x: f"list_transform(range(1, len({x})), lambda i: {x}[i+1]-{x}[i])"
_VAR = lambda x: f"list_aggregate({x},'var_pop')"


def _hjorth_sql(source: str) -> str:
    return f"""SELECT vec_id, mobility, CASE WHEN mobility>1e-12 THEN (CASE WHEN v1>1e-12 THEN sqrt(v2/v1) ELSE 0 END)/mobility ELSE 0 END AS complexity FROM (SELECT *, CASE WHEN v0>1e-12 THEN sqrt(v1/v0) ELSE 0 END AS mobility
      FROM (SELECT vec_id, {_VAR('x')} AS v0, {_VAR('d1')} AS v1, {_VAR('d2')} AS v2 FROM (SELECT *, {_DIFF('d1')} AS d2 FROM (SELECT vec_id, x, {_DIFF('x')} AS d1 FROM {source}))))"""


_LINE = lambda source: f"SELECT vec_id, list_avg(list_transform({_DIFF('x')}, lambda v: abs(v))) AS line_length FROM {source}"
_MOMENT = lambda source: f"SELECT vec_id, list_aggregate(x,'skewness') AS skewness, list_aggregate(x,'kurtosis') AS kurtosis FROM {source}"
_FEATURES = f"""{_PSD}, fb AS (SELECT vec_id, {_BANDS} FROM psd GROUP BY vec_id), fe AS ({_ENT}), fh AS ({_hjorth_sql('z')}), fl AS ({_LINE('z')}), fm AS ({_MOMENT('z')}),
 ft AS (SELECT vec_id, delta, theta, alpha, beta, gamma, spectral_entropy, mobility AS hjorth_mobility, complexity AS hjorth_complexity, line_length, skewness, kurtosis FROM fb JOIN fe USING (vec_id) JOIN fh USING (vec_id) JOIN fl USING (vec_id) JOIN fm USING (vec_id))"""

#: The features of every vector, for other queries' SQL.
FEATURES_SQL = _FEATURES

_MODES = {
    "a": "(v-m)/(s1+1e-6)", "b": "(v-m)/greatest(s1,1e-6)", "c": "(v-m)/CASE WHEN s0<1e-8 THEN 1 ELSE s0 END", "d": "CASE WHEN s0<1e-12 THEN 0 ELSE (v-m)/s0 END", "e": "(v-m)/(s0+1e-6)",
}


def _low_pass_sql(name: str, rate: float, edge: float, half: int) -> str:
    """CTE (j, w): taps of a Hamming-windowed sinc low-pass that sum to 1, over n's j from -half to half."""
    x = f"(2*{edge}::DOUBLE/{rate}*j*pi())"
    raw = f"(CASE WHEN j=0 THEN 1.0::DOUBLE ELSE sin{x}/{x} END)*(0.54::DOUBLE+0.46::DOUBLE*cos(pi()*j/{half}))"
    return f"{name} AS (SELECT j, {raw}/sum({raw}) OVER () AS w FROM n)"


ORACLES = {
    "window_label_overlap": f"WITH {_LABELLED} SELECT user_id, t_start, label FROM lab",
    "window_label_fraction": f"""WITH {_grid_sql(3600, 1800)}, {annotations_sql()}, lab AS (SELECT g.user_id, t_start, coalesce(max(CASE WHEN onset IS NULL THEN 0 WHEN greatest(0,least(t_end,"offset")-greatest(t_start,onset))/(t_end-t_start)>=0.5 THEN 2 WHEN t_end>greatest(0,onset-9000) AND t_start<=onset THEN 1 ELSE 0 END),0)::INT AS label
      FROM grid g LEFT JOIN ann a ON g.user_id=a.user_id AND onset<t_end+9001 AND "offset">=t_start GROUP BY g.user_id, t_start) SELECT user_id, label, count(*) AS windows, min(t_start) AS first_start FROM lab GROUP BY ALL""",
    "sliding_windows": f"""WITH {SAMPLES_SQL}, n AS (SELECT user_id, count(*) AS len FROM samples GROUP BY user_id), w AS (SELECT user_id, len, k FROM n, range(100000) g(k) WHERE k*8+16<=len)
      SELECT w.user_id, k AS window_index, k*8 AS start, round(avg(value),6) AS mean, round(min_by(value,idx),6) AS first, k*8+16<any_value(len) AS exclusive FROM w JOIN samples s ON w.user_id=s.user_id AND idx>=k*8 AND idx<k*8+16 GROUP BY w.user_id, k""",
    "short_filter": f"WITH {SAMPLES_SQL} SELECT user_id, count(*) AS n FROM samples GROUP BY user_id HAVING count(*)>=64",
    "index_map": """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), o AS (SELECT user_id, n, sum(n) OVER (ORDER BY user_id)-n AS o FROM n), t AS (SELECT count(*) AS rows FROM events), i AS (SELECT event_id*3-rows AS index, CASE WHEN event_id*3-rows<0 THEN event_id*3 ELSE event_id*3-rows END AS g FROM events, t)
      SELECT index, user_id, (g-o)::BIGINT AS local FROM i LEFT JOIN o ON g>=o AND g<o+n""",
    "car_reference": f"WITH {SAMPLES_SQL} SELECT event_id, round(value-avg(value) OVER (PARTITION BY user_id, floor(t/86400)),6) AS value FROM samples",
    "fir_smooth": f"WITH {SAMPLES_SQL}, {_FIR} SELECT event_id, round(filtered,6) AS filtered FROM fir",
    "resample": f"WITH {SAMPLES_SQL}, {_FIR} SELECT user_id, idx//4 AS idx, round(filtered,6) AS value FROM fir WHERE idx%4=0",
    "band_filters": f"""WITH {SAMPLES_SQL}, n AS (SELECT unnest(range(-422, 423)) AS j), {_low_pass_sql('b', 256, 40, 422)}, {_low_pass_sql('a', 256, 0.5, 422)}, {_low_pass_sql('u', 256, 51, 422)}, {_low_pass_sql('v', 256, 49, 422)},
      k AS (SELECT j, b.w - a.w AS w1, (CASE WHEN j=0 THEN 1 ELSE 0 END) - (u.w - v.w) AS w2 FROM b JOIN a USING (j) JOIN u USING (j) JOIN v USING (j)),
      f AS (SELECT s.user_id, s.idx, sum(x.value*w1) AS value FROM samples s JOIN samples x ON x.user_id=s.user_id AND x.idx BETWEEN s.idx-422 AND s.idx+422 JOIN k ON k.j=x.idx-s.idx GROUP BY s.user_id, s.idx)
      SELECT s.user_id, s.idx, round(sum(x.value*w2),6) AS value FROM f s JOIN f x ON x.user_id=s.user_id AND x.idx BETWEEN s.idx-422 AND s.idx+422 JOIN k ON k.j=x.idx-s.idx GROUP BY s.user_id, s.idx""",
    "resample_rational": f"""WITH {SAMPLES_SQL}, n AS (SELECT unnest(range(-2080, 2081)) AS j), {_low_pass_sql('h', 16000, 57.6, 2080)}, t AS (SELECT user_id, max(idx) AS t FROM samples GROUP BY user_id),
      m AS (SELECT user_id, unnest(range(0, t*64//125+1)) AS m FROM t)
      SELECT m.user_id, m.m AS idx, round(sum(x.value*h.w)*64,6) AS value FROM m JOIN samples x ON x.user_id=m.user_id AND x.idx*64 BETWEEN m.m*125-2080 AND m.m*125+2080 JOIN h ON h.j=m.m*125-x.idx*64 GROUP BY m.user_id, m.m""",
    "resample_linear": f"""WITH {SAMPLES_SQL}, n AS (SELECT user_id, max(idx) AS t FROM samples GROUP BY user_id), k AS (SELECT user_id, k, k/1.5::DOUBLE AS pos FROM n, range(200000) g(k) WHERE k/1.5::DOUBLE<=t)
      SELECT k.user_id, k AS idx, round(a.value+(pos-a.idx)*(coalesce(b.value,a.value)-a.value),6) AS value FROM k JOIN samples a ON k.user_id=a.user_id AND a.idx=floor(pos) LEFT JOIN samples b ON k.user_id=b.user_id AND b.idx=a.idx+1""",
    "preictal_interval": f"WITH {annotations_sql()} SELECT user_id, round(onset,6) AS onset, round(greatest(0,onset-60),6) AS window_start, round(onset,6) AS window_end, 60.0::DOUBLE AS window_duration FROM ann",
    "class_counts": f"WITH {_LABELLED} SELECT user_id, count(*) AS n_windows, count(*) FILTER (label=0) AS n_0, count(*) FILTER (label=1) AS n_1, count(*) FILTER (label=2) AS n_2 FROM lab GROUP BY user_id",
    "fit_shape": f"WITH {WINDOWS_SQL} SELECT vec_id, 2 AS channels, 80 AS length, round(list_sum(x[1:80]),6) AS padded, 40 AS cut_length, round(2*list_sum(x[1:40]),6) AS cut FROM win",
    "zscore": f"WITH {WINDOWS_SQL}, s AS (SELECT vec_id, x, list_avg(x) AS m, list_aggregate(x,'stddev_pop') AS s0, list_aggregate(x,'stddev_samp') AS s1 FROM win), u AS (" + " UNION ALL ".join(f"SELECT vec_id, '{k}' AS mode, list_transform(x, lambda v: ({v})::DOUBLE) AS z FROM s" for k, v in _MODES.items()) + ") SELECT vec_id, mode, round(z[1],6) AS first, round(z[-1],6) AS last, round(list_sum(list_transform(z, lambda v: v*v)),6) AS sum_squares FROM u",
    "nonfinite": f"WITH {WINDOWS_SQL} SELECT patient, count(*) AS windows, count(*) FILTER (vec_id%7=0 AND len(list_filter(x, lambda v: v>0))>0) AS rejected FROM win GROUP BY patient",
    "welch_psd": f"WITH {_PSD} SELECT vec_id, b::INT AS bin, (b*2)::DOUBLE AS hz, round(power,6) AS power FROM psd",
    "band_power": f"WITH {_PSD}, f AS (SELECT vec_id, {_BANDS} FROM psd GROUP BY vec_id) SELECT vec_id, {', '.join(f'round({k},6) AS {k}' for k in A.BANDS)} FROM f",
    "spectral_entropy": f"WITH {_PSD}, f AS ({_ENT}) SELECT vec_id, round(spectral_entropy,6) AS spectral_entropy FROM f",
    "hjorth": f"WITH {WINDOWS_SQL}, f AS ({_hjorth_sql('win')}) SELECT vec_id, round(mobility,6) AS mobility, round(complexity,6) AS complexity FROM f",
    "line_length": f"WITH {WINDOWS_SQL}, f AS ({_LINE('win')}) SELECT vec_id, round(line_length,6) AS line_length FROM f",
    "skew_kurt": f"WITH {WINDOWS_SQL}, f AS ({_MOMENT('win')}) SELECT vec_id, round(skewness,6) AS skewness, round(kurtosis,6) AS kurtosis FROM f",
    "feature_vector": f"WITH {_FEATURES} " + " UNION ALL ".join(f"SELECT vec_id, 'ch1__{k}' AS name, round({k},6) AS value FROM ft" for k in A.FEATURES),
    "feature_summary": f"WITH {_FEATURES} SELECT patient, count(*) AS n_windows, count(*) FILTER (label=0) AS n_0, count(*) FILTER (label=1) AS n_1, count(*) FILTER (label=2) AS n_2, TRUE AS all_finite, round(avg(line_length),6) AS mean_line_length FROM ft JOIN win USING (vec_id) GROUP BY ROLLUP (patient)",
    "standardise": f"""WITH {WINDOWS_SQL}, t AS (SELECT patient, vec_id, x[1] AS a, x[2] AS b, 3.0::DOUBLE AS c FROM win), s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc FROM t WHERE patient%4<>0)
      SELECT vec_id, round((a-ma)/CASE WHEN sa<1e-8 THEN 1 ELSE sa END,6) AS z_a, round((b-mb)/CASE WHEN sb<1e-8 THEN 1 ELSE sb END,6) AS z_b, round((c-mc)/CASE WHEN sc<1e-8 THEN 1 ELSE sc END,6) AS z_c FROM t, s WHERE patient%4=0""",
}
