"""Signal operators against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave.functions import arrays as A
from rillwave.operators import signal as S


def samples(spark, n=10, rate=1.0):
    return spark.createDataFrame([("r", i, float(np.sin(i))) for i in range(n)], "rec string, idx long, value double")


def test_window_starts_and_end_policies(spark):
    out = S.sliding_windows(samples(spark, 10), 4, 2, ["rec"]).orderBy("start").collect()
    assert [r.start for r in out] == [0, 2, 4, 6]
    assert [r.exclusive for r in out] == [True, True, True, False]
    assert out[1].x == [float(np.sin(i)) for i in range(2, 6)]


@pytest.mark.parametrize(("t", "label"), [(102, 2), (40, 1), (20000, 0)])
def test_labels_by_overlap(spark, t, label):
    w = spark.createDataFrame([("r", float(t), float(t + 4))], "rec string, t_start double, t_end double")
    a = spark.createDataFrame([("r", 100.0, 130.0)], "rec string, onset double, offset double")
    assert S.label_windows(w, a, ["rec"], S.overlap_label()).first().label == label


def test_range_join_equals_plain_join(spark):
    rng = np.random.default_rng(1)
    w = spark.createDataFrame([("r", float(t), float(t + 4)) for t in range(0, 2000, 2)], "rec string, t_start double, t_end double")
    # events at random, on the windows' borders, of no length, of a day, and one within another
    on = [*rng.uniform(0, 2000, 12).tolist(), 100.0, 104.0, 600.0, 700.0, 701.0]
    off = [*(o + rng.uniform(1, 90) for o in on[:12]), 102.0, 104.0, 602.0, 86400.0, 703.0]
    whole = spark.createDataFrame([("r", float(o), float(e)) for o, e in zip(on, off, strict=True)], "rec string, onset double, offset double")
    ends = F.col("t_end"), F.col("t_start")
    gap, onset = F.col("onset") - F.col("t_end"), F.col("onset")
    overlap = F.when((ends[1] < F.col("offset")) & (ends[0] > onset), 2).when((gap >= 30) & (gap <= 120), 1).otherwise(0)
    covered = F.greatest(F.lit(0.0), F.least(ends[0], F.col("offset")) - F.greatest(ends[1], onset)) / 4
    fraction = F.when(covered >= 0.5, 2).when((ends[0] > F.greatest(F.lit(0.0), onset - 900)) & (ends[1] <= onset), 1).otherwise(0)
    for label, expression in ((S.overlap_label(), overlap), (S.fraction_label(4), fraction)):
        for a in (whole.where("offset < 80000"), whole):
            got = {(r.t_start, r.label) for r in S.label_windows(w, a, ["rec"], label).collect()}
            plain = w.join(a, "rec").withColumn("l", expression).groupBy("t_start").agg(F.max("l").alias("l"))
            assert got == {(r.t_start, r.l) for r in plain.collect()}
    assert {r.label for r in S.label_windows(w, whole.where("false"), ["rec"], S.overlap_label()).collect()} == {0}


def test_grid_labels_equal_window_labels_and_shuffle_no_windows(spark):
    rng = np.random.default_rng(2)
    recordings = spark.createDataFrame([("r", 2000.0), ("s", 900.0), ("t", 3.0), ("u", 50.0), (None, 80.0)], "rec string, long double")
    # in and out of the recordings, on the windows' borders, of no length, within another, in a recording without windows
    on = [*rng.uniform(-50, 2100, 40).round(1).tolist(), -1e9, 100.0, 104.0, 600.0, 700.0, 701.0, 1e9, 1996.0, 2000.0]
    rows = [(r, float(o), float(o + e)) for r in ("r", "s", "t", None) for o, e in zip(on, [*rng.uniform(0, 60, 40).tolist(), 1e9 + 30, 2.0, 0.0, 2.0, 900.0, 2.0, 5.0, 9.0, 2.0], strict=True)]
    noted = spark.createDataFrame([*rows, ("r", None, 5.0)], "rec string, onset double, offset double")
    windows = S.window_grid(recordings, ["rec"], 4, 0.7, F.col("long"))
    for label in (S.overlap_label(), S.overlap_label(3.3, 21.0), S.fraction_label(4), S.fraction_label(4, 0.35, 9.1)):
        for a in (noted, noted.where("onset % 3 < 1"), noted.where("false")):
            got = S.label_grid(recordings, a, ["rec"], 4, 0.7, F.col("long"), label)
            want = S.label_windows(windows, a, ["rec"], label)
            read = lambda df: sorted(((r.rec or "", r.t_start, r.t_end, r.label) for r in df.select("rec", "t_start", "t_end", "label").collect()))
            assert read(got) == read(want)
    # windows are made above the last exchange
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence") < plan.index("Window")


def test_filters_meet_their_bands():
    rate, f = 256, np.fft.rfftfreq(8192, 1 / 256)
    band = np.abs(np.fft.rfft(S.sinc_kernel(rate, 0.5, 40, 845), 8192))
    assert band[(f > 1.5) & (f < 38)].min() > 0.97 and band[f > 43].max() < 0.02 and band[f < 0.02].max() < 0.2
    notch = np.abs(np.fft.rfft(S.notch_kernel(rate, 50, 2, 845), 8192))
    assert notch[np.argmin(abs(f - 50))] < 0.15 and notch[(f < 45) | (f > 55)].min() > 0.97


def test_fir_with_halo_equals_convolution(spark):
    kernel = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    for chunk in (3, 7, 100):
        got = [r.filtered for r in S.fir_filter(samples(spark, 25), kernel, ["rec"], chunk=chunk).orderBy("idx").collect()]
        assert np.allclose(got, np.convolve(np.sin(np.arange(25)), kernel, "same"))


def test_welch_matches_numpy_and_features_are_finite(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 512))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    got = S.welch_psd(df, "x", 128.0, 256).orderBy("id").collect()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    parts = [x[:, lo : lo + 256] for lo in (0, 128, 256)]
    want = np.mean([np.abs(np.fft.rfft((p - p.mean(1, keepdims=True)) * window)) ** 2 for p in parts], 0) / (128 * (window**2).sum())
    want[:, 1:128] *= 2
    assert np.allclose([r.psd for r in got], want)
    flat = spark.createDataFrame([(1, [2.0] * 64), (2, [1.0]), (3, [1.0, 2.0])], "id int, x array<double>")
    spectra = S.welch_psd(flat, "x", 128.0)
    made = A.features(F.col("x"), F.col("psd"), F.col("psd_step"))
    for r in spectra.select(*[v.alias(k) for k, v in made.items()]).collect():
        assert all(np.isfinite(v) for v in r)


def test_zscore_modes_on_a_constant(spark):
    df = spark.createDataFrame([([3.0, 3.0, 3.0],)], "x array<double>")
    for mode in "abcde":
        assert df.select(A.zscore(F.col("x"), mode)).first()[0] == [0.0, 0.0, 0.0]


def test_index_map(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 7)], "p string, n long")
    offsets = S.row_offsets(counts, "p")
    asked = spark.createDataFrame([(5,), (0,), (-1,), (12,), (-13,)], "i long")
    got = {r.i: (r.p, r.local) for r in S.locate(asked, offsets, "p", "i", 12, 2).collect()}
    assert got == {5: ("b", 0), 0: ("a", 0), -1: ("b", 6), 12: (None, None), -13: (None, None)}


def test_overlap_save_equals_convolution():
    draw = np.random.default_rng(2)
    for taps, length in ((65, 70), (845, 845), (845, 20000), (5001, 9000)):
        kernel, line = draw.normal(size=taps), draw.normal(size=length)
        got = S.overlap_save(line, S.kernel_spectrum(kernel), taps)
        assert np.allclose(got, np.convolve(line, kernel, "valid"), atol=1e-9)


def test_long_kernel_over_chunks(spark):
    x = np.random.default_rng(1).normal(size=900)
    kernel = S.sinc_kernel(256, 0.5, 40, 101)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 5.0)], "rec int, idx long, value double").repartition(3)
    got = {(r.rec, r.idx): r.filtered for r in S.fir_filter(df, kernel, ["rec"], chunk=128).collect()}
    want = np.convolve(x, kernel, "same")
    assert max(abs(got[1, i] - want[i]) for i in range(900)) < 1e-9 and abs(got[2, 0] - 5 * kernel[50]) < 1e-12


@pytest.mark.parametrize(("up", "down", "half", "chunk"), [(64, 125, 2080, 37), (3, 2, 20, 16), (2, 7, 30, 5), (1, 1, 0, 8)])
def test_rational_resampling_equals_the_long_way(spark, up, down, half, chunk):
    draw = np.random.default_rng(up)
    kernel = S.resampling_kernel(up, down, 250, half) if half else np.ones(1)
    rows, want = [], {}
    for rec, n in enumerate((1, 2, 9, 400)):
        x = draw.normal(size=n)
        rows += [(rec, i, float(v)) for i, v in enumerate(x)]
        raised = np.zeros((n - 1) * up + 1)
        raised[::up] = x
        for m, v in enumerate(np.convolve(raised, kernel)[half : half + len(raised)][::down]):
            want[rec, m] = v
    df = spark.createDataFrame(rows, "rec int, idx long, value double").repartition(3)
    got = {(r.rec, r.idx): r.value for r in S.resample_rational(df, up, down, kernel, ["rec"], chunk=chunk).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_resampling_cuts_what_the_lower_rate_cannot_hold():
    kernel = S.resampling_kernel(64, 125, 250, 2080)
    assert abs(kernel.sum() - 64) < 1e-9
    gain = lambda f: abs((kernel / 64 * np.exp(-2j * np.pi * f / 16000 * np.arange(len(kernel)))).sum())
    assert gain(40) > 0.99 and max(gain(f) for f in np.arange(64.5, 124, 0.5)) < 0.01
