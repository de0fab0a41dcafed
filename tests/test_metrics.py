"""Metric operators on hand-made vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rillwave.operators import metrics as M


def frame(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred, strict=True)), "truth int, pred int")


def test_perfect_and_swapped(spark):
    one = M.overall_metrics(frame(spark, [0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 2, 2]), "truth", "pred").first()
    assert (one.accuracy, one.balanced_accuracy, one.macro_f1) == (1, 1, 1)
    swapped = frame(spark, [0, 0, 1, 1, 2, 2], [0, 0, 2, 2, 1, 1])
    cells = {(r.truth, r.pred): r.n for r in M.confusion(swapped, "truth", "pred").collect()}
    assert [[cells[t, p] for p in range(3)] for t in range(3)] == [[2, 0, 0], [0, 0, 2], [0, 2, 0]]
    assert M.overall_metrics(swapped, "truth", "pred").first().balanced_accuracy == pytest.approx(1 / 3)


def test_constant_class(spark):
    r = M.overall_metrics(frame(spark, [0] * 6 + [1] * 2 + [2] * 2, [0] * 10), "truth", "pred").first()
    assert r.accuracy == pytest.approx(0.6) and r.balanced_accuracy == pytest.approx(1 / 3)


def test_equal_scores_give_half(spark):
    df = spark.createDataFrame([(c, 1 / 3, 1 / 3, 1 / 3) for c in (0, 0, 1, 1, 2, 2)], "truth int, p0 double, p1 double, p2 double")
    assert {r.auc for r in M.class_rankings(df, "truth", ["p0", "p1", "p2"]).collect()} == {0.5}
    alone = M.ranking_metrics(df.where("truth = 0"), "p0", F.col("truth") > 0).first()
    assert alone.auc is None


def test_ranking_against_definition(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    score, hit = rng.integers(0, 12, 200) / 10, rng.random(200) < 0.4
    df = spark.createDataFrame([(float(s), bool(h)) for s, h in zip(score, hit, strict=True)], "s double, h boolean")
    pos, neg = score[hit], score[~hit]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    levels = sorted(set(score), reverse=True)
    ap = sum(((score == v) & hit).sum() / hit.sum() * (hit & (score >= v)).sum() / (score >= v).sum() for v in levels)
    got = M.ranking_metrics(df, "s", F.col("h")).first()
    assert got.auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)


def test_threshold_policies(spark):
    cols = "threshold double, balanced_accuracy double, sensitivity double, specificity double, f1 double, youden_j double, alarm_rate double"
    rows = [(0.10, 0.60, 0.9, 0.3, 0.5, 0.2, 0.8), (0.55, 0.80, 0.8, 0.8, 0.7, 0.6, 0.4), (0.80, 0.70, 0.5, 0.9, 0.6, 0.4, 0.2)]
    assert M.pick_threshold(spark.createDataFrame(rows, cols), "balanced_accuracy").first().threshold == 0.55
    rows = [(0.40, 0.7, 0.95, 0.5, 0.5, 0.4, 0.7), (0.70, 0.8, 0.85, 0.85, 0.7, 0.7, 0.4), (0.80, 0.7, 0.6, 0.95, 0.6, 0.5, 0.2)]
    r = M.pick_threshold(spark.createDataFrame(rows, cols), "specificity_constrained").first()
    assert r.threshold == 0.70 and r.constraint_met
    r = M.pick_threshold(spark.createDataFrame(rows[:1], cols), "specificity_constrained").first()
    assert r.threshold == 0.40 and not r.constraint_met


def test_sweep_grid_is_numpys(spark):
    import numpy as np

    df = spark.createDataFrame([(1, 0.25 + 0.55), (0, 0.1), (1, 1.0), (0, 0.0)], "truth int, s double")
    sweep = M.threshold_sweep(df, "truth", F.col("s")).orderBy("threshold").collect()
    grid = np.arange(0.05, 0.951, 0.01)
    assert [r.threshold for r in sweep] == grid.tolist()
    for r in sweep:
        assert r.tp == (1.0 >= r.threshold) + (0.25 + 0.55 >= r.threshold)


def test_empty_and_null_rows(spark):
    empty = frame(spark, [], [])
    assert M.overall_metrics(empty, "truth", "pred").first().accuracy is None
    probs = spark.createDataFrame([(0.2, 0.3, None), (0.5, 0.25, 0.25), (float("nan"), 0.1, 0.1), (0.0, 0.0, 0.0), (-0.1, 0.6, 0.5)], "a double, b double, c double")
    assert [r.ok for r in M.check_probabilities(probs, ["a", "b", "c"]).collect()] == [False, True, False, False, False]


def test_reporting_contract(spark):
    from rillwave.operators import metrics as M

    rows = [("a", t, p, 0.2 + 0.1 * t, 0.3, 0.5 - 0.1 * t) for t in range(3) for p in range(3)] + [("b", 0, 0, 0.8, 0.1, 0.1), ("b", 1, 0, 0.6, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "e string, t int, p int, p0 double, p1 double, p2 double").selectExpr("*", "p1 + p2 AS s")
    full = M.reporting_metrics(df, "t", "p", ["p0", "p1", "p2"], "s", 0.5, ["e"])
    assert set(M.PRIMARY_KEYS + M.ALARM_KEYS) | {"e", "majority_class"} == set(full.columns) and len(M.PRIMARY_KEYS + M.ALARM_KEYS) == 33
    got = {r.e: r for r in full.collect()}
    assert got["a"].confusion_matrix == [[1, 1, 1]] * 3 and got["a"].per_class_support == [3, 3, 3] and abs(got["a"].accuracy - 1 / 3) < 1e-12
    assert got["b"].balanced_accuracy == 0.5 and got["b"].majority_class == 0 and got["b"].alarm_confusion_matrix == [[1, 0], [1, 0]]
    found = lambda d: {(r.e, r.metric, r.rule, r.got) for r in M.contract_violations(d, ["e"], True).collect()}
    assert found(full) == {("b", "auc", "missing", None)}
    seen = M.reporting_metrics(df, "t", "p", ["p0", "p1", "p2"], "s", 0.5, ["e"], observed=True)
    assert found(seen) == {("b", "auc", "missing", None), ("b", "confusion_matrix", "shape", "2 rows of 2+2"), *(("b", m, "length", "2") for m in M.ARRAYS)}
    bad = seen.where("e = 'a'").selectExpr("* except (loss, alarm_confusion_matrix, majority_class)", "array(array(1L, 2L), array(1L)) AS alarm_confusion_matrix")
    assert found(bad) == {("a", "loss", "missing", None), ("a", "majority_class", "missing", None), ("a", "alarm_confusion_matrix", "shape", "2 rows of 2+1")}


def test_reports_of_small_and_large_groups(spark, monkeypatch):
    """Groups that a task may hold are ranked without an order over all rows; larger ones, by ranges, give the same; a null group is one too."""
    import numpy as np

    draw = np.random.default_rng(7)
    rows = [(None if e == 3 else f"g{e}", None if i == 5 else int(draw.integers(3)), int(draw.integers(3)), *(float(v) / 4 for v in draw.integers(0, 5, 3))) for e, n in enumerate((2, 9, 30, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "e string, t int, p int, p0 double, p1 double, p2 double").selectExpr("*", "p1 + p2 AS s")
    report = lambda: {r.e: r.asDict() for r in M.reporting_metrics(df, "t", "p", ["p0", "p1", "p2"], "s", 0.5, ["e"], observed=True).collect()}
    with monkeypatch.context() as m:
        m.setattr(M, "with_global_sums", lambda *a: pytest.fail("no order over all rows is needed"))
        small = report()
    assert set(small) == {"g0", "g1", "g2", None}
    for e, got in small.items():
        own = [(r[1], *r[3:]) for r in rows if r[0] == e and r[1] is not None]

        def auc(score, hit):
            a, b = [score(r) for r in own if hit(r[0])], [score(r) for r in own if not hit(r[0])]
            return np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]) if a and b else None

        each = [auc(lambda r, c=c: r[1 + c], lambda t, c=c: t == c) for c in range(3)]
        assert got["auc"] == (None if None in each else pytest.approx(np.mean(each)))
        want = auc(lambda r: r[2] + r[3], lambda t: t > 0)
        assert got["alarm_auc"] == (None if want is None else pytest.approx(want))
    monkeypatch.setattr(M, "RANKED", 10)
    for e, got in report().items():
        for k, v in got.items():
            assert v == (pytest.approx(small[e][k]) if isinstance(v, float) else small[e][k]), (e, k)
