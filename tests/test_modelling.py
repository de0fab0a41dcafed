"""Boosted trees against a plain booster, and the nested cross-validation's sides and thresholds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave.operators import boosting as T
from rillwave.operators import models as B
from rillwave.plans import modelling

SF = "/root/testdata/sf0.001"


def plain_booster(bins, y, uid, trees, model, n_bins):
    """Row by row and split by split, with the same draws."""
    margin = [0.0] * len(y)
    forest = []
    for number in range(trees.count):
        allowed = T.drawn_features(bins.shape[1], trees, model, number)
        drawn = T.drawn_rows(uid, trees, model, number)
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((a - b) * 2**30) / 2**30 for a, b in zip(p, y, strict=True)]
        h = [max(round(a * (1 - a) * 2**30), 1) / 2**30 for a in p]

        def split(rows, depth, g=g, h=h, allowed=allowed):
            G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-9, None)
            if depth < trees.depth:
                for f in np.flatnonzero(allowed):
                    for cut in range(1, n_bins):
                        left = [i for i in rows if bins[i, f] < cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < trees.least or H - hl < trees.least:
                            continue
                        gain = gl**2 / (hl + trees.l2) + (G - gl) ** 2 / (H - hl + trees.l2) - G**2 / (H + trees.l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
            if best[1] is None:
                return -trees.rate * G / (H + trees.l2)
            f, cut = best[1]
            return (f, cut, split([i for i in rows if bins[i, f] < cut], depth + 1), split([i for i in rows if bins[i, f] >= cut], depth + 1))

        def value(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] < node[1] else node[3]
            return node

        tree = split([i for i in range(len(y)) if drawn[i]], 0)
        forest.append(tree)
        margin = [m + value(tree, bins[i]) for i, m in enumerate(margin)]
    return np.array(margin), forest


def test_trees_equal_a_plain_booster(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(150, 4)), 2)
    label = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * draw.normal(size=150) > 0.4, 1 + (x[:, 2] > 0), 0)
    rows = [(i, i % 3, int(label[i]), *[None if i % 17 == 0 and c == 3 else float(v) for c, v in enumerate(x[i])]) for i in range(150)]
    t = spark.createDataFrame(rows, "k int, fold int, label int, a double, b double, c double, d double").repartition(4)
    columns, trees = ["a", "b", "c", "d"], T.Trees(count=12, depth=3, rate=0.3, least=1.0)
    ask = [(F.col("fold") != 0, F.col("label") > 0), (F.col("label") > 0, F.col("label") == 2), (F.col("label") > 5, F.col("label") > 0)]
    fitted = T.fit_many(t, columns, ask, trees, bins=8)
    assert [len(b.trees) for b in fitted] == [12, 12, 0]
    held = t.withColumn("uid", F.xxhash64(*columns)).orderBy("k").toPandas()
    bins = T.binned(held[columns].to_numpy(float), fitted[0].cuts)
    assert bins[0, 3] == 0 and bins.max() <= 7
    for m, (own, hit) in enumerate([(held.fold != 0, held.label > 0), (held.label > 0, held.label == 2)]):
        want, _ = plain_booster(bins[own], hit[own].astype(int).tolist(), held.uid.to_numpy()[own], trees, m, 8)
        assert fitted[m].margins(bins[own]) == pytest.approx(want, abs=1e-9)
        assert ((want > 0) == hit[own]).mean() > 0.85
    # the same trees from other partitions, and probabilities as a column
    monkeypatch.setattr(T, "PART", 40)
    monkeypatch.setattr(T, "REDUCED", 1000)
    again = T.fit_many(t.repartition(6), columns, ask, trees, bins=8)
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all() for f, g in zip(fitted, again, strict=True) for a, b in zip(f.trees, g.trees, strict=True))
    got = T.with_probabilities(t, columns, fitted, "p").orderBy("k").toPandas()
    assert np.stack(got.p) == pytest.approx(np.stack([1 / (1 + np.exp(-b.margins(bins))) for b in fitted], 1))
    assert T.with_probabilities(t.where("false"), columns, fitted, "p").count() == 0


def test_queries_use_the_full_trees_and_five_folds(spark, monkeypatch):
    seen = []

    def fit(rows, columns, models, trees=None, bins=64):
        seen.append((trees or B.Trees(), [{r.p for r in rows.where(w).selectExpr("patient % 5 AS p").distinct().collect()} for w, _ in models]))
        return [B.Booster(np.full((len(columns), 1), np.inf), 4) for _ in models]

    monkeypatch.setattr(B, "fit_many", fit)
    held = modelling.nested_cv(spark, SF)
    assert {r.outer_fold for r in held.select("outer_fold").distinct().collect()} == set(range(5))
    assert held.where("patient % 5 <> outer_fold").isEmpty()
    assert [len(p) for p in seen[0][1]] == [3, 3, 4, 4] * 5
    modelling.gbt_hierarchy(spark, SF)
    assert {(t.count, t.depth, t.rate, t.least, t.sample, t.l2) for t, _ in seen} == {(300, 4, 0.05, 5.0, 0.8, 1.0)}


def test_nested_folds_with_given_inner_patients(spark, monkeypatch):
    """Five folds of 40 patients with string ids, eight of 32 as inner validation: 32/8 and 24/8, no overlap, each held out once."""
    rows = [(f"p{i:02d}", i // 8, k, (i + k) % 3, float((i + k) % 3) + 0.1 * k, float(i)) for i in range(40) for k in range(6)]
    t = spark.createDataFrame(rows, "patient string, fold int, k int, label int, a double, b double").coalesce(1).cache()
    given = spark.createDataFrame([(f, f"p{i:02d}") for f in range(5) for i in [j for j in range(40) if j // 8 != f][f % 4 :: 4]], "outer_fold int, patient string")
    seen = []
    fit = B.fit_hierarchies

    def spy(rows, columns, label, parts, trees=None):
        models = fit(rows, columns, label, parts, trees)
        for p, model in zip(parts, models, strict=True):
            own = rows.where(p)
            seen.append(({r.patient for r in own.select("patient").distinct().collect()}, model, own.agg(F.avg("a"), F.stddev_pop("b")).first()))
        return models

    monkeypatch.setattr(B, "fit_hierarchies", spy)
    out = B.nested_cv(t, ["a", "b"], "label", "patient", "fold", list(range(5)), B.Trees(2, 2, 0.3, 1.0, 1), given).collect()
    assert sorted((r.patient, r.k) for r in out) == sorted((r[0], r[2]) for r in rows)
    for f in range(5):
        held, (inner, small, stats), (outer, whole, _) = {f"p{i:02d}" for i in range(40) if i // 8 == f}, *seen[2 * f : 2 * f + 2]
        val = {r.patient for r in given.where(F.col("outer_fold") == f).collect()}
        assert (len(outer), len(held), len(inner), len(val)) == (32, 8, 24, 8)
        assert not outer & held and not inner & val and inner | val == outer
        # the standardiser is that of its own training rows
        assert abs(small.centre[0] - stats[0]) < 1e-9 and abs(small.spread[1] - stats[1]) < 1e-9 and whole.centre != small.centre
        # thresholds are those that the inner validation rows ask for
        mine = [r for r in out if r.outer_fold == f]
        assert {r.patient for r in mine} == held and len({(r.t1, r.t2) for r in mine}) == 1
        scored = small.predict(t.where(F.col("patient").isin(*val)))
        assert mine[0].t1 == B._threshold(scored, "label", "p_alarm", "stage1")
        final = {(r.patient, r.k): (r.p_alarm, r.p_ictal) for r in whole.predict(t.where(F.col("fold") == f)).collect()}
        assert {(r.patient, r.k): (r.p_alarm, r.p_ictal) for r in mine} == final


def test_a_stage_of_one_class_and_two_folds(spark):
    t = spark.createDataFrame([(i, i % 2, 0, float(i)) for i in range(12)], "patient long, fold int, label int, a double")
    model = B.fit_hierarchy(t, ["a"], "label", B.Trees(1, 1))
    assert {(r.p_alarm, r.p_ictal) for r in model.predict(t).collect()} == {(0.5, 0.5)}
    with pytest.raises(ValueError, match="inner"):
        B.nested_cv(t, ["a"], "label", "patient", "fold", [0, 1])


def test_rows_go_down_many_trees_at_once():
    """Places on each level against a walk of every row, for trees whose leaves lie on any level."""
    draw = np.random.default_rng(2)
    bins = draw.integers(0, 64, (5, 300)).astype(np.uint8)
    grown = []
    for share in (0.0, 0.4, 0.8, 1.0):
        t = T.Tree.empty(4)
        for k in range(15):
            if draw.random() < share and (k == 0 or t.feature[(k - 1) // 2] >= 0):
                t.feature[k], t.cut[k] = draw.integers(5), draw.integers(1, 64)
        grown.append(t)
    for depth in range(5):
        for t, at in zip(grown, T.places(grown, bins, depth), strict=True):
            for row, node in zip(bins.T, t.stops(depth)[at], strict=True):
                k = 0
                for _ in range(depth):
                    k = k if t.feature[k] < 0 else 2 * k + 1 + int(row[t.feature[k]] >= t.cut[k])
                assert k == node


def test_passes_use_every_core_and_thresholds_one_sweep(spark, monkeypatch):
    class Seen(Exception):
        pass

    def level(blocks, *rest):
        raise Seen(blocks.rdd.getNumPartitions(), sorted(blocks.selectExpr("spark_partition_id() AS p", "octet_length(uid) DIV 8 AS n").groupBy("p").sum("n").toPandas()["sum(n)"]))

    rows = spark.range(1 << 16).selectExpr("id", "id % 7 AS a", "id % 1000 AS b", "id % 2 AS label")
    with monkeypatch.context() as m, pytest.raises(Seen) as found:
        m.setattr(T, "_level", level)
        T.fit_many(rows, ["a", "b"], [(F.lit(True), F.col("label") > 0)])
    tasks, dealt = found.value.args
    assert tasks == 4 and sum(dealt) == 1 << 16 and len(dealt) > 1
    sweeps = []
    sweep = B.M.threshold_sweep
    monkeypatch.setattr(B.M, "threshold_sweep", lambda *a, **k: (sweeps.append(a), sweep(*a, **k))[1])
    t = spark.createDataFrame([(i % 10, i % 5, i % 3, float(i % 3) + 0.1 * (i % 7)) for i in range(120)], "patient long, fold int, label int, a double")
    assert B.nested_cv(t, ["a"], "label", "patient", "fold", list(range(5)), B.Trees(1, 2, 0.3, 1.0, 1)).count() == 120
    assert len(sweeps) == 2
