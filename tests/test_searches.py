"""The searches try as many candidates as the surveyed pipeline, and find what 64 miss."""

from __future__ import annotations

import hashlib
import inspect

import numpy as np

from rillwave.functions.digests import Endings
from rillwave.operators import splits as D
from rillwave.plans.registry import QUERIES


def test_default_candidates():
    count = lambda f: inspect.signature(f).parameters["trials"].default
    assert (count(D.balanced_split), count(D.kfold_search), count(D.inner_search)) == (10_000, 200_000, 100_000)
    assert {"balanced_split_full", "kfold_search_full", "inner_search_full"} <= set(QUERIES)


def test_a_skewed_cohort_has_a_feasible_deal_beyond_64_candidates(spark):
    # each of the twelve patients with class 1 and 2 must fall into a fold of its own: 4096 of 2704156 deals do
    rare = [(i, 10 + (i < 12) * 2, 10, int(i < 12), int(i < 12)) for i in range(24)]
    matrix = spark.createDataFrame(rare, "patient long, n long, n0 long, n1 long, n2 long")
    few, many = (D.kfold_search(matrix, "patient", 12, t).collect() for t in (64, 10_000))  # arrays in several blocks
    assert not few
    assert len(many) == 24
    assert all(len([r for r in many if r.fold == f and r.patient < 12]) == 1 for f in range(12))


def test_orders_are_those_of_the_draw(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    matrix = spark.createDataFrame([(f"p{i}", i, 1, 1, i - 2) for i in range(9)], "patient string, n long, n0 long, n1 long, n2 long")
    got = D.Cohort(matrix, "patient").orders(range(3, 6), 42, "x")
    grid = matrix.crossJoin(spark.range(3, 6).withColumnRenamed("id", "trial")).withColumn("rn", F.row_number().over(Window.partitionBy("trial").orderBy(D.draw(42, F.lit("x"), "trial", "patient"), "patient")))
    want = {(r.trial, r.rn): r.patient for r in grid.collect()}
    assert {(t + 3, k + 1): f"p{i}" for t, row in enumerate(got) for k, i in enumerate(row)} == want


def _cohort(spark, patients, counts):
    rows = [(i, str(i % 3), sum(c), *c) for i in range(patients) for c in [counts(i)]]
    return spark.createDataFrame(rows, "patient long, fold string, n long, n0 long, n1 long, n2 long")


def test_a_fold_is_decided_once_no_trial_can_be_better(spark, monkeypatch):
    monkeypatch.setattr(D, "FIRST_ROUND", 1 << 14, raising=False)
    # every trial has the least score that there is, so the first wins and none of the other 10^15 is needed
    found = D.inner_search(_cohort(spark, 48, lambda i: (3, 2, 1)), "patient", "fold", 10**15).collect()
    assert {(r.fold, r.trial, r.score) for r in found} == {(f, 0, 0.0) for f in "012"} and len(found) == 24


def test_rounds_find_what_one_round_finds(spark, monkeypatch):
    matrix = _cohort(spark, 45, lambda i: (3 + i % 4, 2 + i % 3, 1 + i % 2))
    one = D.inner_search(matrix, "patient", "fold", 300).collect()
    seen = []
    whole = D._round
    monkeypatch.setattr(D, "FIRST_ROUND", 90 * 20)
    monkeypatch.setattr(D, "_round", lambda spark, trials, *more: seen.append(trials) or whole(spark, trials, *more))
    assert sorted(D.inner_search(matrix, "patient", "fold", 300).collect()) == sorted(one)
    assert [len(r) for r in seen] == [20, 40, 80, 160]  # no score is the least that there is, so all are tried


def test_a_large_common_part_of_scores_leaves_few_to_score_again():
    raw = 719.92 + np.arange(20_000) * 1e-12  # as with 288,000 patients
    at, _, _ = D._leading(raw, D._roundings)
    assert len(at) < 20 and 0 in at


def test_keys_of_four_bytes_and_texts_of_any_place():
    texts = [b"", b"7", b"x" * 40, *[b"%d" % i for i in range(90, 120)], b"8", b"y" * 70]
    heads = [b"42|%d|" % t for t in (0, 5, 12345, 9, 10)]
    want = [[int.from_bytes(hashlib.md5(h + t).digest()[:4], "big") for t in texts] for h in heads]
    ends = Endings(texts, 4)
    assert ends.keys(heads).tolist() == want and ends.keys(heads[2:3]).tolist() == want[2:3]
