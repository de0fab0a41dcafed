"""Digests of many texts at once, and sums over the first patients of many orders, against hashlib and whole orders."""

from __future__ import annotations

import hashlib

import numpy as np

from rillwave.functions.digests import Endings
from rillwave.operators import splits as D


def test_keys_are_the_digests_beginnings():
    texts = [b"", b"7", *[b"%d" % i for i in range(90, 120)], b"x" * 40, "é日".encode(), b"y" * 70]
    heads = [b"42|%d|" % t for t in (0, 5, 9, 10, 12345)] + [b"a" * 20]
    want = [[int.from_bytes(hashlib.md5(h + t).digest()[:8], "big") for t in texts] for h in heads]
    assert Endings(texts).keys(heads).tolist() == want


def test_sums_of_the_first_are_those_of_the_order(spark, monkeypatch):
    matrix = spark.createDataFrame([(i, i % 7, i % 5, i % 3, i % 2) for i in range(53)], "patient long, n long, n0 long, n1 long, n2 long")
    cohort = D.Cohort(matrix, "patient")
    ends, trials = [0, 10, 10, 41, 53], range(8, 13)
    order = cohort.orders(trials, 42, "f")
    want = np.array([[cohort.counts[o[:e]].sum(0) for e in ends] for o in order])
    assert (cohort.first(cohort.counts, ends, trials, 42, "f") == want).all()
    # draws that tie in their first half are told apart by the rest
    monkeypatch.setattr(cohort.endings, "keys", lambda heads: np.zeros((len(heads), 53), np.uint64))
    assert (cohort.first(cohort.counts, ends, trials, 42, "f") == want).all()


def test_few_candidates_are_scored_again():
    # all scores of a large cohort lie within 10^-6; one per rounded score may win, and those at a border of digits
    raw = np.concatenate((5e-7 + np.arange(4096) * 1e-13, [4.9985e-7, 4.9985e-7, 4.998501e-7]))
    at, low, high = D._leading(raw)
    assert len(at) <= 3
    assert np.round(raw, D.DIGITS).argmin() in at
    at, _, _ = D._leading(np.full(5000, 1.5e-9))  # equal scores at a border
    assert at.tolist() == [0]
    assert not len(D._leading(np.full(3, np.inf))[0])
