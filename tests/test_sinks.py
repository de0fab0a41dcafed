"""The resumable sink after stops and damage, and checksums of files of many pieces."""

from __future__ import annotations

import glob
import hashlib
import os

from rillwave.sources import recordings as S


def test_a_damaged_commit_is_repaired(spark, tmp_path):
    rows = [(p, i, float((p or 9) * i)) for p in (*range(4), None) for i in range(50)]
    df = spark.createDataFrame(rows, "patient int, i int, v double").repartition(2, "patient")
    path = str(tmp_path / "f")
    assert {r.how for r in S.resume_features(df, path, "patient").collect()} == {"written"}
    assert {r.how for r in S.resume_features(df, path, "patient").collect()} == {"kept"}
    # files of one task of the only attempt with rows get lost
    (lost, *_) = (f for f in sorted(glob.glob(f"{path}/data/attempt=*/part-*.parquet")) if spark.read.parquet(f).count())
    gone = {r.patient for r in spark.read.parquet(lost).select("patient").distinct().collect()}
    os.remove(lost)
    spark.catalog.clearCache()
    got = {r.patient: (r.how, r.ok, r.saved) for r in S.resume_features(df, path, "patient").collect()}
    assert got == {p: ("repaired" if p in gone else "kept", True, 50) for p in (*range(4), None)}
    assert sorted(map(str, S.read_features(spark, path, "patient").collect())) == sorted(map(str, df.collect()))
    # changed rows of one patient are written again, the others kept
    changed = df.where("patient = 1").selectExpr("patient", "i", "v + 1 AS v").unionByName(df.where("patient = 2"))
    assert {r.patient: r.how for r in S.resume_features(changed, path, "patient").collect()} == {1: "repaired", 2: "kept"}


def test_digests_of_many_pieces(spark, tmp_path, monkeypatch):
    for name, data in (("a.bin", b""), ("b.bin", os.urandom(3_500_000)), ("c d.bin", b"x" * (1 << 20))):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in S.manifest(spark, str(tmp_path), r"/([a-z])[^/]*\.bin$").collect()}
    for f in tmp_path.iterdir():
        row = next(r for r in got.values() if r.bytes == f.stat().st_size)
        assert (row.md5, row.sha256) == (hashlib.md5(f.read_bytes()).hexdigest(), hashlib.sha256(f.read_bytes()).hexdigest())
