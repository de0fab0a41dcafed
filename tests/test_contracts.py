"""Shapes, pair rule, gate and scans on small graphs and texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rillwave.operators import contracts as Q
from rillwave.operators import splits as D
from rillwave.sources import recordings as R


def graph(spark, channels=19, rate="256", onset="100", offset="130", duration="60", subject="p1", filter_type="fir"):
    t = [("p", Q.TYPE, "Patient", "iri"), ("p", "subjectID", subject, "string"), ("p", "hasSession", "s", "iri"), ("s", "sessionID", "s1", "string"), ("s", "hasSamplingRate", "r", "iri"), ("r", "frequencyHz", rate, "float")]
    for i in range(channels):
        t += [("s", "hasChannel", f"c{i}", "iri"), (f"c{i}", "channelLabel", f"ch{i}", "string")]
    for i in (1, 2):
        t += [("s", "hasPreprocessingStep", f"x{i}", "iri"), (f"x{i}", "stepOrder", str(i), "integer")]
        if filter_type is not None:
            t.append((f"x{i}", "filterType", filter_type, "string"))
    t += [("s", "hasSeizure", "z", "iri"), ("z", "hasOnset", onset, "float"), ("z", "hasOffset", offset, "float"), ("z", "hasPreIctalWindow", "w", "iri"), ("w", "windowDuration", duration, "float"), ("w", "windowStart", "40", "float"), ("w", "windowEnd", "100", "float")]
    return Q.infer_types(spark.createDataFrame(t, "s string, p string, o string, kind string"))


def test_valid_graph_conforms(spark):
    g = graph(spark)
    assert Q.violations(g).count() == 0 and Q.pair_violations(g).count() == 0


@pytest.mark.parametrize(
    ("change", "path", "rule"),
    [({"channels": 5}, "hasChannel", "min count"), ({"rate": "100"}, "frequencyHz", "range"), ({"subject": ""}, "subjectID", "length"), ({"duration": "20"}, "windowDuration", "range"), ({"duration": "130"}, "windowDuration", "range"), ({"filter_type": None}, "filterType", "min count")],
)
def test_violations(spark, change, path, rule):
    found = {(r.path, r.rule) for r in Q.violations(graph(spark, **change)).collect()}
    assert found == {(path, rule)}


@pytest.mark.parametrize(("onset", "offset"), [("130", "100"), ("100", "100")])
def test_pair_rule(spark, onset, offset):
    assert Q.pair_violations(graph(spark, onset=onset, offset=offset)).count() == 1


def test_summaries(spark):
    text = "File Name: a.edf\nNumber of Seizures in File: 1\nSeizure 1 Start Time: 100 seconds\nSeizure 1 End Time: 130 seconds\nFile Name: b.edf\nNumber of Seizures in File: 0\nfile name: c.edf\nNumber of Seizures in File: 2\nSeizure Start Time: 5 seconds\nSeizure End Time: 5 seconds\nSeizure 2 Start Time: 9 seconds"
    df = spark.createDataFrame([(text, "x"), ("", "y"), (None, "z")], "value string, `from` string")
    assert [tuple(r) for r in R.parse_summaries(df).collect()] == [("a.edf", 100.0, 130.0)]


def test_interval_files_prefer_the_binary_kind(spark, tmp_path):
    (tmp_path / "r1.csv").write_text("# c\nstart_time,stop_time,label\n1,2,seiz\n")
    (tmp_path / "r1.csv_bi").write_text("# c\n Start_Time , stop_time, type ,prob\n3,4, SEIZ ,0.5\n5,6,seiz,0.4\n7,8,bckg,1\n")
    (tmp_path / "r2.csv").write_text("start_time,stop_time,label\n9,10,gnsz\n")
    got = {tuple(r) for r in R.read_intervals(spark, str(tmp_path)).collect()}
    assert got == {("r1", 3.0, 4.0), ("r2", 9.0, 10.0)}


def test_splits_are_disjoint_complete_and_repeat(spark):
    rows = [(f"p{i}", 30 + i, 10 + i, 3 + i % 4, 17) for i in range(10)]
    m = spark.createDataFrame([(a, b + c + d, b, c, d) for a, b, c, d, _ in rows], "p string, n long, n0 long, n1 long, n2 long")
    one, two = ({(r.p, r.side) for r in D.balanced_split(m, "p", 20).collect()} for _ in range(2))
    assert one == two and len(one) == 10 and {s for _, s in one} == {"train", "validation", "test"}


def test_row_split_needs_three_rows(spark):
    with pytest.raises(ValueError, match="three rows"):
        D.split_rows(spark.range(2), "id")
    assert {r.side: r["count"] for r in D.split_rows(spark.range(3), "id").groupBy("side").count().collect()} == {"train": 1, "validation": 1, "test": 1}


def test_round_robin_alternates(spark):
    rows = spark.createDataFrame([(p, i) for p, n in (("a", 10), ("b", 9), ("c", 7)) for i in range(n)], "p string, k long")
    out = D.round_robin(rows, "p", "k", 2, turns=1).orderBy("position").collect()
    assert len({r.p for r in out[:3]}) == 3 and len(out) == 5 + 5 + 4


def test_names_are_made_once_and_types_in_one_pass(spark):
    rows = spark.range(5).select(F.col("id").alias("k"))
    name = Q.iri(F.lit("session"), "k")
    g = Q.facts(rows, [(name, "sessionID", F.col("k"), "string"), (name, "hasChannel", Q.iri(F.lit("c"), "k"), "iri"), (name, Q.TYPE, F.lit("RecordingSession"), "iri")])
    typed = Q.infer_types(g, partitions=3).where(F.col("p") == Q.TYPE)
    assert sorted((r.s, r.o) for r in typed.collect()) == sorted([(f"session_{i}", "RecordingSession") for i in range(5)] + [(f"c_{i}", "EEGChannel") for i in range(5)])
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_violations_shuffle_by_the_partitions_given(spark):
    rows = [("a", "type", "Patient", "iri"), ("a", "type", "Patient", "iri"), ("a", "hasSession", "x", "iri"), ("a", "hasSession", "x", "iri"), ("b", "hasSession", "y", "iri"), ("a", "subjectID", "", "string"), ("c", "type", "Patient", "iri")]
    g = spark.createDataFrame(rows, "s string, p string, o string, kind string")
    found = Q.violations(g, partitions=7)
    want = {("a", "hasSession", "object class", 1), ("a", "subjectID", "length", 1), ("c", "hasSession", "min count", 0), ("c", "subjectID", "min count", 0)}
    assert {(r.focus, r.path, r.rule, r.n) for r in found.collect()} == want
    assert "RepartitionByExpression [focus" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", 7" in plan


def test_shapes_are_checked_on_all_rows(spark):
    from rillwave.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_returnflag").alias("n")).where("n > 1").count()
    found = {(r["class"], r.path, r.rule): r.nodes for r in QUERIES["shape_violations"](spark, d).collect()}
    assert found["EEGChannel", "channelLabel", "max count"] == labels > 0
    assert ("RecordingSession", "hasSamplingRate", "min count") not in found


def test_types_reach_every_row_and_seizures(spark):
    from rillwave.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    n = {r["class"]: r["count"] for r in QUERIES["type_inference"](spark, d).groupBy("class").count().collect()}
    assert n["SeizureEvent"] == n["PreIctalWindow"] == read("events").where("event_type = 'error'").count() > 0
    assert n["SamplingRate"] == read("orders").count()
