"""Queries of whole-run rules: catalogues with annotations, window rejections, channel-major vectors, feature contracts, nested leakage, coverage, and the gate that stops a run; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions import arrays as A
from rillwave.functions.ordering import scratch_path
from rillwave.operators import contracts as Q
from rillwave.operators import models as B
from rillwave.operators import signal as P
from rillwave.operators import splits as D
from rillwave.sources import recordings as S

from .signals import FEATURES_SQL, feature_table
from .tables import WINDOWS_SQL, r6, seconds, table, windows

CHANNELS = 20


def catalogue_annotated(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve subjects of users modulo 20; even subjects have a summary file."""
    ev = table(spark, d, "events").select((F.col("user_id") % 20).alias("subject"), F.lit("recording").alias("kind"), F.col("event_id").cast("string").alias("value"))
    notes = ev.where("subject % 2 = 0").select("subject", F.lit("summary").alias("kind"), F.lit("File Name: all").alias("value")).distinct()
    path = scratch_path(spark, "annotated")
    ev.unionByName(notes).repartition("subject", "kind").write.partitionBy("subject", "kind").text(path)
    return S.catalogue(spark, path, r"subject=(\d+)/(kind=[^/]+/[^/]+)$", 12).select(F.col("subject").cast("long").alias("subject"), "recordings", "has_summary", F.col("annotation").isNotNull().alias("attached"), "warning")


def window_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Some patients lack labels, some have a label of 5, and some of those declared have no windows."""
    p, v = F.col("patient"), F.col("vec_id")
    label = F.when((p % 6 == 1) & (v % 3 == 0), F.lit(None)).when((p % 7 == 2) & (v % 5 != 1), 5).otherwise(F.col("label"))
    w = windows(spark, d).select("patient", F.col("x").alias("X"), label.cast("int").alias("y"))
    declared = w.select("patient").unionByName(w.where("patient % 10 = 3").select((p + 20).alias("patient")))
    return S.window_problems(S.read_windows(w), declared, "patient")


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Twenty vectors in a row as the channels of one window: 220 named values, long form."""
    t = feature_table(spark, d).withColumns({"win": F.floor(F.col("vec_id") / CHANNELS).cast("long"), "channel": F.col("vec_id") % CHANNELS})
    made = P.assemble_vectors(t, ["win"], "channel", list(A.FEATURES), CHANNELS)
    return made.select("win", F.posexplode(F.arrays_zip("names", "vector")).alias("position", "v")).select("win", "position", F.col("v.names").alias("name"), r6(F.col("v.vector")).alias("value"))


def feature_contract(spark: SparkSession, d: str) -> DataFrame:
    """What the feature job declares of each patient against what it has: shape, counts, classes, rate within 1e-6 of 128, finite values."""
    p = F.col("patient")
    t = feature_table(spark, d).withColumn("values", F.array(*A.FEATURES))
    ok = reduce(lambda a, b: a & b, [A.is_finite(F.col(k)) for k in A.FEATURES])
    s = t.groupBy("patient").agg(F.count("*").alias("n"), F.min(F.size("values")).alias("short"), F.max(F.size("values")).alias("long"), F.bool_and(ok).alias("finite"), *[F.count(F.when(F.col("label") == c, 1)).alias(f"n{c}") for c in range(3)])
    s = s.withColumns({"declared": F.col("n") + F.when(p % 5 == 0, 1).otherwise(0), "declared1": F.col("n1") - F.when(p % 7 == 3, 1).otherwise(0), "rate": F.when(p % 4 == 1, 128.001).when(p % 4 == 2, 128.0000001).otherwise(128.0)})
    rules = {
        "shape": ((F.col("short") == len(A.FEATURES)) & (F.col("long") == len(A.FEATURES)), "FAIL"),
        "declared windows": (F.col("n") == F.col("declared"), "FAIL"),
        "declared classes": (F.col("n1") == F.col("declared1"), "FAIL"),
        "rate": (F.abs(F.col("rate") - 128.0) <= 1e-6, "FAIL"),
        "finite": (F.col("finite"), "FAIL"),
    }
    return Q.audit(s, "patient", rules)


def leakage_nested(spark: SparkSession, d: str) -> DataFrame:
    """Inner sides of suppliers' folds: fold 2 leaves some out, fold 3 has some on both sides, fold 4 trains on some that it holds out."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("patient"))
    held = s.withColumn("fold", (F.col("patient") % 5).cast("int"))
    k, f = F.col("patient"), F.col("fold")
    each = s.crossJoin(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("fold")))).withColumn("role", F.when(k % 4 == f % 4, "validation").otherwise("train"))
    inner = each.where((k % 5 != f) & ~((f == 2) & (k % 7 == 0)) | (f == 4) & (k % 5 == 4) & (k % 13 == 0))
    twice = each.where((f == 3) & (k % 11 == 0) & (k % 5 != 3)).withColumn("role", F.when(F.col("role") == "train", "validation").otherwise("train"))
    return D.nested_leakage(held, inner.unionByName(twice), "patient", "fold")


def channel_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Users of all events against those with an error event of a high value."""
    ev = table(spark, d, "events")
    return Q.coverage(ev, ev.where("event_type = 'error' and value > 95"), "user_id")


def gate_run(spark: SparkSession, d: str) -> DataFrame:
    """What stops a run over error events (no metadata for every seventeenth, an offset not after the onset for low values), and how many rows go on."""
    ev = table(spark, d, "events").where("event_type = 'error'").withColumns({"t": F.floor(seconds()), "focus": Q.iri(F.lit("seizure"), "event_id")})
    graph = Q.triples(ev.where("event_id % 17 <> 0"), F.col("focus"), [("hasOnset", F.col("t"), "float"), ("hasOffset", F.col("t") + F.floor(F.col("value")) - 20, "float")])
    graphs, bad, rows = graph.select(F.col("s").alias("focus")).distinct(), Q.pair_violations(graph).select("focus"), ev.select("focus", "event_id")
    reasons = Q.gate_reasons(rows, graphs, bad, "focus").groupBy("reason").agg(F.count("*").alias("n"))
    good = rows.join(bad, "focus", "left_anti").join(graphs, "focus", "left_semi")
    on = Q.gate_all(rows, graphs, bad, "focus").agg(F.count("*").alias("n")).select(F.lit("rows of the whole run that go on").alias("reason"), "n")
    clean = Q.gate_all(good, graphs, bad, "focus").agg(F.count("*").alias("n")).select(F.lit("rows of a clean run that go on").alias("reason"), "n")
    return reasons.unionByName(on).unionByName(clean)


def standardise_all(spark: SparkSession, d: str) -> DataFrame:
    """All 64 columns by the standardiser of the training patients, for the others; long form."""
    names = [f"x{i}" for i in range(64)]
    t = windows(spark, d).select("patient", "vec_id", *[F.element_at("x", i + 1).alias(c) for i, c in enumerate(names)])
    out = B.standardised(t.where("patient % 4 = 0"), names, *B.standardiser(t.where("patient % 4 <> 0"), names))
    return out.select("vec_id", F.posexplode(F.array(*names)).alias("place", "z")).withColumn("z", r6(F.col("z")))


QUERIES = {f.__name__: f for f in (catalogue_annotated, window_rejections, feature_matrix, feature_contract, leakage_nested, channel_coverage, gate_run, standardise_all)}

_RULES = (("shape", "TRUE"), ("declared windows", "patient%5<>0"), ("declared classes", "patient%7<>3"), ("rate", "patient%4<>1"), ("finite", "TRUE"))
_ERRORS = "e AS (SELECT event_id, floor(value) AS v, event_id%17=0 AS lacks, event_id%17<>0 AND floor(value)-20<=0 AS bad FROM events WHERE event_type='error')"
ORACLES = {
    "catalogue_annotated": "SELECT subject, 1::BIGINT AS recordings, subject%2=0 AS has_summary, subject%2=0 AS attached, CASE WHEN subject%2=1 THEN 'no annotation file' END AS warning FROM (SELECT subject FROM (SELECT DISTINCT user_id%20 AS subject FROM events) ORDER BY subject::VARCHAR LIMIT 12)",
    "window_rejections": f"""WITH {WINDOWS_SQL}, w AS (SELECT patient, CASE WHEN patient%6=1 AND vec_id%3=0 THEN NULL WHEN patient%7=2 AND vec_id%5<>1 THEN 5 ELSE label END AS y FROM win), g AS (SELECT patient, count(*) AS n, count(y) AS l, count(*) FILTER (y NOT BETWEEN 0 AND 2) AS s FROM w GROUP BY patient)
      SELECT patient, n AS n_windows, CASE WHEN n<>l THEN 'counts differ' WHEN s>0 THEN 'labels out of range' END AS problem FROM g UNION ALL SELECT patient+20, 0::BIGINT, 'no windows' FROM g WHERE patient%10=3""",
    "feature_matrix": f"WITH {FEATURES_SQL}, w AS (SELECT vec_id//20 AS win, vec_id%20 AS ch, * FROM ft), f AS (SELECT win FROM w GROUP BY win HAVING count(*)=20) "
    + " UNION ALL ".join(f"SELECT win, (ch*11+{i})::INT AS position, ch||'__{k}' AS name, round({k},6) AS value FROM w SEMI JOIN f USING (win)" for i, k in enumerate(A.FEATURES)),
    "feature_contract": "WITH p AS (SELECT DISTINCT vec_id%20 AS patient FROM embeddings) " + " UNION ALL ".join(f"SELECT patient, '{n}' AS rule, CASE WHEN {c} THEN 'PASS' ELSE 'FAIL' END AS severity FROM p" for n, c in _RULES),
    "leakage_nested": """WITH s AS (SELECT s_suppkey AS k, f::INT AS fold FROM supplier, range(5) g(f)) SELECT fold, 'on both inner sides' AS rule, count(*) FILTER (fold=3 AND k%11=0 AND k%5<>3) AS violations FROM s GROUP BY fold
      UNION ALL SELECT fold, 'inner but held out', count(*) FILTER (fold=4 AND k%5=4 AND k%13=0) FROM s GROUP BY fold UNION ALL SELECT fold, 'outer train on no inner side', count(*) FILTER (fold=2 AND k%7=0 AND k%5<>2) FROM s GROUP BY fold""",
    "channel_coverage": "WITH a AS (SELECT count(DISTINCT user_id) AS expected, count(DISTINCT user_id) FILTER (event_type='error' AND value>95) AS available FROM events) SELECT expected, available, expected-available AS missing, CASE WHEN available=0 THEN 'FAIL' WHEN expected>available THEN 'WARN' ELSE 'PASS' END AS severity FROM a",
    "gate_run": f"""WITH {_ERRORS} SELECT reason, n FROM (SELECT 'no graph' AS reason, count(*) FILTER (lacks) AS n FROM e UNION ALL SELECT 'does not conform', count(*) FILTER (bad) FROM e) WHERE n>0
      UNION ALL SELECT 'rows of the whole run that go on', CASE WHEN count(*) FILTER (lacks OR bad)>0 THEN 0 ELSE count(*) END FROM e UNION ALL SELECT 'rows of a clean run that go on', count(*) FILTER (NOT lacks AND NOT bad) FROM e""",
    "standardise_all": f"""WITH {WINDOWS_SQL}, u AS (SELECT vec_id, patient, unnest(range(64)) AS i, unnest(x) AS v FROM win), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u WHERE patient%4<>0 GROUP BY i)
      SELECT vec_id, i::INT AS place, round((v-m)/CASE WHEN s<1e-8 THEN 1 ELSE s END,6) AS z FROM u JOIN s USING (i) WHERE patient%4=0""",
}
