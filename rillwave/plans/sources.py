"""Queries of scans and sinks: files are written from the given tables to the scratch folder and read back through the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise, scratch_path, with_global_number
from rillwave.sources import recordings as S

from .tables import ORIGIN, pred_sql, predictions, r6, seconds, table, windows

_LABELS = {"click": "gnsz", "view": "fnsz", "purchase": "bckg", "error": "seiz"}


def summary_scan(spark: SparkSession, d: str) -> DataFrame:
    """A summary text for each user from its error events (whole seconds), scanned back; every fifth has an end too few, every seventh a count of 0."""
    ev = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.floor(seconds()).cast("long").alias("t"), "event_id")
    each = ev.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id"))).alias("e"))
    line = lambda word, add: F.transform("e", lambda x, i: F.concat(F.lit("Seizure "), (i + 1).cast("string"), F.lit(f" {word} Time: "), (x["t"] + add).cast("string"), F.lit(" seconds")))
    ends = F.when(F.col("user_id") % 5 == 0, F.slice(line("End", 3600), 1, F.size("e") - 1)).otherwise(line("End", 3600))
    count = F.when(F.col("user_id") % 7 == 0, F.lit(0)).otherwise(F.size("e"))
    text = F.concat_ws("\n", F.concat(F.lit("File Name: u"), F.col("user_id").cast("string"), F.lit(".edf")), F.concat(F.lit("Number of Seizures in File: "), count.cast("string")), F.array_join(line("Start", 0), "\n"), F.array_join(ends, "\n"))
    path = scratch_path(spark, "summaries")
    each.select(text.alias("value")).write.text(path)
    found = S.read_summaries(spark, path)
    return found.select(F.regexp_extract("file", r"u(\d+)", 1).cast("long").alias("user_id"), "onset", "offset")


def interval_csv(spark: SparkSession, d: str) -> DataFrame:
    """Interval tables of users modulo 8 (with comments and a header), events of seizure kinds with confidence value / 100."""
    ev = table(spark, d, "events").select((F.col("user_id") % 8).alias("part"), F.floor(seconds()).alias("t"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair]), F.col("event_type")), F.lit("bckg")).alias("label"), F.round(F.col("value") / 100, 4).alias("confidence"), "event_id")
    path = scratch_path(spark, "intervals")
    rows = ev.select("part", F.lit(1).alias("o"), F.concat_ws(",", F.lit("TERM"), F.col("t").cast("string"), (F.col("t") + 60).cast("string"), F.upper("label"), F.format_string("%.4f", "confidence")).alias("value"))
    heads = ev.select("part").distinct().select("part", F.lit(0).alias("o"), F.explode(F.array(F.lit("# version = 1"), F.lit(" Channel, Start_time, stop_time, Label, confidence"))).alias("value"))
    heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "o", "value").select("part", "value").write.partitionBy("part").text(path)
    found = S.read_intervals(spark, path)
    return found.groupBy("onset", "offset").agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of users' subjects written as files, listed without reading them."""
    ev = table(spark, d, "events").select((F.col("user_id") % 20).alias("subject"), "event_id")
    path = scratch_path(spark, "catalogue")
    ev.repartition("subject").select("subject", F.col("event_id").cast("string").alias("value")).write.partitionBy("subject").text(path)
    return S.catalogue(spark, path, r"subject=(\d+)/([^/]+)$").select(F.col("subject").cast("long").alias("subject"), "recordings", "bytes", "has_summary")


def alias_read(spark: SparkSession, d: str) -> DataFrame:
    """The same windows under both sets of names."""
    w = windows(spark, d)
    one = S.read_windows(w.select("vec_id", F.col("x").alias("epochs"), F.col("label").alias("labels"), F.lit(256.0).alias("sfreq")))
    two = S.read_windows(w.select("vec_id", F.col("x").alias("X"), (F.col("vec_id") % 5).alias("y")))
    return one.unionByName(two).groupBy("rate", "label", "valid").agg(F.count("*").alias("n"), r6(F.sum(F.element_at("signal", 1))).alias("first"))


def _write_splits(spark: SparkSession, d: str) -> str:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    side = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("k"))))
    path = scratch_path(spark, "splits")
    s.groupBy((F.col("k") % 3).alias("g")).agg(side(F.col("k") % 5 > 1).alias("train"), side(F.col("k") % 5 == 1).alias("val"), side(F.col("k") % 5 == 0).alias("test")).select(F.concat(F.lit("split_"), "g").alias("split_name"), "train", "val", "test").write.option("maxRecordsPerFile", 1).json(path)
    return path


def split_read(spark: SparkSession, d: str) -> DataFrame:
    return S.read_splits(spark, _write_splits(spark, d))


def resolve_split(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of the split files against the suppliers of lines with a large discount."""
    split = S.read_splits(spark, _write_splits(spark, d))
    entries = table(spark, d, "lineitem").where("l_discount >= 0.05 and l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("patient"), (F.col("l_suppkey") % 3).alias("e")).distinct()
    more = entries.where("patient % 9 = 0").withColumn("e", F.lit(9).cast("long"))
    return S.resolve_split(split, entries.unionByName(more), "patient").select("split_name", "side", "patient", "n_entries", "resolved")


def window_sink(spark: SparkSession, d: str) -> DataFrame:
    return S.write_windows(windows(spark, d).select("patient", "vec_id", "label", "x"), scratch_path(spark, "windows"), "patient", "label").withColumn("patient", F.col("patient").cast("long"))


def resume_sink(spark: SparkSession, d: str) -> DataFrame:
    """A run that stops after patients under 8 and is taken up again."""
    w = windows(spark, d).select("patient", "vec_id", "label")
    path = scratch_path(spark, "features")
    S.resume_features(w.where("patient < 8"), path, "patient")
    return S.resume_features(w, path, "patient").select("patient", "expected", "saved", "ok")


def resume_repair(spark: SparkSession, d: str) -> DataFrame:
    """Four runs over one folder: patients under 8; a run that stops with half of patients 8 to 11 written; all patients; and patients under 4 again with other labels."""
    w = windows(spark, d).select("patient", "vec_id", "label")
    path = scratch_path(spark, "features")
    S.resume_features(w.where("patient < 8"), path, "patient")
    S.stage_features(w.where("patient between 8 and 11 and vec_id % 40 < 20"), path, "patient", "stopped")
    second = S.resume_features(w, path, "patient").select("patient", F.col("how").alias("second"))
    third = S.resume_features(w.where("patient < 4").withColumn("label", F.col("label") + 10), path, "patient", overwrite=True).select("patient", F.col("how").alias("third"))
    now = S.read_features(spark, path, "patient").groupBy("patient").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
    return now.join(second, "patient", "left").join(third, "patient", "left")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of files of event ids by user modulo 16, against the sums of what should be in them; files that divide by 5 are changed."""
    ev = table(spark, d, "events").select((F.col("user_id") % 16).alias("part"), "event_id")
    text = ev.groupBy("part").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda v: v.cast("string")), "\n"), F.lit("\n")).alias("t"))
    expected = text.select(F.concat(F.lit("part="), "part").alias("name"), F.md5(F.concat("t", F.when(F.col("part") % 5 == 0, "x").otherwise(""))).alias("md5"))
    path = scratch_path(spark, "manifest")
    ev.repartition("part").sortWithinPartitions("part", "event_id").select("part", F.col("event_id").cast("string").alias("value")).write.partitionBy("part").text(path)
    return S.manifest(spark, path, r"(part=\d+)/", expected).select("name", "bytes", "md5", "status")


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Both checksums of files of 500 events each, so there are as many as the rows ask for; every fifth is expected otherwise, one is expected that is not there."""
    ev = with_global_number(table(spark, d, "events").select("event_id", "event_type"), [F.col("event_id")], "no").withColumn("part", F.floor(F.col("no") / 500))
    ev = materialise(ev, "events")
    line = F.concat_ws(",", "event_id", "event_type")
    text = ev.groupBy("part").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", line.alias("v")))), lambda x: x["v"]), "\n"), F.lit("\n")).alias("t"))
    expected = text.select(F.concat(F.lit("part="), "part").alias("name"), F.md5(F.concat("t", F.when(F.col("part") % 5 == 0, "x").otherwise(""))).alias("md5"))
    expected = expected.unionByName(spark.createDataFrame([("part=none", "")], "name string, md5 string"))
    path = scratch_path(spark, "manifest")
    ev.repartition("part").sortWithinPartitions("part", "no").select("part", line.alias("value")).write.partitionBy("part").text(path)
    return S.manifest(spark, path, r"(part=\d+)/", expected).select("name", "bytes", "md5", "sha256", "status")


def report_sink(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).groupBy("patient").agg(F.count("*").alias("n_windows"), *[F.sum(F.when(F.col("truth") == c, 1).otherwise(0)).alias(f"n_{c}") for c in range(3)], r6(F.avg("p1")).alias("mean_p1"))
    return S.write_report(p, scratch_path(spark, "report"))


QUERIES = {f.__name__: f for f in (summary_scan, interval_csv, catalogue, alias_read, split_read, resolve_split, window_sink, resume_sink, resume_repair, manifest, manifest_files, report_sink)}

_T = f"floor(epoch_us(ts)/1e6-{ORIGIN})"
_WIN = "win AS (SELECT vec_id, vec_id%20 AS patient, (label%3)::INT AS label, embedding[1]::DOUBLE AS first FROM embeddings)"
_SPLIT = "sp AS (SELECT 'split_'||(s_suppkey%3) AS split_name, CASE WHEN s_suppkey%5>1 THEN 'train' WHEN s_suppkey%5=1 THEN 'validation' ELSE 'test' END AS side, s_suppkey AS patient FROM supplier)"
ORACLES = {
    "summary_scan": f"""WITH e AS (SELECT user_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type='error')
      SELECT user_id, t AS onset, t+3600 AS "offset" FROM e WHERE user_id%7<>0 AND (user_id%5<>0 OR rn<n)""",
    "interval_csv": f"SELECT {_T} AS onset, {_T}+60 AS \"offset\", count(*) AS n FROM events WHERE event_type IN ('click','view','error') AND round(value/100,4)>=0.5 GROUP BY ALL",
    "catalogue": "SELECT user_id%20 AS subject, 1::BIGINT AS recordings, sum(length(event_id::VARCHAR)+1)::BIGINT AS bytes, FALSE AS has_summary FROM events GROUP BY 1",
    "alias_read": f"WITH {_WIN} SELECT 256.0::DOUBLE AS rate, label, TRUE AS valid, count(*) AS n, round(sum(first),6) AS first FROM win GROUP BY label UNION ALL SELECT 128.0, (vec_id%5)::INT, vec_id%5<=2, count(*), round(sum(first),6) FROM win GROUP BY vec_id%5",
    "split_read": f"WITH {_SPLIT} SELECT * FROM sp",
    "resolve_split": f"WITH {_SPLIT}, e AS (SELECT DISTINCT l_suppkey AS patient FROM lineitem WHERE l_discount>=0.05 AND l_suppkey%4<>0) SELECT split_name, side, sp.patient, (CASE WHEN e.patient IS NULL THEN 0 WHEN sp.patient%9=0 THEN 2 ELSE 1 END)::BIGINT AS n_entries, e.patient IS NOT NULL AND sp.patient%9<>0 AS resolved FROM sp LEFT JOIN e ON e.patient=sp.patient",
    "window_sink": f"WITH {_WIN} SELECT patient, count(*) AS n_windows, count(*) FILTER (label=0) AS n_0, count(*) FILTER (label=1) AS n_1, count(*) FILTER (label=2) AS n_2 FROM win GROUP BY patient",
    "resume_sink": f"WITH {_WIN} SELECT patient, count(*) AS expected, count(*) AS saved, TRUE AS ok FROM win GROUP BY patient",
    "manifest": "WITH t AS (SELECT user_id%16 AS part, string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id)||chr(10) AS t FROM events GROUP BY 1) SELECT 'part='||part AS name, length(t) AS bytes, md5(t) AS md5, CASE WHEN part%5=0 THEN 'changed' ELSE 'ok' END AS status FROM t",
    "resume_repair": f"""WITH {_WIN} SELECT patient, count(*) AS n, sum(label + CASE WHEN patient < 4 THEN 10 ELSE 0 END)::BIGINT AS labels, CASE WHEN patient < 8 THEN 'kept' ELSE 'written' END AS second, CASE WHEN patient < 4 THEN 'replaced' END AS third FROM win GROUP BY patient""",
    "manifest_files": """WITH e AS (SELECT event_id, event_type, (row_number() OVER (ORDER BY event_id)-1)//500 AS part FROM events),
      t AS (SELECT part, string_agg(event_id||','||event_type, chr(10) ORDER BY event_id)||chr(10) AS t FROM e GROUP BY part)
      SELECT 'part='||part AS name, strlen(t) AS bytes, md5(t) AS md5, sha256(t) AS sha256, CASE WHEN part%5=0 THEN 'changed' ELSE 'ok' END AS status FROM t UNION ALL SELECT 'part=none', NULL, NULL, NULL, 'missing'""",
    "report_sink": f"WITH {pred_sql()} SELECT patient, count(*) AS n_windows, count(*) FILTER (truth=0) AS n_0, count(*) FILTER (truth=1) AS n_1, count(*) FILTER (truth=2) AS n_2, round(avg(p1),6) AS mean_p1 FROM pred GROUP BY patient",
}
