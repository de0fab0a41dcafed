"""Scans and sinks: annotation texts, interval tables, catalogues, split files, window and feature tables, manifests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise

# Labels of an interval that count as a seizure.
SEIZURE_LABELS = ("seiz", "gnsz", "fnsz", "cpsz", "spsz", "tcsz", "tnsz", "absz", "atsz", "mysz")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Annotation summaries, one row an interval: (file, onset, offset).

    A text is cut into blocks at 'File Name:'; only the first block of a file counts; starts and ends are paired by position
    and the longer list is cut; pairs that do not begin before they end are dropped.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("from", F.col("_metadata.file_path"))
    return parse_summaries(text)


def parse_summaries(text: DataFrame) -> DataFrame:
    """As `read_summaries`, over a table (value, from)."""
    blocks = text.select("from", F.posexplode(F.split("value", r"(?i)(?=File Name:)")).alias("no", "block"))
    pick = lambda pattern: F.regexp_extract("block", pattern, 1)
    numbers = lambda word: F.transform(F.regexp_extract_all("block", F.lit(rf"(?i)Seizure\s*\d*\s*{word}\s*Time:\s*(\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    named = blocks.select("from", "no", F.trim(pick(r"(?i)File Name:\s*(\S+)")).alias("file"), F.expr("try_cast(nullif(regexp_extract(block, '(?i)Number of Seizures in File:\\\\s*(\\\\d+)', 1), '') as int)").alias("count"), numbers("Start").alias("starts"), numbers("End").alias("ends"))
    first = named.where("file <> ''").groupBy("from", "file").agg(F.min_by(F.struct("count", "starts", "ends"), "no").alias("b")).select("file", "b.*")
    n = F.least(F.size("starts"), F.size("ends"))
    pairs = F.arrays_zip(F.slice("starts", 1, n).alias("onset"), F.slice("ends", 1, n).alias("offset"))
    return first.where("count > 0").select("file", F.inline(pairs)).where("onset < offset")


def read_intervals(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Interval tables (CSV with # comments), one row an interval: (file, onset, offset).

    Headers are trimmed and lowered; the label is in label, else type; the confidence in confidence, else prob, else 1;
    seizure labels with a confidence of 0.5 or more stay. Of a stem's files, .csv_bi goes before .csv.
    """
    raw = spark.read.text(paths, recursiveFileLookup=True).withColumn("from", F.col("_metadata.file_path"))
    raw = raw.withColumn("stem", F.regexp_replace("from", r"\.csv(_bi)?$", "")).withColumn("better", F.col("from").endswith("_bi"))
    chosen = raw.select("stem", "from", "better").distinct().groupBy("stem").agg(F.max_by("from", "better").alias("from"))
    lines = raw.join(chosen, ["stem", "from"], "left_semi").where(~F.col("value").rlike(r"^\s*(#|$)"))
    cells = F.transform(F.split("value", ",", -1), lambda c: F.trim(c))
    header = F.col("value").rlike(r"(?i)start_time")
    heads = lines.where(header).groupBy("from").agg(F.min(F.lower("value")).alias("h")).select("from", F.transform(F.split("h", ","), lambda c: F.trim(c)).alias("names"))
    rows = lines.where(~header).select("stem", "from", cells.alias("cells")).join(heads, "from").withColumn("m", F.map_from_arrays("names", F.slice("cells", 1, F.size("names"))))
    get = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    confidence = F.coalesce(get("confidence", "prob").try_cast("double"), F.lit(1.0))
    kept = rows.where(F.lower(get("label", "type")).isin(*SEIZURE_LABELS) & (confidence >= 0.5))
    return kept.select(F.regexp_extract("stem", r"([^/]+)$", 1).alias("file"), get("start_time").try_cast("double").alias("onset"), get("stop_time").try_cast("double").alias("offset"))


def catalogue(spark: SparkSession, path: str, pattern: str, first: int | None = None) -> DataFrame:
    """(subject, recordings, bytes, has_summary, annotation, warning) of a folder of subjects; contents are not read.

    `pattern` has the subject as group 1 and the file name as group 2. The annotation file of a subject is its (first)
    summary; a subject without one stays, with a warning. Subjects without recordings go. With `first`, only the first
    subjects in order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    named = files.select(F.regexp_extract("path", pattern, 1).alias("subject"), F.regexp_extract("path", pattern, 2).alias("name"), "length").where("subject <> ''")
    summary = F.col("name").rlike(r"(?i)summary")
    sums = named.groupBy("subject").agg(F.sum(F.when(summary, 0).otherwise(1)).alias("recordings"), F.sum("length").alias("bytes"), F.max(summary).alias("has_summary"), F.min(F.when(summary, F.col("name"))).alias("annotation"))
    out = sums.where("recordings > 0").withColumn("warning", F.when(~F.col("has_summary"), "no annotation file"))
    return out.orderBy("subject").limit(first) if first else out


def read_windows(df: DataFrame) -> DataFrame:
    """A window table under either set of names: epochs or X, labels or y, sfreq or sampling_rate (128 if neither); labels outside 0 to 2 are an error column."""
    have = set(df.columns)

    def pick(*names: str, default: Column | None = None) -> Column:
        there = [F.col(n) for n in names if n in have]
        if default is not None:
            there.append(default)
        if not there:
            raise ValueError(f"none of {names} is in the table")
        return F.coalesce(*there)

    label = pick("labels", "y").cast("int")
    rest = [c for c in df.columns if c not in ("epochs", "X", "labels", "y", "sfreq", "sampling_rate")]
    return df.select(*rest, pick("epochs", "X").alias("signal"), label.alias("label"), pick("sfreq", "sampling_rate", default=F.lit(128.0)).cast("double").alias("rate"), F.coalesce(label.between(0, 2), F.lit(False)).alias("valid"))


def window_problems(windows: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, n_windows, problem) of every declared set, from a table as `read_windows` gives it: no windows, as many signals as labels or not, labels outside 0 to 2; NULL if nothing is wrong."""
    sums = windows.groupBy(key).agg(F.count("*").alias("n"), F.count("signal").alias("signals"), F.count("label").alias("labels"), F.count(F.when(F.col("label").isNotNull() & ~F.col("valid"), 1)).alias("strange"))
    both = declared.select(key).distinct().join(sums, key, "left").withColumn("n_windows", F.coalesce("n", F.lit(0)))
    problem = F.when(F.col("n_windows") == 0, "no windows").when(F.col("signals") != F.col("labels"), "counts differ").when(F.col("strange") > 0, "labels out of range")
    return both.select(key, "n_windows", problem.alias("problem"))


def accepted_windows(windows: DataFrame, declared: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The windows of sets without a problem; if strict, any problem is an error instead."""
    found = window_problems(windows, declared, key)
    if strict:
        bad = found.where("problem is not null").orderBy(key).limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r[key]}: {r.problem}" for r in bad))
    return windows.join(found.where("problem is null"), key, "left_semi")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split_name, side, patient) of JSON split files; val is an alias of validation. A missing side or a patient listed twice is an error."""
    raw = spark.read.option("multiLine", True).json(path)
    val = F.coalesce(*[F.col(c) for c in ("validation", "val") if c in raw.columns]) if {"validation", "val"} & set(raw.columns) else None
    if val is None or not {"train", "test"} <= set(raw.columns):
        raise ValueError("a split file needs train, validation (or val) and test")
    sides = F.array(*[F.struct(F.lit(n).alias("side"), c.alias("patients")) for n, c in (("train", F.col("train")), ("validation", val), ("test", F.col("test")))])
    rows = raw.select("split_name", F.inline(sides)).select("split_name", "side", F.explode("patients").alias("patient"))
    twice = rows.groupBy("split_name", "patient").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a patient is listed twice")
    return rows


def resolve_split(split: DataFrame, entries: DataFrame, patient: str) -> DataFrame:
    """split with n_entries, the data entries of each patient, and resolved: exactly one."""
    n = entries.groupBy(patient).agg(F.count("*").alias("n_entries"))
    return split.join(n, patient, "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0))).withColumn("resolved", F.col("n_entries") == 1)


def write_windows(windows: DataFrame, path: str, patient: str, label: str) -> DataFrame:
    """Write windows partitioned by patient; returns each patient's class counts, read back from what was written."""
    windows.write.mode("overwrite").partitionBy(patient).parquet(path)
    back = windows.sparkSession.read.parquet(path)
    return back.groupBy(patient).agg(F.count("*").alias("n_windows"), *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"n_{c}") for c in range(3)])


def _sums(rows: DataFrame, patient: str) -> DataFrame:
    """(patient, rows, checksum) by all columns, whatever the order of rows."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    return rows.groupBy(patient).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("checksum"))


_COMMIT = "attempt string, number long, rows long, checksum decimal(30,0)"


def committed(spark: SparkSession, path: str, patient: str) -> DataFrame | None:
    """(patient, attempt, number, rows, checksum): the last attempt that was committed for each patient; None before the first."""
    if not _exists(spark, f"{path}/commits"):
        return None
    log = spark.read.parquet(f"{path}/commits")
    return log.groupBy(patient).agg(F.max_by(F.struct("attempt", "number", "rows", "checksum"), F.col("number")).alias("c")).select(patient, "c.*")


def read_features(spark: SparkSession, path: str, patient: str) -> DataFrame:
    """The rows of committed attempts; what a run that stopped has left is not seen."""
    log = committed(spark, path, patient).select(F.col(patient).alias("_patient"), F.col("attempt").alias("_attempt"))
    data = spark.read.parquet(f"{path}/data")
    return data.join(log, F.col(patient).eqNullSafe(F.col("_patient")) & (F.col("attempt") == F.col("_attempt")), "left_semi").drop("attempt")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stage_features(features: DataFrame, path: str, patient: str, attempt: str) -> None:
    """Write rows into the folder of one attempt; nobody reads them before they are committed."""
    features.write.parquet(f"{path}/data/attempt={attempt}")


def resume_features(features: DataFrame, path: str, patient: str, overwrite: bool = False) -> DataFrame:
    """Write the patients of `features` that are not there whole; (patient, expected, saved, ok, how), how being kept, written, repaired or replaced.

    A run writes its rows into a folder of its own, reads them back, and then appends one commit a patient (attempt, rows,
    checksum) to the commit table. A patient is done if what its last committed attempt holds on disk has the rows and the
    checksum of its commit and of `features`; all others are written again, whether there is nothing, a part without a commit
    or damage behind a commit. With `overwrite` all given patients are written again and supersede what was there.
    """
    spark = features.sparkSession
    want = materialise(_sums(features, patient), "expected")
    log = committed(spark, path, patient)
    number = 0
    state = want.select(patient, "rows", "checksum").withColumns({"_known": F.lit(False), "_whole": F.lit(False)})
    if log is not None:
        number = log.agg(F.max("number")).first()[0] + 1
        there = _sums(read_features(spark, path, patient), patient).select(F.col(patient).alias("_p"), F.col("rows").alias("_rows"), F.col("checksum").alias("_sum"))
        noted = log.select(F.col(patient).alias("_q"), F.col("rows").alias("_crows"), F.col("checksum").alias("_csum"))
        met = want.join(there, F.col(patient).eqNullSafe(F.col("_p")), "left").join(noted, F.col(patient).eqNullSafe(F.col("_q")), "left")
        same = (F.col("_rows") == F.col("rows")) & (F.col("_sum") == F.col("checksum")) & (F.col("_crows") == F.col("rows")) & (F.col("_csum") == F.col("checksum"))
        state = met.select(patient, "rows", "checksum", F.col("_crows").isNotNull().alias("_known"), F.coalesce(same, F.lit(False)).alias("_whole"))
    state = materialise(state, "state")
    attempt = uuid.uuid4().hex
    due = state if overwrite else state.where(~F.col("_whole"))
    todo = features.join(due.select(F.col(patient).alias("_p")), F.col(patient).eqNullSafe(F.col("_p")), "left_semi")
    stage_features(todo, path, patient, attempt)
    back = _sums(spark.read.schema(features.schema).parquet(f"{path}/data/attempt={attempt}"), patient).select(F.col(patient).alias("_p"), F.col("rows").alias("_rows"), F.col("checksum").alias("_sum"))
    right = due.join(back, F.col(patient).eqNullSafe(F.col("_p")) & (F.col("rows") == F.col("_rows")) & (F.col("checksum") == F.col("_sum")), "left_semi")
    commits = right.select(patient, F.lit(attempt).alias("attempt"), F.lit(number).cast("long").alias("number"), "rows", F.col("checksum").cast("decimal(30,0)").alias("checksum"))
    commits.write.mode("append").parquet(f"{path}/commits")
    saved = read_features(spark, path, patient).groupBy(F.col(patient).alias("_p")).agg(F.count("*").alias("saved"))
    how = F.when(F.lit(overwrite), F.when(F.col("_known"), "replaced").otherwise("written")).when(F.col("_whole"), "kept").when(F.col("_known"), "repaired").otherwise("written")
    met = state.withColumn("how", how).join(saved, F.col(patient).eqNullSafe(F.col("_p")), "left")
    return met.select(patient, F.col("rows").alias("expected"), "saved", F.coalesce(F.col("rows") == F.col("saved"), F.lit(False)).alias("ok"), "how")


#: Bytes that a task reads of a file at a time.
PIECE = 1 << 20


def file_digests(files: DataFrame) -> DataFrame:
    """(path, length, md5, sha256) of listed files (uri): each is read in pieces by one task, so its size doesn't matter."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, str, str]] = []
            for uri in batch.column("uri").to_pylist():
                fs, name = pafs.FileSystem.from_uri(uri)
                md5, sha, length = hashlib.md5(), hashlib.sha256(), 0
                with fs.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        md5.update(piece)
                        sha.update(piece)
                        length += len(piece)
                found.append((unquote(uri), length, md5.hexdigest(), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "length", "md5", "sha256"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("uri").repartition(n, "uri").mapInArrow(digest, "path string, length long, md5 string, sha256 string")


def manifest(spark: SparkSession, path: str, pattern: str, expected: DataFrame | None = None) -> DataFrame:
    """(name, bytes, md5, sha256, status) of files; against `expected` (name, md5): ok, changed, missing or unexpected."""
    # the listing alone, empty files included: no content is read here
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    files = spark.createDataFrame(pa.table({"uri": pa.array(listed, pa.string())}))
    named = file_digests(files).withColumn("name", F.regexp_extract("path", pattern, 1)).where("name <> ''")
    got = named.select("name", F.col("length").alias("bytes"), "md5", "sha256")
    if expected is None:
        return got.withColumn("status", F.lit("ok"))
    both = got.join(expected.select("name", F.col("md5").alias("_md5")), "name", "full")
    state = F.when(F.col("md5").isNull(), "missing").when(F.col("_md5").isNull(), "unexpected").when(F.col("md5") == F.col("_md5"), "ok").otherwise("changed")
    return both.withColumn("status", state).drop("_md5")


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Write a table as CSV with a header and read it back with the same types."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)
