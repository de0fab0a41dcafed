"""Data contracts and metadata graphs: rules are rows, findings are rows, and a gate is a join.

Triples have the columns s, p, o (all strings), and kind ('iri' or a datatype name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("PASS", "WARN", "FAIL")

# The evidence patterns, searched without regard to case.
EVIDENCE = (
    r"pre[-_ ]?ictal",
    r"prediction[_ -]?horizon",
    r"seizure[_ -]?prediction[_ -]?horizon",
    r"seizure[_ -]?occurrence[_ -]?period",
    r"post[-_ ]?ictal",
    r"exclusion[_ -]?period",
    r"seizure[_ -]?onset",
    r"label[_ -]?map",
    r"class[_ -]?map",
)

# The shapes' property rules. Bounds that are None are not checked.
#: (class, path, least, most, datatype, shortest, low, high, object class)
SHAPES = (
    ("Patient", "subjectID", 1, 1, "string", 1, None, None, None),
    ("Patient", "hasSession", 1, None, None, None, None, None, "RecordingSession"),
    ("RecordingSession", "hasChannel", 19, None, None, None, None, None, "EEGChannel"),
    ("RecordingSession", "hasSamplingRate", 1, 1, None, None, None, None, "SamplingRate"),
    ("RecordingSession", "sessionID", 1, 1, "string", 1, None, None, None),
    ("RecordingSession", "hasPreprocessingStep", 1, None, None, None, None, None, "PreprocessingStep"),
    ("SamplingRate", "frequencyHz", 1, 1, "float", None, 128.0, 600.0, None),
    ("EEGChannel", "channelLabel", 1, 1, "string", 1, None, None, None),
    ("SeizureEvent", "hasOnset", 1, 1, "float", None, 0.0, None, None),
    ("SeizureEvent", "hasOffset", 1, 1, "float", None, 0.0, None, None),
    ("SeizureEvent", "hasPreIctalWindow", None, None, None, None, None, None, "PreIctalWindow"),
    ("PreIctalWindow", "windowDuration", 1, 1, "float", None, 30.0, 120.0, None),
    ("PreIctalWindow", "windowStart", 1, 1, "float", None, 0.0, None, None),
    ("PreIctalWindow", "windowEnd", 1, 1, "float", None, 0.0, None, None),
    ("PreprocessingStep", "filterType", 1, 1, "string", 1, None, None, None),
    ("PreprocessingStep", "stepOrder", 1, 1, "integer", None, 1.0, None, None),
)
#: property: (domain, range) of the object properties.
AXIOMS = (
    ("hasSession", "Patient", "RecordingSession"),
    ("hasChannel", "RecordingSession", "EEGChannel"),
    ("hasSamplingRate", "RecordingSession", "SamplingRate"),
    ("hasSeizure", "RecordingSession", "SeizureEvent"),
    ("hasPreprocessingStep", "RecordingSession", "PreprocessingStep"),
    ("hasPreIctalWindow", "SeizureEvent", "PreIctalWindow"),
)
TYPE = "type"


def audit(entities: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, rule, severity): each rule is (passes, severity if not); NULL does not pass."""
    rows = [F.struct(F.lit(name).alias("rule"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(severity).alias("severity")) for name, (ok, severity) in rules.items()]
    return entities.select(key, F.inline(F.array(*rows)))


def status(findings: DataFrame, key: str) -> DataFrame:
    """(key, status): the worst severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.groupBy(key).agg(F.max_by("severity", rank).alias("status"))


def audit_report(findings: DataFrame, key: str) -> DataFrame:
    """(status, entities, overall, findings): counts by status, the worst of all, and the findings joined."""
    named = findings.where("severity <> 'PASS'").groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "severity", "rule"))), "; ").alias("text"))
    each = status(findings, key).join(named, key, "left")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("status"))
    worst = each.agg(F.max_by("status", rank).alias("overall"))
    counts = each.groupBy("status").agg(F.count("*").alias("entities"), F.count("text").alias("with_findings"))
    return counts.crossJoin(F.broadcast(worst))


def channel_order(channels: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n_channels, same_order, same_set) against the first entity; `order` is an array column."""
    first = channels.agg(F.min_by(order, key).alias("_ref"))
    both = channels.crossJoin(F.broadcast(first))
    return both.select(key, F.size(order).alias("n_channels"), (F.col(order) == F.col("_ref")).alias("same_order"), (F.array_sort(F.array_distinct(order)) == F.array_sort(F.array_distinct("_ref"))).alias("same_set"))


def compatibility(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """(key, verdict) of two datasets' channel arrays: missing, duplicates, exact, same set, different; in this priority."""
    both = a.select(key, F.col(order).alias("_a")).join(b.select(key, F.col(order).alias("_b")), key, "full")
    twice = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    verdict = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "MISSING")
        .when(twice("_a") | twice("_b"), "DUPLICATES")
        .when(F.col("_a") == F.col("_b"), "EXACT")
        .when(F.array_sort("_a") == F.array_sort("_b"), "SAME SET")
        .otherwise("DIFFERENT")
    )
    return both.select(key, verdict.alias("verdict"))


def reconcile(declared: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, declared, actual) where the two differ or one is missing."""
    both = declared.alias("d").join(actual.alias("a"), key, "full")
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"d.{c}").cast("long").alias("declared"), F.col(f"a.{c}").cast("long").alias("actual")) for c in columns]
    return both.select(key, F.inline(F.array(*rows))).where(~F.col("declared").eqNullSafe(F.col("actual")))


def evidence(texts: DataFrame, key: str, text: str, patterns: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """(key, line, found): lines, counted from 1, that any pattern meets; trimmed."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n", -1)).alias("_n", "_line"))
    return lines.where(F.col("_line").rlike("(?i)" + "|".join(patterns))).select(key, (F.col("_n") + 1).alias("line"), F.trim("_line").alias("found"))


def iri(*parts: Column | str) -> Column:
    """Deterministic id of the parts; what is unsafe becomes _."""
    return F.regexp_replace(F.concat_ws("_", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), r"[^A-Za-z0-9_.-]", "_")


def facts(rows: DataFrame, made: list[tuple[Column, str, Column, str]]) -> DataFrame:
    """(s, p, o, kind) of each row's facts (subject, property, object, kind) in one pass; a NULL subject or object gives no triple."""
    # subjects and objects are columns first: a name that several facts share is made once
    named = rows.select(*[s.alias(f"_s{i}") for i, (s, _, _, _) in enumerate(made)], *[o.cast("string").alias(f"_o{i}") for i, (_, _, o, _) in enumerate(made)])
    structs = [F.struct(F.col(f"_s{i}").alias("s"), F.lit(p).alias("p"), F.col(f"_o{i}").alias("o"), F.lit(kind).alias("kind")) for i, (_, p, _, kind) in enumerate(made)]
    return named.select(F.inline(F.array(*structs))).where("s is not null and o is not null")


def triples(rows: DataFrame, subject: Column, made: list[tuple[str, Column, str]]) -> DataFrame:
    """As `facts`, all of one subject: (property, object, kind)."""
    return facts(rows, [(subject, *f) for f in made])


def _dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Rows dealt by the keys to so many partitions (None: as the session says), so that what a task groups does not grow with the table."""
    return df.repartition(*([partitions] if partitions else []), *keys)


def infer_types(graph: DataFrame, axioms: tuple[tuple[str, str, str], ...] = AXIOMS, partitions: int | None = None) -> DataFrame:
    """The graph with the types that domains and ranges give to subjects and objects; each type triple once."""
    known = F.broadcast(graph.sparkSession.createDataFrame([*axioms, (TYPE, None, None)], "p string, domain string, range string"))  # a fixed list
    met = graph.join(known, "p")
    own = F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.col("domain"))
    pairs = met.select("s", "o", own.alias("_own"), "range").select(F.inline(F.array(F.struct(F.col("s").alias("s"), F.col("_own").alias("o")), F.struct(F.col("o").alias("s"), F.col("range").alias("o")))))
    # dealt before repeated ones go: no task keeps a table of all that it has read
    types = _dealt(pairs.where("o is not null"), partitions, "s").distinct()
    return graph.where(F.col("p") != TYPE).unionByName(types.select("s", F.lit(TYPE).alias("p"), "o", F.lit("iri").alias("kind")))


def violations(graph: DataFrame, shapes: tuple = SHAPES, partitions: int | None = None) -> DataFrame:
    """(focus, class, path, rule, n): nodes of a shape's class that break a property rule, n being the values that break it or, for counts, those there are.

    A node's types and values are dealt together once and summed where they lie; only objects with a class to have meet the
    types a second time.
    """
    spark = graph.sparkSession
    names = "class string, path string, least int, most int, datatype string, shortest int, low double, high double, object_class string"
    rules = spark.createDataFrame(list(shapes), names)  # a fixed list
    # a rule is met by a node's type, which asks for it, and by the values of its property
    met_by = rules.select(F.concat(F.lit("type "), "class").alias("_key"), F.lit(True).alias("_asks"), "*").unionByName(rules.select(F.concat(F.lit("value "), "path").alias("_key"), F.lit(False).alias("_asks"), "*"))
    key = F.when(F.col("p") == TYPE, F.concat(F.lit("type "), "o")).otherwise(F.concat(F.lit("value "), "p"))
    # what no rule meets goes before anything is shuffled
    wanted = [*{f"type {r[0]}" for r in shapes}, *{f"value {r[1]}" for r in shapes}]
    own = graph.select(F.col("s").alias("focus"), "p", "o", "kind").where(key.isin(*sorted(wanted)))
    values = _dealt(own, partitions, "focus").distinct().withColumn("_key", key).join(F.broadcast(met_by), "_key")
    number = F.expr("try_cast(o as double)")
    numeric = F.col("low").isNotNull() | F.col("high").isNotNull()
    outside = numeric & (number.isNull() | F.coalesce(number < F.col("low"), F.lit(False)) | F.coalesce(number > F.col("high"), F.lit(False)))
    count = lambda c: F.sum(F.when(~F.col("_asks") & c, 1).otherwise(0))
    each = values.groupBy("focus", "class", "path").agg(
        F.max("_asks").alias("_asked"),
        F.max("least").alias("least"),
        F.max("most").alias("most"),
        count(F.col("o").isNotNull()).alias("n"),
        count(F.col("datatype").isNotNull() & (F.col("kind") != F.col("datatype"))).alias("datatype"),
        count(F.col("shortest").isNotNull() & (F.length("o") < F.col("shortest"))).alias("length"),
        count(outside).alias("range"),
    ).where("_asked")
    few, many = F.when(F.col("n") < F.col("least"), F.col("n")), F.when(F.col("n") > F.col("most"), F.col("n"))
    found = [F.struct(F.lit(r).alias("rule"), v.alias("n")) for r, v in (("min count", few), ("max count", many), *((r, F.when(F.col(r) > 0, F.col(r))) for r in ("datatype", "length", "range")))]
    counted = each.select("focus", "class", "path", F.inline(F.array(*found))).where("n is not null")
    # links and types by the object: a link whose object lacks the class is strange
    linking = F.broadcast(rules.where("object_class is not null").select(F.col("path").alias("p"), "path", "class", "object_class"))
    linked = graph.select(F.col("s").alias("focus"), "p", "o", "kind").join(linking, "p").select("focus", "class", "path", "o", "kind", "object_class")
    types = graph.where((F.col("p") == TYPE) & F.col("o").isin(*sorted({r[8] for r in shapes if r[8]}))).select(F.col("s").alias("o"), F.col("o").alias("object_class"))
    strange = _dealt(linked, partitions, "o", "object_class").join(_dealt(types, partitions, "o", "object_class"), ["o", "object_class"], "left_anti").distinct()
    focused = graph.where((F.col("p") == TYPE) & F.col("o").isin(*sorted({r[0] for r in shapes if r[8]}))).select(F.col("s").alias("focus"), F.col("o").alias("class"))
    strange = _dealt(strange, partitions, "focus", "class").join(_dealt(focused, partitions, "focus", "class"), ["focus", "class"], "left_semi")
    return counted.unionByName(strange.groupBy("focus", "class", "path").agg(F.count("*").alias("n")).select("focus", "class", "path", F.lit("object class").alias("rule"), "n"))


def pair_violations(graph: DataFrame, first: str = "hasOnset", second: str = "hasOffset") -> DataFrame:
    """(focus, first, second) where the first value is not under the second."""
    pick = lambda p, name: graph.where(F.col("p") == p).select(F.col("s").alias("focus"), F.expr("try_cast(o as double)").alias(name))
    return pick(first, "first").join(pick(second, "second"), "focus").where("first >= second")


def gate_reasons(rows: DataFrame, graphs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """(key, reason) of everything that stops a run: rows without a graph, and graphs of rows that do not conform."""
    needed = rows.select(key).distinct()
    missing = needed.join(graphs.select(key), key, "left_anti").withColumn("reason", F.lit("no graph"))
    failing = needed.join(bad.select(key), key, "left_semi").withColumn("reason", F.lit("does not conform"))
    return missing.unionByName(failing)


def gate_all(rows: DataFrame, graphs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """All rows if every one has a conforming graph, none if anything is missing or fails: nothing downstream runs on a part."""
    stopped = gate_reasons(rows, graphs, bad, key).limit(1).select(F.lit(True).alias("stopped"))
    return rows.join(F.broadcast(stopped), F.lit(True), "left_anti")


def coverage(expected: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """One row: expected, available, missing entities, and severity: WARN unless all are there, FAIL if none is."""
    both = expected.select(key).distinct().join(available.select(key).distinct().withColumn("here", F.lit(1)), key, "left")
    sums = both.agg(F.count("*").alias("expected"), F.count("here").alias("available"))
    return sums.withColumn("missing", F.col("expected") - F.col("available")).withColumn("severity", F.when(F.col("available") == 0, "FAIL").when(F.col("missing") > 0, "WARN").otherwise("PASS"))


def gate(rows: DataFrame, graphs: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows whose graph exists and conforms; for a whole run that must stop on one failure see `gate_all`."""
    return rows.join(graphs.select(key).distinct().join(bad.select(key).distinct(), key, "left_anti"), key, "left_semi")
