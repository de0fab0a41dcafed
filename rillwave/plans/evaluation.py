"""Queries of the evaluation operators over lineitem as predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import with_global_number
from rillwave.operators import metrics as M

from .tables import pred_sql, predictions, r6

LOW, STEP, COUNT = 0.05, 0.01, 91


def _score() -> F.Column:
    return F.col("p1") + F.col("p2")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


RATES = ("accuracy", "precision", "sensitivity", "specificity", "f1", "balanced_accuracy", "youden_j", "alarm_rate", "true_rate", "hours", "false_alarms_per_hour")


def prob_check(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("p0", F.when(F.col("l_linenumber") == 3, -F.col("p0")).otherwise(F.col("p0")))
    out = M.check_probabilities(p, ["p0", "p1", "p2"])
    return out.groupBy("patient").agg(F.count("*").alias("rows"), F.sum(F.col("ok").cast("int")).alias("good"), r6(F.sum("p1")).alias("sum_p1"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), "truth", "pred")


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.class_metrics(predictions(spark, d), "truth", "pred"), "precision", "recall", "f1", "specificity")


def specificity(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    one = None
    for name, zero in (("null", None), ("zero", 0.0), ("one", 1.0)):
        part = M.class_metrics(p, "truth", "pred", ["patient"], zero).groupBy("patient").agg(r6(F.avg("specificity")).alias("macro_specificity")).withColumn("policy", F.lit(name))
        one = part if one is None else one.unionByName(part)
    return one


def overall(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    fixed = M.overall_metrics(p, "truth", "pred").withColumn("macro", F.lit("fixed"))
    seen = M.overall_metrics(p, "truth", "pred", macro="observed").withColumn("macro", F.lit("observed"))
    return _rounded(fixed.unionByName(seen), "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


def auc_binary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ranking_metrics(predictions(spark, d).withColumn("score", _score()), "score", F.col("truth") > 0).select("n_pos", "n_neg", "auc"), "auc")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.ranking_metrics(predictions(spark, d).withColumn("score", _score()), "score", F.col("truth") > 0).select("n_pos", "average_precision"), "average_precision")


def auc_macro(spark: SparkSession, d: str) -> DataFrame:
    each = M.class_rankings(predictions(spark, d), "truth", ["p0", "p1", "p2"])
    strict = F.when(F.count("auc") == 3, F.avg("auc"))
    return each.agg(r6(F.avg("auc")).alias("macro_auc"), r6(strict).alias("macro_auc_strict"), F.count("auc").alias("classes"))


def alarm_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.alarm_metrics(predictions(spark, d), "truth", _score(), 0.5), *RATES)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.threshold_sweep(predictions(spark, d), "truth", _score(), LOW, STEP, COUNT), *RATES)


def threshold_pick(spark: SparkSession, d: str) -> DataFrame:
    sweep = M.threshold_sweep(predictions(spark, d), "truth", _score(), LOW, STEP, COUNT)
    out = None
    for policy in ("balanced_accuracy", "youden_j", "f1", "specificity_constrained", "stage1", "stage2"):
        part = M.pick_threshold(sweep, policy).select(F.lit(policy).alias("policy"), r6(F.col("threshold")).alias("threshold"), r6(F.col("balanced_accuracy")).alias("balanced_accuracy"), "constraint_met")
        out = part if out is None else out.unionByName(part)
    return out


def patient_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    recall = M.class_metrics(p, "truth", "pred", ["patient"]).groupBy("patient").agg(*[r6(F.max(F.when((F.col("class") == c) & (F.col("support") > 0), F.col("recall")))).alias(f"recall_{c}") for c in range(3)])
    return _rounded(M.overall_metrics(p, "truth", "pred", ["patient"]).select("patient", "n", "accuracy", "balanced_accuracy").join(recall, "patient"), "accuracy", "balanced_accuracy")


def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("fold", F.col("patient") % 5)
    each = M.overall_metrics(p, "truth", "pred", ["fold"])
    return _rounded(M.summarise(each, ["accuracy", "balanced_accuracy", "macro_f1"]), "mean", "sd")


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """Folds' held-out rows put together, only if all five folds are there."""
    p = predictions(spark, d).withColumn("fold", F.col("patient") % 5)
    folds = None
    for f in range(5):
        part = p.where(F.col("fold") == f)
        folds = part if folds is None else folds.unionByName(part)
    there = p.select("fold").distinct().agg((F.count("*") == 5).alias("whole"))
    return _rounded(M.overall_metrics(folds.crossJoin(F.broadcast(there)).where("whole"), "truth", "pred").select("n", "accuracy", "balanced_accuracy", "macro_f1"), "accuracy", "balanced_accuracy", "macro_f1")


KEY = ["l_orderkey", "l_linenumber", "patient"]


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = []
    for rotate in (0, 1):
        made.append(predictions(spark, d, rotate).withColumn("alarm", _score() >= 0.5))
    return made[0], made[1]


def model_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    gaps = M.compare(a, b, KEY, ["p0", "p1", "p2"], "pred", "alarm")
    fa, fb = (M.overall_metrics(x, "truth", "pred").select(F.col("macro_f1").alias(n)) for x, n in ((a, "f1_a"), (b, "f1_b")))
    out = gaps.crossJoin(F.broadcast(fa)).crossJoin(F.broadcast(fb)).withColumn("retain", F.col("f1_a") - F.col("f1_b") <= 0.02)
    return _rounded(out, "max_abs_diff", "mean_abs_diff", "f1_a", "f1_b")


def parity(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return M.parity(a, b, KEY, ["p0", "p1", "p2"], "pred", atol=0.05, rtol=0.1)


def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Class most frequent in training (least on ties) said for all test rows; patients that divide by 4 are the test side."""
    p = predictions(spark, d)
    most = p.where("patient % 4 <> 0").groupBy("truth").count().agg(F.max_by("truth", F.struct("count", -F.col("truth"))).alias("majority"))
    test = p.where("patient % 4 = 0").crossJoin(F.broadcast(most))
    return _rounded(M.overall_metrics(test, "truth", "majority", ["majority"]).select("majority", "n", "accuracy", "balanced_accuracy", "macro_f1"), "accuracy", "balanced_accuracy", "macro_f1")


def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    names = ["accuracy", "balanced_accuracy", "macro_f1"]
    model = M.metric_rows(M.overall_metrics(p.where("patient % 4 = 0"), "truth", "pred").withColumn("k", F.lit(1)), ["k"], names)
    base = M.metric_rows(majority_baseline(spark, d).withColumn("k", F.lit(1)), ["k"], names)
    both = model.withColumnRenamed("value", "model").join(base.withColumnRenamed("value", "baseline"), ["k", "metric"])
    return _rounded(both.select("metric", "model", "baseline", (F.col("model") - F.col("baseline")).alias("difference")), "model", "baseline", "difference")


def metric_long(spark: SparkSession, d: str) -> DataFrame:
    each = M.class_metrics(predictions(spark, d), "truth", "pred", ["patient"])
    return _rounded(M.metric_rows(each, ["patient", "class"], ["precision", "recall", "f1", "specificity"], "class metrics:"), "value")


def metric_contract(spark: SparkSession, d: str) -> DataFrame:
    each = M.metric_rows(M.overall_metrics(predictions(spark, d), "truth", "pred", ["patient"]).join(M.alarm_metrics(predictions(spark, d), "truth", _score(), 0.5, ["patient"]).select("patient", "specificity"), "patient"), ["patient"], ["accuracy", "macro_f1", "specificity"])
    return M.missing_metrics(each, ["accuracy", "macro_f1", "specificity", "macro_auc"], ["patient"])


def metric_contract_nested(spark: SparkSession, d: str) -> DataFrame:
    """Every order's report: arrays and matrix over the classes it has, so many orders lack rows, and rankings where one class is all."""
    p = predictions(spark, d).withColumn("alarm_score", _score())
    made = M.reporting_metrics(p, "truth", "pred", ["p0", "p1", "p2"], "alarm_score", 0.5, ["l_orderkey"], observed=True)
    return M.contract_violations(made, ["l_orderkey"], majority=True)


def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.timing_summary(predictions(spark, d).withColumn("ms", F.col("p0") * 10), "ms", ["truth"]), "mean", "median", "min", "max", "sd")


def patient_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Each patient's F1 threshold on its validation slice (even orders), used on its test slice."""
    p = predictions(spark, d).withColumn("alarm_score", _score())
    sweep = M.threshold_sweep(p.where("l_orderkey % 2 = 0"), "truth", F.col("alarm_score"), 0.1, 0.1, 9, ["patient"])
    picked = M.pick_threshold(sweep, "f1", by=["patient"]).select("patient", F.col("threshold").alias("own"))
    test = p.where("l_orderkey % 2 <> 0").join(picked, "patient")
    out = M.alarm_metrics(test, "truth", F.col("alarm_score") - F.col("own"), 0.0, ["patient", "own"])
    return _rounded(out.select("patient", F.col("own").alias("threshold"), "tp", "fp", "fn", "tn", "f1"), "threshold", "f1")


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Stable softmax of three raw scores and its first maximum."""
    li = predictions(spark, d)
    z = F.array(F.col("p0") * 4, F.col("p1") * 4, F.col("p2") * 4)
    e = li.withColumn("e", F.transform(z, lambda v: F.exp(v - F.array_max(z))))
    s = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    out = e.withColumn("q", F.transform("e", lambda v: v / s))
    return out.groupBy("patient", (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("said")).agg(F.count("*").alias("rows"), r6(F.sum(F.element_at("q", 1))).alias("q0"))


def alarm_decision(spark: SparkSession, d: str) -> DataFrame:
    """0 under the threshold, else the larger alarm class (the first on ties)."""
    p = predictions(spark, d)
    said = lambda t: F.when(_score() >= t, F.when(F.col("p2") > F.col("p1"), 2).otherwise(1)).otherwise(0)
    return p.groupBy("patient").agg(*[F.sum(F.when(said(t) == c, 1).otherwise(0)).alias(f"n{c}_at_{int(t * 100)}") for t in (0.5, 0.8) for c in range(3)])


def smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Centred moving average of five by patient and time, edge values repeated, rows renormalised.

    Frames must not cross a recording, and no task holds one: rows are numbered over ranges, cut into chunks, and the two rows
    on either side of a cut go to both chunks. A frame that is short is at an end of its recording, so it holds the edge value.
    """
    half, chunk = 2, 1 << 14
    keys = ["at", "l_orderkey", "l_linenumber", "p0", "p1", "p2", "truth"]
    rows = with_global_number(predictions(spark, d), [F.col(c) for c in ("patient", *keys)], "place")
    part = lambda step: F.floor((F.col("place") + step) / chunk)
    dealt = rows.withColumns({"own": part(0), "chunk": F.explode(F.array_distinct(F.array(part(-half), part(0), part(half))))})
    order = Window.partitionBy("patient", "chunk").orderBy("place")
    frame = order.rowsBetween(-half, half)
    before, after = half - F.count("*").over(order.rowsBetween(-half, -1)), half - F.count("*").over(order.rowsBetween(1, half))
    mean = lambda c: (F.sum(c).over(frame) + before * F.first(c).over(frame) + after * F.last(c).over(frame)) / (2 * half + 1)
    s = dealt.withColumns({f"m{c}": mean(c) for c in ("p0", "p1", "p2")}).where("own = chunk")
    total = F.col("mp0") + F.col("mp1") + F.col("mp2")
    return s.select("patient", "l_orderkey", "l_linenumber", *[r6(F.col(f"m{c}") / total).alias(f"{c}_smooth") for c in ("p0", "p1", "p2")])


def prediction_rows(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit(0), F.lit("interictal"), F.lit(1), F.lit("pre-ictal"), F.lit(2), F.lit("ictal"))
    p = predictions(spark, d)
    return p.select("patient", "l_orderkey", "l_linenumber", F.element_at(names, F.col("truth")).alias("truth_name"), F.element_at(names, F.col("pred")).alias("pred_name"), (F.col("truth") == F.col("pred")).alias("correct"), *[r6(F.col(c)).alias(c) for c in ("p0", "p1", "p2")], F.when(_score() >= 0.5, "ALARM").otherwise("NO ALARM").alias("alarm"))


def best_run(spark: SparkSession, d: str) -> DataFrame:
    """The earliest step with the greatest macro F1 of each experiment; steps are ship months, experiments are suppliers modulo 10."""
    p = predictions(spark, d).withColumn("experiment", F.col("patient") % 10).withColumn("step", F.year("at") * 12 + F.month("at"))
    each = M.overall_metrics(p, "truth", "pred", ["experiment", "step"]).withColumn("f1", r6(F.col("macro_f1")))
    return each.groupBy("experiment").agg(F.max_by("step", F.struct("f1", -F.col("step"))).alias("step"), F.max("f1").alias("f1"))


def routing(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage decision: 0 under the first threshold, else 2 from the second on, else 1; joint probabilities."""
    p = predictions(spark, d).withColumn("a", _score()).withColumn("b", F.col("p2") / (F.col("p1") + F.col("p2")))
    said = F.when(F.col("a") < 0.55, 0).when(F.col("b") >= 0.5, 2).otherwise(1)
    return p.groupBy("patient").agg(*[F.sum(F.when(said == c, 1).otherwise(0)).alias(f"n{c}") for c in range(3)], r6(F.sum(F.col("a") * (1 - F.col("b")))).alias("joint1"), r6(F.sum(F.col("a") * F.col("b"))).alias("joint2"))


QUERIES = {
    f.__name__: f
    for f in (
        prob_check, confusion, class_metrics, specificity, overall, auc_binary, average_precision, auc_macro, alarm_metrics, threshold_sweep, threshold_pick, patient_metrics, fold_summary, pooled, model_compare, parity,
        majority_baseline, baseline_delta, metric_long, metric_contract, metric_contract_nested, timing_summary, patient_calibration, softmax_argmax, alarm_decision, smoothing, prediction_rows, best_run, routing,
    )
}

P = pred_sql()


def _overall_sql(source: str, by: str = "", pred: str = "pred", where: str = "") -> str:
    """CTE w: counts, then metrics."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}," if by else ""
    n = ",".join(f"count(*) FILTER (truth={c} AND {pred}={c}) AS tp{c}, count(*) FILTER (truth={c}) AS sup{c}, count(*) FILTER ({pred}={c}) AS said{c}" for c in range(3))
    bal = "+".join(f"coalesce(tp{c}::DOUBLE/nullif(sup{c},0),0)" for c in range(3))
    present = "+".join(f"(sup{c}>0)::INT" for c in range(3))
    mp = "+".join(f"coalesce(tp{c}::DOUBLE/nullif(said{c},0),0)" for c in range(3))
    f1 = "+".join(f"coalesce(2*tp{c}::DOUBLE/nullif(sup{c}+said{c},0),0)" for c in range(3))
    seen = "+".join(f"(sup{c}+said{c}>0)::INT" for c in range(3))
    return f"""SELECT {lead} n, (tp0+tp1+tp2)::DOUBLE/n AS accuracy, ({bal})/nullif({present},0) AS balanced_accuracy, ({mp})/3 AS macro_precision, ({bal})/3 AS macro_recall, ({f1})/3 AS macro_f1,
      ({mp})/({seen}) AS obs_precision, ({bal})/({seen}) AS obs_recall, ({f1})/({seen}) AS obs_f1
      FROM (SELECT {lead} count(*) AS n, {n} FROM {source} {where} {group})"""


_CLASS = lambda by, zero="NULL": f"""SELECT {by} c AS class, sup AS support, coalesce(tp::DOUBLE/nullif(said,0),0) AS precision, coalesce(tp::DOUBLE/nullif(sup,0),0) AS recall,
   coalesce(2*tp::DOUBLE/nullif(sup+said,0),0) AS f1, coalesce((n-sup-said+tp)::DOUBLE/nullif(n-sup,0),{zero}) AS specificity
   FROM (SELECT {by} c, count(*) AS n, count(*) FILTER (truth=c) AS sup, count(*) FILTER (pred=c) AS said, count(*) FILTER (truth=c AND pred=c) AS tp FROM pred, (VALUES (0),(1),(2)) v(c) GROUP BY {by} c)"""  # noqa: E731

_RATE = """accuracy, precision, sensitivity, specificity, f1, (sensitivity+specificity)/2 AS balanced_accuracy, sensitivity+specificity-1 AS youden_j, alarm_rate, true_rate, hours, false_alarms_per_hour"""
_BASE = """(tp+tn)::DOUBLE/nullif(n,0) AS accuracy, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS precision, tp::DOUBLE/nullif(tp+fn,0) AS sensitivity, tn::DOUBLE/nullif(tn+fp,0) AS specificity,
  coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0) AS f1, (tp+fp)::DOUBLE/nullif(n,0) AS alarm_rate, (tp+fn)::DOUBLE/nullif(n,0) AS true_rate, n*(2.0::DOUBLE/3600.0::DOUBLE) AS hours, fp::DOUBLE/nullif(n*(2.0::DOUBLE/3600.0::DOUBLE),0) AS false_alarms_per_hour"""
_R = lambda *names: ", ".join(f"round({n},6) AS {n}" for n in names)


def _sweep_sql(count: int = COUNT, low: float = LOW, step: float = STEP, by: str = "", where: str = "") -> str:
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} threshold, tp, tn, fp, fn, {_RATE} FROM (SELECT *, {_BASE} FROM (SELECT *, tp+tn+fp+fn AS n FROM (
      SELECT {lead} {low}::DOUBLE + k*(({low}::DOUBLE+{step}::DOUBLE)-{low}::DOUBLE) AS threshold,
       count(*) FILTER (truth>0 AND p1+p2>={low}::DOUBLE + k*(({low}::DOUBLE+{step}::DOUBLE)-{low}::DOUBLE)) AS tp, count(*) FILTER (truth=0 AND p1+p2<{low}::DOUBLE + k*(({low}::DOUBLE+{step}::DOUBLE)-{low}::DOUBLE)) AS tn,
       count(*) FILTER (truth=0 AND p1+p2>={low}::DOUBLE + k*(({low}::DOUBLE+{step}::DOUBLE)-{low}::DOUBLE)) AS fp, count(*) FILTER (truth>0 AND p1+p2<{low}::DOUBLE + k*(({low}::DOUBLE+{step}::DOUBLE)-{low}::DOUBLE)) AS fn
      FROM pred, range({count}) g(k) {where} GROUP BY {lead} k)))"""


def _rank_sql(source: str, by: str = "") -> str:
    lead, part = (f"{by},", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead} sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(pos*(below+neg/2.0::DOUBLE))/nullif(sum(pos)::DOUBLE*sum(neg),0) AS auc, sum(pos*above::DOUBLE/(above+negabove))/nullif(sum(pos),0) AS average_precision FROM (
      SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below, sum(pos) OVER ({part} ORDER BY score DESC) AS above, sum(neg) OVER ({part} ORDER BY score DESC) AS negabove
      FROM (SELECT {lead} score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM {source} GROUP BY {lead} score)) {group}"""


_PICKS = {
    "balanced_accuracy": "balanced_accuracy DESC, specificity DESC, alarm_rate, threshold DESC",
    "youden_j": "youden_j DESC, specificity DESC, alarm_rate, threshold DESC",
    "f1": "f1 DESC, specificity DESC, alarm_rate, threshold DESC",
    "specificity_constrained": "(specificity>=0.8::DOUBLE) DESC, CASE WHEN specificity>=0.8::DOUBLE THEN sensitivity ELSE specificity END DESC, CASE WHEN specificity>=0.8::DOUBLE THEN specificity ELSE sensitivity END DESC, alarm_rate, threshold DESC",
    "stage1": "(specificity>=0.8::DOUBLE) DESC, balanced_accuracy DESC, CASE WHEN specificity>=0.8::DOUBLE THEN sensitivity ELSE specificity END DESC, CASE WHEN specificity>=0.8::DOUBLE THEN f1 ELSE sensitivity END DESC, threshold",
    "stage2": "balanced_accuracy DESC, sensitivity DESC, f1 DESC, threshold",
}

_OVERALL = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")
_M3 = ("accuracy", "balanced_accuracy", "macro_f1")
_TWO = pred_sql("a") + ", " + pred_sql("b", 1)
_MAJ = f"WITH {P}, m AS (SELECT truth AS majority FROM pred WHERE patient%4<>0 GROUP BY truth ORDER BY count(*) DESC, truth LIMIT 1), t AS (SELECT * FROM pred, m WHERE patient%4=0)"

ORACLES = {
    "prob_check": f"""WITH {P}, q AS (SELECT patient, CASE WHEN l_linenumber=3 THEN -p0 ELSE p0 END AS p0, p1, p2 FROM pred), c AS (SELECT *, p0>=-1e-8 AND p0+p1+p2>0 AS ok FROM q)
      SELECT patient, count(*) AS rows, count(*) FILTER (ok) AS good, round(sum(CASE WHEN ok THEN p1/(p0+p1+p2) END),6) AS sum_p1 FROM c GROUP BY patient""",
    "confusion": f"WITH {P} SELECT t::INT AS truth, p::INT AS pred, (SELECT count(*) FROM pred x WHERE x.truth=t AND x.pred=p) AS n FROM (VALUES (0),(1),(2)) a(t), (VALUES (0),(1),(2)) b(p)",
    "class_metrics": f"WITH {P}, k AS ({_CLASS('')}) SELECT class, support, {_R('precision', 'recall', 'f1', 'specificity')} FROM k",
    "specificity": f"WITH {P} " + " UNION ALL ".join(f"SELECT patient, round(avg(specificity),6) AS macro_specificity, '{n}' AS policy FROM ({_CLASS('patient,', z)}) GROUP BY patient" for n, z in (("null", "NULL"), ("zero", "0"), ("one", "1"))),
    "overall": f"WITH {P}, o AS ({_overall_sql('pred')}) SELECT n, {_R(*_OVERALL)}, 'fixed' AS macro FROM o UNION ALL SELECT n, round(accuracy,6), round(balanced_accuracy,6), round(obs_precision,6), round(obs_recall,6), round(obs_f1,6), 'observed' FROM o",
    "auc_binary": f"WITH {P}, s AS (SELECT p1+p2 AS score, truth>0 AS hit FROM pred) SELECT n_pos, n_neg, round(auc,6) AS auc FROM ({_rank_sql('s')})",
    "average_precision": f"WITH {P}, s AS (SELECT p1+p2 AS score, truth>0 AS hit FROM pred) SELECT n_pos, round(average_precision,6) AS average_precision FROM ({_rank_sql('s')})",
    "auc_macro": f"WITH {P}, s AS (SELECT c, CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score, truth=c AS hit FROM pred, (VALUES (0),(1),(2)) v(c)) SELECT round(avg(auc),6) AS macro_auc, round(CASE WHEN count(auc)=3 THEN avg(auc) END,6) AS macro_auc_strict, count(auc) AS classes FROM ({_rank_sql('s', 'c')})",
    "alarm_metrics": f"WITH {P}, s AS ({_sweep_sql(1, 0.5, 0.0)}) SELECT tp, tn, fp, fn, {_R(*RATES)} FROM s",
    "threshold_sweep": f"WITH {P}, s AS ({_sweep_sql()}) SELECT threshold, tp, tn, fp, fn, {_R(*RATES)} FROM s",
    "threshold_pick": f"WITH {P}, s AS ({_sweep_sql()}) " + " UNION ALL ".join(f"SELECT '{p}' AS policy, round(threshold,6) AS threshold, round(balanced_accuracy,6) AS balanced_accuracy, {'TRUE' if p not in ('specificity_constrained', 'stage1') else '(SELECT coalesce(bool_or(specificity>=0.8::DOUBLE),FALSE) FROM s)'} AS constraint_met FROM (SELECT * FROM s ORDER BY {o} LIMIT 1)" for p, o in _PICKS.items()),
    "patient_metrics": f"WITH {P}, o AS ({_overall_sql('pred', 'patient')}), k AS ({_CLASS('patient,')}) SELECT o.patient, n, {_R('accuracy', 'balanced_accuracy')}, r.* EXCLUDE (patient) FROM o JOIN (SELECT patient, "
    + ", ".join(f"round(max(recall) FILTER (class={c} AND support>0),6) AS recall_{c}" for c in range(3))
    + " FROM k GROUP BY patient) r ON o.patient=r.patient",
    "fold_summary": f"WITH {P}, f AS (SELECT *, patient%5 AS fold FROM pred), o AS ({_overall_sql('f', 'fold')}), l AS (UNPIVOT (SELECT accuracy, balanced_accuracy, macro_f1 FROM o) ON accuracy, balanced_accuracy, macro_f1 INTO NAME metric VALUE value) SELECT metric, round(avg(value),6) AS mean, round(CASE WHEN count(value)=1 THEN 0 ELSE stddev_samp(value) END,6) AS sd, count(value) AS contributing FROM l GROUP BY metric",
    "pooled": f"WITH {P}, o AS ({_overall_sql('pred', where='WHERE (SELECT count(DISTINCT patient%5) FROM pred)=5')}) SELECT n, {_R(*_M3)} FROM o",
    "model_compare": f"""WITH {_TWO}, j AS (SELECT a.pred AS pa, b.pred AS pb, a.p1+a.p2>=0.5 AS aa, b.p1+b.p2>=0.5 AS ab, abs(a.p0-b.p0) AS d0, abs(a.p1-b.p1) AS d1, abs(a.p2-b.p2) AS d2 FROM a JOIN b USING (l_orderkey, l_linenumber, patient)),
      fa AS ({_overall_sql('a')}), fb AS ({_overall_sql('b')})
      SELECT count(*) AS rows, count(*) FILTER (pa<>pb) AS pred_differs, count(*) FILTER (aa<>ab) AS alarm_differs, round(max(greatest(d0,d1,d2)),6) AS max_abs_diff, round(avg((d0+d1+d2)/3),6) AS mean_abs_diff,
      round((SELECT macro_f1 FROM fa),6) AS f1_a, round((SELECT macro_f1 FROM fb),6) AS f1_b, (SELECT macro_f1 FROM fa)-(SELECT macro_f1 FROM fb)<=0.02 AS retain FROM j""",
    "parity": f"""WITH {_TWO}, j AS (SELECT a.pred AS pa, b.pred AS pb, abs(a.p0-b.p0)<=0.05::DOUBLE+0.1::DOUBLE*abs(b.p0) AND abs(a.p1-b.p1)<=0.05::DOUBLE+0.1::DOUBLE*abs(b.p1) AND abs(a.p2-b.p2)<=0.05::DOUBLE+0.1::DOUBLE*abs(b.p2) AS near FROM a JOIN b USING (l_orderkey, l_linenumber, patient))
      SELECT count(*) AS rows, bool_and(near) AS all_close, count(*) FILTER (NOT near) AS rows_apart, bool_and(pa=pb) AS decisions_match FROM j""",
    "majority_baseline": f"{_MAJ}, o AS ({_overall_sql('t', 'majority', 'majority')}) SELECT majority, n, {_R(*_M3)} FROM o",
    "baseline_delta": f"{_MAJ}, o AS ({_overall_sql('t', '', 'majority')}), q AS ({_overall_sql('t')}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(q.{m},6) AS model, round(o.{m},6) AS baseline, round(q.{m}-round(o.{m},6),6) AS difference FROM o, q" for m in _M3),
    "metric_long": f"WITH {P}, k AS ({_CLASS('patient,')}) SELECT patient, class, 'class metrics_' || m AS metric, round(v,6) AS value FROM (" + " UNION ALL ".join(f"SELECT patient, class, '{m}' AS m, {m} AS v FROM k" for m in ("precision", "recall", "f1", "specificity")) + ") WHERE v IS NOT NULL",
    "metric_contract": f"WITH {P} SELECT patient, 'macro_auc' AS metric FROM pred GROUP BY patient UNION ALL SELECT patient, 'specificity' FROM pred GROUP BY patient HAVING count(*) FILTER (truth=0)=0",
    "metric_contract_nested": f"""WITH {P}, c AS (SELECT l_orderkey, count(*) AS n, {', '.join(f'count(*) FILTER (truth={c}) AS s{c}, (count(*) FILTER (truth={c} OR pred={c})>0)::INT AS k{c}' for c in range(3))} FROM pred GROUP BY l_orderkey), e AS (SELECT *, k0+k1+k2 AS k FROM c)
      SELECT l_orderkey, m AS metric, 'length' AS rule, k::VARCHAR AS got FROM e, (VALUES ('per_class_precision'),('per_class_recall'),('per_class_specificity'),('per_class_f1'),('per_class_support')) v(m) WHERE k<>3
      UNION ALL SELECT l_orderkey, 'confusion_matrix', 'shape', k||' rows of '||array_to_string(list_transform(range(k), lambda x: k::VARCHAR), '+') FROM e WHERE k<>3
      UNION ALL SELECT l_orderkey, 'specificity', 'missing', NULL FROM e WHERE k=1
      UNION ALL SELECT l_orderkey, 'auc', 'missing', NULL FROM e WHERE s0 IN (0,n) OR s1 IN (0,n) OR s2 IN (0,n)
      UNION ALL SELECT l_orderkey, m, 'missing', NULL FROM e, (VALUES ('alarm_auc'),('alarm_balanced_accuracy'),('alarm_youden_j'),('alarm_recall_sensitivity'),('alarm_specificity')) v(m) WHERE (s0=n AND m<>'alarm_specificity') OR (s0=0 AND m<>'alarm_recall_sensitivity')""",
    "timing_summary": f"WITH {P} SELECT truth, count(*) AS n, round(avg(p0*10),6) AS mean, round(quantile_cont(p0*10,0.5),6) AS median, round(min(p0*10),6) AS min, round(max(p0*10),6) AS max, round(stddev_pop(p0*10),6) AS sd FROM pred GROUP BY truth",
    "patient_calibration": f"""WITH {P}, s AS ({_sweep_sql(9, 0.1, 0.1, 'patient', 'WHERE l_orderkey%2=0')}), best AS (SELECT patient, threshold FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY f1 DESC, specificity DESC, alarm_rate, threshold DESC) AS rn FROM s) WHERE rn=1),
      c AS (SELECT patient, threshold, count(*) FILTER (truth>0 AND p1+p2>=threshold) AS tp, count(*) FILTER (truth=0 AND p1+p2>=threshold) AS fp, count(*) FILTER (truth>0 AND p1+p2<threshold) AS fn, count(*) FILTER (truth=0 AND p1+p2<threshold) AS tn FROM pred JOIN best USING (patient) WHERE l_orderkey%2<>0 GROUP BY patient, threshold)
      SELECT patient, round(threshold,6) AS threshold, tp, fp, fn, tn, round(coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0),6) AS f1 FROM c""",
    "softmax_argmax": f"""WITH {P}, e AS (SELECT patient, exp(p0*4-greatest(p0,p1,p2)*4) AS a, exp(p1*4-greatest(p0,p1,p2)*4) AS b, exp(p2*4-greatest(p0,p1,p2)*4) AS c FROM pred)
      SELECT patient, (CASE WHEN a>=b AND a>=c THEN 0 WHEN b>=c THEN 1 ELSE 2 END)::INT AS said, count(*) AS rows, round(sum(a/(a+b+c)),6) AS q0 FROM e GROUP BY ALL""",
    "alarm_decision": f"WITH {P} SELECT patient, " + ", ".join(f"count(*) FILTER ((CASE WHEN p1+p2>={t}::DOUBLE THEN CASE WHEN p2>p1 THEN 2 ELSE 1 END ELSE 0 END)={c}) AS n{c}_at_{int(t * 100)}" for t in (0.5, 0.8) for c in range(3)) + " FROM pred GROUP BY patient",
    "smoothing": f"""WITH {P}, o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY patient) AS n FROM pred WINDOW w AS (PARTITION BY patient ORDER BY "at", l_orderkey, l_linenumber, p0, p1, p2, truth)),
      s AS (SELECT x.patient, x.rn, x.l_orderkey, x.l_linenumber, avg(y.p0) AS a, avg(y.p1) AS b, avg(y.p2) AS c FROM (SELECT o.*, least(greatest(rn+d,1),n) AS at_rn FROM o, (VALUES (-2),(-1),(0),(1),(2)) v(d)) x JOIN o y ON x.patient=y.patient AND x.at_rn=y.rn GROUP BY x.patient, x.rn, x.l_orderkey, x.l_linenumber)
      SELECT patient, l_orderkey, l_linenumber, round(a/(a+b+c),6) AS p0_smooth, round(b/(a+b+c),6) AS p1_smooth, round(c/(a+b+c),6) AS p2_smooth FROM s""",
    "prediction_rows": f"""WITH {P} SELECT patient, l_orderkey, l_linenumber, ['interictal','pre-ictal','ictal'][truth+1] AS truth_name, ['interictal','pre-ictal','ictal'][pred+1] AS pred_name, truth=pred AS correct, round(p0,6) AS p0, round(p1,6) AS p1, round(p2,6) AS p2, CASE WHEN p1+p2>=0.5 THEN 'ALARM' ELSE 'NO ALARM' END AS alarm FROM pred""",
    "best_run": f"""WITH {P}, e AS (SELECT *, patient%10 AS experiment, (year("at")*12+month("at"))::INT AS step FROM pred), o AS ({_overall_sql('e', 'experiment, step')})
      SELECT experiment, step, f1 FROM (SELECT experiment, step, round(macro_f1,6) AS f1, row_number() OVER (PARTITION BY experiment ORDER BY round(macro_f1,6) DESC, step) AS rn FROM o) WHERE rn=1""",
    "routing": f"""WITH {P}, r AS (SELECT patient, p1+p2 AS a, p2/(p1+p2) AS b FROM pred), k AS (SELECT *, CASE WHEN a<0.55::DOUBLE THEN 0 WHEN b>=0.5 THEN 2 ELSE 1 END AS said FROM r)
      SELECT patient, count(*) FILTER (said=0) AS n0, count(*) FILTER (said=1) AS n1, count(*) FILTER (said=2) AS n2, round(sum(a*(1-b)),6) AS joint1, round(sum(a*b),6) AS joint2 FROM k GROUP BY patient""",
}
