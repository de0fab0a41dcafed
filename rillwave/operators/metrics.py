"""Evaluation of class predictions and alarm scores as aggregations (classes 0, 1, 2; an alarm is a class above 0).

Undefined values are NULL. Every function takes `by`, the columns to report separately.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise, with_global_sums

from .order_statistics import quantiles

CLASSES = (0, 1, 2)
#: Rows of a group that one task ranks; larger groups are ranked by ranges.
RANKED = 1 << 16


def ratio(a: Column, b: Column, zero: float | None = None) -> Column:
    """a / b; `zero` where b is 0 (NULL by default)."""
    other = F.lit(None).cast("double") if zero is None else F.lit(float(zero))
    return F.when(b != 0, a.cast("double") / b).otherwise(other)


def check_probabilities(df: DataFrame, columns: list[str], slack: float = 1e-8) -> DataFrame:
    """Adds ok (finite, not under -slack, positive sum); probabilities of good rows are renormalised, of others NULL."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    good = total > 0
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) & (F.col(c) >= -slack)
    return df.withColumn("ok", F.coalesce(good, F.lit(False))).withColumns({c: F.when(F.col("ok"), F.col(c) / total) for c in columns})


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by, truth, pred, n) for all nine cells."""
    by = by or []
    cells = [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), 1).otherwise(0)).alias("n")) for t in CLASSES for p in CLASSES]
    wide = df.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return wide.select(*by, F.inline("cells"))


def _wide(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    hits = [F.sum(F.when((F.col(truth) == c) & (F.col(pred) == c), 1).otherwise(0)).alias(f"tp{c}") for c in CLASSES]
    there = [F.sum(F.when(F.col(truth) == c, 1).otherwise(0)).alias(f"sup{c}") for c in CLASSES]
    said = [F.sum(F.when(F.col(pred) == c, 1).otherwise(0)).alias(f"said{c}") for c in CLASSES]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *hits, *there, *said)


def class_metrics(df: DataFrame, truth: str, pred: str, by: list[str] | None = None, specificity_zero: float | None = None) -> DataFrame:
    """One row a class: support, precision, recall, f1 (0 on zero division), specificity (see `specificity_zero`)."""
    by = by or []
    rows = []
    for c in CLASSES:
        tp, sup, said = F.col(f"tp{c}"), F.col(f"sup{c}"), F.col(f"said{c}")
        p, r = ratio(tp, said, 0), ratio(tp, sup, 0)
        rows.append(
            F.struct(
                F.lit(c).alias("class"), sup.alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * tp, sup + said, 0).alias("f1"), ratio(F.col("n") - sup - said + tp, F.col("n") - sup, specificity_zero).alias("specificity")
            )
        )
    return _wide(df, truth, pred, by).select(*by, F.inline(F.array(*rows)))


def overall_metrics(df: DataFrame, truth: str, pred: str, by: list[str] | None = None, macro: str = "fixed") -> DataFrame:
    """n, accuracy, balanced accuracy (mean recall of classes in truth), macro precision, recall and F1.

    macro='fixed' averages over classes 0 to 2; 'observed' over those in truth or prediction.
    """
    by = by or []
    w = _wide(df, truth, pred, by)
    tp, sup, said = ([F.col(f"{k}{c}") for c in CLASSES] for k in ("tp", "sup", "said"))
    present = sum(((s > 0).cast("int") for s in sup), F.lit(0))
    seen = [((s > 0) | (q > 0)).cast("int") for s, q in zip(sup, said, strict=True)] if macro == "observed" else [F.lit(1)] * 3
    over = sum(seen, F.lit(0))

    def mean(parts: list[Column]) -> Column:
        return sum((x * s for x, s in zip(parts, seen, strict=True)), F.lit(0.0)) / over

    return w.select(
        *by,
        "n",
        ratio(sum(tp, F.lit(0)), F.col("n")).alias("accuracy"),
        ratio(sum((F.coalesce(ratio(t, s), F.lit(0.0)) for t, s in zip(tp, sup, strict=True)), F.lit(0.0)), present).alias("balanced_accuracy"),
        mean([ratio(t, q, 0) for t, q in zip(tp, said, strict=True)]).alias("macro_precision"),
        mean([ratio(t, s, 0) for t, s in zip(tp, sup, strict=True)]).alias("macro_recall"),
        mean([ratio(2 * t, s + q, 0) for t, s, q in zip(tp, sup, said, strict=True)]).alias("macro_f1"),
    )


def ranking_metrics(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc, average_precision): ties take midranks; NULL with one class only.

    Rows are first summed by score; running sums over the distinct scores go by ranges, not through one task.
    """
    by = by or []
    bins = df.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(positive.cast("int")).alias("_pos"), F.sum(1 - positive.cast("int")).alias("_neg"))
    run = with_global_sums(bins, [*(F.col(c) for c in by), F.col("_score")], {"_cp": F.col("_pos"), "_cn": F.col("_neg")})
    totals = run.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.min(F.col("_cp") - F.col("_pos")).alias("_p0"), F.min(F.col("_cn") - F.col("_neg")).alias("_n0"))
    run = _with_groups(run, totals, by, "inner") if by else run.crossJoin(F.broadcast(totals))
    below = F.col("_cn") - F.col("_n0") - F.col("_neg")
    pos_from = F.col("n_pos") - (F.col("_cp") - F.col("_p0")) + F.col("_pos")
    neg_from = F.col("n_neg") - below
    parts = run.groupBy(*by, "n_pos", "n_neg").agg(
        F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("_u"), F.sum(F.when(F.col("_pos") > 0, F.col("_pos") * pos_from.cast("double") / (pos_from + neg_from)).otherwise(0.0)).alias("_ap")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return parts.select(*by, "n_pos", "n_neg", F.when(both, F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"), F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos")).alias("average_precision"))


def class_rankings(df: DataFrame, truth: str, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """Ranking metrics of each class against the rest: (by, class, ...)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).alias("_s"), (F.col(truth) == c).alias("_hit")) for c, s in enumerate(scores)])
    long = df.select(*(by or []), F.inline(pairs))
    return ranking_metrics(long, "_s", F.col("_hit"), [*(by or []), "class"])


def _same(by: list[str], names: list[str]) -> Column:
    """Equal groups; a null is a value of its own."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], F.lit(True))


def _with_groups(df: DataFrame, other: DataFrame, by: list[str], how: str) -> DataFrame:
    """df joined with the rows of its groups in `other`."""
    names = [f"_by_{i}" for i in range(len(by))]
    own = other.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *[c for c in other.columns if c not in by])
    return df.join(F.broadcast(own) if how in ("left_semi", "left_anti") else own, _same(by, names), how).drop(*names)


def _group_aucs(df: DataFrame, asked: dict[str, tuple[Column, Column]], by: list[str]) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """For groups that a task may hold: rows with running counts within their group, dealt once for all rankings; sums to
    aggregate by group; and the AUC of each (score, positive) from those, null with one class only.

    Twice the pairs that a positive wins, ties as halves: negatives up to each positive, less positives up to each negative,
    and all pairs.
    """
    sums, out = [], {}
    for k, (score, positive) in asked.items():
        df = df.withColumns({f"_hit_{k}": positive, f"_score_{k}": score})
    for k in asked:
        pos, neg = F.col(f"_hit_{k}"), ~F.col(f"_hit_{k}")
        upto = Window.partitionBy(*by).orderBy(f"_score_{k}").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({f"_neg_{k}": F.count(F.when(neg, 1)).over(upto), f"_pos_{k}": F.count(F.when(pos, 1)).over(upto)})
        sums += [F.sum(F.when(pos, F.col(f"_neg_{k}")).when(neg, -F.col(f"_pos_{k}")).otherwise(F.lit(0))).alias(f"_u_{k}"), F.count(F.when(pos, 1)).alias(f"_p_{k}"), F.count(F.when(neg, 1)).alias(f"_n_{k}")]
        pairs = F.col(f"_p_{k}") * F.col(f"_n_{k}")
        out[k] = F.when(pairs > 0, (F.col(f"_u_{k}") + pairs) / 2.0 / (F.col(f"_p_{k}").cast("double") * F.col(f"_n_{k}")))
    return df, sums, out


def rates(tp: Column, tn: Column, fp: Column, fn: Column, step_seconds: float, zero: float | None = None) -> dict[str, Column]:
    """Alarm rates from counts; sensitivity and specificity take `zero` on a zero denominator, precision 0."""
    n = tp + tn + fp + fn
    sens, spec, prec = ratio(tp, tp + fn, zero), ratio(tn, tn + fp, zero), ratio(tp, tp + fp, 0)
    hours = n * F.lit(step_seconds / 3600.0)
    return {
        "accuracy": ratio(tp + tn, n),
        "precision": prec,
        "sensitivity": sens,
        "specificity": spec,
        "f1": ratio(2 * tp, 2 * tp + fp + fn, 0),
        "balanced_accuracy": (sens + spec) / 2,
        "youden_j": sens + spec - 1,
        "alarm_rate": ratio(tp + fp, n),
        "true_rate": ratio(tp + fn, n),
        "hours": hours,
        "false_alarms_per_hour": ratio(fp, hours),
    }


def alarm_metrics(df: DataFrame, truth: str, score: Column, threshold: float, by: list[str] | None = None, step_seconds: float = 2.0, zero: float | None = None) -> DataFrame:
    """Alarm counts and rates at one threshold (alarm if score >= threshold)."""
    by = by or []
    hit, alarm = F.col(truth) > 0, score >= threshold
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    wide = df.groupBy(*by).agg(count(hit & alarm).alias("tp"), count(~hit & ~alarm).alias("tn"), count(~hit & alarm).alias("fp"), count(hit & ~alarm).alias("fn"))
    made = rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"), step_seconds, zero)
    return wide.select(*by, "tp", "tn", "fp", "fn", *[v.alias(k) for k, v in made.items()])


def threshold_sweep(df: DataFrame, truth: str, score: Column, low: float = 0.05, step: float = 0.01, count: int = 91, by: list[str] | None = None, step_seconds: float = 2.0) -> DataFrame:
    """Alarm metrics at low, low + d, low + 2 d, ... (d = (low + step) - low, as numpy spaces a range).

    One pass: each score is placed among the thresholds, rows are summed by place, and at most `count` + 1 rows a group are
    summed up from the top.
    """
    by = by or []
    d = (low + step) - low
    value = lambda k: F.lit(low) + k * F.lit(d)
    guess = F.floor((score - low) / d)
    exact = F.when(score < value(guess), guess - 1).when(score >= value(guess + 1), guess + 1).otherwise(guess)
    place = F.least(F.greatest(exact, F.lit(-1)), F.lit(count - 1)).cast("int")
    bins = df.groupBy(*by, place.alias("_k")).agg(F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(truth) > 0, 0).otherwise(1)).alias("_n"))
    grouped = bins.groupBy(*by).agg(F.collect_list(F.struct("_k", "_p", "_n")).alias("_bins"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    zero = F.lit(0).cast("long")
    above = lambda name: F.aggregate("_bins", zero, lambda a, b: a + F.when(b["_k"] >= F.col("_i"), b[name]).otherwise(zero))
    at = grouped.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumns({"tp": above("_p"), "fp": above("_n")})
    at = at.withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_neg") - F.col("fp"), "threshold": value(F.col("_i"))})
    made = rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"), step_seconds)
    return at.select(*by, "threshold", "tp", "tn", "fp", "fn", *[v.alias(k) for k, v in made.items()])


#: Keys that a policy maximises, in order; the last decides full ties.
POLICIES = {
    "balanced_accuracy": ("balanced_accuracy", "specificity", "-alarm_rate", "threshold"),
    "youden_j": ("youden_j", "specificity", "-alarm_rate", "threshold"),
    "f1": ("f1", "specificity", "-alarm_rate", "threshold"),
    "specificity_constrained": ("sensitivity", "specificity", "-alarm_rate", "threshold"),
    "stage1": ("balanced_accuracy", "sensitivity", "f1", "-threshold"),
    "stage2": ("balanced_accuracy", "sensitivity", "f1", "-threshold"),
}
_FALLBACK = {"specificity_constrained": ("specificity", "sensitivity", "-alarm_rate", "threshold"), "stage1": ("balanced_accuracy", "specificity", "sensitivity", "-threshold")}


def pick_threshold(sweep: DataFrame, policy: str, min_specificity: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """The sweep row that a policy prefers, with constraint_met; constrained policies fall back when no row meets them."""
    by = by or []

    def key(names: tuple[str, ...]) -> Column:
        return F.struct(*[(-F.col(n[1:]) if n[0] == "-" else F.col(n)).alias(f"k{i}") for i, n in enumerate(names)])

    row = F.struct(*[F.col(c) for c in sweep.columns if c not in by])
    if policy not in _FALLBACK:
        best = sweep.groupBy(*by).agg(F.max_by(row, key(POLICIES[policy])).alias("_r"), F.lit(True).alias("constraint_met"))
    else:
        meets = F.col("specificity") >= min_specificity
        first = F.max_by(row, F.when(meets, key(POLICIES[policy])))
        best = sweep.groupBy(*by).agg(F.coalesce(first, F.max_by(row, key(_FALLBACK[policy]))).alias("_r"), F.coalesce(F.max(meets), F.lit(False)).alias("constraint_met"))
    return best.select(*by, "_r.*", "constraint_met")


def summarise(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, metric, mean, sd, contributing): NULLs are skipped; sd is the sample one, 0 for one value."""
    long = df.select(*(by or []), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    sd = F.when(F.count("value") == 1, F.lit(0.0)).otherwise(F.stddev_samp("value"))
    return long.groupBy(*(by or []), "metric").agg(F.avg("value").alias("mean"), sd.alias("sd"), F.count("value").alias("contributing"))


def compare(a: DataFrame, b: DataFrame, on: list[str], probabilities: list[str], pred: str, alarm: str) -> DataFrame:
    """Disagreements and probability differences of two models over the rows that both have."""
    left = a.select(*on, pred, alarm, *probabilities)
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in (pred, alarm, *probabilities)])
    both = left.join(right, on)
    gaps = F.array(*[F.abs(F.col(p) - F.col(f"{p}_b")) for p in probabilities])
    return both.agg(
        F.count("*").alias("rows"),
        F.sum(F.when(F.col(pred) != F.col(f"{pred}_b"), 1).otherwise(0)).alias("pred_differs"),
        F.sum(F.when(F.col(alarm) != F.col(f"{alarm}_b"), 1).otherwise(0)).alias("alarm_differs"),
        F.max(F.array_max(gaps)).alias("max_abs_diff"),
        F.avg(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / len(probabilities)).alias("mean_abs_diff"),
    )


def parity(a: DataFrame, b: DataFrame, on: list[str], values: list[str], decision: str, atol: float = 1e-5, rtol: float = 1e-4) -> DataFrame:
    """all_close by |a - b| <= atol + rtol |b|, decisions_match, and rows compared."""
    both = a.select(*on, decision, *values).join(b.select(*on, *[F.col(c).alias(f"{c}_b") for c in (decision, *values)]), on)
    close = F.lit(True)
    for v in values:
        close = close & (F.abs(F.col(v) - F.col(f"{v}_b")) <= atol + rtol * F.abs(F.col(f"{v}_b")))
    return both.agg(F.count("*").alias("rows"), F.bool_and(close).alias("all_close"), F.sum(F.when(close, 0).otherwise(1)).alias("rows_apart"), F.bool_and(F.col(decision) == F.col(f"{decision}_b")).alias("decisions_match"))


def metric_rows(df: DataFrame, keys: list[str], metrics: list[str], prefix: str = "") -> DataFrame:
    """Long form (keys, metric, value): names made safe, values that are not finite left out."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    safe = F.regexp_replace("metric", r"[^A-Za-z0-9_./ -]", "_")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).withColumn("metric", safe)


def missing_metrics(long: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """Required metrics that an entity's long table lacks."""
    spark = long.sparkSession
    wanted = spark.createDataFrame([(m,) for m in required], "metric string")  # a fixed list
    return long.select(*keys).distinct().crossJoin(F.broadcast(wanted)).join(long.select(*keys, "metric").distinct(), [*keys, "metric"], "left_anti")


# The names that a report needs.
PRIMARY_KEYS = (
    "loss", "accuracy", "balanced_accuracy", "precision", "recall_sensitivity", "specificity", "f1", "auc",
    "per_class_precision", "per_class_recall", "per_class_specificity", "per_class_f1", "per_class_support", "confusion_matrix",
)
ALARM_KEYS = (
    "decision_threshold", "alarm_accuracy", "alarm_balanced_accuracy", "alarm_precision", "alarm_recall_sensitivity", "alarm_specificity", "alarm_f1", "alarm_auc", "alarm_youden_j",
    "alarm_prediction_rate", "alarm_true_rate", "alarm_confusion_matrix", "tp", "tn", "fp", "fn", "evaluated_duration_seconds", "evaluated_duration_hours", "false_alarms_per_hour",
)
#: Length of the per-class arrays, and sides of the square matrices.
ARRAYS = {k: len(CLASSES) for k in PRIMARY_KEYS if k.startswith("per_class_")}
MATRICES = {"confusion_matrix": len(CLASSES), "alarm_confusion_matrix": 2}


def reporting_metrics(df: DataFrame, truth: str, pred: str, scores: list[str], alarm: str, threshold: float, by: list[str], step_seconds: float = 2.0, observed: bool = False) -> DataFrame:
    """(by, all PRIMARY_KEYS and ALARM_KEYS, majority_class) in nested form; with `observed`, arrays and the matrix hold only the classes that an entity has or was said to have."""
    truth_, pred_ = F.col(truth), F.col(pred)
    count = lambda c: F.count(F.when(c, 1))
    cells = [count((truth_ == t) & (pred_ == p)).alias(f"_cell{t}{p}") for t in CLASSES for p in CLASSES]
    hit, alarmed = truth_ > 0, F.col(alarm) >= threshold
    own = F.element_at(F.array(*scores), truth_ + 1)
    made = [
        F.count("*").alias("n"), *cells, F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss"),
        count(hit & alarmed).alias("tp"), count(~hit & ~alarmed).alias("tn"), count(~hit & alarmed).alias("fp"), count(hit & ~alarmed).alias("fn"),
    ]
    large = materialise(df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > RANKED).select(*by, "_rows"), "large")  # no more than rows / RANKED
    some = not large.isEmpty()
    # groups that a task may hold are dealt once, ranked and summed where they lie
    rows, ranks, aucs = _group_aucs(_with_groups(df, large.drop("_rows"), by, "left_anti") if some else df, {**{str(c): (F.col(s), truth_ == c) for c, s in zip(CLASSES, scores, strict=True)}, "alarm": (F.col(alarm), hit)}, by)
    sums = rows.groupBy(*by).agg(*made, *ranks).withColumns({"auc": reduce(lambda a, b: a + b, [aucs[str(c)] for c in CLASSES]) / len(CLASSES), "alarm_auc": aucs["alarm"]}).drop(*[f"_{x}_{k}" for x in "upn" for k in aucs])
    if some:
        big = _with_groups(df, large.drop("_rows"), by, "left_semi")
        ranked = class_rankings(big, truth, scores, by).groupBy(*by).agg(F.when(F.count("auc") == len(CLASSES), F.avg("auc")).alias("auc"))
        alarms = ranking_metrics(big, alarm, hit, by).select(*by, F.col("auc").alias("alarm_auc"))
        sums = sums.unionByName(_with_groups(_with_groups(big.groupBy(*by).agg(*made), ranked, by, "left"), alarms, by, "left"))
    cell = lambda t, p: F.col(f"_cell{t}{p}")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    has, said = [add([cell(c, p) for p in CLASSES]) for c in CLASSES], [add([cell(t, c) for t in CLASSES]) for c in CLASSES]
    each = {
        "per_class_precision": [ratio(cell(c, c), said[c], 0) for c in CLASSES],
        "per_class_recall": [ratio(cell(c, c), has[c], 0) for c in CLASSES],
        "per_class_specificity": [ratio(F.col("n") - has[c] - said[c] + cell(c, c), F.col("n") - has[c]) for c in CLASSES],
        "per_class_f1": [ratio(2 * cell(c, c), has[c] + said[c], 0) for c in CLASSES],
        "per_class_support": has,
    }
    # there may be millions of groups, so lambdas, which are slow, do next to nothing; the matrix has one that keeps all of this
    # out of a single generated method, which would be too long to be compiled
    seen = [has[c] + said[c] > 0 if observed else F.lit(True) for c in CLASSES]

    def over_seen(values: list[Column], kind: str) -> Column:
        return F.concat(*[F.when(seen[c], F.array(v)).otherwise(F.array().cast(f"array<{kind}>")) for c, v in zip(CLASSES, values, strict=True)])

    def mean(m: str) -> Column:
        values = [F.when(seen[c], v) for c, v in zip(CLASSES, each[m], strict=True)]
        return add([F.coalesce(v, F.lit(0.0)) for v in values]) / F.nullif(add([v.isNotNull().cast("int") for v in values]), F.lit(0))

    there = F.nullif(add([(h > 0).cast("int") for h in has]), F.lit(0))
    r = rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"), step_seconds)
    shown = sums.withColumns({
        **{m: over_seen(v, "bigint" if m == "per_class_support" else "double") for m, v in each.items()},
        "confusion_matrix": F.filter(F.array(*[F.when(seen[t], over_seen([cell(t, p) for p in CLASSES], "bigint")) for t in CLASSES]), lambda row: row.isNotNull()),
        "accuracy": ratio(add([cell(c, c) for c in CLASSES]), F.col("n")), "precision": mean("per_class_precision"), "recall_sensitivity": mean("per_class_recall"), "balanced_accuracy": add([F.coalesce(ratio(cell(c, c), has[c]), F.lit(0.0)) for c in CLASSES]) / there,
        "specificity": mean("per_class_specificity"), "f1": mean("per_class_f1"), "majority_class": F.array_position(F.array(*has), F.array_max(F.array(*has))) - 1,
        "decision_threshold": F.lit(threshold), "alarm_confusion_matrix": F.array(F.array("tn", "fp"), F.array("fn", "tp")),
        **{f"alarm_{m}": r[m] for m in ("accuracy", "balanced_accuracy", "precision", "specificity", "f1", "youden_j", "true_rate")},
        "alarm_recall_sensitivity": r["sensitivity"], "alarm_prediction_rate": r["alarm_rate"],
        "evaluated_duration_seconds": F.col("n") * step_seconds, "evaluated_duration_hours": r["hours"], "false_alarms_per_hour": r["false_alarms_per_hour"],
    })
    return shown.select(*by, *PRIMARY_KEYS, *ALARM_KEYS, "majority_class")


def contract_violations(df: DataFrame, keys: list[str], majority: bool = False) -> DataFrame:
    """(keys, metric, rule, got) of each entity's metrics: required ones that are absent or null, per-class arrays of another length, matrices of another shape."""
    found = []

    def say(metric: str, rule: str, when: Column, got: Column) -> None:
        found.append(F.when(when, F.struct(F.lit(metric).alias("metric"), F.lit(rule).alias("rule"), got.alias("got"))))

    none = F.lit(None).cast("string")
    for m in (*PRIMARY_KEYS, *ALARM_KEYS, *(["majority_class"] if majority else [])):
        if m not in df.columns:
            say(m, "missing", F.lit(True), none)
            continue
        say(m, "missing", F.col(m).isNull(), none)
        if m in ARRAYS:
            say(m, "length", F.size(m) != ARRAYS[m], F.size(m).cast("string"))
        if m in MATRICES:
            n = F.lit(MATRICES[m])
            widths = F.array_join(F.transform(m, lambda row: F.size(row).cast("string")), "+")
            say(m, "shape", (F.size(m) != n) | F.exists(m, lambda row: F.coalesce(F.size(row), F.lit(-1)) != n), F.concat(F.size(m).cast("string"), F.lit(" rows of "), widths))
    return df.select(*keys, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def timing_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, median, min, max, sd); the median is exact, from counts by ranges of values, so no task holds a group's values."""
    by, v = by or [], F.col(value)
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("sd"))
    middle = quantiles(df, value, {"median": 0.5}, by).select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], "median")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_m{i}"))
    return sums.join(middle, same, "left").select(*by, "n", "mean", "median", "min", "max", "sd")
