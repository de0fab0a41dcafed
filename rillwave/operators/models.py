"""A two-stage boosted-tree hierarchy, and its nested patient-wise cross-validation.

Stage one tells alarms (label > 0) from the rest, stage two ictal from pre-ictal among the alarms. All stages of all parts of a
cross-validation are boosted together, in shared passes over the rows (see `boosting`).

Each part keeps the standardiser of its own training rows (population deviation; under 1e-8 counts as 1). A tree asks only
whether a value reaches a cut point, which no standardiser changes, so the trees read the values as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise

from . import metrics as M
from .boosting import Booster, Trees, fit_many, with_probabilities


@dataclass
class Hierarchy:
    columns: list[str]
    centre: list[float]
    spread: list[float]
    alarm: Booster
    ictal: Booster

    def predict(self, df: DataFrame) -> DataFrame:
        """df with p_alarm and p_ictal (given an alarm) for every row; a stage that had one class only answers 0.5."""
        out = with_probabilities(df, self.columns, [self.alarm, self.ictal], "_p")
        return out.withColumns({"p_alarm": F.col("_p")[0], "p_ictal": F.col("_p")[1]}).drop("_p")


def standardiser(train: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each column; a deviation under 1e-8 counts as 1, a column without values has mean 0."""
    return standardisers(train, columns, [F.lit(True)])[0]


def standardisers(rows: DataFrame, columns: list[str], parts: list[Column]) -> list[tuple[list[float], list[float]]]:
    """The standardiser of the rows of each part, in one pass."""
    own = {(k, i): F.when(p, F.col(c)) for k, p in enumerate(parts) for i, c in enumerate(columns)}
    # two numbers a part and column
    s = rows.agg(*[F.avg(v).alias(f"m{k}_{i}") for (k, i), v in own.items()], *[F.stddev_pop(v).alias(f"s{k}_{i}") for (k, i), v in own.items()]).first()
    each = range(len(columns))
    return [([s[f"m{k}_{i}"] or 0.0 for i in each], [s[f"s{k}_{i}"] if (s[f"s{k}_{i}"] or 0.0) >= 1e-8 else 1.0 for i in each]) for k in range(len(parts))]


def standardised(df: DataFrame, columns: list[str], centre: list[float], spread: list[float], out: list[str] | None = None) -> DataFrame:
    """df with each column less its centre, by its spread, under the names in `out` (or its own)."""
    return df.withColumns({o: (F.col(c) - m) / s for o, c, m, s in zip(out or columns, columns, centre, spread, strict=True)})


def fit_hierarchies(rows: DataFrame, columns: list[str], label: str, parts: list[Column], trees: Trees | None = None) -> list[Hierarchy]:
    """Both stages of each part, whose training rows are those that meet its condition."""
    y = F.col(label)
    stages = [stage for p in parts for stage in ((p & y.isNotNull(), y > 0), (p & (y > 0), y == 2))]
    fitted = fit_many(rows, columns, stages, trees)
    scales = standardisers(rows, columns, parts)
    return [Hierarchy(columns, *scales[k], fitted[2 * k], fitted[2 * k + 1]) for k in range(len(parts))]


def fit_hierarchy(train: DataFrame, columns: list[str], label: str, trees: Trees | None = None) -> Hierarchy:
    return fit_hierarchies(train, columns, label, [F.lit(True)], trees)[0]


def route(df: DataFrame, t1: float, t2: float) -> DataFrame:
    """df with pred (0 under t1, else 2 from t2 on, else 1) and the joint probabilities q0, q1, q2."""
    said = F.when(F.col("p_alarm") < t1, 0).when(F.col("p_ictal") >= t2, 2).otherwise(1)
    return df.withColumns({"pred": said, "q0": 1 - F.col("p_alarm"), "q1": F.col("p_alarm") * (1 - F.col("p_ictal")), "q2": F.col("p_alarm") * F.col("p_ictal")})


def _thresholds(scored: DataFrame, truth: str, score: str, policy: str, by: str) -> dict:
    """The threshold that the policy picks for each value of `by`, in one sweep."""
    sweep = M.threshold_sweep(scored, truth, F.col(score), 0.01, 0.01, 99, [by])
    return {r[by]: r.threshold for r in M.pick_threshold(sweep, policy, by=[by]).collect() if r.threshold is not None}  # one row a fold


def _threshold(scored: DataFrame, truth: str, score: str, policy: str) -> float:
    return _thresholds(scored.withColumn("_all", F.lit(0)), truth, score, policy, "_all").get(0, 0.5)


def nested_cv(features: DataFrame, columns: list[str], label: str, patient: str, fold: str, folds: list, trees: Trees | None = None, inner: DataFrame | None = None) -> DataFrame:
    """Predictions of every held-out row: (…, outer_fold, t1, t2, p_alarm, p_ictal, pred, q0, q1, q2).

    For each outer fold: fit on the inner training side, choose both thresholds on the inner validation side, fit again on
    the whole outer training side with its own standardiser, score the untouched fold. `inner` names the validation
    patients of each outer fold (outer_fold, patient; ids of any type); without it they are those of the next fold.
    """
    if inner is None and len(folds) < 3:
        raise ValueError("two folds leave no inner validation side: give the inner patients")
    if inner is None:
        beside = dict(zip(folds, [*folds[1:], folds[0]], strict=True))
        marked, validates = features, {held: F.col(fold) == beside[held] for held in folds}
    else:
        given = inner.groupBy(F.col(patient).alias("_patient")).agg(F.collect_set("outer_fold").alias("_validates"))
        marked = features.join(given, F.col(patient) == F.col("_patient"), "left").drop("_patient")
        validates = {held: F.coalesce(F.array_contains("_validates", F.lit(held)), F.lit(False)) for held in folds}
    marked = materialise(marked, "folds")
    outer = {held: F.col(fold) != held for held in folds}
    parts = [p for held in folds for p in (outer[held] & ~validates[held], outer[held])]
    models = fit_hierarchies(marked, columns, label, parts, trees)
    # of each fold: p_alarm and p_ictal by the inner model, then by the final one
    scored = materialise(with_probabilities(marked, columns, [b for m in models for b in (m.alarm, m.ictal)], "_p"), "scored")
    # the inner validation rows of every fold, with its inner model's answers; a row may serve several folds
    inner = [F.when(outer[held] & validates[held], F.struct(F.lit(k).alias("_part"), F.col("_p")[4 * k].alias("p_alarm"), F.col("_p")[4 * k + 1].alias("p_ictal"))) for k, held in enumerate(folds)]
    val = scored.select(F.col(label), (F.col(label) == 2).cast("int").alias("_ictal"), F.inline(F.filter(F.array(*inner), lambda x: x.isNotNull())))
    t1 = _thresholds(val, label, "p_alarm", "stage1", "_part")
    t2 = _thresholds(val.where(F.col(label) > 0), "_ictal", "p_ictal", "stage2", "_part")
    t1, t2 = ({held: t.get(k, 0.5) for k, held in enumerate(folds)} for t in (t1, t2))
    out = None
    for k, held in enumerate(folds):
        own = scored.where(F.col(fold) == held).withColumns({"p_alarm": F.col("_p")[4 * k + 2], "p_ictal": F.col("_p")[4 * k + 3]}).drop("_p", "_validates")
        part = route(own, t1[held], t2[held]).withColumns({"outer_fold": F.lit(held), "t1": F.lit(t1[held]), "t2": F.lit(t2[held])})
        out = part if out is None else out.unionByName(part)
    return out
