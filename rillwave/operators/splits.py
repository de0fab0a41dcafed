"""Patient-disjoint splits, sampling and batch plans. All draws are the order of md5('seed|…|id'), which any engine repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwave.functions.digests import Endings
from rillwave.functions.ordering import materialise, with_global_number, with_group_number

#: Patients that a search of splits deals at most.
MOST_PATIENTS = 1 << 20
#: Digits of a score, and what arrays and columns may differ by: raw scores that near a border of digits are scored again.
DIGITS, _SLACK = 9, 1e-12
#: Draws of the first round of a search that may end early; each further round has twice as many. Keys that are looked at together.
FIRST_ROUND, _KEYS = 1 << 30, 1 << 20
_COUNTS = ("n", "n0", "n1", "n2")

#: Parts of a stratum that are capped by themselves first.
PARTS = 64


def draw(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by |; strings are column names."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def class_matrix(rows: DataFrame, patient: str, label: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(patient, n, n0, n1, n2)."""
    return rows.groupBy(patient).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"n{c}") for c in classes])


def split_rows(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with side: exact sizes, each side at least one row; fewer than three rows are an error."""
    numbered = with_global_number(rows.withColumn("_h", draw(seed, key)), [F.col("_h"), F.col(key)], "_no")
    n = numbered.count()
    if n < 3:
        raise ValueError("a three-way split needs three rows")
    a = min(max(1, int(train * n)), n - 2)
    b = min(max(1, int(val * n)), n - a - 1)
    side = F.when(F.col("_no") < a, "train").when(F.col("_no") < a + b, "validation").otherwise("test")
    return numbered.withColumn("side", side).drop("_no", "_h")


def split_sizes(n: int, train: float = 0.7, val: float = 0.15) -> tuple[int, int, int]:
    """Patients a side: at least one, at least two from six patients on."""
    least = 2 if n >= 6 else 1
    v = max(least, int(val * n))
    t = max(least, int((1 - train - val) * n + 1e-9))
    return n - v - t, v, t


def _trials(matrix: DataFrame, patient: str, trials: DataFrame, seed: int) -> DataFrame:
    """Every trial's order of the patients: rows (trial, patient, rn, …); candidates are independent, so this is as parallel as trials x patients."""
    grid = matrix.crossJoin(F.broadcast(trials))
    order = Window.partitionBy("trial").orderBy(draw(seed, "trial", patient), patient)
    return grid.withColumn("rn", F.row_number().over(order))


class Cohort:
    """The patients of a search as arrays: one row a patient, in order of patient. At most `MOST_PATIENTS`, as every task holds them."""

    def __init__(self, matrix: DataFrame, patient: str, *more: str):
        rows = matrix.select(F.col(patient), F.col(patient).cast("string").alias("_text"), *_COUNTS, *more).orderBy(patient).limit(MOST_PATIENTS + 1).collect()
        if len(rows) > MOST_PATIENTS:
            raise ValueError(f"a search deals at most {MOST_PATIENTS} patients")
        self.texts = [r["_text"].encode() for r in rows]
        self.counts = np.array([[r[c] for c in _COUNTS] for r in rows], float).reshape(-1, len(_COUNTS))
        self.more = [[r[c] for r in rows] for c in more]
        self.endings = Endings(self.texts, 4)

    def part(self, own: np.ndarray) -> Cohort:
        """The patients at these places."""
        out = object.__new__(Cohort)
        out.texts, out.counts, out.more = [self.texts[i] for i in own], self.counts[own], [[m[i] for i in own] for m in self.more]
        out.endings = Endings(out.texts, 4)
        return out

    def orders(self, trials: range, *head: object) -> np.ndarray:
        """Each trial's order of the patients, as `draw` gives it: trials by patients."""
        start = "|".join(map(str, head)).encode()
        digests = b"".join(hashlib.md5(b"%b|%d|%b" % (start, t, x)).digest() for t in trials for x in self.texts)
        high, low = np.frombuffer(digests, ">u8").reshape(len(trials), len(self.texts), 2).transpose(2, 0, 1)
        return np.lexsort((low, high), axis=-1)

    def first(self, values: np.ndarray, ends: list[int], trials: range, *head: object) -> np.ndarray:
        """Sums of whole values (patients by kinds) over the first patients of each trial's order, up to each end: trials, ends, kinds.

        No order is made: a sum needs only the draw at its end. Where draws tie there in their first bytes, the order tells.
        """
        n = len(self.texts)
        inner = sorted({e for e in ends if 0 < e < n})
        counted = np.concatenate((values, np.ones((n, 1))), 1)
        out = np.zeros((len(trials), len(ends), counted.shape[1]))
        out[:, [i for i, end in enumerate(ends) if end >= n]] = counted.sum(0)
        start = "|".join(map(str, head)).encode()
        for at in range(0, len(trials) if inner else 0, step := max(1, _KEYS // max(1, n))):
            keys = self.endings.keys([b"%b|%d|" % (start, t) for t in trials[at : at + step]])
            borders = np.partition(keys, inner, axis=1)[:, inner]
            for i, end in enumerate(ends):
                if end in inner:
                    out[at : at + step, i] = (keys < borders[:, inner.index(end), None]).astype(float) @ counted
        for t in np.flatnonzero((out[..., -1] != np.clip(ends, 0, n)).any(1)):
            order = self.orders(range(trials[t], trials[t] + 1), *head)[0]
            out[t] = [counted[order[:end]].sum(0) for end in ends]
        return out[..., :-1]


def _relative(raw: np.ndarray) -> np.ndarray:
    return _SLACK * np.maximum(1.0, raw)


def _roundings(raw: np.ndarray) -> np.ndarray:
    """What engines may differ by in a score that is a short sum of a number that all trials share and of squares."""
    return 32 * np.spacing(np.maximum(1.0, raw))


def _leading(raw: np.ndarray, slack: Callable[[np.ndarray], np.ndarray] = _relative) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the candidates that may have the least score, and the least and greatest rounded score of each.

    Of those whose rounded score is certain only the first can win; the others are kept, equal raw scores once.
    """
    found = np.flatnonzero(raw < np.inf)
    off = slack(raw[found])
    low, high = np.full(len(raw), np.inf), np.full(len(raw), np.inf)
    low[found], high[found] = np.round(raw[found] - off, DIGITS), np.round(raw[found] + off, DIGITS)
    near = found[low[found] <= high.min(initial=np.inf)]
    sure = low[near] == high[near]
    unsure = near[~sure]
    kept = np.sort(np.concatenate((near[sure][:1], unsure[np.unique(raw[unsure], return_index=True)[1]])))
    return kept, low[kept], high[kept]


def _shortlist(matrix: DataFrame, trials: int, patients: int, scored: Callable[[range, list], dict], schema: str, bounds: dict | None = None, slack: Callable[[np.ndarray], np.ndarray] = _relative) -> DataFrame:
    """Candidates that may have the least score by outer fold: one whose score is certain, and those too near a border of digits to tell.

    A task scores blocks of trials as arrays, so trials x patients are never rows, and a block gives the few that may win.
    scored: for a block of trials and the outer folds asked for, raw scores by outer fold (infinite where a trial is not feasible).
    bounds: by outer fold, the rounded score that no trial is below. The first trial wins a tie, so once one is known to have this
    score no later trial can win, and the fold is decided; folds without such a trial go through all trials. The rounds this
    takes are a search's first, double, fourfold … so many trials.
    """
    spark, left, start, rounds = matrix.sparkSession, [None] if bounds is None else list(bounds), 0, []
    size = trials if bounds is None else max(1, FIRST_ROUND // max(1, patients))
    while start < trials and (left or not rounds):
        rounds.append(_round(spark, range(start, min(trials, start + size)), scored, left, slack))
        if bounds:
            reached = {r["outer"]: r["high"] for r in rounds[-1].groupBy("outer").agg(F.min("high").alias("high")).collect()}  # a row a fold
            left = [o for o in left if reached.get(o, np.inf) > bounds[o]]
        start, size = start + size, 2 * size
    found = reduce(DataFrame.unionByName, rounds)
    least = found.groupBy(F.col("outer").alias("_o")).agg(F.min("high").alias("_least"))
    near = found.join(F.broadcast(least), F.col("outer").eqNullSafe(F.col("_o"))).where(F.col("low") <= F.col("_least"))
    unsure = F.when(F.col("low") < F.col("high"), F.col("trial"))
    return near.groupBy("outer", unsure.alias("_unsure")).agg(F.min("trial").alias("trial")).select(*schema.split(","))


def _round(spark: SparkSession, trials: range, scored: Callable[[range, list], dict], outers: list, slack: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(outer, trial, low, high): of each block of these trials those that may win, for these outer folds."""
    tasks = 8 * spark.sparkContext.defaultParallelism
    block = min(4096, -(-len(trials) // tasks))
    blocks = -(-len(trials) // block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                numbers = trials[b * block : (b + 1) * block]
                for outer, raw in scored(numbers, outers).items():
                    at, low, high = _leading(raw, slack)
                    yield pa.RecordBatch.from_arrays([pa.array([outer] * len(at), pa.string()), pa.array(at + numbers.start, pa.int64()), pa.array(low), pa.array(high)], names=["outer", "trial", "low", "high"])

    starts = spark.range(0, blocks, 1, min(blocks, tasks))
    return materialise(starts.mapInArrow(search, "outer string, trial long, low double, high double"), "candidates")


def balanced_split(matrix: DataFrame, patient: str, trials: int = 10_000, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(trial, score, patient, side) of the best of `trials` random patient splits.

    Score: over the sides, squared drift of the class shares, 1.5 (window share - target)^2, 100 a missing class, and 0.02 for
    each count a class falls short of 10; the lowest wins, the first on ties.
    """
    matrix = materialise(matrix, "cohort")
    all_ = matrix.agg(F.count("*").alias("p"), *[F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2")]).first()
    a, b, c = split_sizes(all_.p, train, val)
    deal = lambda chosen: _trials(matrix, patient, chosen, seed).withColumn("side", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "validation").otherwise("test"))
    cohort, whole = Cohort(matrix, patient), np.array([float(all_[k]) for k in _COUNTS])
    aims = np.array([a, b, c]) / all_.p

    def scored(numbers: range, _outers: list) -> dict:
        s = np.diff(cohort.first(cohort.counts, [0, a, a + b, all_.p], numbers, seed), axis=1)
        n = s[..., :1]
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = 1.5 * (n[..., 0] / whole[0] - aims) ** 2 + ((s[..., 1:] / n - whole[1:] / whole[0]) ** 2 + 100.0 * (s[..., 1:] == 0) + 0.02 * np.maximum(0, 10 - s[..., 1:])).sum(-1)
        return {None: np.where(np.isnan(raw).any(1), np.inf, raw.sum(1))}

    sides = deal(_shortlist(matrix, trials, all_.p, scored, "trial")).groupBy("trial", "side").agg(*[F.sum(k).alias(k) for k in ("n", "n0", "n1", "n2")])
    target = F.when(F.col("side") == "train", a / all_.p).when(F.col("side") == "validation", b / all_.p).otherwise(c / all_.p)
    term = 1.5 * F.pow(F.col("n") / all_.n - target, 2)
    for k in ("n0", "n1", "n2"):
        term = term + F.pow(F.col(k) / F.col("n") - all_[k] / all_.n, 2) + F.when(F.col(k) == 0, 100.0).otherwise(0.0) + 0.02 * F.greatest(F.lit(0), 10 - F.col(k))
    best = sides.groupBy("trial").agg(F.round(F.sum(term), 9).alias("score")).agg(F.min_by(F.struct("trial", "score"), F.struct("score", "trial")).alias("b")).select("b.*")
    return deal(best).select("trial", "score", patient, "side")


def kfold_search(matrix: DataFrame, patient: str, folds: int = 5, trials: int = 200_000, seed: int = 42) -> DataFrame:
    """(trial, score, patient, fold) of the best feasible deal; a fold without class 1 or 2 is not feasible.

    Score: mean over folds of the weighted squared relative errors of the class counts (0.25, 1, 1), 0.05 of the variances of
    the patients with class 1 and 2, and 0.05 of the mean log1p of the squared relative window error.
    """
    matrix = materialise(matrix, "cohort")
    all_ = matrix.agg(F.count("*").alias("p"), *[F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2")]).first()
    deal = lambda chosen: _trials(matrix, patient, chosen, seed).withColumn("fold", F.floor((F.col("rn") - 1) * folds / all_.p).cast("int"))
    has = [F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).alias(f"with{c}") for c in (1, 2)]
    cohort, fair = Cohort(matrix, patient), np.array([float(all_[k] or 0) for k in _COUNTS]) / folds
    ends = [-(-f * all_.p // folds) for f in range(folds + 1)]
    both = np.concatenate((cohort.counts, cohort.counts[:, 2:] > 0), 1)

    def scored(numbers: range, _outers: list) -> dict:
        s = np.diff(cohort.first(both, ends, numbers, seed), axis=1)
        error = sum(w * ((s[..., i] - fair[i]) / fair[i]) ** 2 if fair[i] else 0.0 for i, w in ((1, 0.25), (2, 1.0), (3, 1.0)))
        raw = np.mean(error, 1) + 0.05 * (s[..., 4].var(1) + s[..., 5].var(1)) + 0.05 * np.log1p(((s[..., 0] - fair[0]) / fair[0]) ** 2).mean(1)
        return {None: np.where((s[..., 2:4].min((1, 2)) > 0) & (all_.p >= folds), raw, np.inf)}

    each = deal(_shortlist(matrix, trials, all_.p, scored, "trial")).groupBy("trial", "fold").agg(*[F.sum(k).alias(k) for k in ("n", "n0", "n1", "n2")], *has)
    error = F.lit(0.0)
    for k, w in (("n0", 0.25), ("n1", 1.0), ("n2", 1.0)):
        fair = all_[k] / folds
        error = error + (w * F.pow((F.col(k) - fair) / fair, 2) if fair else F.lit(0.0))
    window = F.log1p(F.pow((F.col("n") - all_.n / folds) / (all_.n / folds), 2))
    score = F.avg(error) + 0.05 * (F.var_pop("with1") + F.var_pop("with2")) + 0.05 * F.avg(window)
    scored = each.groupBy("trial").agg(F.round(score, 9).alias("score"), F.min(F.least("n1", "n2")).alias("least"), F.count("*").alias("k")).where((F.col("least") > 0) & (F.col("k") == folds))
    best = scored.agg(F.min_by(F.struct("trial", "score"), F.struct("score", "trial")).alias("b")).where("b is not null").select("b.*")
    return deal(best).select("trial", "score", patient, "fold")


def inner_search(matrix: DataFrame, patient: str, outer: str, trials: int = 100_000, seed: int = 42, least_minority: int = 4, share: tuple[float, float] = (0.10, 0.40)) -> DataFrame:
    """(outer, trial, score, patient) of the validation patients chosen inside each outer fold's training side.

    Feasible: all classes on both sides, `least_minority` patients with class 1 and with class 2, window share in bounds.
    """
    matrix = materialise(matrix, "cohort")
    folds = matrix.select(F.col(outer).alias("_out")).distinct()
    train = folds.crossJoin(matrix).where(F.col("_out") != F.col(outer)).drop(outer).withColumnRenamed("_out", outer)
    sizes = train.groupBy(outer).agg(F.count("*").alias("p"), *[F.sum(k).alias(f"all_{k}") for k in ("n", "n0", "n1", "n2")]).withColumn("k", F.greatest(F.lit(4), F.floor(F.col("p") / 4)).cast("int"))
    cohort = Cohort(matrix.withColumn("_outer", F.col(outer).cast("string")), patient, "_outer")
    side_of = cohort.more[0]
    own = {fold: cohort.part(np.array([i for i, f in enumerate(side_of) if f is not None and f != fold], int)) for fold in sorted({f for f in side_of if f is not None})}
    taken = {fold: max(4, len(part.texts) // 4) for fold, part in own.items()}
    held = matrix.sparkSession.sparkContext.broadcast(own)

    def scored(numbers: range, outers: list) -> dict:
        out = {}
        for fold in outers:
            part, k = held.value[fold], taken[fold]
            whole = part.counts.sum(0)
            s = part.first(np.concatenate((part.counts, part.counts[:, 2:] > 0), 1), [k], numbers, seed, fold)[:, 0]
            s, having = s[:, :4], s[:, 4:]
            with np.errstate(divide="ignore", invalid="ignore"):
                share_ = s[:, 0] / whole[0]
                ok = (share_ >= share[0]) & (share_ <= share[1]) & (having >= least_minority).all(1) & ((s[:, 1:] > 0) & (s[:, 1:] < whole[1:])).all(1)
                raw = 0.15 * ((share_ - 0.25) / 0.25) ** 2 + 0.01 * abs(8 - k) + ((s[:, 1:] / (whole[1:] * share_[:, None]) - 1) ** 2 * [0.25, 1.0, 1.0]).sum(1)
            out[fold] = np.where(ok, raw, np.inf)
        return out

    # all trials of a fold share this part of the score, the rest are squares
    bounds = {fold: float(np.round(0.01 * abs(8 - k), DIGITS)) for fold, k in taken.items()}
    chosen = _shortlist(matrix, trials, sum(len(part.texts) for part in own.values()), scored, "outer,trial", bounds, _roundings)
    grid = train.withColumn("_text", F.col(outer).cast("string")).join(F.broadcast(chosen.withColumnRenamed("outer", "_text")), "_text").drop("_text")
    order = Window.partitionBy(outer, "trial").orderBy(draw(seed, outer, "trial", patient), patient)
    val = grid.withColumn("rn", F.row_number().over(order)).join(F.broadcast(sizes), outer).where("rn <= k")
    has = [F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).alias(f"with{c}") for c in (1, 2)]
    cand = val.groupBy(outer, "trial", "k", "all_n", "all_n0", "all_n1", "all_n2").agg(*[F.sum(k).alias(k) for k in ("n", "n0", "n1", "n2")], *has)
    part = F.col("n") / F.col("all_n")
    ok = part.between(*share) & (F.col("with1") >= least_minority) & (F.col("with2") >= least_minority)
    for k in ("n0", "n1", "n2"):
        ok = ok & (F.col(k) > 0) & (F.col(k) < F.col(f"all_{k}"))
    score = 0.15 * F.pow((part - 0.25) / 0.25, 2) + 0.01 * F.abs(8 - F.col("k"))
    for k, w in (("n0", 0.25), ("n1", 1.0), ("n2", 1.0)):
        score = score + w * F.pow(F.col(k) / (F.col(f"all_{k}") * part) - 1, 2)
    best = cand.where(ok).groupBy(outer).agg(F.min_by(F.struct("trial", F.round(score, 9).alias("score")), F.struct(F.round(score, 9), F.col("trial"))).alias("b")).select(outer, "b.*")
    return val.select(outer, "trial", patient).join(F.broadcast(best), [outer, "trial"]).select(outer, "trial", "score", patient)


def leakage(assigned: DataFrame, patient: str, fold: str, cohort: DataFrame) -> DataFrame:
    """(rule, violations): patients held out in several folds or in none, folds that hold out nobody."""
    held = assigned.select(patient, fold).distinct()
    several = held.groupBy(patient).count().where("count > 1")
    never = cohort.select(patient).distinct().join(held, patient, "left_anti")
    stray = held.join(cohort.select(patient).distinct(), patient, "left_anti")
    name = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return name(several, "held out more than once").unionByName(name(never, "never held out")).unionByName(name(stray, "not in the cohort"))


def capped(rows: DataFrame, strata: list[str], key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each stratum; input columns are kept.

    The first `cap` of each of `PARTS` parts of a stratum are taken before those of the stratum, and each task keeps no more of a
    part before the exchange, so a stratum with most of the rows is no single task's.
    """
    drawn = rows.withColumns({"_h": draw(seed, key), "_in": F.pmod(F.xxhash64(key), F.lit(PARTS))})
    for by in ([*strata, "_in"], strata):
        order = Window.partitionBy(*by).orderBy("_h", key)
        drawn = drawn.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap)
    return drawn.drop("_rn", "_h", "_in")


def calibration_sample(rows: DataFrame, patient: str, label: str, key: str, m: int, seed: int = 42) -> DataFrame:
    """m rows a patient: max(1, m // classes) of each class that is there, then the rest by the draw.

    No patient takes more than the first m of a class, so these alone are ranked: at most m rows a patient and class.
    """
    stratum = Window.partitionBy(patient, label).orderBy(draw(seed, key), key)
    kinds = rows.groupBy(patient).agg(F.countDistinct(label).alias("_k"))
    r = capped(rows, [patient, label], key, m, seed).join(kinds, patient).withColumn("_first", F.row_number().over(stratum) <= F.greatest(F.lit(1), F.floor(F.lit(m) / F.col("_k"))))
    fill = Window.partitionBy(patient).orderBy(F.col("_first").desc(), draw(seed, key), key)
    return r.withColumn("_rn", F.row_number().over(fill)).where(F.col("_rn") <= m).drop("_k", "_first", "_rn")


def even_sample(rows: DataFrame, patient: str, idx: str, k: int) -> DataFrame:
    """All rows of a patient with k at most, else those at the whole parts of k even steps from first to last."""
    n = rows.groupBy(patient).agg(F.count("*").alias("_n"))
    step = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(k - 1)))
    chosen = n.withColumn(idx, F.explode(F.when(F.col("_n") <= k, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(step))).select(patient, idx).distinct()
    return rows.join(chosen, [patient, idx], "left_semi")


def block_batches(rows: DataFrame, patient: str, key: str, size: int, epoch: int = 0, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """rows with batch (within the patient) and patient_no (order of the patients): one patient a batch, new order each epoch."""
    drawn = with_group_number(rows.withColumn("_h", draw(seed, epoch, patient, key)), [patient], [F.col("_h"), F.col(key)], "_at")
    out = drawn.withColumn("batch", F.floor(F.col("_at") / size).cast("long")).drop("_h", "_at")
    if drop_last:
        n = rows.groupBy(patient).agg((F.floor(F.count("*") / size)).alias("_whole"))
        out = out.join(n, patient).where(F.col("batch") < F.col("_whole")).drop("_whole")
    patients = with_global_number(rows.select(patient).distinct().withColumn("_h", draw(seed, epoch, patient)), [F.col("_h"), F.col(patient)], "patient_no").drop("_h")
    return out.join(patients, patient)


def round_robin(rows: DataFrame, patient: str, key: str, size: int, turns: int = 8, epoch: int = 0, seed: int = 42) -> DataFrame:
    """(patient, batch, round, position): each patient gives `turns` batches a round; the order of patients changes with the round."""
    batches = block_batches(rows, patient, key, size, epoch, seed).select(patient, "batch").distinct().withColumn("round", F.floor(F.col("batch") / turns))
    return with_global_number(batches.withColumn("_h", draw(seed, epoch, "round", patient)), [F.col("round"), F.col("_h"), F.col(patient), F.col("batch")], "position").drop("_h")


def class_weights(rows: DataFrame, label: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(label, n, weight): rows / (classes that are there x rows of the class), 0 for an absent class."""
    n = rows.agg(F.count(label).alias("all"), *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"n{c}") for c in classes])
    there = sum(((F.col(f"n{c}") > 0).cast("int") for c in classes), F.lit(0))
    rows_ = [F.struct(F.lit(c).alias("label"), F.col(f"n{c}").alias("n"), F.when(F.col(f"n{c}") > 0, F.col("all") / (there * F.col(f"n{c}"))).otherwise(0.0).alias("weight")) for c in classes]
    return n.select(F.inline(F.array(*rows_)))


def cohort_table(rows: DataFrame, side: str, patient: str, label: str) -> DataFrame:
    """(side, patients, n_windows, pct_0, pct_1, pct_2, members)."""
    pct = [(100.0 * F.sum(F.when(F.col(label) == c, 1).otherwise(0)) / F.count("*")).alias(f"pct_{c}") for c in range(3)]
    return rows.groupBy(side).agg(F.countDistinct(patient).alias("patients"), F.count("*").alias("n_windows"), *pct, F.array_join(F.transform(F.sort_array(F.collect_set(patient)), lambda v: v.cast("string")), ";").alias("members"))


def nested_leakage(held: DataFrame, inner: DataFrame, patient: str, fold: str, role: str = "role") -> DataFrame:
    """(fold, rule, violations): patients on both inner sides, inner patients that the fold holds out, patients of the outer training side on neither.

    held: (patient, fold), one row a patient of the cohort and fold that holds it out; inner: (fold, role, patient).
    """
    cohort, folds = held.select(patient).distinct(), held.select(fold).distinct()  # as many folds as there are splits
    sides = inner.groupBy(fold, patient).agg(F.countDistinct(role).alias("_sides"))
    out = held.select(fold, patient).distinct().withColumn("_held", F.lit(True))
    all_ = cohort.crossJoin(F.broadcast(folds)).join(sides, [fold, patient], "left").join(out, [fold, patient], "left")
    sides_, held_ = F.coalesce("_sides", F.lit(0)), F.coalesce("_held", F.lit(False))
    rules = {"on both inner sides": sides_ > 1, "inner but held out": (sides_ > 0) & held_, "outer train on no inner side": (sides_ == 0) & ~held_}
    sums = all_.groupBy(fold).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in rules.items()])
    return sums.select(fold, F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))
