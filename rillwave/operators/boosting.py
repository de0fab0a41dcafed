"""Second-order boosted trees for many models at once, in shared passes over the rows.

A level of a tree needs sums of gradients and Hessians by (model, node, feature, bin). One pass over the rows makes them for
every model together, so twenty models of 300 trees and depth 4 are 1,200 short jobs, not 20 chains of them.

Rows are binned once: a value's bin is the number of cut points (quantiles of all rows, no labels) that it reaches. They lie in
blocks of at most `BLOCK` rows, one row a block, as flat arrays by feature and by model, dealt evenly to the cores. A task adds up its
blocks' histograms, dense and of a size that the parameters fix, and sends one row a model; reducers add those up and answer with the
best split of each node. The driver gets at most one row a node. Margins are written with the blocks every `KEEP` trees; between, a
pass adds the trees since. Rows go down many trees at once by comparing whole columns of bins, node by node.

Gradients and Hessians are whole numbers of 2^-30 and are summed as such, so trees do not depend on partitions.

For logistic loss with g = p - y and h = p (1 - p): gain = GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), both sides with
H of at least `least`; a leaf adds -rate G / (H + l2). Each tree sees a share `sample` of the rows and of the features.

Defined results: a null or NaN value is under every cut point; ties of gain take the lesser feature, then the lesser bin; rows
in no model do nothing; equal rows are drawn together; a model of one class only has no trees and answers 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.ordering import scratch_path

BINS = 64
BLOCK = 1 << 14
KEEP = 10
#: Rows of a task, at least; there are no more tasks than cores until each has `FULL` rows.
PART = 1 << 14
FULL = 1 << 20
#: Trees that a block's rows go down together.
AT_ONCE = 64
#: Bytes of histograms that a reducer adds up.
REDUCED = 8 << 20
_ONE = 1 << 30
_OUT = 2


@dataclass
class Trees:
    """Sizes of the boosters; `least` is the Hessian weight a leaf needs, `l2` the penalty of leaf values."""

    count: int = 300
    depth: int = 4
    rate: float = 0.05
    sample: float = 0.8
    least: float = 5.0
    seed: int = 42
    l2: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order: node k goes to 2k+1, or to 2k+2 from bin `cut` on; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def stops(self, depth: int) -> np.ndarray:
        """The node in which the rows of each place on the level `depth` are: one of that level, or a leaf above."""
        node = np.zeros(1, np.int64)
        for _ in range(depth):
            on = self.feature[node] >= 0
            node = np.stack([np.where(on, 2 * node + 1, node), np.where(on, 2 * node + 2, node)], 1).ravel()
        return node


def places(grown: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    """Where each tree has each row on the level `depth`, from the left (trees by rows); rows of a leaf above go left. bins: features by rows."""
    at = np.zeros((len(grown), bins.shape[1]), np.uint8 if depth <= 8 else np.int64)
    feature, cut = np.stack([t.feature for t in grown]), np.stack([t.cut for t in grown])
    last = np.where(feature < 0, 255, cut - 1).astype(np.uint8)  # of the left side
    for level in range(depth):
        first = 2**level - 1
        right = np.zeros(at.shape, bool)
        for i in range(2**level):
            if (feature[:, first + i] >= 0).any():
                over = bins[np.maximum(feature[:, first + i], 0)] > last[:, first + i, None]
                right |= over & (at == i) if level else over
        at = 2 * at + right
    return at


@dataclass
class Booster:
    """The trees of one model over shared cut points (features by cuts, padded with infinity)."""

    cuts: np.ndarray
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out, by_feature = np.zeros(len(bins)), np.ascontiguousarray(bins.T)
        for a in range(0, len(self.trees), AT_ONCE):
            own = self.trees[a : a + AT_ONCE]
            for t, at in zip(own, places(own, by_feature, self.depth), strict=True):
                out += t.value[t.stops(self.depth)][at]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(binned(values, self.cuts))))


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bins of values (rows by features): how many cut points each value reaches."""
    out = np.zeros(values.shape, np.uint8)
    for f in range(values.shape[1]):
        x = values[:, f]
        out[:, f] = np.where(np.isnan(x), 0, np.searchsorted(cuts[f], x, "right"))
    return out


def cut_points(df: DataFrame, columns: list[str], bins: int = BINS) -> np.ndarray:
    """Distinct quantiles of each column, at most bins - 1."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 1 << 14).alias(f"q{i}") for i, c in enumerate(columns)]).first()  # bins numbers a column
    out = np.full((len(columns), bins - 1), np.inf)
    for i in range(len(columns)):
        q = np.unique(np.array(row[f"q{i}"] or [], float))
        out[i, : len(q)] = q
    return out


def _mixed(uid: np.ndarray, salt: int) -> np.ndarray:
    """Draws in [0, 1) by row, of their own for each salt."""
    x = uid.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def drawn_rows(uid: np.ndarray, trees: Trees, model: int, tree: int) -> np.ndarray:
    return _mixed(uid, (trees.seed * 1_000_003 + model) * 1_000_003 + tree) < trees.sample


def drawn_features(n: int, trees: Trees, model: int, tree: int) -> np.ndarray:
    """A share of the features (rounded, at least one), by draws of their own."""
    order = np.argsort(_mixed(np.arange(n), (trees.seed * 999_983 + model) * 1_000_003 + tree), kind="stable")
    chosen = np.zeros(n, bool)
    chosen[order[: max(1, round(trees.sample * n))]] = True
    return chosen


def slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians as whole numbers of 2^-30."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * _ONE), np.maximum(np.rint(p * (1 - p) * _ONE), 1.0)


def best_splits(sums: np.ndarray, allowed: np.ndarray, trees: Trees) -> list[tuple[int, int, float, float, float, float]]:
    """(feature, cut, left G, left H, G, H) of each node, feature -1 where none gains. sums: nodes, features, bins, (G, H)."""
    total = sums[:, allowed.argmax()].sum(1) / _ONE
    g, h = total[:, 0, None, None], total[:, 1, None, None]
    left = np.cumsum(sums, 2)[:, :, :-1] / _ONE
    gl, hl = left[..., 0], left[..., 1]
    gr, hr = g - gl, h - hl
    gain = gl**2 / (hl + trees.l2) + gr**2 / (hr + trees.l2) - g**2 / (h + trees.l2)
    gain[(hl < trees.least) | (hr < trees.least) | ~allowed[:, None]] = -np.inf
    out = []
    for i, best in enumerate(gain.reshape(len(sums), -1).argmax(1).tolist()):
        f, b = divmod(best, gain.shape[2])
        # sums of whole numbers are exact, what is divided is not: a gain must be more than rounding
        if gain[i, f, b] > 1e-9:
            out.append((f, b + 1, float(gl[i, f, b]), float(hl[i, f, b]), *total[i].tolist()))
        else:
            out.append((-1, 0, 0.0, 0.0, *total[i].tolist()))
    return out


def grow(tree: Tree, level: int, splits: list[tuple], trees: Trees) -> None:
    """Enter the splits of one level; the values of new leaves come from the sums on either side."""
    first = 2**level - 1
    value = lambda g, h: -trees.rate * g / (h + trees.l2)
    for i, (f, cut, gl, hl, g, h) in enumerate(splits):
        k = first + i
        if level and tree.feature[(k - 1) // 2] < 0:
            continue  # no such node
        if level == 0:
            tree.value[k] = value(g, h)
        if f >= 0:
            tree.feature[k], tree.cut[k] = f, cut
            tree.value[2 * k + 1], tree.value[2 * k + 2] = value(gl, hl), value(g - gl, h - hl)


def histograms(bins: np.ndarray, y: np.ndarray, uid: np.ndarray, margin: np.ndarray, current: list[Tree | None], allowed: list[np.ndarray], trees: Trees, number: int, level: int, n_bins: int) -> dict[int, np.ndarray]:
    """Sums of one block by model: nodes of the level, features (0 of those that are not allowed), bins, (G, H). All but uid: features or models by rows."""
    out = {}
    n_features, width = len(bins), 2**level
    own = [m for m, tree in enumerate(current) if tree is not None]
    cell = bins + np.arange(n_features)[:, None] * n_bins
    for m, at in zip(own, places([current[m] for m in own], bins, level), strict=True):
        on = current[m].stops(level) >= width - 1
        rows = np.flatnonzero((y[m] != _OUT) & drawn_rows(uid, trees, m, number) & on[at])
        features = np.flatnonzero(allowed[m])
        key = (cell[features].take(rows, 1) + at[rows].astype(np.int64) * (n_features * n_bins)).ravel()
        parts = [np.bincount(key, np.tile(v, len(features)), width * n_features * n_bins) for v in slopes(margin[m, rows], y[m, rows])]
        out[m] = np.stack(parts, 1).astype(np.int64).reshape(width, n_features, n_bins, 2)
    return out


_BLOCKS = "bins binary, y binary, uid binary, margin binary"


def _blocks(rows: DataFrame, n_features: int, n_models: int, cuts: np.ndarray) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, n_features)
                y = part.column("y").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(n, n_models)
                uid = part.column("uid").to_numpy().astype(np.int64)
                cols = (np.ascontiguousarray(binned(x, cuts).T), np.ascontiguousarray(y.T), uid, np.zeros((n_models, n)))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["bins", "y", "uid", "margin"])

    return rows.mapInArrow(pack, _BLOCKS)


def _arrays(batch: pa.RecordBatch, n_features: int, n_models: int) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(batch.num_rows):
        read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
        yield read("bins", np.uint8).reshape(n_features, -1), read("y", np.uint8).reshape(n_models, -1), read("uid", np.int64), read("margin", float).reshape(n_models, -1)


def _with_trees(bins: np.ndarray, margin: np.ndarray, since: list[list[tuple[Tree, np.ndarray]]], depth: int) -> np.ndarray:
    """Margins with the trees since, each given with its values by place."""
    out = margin.copy()
    flat = [(m, t, values) for m, own in enumerate(since) for t, values in own]
    for a in range(0, len(flat), AT_ONCE):
        some = flat[a : a + AT_ONCE]
        for (m, _, values), at in zip(some, places([t for _, t, _ in some], bins, depth), strict=True):
            out[m] += values[at]
    return out


def fit_many(rows: DataFrame, columns: list[str], models: list[tuple[Column, Column]], trees: Trees | None = None, bins: int = BINS) -> list[Booster]:
    """One booster for each (where, hit): rows that meet `where`, the class 1 where they meet `hit`."""
    trees = trees or Trees()
    spark = rows.sparkSession
    n_f, n_m = len(columns), len(models)
    cuts = cut_points(rows, columns, bins)
    told = [F.when(F.coalesce(w, F.lit(False)), F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)).otherwise(_OUT).cast("byte") for w, hit in models]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in columns])
    narrow = rows.select(x.alias("x"), F.array(*told).alias("y"), F.xxhash64(*columns).alias("uid"))
    counted = rows.agg(F.count("*").alias("n"), *[F.min(F.when(t != _OUT, t)).alias(f"a{i}") for i, t in enumerate(told)], *[F.max(F.when(t != _OUT, t)).alias(f"b{i}") for i, t in enumerate(told)]).first()  # two numbers a model, and one
    live = [m for m in range(n_m) if counted[f"a{m}"] == 0 and counted[f"b{m}"] == 1]
    out = [Booster(cuts, trees.depth) for _ in models]
    if not live:
        return out
    # the passes are short and all alike: a session of their own leaves out the adaptive planning between their two stages
    loop = spark.newSession()
    loop.conf.set("spark.sql.adaptive.enabled", "false")
    tasks = max(1, min(counted.n // PART, spark.sparkContext.defaultParallelism), counted.n // FULL)
    blocks = _written(_blocks(narrow.repartition(tasks), n_f, n_m, cuts), loop, tasks)
    since: list[list[tuple[Tree, np.ndarray]]] = [[] for _ in models]
    # a reducer adds up about `REDUCED` bytes; what one task has added up needs no exchange
    reducers = 0 if tasks == 1 else max(1, min(len(live), tasks * len(live) * 2 ** (trees.depth - 1) * n_f * bins * 16 // REDUCED))

    for number in range(trees.count):
        current: list[Tree | None] = [Tree.empty(trees.depth) if m in live else None for m in range(n_m)]
        allowed = [drawn_features(n_f, trees, m, number) for m in range(n_m)]
        for level in range(trees.depth):
            for m, splits in _level(blocks, since, current, allowed, trees, number, level, n_f, n_m, bins, reducers):
                grow(current[m], level, splits, trees)
        for m in live:
            since[m].append((current[m], current[m].value[current[m].stops(trees.depth)]))
            out[m].trees.append(current[m])
        if (number + 1) % KEEP == 0 and number + 1 < trees.count:
            kept = _written(_kept(blocks, since, trees.depth, n_f, n_m), loop, tasks)
            blocks.unpersist()
            blocks, since = kept, [[] for _ in models]
    blocks.unpersist()
    return out


def _written(blocks: DataFrame, session: SparkSession, tasks: int) -> DataFrame:
    path = scratch_path(blocks.sparkSession, "blocks")
    blocks.write.parquet(path)
    read = session.read.schema(_BLOCKS).parquet(path)
    # files make up partitions by their bytes, so blocks are dealt anew
    return (read.repartition(tasks) if tasks > 1 else read.coalesce(1)).persist()


def _kept(blocks: DataFrame, since: list, depth: int, n_f: int, n_m: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_with_trees(b, m, since, depth).tobytes() for b, _, _, m in _arrays(batch, n_f, n_m)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "y", "uid")), pa.array(new, pa.binary())], names=["bins", "y", "uid", "margin"])

    return blocks.mapInArrow(add, _BLOCKS)


def _level(blocks: DataFrame, since: list, current: list, allowed: list, trees: Trees, number: int, level: int, n_f: int, n_m: int, bins: int, reducers: int) -> list[tuple[int, list[tuple]]]:
    """The splits of each model's nodes on one level."""
    shape = (2**level, n_f, bins, 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, y, uid, margin in _arrays(batch, n_f, n_m):
                for m, sums in histograms(b, y, uid, _with_trees(b, margin, since, trees.depth), current, allowed, trees, number, level, bins).items():
                    total[m] = total[m] + sums if m in total else sums
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["model", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, load in zip(batch.column("model").to_pylist(), batch.column("sums"), strict=True):
                sums = np.frombuffer(load.as_buffer(), np.int64).reshape(shape)
                total[m] = total[m] + sums if m in total else sums
        found = [(m, np.array(best_splits(v, allowed[m], trees)).tobytes()) for m, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.int32()), pa.array([s for _, s in found], pa.binary())], names=["model", "splits"])

    answer = "model int, splits binary"
    if reducers:
        found = blocks.mapInArrow(add, "model int, sums binary").repartition(reducers, "model").mapInArrow(best, answer)
    else:
        found = blocks.mapInArrow(lambda batches: best(add(batches)), answer)
    got = found.collect()  # one row a model, one split a node
    return [(r.model, [(int(s[0]), int(s[1]), *map(float, s[2:])) for s in np.frombuffer(r.splits).reshape(-1, 6)]) for r in got]


def with_probabilities(df: DataFrame, columns: list[str], boosters: list[Booster], out: str) -> DataFrame:
    """df with an array of the boosters' probabilities; one without trees answers 0.5."""
    sent = df.sparkSession.sparkContext.broadcast(boosters)

    @F.pandas_udf("array<double>")
    def score(x):
        import pandas as pd

        values = np.stack(x.to_list()).astype(float) if len(x) else np.zeros((0, len(columns)))
        bins = binned(values, sent.value[0].cuts)
        found = [1.0 / (1.0 + np.exp(-b.margins(bins))) for b in sent.value]
        return pd.Series(list(np.stack(found, 1))) if len(x) else pd.Series([], dtype=object)

    score = score.asNondeterministic()  # one call a row, however often its parts are read
    return df.withColumn(out, score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in columns])))
