"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target in words; every document of it is wanted target / source_size times: that many whole copies, and
one more with the fractional part as inclusion probability. The cube method moves these probabilities through the null
space of the balancing constraints (words, documents): three undecided documents at a time, along the direction that keeps
both totals, until one of them is 0 or 1. The flight runs in blocks of bounded size, and the few undecided documents of
each block (two at most) meet again in coarser blocks until one block a source is left; the landing drops the document
total, settles the last document by a fixed draw, and turns over up to four documents of the last block where that brings
the words nearer to their target (so a few inclusion probabilities a source differ from the given ones).

Source totals, ranks and targets are tables: nothing here grows on the driver but the number of rounds.

Defined results: size of a null or empty text is 0; a null source is one source, ranked last; documents of a source without
words are wanted 0 times; a very long text is one document, moves first and never counts in part; repeated rows (same id,
source and text) are one unit and get the same number of copies; draws depend on the seed and the row alone, and ties in size
and draw go by the unit's hash, so reruns agree; an empty table gives no rows. Extra columns pass through, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from rillwave.functions.ordering import with_global_number

from .shared import written

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words are runs of anything but U+0020 and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares of the whole by weight; what exceeds `most` times a source goes to the others by weight."""
    sources = written(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    # Spark orders strings by their UTF-8 bytes, which is the order of code points
    ranked = written(with_global_number(sources, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", weight), "ranked")
    words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    # a source is full once most * size / weight is under the common level; levels only rise
    level, full = 0.0, F.lit(False)
    while True:
        s = ranked.agg(F.sum(F.when(full, F.lit(most) * F.col("source_size")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if not s.open:
            break
        level = (words - s.held) / s.open
        wider = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        if ranked.where(wider).count() <= s.n:
            break
        full = wider
    return ranked.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.lit(most) * F.col("source_size")).alias("target"))


def _move(pi: float, u: float) -> tuple[float, float]:
    """How far pi can go along +u and along -u within [0, 1]."""
    if u > 0:
        return (1.0 - pi) / u, pi / u
    if u < 0:
        return pi / -u, (1.0 - pi) / -u
    return np.inf, np.inf


def flight(pi: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """Probabilities after the flight, in the given order (largest first); at most two stay fractional, with `last` none.

    Three documents move along the direction that keeps words and documents. In the last part of the order, a document that
    is left over and far larger than the next moves against that one alone, which keeps words only: it would else stay
    undecided to the end and weigh down the landing.
    """
    eps = 1e-9
    out = pi.astype(float).tolist()
    z, luck = size.astype(float).tolist(), draw.tolist()
    live: list[int] = []

    def step(units: list[int], u: list[float], chance: float) -> None:
        top = max(map(abs, u))
        u = [x / top for x in u]
        ahead = min(_move(out[k], x)[0] for k, x in zip(units, u, strict=True))
        back = min(_move(out[k], x)[1] for k, x in zip(units, u, strict=True))
        by = ahead if chance * (ahead + back) < back else -back
        for k, x in zip(units, u, strict=True):
            p = out[k] + by * x
            out[k] = 0.0 if p < eps else 1.0 if p > 1 - eps else p

    def pair(a: int, b: int) -> None:
        step([a, b], [z[b], -z[a]] if z[a] or z[b] else [1.0, -1.0], luck[b])

    tail = len(out) * 3 // 5
    for i in range(len(out)):
        live.append(i)
        while len(live) > 1:
            large, small = max(live, key=z.__getitem__), min(live, key=z.__getitem__)
            if i >= tail and large != small and z[large] > 2 * z[small]:
                pair(large, small)
            elif len(live) == 3:
                a, b, c = live
                u = [z[b] - z[c], z[c] - z[a], z[a] - z[b]]
                step(live, u if any(u) else [1.0, -1.0, 0.0], luck[i])
            else:
                break
            live = [k for k in live if 0 < out[k] < 1]
    if last:
        # landing: words only, then one document by a draw
        if len(live) == 2:
            pair(*live)
            live = [k for k in live if 0 < out[k] < 1]
        for k in live:
            out[k] = float(luck[k] < out[k])
        return _settle(np.array(out), pi, size)
    return np.array(out)


def _settle(chosen: np.ndarray, pi: np.ndarray, size: np.ndarray, flips: int = 4) -> np.ndarray:
    """The end of the landing: turn over, one at a time, the document that brings the words nearest to their expectation."""
    z = size.astype(float)
    off = float(((chosen - pi) * z).sum())
    for _ in range(flips):
        after = np.abs(off + z * (1 - 2 * chosen))
        k = int(np.argmin(after)) if len(after) else -1
        if k < 0 or after[k] >= abs(off) * (1 - 1e-9):
            break
        off += z[k] * (1 - 2 * chosen[k])
        chosen[k] = 1 - chosen[k]
    return chosen



def cube_sample(units: DataFrame, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """units: (source, size, uid, pi); adds chosen (0 or 1). Blocks are dealt by a hash of uid within each source."""
    spark = units.sparkSession
    counts = units.where("pi > 0 and pi < 1").groupBy("source").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("blocks"))
    # matched null-safely: a null source is a source
    dealt = units.alias("u").join(counts.alias("c"), F.col("u.source").eqNullSafe(F.col("c.source")), "left").select("u.*", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    now = dealt.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("blocks")))
    done = now.where("pi <= 0 or pi >= 1").select("source", "size", "uid", F.col("pi").cast("int").alias("chosen"))
    now = now.where("pi > 0 and pi < 1").select("source", "size", "uid", "pi", "blocks", "block")
    schema = spark.createDataFrame([], "source string, size long, uid long, pi double, blocks long, block long").schema

    def fly(table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        blocks = table.column("blocks")[0].as_py()
        draw = K.unit(seed + blocks, uid)
        order = np.lexsort((uid, draw, -table.column("size").to_numpy()))
        table = table.take(pa.array(order))
        pi = flight(table.column("pi").to_numpy(), table.column("size").to_numpy(), draw[order], blocks <= 1)
        return table.set_column(table.column_names.index("pi"), "pi", pa.array(pi))

    while not now.isEmpty():
        flown = written(now.groupBy("source", "blocks", "block").applyInArrow(fly, schema), "flown")
        done = done.unionByName(flown.where("pi = 0 or pi = 1").select("source", "size", "uid", F.col("pi").cast("int").alias("chosen")))
        fewer = F.ceil(F.col("blocks") / F.lit(block_rows // 2)).cast("long")
        now = flown.where("pi > 0 and pi < 1").withColumn("block", F.pmod("block", fewer)).withColumn("blocks", fewer).where("block is not null")
    return done


def _unit(id_col: str, text_col: str, source_col: str) -> Column:
    """A unit of the sample: a hash of id, source and text."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`"))


def copies(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7
) -> DataFrame:
    """One row for each row of `documents`: its id, uid, size, source_size, target, copies; the text is read but not shuffled."""
    picked = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), _unit(id_col, text_col, source_col).alias("uid")]
    rows = written(documents.select(*picked), "sizes")
    units = rows.groupBy("source", "uid").agg(F.max("size").alias("one"), F.count("*").alias("rows")).withColumn("size", F.col("one") * F.col("rows"))
    targets = source_targets(units, weights, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.source", "uid", "size", "source_size", "target", wanted.alias("wanted"))
    # a fraction within 1e-9 of a whole number counts as that number
    units = units.withColumn("whole", F.floor(F.col("wanted") + 1e-9)).withColumn("pi", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole")))
    units = written(units.withColumn("pi", F.when(F.col("pi") < 1e-9, 0.0).otherwise(F.col("pi"))), "units")
    extra = cube_sample(units.select("source", "size", "uid", "pi"), seed)
    # written, so that a unit of very many repeated rows can be split in the join
    decided = written(units.join(extra.select("uid", "chosen"), "uid").select("uid", "source_size", "target", (F.col("whole") + F.col("chosen")).alias("copies")), "decided")
    return rows.join(decided, "uid").select(F.col("id").alias(id_col), "uid", "size", "source_size", "target", "copies")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mixed corpus: every row of `documents` as often as the mix takes it, with the columns of `documents`."""
    taken = written(copies(documents, id_col, text_col, source_col, **options).where("copies > 0").select("uid", "copies").distinct(), "taken")
    # the row travels as one struct, so no name of its columns can meet ours
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _unit(id_col, text_col, source_col).alias("uid"))
    # a merge join at every size: the numbers of copies outgrow any broadcast, and rows of one unit can be split
    return rows.join(taken.hint("merge"), "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
