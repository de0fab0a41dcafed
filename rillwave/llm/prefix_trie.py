"""Prefix trie of conversations in balanced parentheses: which turns would be stored once if shared prefixes were.

Turns are numbered in their conversation, each conversation is rebuilt on the opening of its family's first one, and running
sums of turn hashes (four of 28 bits, by ranges, so no task holds a conversation) name each prefix. One aggregation gives
every prefix its members. A chain of prefixes with the same members is one run, named by its least member and their
number; a conversation's path is its few runs, at most about the square root of twice all turns.

Paths are sorted over ranges of (path, conversation), a range is a shard. A shard writes its trie as balanced parentheses
in preorder, keeps the least excess of blocks of `BLOCK` bits in a tree (range min-max), and finds the close of every
parenthesis, which delimits its subtree. Ranks of leaf pairs "()" count leaves, cumulative arrays give savings and members.
Runs that neighbouring shards share (the spines) are counted by the first of them only, and added up over the shards;
all others are final in their shard.

Defined results: rows of equal turn are ordered by the sha-256 of role length, role and text, repeated rows are turns each; a
null turn comes first; a null role or text is empty; a null conv_id (and 2^63 - 1) is one conversation without a family,
ordered last and written as the empty text; very long texts count by their bytes; an empty table gives no rows (there is no
root without a conversation). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import with_group_sums

from .shared import partitions, written

#: Conversations in one family share the opening of the first; an opening has fewer turns than `OPENINGS`.
FAMILY, OPENINGS = 5, 9
#: Bits of a block of the range min-max tree.
BLOCK = 64
#: Path elements of a shard, about.
SHARD = 1 << 18
#: Members in one piece of text, where several shards write the members that end at a prefix.
PIECE = 512
_LAST = (1 << 63) - 1
_KEY = ["pos", *[f"s{i}" for i in range(4)]]
_RUN = ["top", "m", "n", "bottom", "before", "bytes", "leaf"]


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, bytes, digest), pos from 1, and (conv): the turns of every rebuilt conversation, and all conversations."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.coalesce(F.col(f"`{conv_col}`").cast("long"), F.lit(_LAST)).alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.octet_length(text).alias("bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    own = with_group_sums(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")], {"at": F.lit(1)}).drop("turn", "tie")
    own = written(own, "turns")
    decimal = F.when(F.col("conv") == _LAST, F.lit("")).otherwise(F.col("conv").cast("string"))
    first = F.when(F.col("conv") != _LAST, F.col("conv") - F.col("conv") % family)
    convs = written(own.groupBy("conv").agg(F.least(F.max("at"), F.lit(openings - 1)).alias("opening")), "conversations")
    wanted = convs.select("conv", F.pmod(F.crc32(decimal.cast("binary")), F.lit(openings)).alias("h"), first.alias("first"))
    known = wanted.join(convs.select(F.col("conv").alias("first"), "opening"), "first", "left").select("conv", "h", "first", F.least("h", F.coalesce("opening", F.lit(0))).alias("taken"))
    known = written(known, "openings")
    heads = own.where(F.col("at") < openings).withColumnRenamed("conv", "first")
    opening = heads.join(known, "first").where("at <= h").select("conv", F.col("at").alias("pos"), "bytes", "digest")
    rest = own.join(known, "conv").where("at > h").select("conv", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "bytes", "digest")
    return opening.unionByName(rest), convs.select("conv")


def prefixes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, pos, bytes, tb, n, m, leaf): each conversation's prefixes with the root, their members, the least of them."""
    named = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")).cast("binary"), 256)
    parts = {f"h{i}": F.conv(F.substring("_name", 1 + 7 * i, 7), 16, 10).cast("long") for i in range(4)}
    rows = path.withColumn("_name", named).withColumns(parts).drop("_name", "digest")
    sums = with_group_sums(rows, ["conv"], [F.col("pos")], {**{f"s{i}": F.col(f"h{i}") for i in range(4)}, "tb": F.col("bytes")})
    sums = written(sums, "prefixes")
    ahead = sums.select((F.col("pos") - 1).alias("pos"), *[(F.col(f"s{i}") - F.col(f"h{i}")).alias(f"s{i}") for i in range(4)], F.lit(None).cast("long").alias("conv"), F.lit(1).alias("ext")).where("pos > 0")
    met = sums.select(*_KEY, "conv", F.lit(0).alias("ext")).unionByName(ahead)
    nodes = met.groupBy(*_KEY).agg(F.count("conv").alias("n"), F.min("conv").alias("m"), (F.max("ext") == 0).alias("leaf"))
    # many rows to one: a hot prefix is split by the adaptive skew join, as both sides are written tables
    below = sums.select("conv", *_KEY, "bytes", "tb").join(written(nodes, "nodes"), _KEY).select("conv", "pos", "bytes", "tb", "n", "m", "leaf")
    n, m = convs.agg(F.count("*"), F.min("conv")).first()
    grown = below.select("pos").limit(1).count() > 0
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("pos"), zero.cast("int").alias("bytes"), zero.alias("tb"), F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"), F.lit(not grown).alias("leaf"))
    return written(below.unionByName(root), "members")


def paths(members: DataFrame) -> DataFrame:
    """(conv, path): the runs of prefixes with the same members, from the root down."""
    runs = members.groupBy("conv", "m", "n").agg(
        F.min("pos").alias("top"), F.max("pos").alias("bottom"), F.min(F.col("tb") - F.col("bytes")).alias("before"), F.sum(F.col("bytes").cast("long")).alias("bytes"), F.max("leaf").cast("long").alias("leaf")
    )
    return runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_RUN))).alias("path"))


# --- one shard ---------------------------------------------------------------------------------------------------------


class Parentheses:
    """A balanced sequence with excess blocks in a min tree; `close` finds the partners of all opens together."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        n_blocks = max(1, -(-len(bits) // BLOCK))
        padded = np.full(n_blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(n_blocks, BLOCK)
        self.leaves = 1 << (n_blocks - 1).bit_length()
        self.least = np.full(2 * self.leaves, np.iinfo(np.int32).max, np.int32)
        self.least[self.leaves : self.leaves + n_blocks] = self.blocks.min(1)
        for k in range(self.leaves.bit_length() - 2, -1, -1):
            a = 1 << k
            self.least[a : 2 * a] = np.minimum(self.least[2 * a : 4 * a : 2], self.least[2 * a + 1 : 4 * a : 2])

    def close(self, opens: np.ndarray) -> np.ndarray:
        out = np.empty(len(opens), np.int64)
        for a in range(0, len(opens), 1 << 14):
            out[a : a + (1 << 14)] = self._close(opens[a : a + (1 << 14)])
        return out

    def _first(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in the block of the first excess of `target` behind `after`; -1: none."""
        hit = (self.blocks[block] == target[:, None]) & (np.arange(BLOCK)[None] > after[:, None])
        return np.where(hit.any(1), hit.argmax(1), -1)

    def _close(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        block = opens // BLOCK
        at = self._first(block, opens % BLOCK, target)
        todo = np.flatnonzero(at < 0)
        node, want = block[todo] + self.leaves, target[todo]
        # up until a right sibling reaches the target, then down to its first block that does
        live = np.ones(len(todo), bool)
        while live.any():
            right = np.minimum(node + 1, 2 * self.leaves - 1)
            found = live & (node % 2 == 0) & (self.least[right] <= want)
            node = np.where(found, right, np.where(live, node // 2, node))
            live &= ~found
        while (inner := node < self.leaves).any():
            node = np.where(inner, 2 * node + (self.least[np.where(inner, 2 * node, 0)] > want), node)
        block[todo] = node - self.leaves
        at[todo] = self._first(block[todo], np.full(len(todo), -1), want)
        return block * BLOCK + at


def shard_trie(lengths: np.ndarray, runs: dict[str, np.ndarray], shared_before: int) -> dict[str, np.ndarray]:
    """The trie of paths in order. lengths: elements of each path; runs: columns `_RUN` of all elements; shared_before: how many elements of the first path the shard before has too.

    Gives columns by node in preorder: `first` (its element), `children`, `leaves`, `saved`, `ends_from`, `ends_to` (the paths that end at it), of what this shard owns.
    """
    count = len(lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    of = np.repeat(np.arange(count), lengths)
    depth = np.arange(starts[-1]) - starts[of]
    before = np.where(of > 0, starts[np.maximum(of - 1, 0)] + depth, 0)
    equal = (of > 0) & (depth < lengths[np.maximum(of - 1, 0)])
    equal &= (runs["m"] == runs["m"][before]) & (runs["n"] == runs["n"][before])
    opens = ~equal  # an element that the path before has not is a new node
    kept = np.bincount(of, equal, minlength=count).astype(np.int64)
    closes = np.concatenate(([0], lengths[:-1] - kept[1:], [lengths[-1]]))
    steps = np.empty(2 * count + 1, np.int64)
    steps[0::2], steps[1::2] = closes, np.append(lengths - kept, 0)[:count]
    bits = np.repeat(np.arange(2 * count + 1) % 2 == 1, steps)
    tree = Parentheses(bits)
    at = np.flatnonzero(bits)
    ends = tree.close(at)
    size = (ends - at + 1) // 2
    first = np.flatnonzero(opens)
    nodes = len(first)
    span = np.arange(nodes) + size
    # node of each element: the last one opened at its depth
    number = np.cumsum(opens) - 1
    along = np.lexsort((np.arange(len(of)), depth))
    held = np.maximum.accumulate(np.where(opens[along], np.arange(len(of)), 0))
    node = np.empty(len(of), np.int64)
    node[along] = number[along[held]]
    owned = ~((of[first] == 0) & (depth[first] < shared_before))

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[span] - total[:nodes]

    # ranks of leaf pairs, up to each bit
    pair = np.zeros(len(bits), np.int64)
    pair[at] = (~bits[at + 1]) & owned & (runs["leaf"][first] > 0)
    rank = np.concatenate(([0], np.cumsum(pair)))
    parent = np.where(depth[first] > 0, node[first - 1], -1)
    last = node[starts[1:] - 1]
    return {
        "first": first,
        "depth": depth[first],
        "children": np.bincount(parent[owned & (parent >= 0)], minlength=nodes),
        "leaves": rank[ends] - rank[at],
        "saved": below(np.where(owned, (runs["n"][first] - 1) * runs["bytes"][first], 0)),
        "parent": np.where(parent >= 0, first[np.maximum(parent, 0)], -1),
        "ends_from": np.searchsorted(last, np.arange(nodes)),
        "ends_to": np.searchsorted(last, np.arange(nodes), "right"),
        "spine": (of[first] == 0) & (depth[first] < shared_before),
        "last_path": node[starts[-2] :],
    }


def _common(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x.m == y.m) & (x.n == y.n)), lambda x: x))


_NODE = "m long, n long, top long, bottom long, before long, parent_m long, children long, leaves long, saved long, ends_sha256 string, spine boolean"


def trie_runs(sequences: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """A row a run of prefixes: `_NODE` without spine, over all shards."""
    spark = sequences.sparkSession
    elements = sequences.agg(F.sum(F.size("path"))).first()[0] or 0
    n = max(partitions(spark), -(-elements // shard_size))
    dealt = written(sequences.repartitionByRange(n, "path", "conv").withColumn("shard", F.spark_partition_id()), "paths")
    borders = written(dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")), "borders")
    have = sorted(r.shard for r in borders.select("shard").collect())  # one number a shard
    follows = spark.createDataFrame(list(zip(have[:-1], have[1:], strict=True)), "shard int, next int")
    after = borders.select(F.col("shard").alias("next"), F.col("low").alias("next_low"))
    shared = borders.join(F.broadcast(follows), "shard").join(after, "next").select("shard", "next", _common("high", "next_low").alias("both")).collect()  # three numbers a shard
    with_next, with_last = {r.shard: r.both for r in shared}, {r.next: r.both for r in shared}

    def build(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        convs, lists = table.column("conv").combine_chunks(), table.column("path").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        runs = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in _RUN}
        # rows of a group come in no order: sort by the paths' elements, level by level, then by conversation
        order = _sorted_paths(lengths, runs, convs.to_numpy())
        starts = np.concatenate(([0], np.cumsum(lengths)))
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
        runs, lengths, ids = {c: v[take] for c, v in runs.items()}, lengths[order], convs.to_numpy()[order]
        t = shard_trie(lengths, runs, with_last.get(shard, 0))
        spine = t["spine"].copy()
        spine[t["last_path"][: with_next.get(shard, 0)]] = True
        names = ["" if c == _LAST else str(c) for c in ids.tolist()]
        nothing = hashlib.sha256(b"").hexdigest()
        hashes, extra = [], []
        for k, (a, b) in enumerate(zip(t["ends_from"].tolist(), t["ends_to"].tolist(), strict=True)):
            if spine[k]:
                hashes.append(None)
                extra += [(k, ",".join(names[i : min(i + PIECE, b)]), i) for i in range(a, b, PIECE)]
            else:
                hashes.append(hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() if b > a else nothing)
        f = t["first"]
        cols = {c: pa.array(runs[c][f], pa.int64()) for c in ("m", "n", "top", "bottom", "before")}
        cols["parent_m"] = pa.array(runs["m"][np.maximum(t["parent"], 0)], pa.int64(), mask=t["parent"] < 0)
        cols |= {c: pa.array(t[c], pa.int64()) for c in ("children", "leaves", "saved")}
        made = pa.table({**cols, "ends_sha256": pa.array(hashes, pa.string()), "spine": pa.array(spine), "piece": pa.nulls(len(f), pa.int64()), "ids": pa.nulls(len(f), pa.string())})
        if not extra:
            return made
        k = np.array([e[0] for e in extra])
        pieces = {c: made.column(c).take(pa.array(k)) for c in ("m", "n")}
        more = pa.table({c: pieces.get(c, pa.nulls(len(k), made.schema.field(c).type)) for c in made.column_names if c not in ("piece", "ids")} | {"piece": pa.array([shard * (1 << 32) + e[2] for e in extra], pa.int64()), "ids": pa.array([e[1] for e in extra], pa.string())})
        return pa.concat_tables([made, more])

    out = written(dealt.groupBy("shard").applyInArrow(build, f"{_NODE}, piece long, ids string"), "shards")
    nodes = out.where("piece is null")
    whole = nodes.where("not spine").drop("spine", "piece", "ids")
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    spines = nodes.where("spine").groupBy("m", "n").agg(*[F.first(c).alias(c) for c in ("top", "bottom", "before", "parent_m")], *sums)
    ends = out.where("piece is not null").select("m", "n", "piece", "ids").repartition(n, "m", "n").sortWithinPartitions("m", "n", "piece").mapInArrow(_digests, "m long, n long, ends_sha256 string")
    merged = spines.join(ends, ["m", "n"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return whole.unionByName(merged)


def _sorted_paths(lengths: np.ndarray, runs: dict[str, np.ndarray], convs: np.ndarray) -> np.ndarray:
    """Order of the paths as the ranges have it: element by element (top, m, n), a prefix first, then by conversation."""
    order = np.argsort(convs, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))
    todo = [order]
    out: list[np.ndarray] = []
    level = [0]
    while todo:
        group, d = todo.pop(), level.pop()
        done = lengths[group] <= d
        if done.any():
            out.append(group[done])
        group = group[~done]
        if len(group) < 2:
            out.append(group)
            continue
        e = starts[group] + d
        by = np.lexsort((runs["n"][e], runs["m"][e], runs["top"][e]))
        group, e = group[by], e[by]
        cut = np.flatnonzero((runs["m"][e][1:] != runs["m"][e][:-1]) | (runs["n"][e][1:] != runs["n"][e][:-1])) + 1
        for part in reversed(np.split(group, cut)):
            todo.append(part)
            level.append(d + 1)
    return np.concatenate(out) if out else order


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sha-256 of each run's pieces, which come sorted, one piece at a time."""
    key, state = None, None

    def row(key: tuple, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["m", "n", "ends_sha256"])

    for batch in batches:
        for m, n, ids in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (m, n) != key:
                if key is not None:
                    yield row(key, state)
                key, state = (m, n), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield row(key, state)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_size: int = SHARD) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path, convs = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    members = prefixes(path, convs)
    runs = written(trie_runs(paths(members), shard_size), "runs")
    # a node is where its least member has it; many nodes to one run: split by the adaptive skew join
    nodes = members.where("conv = m").select("m", "n", F.col("pos").alias("depth"), (F.col("tb") - F.col("bytes")).alias("above"))
    met = nodes.join(runs, ["m", "n"])

    def shown(c: str):
        return F.when(F.col(c) != _LAST, F.col(c))

    return met.select(
        shown("m").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), shown("m")).otherwise(shown("parent_m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("above") - F.col("before"))).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("bottom"), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
