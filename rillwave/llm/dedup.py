"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of five words (lower-cased, letters and digits), each with its count times a damped
inverse document frequency. One pass gives every text a signature of `bands * rows` consistent samples; texts with an equal
band are candidates; candidates are verified by weighted Jaccard similarity of their whole shingle sets (0.8 or more) and
verified links are joined into classes.

* Document frequency is read as a share of all texts from a count-min table over all documents. Its size is fixed, and so is
  its error as a share; weights only change for shingles in more than 1/`COMMON` of the texts, well above that error, so
  the weights behave alike at every size of corpus. Damping keeps a weight within [0.75, 1]: passages that very many texts
  share count less, while a group of copies, however large, cannot make its own shingles worthless and fall apart.
* Texts with the same words are one node, whatever their number: copies are put together before anything is joined, so a
  group of exact copies adds one row to the candidate search and no pairs.
* In every band bucket all members are compared with one leader. Where members stay in different classes after that, all
  of them are compared across classes: in small buckets pair by pair, in larger ones block by block, where only identities
  are dealt to blocks and each block's sets meet inside a task; only the links that join classes leave it.
* Classes come from min-label propagation with pointer jumping over tables in the shared folder; nothing but counts
  reaches the driver. Every table that is joined on a hot key (words of copies, a bucket) is written before, so adaptive
  execution can split the hot side.

Defined results: class_id is the least doc_id of the class. A null, empty or wordless text is like every other wordless
text in nothing: each is alone. A text of fewer than five words is one shingle of all its words. Rows that share a doc_id
share a class, and repeated rows are repeated in the result. A row without doc_id takes the class of the rows with its
words, or null. A very long text is sampled and compared whole. An empty table gives no rows. Extra columns, whatever their
names, are not read by `near_duplicate_classes` and pass through `keep_one`; ties are broken by the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import unused, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Count-min table: cells a row, and rows.
WIDTH, DEPTH = 1 << 18, 2
COMMON = 64
FLOOR = 0.75
#: Buckets of up to so many members are compared pair by pair, larger ones in blocks of so many bytes of sets.
SMALL_BUCKET = 8
BLOCK_BYTES = 4 << 20
_DRAWS = 1 << 16
_PIECE = 1 << 14
_HASH = K.U64((1 << 48) - 1)


def _cells(h: np.ndarray, d: int) -> np.ndarray:
    return ((h * K.U64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[d])) >> K.U64(64 - 18)).astype(np.int64)


def document_frequency(documents: DataFrame, text_col: str, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The count-min table of shingles over all texts, and the number of texts with words."""

    @K.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(0))
            for lo, hi in K.blocks(offs):
                w = K.Words(raw, offs[lo : hi + 1], K.ALNUM)
                h, first = K.shingles(w, size)
                n += int((np.diff(first) > 0).sum())
                h = _per_text(h, first)[0] & _HASH
                for d in range(DEPTH):
                    cells[d] += np.bincount(_cells(h, d), minlength=WIDTH)
        if n:
            parts = cells.reshape(-1, _PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([np.array([n]).tobytes(), *(p.tobytes() for p in parts)], pa.binary())], names=["piece", "cells"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in tables:
            for x in t.column("cells"):
                part = np.frombuffer(x.as_buffer(), np.int64)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "cells"])

    counts = documents.select(text_col).mapInArrow(count, "piece int, cells binary").groupBy("piece").applyInArrow(add, "piece int, cells binary")
    table, n = np.zeros((DEPTH, WIDTH), np.int64), 0
    flat = table.reshape(-1, _PIECE)
    for r in counts.collect():  # DEPTH * WIDTH * 8 bytes, at any size of the corpus
        if r.piece < 0:
            n = int(np.frombuffer(r.cells, np.int64)[0])
        else:
            flat[r.piece] = np.frombuffer(r.cells, np.int64)
    return table, n


def _per_text(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number in the top 16 bits, hash below; sorted. And how often each occurs."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    return K.distinct((row << K.U64(48)) | (h >> K.U64(16)), counts=True)


def damped_idf(table: np.ndarray, n: int) -> np.ndarray:
    """For each cell the weight factor: FLOOR for a shingle in every text, 1 for one in less than 1/COMMON of them, in steps of 1/64."""
    share = np.clip(table / max(1, n), 1.0 / COMMON, 1.0)
    idf = np.log(1.0 / share) / np.log(COMMON)
    return (FLOOR + (1 - FLOOR) * np.round(idf * 16) / 16).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010): r and c are Gamma(2, 1), beta is uniform, for each element and sample.

    Draws come from fixed tables by a hash of the element for each sample; for the commonest weight, 1, the whole outcome is tabled.
    """

    def __init__(self, samples: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.turn = K.mix(np.arange(1, samples + 1, dtype=np.uint64) * K.U64(0x9E3779B97F4A7C15)) | K.U64(1)
        self.r = rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
        self.beta = rng.random(_DRAWS).astype(np.float32)
        self.one = self._outcome(np.arange(_DRAWS), np.float32(0.0))

    def _outcome(self, at: np.ndarray, log_w: np.ndarray | np.float32) -> np.ndarray:
        """High half: an order-preserving form of log a; low half: a hash of t."""
        r, beta = self.r[at], self.beta[at]
        t = np.floor(log_w / r + beta)
        log_a = self.log_c[at] - r * (t - beta + 1) + np.float32(4096)
        low = (t.astype(np.int64).astype(np.uint64) * K.U64(0xD6E8FEB86659FD93)) >> K.U64(32)
        return (log_a.view(np.uint32).astype(np.uint64) << K.U64(32)) | low

    def signatures(self, h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, samples) of 32-bit values; texts without elements have zeros."""
        full = np.flatnonzero(np.diff(first))
        out = np.zeros((len(first) - 1, len(self.turn)), np.uint64)
        if not len(full):
            return out
        h = K.mix(h)
        low = h & K.U64(0xFFFFFFFF)
        other = np.flatnonzero(weight != 1)
        h_other, log_other = h[other], np.log(weight[other])
        heads = first[full]
        for k, turn in enumerate(self.turn):
            key = self.one[((h * turn) >> K.U64(48)).astype(np.int64)]
            if len(other):
                key[other] = self._outcome(((h_other * turn) >> K.U64(48)).astype(np.int64), log_other)
            key ^= low
            out[full, k] = np.minimum.reduceat(key, heads) & K.U64(0xFFFFFFFF)
        return out


def weighted_set(w: K.Words, factor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their weights, and the first index of each text."""
    h, first = K.shingles(w, size)
    key, times = _per_text(h, first)
    h = key & _HASH
    share = factor[0][_cells(h, 0)]
    for d in range(1, DEPTH):
        share = np.maximum(share, factor[d][_cells(h, d)])
    return h, (share * times).astype(np.float32), np.searchsorted(key >> K.U64(48), np.arange(len(first), dtype=np.uint64))


def sketch(documents: DataFrame, id_col: str, text_col: str, factor: np.ndarray, size: int, bands: int, rows: int) -> DataFrame:
    """doc (id), k1 and k2 (hash of the words, null without words), band (array of bucket hashes)."""
    sent = documents.sparkSession.sparkContext.broadcast(factor)
    kind = documents.schema[id_col].dataType.simpleString()

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        c = K.coefficients(rows + bands)
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(1))
            k1, k2, none, band = [], [], [], []
            for lo, hi in K.blocks(offs):
                w = K.Words(raw, offs[lo : hi + 1], K.ALNUM)
                a, b = K.digest_pair(w.hashes, w.first)
                h, weight, first = weighted_set(w, sent.value, size)
                sig = sampler.signatures(h, weight, first).reshape(hi - lo, bands, rows)
                mixed = np.zeros((hi - lo, bands), np.uint64)
                for j in range(rows):
                    mixed += (sig[:, :, j] + K.U64(1)) * c[j]
                band.append(K.mix(mixed + c[rows : rows + bands]))
                k1.append(a)
                k2.append(b)
                none.append(w.counts == 0)
            mask = np.concatenate(none) if none else np.zeros(0, bool)
            flat = np.concatenate(band).reshape(-1) if band else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(K.as_long(flat)))
            key = [pa.array(K.as_long(np.concatenate(k)) if k else np.zeros(0, np.int64), pa.int64(), mask=mask) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *key, lists], names=["doc", "k1", "k2", "band"])

    return documents.select(id_col, text_col).mapInArrow(run, f"doc {kind}, k1 long, k2 long, band array<long>")


def shingle_sets(texts: DataFrame, ids: DataFrame, factor: np.ndarray, size: int) -> DataFrame:
    """(doc, items, size in bytes): the whole weighted set of each text in `ids` (doc); texts: (doc, text). Written to the shared folder."""
    sent = texts.sparkSession.sparkContext.broadcast(factor)
    kind = texts.schema["doc"].dataType.simpleString()

    @K.released
    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column("text"))
            out = []
            for lo, hi in K.blocks(offs):
                h, weight, first = weighted_set(K.Words(raw, offs[lo : hi + 1], K.ALNUM), sent.value, size)
                # 32 bits tell the shingles of two texts apart; ascending order of the hash keeps these ascending too
                top = (h >> K.U64(16)).astype(np.uint32)
                out += [top[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64())], names=["doc", "items", "size"])

    return written(texts.join(ids, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")).mapInArrow(to_set, f"doc {kind}, items binary, size long"), "sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least `least`. Many pairs may share an a: its set is added last, so no copy of it is shuffled."""
    kind = sets.schema["doc"].dataType.simpleString()

    @K.released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                keep[i] = weighted_jaccard(x.as_buffer(), y.as_buffer()) >= least - 1e-9
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}")


def _block_links(docs: list, roots: list, side: np.ndarray, items: list, least: float) -> list[tuple[int, int]]:
    """Links between the texts of side 0 and those of side 1 (all texts, if there is but one side) that join two classes."""
    at = {c: k for k, c in enumerate(dict.fromkeys(roots))}
    parent = list(range(len(at)))
    own = [at[c] for c in roots]  # the class of each text, by number

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = [len(memoryview(x)) // 8 for x in items]
    hashes = [np.frombuffer(x, np.uint32, k) for x, k in zip(items, n, strict=True)]
    weights = [np.frombuffer(x, np.float32, k, 4 * k) for x, k in zip(items, n, strict=True)]
    total = np.array([float(w.sum(dtype=np.float64)) for w in weights])
    links: list[tuple] = []

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        """All of left against all of right, through the shingles of right in order."""
        if not len(left) or not len(right):
            return
        flat = np.concatenate([hashes[k] for k in right])
        order = np.argsort(flat, kind="stable")
        flat, which = flat[order], np.repeat(right, [n[k] for k in right])[order]
        weight = np.concatenate([weights[k] for k in right])[order].astype(np.float64)
        for x in left:
            lo, hi = np.searchsorted(flat, hashes[x], "left"), np.searchsorted(flat, hashes[x], "right")
            times = hi - lo
            e = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            shared = np.bincount(which[e], np.minimum(weight[e], np.repeat(weights[x], times)), len(items))
            like = shared >= (least - 1e-9) * (total[x] + total - shared)
            for y in np.flatnonzero(like & (shared > 0)):
                p, q = find(own[x]), find(own[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((docs[x], docs[y]))

    # members of the largest class need not be compared among themselves
    main = np.array(own) == np.bincount(own).argmax()
    if side.any():
        compare(np.flatnonzero((side == 0) & ~main), np.flatnonzero(side == 1))
        compare(np.flatnonzero((side == 1) & ~main), np.flatnonzero((side == 0) & main))
    else:
        compare(np.flatnonzero(~main), np.arange(len(items)))
    return links


def block_links(members: DataFrame, sets: DataFrame, least: float, block_bytes: int | None = None) -> DataFrame:
    """Links (a, b) between different classes of a group (a bucket). members: (group, doc, class_id), each doc once a group."""
    kind = sets.schema["doc"].dataType.simpleString()
    size = block_bytes or BLOCK_BYTES
    sized = members.join(sets.select("doc", "size"), "doc")
    # written, so that a large group can be split in the join below
    room = written(sized.groupBy("group").agg(F.ceil(F.sum(F.col("size") + 64) / F.lit(size)).cast("int").alias("n")), "room")
    dealt = members.join(room, "group").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "class_id").join(sets.select("doc", "items"), "doc")

    def meet(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_pylist()
        side = (table.column("own").to_numpy() != table.column("i").to_numpy()).astype(np.int64)
        alone = table.column("i")[0] != table.column("j")[0] and (side.all() or not side.any())
        links = [] if alone else _block_links(docs, table.column("class_id").to_pylist(), side, [x.as_buffer() for x in table.column("items")], least)
        return pa.table([pa.array([a for a, _ in links], table.column("doc").type), pa.array([b for _, b in links], table.column("doc").type)], names=["a", "b"])

    return dealt.groupBy("group", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def weighted_jaccard(x: pa.Buffer | bytes, y: pa.Buffer | bytes) -> float:
    """Sum of least weights over sum of greatest, of two sets written by `similar`."""
    n, m = len(memoryview(x)) // 8, len(memoryview(y)) // 8
    a, b = np.frombuffer(x, np.uint32, n), np.frombuffer(y, np.uint32, m)
    u, v = np.frombuffer(x, np.float32, n, 4 * n), np.frombuffer(y, np.float32, m, 4 * m)
    if not n or not m:
        return 0.0
    at = np.minimum(np.searchsorted(b, a), m - 1)
    hit = b[at] == a
    shared = float(np.minimum(u[hit], v[at[hit]]).sum(dtype=np.float64))
    return shared / (float(u.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - shared)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, class_id): the least doc of each connected part. nodes: (doc, class_id) so far; links: (a, b)."""
    label = nodes
    while True:
        ends = links.join(label.select(F.col("doc").alias("a"), F.col("class_id").alias("p")), "a").join(label.select(F.col("doc").alias("b"), F.col("class_id").alias("q")), "b").where("p <> q")
        step = written(ends.select(F.greatest("p", "q").alias("old"), F.least("p", "q").alias("new")).groupBy("old").agg(F.min("new").alias("new")), "step")
        if step.isEmpty():
            return label
        # classes point to lower ones: follow the pointers to their ends
        while True:
            jump = step.select(F.col("old").alias("new"), F.col("new").alias("further"))
            ahead = written(step.join(jump, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")), "step")
            moved = not ahead.where("moved").isEmpty()
            step = ahead.select("old", "new")
            if not moved:
                break
        label = written(label.join(step, label.class_id == step.old, "left").select("doc", F.coalesce("new", "class_id").alias("class_id")), "labels")


def near_duplicate_classes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row for each row of `documents`: its id, class_id (least id of the class), is_kept (the row's id is the class's)."""
    table, n = document_frequency(documents, text_col, size)
    factor = damped_idf(table, n)
    made = written(sketch(documents, id_col, text_col, factor, size, bands, rows), "sketch")
    worded = made.where("k1 is not null and doc is not null")
    # one node for all texts of the same words; map-side, so that copies are few before they meet
    nodes = written(worded.groupBy("k1", "k2").agg(F.min("doc").alias("node"), F.first("band").alias("band")), "nodes")
    banded = nodes.select(F.col("node").alias("doc"), F.posexplode("band").alias("no", "bucket"))
    met = written(banded.groupBy("no", "bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "met")
    members = written(banded.join(met, ["no", "bucket"]).select("no", "bucket", "leader", "doc").distinct(), "members")
    own = _shared_ids(worded, nodes)
    start = written(members.select("doc").unionByName(own.select(F.col("a").alias("doc"))).unionByName(own.select(F.col("b").alias("doc"))).distinct(), "start")
    sets = shingle_sets(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), start, factor, size)

    tested = written(members.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    links = written(similar(tested, sets, similarity), "links")
    label = components(start.select("doc", F.col("doc").alias("class_id")), links.unionByName(own))

    # buckets whose members are still in several classes
    now = members.join(label, "doc").drop("leader")
    split = written(now.groupBy("no", "bucket").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"), F.count("*").alias("n")).where("x <> y").select("no", "bucket", "n"), "split")
    left = written(now.join(split, ["no", "bucket"]), "left")
    few, many = left.where(F.col("n") <= SMALL_BUCKET), left.where(F.col("n") > SMALL_BUCKET)
    more = similar(_across(few).join(tested, ["a", "b"], "left_anti"), sets, similarity)
    crowd = many.select(F.xxhash64("no", "bucket").alias("group"), "doc", "class_id")
    links = written(more.unionByName(block_links(crowd, sets, similarity)), "links")
    label = components(label, links)

    of_words = nodes.join(label.withColumnRenamed("doc", "node"), "node", "left").select("k1", "k2", F.coalesce("class_id", "node").alias("class_id"))
    # a row without words meets nothing
    with_words = made.where("k1 is not null").select("doc", "k1", "k2").join(written(of_words, "classes"), ["k1", "k2"], "left")
    out = with_words.select("doc", F.coalesce("class_id", "doc").alias("class_id")).unionByName(made.where("k1 is null").select("doc", F.col("doc").alias("class_id")))
    return out.select(F.col("doc").alias(id_col), "class_id", F.coalesce(F.col("doc") == F.col("class_id"), F.lit(False)).alias("is_kept"))


def _shared_ids(worded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that share an id but not their words."""
    several = worded.groupBy("doc").agg(F.min("k1").alias("p"), F.max("k1").alias("q"), F.min("k2").alias("r"), F.max("k2").alias("s")).where("p <> q or r <> s").select("doc")
    rows = written(worded.join(several, "doc", "left_semi").select("doc", "k1", "k2").distinct().join(nodes.drop("band"), ["k1", "k2"]).select("doc", "node"), "ids")
    least = written(rows.groupBy("doc").agg(F.min("node").alias("a")), "ids")
    return written(rows.join(least, "doc").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "ids")


def _across(left: DataFrame) -> DataFrame:
    """Pairs (a < b) of a bucket's members that are in different classes."""
    x = left.select("no", "bucket", F.col("doc").alias("a"), F.col("class_id").alias("p"))
    y = left.select("no", "bucket", F.col("doc").alias("b"), F.col("class_id").alias("q"))
    different: Column = (F.col("a") < F.col("b")) & (F.col("p") != F.col("q"))
    return x.join(y, ["no", "bucket"]).where(different).select("a", "b").distinct()


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of `documents` without the near copies: the row with the least id of each class stays, once.

    Of rows with one id but unlike texts that with the least hash of its text stays (equal hashes: the least text), if none of
    them belongs to the class of a lesser id.
    """
    classes = near_duplicate_classes(documents, id_col, text_col, **options)
    lost = classes.where(~F.col("is_kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rest = documents.join(lost, id_col, "left_anti")
    key, order, row = unused(rest, "key"), F.struct(F.xxhash64(text_col), F.coalesce(text_col, F.lit(""))), F.struct(*[F.col(f"`{c}`") for c in rest.columns])
    first = rest.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.min_by(row, order).alias("row"))
    return rest.where(F.col(id_col).isNull()).unionByName(first.select(*[F.col("row").getField(c).alias(c) for c in rest.columns]))
