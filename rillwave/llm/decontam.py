"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into item-sized windows (ten consecutive words; a shorter item is one window). The tokens of a
window are its shingles of two neighbouring words (a one-word window: that word). Tokens are ordered by rarity, counted over
the whole corpus; as a window must be contained whole, its one rarest token is a sufficient prefix. Document tokens are
joined with the prefix tokens, the token's place in the window gives the only possible start, length and position bounds
drop what would leave the text, and the words are compared exactly.

The prefix index is broadcast only up to `index_bytes`; a larger benchmark is taken in blocks of that size, one scan each,
and the blocks' results are merged by key, so no item is dropped at any size. Tokens of a very common passage meet one index
entry for each distinct window, whatever the number of items that hold it.

Defined results: a null or empty text has no words; a null or empty item has no window; equal items all count; items with a
null item_id are left out; a very long text is one row of a block of its own and scanned whole; repeated rows get equal
results; of equally rare tokens of a window the first is its prefix; an empty table gives no rows, and an empty benchmark no
hits; extra columns pass through whatever their names, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import written

WINDOW = 10
INDEX_BYTES = 64 << 20
_FILTER_BITS = 20
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def _tokens(h: np.ndarray) -> np.ndarray:
    """Token i: words i and i + 1 in order. The last word's own token is meaningless."""
    out = h * K.U64(0x9FB21C651E98DF25)
    out[:-1] += h[1:] * K.U64(0xA24BAED4963EE407)
    return K.mix(out)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: words (joined by a space), hashes (8 bytes a word), items (sorted ids as text)."""

    @K.released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column("_text"))
            items, words, hashes = [], [], []
            for lo, hi in K.blocks(offs):
                w = K.Words(raw, offs[lo : hi + 1], K.ALNUM)
                text = [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.stops, strict=True)]
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    for s in range(a, max(b - size, a) + 1 if b > a else a):
                        e = min(s + size, b)
                        items.append(batch.column("_item")[lo + i].as_py())
                        words.append(" ".join(text[s:e]))
                        hashes.append(w.hashes[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.string()), pa.array(hashes, pa.binary())], names=["item", "words", "hashes"])

    picked = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("_item"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(cut, "item string, words string, hashes binary").groupBy("words", "hashes").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(keys >> K.U64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return bits


def _among(tokens: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that are among the sorted keys, and which key each is."""
    at = np.flatnonzero(bits[(tokens >> K.U64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at) or not len(keys):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(keys, tokens[at]), len(keys) - 1)
    hit = keys[k] == tokens[at]
    return at[hit], k[hit]


def token_counts(documents: DataFrame, text_col: str, keys: np.ndarray) -> np.ndarray:
    """How often each of the sorted two-word tokens occurs in all documents."""
    sent = documents.sparkSession.sparkContext.broadcast(keys)

    @K.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        bits, total = _bitmap(own), np.zeros(len(own), np.int64)
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(0))
            for lo, hi in K.blocks(offs):
                w = K.Words(raw, offs[lo : hi + 1], K.ALNUM)
                token = _tokens(w.hashes)
                last = w.first[1:][w.counts > 0] - 1
                inner = np.ones(len(token), bool)
                inner[last] = False
                total += np.bincount(_among(token[inner], own, bits)[1], minlength=len(own))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["k", "n"])

    out = np.zeros(len(keys), np.int64)
    # as many rows as the block of the benchmark has tokens
    for row in documents.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[row.k] = row.n
    return out


@dataclass
class Index:
    """Sorted prefix tokens (of pairs, of single words); entry[k] to entry[k + 1] are their (window, place) entries."""

    keys: list[np.ndarray]
    entry: list[np.ndarray]
    window: list[np.ndarray]
    place: list[np.ndarray]
    hashes: np.ndarray
    length: np.ndarray
    words: list[bytes]
    items: list[list[str]]


def build_index(rows: list, counts: dict[int, int], size: int) -> Index:
    length = np.array([len(r.hashes) // 8 for r in rows], np.int64)
    hashes = np.zeros((len(rows), size), np.uint64)
    kinds: list[list[tuple[int, int, int]]] = [[], []]
    for i, r in enumerate(rows):
        h = np.frombuffer(r.hashes, np.uint64)
        hashes[i, : len(h)] = h
        if len(h) == 1:
            kinds[1].append((int(h[0]), i, 0))
        else:
            token = _tokens(h.copy())[:-1].tolist()
            place = min(range(len(token)), key=lambda p: (counts.get(token[p], 0), p))
            kinds[0].append((token[place], i, place))
    keys, entry, window, place = [], [], [], []
    for kind in kinds:
        kind.sort()
        col = np.array([k for k, _, _ in kind], np.uint64)
        own, times = K.distinct(col, counts=True)
        keys.append(own)
        entry.append(np.concatenate(([0], np.cumsum(times))))
        window.append(np.array([w for _, w, _ in kind], np.int64))
        place.append(np.array([p for _, _, p in kind], np.int64))
    return Index(keys, entry, window, place, hashes, length, [r.words.encode() for r in rows], [list(r.items) for r in rows])


def occurrences(w: K.Words, index: Index, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every exact occurrence in a block of texts."""
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, which = [], []
    for kind, tokens in enumerate((_tokens(w.hashes), w.hashes)):
        if not len(index.keys[kind]):
            continue
        at, k = _among(tokens, index.keys[kind], bits[kind])
        times = index.entry[kind][k + 1] - index.entry[kind][k]
        e = np.repeat(index.entry[kind][k] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        win = index.window[kind][e]
        start = np.repeat(at, times) - index.place[kind][e]
        row = np.repeat(np.searchsorted(w.first, at, side="right") - 1, times)
        fits = (start >= w.first[row]) & (start + index.length[win] <= w.first[row + 1])
        start, win = start[fits], win[fits]
        same = np.ones(len(start), bool)
        for j in range(index.hashes.shape[1]):
            inside = index.length[win] > j
            same &= ~inside | (w.hashes[np.minimum(start + j, len(w) - 1)] == index.hashes[win, j])
        begin.append(start[same])
        which.append(win[same])
    start, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, which))
    exact = [b" ".join(w.raw[w.starts[s + j] : w.stops[s + j]].tobytes() for j in range(index.length[k])) == index.words[k] for s, k in zip(start, win, strict=True)]
    keep = np.array(exact, bool)
    return start[keep], win[keep]


def _summary(n_words: int, covered: int, items: list[str]) -> tuple:
    return n_words, covered, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), covered > 0


def _scan(documents: DataFrame, text_col: str, columns: list[str], index: Index, spans: bool) -> DataFrame:
    """With spans False the final columns of every row; with True, for rows that are hit, their spans and items."""
    sent = documents.sparkSession.sparkContext.broadcast(index)
    fields = [documents.schema[c] for c in columns]
    extra = T.StructType.fromDDL("_n bigint, _from array<bigint>, _to array<bigint>, _items array<string>") if spans else RESULT
    read = documents.select(*columns, *([] if text_col in columns else [text_col]))

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        bits = [_bitmap(k) for k in own.keys]
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(text_col))
            out: list[tuple] = []
            took: list[int] = []
            for lo, hi in K.blocks(offs):
                w = K.Words(raw, offs[lo : hi + 1], K.ALNUM)
                start, win = occurrences(w, own, bits)
                row = np.searchsorted(w.first, start, side="right") - 1
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + own.length[win], -1)
                total = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
                covered = total[w.first[1:]] - total[w.first[:-1]]
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
                for i in np.flatnonzero(covered) if spans else range(hi - lo):
                    mine = order[cut[i] : cut[i + 1]]
                    items = sorted({x for k in win[mine] for x in own.items[k]}) if len(mine) else []
                    n = int(w.first[i + 1] - w.first[i])
                    if spans:
                        a = start[mine] - w.first[i]
                        out.append((n, a.tolist(), (a + own.length[win[mine]]).tolist(), items))
                        took.append(lo + int(i))
                    else:
                        out.append(_summary(n, int(covered[i]), items))
            kept = batch.take(pa.array(took, pa.int64())) if spans else batch
            cols = list(zip(*out, strict=True)) if out else [[] for _ in extra.fields]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string())] if spans else [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*columns, *extra.fieldNames()])

    return read.mapInArrow(run, T.StructType([*fields, *extra.fields]))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, index_bytes: int = INDEX_BYTES, result_prefix: str = "") -> DataFrame:
    """The rows of `documents` (all columns, or those in `keep`) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    given = documents.columns
    columns = [f"c{i}" for i, c in enumerate(given) if c not in [result_prefix + r for r in RESULT.fieldNames()] and (keep is None or c in keep)]
    # columns go by number inside, so that no name of theirs can meet ours
    found = _found(documents.toDF(*[f"c{i}" for i in range(len(given))]), f"c{given.index(text_col)}", columns, benchmark, window, index_bytes)
    return found.select(*[F.col(c).alias(given[int(c[1:])]) for c in columns], *[F.col(r).alias(result_prefix + r) for r in RESULT.fieldNames()])


def _found(documents: DataFrame, text_col: str, columns: list[str], benchmark: DataFrame, window: int, index_bytes: int) -> DataFrame:
    """The given columns of `documents` with the results."""
    wins = written(windows(benchmark, size=window), "windows")
    room = wins.agg(F.coalesce(F.sum(F.octet_length("words") + 3 * F.octet_length("hashes") + 32 * F.size("items") + 100), F.lit(0)).alias("b")).first().b
    n_blocks = max(1, -(-int(room) // index_bytes))
    part = F.pmod(F.xxhash64("words"), F.lit(n_blocks))

    def index_of(block: int) -> Index:
        rows = sorted(wins.where(part == block).collect(), key=lambda r: r.words)  # about index_bytes at most
        pairs = [_tokens(np.frombuffer(r.hashes, np.uint64).copy())[:-1] for r in rows if len(r.hashes) > 8]
        keys = K.distinct(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        counts = dict(zip(keys.tolist(), token_counts(documents, text_col, keys).tolist(), strict=True)) if len(keys) else {}
        return build_index(rows, counts, window)

    if n_blocks == 1:
        return _scan(documents, text_col, columns, index_of(0), spans=False)

    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = documents.select(text_col, digest.alias("key"))
    found = None
    for block in range(n_blocks):
        hits = written(_scan(keyed, text_col, ["key"], index_of(block), spans=True).dropDuplicates(["key"]), "hits")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("key").agg(
        F.max("_n").alias("_n"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_from", "_to")))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
    )
    # spans come sorted by their start: each adds what lies beyond the furthest end so far
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("_spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["_to"] - F.greatest(s["end"], x["_from"]))).alias("n"), F.greatest(s["end"], x["_to"]).alias("end")))["n"]
    merged = merged.select("key", covered.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    empty = Index([np.zeros(0, np.uint64)] * 2, [np.zeros(1, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros((0, window), np.uint64), np.zeros(0, np.int64), [], [])
    counted = _scan(documents.withColumn("key", digest), text_col, [*columns, "key"], empty, spans=False)
    return (
        counted.drop("n_hit", "n_items", "items_sha256", "contaminated")
        .join(merged, "key", "left")
        .select(*columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
    )
