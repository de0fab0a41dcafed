"""Language-model scores from a log-frequency Bloom filter of n-gram counts, beside exact add-0.1 unigram scores.

Counting: each task counts words and pairs of its texts and sends them, packed and pre-aggregated, to hash buckets; a bucket
merges its counts (64 bits) and writes a table of its words and a filter segment. A count c is held as the level
1 + floor(log_b c): the filter has the n-gram at every level up to its own, and reading probes level 1, 2, ... until a probe
fails (Talbot and Osborne 2007). A segment has `BITS` bits an entry, and no word or pair is left out at any size of corpus.

Reading: while all segments have at most `filter_bytes` and the exact counts at most `table_words` entries, both are broadcast;
every Python worker holds a copy, so the bounds are kept low. Beyond them the texts are written in blocks, each block sends its
distinct words and pairs by bucket in one shuffle (one row a block and bucket, so no word, the end token neither, makes a
hot key), and levels and exact counts go back to the block, where its texts are scored. Segments, levels and counts are the
same on both ways, and so are the scores.

Scoring: P(w | u) = (1 - L) P1(w) + L c(u, w) / c(u), for u that training has, with c(u, w) and the counts in P1 from the
filter, P1 smoothed by 0.1 over the sum of such counts, and the exact c(u). All that follows a u adds up to c(u), so nothing is lost: but for the rounding
of levels and the filter's false positives the probabilities of all words and one unknown add up to 1. The end token opens and
closes every text. The base score uses the exact counts. Segments are cut by the bytes of the training texts, so scores depend
on the texts alone, not on partitions or settings.

Defined results: a null or empty text has the end token alone; with nothing to learn from, N and V are 0 and every token has
probability 1; a null doc_id counts as the text '' in the held-out rule; a very long text is counted and scored whole, in
blocks of its own; repeated rows are learned from as often as they occur and get equal scores; equal counts have equal
levels, so ties are equal scores; an empty table gives no rows. Extra columns pass through whatever their names; those named
like a result are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import crc_bucket, numbered, partitions, written

BASE = 1.6
BITS, PROBES = 8, 4
FILTER_BYTES = 16 << 20
TABLE_WORDS = 1 << 20
LAMBDA = 0.3
#: Bytes of training texts for one bucket.
BUCKET_BYTES = 16 << 20
SMOOTH = 0.1
END = K.U64(0x632BE59BD9B4E019)
#: The filter and the pairs use the upper 44 bits of a hash: at 5 * 10^9 n-grams 0.03 % meet another, far under the filter's own errors.
_LOW = K.U64(20)
#: Entries that a task holds before it sends them.
_FLUSH = 3 << 19
#: Bytes of text in a block that asks the segments.
_SENT = 4 << 20
_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("train_tokens", T.LongType())])


def _sequence(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows with their end tokens, the token before each, and the first token of each row (length n + 1)."""
    n = len(w.first) - 1
    seq = np.full(len(w) + n, END, np.uint64)
    seq[np.arange(len(w)) + w.rows()] = w.hashes
    before = np.empty_like(seq)
    if len(seq):
        before[0] = END
        before[1:] = seq[:-1]
    return seq, before, w.first + np.arange(n + 1)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _upper(K.mix(before * K.U64(0xA0761D6478BD642F) + word * K.U64(0xE7037ED1A0B428DB)))


def _upper(h: np.ndarray) -> np.ndarray:
    return h >> _LOW << _LOW


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after one byte that says how many."""
    size = next(k for k in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * k)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _wide(load: pa.Buffer | bytes) -> np.ndarray:
    raw = memoryview(load)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _packed(h: np.ndarray) -> bytes:
    """Sorted upper parts: the first and the steps in four bytes each, or as they are where a step is too large."""
    step = np.diff(h >> _LOW)
    if not len(h) or len(step) and step.max() >> K.U64(32):
        return b"\0" + h.tobytes()
    return b"\1" + h[:1].tobytes() + step.astype("<u4").tobytes()


def _unpacked(load: pa.Buffer | bytes) -> np.ndarray:
    raw = memoryview(load)
    if raw[0] == 0:
        return np.frombuffer(raw, np.uint64, offset=1)
    steps = np.frombuffer(raw, "<u4", offset=9).astype(np.uint64)
    return np.cumsum(np.append(np.frombuffer(raw, np.uint64, 1, 1) >> _LOW, steps), dtype=np.uint64) << _LOW


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> K.U64(32)) * K.U64(n)) >> K.U64(32)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by hash, sorted by hash."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return (h[head], np.add.reduceat(c, head)) if len(h) else (h, c)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The expected count at a level: the middle of its range; 0 at level 0, 1 at level 1."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    return np.where(level <= 0, 0.0, np.where(level == 1, 1.0, (low + np.maximum(low, np.ceil(BASE ** level.astype(float)) - 1)) / 2))


def _probes(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[tuple[int, np.ndarray]]:
    """Bit places of each n-gram at each level, one probe after the other."""
    g = K.mix(h + np.asarray(level).astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))
    step = K.mix(g) | K.U64(1)
    for i in range(PROBES):
        yield i, ((((g + K.U64(i) * step) >> K.U64(32)) * np.asarray(bits).astype(np.uint64)) >> K.U64(32)).astype(np.int64)


def build_segment(h: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter of a whole number of bytes for the n-grams of one bucket."""
    h = _upper(h)
    level = levels_of(counts) if len(counts) else np.zeros(0, np.int64)
    bits = -(-int(level.sum()) * BITS // 8) * 8
    mark = np.zeros(bits, bool)
    entry = np.repeat(np.arange(len(h)), level)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(level) - level, level) + 1
    for _, place in _probes(h[entry], at, bits) if bits else ():
        mark[place] = True
    return np.packbits(mark, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """All segments in a row; a bucket's segment has bits[b] bits from byte start[b]."""

    data: np.ndarray
    start: np.ndarray
    bits: np.ndarray

    def _set(self, start: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (self.data[start + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if not len(self.bits):
            return out
        h = _upper(h)
        bucket = _bucket(h, len(self.bits)).astype(np.int64)
        alive = np.flatnonzero(self.bits[bucket] > 0)
        level = 0
        while len(alive):
            level += 1
            b = bucket[alive]
            ok = np.ones(len(alive), bool)
            for i, place in _probes(h[alive], level, self.bits[b]):
                if i == 0:
                    ok = self._set(self.start[b], place)
                else:  # only what has not failed is probed again
                    left = np.flatnonzero(ok)
                    ok[left] = self._set(self.start[b[left]], place[left])
            alive = alive[ok]
            out[alive] = level
        return out


@dataclass
class Held:
    """The whole model in memory: all segments, and the exact counts of sorted words."""

    segments: LogFrequencyFilter
    words: np.ndarray
    counts: np.ndarray

    def exact(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)

    def word_levels(self, words: np.ndarray) -> np.ndarray:
        return self.segments.levels(words)

    def pair_levels(self, pairs: np.ndarray) -> np.ndarray:
        return self.segments.levels(pairs)


@dataclass
class Answered:
    """What the buckets have answered to one block: levels and exact counts of its sorted words, levels of its sorted pairs."""

    words: np.ndarray
    counts: np.ndarray
    word_level: np.ndarray
    pairs: np.ndarray
    pair_level: np.ndarray

    def exact(self, words: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.words, words)]

    def word_levels(self, words: np.ndarray) -> np.ndarray:
        return self.word_level[np.searchsorted(self.words, words)]

    def pair_levels(self, pairs: np.ndarray) -> np.ndarray:
        return self.pair_level[np.searchsorted(self.pairs, pairs)]


@dataclass
class Model:
    """Totals of the training tokens; `filter` (with the exact counts) is None where it is too large to broadcast."""

    filter: Held | None
    tokens: int
    words: int
    #: The sum of the words' counts as their levels have them.
    mass: float

    def score_texts(self, w: K.Words, found: Held | Answered) -> list[np.ndarray]:
        """n_tokens, n_known, base score and score of each text of a block."""
        seq, before, first = _sequence(w)
        heads = first[:-1]
        n = np.diff(first)
        if not self.tokens:
            return [n, np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))]
        whole = self.tokens + SMOOTH * (self.words + 1)
        known = K.distinct(seq)
        # the opening end token is among the tokens, as every text ends with it
        here, there = np.searchsorted(known, seq), np.searchsorted(known, before)
        exact = found.exact(known)
        base = np.log10((exact + SMOOTH) / whole)
        single = count_of(found.word_levels(known))
        pair = count_of(found.pair_levels(pair_hash(before, seq)))
        p1 = ((single + SMOOTH) / (self.mass + SMOOTH * (self.words + 1)))[here]
        history = exact[there]
        p2 = np.minimum(1.0, pair / np.maximum(history, 1))
        lam = np.where(history > 0, LAMBDA, 0.0)
        score = np.log10((1 - lam) * p1 + lam * p2)
        return [n, np.add.reduceat((exact > 0).astype(np.int64)[here], heads), np.add.reduceat(base[here], heads), np.add.reduceat(score, heads)]


def count_ngrams(train: DataFrame, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row a bucket: bucket, words, tokens, hashes and counts of its words (packed), segment of the filter.

    Buckets are as many as the bytes of the texts ask for, so the work of one doesn't grow with the corpus. Another number of
    buckets would mark other bits and so move scores (false positives), never exact counts.
    """
    n_buckets = buckets or max(64, -(-(train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BUCKET_BYTES))

    @K.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for kind in range(2):
                h, c = _merged(held[kind])
                held[kind].clear()
                cut = np.searchsorted(_bucket(h, n_buckets), np.arange(n_buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cut))
                hashes = [_packed(h[cut[b] : cut[b + 1]]) if kind else h[cut[b] : cut[b + 1]].tobytes() for b in full]
                counts = [_narrow(c[cut[b] : cut[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "kind", "hashes", "counts"])

        for batch in batches:
            raw, offs = K.text_buffers(batch.column(0))
            for lo, hi in K.blocks(offs, 2 << 20):
                seq, before, _ = _sequence(K.Words(raw, offs[lo : hi + 1], K.NOT_SPACE))
                for kind, h in enumerate((seq, pair_hash(before, seq))):
                    held[kind].append(K.distinct(h, counts=True))
                    size += len(held[kind][-1][0])
                if size > _FLUSH:
                    yield from packed()
                    size = 0
        if size:
            yield from packed()

    def merge(table: pa.Table) -> pa.Table:
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for kind, h, c in zip(table.column("kind").to_pylist(), table.column("hashes"), table.column("counts"), strict=True):
            parts[kind].append((_unpacked(h.as_buffer()) if kind else np.frombuffer(h.as_buffer(), np.uint64), _wide(c.as_buffer())))
        word, count = _merged(parts[0])
        pair, times = _merged(parts[1])
        segment = build_segment(np.concatenate((word, pair)), np.concatenate((count, times)))
        mass = float(count_of(levels_of(count)).sum()) if len(count) else 0.0
        row = (table.column("bucket")[0].as_py(), len(word), int(count.sum()), mass, word.tobytes(), _narrow(count), segment)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["bucket", "words", "tokens", "mass", "hashes", "counts", "segment"])

    sent = train.select(text_col).mapInArrow(count, "bucket int, kind int, hashes binary, counts binary")
    return written(sent.groupBy("bucket").applyInArrow(merge, "bucket int, words long, tokens long, mass double, hashes binary, counts binary, segment binary"), "ngrams").withColumn("buckets", F.lit(n_buckets))


def load_model(ngrams: DataFrame, filter_bytes: int = FILTER_BYTES, table_words: int = TABLE_WORDS) -> Model:
    """The totals, and the filter with the exact counts where they have at most filter_bytes and table_words entries."""
    total = ngrams.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), F.sum("mass").alias("mass"), F.sum(F.length("segment")).alias("size")).first()
    empty = np.zeros(0, np.int64)
    if total.tokens is None:
        return Model(Held(LogFrequencyFilter(np.zeros(0, np.uint8), empty, empty), np.zeros(0, np.uint64), empty), 0, 0, 0.0)
    if total.size > filter_bytes or total.words > table_words:
        return Model(None, total.tokens, total.words, total.mass)
    rows = sorted(ngrams.select("bucket", "segment", "buckets", "hashes", "counts").collect(), key=lambda r: r.bucket)  # bounded just now
    size = np.zeros(rows[0].buckets, np.int64)
    for r in rows:
        size[r.bucket] = len(r.segment)
    data = np.frombuffer(b"".join(r.segment for r in rows), np.uint8)
    # buckets are ranges of hashes, so their words are in order
    words, counts = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows]), np.concatenate([_wide(r.counts) for r in rows])
    return Model(Held(LogFrequencyFilter(data, np.cumsum(size) - size, size * 8), words, counts), total.tokens, total.words, total.mass)


def _ngrams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct words, and pairs, of a block of texts."""
    raw, offs = K.text_buffers(column)
    words, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi in K.blocks(offs):
        seq, before, _ = _sequence(K.Words(raw, offs[lo : hi + 1], K.NOT_SPACE))
        words.append(K.distinct(seq))
        pairs.append(K.distinct(pair_hash(before, seq)))
    return K.distinct(np.concatenate(words)), K.distinct(np.concatenate(pairs))


_ASK = "block string, kind int, bucket int, load binary, words binary, counts binary"
_ASK_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_ASK_KINDS)], names=["block", "kind", "bucket", "load", "words", "counts"])


def looked_up(read: DataFrame, ngrams: DataFrame, text_col: str) -> DataFrame:
    """The texts of `read` in blocks (kind 1; load: an Arrow stream) after the buckets' answers to their words and pairs (kind 0; load: levels of words and pairs, counts: of words), in partitions sorted so."""
    n_buckets = ngrams.select("buckets").first().buckets

    @K.released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return _rows([(uuid.uuid4().hex, 1, -1, sink.getvalue().to_pybytes(), None, None)])

        for batch in batches:
            _, offs = K.text_buffers(batch.column(text_col))
            for lo, hi in K.blocks(offs, _SENT):
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                if size >= _SENT:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    @K.released
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, load in zip(batch.column("block"), batch.column("load"), strict=True):
                words, pairs = _ngrams_of(pa.ipc.open_stream(load.as_buffer()).read_all().column(text_col))
                edges = np.arange(n_buckets + 1, dtype=np.uint64)
                w, p = np.searchsorted(_bucket(words, n_buckets), edges), np.searchsorted(_bucket(pairs, n_buckets), edges)
                some = np.flatnonzero(np.diff(w) + np.diff(p))
                yield _rows([(block.as_py(), 1, int(b), _packed(pairs[p[b] : p[b + 1]]), words[w[b] : w[b + 1]].tobytes(), None) for b in some])

    @K.released
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        nothing = Held(LogFrequencyFilter(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)), none, np.zeros(0, np.int64))
        at, own = -1, nothing
        for batch in batches:
            rows: list[tuple] = []
            for block, kind, bucket, load, words, counts in zip(*(batch.column(c) for c in ("block", "kind", "bucket", "load", "words", "counts")), strict=True):
                b = bucket.as_py()
                if not kind.as_py():
                    segment = load.as_py()
                    one = LogFrequencyFilter(np.frombuffer(segment, np.uint8), np.zeros(1, np.int64), np.array([len(segment) * 8]))
                    at, own = b, Held(one, np.frombuffer(words.as_py(), np.uint64), _wide(counts.as_py()))
                    continue
                found = own if at == b else nothing
                asked, pairs = np.frombuffer(words.as_buffer(), np.uint64), _unpacked(load.as_buffer())
                level = np.concatenate((found.word_levels(asked), found.pair_levels(pairs))).astype(np.uint8)
                rows.append((block.as_py(), 0, b, level.tobytes(), None, _narrow(found.exact(asked))))
            yield _rows(rows)

    blocks = written(read.mapInArrow(pack, _ASK), "texts")
    asked = blocks.select("block", "load").mapInArrow(ask, _ASK)
    segments = ngrams.select(F.lit("").alias("block"), F.lit(0).alias("kind"), "bucket", F.col("segment").alias("load"), F.col("hashes").alias("words"), "counts")
    answers = segments.unionByName(asked).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, _ASK)
    # a task scores about eight blocks
    return answers.unionByName(blocks).repartition(max(partitions(read.sparkSession), blocks.count() // 8), "block").sortWithinPartitions("block", "kind", "bucket")


def score_texts(documents: DataFrame, train: DataFrame, text_col: str = "text", keep: list[str] | None = None, filter_bytes: int = FILTER_BYTES, table_words: int = TABLE_WORDS) -> DataFrame:
    """Rows of `documents` (columns in `keep`, or all) with n_tokens, n_known, train_tokens, base_score and score; learned from `train`."""
    spark = documents.sparkSession
    ngrams = count_ngrams(train, text_col)
    model = load_model(ngrams, filter_bytes, table_words)
    sent = spark.sparkContext.broadcast(model)
    columns = [c for c in documents.columns if c not in _RESULT.fieldNames() and (keep is None or c in keep)]
    names = [*columns, *([] if text_col in columns else [text_col])]
    read, text = numbered(documents, names), f"c{names.index(text_col)}"
    schema = T.StructType([*(documents.schema[c] for c in columns), *_RESULT.fields])

    def scored_batch(batch: pa.RecordBatch, found: Held | Answered) -> pa.RecordBatch:
        raw, offs = K.text_buffers(batch.column(text))
        parts = [sent.value.score_texts(K.Words(raw, offs[lo : hi + 1], K.NOT_SPACE), found) for lo, hi in K.blocks(offs)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        made = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0), kind) for i, kind in enumerate(kinds)]
        made.append(pa.array(np.full(batch.num_rows, sent.value.tokens, np.int64)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *made], names=[*columns, *_RESULT.fieldNames()])

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scored_batch(batch, sent.value.filter)

    @K.released
    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for kind, load, count in zip(batch.column("kind"), batch.column("load"), batch.column("counts"), strict=True):
                if not kind.as_py():
                    levels.append(np.frombuffer(load.as_py(), np.uint8))
                    counts.append(_wide(count.as_py()))
                    continue
                texts = pa.ipc.open_stream(load.as_buffer()).read_all().combine_chunks()
                words, pairs = _ngrams_of(texts.column(text))
                cut = [len(c) for c in counts]  # a bucket answers for its words, then for its pairs
                word_level = np.concatenate([x[:k] for x, k in zip(levels, cut, strict=True)])
                pair_level = np.concatenate([x[k:] for x, k in zip(levels, cut, strict=True)])
                found = Answered(words, np.concatenate(counts), word_level, pairs, pair_level)
                levels, counts = [], []
                for part in texts.to_batches():
                    yield scored_batch(part, found)

    return read.mapInArrow(run, schema) if model.filter is not None else looked_up(read, ngrams, text).mapInArrow(run_blocks, schema)


def split(documents: DataFrame, modulus: int = 10, held_out: int = 0, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """documents with held_out, and the rows to learn from."""
    marked = documents.withColumn("held_out", crc_bucket(id_col, modulus) == held_out)
    return marked, marked.where(~F.col("held_out"))
