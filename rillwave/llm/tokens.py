"""Token-ID output: flat unsigned integer files with 64-bit document offsets, in ascending id order.

Documents are dealt to ranges of doc_id (ties by text, so one id cannot fill a range alone unless its rows are equal), each
range is one shard. A shard is three flat little-endian files in the shared folder:

    shard-NNNNNN-<attempt>.ids  every id of the shard's documents, unsigned, 2 bytes each if the vocabulary fits, else 4
    shard-NNNNNN-<attempt>.off  n + 1 unsigned 64-bit offsets of the documents, counted in ids from the start of the corpus
    shard-NNNNNN-<attempt>.doc  n 64-bit doc_ids (the least value stands for null)

and `index/` is a Parquet table with one row a shard: its number, file names, documents, ids, base, bytes an id. Every
attempt of a task writes files of its own, and the index lists those of the attempt whose result Spark took, so a task that
is run again can neither meet nor spoil another's files. The ids are written first; the shards' totals (one row each) give
every shard its base by a prefix sum, and the offsets are written from it. Readers map the files into memory where the
folder is a mounted one, and read them elsewhere.

White space only parts words for the vocabulary that is the default here, so a text's ids are its words' ids in a row, and
words recur: a task keeps the ids of pieces (words, parted before trailing ASCII punctuation) that it has met, in flat
arrays of bounded size, and the tokenizer encodes only new ones. This way is taken only for a tokenizer whose normalizer,
pre-tokenizer and added tokens are exactly those that it was made for; any other file encodes whole texts.

Defined results: a null or empty text has the end id alone; a null doc_id comes first; rows of equal id follow each other,
ordered by a hash of their text; repeated rows are written each time; a very long text is encoded whole, in memory of its
own size; an empty table has an index without rows and no files; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions, shared_path

END_ID = 2
#: Slots of a task's memory of pieces; it is emptied when two thirds are taken.
MEMORY_BITS = 20
#: Bytes of texts in a shard, about.
SHARD_BYTES = 256 << 20
BATCH_TEXTS = 256
BATCH_PIECES = 20_000
NO_ID = -(1 << 63)

# The outer steps of tokenizers whose texts may be parted at white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Lower-case letters of U+0061 to U+00FF: one code point each in NFC.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write a byte as its own letter where that is printed, and the others as U+0100 and on, in order.
_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_byte = np.arange(256)
_ALPHA = ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A))
#: ASCII punctuation that never belongs to what stands before it; an apostrophe may begin a contraction.
_TAIL = (_byte > 0x20) & (_byte < 0x7F) & ~_ALPHA & ~((_byte >= 0x30) & (_byte <= 0x39)) & (_byte != 0x27)
#: The second byte of the letters U+00C0 to U+00FF, whose first is C3.
_LATIN = (_byte >= 0x80) & (_byte <= 0xBF) & (_byte != 0x97) & (_byte != 0xB7)
_MOST_TAIL = 8


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The file of a public vocabulary, installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_at_spaces(file: dict) -> bool:
    """Whether this tokenizer's ids of a text are its words' ids in a row, and letters part from what follows them."""
    added = file.get("added_tokens") or []
    # names of added tokens are looked for before all else: words that hold their opening are left whole
    named = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return named and file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER and file.get("post_processor") is None and file["model"].get("type") == "BPE" and file["model"].get("dropout") is None


class PieceMemory:
    """Ids of pieces by a 64-bit hash: open addressing in flat arrays."""

    def __init__(self, kind: np.dtype, bits: int = MEMORY_BITS):
        self.shift, self.mask = K.U64(64 - bits), (1 << bits) - 1
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.room = (1 << bits) * 2 // 3
        self.size, self.filled = 0, 0
        self.first = np.zeros(self.room + 1, np.int64)
        self.ids = np.zeros(1 << 16, kind)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for new ones."""
        out = np.full(len(h), -1, np.int32)
        at, live = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(live):
            key = self.key[at[live]]
            hit = key == h[live]
            out[live[hit]] = self.number[at[live[hit]]]
            live = live[~hit & (key != 0)]
            at[live] = (at[live] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take in distinct new pieces; there must be room."""
        at, live = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(live):
            place = at[live]
            free = self.key[place] == 0
            self.key[place[free]] = h[live[free]]  # of several that want a place, the last one has it
            won = free & (self.key[place] == h[live])
            self.number[place[won]] = self.size + live[won]
            live = live[~won]
            at[live] = (at[live] + 1) & self.mask
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(max(len(ids), self.filled), self.ids.dtype)))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.first[self.size + 1 : self.size + 1 + len(h)] = self.filled + np.cumsum(counts)
        self.size += len(h)
        self.filled += len(ids)


class TextEncoder:
    """Ids of whole texts as flat arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_pieces = parts_at_spaces(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.memory = PieceMemory(self.kind)

    def encode_block(self, raw: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, each with the end id, and their numbers."""
        if self.by_pieces:
            return self._by_pieces(raw[offs[0] : offs[-1]], offs - offs[0], end)
        ids, lengths = [], []
        for lo in range(0, len(offs) - 1, BATCH_TEXTS):
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offs[lo:-1][:BATCH_TEXTS], offs[lo + 1 :][:BATCH_TEXTS], strict=True)]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids.append(np.array([*e.ids, end], self.kind))
                lengths.append(len(ids[-1]))
        return np.concatenate(ids) if ids else np.zeros(0, self.kind), np.array(lengths, np.int64)

    def encode(self, text: bytes, end: int) -> bytes:
        """The ids of one text and the end id, as flat bytes."""
        raw = np.frombuffer(text, np.uint8)
        return self.encode_block(raw, np.array([0, len(raw)]), end)[0].tobytes()

    def _by_pieces(self, raw: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        w = K.Words(K.LOWER[raw], offs, K.NOT_SPACE, lower=False)
        whole = self._left_as_it_is(raw, w)
        begin, length, first = pieces(w, whole)
        letters = w.letters if not whole.any() else w.raw[K.NOT_SPACE[w.raw]]
        h = K.run_hashes(letters, length)
        h[h == 0] = 1
        number = self.memory.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            if self.memory.size + len(fresh) > self.memory.room:
                fresh, at = np.unique(h, return_index=True)
                new = np.arange(len(h))
                self.memory = PieceMemory(self.kind, max(MEMORY_BITS, (2 * len(fresh)).bit_length()))
            at = new[at]
            self.memory.add(fresh, *self._learned([w.raw[a : a + n].tobytes() for a, n in zip(begin[at], length[at], strict=True)]))
            number[new] = self.memory.find(h[new])
        start = self.memory.first[number]
        counts = self.memory.first[number + 1] - start
        total = np.concatenate(([0], np.cumsum(counts)))
        n = len(offs) - 1
        last = total[first[1:]] + np.arange(n)  # where each text's end id stands
        out = np.full(int(total[-1]) + n, end, self.kind)
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = self.memory.ids[np.repeat(start - total[:-1], counts) + np.arange(total[-1])]
        return out, total[first[1:]] - total[first[:-1]] + 1

    def _left_as_it_is(self, raw: np.ndarray, w: K.Words) -> np.ndarray:
        """Words that keep their case and are not parted: A-Z may join with a mark that follows (U+0300 to U+037F), and added tokens' names are in lower case alone."""
        odd = (raw == 0xCC) | (raw == 0xCD)
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        whole = np.zeros(len(w), bool)
        if odd.any():
            whole[np.searchsorted(w.starts, np.flatnonzero(odd), side="right") - 1] = True
            for i in np.flatnonzero(whole):
                w.raw[w.starts[i] : w.stops[i]] = raw[w.starts[i] : w.stops[i]]
        return whole

    def _learned(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[list[int]] = []
        rest: list[tuple[int, str]] = []
        tokenize = self.model.tokenize
        for i, t in enumerate(texts):
            text = t.decode()
            if _PLAIN.fullmatch(text):
                # the outer steps leave lower-case Latin letters as they are: the model alone encodes them
                ids.append([x.id for x in tokenize(text if len(t) == len(text) else t.decode("latin-1").translate(_LETTERS))])
            else:
                ids.append([])
                rest.append((i, text))
        for lo in range(0, len(rest), BATCH_PIECES):
            part = rest[lo : lo + BATCH_PIECES]
            for (i, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        return np.array([x for own in ids for x in own], self.kind), np.array([len(x) for x in ids], np.int64)


def pieces(w: K.Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of the pieces of all words, and the first piece of each row (length n + 1).

    A word is parted between a last letter of A-Z, a-z or U+00C0 to U+00FF and ASCII punctuation to its end: neither
    composition nor lower-casing makes one of these letters anything but a letter, so the tokenizer parts them too. After
    any other letter (U+0130 becomes two code points, the second of them a mark) a word stays whole.
    """
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(w.first), np.int64)
    cut = w.stops.copy()
    live = np.flatnonzero(~whole)
    for _ in range(_MOST_TAIL):
        live = live[cut[live] > w.starts[live]]
        live = live[_TAIL[w.raw[cut[live] - 1]]]
        if not len(live):
            break
        cut[live] -= 1
    last = w.raw[np.maximum(cut - 1, 0)]
    before = w.raw[np.maximum(cut - 2, 0)]
    letter = (cut > w.starts) & _ALPHA[last] | (cut > w.starts + 1) & (before == 0xC3) & _LATIN[last]
    two = letter & (cut < w.stops)
    at = np.arange(len(w)) + np.cumsum(two) - two
    n = len(w) + int(two.sum())
    begin, stop = np.empty(n, np.int64), np.empty(n, np.int64)
    begin[at], stop[at] = w.starts, np.where(two, cut, w.stops)
    begin[at[two] + 1], stop[at[two] + 1] = cut[two], w.stops[two]
    return begin, stop - begin, np.append(at, n)[w.first]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One tokenizer for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, data: bytes) -> None:
    fs, path = _open(uri)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read_flat(uri: str, kind: np.dtype) -> np.ndarray:
    """A flat file as an array, memory-mapped where it is a mounted file."""
    fs, path = _open(uri)
    if urlparse(uri).scheme in ("", "file"):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the corpus to `folder`; its index, one row a shard: shard, name, offsets, documents, ids, base, width (bytes an id)."""
    spark = documents.sparkSession
    path = vocabulary or vocabulary_path()
    n = shards or max(partitions(spark), -(-(documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // SHARD_BYTES))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ranged = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").select("id", "text")

    @K.released
    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        first = next(batches, None)
        if first is None:
            return
        coder = encoder(path)
        fs, base = _open(f"{folder}/{name}.ids")
        fs.create_dir(os.path.dirname(base), recursive=True)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        with fs.open_output_stream(base) as out:
            batch = first
            while batch is not None:
                raw, offs = K.text_buffers(batch.column("text"))
                ids.append(batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for lo, hi in K.blocks(offs):
                    coded, length = coder.encode_block(raw, offs[lo : hi + 1], end)
                    lengths.append(length)
                    out.write(coded.tobytes())
                batch = next(batches, None)
        coder.memory = PieceMemory(coder.kind)
        length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        _put(f"{folder}/{name}.doc", np.concatenate(ids).astype("<i8").tobytes())
        _put(f"{folder}/{name}.len", length.astype("<i8").tobytes())
        if len(length):
            row = ((shard, pa.int32()), (name, pa.string()), (len(length), pa.int64()), (int(length.sum()), pa.int64()), (coder.kind.itemsize, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["shard", "name", "documents", "ids", "width"])

    done = sorted(ranged.mapInArrow(write_shard, "shard int, name string, documents long, ids long, width int").collect())  # one row a shard
    base, index = 0, []
    for r in done:
        index.append((r.shard, r.name, None, r.documents, r.ids, base, r.width))
        base += r.ids
    based = spark.createDataFrame(index, "shard int, name string, offsets string, documents long, ids long, base long, width int")

    def write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for name, first in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                length = read_flat(f"{folder}/{name}.len", np.dtype("<i8"))
                own.append(f"{name}-{uuid.uuid4().hex}.off")
                _put(f"{folder}/{own[-1]}", (np.concatenate(([0], np.cumsum(length))) + first).astype("<u8").tobytes())
            yield batch.set_column(batch.schema.get_field_index("offsets"), "offsets", pa.array(own, pa.string()))

    # Spark's writer keeps the rows of one attempt of each task alone
    based.repartition(max(1, min(len(index), n))).mapInArrow(write_offsets, based.schema).write.parquet(f"{folder}/index")
    return spark.read.schema(based.schema).parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as 4-byte little-endian)."""
    index = spark.read.parquet(f"{folder}/index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offsets, base, width in zip(*(batch.column(c).to_pylist() for c in ("name", "offsets", "base", "width")), strict=True):
                ids = read_flat(f"{folder}/{name}.ids", np.dtype(f"<u{width}"))
                off = read_flat(f"{folder}/{offsets}", np.dtype("<u8")).astype(np.int64)
                doc = np.array(read_flat(f"{folder}/{name}.doc", np.dtype("<i8")))
                for lo in range(0, len(doc), 4096):
                    hi = min(lo + 4096, len(doc))
                    cut = off[lo : hi + 1] - base
                    wide = ids[cut[0] : cut[-1]].astype("<u4")
                    cut = cut - cut[0]
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    part = doc[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64(), mask=part == NO_ID), pa.array(off[lo:hi], pa.int64()), pa.array(np.diff(off[lo : hi + 1]), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(index.count(), partitions(spark)))
    return index.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    spark = documents.sparkSession
    folder = shared_path(spark, "tokens")
    write_tokens(documents, folder, id_col, text_col, **options)
    return read_tokens(spark, folder)
