"""Source divergence: how far the word use of each source lies from the other sources of its language, and by which words.

Every term is qualified by its document's language (lang, NUL, term), so one CountVectorizer with minDF and the greatest
vocabSize is one per language: a qualified term's document frequency is its frequency within the language. Its sparse
vectors hold exact counts; they are summed by (lang, source) term by term, as a Summarizer would sum them but without a
dense buffer a group. Shares are whole numbers, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals of 38 digits.

A fitted vocabulary lies on the driver and on every executor, so it must be bounded: terms are dealt by hash to rounds of
about `VOCABULARY` kept terms, each round fits and counts its own. The number of rounds comes from the exact document
frequencies of 1 in `PROBE` of the terms, over all documents, and changes no result.

Pairs of sources are compared sparsely. With b the share of an absent term, a pair's sum over all V terms is V |b_g - b_h|
plus a correction at the terms that g or h has. Corrections are added up by (block of terms, tile of sources against tile),
so a task holds one block of two tiles whatever the number of terms and sources.

Defined results: a null text, lang or source is ''; an empty text has no terms, and its group is listed; a very long text is
counted whole; repeated rows count each; equal values are ranked by the item's UTF-8 bytes; a language without kept terms
has pairs of value 0; a source that is alone has no pairs; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

MIN_DF, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Kept terms of one round, about; terms whose exact frequencies say how many rounds there are: one in so many.
VOCABULARY, PROBE = 1 << 20, 64
#: Terms of a block, sources of a tile.
BLOCK, TILE = 8192, 128
#: Bytes of texts cut into terms at a time.
SLICE = 1 << 22
#: Cells of document vectors that a task adds up before it sends the sums.
HELD = 1 << 22
#: A term that no text can hold: without it a corpus of no frequent terms could not be fitted.
_NONE = "\x00"
_IS_TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _probed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One in about `PROBE` terms, by their length and four of their bytes."""
    last = starts + lengths - 1
    mixed = lengths.astype(np.uint32)
    for at in (starts, last, starts + lengths // 2, starts + lengths // 3):
        mixed = (mixed ^ data[at]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed % np.uint32(PROBE) == 0


def qualified_terms(langs: pa.StringArray, texts: pa.StringArray) -> tuple[pa.ListArray, pa.ListArray]:
    """The terms of each text behind its language, and those of them that are probed."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    on = _IS_TERM[raw]
    opens = on.copy()
    opens[1:] &= ~on[:-1]
    borders = offsets[:-1][offsets[:-1] < len(raw)]
    opens[borders] = on[borders]
    data = _LOWER[raw[on]]
    starts = np.flatnonzero(opens[on])
    lengths = np.diff(np.append(starts, len(data)))
    counts = np.concatenate(([0], np.cumsum(opens)))[offsets]
    bounds = np.append(starts, len(data)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    row = np.repeat(np.arange(len(texts)), np.diff(counts))
    full = pc.binary_join_element_wise(langs.take(pa.array(row)), terms, "\x00")
    chosen = _probed(data, starts, lengths)
    probes = np.concatenate(([0], np.cumsum(chosen)))[counts]
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), full), pa.ListArray.from_arrays(pa.array(probes, pa.int32()), full.filter(pa.array(chosen)))


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield a, b - a
        a = b


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, n in _slices(batch.column("text")):
            part = batch.slice(a, n)
            terms, probe = qualified_terms(part.column("lang"), part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), terms, probe], names=["lang", "source", "terms", "probe"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each (lang, source), `HELD` cells at a time."""
    held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), parts in held.items():
            term, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            if len(term) * 8 < (top := int(term.max(initial=-1)) + 1):
                own, place = np.unique(term, return_inverse=True)
                sums = np.bincount(place, n, len(own))
            else:
                sums = np.bincount(term, n, top)
                own = np.flatnonzero(sums)
                sums = sums[own]
            names = [pa.DictionaryArray.from_arrays(np.zeros(len(own), np.int32), pa.array([k], pa.string())).dictionary_decode() for k in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(own, pa.int32()), pa.array(sums.astype(float))], names=["lang", "source", "term", "n"])
        held.clear()

    for batch in batches:
        terms, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
        ends = np.cumsum(pc.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False))
        begin = 0
        for key, end in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True), ends.tolist(), strict=True):
            held.setdefault(key, []).append((terms[begin:end], values[begin:end]))
            begin = end
        size += len(terms)
        if size > HELD:
            yield from flush()
            size = 0
    yield from flush()


def _counts(cut: DataFrame, rounds: int, k: int, min_df: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the kept terms of one round, and (term, name) of its vocabulary."""
    spark = cut.sparkSession
    own = cut if rounds == 1 else cut.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(rounds)) == k))
    never = spark.range(min_df).select(F.array(F.lit(_NONE)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(min_df), vocabSize=2**31 - 1).fit(own.select("terms").unionByName(never))
    vectors = model.transform(own).select("lang", "source", F.unwrap_udt("counts").alias("v")).select("lang", "source", "v.indices", "v.values")
    cells = vectors.mapInArrow(_summed, "lang string, source string, term int, n double")
    base = k << 32
    summed = cells.groupBy("lang", "source", "term").agg(F.sum("n").cast("long").alias("n")).withColumn("term", F.col("term").cast("long") + base)
    words = model.vocabulary  # about VOCABULARY terms
    names = spark.createDataFrame(pa.table({"term": pa.array(np.arange(len(words)) + base), "name": pa.array(words, pa.string())}))
    return written(summed, "counts"), written(names.select("term", F.substring_index("name", "\x00", -1).alias("name")), "vocabulary")


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH size)), null where nothing is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    below = F.nullif(wide(total + SMOOTH * size), F.lit(0))
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH), below).cast("long") + 1


def pair_sums(source: np.ndarray, term: np.ndarray, share: np.ndarray, left: int, right: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrections of a block for each pair of a source of tile `left` and a later one of tile `right`; rows with term -1 hold a source's share of absent terms."""
    own = term < 0
    order = np.argsort(source[own])
    known, base = source[own][order], share[own][order]
    at = np.searchsorted(known, source[~own])
    by = np.argsort(at, kind="stable")
    at, value = at[by], share[~own][by]
    _, place = np.unique(term[~own][by], return_inverse=True)
    cuts = np.searchsorted(at, np.arange(len(known) + 1))
    out = []
    dense = np.empty(place.max() + 1 if len(place) else 0, np.int64)
    for g in np.flatnonzero(known // tile == left):
        later = np.flatnonzero((known // tile == right) & (known > known[g]))
        if not len(later):
            continue
        mine = slice(cuts[g], cuts[g + 1])
        ranked = np.sort(value[mine])
        sums = np.concatenate(([0], np.cumsum(ranked)))
        b = base[later]
        under = np.searchsorted(ranked, b)
        apart = b * under - sums[under] + sums[-1] - sums[under] - b * (len(ranked) - under)
        first = apart - len(ranked) * np.abs(base[g] - b)
        dense[:] = base[g]
        dense[place[mine]] = value[mine]
        cells = slice(cuts[later[0]], cuts[later[-1] + 1])
        there = dense[place[cells]]
        moved = np.concatenate(([0], np.cumsum(np.abs(there - value[cells]) - np.abs(there - base[at[cells]]))))
        second = moved[cuts[later + 1] - cuts[later[0]]] - moved[cuts[later] - cuts[later[0]]]
        out.append((np.full(len(later), known[g]), known[later], first + second))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language. groups: (lang, source, g, tiles, base, size); cells: (lang, g, tiles, term, share)."""
    block = (F.shiftright("term", 32) * F.lit((1 << 32) // BLOCK) + F.floor((F.col("term") % F.lit(1 << 32)) / BLOCK)).cast("long").alias("block")
    kept = cells.select("lang", block, "g", "tiles", "term", "share")
    absent = kept.select("lang", "block").distinct().join(groups, "lang").select("lang", "block", "g", "tiles", F.lit(-1).cast("long").alias("term"), F.col("base").alias("share"))
    mine = F.floor(F.col("g") / TILE).cast("int")
    dealt = kept.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "block", "g", "term", "share", F.least(mine, "other").alias("left"), F.greatest(mine, "other").alias("right"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        lang, _, left, right = (k.as_py() for k in key)
        a, b, v = pair_sums(*(t.column(c).to_numpy() for c in ("g", "term", "share")), left, right)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "v": pa.array(v, pa.int64())})

    found = dealt.groupBy("lang", "block", "left", "right").applyInArrow(compare, "lang string, a long, b long, v long").groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    one = groups.select("lang", "source", F.col("g").alias("g1"), F.col("base").alias("b1"), "size")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("g2"), F.col("base").alias("b2"))
    pairs = one.join(two, "lang").where("g1 <> g2").withColumns({"a": F.least("g1", "g2"), "b": F.greatest("g1", "g2")})
    return pairs.join(found, ["lang", "a", "b"], "left").select("lang", "source", "item", (F.coalesce("v", F.lit(0)) + F.coalesce(F.col("size") * F.abs(F.col("b1") - F.col("b2")), F.lit(0))).alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = MIN_DF, top: int = TOP, rounds: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the distance to each other source, part `term` the terms that the source uses more than its language."""
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    cut = written(texts.mapInArrow(_cut, "lang string, source string, terms array<string>, probe array<string>"), "terms")
    if rounds is None:
        probes = cut.select(F.explode(F.array_distinct("probe")).alias("t")).groupBy("t").count().where(F.col("count") >= min_df).count()
        rounds = max(1, -(-probes * PROBE // VOCABULARY))
    parts = [_counts(cut, rounds, k, min_df) for k in range(rounds)]
    counts, names = parts[0]
    for c, v in parts[1:]:
        counts, names = counts.unionByName(c), names.unionByName(v)
    whole = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "language")
    langs = whole.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = Window.partitionBy("lang").orderBy("source")
    every = cut.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "size"])
    every = every.withColumns({"g": (F.row_number().over(number) - 1).cast("long"), "tiles": F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int"), "base": _share(F.lit(0), F.col("total"), F.col("size"))})
    groups = written(every, "groups")
    cells = counts.join(groups, ["lang", "source"]).withColumn("share", _share(F.col("n"), F.col("total"), F.col("size")))
    pairs = _pairs(groups, cells)
    more = cells.join(whole, ["lang", "term"]).withColumn("value", F.col("share") - _share(F.col("lang_n"), F.col("lang_total"), F.col("size"))).where("value > 0")
    named = more.join(names, "term").select("lang", "source", F.col("name").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumns({"part": F.lit("pair"), "rank": place}).unionByName(named.withColumns({"part": F.lit("term"), "rank": place}).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
