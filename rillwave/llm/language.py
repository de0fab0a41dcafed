"""Language identification by cross-parsing: how few phrases of a language's labelled text make up a text.

Labelled windows of each language, drawn by hash from distinct texts, are joined into one string and read into a suffix
automaton. A text is parsed greedily against it: each phrase is the longest match with any part of that string, and a
letter that the language lacks ends a phrase (Ziv and Merhav 1993). The normalised number of phrases is their number times
log2 of the automaton's string length, per character; the language with the least wins.

Characters are letters in lower case; anything between letters is one space. The `OWN - 1` commonest letters of the windows
have symbols of their own, other letters share the rest by code point. The automata are tables of (state, symbol), where
a missing move leads where its phrase's successor begins, so parsing is one lookup a character; all blocks of `STEPS` characters
of a slice of texts go through all languages together. A new block begins a new phrase, in each language alike.

Bounds: at most `TEXTS` texts a language give windows, and automata have at most `CHARS` characters together (fewer each with
many languages), so what is collected and broadcast never exceeds 2 * `CHARS` states of `SYMBOLS` moves (256 MB; 12 MB here).

Defined results: a null text and one without letters is `und` with score 0, as is every text where nothing was learned; very
long texts are parsed whole; equal texts get equal results, ties go to the language first by code point; with one language
learned every text with a letter is of it, score 1; repeated texts are learned from once; a null lang isn't learned from,
an empty one is a language; a null doc_id counts as the text '' in the held-out rule; an empty table gives no rows. Extra
columns pass through whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_bucket

TEXTS = 256
#: Parts of the hashes in which a sample is drawn first.
PARTS = 64
#: Characters of one automaton, and of all together.
EACH, CHARS = 1 << 14, 1 << 19
SYMBOLS, OWN = 64, 48
STEPS = 1024
#: Bytes of texts parsed at a time.
SLICE = 1 << 22
UNKNOWN = "und"
RESULT = ("lang_pred", "score")


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower case of each letter by code point, 0 for what is none."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automata:
    """Suffix automata of each language's string as one table of moves, with the symbols of all letters."""

    def __init__(self, strings: dict[str, list[str]], each: int = EACH):
        self.langs = sorted(strings)
        folded = {k: [_letters()[_points(t)] for t in v] for k, v in strings.items()}
        seen = Counter()
        for v in folded.values():
            for points in v:
                seen.update(dict(zip(*(x.tolist() for x in np.unique(points[points > 0], return_counts=True)), strict=True)))
        own = sorted(seen, key=lambda p: (-seen[p], p))[: OWN - 1]
        self.own = np.array(sorted(own), np.uint32)
        self.rank = np.array([own.index(p) + 1 for p in sorted(own)], np.uint8)
        tables, self.roots, self.costs, base = [], [], [], 0
        for k in self.langs:
            string = squeezed(np.concatenate([self.symbols(p) for p in folded[k]] or [np.zeros(0, np.uint8)]))[:each]
            moves = suffix_automaton(string.tolist())
            table = np.full((len(moves), SYMBOLS), -1, np.int32)
            for s, m in enumerate(moves):
                for c, t in m.items():
                    table[s, c] = t
            # a missing move ends the phrase (bit 0) and goes on from the root
            again = np.where(table[0] >= 0, table[0], 0)
            table = np.where(table >= 0, (table + base) * SYMBOLS * 2, (again + base) * SYMBOLS * 2 + 1)
            tables.append(table.astype(np.int32).ravel())
            self.roots.append(base * SYMBOLS)
            self.costs.append(math.log2(len(string) + 2))
            base += len(moves)
        self.moves = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def symbols(self, folded: np.ndarray) -> np.ndarray:
        """0 for no letter, own symbols of common letters, shared ones of others. folded: lower-case code points or 0."""
        out = np.where(folded > 0, OWN + folded % (SYMBOLS - OWN), 0).astype(np.uint8)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, folded), len(self.own) - 1)
            known = self.own[at] == folded
            out[known] = self.rank[at[known]]
        return out

    def table(self) -> np.ndarray:
        """Symbols of all code points."""
        return self.symbols(_letters())


def squeezed(symbols: np.ndarray) -> np.ndarray:
    """One 0 between letters, none at the start."""
    gap = symbols == 0
    drop = gap.copy()
    drop[1:] &= gap[:-1]
    return symbols[~drop]


def suffix_automaton(string: list[int]) -> list[dict[int, int]]:
    """The moves of each state of the smallest automaton of all factors; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in string:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def phrases(own: Automata, symbol_of: np.ndarray, texts: list[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language (texts by languages), and its number of characters after folding; 0: no letter."""
    sizes = np.array([len(t) for t in texts])
    symbols = symbol_of[_points("".join(texts))]
    row = np.repeat(np.arange(len(texts)), sizes)
    gap = symbols == 0
    drop = gap.copy()
    drop[1:] &= gap[:-1] | (row[1:] != row[:-1])
    symbols, row = symbols[~drop], row[~drop]
    counts = np.bincount(row, minlength=len(texts))
    starts = np.concatenate(([0], np.cumsum(counts)))
    pieces = -(-counts // steps)
    first = np.concatenate(([0], np.cumsum(pieces)))
    place = np.arange(len(symbols)) - starts[row]
    piece = first[row] + place // steps
    lengths = np.bincount(piece, minlength=first[-1])
    order = np.argsort(-lengths, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    block = np.zeros((min(steps, int(lengths.max(initial=0))), len(order)), np.int32)
    block[place % steps, column[piece]] = symbols
    live = np.searchsorted(-lengths[order], -np.arange(len(block)), "left")  # blocks longer than t
    state = np.repeat(np.array(own.roots, np.int32)[:, None], len(order), 1)
    ended = np.ones((len(own.langs), len(order)), np.int32)
    for t, n in enumerate(live.tolist()):
        found = own.moves.take(state[:, :n] + block[t, :n])
        ended[:, :n] += found & 1
        np.right_shift(found, 1, out=state[:, :n])
    total = np.zeros((len(texts), len(own.langs)), np.int64)
    of = np.repeat(np.arange(len(texts)), pieces)
    for i in range(len(own.langs)):
        total[:, i] = np.bincount(of, ended[i][column], minlength=len(texts))
    return total, counts


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS, each: int = EACH, chars: int = CHARS) -> Automata:
    """Automata of the languages of labelled rows. Windows of at most `texts` distinct texts a language, the least by hash, are collected."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # the least of each part of the hashes first, so a language's last choice is among `PARTS` times `texts` rows
    part = F.pmod("h", F.lit(PARTS))
    least = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))).where(F.col("n") <= texts).drop("n")
    chosen = least(least(rows.select("lang", "h").distinct(), part))
    window = max(1, 4 * each // texts)
    begin = F.pmod("h", F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int") + 1
    windows = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.substring("text", begin, F.lit(window)).alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    strings: dict[str, list[str]] = {}
    for r in windows.orderBy("lang", "h").toLocalIterator():  # at most 4 * each characters a language
        strings.setdefault(r.lang, []).append(r.part + " ")
    return Automata(strings, min(each, max(64, chars // max(1, len(strings)))))


def predict(docs: DataFrame, model: Automata, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred and score: how much fewer normalised phrases the best language needs than the next."""
    keep = [c for c in docs.columns if c not in RESULT]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + (", " if keep else "") + "made0 string, made1 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        symbol_of = own.table() if own.langs else np.zeros(0, np.uint8)
        names = np.array(own.langs or [UNKNOWN], object)
        costs = np.array(own.costs or [0.0])
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
                part = batch.slice(a, b - a)
                a = b
                texts = [t or "" for t in part.column(0).to_pylist()]
                said, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if own.langs:
                    found, chars = phrases(own, symbol_of, texts)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cost = found * costs / chars[:, None]
                    best = cost.argmin(1)
                    least = cost[np.arange(len(texts)), best]
                    known = chars > 0
                    said[known] = names[best[known]]
                    score[known] = 1.0
                    if len(own.langs) > 1:
                        score[known] = 1 - least[known] / np.partition(cost, 1, axis=1)[known, 1]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(said, pa.string()), pa.array(score)], names=[*[f"c{i}" for i in range(len(keep))], "made0", "made1"])

    given = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    return given.mapInArrow(run, schema).toDF(*keep, *RESULT)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows to learn from: crc32 of the id as text is not 1 modulo 3."""
    return docs.where(crc_bucket(id_col, 3) != 1)
