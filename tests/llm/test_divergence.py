"""Source divergence against plain counting, in one round and several; pairs of sources against dense sums."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillwave.llm.divergence import pair_sums, qualified_terms, source_divergence

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "text string, lang string, source string, term long, n long, g int, part string"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(rows, min_df, top):
    seen, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        seen.update((lang, t) for t in set(terms(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for (a, t), n in seen.items() if a == lang and n >= min_df]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"{c}{d}" for c in "abcÄäéZ" for d in "xyzÅ"] + ["日本", "𝒳y", "it's", "a\x00b", "q_q"]
    rows = []
    for _ in range(400):
        lang = draw.choice(["en", "en", "en", "de", None, ""])
        source = draw.choice(["hot", "hot", "a", "b", "", None, "é"])
        rows.append((draw.choice([None, "", " ".join(draw.choices(words, [1 + 40 * (len(source or "") == 3)] + [2] * (len(words) - 1), k=draw.randrange(1, 30)))]), lang, source))
    return rows + [("only once", "xx", "s"), ("only twice", "xx", "t"), (None, "yy", "alone"), ("long " * 40000, "de", "b")] + rows[:40]


@pytest.mark.parametrize(("seed", "rounds"), [(1, None), (2, 3)])
def test_divergence_equals_plain_counting(spark, seed, rounds):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2, 3, "p") for r in rows], SCHEMA).repartition(5)
    got = source_divergence(df, min_df=8, top=5, rounds=rounds).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 8, 5)


def test_no_rows(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_equal_the_pattern():
    texts = [None, "", "Aa bÉ", "ÄÅ it's", "x", "X\x00y日", "{z}"]
    langs = ["en", "", "de", "a\x00b", "", "en", "de"]
    for a, b in ((0, 7), (2, 6), (4, 5), (0, 0)):
        found, _ = qualified_terms(pa.array(langs).slice(a, b - a), pa.array(texts).slice(a, b - a))
        assert found.to_pylist() == [[f"{g}\x00{t}" for t in terms(x)] for g, x in zip(langs[a:b], texts[a:b], strict=True)]


@pytest.mark.parametrize("tile", [2, 3, 100])
def test_pairs_equal_dense_sums(tile):
    draw = np.random.default_rng(tile)
    n, v = 7, 60
    base = draw.integers(1, 50, n)
    dense = np.repeat(base[:, None], v, 1)
    has = draw.random((n, v)) < 0.3
    has[4] = False
    dense[has] = draw.integers(1, 100, has.sum())
    g, t = np.nonzero(has)
    got = {}
    tiles = -(-n // tile)
    for i in range(tiles):
        for j in range(i, tiles):
            mine = np.isin(g // tile, (i, j))
            own = np.flatnonzero(np.isin(np.arange(n) // tile, (i, j)))
            mix = draw.permutation(mine.sum() + len(own))
            cols = (np.concatenate((g[mine], own)), np.concatenate((t[mine], np.full(len(own), -1))), np.concatenate((dense[has][mine], base[own])))
            for a, b, s in zip(*pair_sums(*(c[mix] for c in cols), i, j, tile), strict=True):
                assert (a, b) not in got
                got[a, b] = s
    assert got == {(a, b): np.abs(dense[a] - dense[b]).sum() - v * abs(base[a] - base[b]) for a in range(n) for b in range(a + 1, n)}
