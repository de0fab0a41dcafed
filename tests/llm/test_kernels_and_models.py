"""Kernels, sampling, Viterbi and file formats against plain definitions."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rillwave.llm import chat, dedup, flac, html, lm, mixing, quality, tokens
from rillwave.llm import kernels as K

TEXTS = ["", None, "a", "b c", "É x É", "AbC abc", "  lead and trail  ", "one two three four five six", "x" * 5000, "tab\tnew\nline\r\x0b\x0c end", "日本 語 a1"]


def test_words_are_those_of_the_patterns():
    raw, offs = K.text_buffers(pa.array(TEXTS))
    for klass, lower, pattern in ((K.NOT_SPACE, False, r"[^\x20\x09-\x0D]+"), (K.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        want = [re.findall(pattern, (t or "").translate(low) if lower else t or "") for t in TEXTS]
        w = K.Words(raw, offs, klass, lower)
        got = [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.stops, strict=True)]
        assert got == [x for row in want for x in row]
        assert w.counts.tolist() == [len(r) for r in want]
        by_word = dict(zip(got, w.hashes.tolist(), strict=True))
        assert [by_word[x] for x in got] == w.hashes.tolist() and len(set(by_word.values())) == len(by_word)


def test_shingles_of_short_and_long_texts():
    raw, offs = K.text_buffers(pa.array(["a b c d e", "a b c d e f", "a b", "", "a b c d f"]))
    h, first = K.shingles(K.Words(raw, offs, K.ALNUM))
    assert np.diff(first).tolist() == [1, 2, 1, 0, 1]
    assert h[0] == h[1] and len(set(h.tolist())) == 4


def test_sliced_arrow_columns():
    raw, offs = K.text_buffers(pa.array(["zz", "a b", None, "c"]).slice(1))
    assert raw.tobytes() == b"a bc" and offs.tolist() == [0, 3, 3, 4]


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 48, 400).astype(np.uint64))
    u, v = rng.choice([0.75, 1.0, 2.0], len(h)), rng.choice([0.75, 1.0, 2.0], len(h))
    u[:60], v[-60:] = 0, 0
    sampler = dedup.Sampler(2048)
    a, b = u > 0, v > 0
    s = sampler.signatures(np.concatenate((h[a], h[b])), np.concatenate((u[a], v[b])).astype(np.float32), np.array([0, a.sum(), a.sum() + b.sum()]))
    want = np.minimum(u, v).sum() / np.maximum(u, v).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.06


def test_cube_flight_keeps_totals():
    rng = np.random.default_rng(5)
    pi, size = rng.uniform(0.05, 0.95, 500), rng.integers(0, 900, 500)
    order = np.argsort(-size)
    pi, size = pi[order], size[order]
    s = mixing.flight(pi, size, rng.random(500), last=True)
    assert set(s) <= {0.0, 1.0}
    assert abs((s * size).sum() - (pi * size).sum()) <= 5
    part = mixing.flight(pi, size, rng.random(500), last=False)
    assert ((part > 0) & (part < 1)).sum() <= 2
    assert (part * size).sum() == pytest.approx((pi * size).sum(), rel=1e-6)


def test_cube_inclusion_probabilities():
    rng = np.random.default_rng(6)
    pi, size = np.full(60, 0.3), np.sort(rng.integers(1, 400, 60))[::-1]
    mean = np.mean([mixing.flight(pi, size, rng.random(60), last=False) for _ in range(300)], 0)
    assert abs(mean - 0.3).max() < 0.12


def test_hinge_loss_separates():
    rng = np.random.default_rng(7)
    y = np.where(rng.random(200) < 0.3, -1, 1)
    cols = [np.unique(np.append(rng.integers(10, 400, 20), 1 if t > 0 else 2)) for t in y]
    ratio = quality.log_count_ratios(cols, y, 512)
    w, b = quality.dual_coordinate_descent(cols, y, ratio)
    said = [np.sign(ratio[c] @ w[c] / np.sqrt((ratio[c] ** 2).sum()) + b) for c in cols]
    assert (np.array(said) == y).mean() > 0.97


def test_log_frequency_filter_has_no_false_negatives():
    rng = np.random.default_rng(8)
    h = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    counts = rng.geometric(0.3, len(h)) ** 3
    parts = [lm.build_segment(h[lm._bucket(h, 4) == b], counts[lm._bucket(h, 4) == b]) for b in range(4)]
    size = np.array([len(p) for p in parts])
    f = lm.LogFrequencyFilter(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size * 8)
    got, want = f.levels(h), lm.levels_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.95
    strange = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    assert (f.levels(strange) > 0).mean() < 0.05
    assert abs(lm.count_of(lm.levels_of(np.array([1, 2, 10, 1000]))) / np.array([1, 2, 10, 1000]) - 1).max() < 0.35


def _tiny():
    rng = np.random.default_rng(9)
    n = len(chat.STATES)
    return chat.Model(rng.random(n) + 0.1, rng.random((n, n)) + 0.1, {k: rng.random((n, m)) + 1.1 for k, m in chat.FEATURES.items()}), rng


def test_viterbi_in_blocks_equals_all_paths():
    model, rng = _tiny()
    show = rng.normal(size=(6, len(chat.STATES)))

    def score(path):
        s = model.start[path[0]] + show[0][path[0]]
        for i in range(1, len(path)):
            s += model.move[path[i - 1], path[i]] + show[i][path[i]]
        return s

    best = max(itertools.product(range(len(chat.STATES)), repeat=6), key=score)
    for cuts in ((6,), (1, 5), (2, 2, 2), (1, 1, 4)):
        parts, at = [], 0
        for c in cuts:
            parts.append(show[at : at + c])
            at += c
        opened = model.start + parts[0][0]
        for e in parts[0][1:]:
            opened = (opened[:, None] + model.move).max(0) + e
        ends = chat.chain(opened, np.stack([chat.transfer(model, p) for p in parts]))
        path = [s for p, (a, b) in zip(parts, ends, strict=True) for s in chat.best_path(model, p, a, b)]
        assert score(path) == pytest.approx(score(best))


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(10)
    data = [flac.payload(b""), flac.payload("é text ".encode() * 700), rng.bytes(5 * 192), bytes(range(256)) * 9, b"\x80" * 1152, flac.payload(b"a" * 1153)]
    streams = flac.encode_payloads(data)
    for d, (x, frames) in zip(data, flac.decode_streams(streams), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == d
        assert [f for f, _ in frames] == list(range(0, len(d), 1152)) and sum(n for _, n in frames) == len(d)
    bad = bytearray(streams[1])
    bad[-30] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(bad)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8))


@pytest.mark.parametrize(("kind", "partition_order", "method"), [("lpc", 0, 0), ("lpc", 2, 1), ("fixed3", 1, 0), ("fixed4", 3, 0), ("escape", 1, 0)])
def test_flac_decoder_reads_what_the_encoder_does_not_write(kind, partition_order, method):
    """Frames made bit by bit: linear predictors, high fixed orders, partitions, five-bit parameters, escapes; no seek table."""
    rng = np.random.default_rng(11)
    n = 192
    x = np.clip(np.cumsum(rng.integers(-6, 7, n)), -128, 127)
    w = Writer()
    if kind == "lpc":
        coefs, shift, precision = [13, -5], 3, 6
        order = 2
        w.put(0, 1), w.put(32 + order - 1, 6), w.put(0, 1)
    else:
        order = int(kind[-1]) if kind.startswith("fixed") else 1
        w.put(0, 1), w.put(8 + order, 6), w.put(0, 1)
    for v in x[:order]:
        w.put(int(v), 8)
    if kind == "lpc":
        w.put(precision - 1, 4), w.put(shift, 5)
        for c in coefs:
            w.put(c, precision)
        res = [int(x[i]) - ((coefs[0] * int(x[i - 1]) + coefs[1] * int(x[i - 2])) >> shift) for i in range(order, n)]
    else:
        res = np.diff(x, order).tolist()
    w.put(method, 2), w.put(partition_order, 4)
    size = n >> partition_order
    at = 0
    for p in range(1 << partition_order):
        count = size - (order if p == 0 else 0)
        part = res[at : at + count]
        at += count
        if kind == "escape" and p == 1:
            w.put(15, 4), w.put(9, 5)
            for r in part:
                w.put(r, 9)
            continue
        k = 2 + p % 3
        w.put(k, 4 if method == 0 else 5)
        for r in part:
            u = (r << 1) ^ (r >> 31)
            w.put(0, u >> k), w.put(1, 1), w.put(u, k)
    frame = flac.frame_header(0, n) + w.bytes()
    frame += int(flac.crc16_all([frame])[0]).to_bytes(2, "big")
    info = b"\0\xc0\0\xc0" + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    (got, frames), = flac.decode_streams([stream])
    assert got.tolist() == x.tolist() and frames == [(0, n)]


@pytest.mark.parametrize(
    "text",
    ["", "a\x1cb c", "É éx", "don't  it's it'S 'S", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", " a\xa0b", "ΑΣ ΣΑΣ.", "́a b́", "1234 5six 6.", "İstanbul. ſ. K!", "　全角。 文字.", "é».,", "x...'s 'tis' o'clock ABC!!", "a_b- --- ...", "Å. Å, É!!", "ａ. ².", "THE the. The, word" * 50],
)
def test_encoder_equals_the_tokenizer_on_whole_texts(text):
    coder = tokens.encoder(tokens.vocabulary_path())
    want = [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(coder.encode(text.encode(), 2), coder.kind).tolist() == want


def test_encoder_equals_the_tokenizer_on_random_texts():
    import random

    rng = random.Random(1)
    alphabet = [*"aAbTtHhwWyYjJiIİıſßẞéÉåÅ'’.,!?;:-_<>|=\"()sdlmrev09½ªº×÷ǅΣσς\u0338\u0331\u0300\u0301\u0307\u0308\u030a\u030c\u0340\u0345  \u2003\u200b \t\n\r\x0b\x0c\x85\x1c\x00한각가日本🙂", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext|>", "'re", "'LL"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(30000)]
    raw, offs = K.text_buffers(pa.array(texts))
    coder = tokens.TextEncoder(tokens.vocabulary_path())
    coder.memory = tokens.PieceMemory(coder.kind, 12)  # emptied again and again
    assert coder.by_pieces
    for lo, hi in K.blocks(offs, 1 << 14):
        ids, lengths = coder.encode_block(raw, offs[lo : hi + 1], 2)
        cut = np.concatenate(([0], np.cumsum(lengths)))
        for k, e in enumerate(coder.tokenizer.encode_batch(texts[lo:hi], add_special_tokens=False)):
            assert ids[cut[k] : cut[k + 1]].tolist() == [*e.ids, 2], texts[lo + k]


@pytest.mark.parametrize("text", ["The THE the", "TÜRKÇESİ.", "  two  spaces\n", "", "Don't stop!"])
def test_a_cased_vocabulary_encodes_whole_texts(text):
    coder = tokens.encoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    assert not coder.by_pieces
    want = [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(coder.encode(text.encode(), 2), coder.kind).tolist() == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>just a <i>p", "just a p"),
        ("plain &amp; text", "plain & text"),
        ("<html><body><nav><a href=x>menu menu menu</a></nav><article><h1>T</h1><p>One <a href=y>two</a> &lt;3.<p>Four<br>five <b>six</b></article><footer>f</footer>", "T\nOne two <3.\nFour five six"),
        ("<body><div class='sidebar'><p>no no no no no</div><div id=content><p>A long enough paragraph of the text.</p><ul><li>a<li>b</ul></div><div class=comments><p>bad bad bad</div><form><p>name</form>", "A long enough paragraph of the text.\na\nb"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style>", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_crc_matches_definition():
    assert flac.crc8(b"123456789") == 0xF4
    assert int(flac.crc16_all([b"123456789"])[0]) == 0xFEE8
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_html_content_in_cousin_containers():
    part = lambda k, n: "".join(f"<p>{k}{i} some words of a long enough paragraph of prose, as articles have them.</p>" for i in range(n))
    first, second = ([f"{k}{i} some words of a long enough paragraph of prose, as articles have them." for i in range(n)] for k, n in (("a", 10), ("b", 8)))
    links = "<ul><li><a href=x>one link</a><li><a href=y>other link</a></ul>"
    page = f"<body>{links}<div><div class=a><div class=t>{part('a', 10)}</div></div><div class=b><div class=t>{part('b', 8)}</div></div></div></body>"
    assert html.main_text(page).split("\n") == first + second
    beside = f"<body>{links}<article>{part('a', 10)}</article><div><div class=t>{part('b', 8)}</div></div></body>"
    assert html.main_text(beside).split("\n") == first + second


@pytest.mark.parametrize("name", ["content has-sidebar", "no-header", "with-nav", "legal-news", "social-science", "search-results", "sidebar"])
def test_html_class_words_do_not_take_out_the_page(name):
    text = [f"{i} some words of a long enough paragraph of prose, as articles have them." for i in range(6)]
    inner = "".join(f"<p>{t}</p>" for t in text)
    noise = '<div class="ad">buy</div><div class="sidebar-left"><p>an aside</p></div>'
    assert html.main_text(f'<body><div class="{name}">{inner}</div>{noise}</body>').split("\n") == text
    assert html.main_text(f'<body><div class="{name}"><article>{inner}</article></div>{noise}</body>').split("\n") == text
    assert html.main_text(f'<body><ul><li><a href=x>one link</a><li><a href=y>other link</a></ul><div class="legal-news">{inner}</div><div class="other">{inner * 3}</div>{noise}</body>').split("\n") == text * 4


_PROSE = "It was a long sentence of ordinary prose, with a clause or two and a number of words that no menu would ever hold."


@pytest.mark.parametrize("mark", ["class=legal", "id=search", "class='alert-note'", "class=comment", "id=header-1", "class='social share'", "hidden", "aria-hidden=true"])
def test_no_paragraph_leaves_for_a_word_of_its_class(mark):
    page = f"<body><nav><a href=x>menu</a></nav><div><p>{_PROSE} 1</p><p {mark}>{_PROSE} 2</p><p>{_PROSE} 3</p></div><div class=ad>Buy it now, and buy it here.</div><footer>f</footer></body>"
    assert html.main_text(page) == "\n".join(f"{_PROSE} {i}" for i in (1, 2, 3))


def test_nul_and_wrappers_stay():
    assert html.main_text("<p>a\x00b") == "a\x00b"
    page = f"<body><div class='header-wrap'><div class=content>{f'<p>{_PROSE}</p>' * 4}</div></div><div class=comments><p>Nice!</p></div></body>"
    assert html.main_text(page) == "\n".join([_PROSE] * 4)
    page = f"<body><div class=ad>{_PROSE * 9}</div><article><p>One.</p></article></body>"
    assert html.main_text(page) == "One."


def test_densities_and_choice_against_a_plain_definition():
    """Random well-formed pages: the formula written out by recursion over nested lists, and the choice by its definition."""
    import math
    import random

    rng = random.Random(3)

    def made(depth):
        name = rng.choice(["div", "section", "p", "ul", "b", "a"] if depth else ["div"])
        if name in ("p", "b", "a") or depth > 4:
            return [name if name in ("p", "b", "a") else "p", "w" * rng.randint(1, 90)]
        return [name, *(made(depth + 1) for _ in range(rng.randint(1, 4)))]

    def render(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(render, x[1:]))}</{x[0]}>"

    def count(x):
        """C, T, LC, LT"""
        if isinstance(x, str):
            return len(x), 0, 0, 0
        parts = [count(y) for y in x[1:]]
        c, t, lc, lt = (sum(p[i] for p in parts) for i in range(4))
        t += sum(not isinstance(y, str) for y in x[1:])
        lt += sum(not isinstance(y, str) and y[0] == "a" for y in x[1:])
        return c, t, c if x[0] == "a" else lc, lt

    for _ in range(200):
        body = ["body", *(made(1) for _ in range(3))]
        cb, _, lcb, _ = count(body)

        def density(x):
            c, t, lc, lt = (max(1, v) for v in count(x))
            outside = max(1, count(x)[0] - count(x)[2])
            return c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(math.log(c / outside * lc + lcb / max(1, cb) * c + math.e))

        flat = []

        def walk(x, flat=flat, density=density):
            flat.append((x[0], density(x), sum(density(y) for y in x[1:] if not isinstance(y, str))))
            for y in x[1:]:
                if not isinstance(y, str):
                    walk(y)

        walk(body)
        order = html.densities(html.parse(render(body)))[1:]
        assert [n.name for n in order] == [n for n, _, _ in flat]
        assert [n.density for n in order] == pytest.approx([d for _, d, _ in flat])
        assert [n.total for n in order] == pytest.approx([t for _, _, t in flat])
        # the maximum-sum subtree is part of the text as a whole
        best = max(range(len(flat)), key=lambda i: flat[i][2])
        text = html.main_text(render(body))
        assert "\n".join(html._blocks(order[best])) in text


def test_flac_takes_linear_predictors_where_they_win():
    rng = np.random.default_rng(12)
    tone = (60 * np.sin(np.arange(5760) * 0.31) + 30 * np.sin(np.arange(5760) * 0.11) + rng.normal(0, 1, 5760)).round().clip(-128, 127)
    data = [(tone + 128).astype(np.uint8).tobytes(), flac.payload(b"some text of words and spaces, as it comes. " * 60), rng.bytes(1152)]
    streams = flac.encode_payloads(data)
    for d, (x, _) in zip(data, flac.decode_streams(streams), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == d
    kinds = []
    for stream in streams:
        o = flac.open_stream(stream)
        for _, at, size in o.points:
            _, head = flac._read_header(stream, o.audio + at)
            kinds.append(stream[o.audio + at + head] >> 1)
    assert kinds[:5] == [32 + flac.ORDER - 1] * 5 and kinds[-1] == 1  # predictors for the tone, verbatim for noise
    assert len(streams[0]) < 0.6 * len(data[0])


def test_flac_streams_without_their_seek_table():
    data = flac.payload("é text of many frames ".encode() * 900)
    (stream,) = flac.encode_payloads([data])
    o = flac.open_stream(stream)
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[o.audio :]
    ((x, frames),) = flac.decode_streams([bare])
    assert (x + 128).astype(np.uint8).tobytes() == data and len(frames) == len(o.points)
