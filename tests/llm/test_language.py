"""Cross-parsing against substring search, held-out accuracy, and texts with nothing to go by."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave.llm import language
from rillwave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, made0 string, c0 int"


def folded(text):
    out = "".join(c.lower() if len(c.lower()) == 1 else c for c in (ch if ch.isalpha() else " " for ch in text))
    return " ".join(out.split()) + (" " if out.split() and not text[-1].isalpha() else "")


def greedy(text, string, steps):
    """Phrases by substring search; a letter that the string lacks ends a phrase and opens the next."""
    n = 0
    for a in range(0, len(text), steps):
        part, now = text[a : a + steps], ""
        n += 1
        for c in part:
            if now + c in string:
                now += c
            else:
                n += 1
                now = c if c in string else ""
    return n


@pytest.mark.parametrize("steps", [7, 64, 1024])
def test_phrases_equal_substring_search(steps):
    draw = random.Random(steps)
    make = lambda letters, k: "".join(draw.choices(letters + " ", k=k)).lstrip()
    strings = {"a": [make("abcé", 300)], "b": [make("bcdé", 200)], "c": [make("xyz", 9)]}
    model = language.Automata(strings)
    texts = ["", make("abcdé", 500), "q", "  ", make("abcxyz", 30), "A.b,,c É", "123"] + [make("abcdéxyzq", draw.randrange(1, 90)) for _ in range(20)]
    found, chars = language.phrases(model, model.table(), texts, steps)
    assert chars.tolist() == [len(folded(t)) for t in texts]
    want = [[greedy(folded(t), folded(strings[k][0]), steps) for k in model.langs] for t in texts]
    assert found.tolist() == want


def test_automaton_has_all_factors_and_no_other():
    draw = random.Random(4)
    string = [draw.randrange(3) for _ in range(60)]
    moves = language.suffix_automaton(string)
    assert len(moves) <= 2 * len(string)
    factors = {tuple(string[i:j]) for i in range(60) for j in range(i, 61)}

    def walk(state, word):
        assert word in factors
        return 1 + sum(walk(t, (*word, c)) for c, t in moves[state].items())

    assert walk(0, ()) == len(factors)


def test_texts_with_nothing_to_go_by(spark):
    rows = [(1, "das ist ein haus und ein baum", "de"), (2, "this is a house and a tree", "en"), (3, None, "en"), (4, "", None), (5, "12 -- 3", "de"), (None, "EIN BAUM", None), (6, "日本語", "xx"), (7, "the tree " * 50000, "en"), (8, "a", ""), (1, "das ist ein haus und ein baum", "de")]
    df = spark.createDataFrame([(i, t, g, "s", 0.5, "m", 7) for i, t, g in rows], SCHEMA).repartition(3)
    model = language.fit(df.where("lang is null or lang in ('de', 'en')"))
    got = {(r.doc_id, r.text): r for r in language.predict(df, model).collect()}
    assert set(language.predict(df, model).columns) == {*df.columns, "lang_pred"}
    assert len(got) == len(rows) - 1 and model.langs == ["de", "en"]
    said = {r.doc_id: r.lang_pred for r in got.values()}
    assert said == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", None: "de", 6: said[6], 7: "en", 8: said[8]}
    assert all(0 <= r.score <= 1 for r in got.values()) and said[6] in model.langs
    none = language.predict(df, language.fit(df.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)
    one = language.predict(df, language.fit(df.where("lang = 'de'"))).where("doc_id = 2").first()
    assert (one.lang_pred, one.score) == ("de", 1.0)
    assert language.predict(df.where("false"), model).count() == 0


def test_held_out_documents(spark):
    got = QUERIES["op13_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95 and got.count() == 200


def test_a_sample_is_bounded(spark):
    rows = [(i, f"word{i % 50} and other words of text {i}", "en", "s", 0.0, "", 0) for i in range(2000)] + [(0, "same text", "de", "s", 0.0, "", 0)] * 1500
    model = language.fit(spark.createDataFrame(rows, SCHEMA), texts=20, each=200)
    assert model.langs == ["de", "en"] and len(model.moves) <= 2 * 2 * 201 * language.SYMBOLS
    assert np.all(model.moves >= 0)
