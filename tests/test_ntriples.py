"""Graphs written as text and read back; lines by the grammar, good and bad."""

from __future__ import annotations

from rillwave.sources import ntriples as N

ODD = ["plain", "", 'say "so"', "back\\slash \\n", "two\nlines\r\n", "tab\t\b\f", "\x00\x01\x1f\x7f", "é 日本 \U0001d4b3", "'", "\\", "\\u0041", "a # b .", " \u0085"]


def test_round_trip(spark, tmp_path):
    rows = [(f"s{i}", "has text", t, k) for i, t in enumerate(ODD) for k in ("string", "integer", "lang:en-GB")]
    rows += [(f"s {i}<>\"{{}}|^`\\", "p", t, "iri") for i, t in enumerate(ODD)] + rows[:2]
    graph = spark.createDataFrame([*rows, (None, "p", "o", "string"), ("s", "p", None, "iri")], "s string, p string, o string, kind string").repartition(3)
    N.write_ntriples(graph, str(tmp_path / "g"))
    back = N.read_ntriples(spark, str(tmp_path / "g")).collect()
    assert not any(r.error for r in back)
    assert sorted((r.s, r.p, r.o, r.kind) for r in back) == sorted(rows)


def test_lines_by_the_grammar(spark, tmp_path):
    good = {
        "<http://a/s> <http://a/p> <http://a/o> .": ("http://a/s", "http://a/p", "http://a/o", "iri"),
        "_:b1 <urn:rillwave:p> _:c.d .# note": ("_:b1", "p", "_:c.d", "iri"),
        '\t<urn:rillwave:s><urn:rillwave:p>"x\\u00e9\\U0001F600\\t" .': ("s", "p", "xé😀\t", "string"),
        '<urn:rillwave:s> <urn:rillwave:p> "1.5"^^<http://www.w3.org/2001/XMLSchema#float> .  ': ("s", "p", "1.5", "float"),
        '<urn:rillwave:s> <urn:rillwave:p> "hi"@en .': ("s", "p", "hi", "lang:en"),
        '<urn:rillwave:s> <urn:rillwave:p> "x"^^<urn:t> .': ("s", "p", "x", "urn:t"),
    }
    bad = ["<a> <b> <c>", "<a b> <p> <o> .", '<s> <p> "open .', '<s> "p" <o> .', '<s> <p> "bad \\x" .', "s p o ."]
    (tmp_path / "g.nt").write_text("\n".join([*good, "", "  # comment", *bad]) + "\n", encoding="utf-8")
    rows = N.read_ntriples(spark, str(tmp_path / "g.nt")).collect()
    assert sorted((r.s, r.p, r.o, r.kind) for r in rows if not r.error) == sorted(good.values())
    assert sorted(r.line for r in rows if r.error) == sorted(bad) and all(r.s is None for r in rows if r.error)


def test_a_line_is_read_in_one_pass(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<s> <p> "o" .\n')
    plan = N.read_ntriples(spark, str(tmp_path / "g.nt"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\^\^<(") == 1


def test_long_terms_and_odd_escapes(spark, tmp_path):
    long = "n" * 200_000
    rows = [(long, "p", "x" * 300_000 + '"\\' * 50_000, "string"), ("s", "p", "\\\\\\n\\\\u0041\\", "string"), ("s", "p", "\\'\t\\\\\n'", "string"), ("s", "p", "\x01\\\\n", "string"), ("s", "p", "", "string"), ("s", "p", "", "iri")]
    N.write_ntriples(spark.createDataFrame(rows, "s string, p string, o string, kind string"), str(tmp_path / "g"))
    assert sorted((r.s, r.p, r.o, r.kind) for r in N.read_ntriples(spark, str(tmp_path / "g")).collect()) == sorted(rows)
    (tmp_path / "g.nt").write_text('<s> <p> "o" .\u0085\n', encoding="utf-8")  # read as before: a last line end is no part of the line
    assert [(r.o, r.kind, r.error) for r in N.read_ntriples(spark, str(tmp_path / "g.nt")).collect()] == [("o", "string", False)]


def test_files_are_compressed_and_many(spark, tmp_path):
    n = 3 * N.LINES
    rows = spark.range(0, n, 1, 2).selectExpr("concat('session_', id) s", "'hasRate' p", "concat('rate_', id % 7) o", "if(id % 2 = 0, 'iri', 'string') kind")
    N.write_ntriples(rows, str(tmp_path / "g"))
    files = list((tmp_path / "g").glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".gz") for f in files)
    back = N.read_ntriples(spark, str(tmp_path / "g"))
    assert sum(f.stat().st_size for f in files) * 5 < n * 80
    assert back.where("not error").select("s", "p", "o", "kind").exceptAll(rows).count() == 0 and back.count() == n


def test_simple_lines_are_read_as_by_the_grammar(spark, tmp_path, monkeypatch):
    b, x = N.BASE, N.XSD
    ends = [f"<{b}o>", f"<{b}>", '"text"', '""', '"two words"', '"a\\tb"', '"it\'s <b> {c}"', f'"1"^^<{x}float>', f'"1"^^<{x}>', f'"1"^^<{x}a{x}b>', '"1"^^<urn:t>', '"x"@en', "<http://a/o>", f"<{b}o\\u0020p>", "_:b", f"<{b}é日>", '"é日"', '"a"b"', f"<{b}o> <{b}o>", '"x"^^<>']
    lines = [f"<{s}> <{p}> {o}{e}" for s, p in ((f"{b}s", f"{b}p"), (b, f"{b}p"), ("urn:s", f"{b}p")) for o in ends for e in (" .", " . ", ".", " .\u0085", " . # n", "")]
    lines += [f"  <{b}s> <{b}p> <{b}o> .", f"<{b}s>  <{b}p> <{b}o> .", f"<{b}s><{b}p><{b}o> .", "", "# c", " ", "<", f"<{b}s> <{b}p> ."]
    (tmp_path / "g.nt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    read = lambda: sorted(map(str, N.read_ntriples(spark, str(tmp_path / "g.nt")).collect()))
    got = read()
    monkeypatch.setattr(N, "_simple", lambda base: "(?!)")
    assert got == read()
