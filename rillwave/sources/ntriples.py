"""Graphs as N-Triples text: one line a triple, written with full escaping and read by the line grammar.

Names are IRIs below `base`; a literal carries its datatype (`kind`, an XML Schema type) or, for kind `lang:xx`, a language tag.
Literals escape what a line or a quote would end, and all other control characters by code point, so any text is one line.

Defined results: a triple without subject, property or object is not written; a name's characters that an IRI forbids are
escaped and read back; blank lines and comments are no triples; a line that the grammar refuses is a row with `error` true and
its text in `line`; a literal without a type is of kind `string`; terms outside `base` keep their whole IRI, blank nodes `_:`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "urn:rillwave:"
XSD = "http://www.w3.org/2001/XMLSchema#"
_CONTROL = r"\x00-\x1F\x7F"
# The short escapes of a literal.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
# what a class takes is taken as a run, and nothing of a group is given back: long terms need no step a character
_IRI = r"<((?:[^\x00-\x20<>\"{}|^`\\]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)>"
_BLANK = r"(_:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)"
_STRING = r"(\")((?:[^\x0A\x0D\"\\]++|\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)\""
#: Groups: subject (name, blank), property, object (name, blank, quote, text, datatype, language).
LINE = rf"^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_STRING}(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)[ \t]*\.[ \t]*(?:#.*)?$"
_GROUPS = 9
_FORBIDDEN = r"\x00-\x20<>\"{}|^`\\"
#: Lines of a file: files are compressed and read by a task each, so a table is many files.
LINES = 1 << 15


def _simple(base: str) -> str:
    """Lines as `write_ntriples` writes most: names below `base`, nothing escaped, no language; a space between terms. They are read without groups."""
    name = rf"<\Q{base}\E[^{_FORBIDDEN}]*+>"
    return rf"^{name} {name} (?:{name}|\"[^\x0A\x0D\"\\]*+\"(?:\^\^<\Q{XSD}\E[^{_FORBIDDEN}]*+>)?) \.\z"


def _by_code(text: Column, unsafe: str) -> Column:
    """Characters of the class `unsafe` as \\uXXXX; texts without them are left as they are."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)[^{unsafe}]+|[{unsafe}]"), F.lit(0))
    coded = F.transform(parts, lambda p: F.when(p.rlike(f"^[{unsafe}]$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(p)), 4, "0"))).otherwise(p))
    return F.when(text.rlike(f"[{unsafe}]"), F.array_join(coded, "")).otherwise(text)


def _short_escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escaped(text: Column) -> Column:
    """A literal's text between its quotes."""
    return _by_code(_short_escaped(text), _CONTROL)


def _iri(name: Column, base: str) -> Column:
    """A name; `_plain` tells that there is nothing to escape."""
    return F.concat(F.lit(f"<{base}"), F.when(F.col("_plain"), name).otherwise(_by_code(name, _FORBIDDEN)), F.lit(">"))


def unescaped(text: Column) -> Column:
    short = F.create_map(*[F.lit(x) for plain, code in (*ESCAPES, ("'", "\\'")) for x in (code, plain)])
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def one(p: Column) -> Column:
        point = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[uU]"), point).when(p.startswith("\\"), F.try_element_at(short, p)).otherwise(p)

    def plain(part: Column) -> Column:
        for x, code in (*ESCAPES[1:], ("'", "\\'")):
            part = F.replace(part, F.lit(code), F.lit(x))
        return part

    # without code points, what lies between escaped backslashes is replaced as a whole
    whole = F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")
    by_code = text.contains("\\u") | text.contains("\\U")
    return F.when(~text.contains("\\"), text).when(by_code, F.array_join(F.transform(parts, one), "")).otherwise(whole)


def write_ntriples(graph: DataFrame, path: str, base: str = BASE) -> None:
    """graph: (s, p, o, kind); kind `iri` is a name, `lang:xx` a text in a language, any other a datatype. The files are compressed (gzip)."""
    rows = graph.where("s is not null and p is not null and o is not null and kind is not null")
    # what has nothing to escape is found by one search of all three terms
    rows = rows.select("s", "p", "kind", "o", (~F.concat("s", "p", "o").rlike(rf"[{_FORBIDDEN}\x7F]")).alias("_plain"))
    # each step is a column of its own, as the next one reads it more than once
    whole = F.col("_plain") | (F.col("kind") == "iri")
    rows = rows.select("s", "p", "kind", "_plain", F.when(whole, F.col("o")).otherwise(_short_escaped(F.col("o"))).alias("o"))
    quoted = F.concat(F.lit('"'), F.when(whole, F.col("o")).otherwise(_by_code(F.col("o"), _CONTROL)), F.lit('"'))
    rows = rows.select("s", "p", "kind", "_plain", F.when(F.col("kind") == "iri", _iri(F.col("o"), base)).otherwise(quoted).alias("o"))
    mark = F.when(F.col("kind").isin("iri", "string"), "").when(F.col("kind").startswith("lang:"), F.concat(F.lit("@"), F.substr("kind", F.lit(6)))).otherwise(F.concat(F.lit(f"^^<{XSD}"), F.col("kind"), F.lit(">")))
    line = F.concat_ws(" ", _iri(F.col("s"), base), _iri(F.col("p"), base), F.concat("o", mark), F.lit("."))
    rows.select(line.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", LINES).text(path)


def read_ntriples(spark: SparkSession, path: str, base: str = BASE) -> DataFrame:
    """(s, p, o, kind, error, line) of each line that is neither blank nor a comment."""
    lines = spark.read.text(path).where(F.col("value").startswith("<") | ~F.col("value").rlike(r"^[ \t]*(#.*)?$"))
    # of a simple line a quote ends what no name holds, and a space each name
    lines = lines.select("value", F.when(F.col("value").rlike(_simple(base)), F.split("value", '"', 3)).alias("_q"))
    # the grammar goes over any other line once: its groups, one a line, and what it leaves; a line of text has no line end
    groups = F.regexp_replace("value", LINE, "".join(f"${i + 1}\n" for i in range(_GROUPS)))
    lines = lines.select("value", "_q", F.split(F.col("_q")[0], " ", -1).alias("_n"), F.when(F.col("_q").isNull(), F.split(groups, "\n", -1)).alias("_g"))
    group = lambda i: F.col("_g")[i - 1]

    def name(iri: Column, blank: Column | None = None) -> Column:
        whole = unescaped(iri)
        short = F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(whole)
        return short if blank is None else F.when(blank != "", blank).otherwise(short)

    literal = group(6) != ""
    kind = F.when(~literal, "iri").when(group(9) != "", F.concat(F.lit("lang:"), group(9))).when(group(8) != "", F.replace(unescaped(group(8)), F.lit(XSD), F.lit(""))).otherwise("string")
    o = F.when(literal, unescaped(group(7))).otherwise(name(group(4), group(5)))
    simple, good = F.col("_n").isNotNull(), F.size("_g") > 1
    below = lambda i: F.substr(F.col("_n")[i], F.lit(len(base) + 2), F.length(F.col("_n")[i]) - (len(base) + 2))
    quoted, kept = F.size("_q") > 1, F.get("_q", F.lit(2))
    plain = {
        "s": below(0),
        "p": below(1),
        "o": F.when(quoted, F.get("_q", F.lit(1))).otherwise(below(2)),
        "kind": F.when(~quoted, "iri").when(kept == " .", "string").otherwise(F.replace(F.substr(kept, F.lit(4), F.length(kept) - 6), F.lit(XSD), F.lit(""))),
    }
    made = {"s": name(group(1), group(2)), "p": name(group(3)), "o": o, "kind": kind}
    bad = ~simple & ~good
    return lines.select(*[F.when(simple, plain[k]).when(good, v).alias(k) for k, v in made.items()], F.coalesce(bad, F.lit(False)).alias("error"), F.when(bad, F.col("value")).alias("line"))
