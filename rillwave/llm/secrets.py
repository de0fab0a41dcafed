"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are always reported. Weak candidates (account identifiers, short secrets, key-like strings, endpoints) are
reported only when complementary parts stand within one scope: an interval join of identifiers, secrets and endpoints.

Places come from one property of regular expressions: a pattern that starts with \\G and a lazy gap matches gap and hit in
turn, so the running lengths of gaps and hits are the places of the leftmost non-overlapping hits, in code points. Texts
without a trace of a pattern are sorted out by one cheaper test first.

The interval join deals candidates to buckets of `scope` code points and looks into the neighbouring buckets. A bucket has
as many candidates at most as fit into it, so no text makes more than a fixed number of meetings a candidate; and it is a
semi join, which stops at the first partner.

Defined results: null is an empty text; a text without hits has counts 0 and empty strings; a very long text is scanned
whole, its places are summed up in pieces of `PIECE` hits; rows are matched by id and a hash of the text, so rows that share
an id keep their own spans and repeated rows get equal ones; spans that begin together go by kind as listed; an empty table
gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.arrays import let

from .shared import written

SCOPE = 256
PIECE = 512

# Fixed patterns of the strong kinds, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Patterns of the weak kinds.
IDENTIFIER = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
SHORT = r"""(?i:password|passwd|secret|pwd|passphrase)["']?\x20*[:=]\x20*["']?[!-~]{4,}"""
KEYLIKE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
#: What a whole run must hold somewhere to look like a key.
KEY_CLASSES = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

#: kind, pattern, the part that it plays (identifier, secret, endpoint), strong or weak
KINDS = (
    ("assign", ASSIGN, "secret", True),
    ("access", ACCESS, "identifier", True),
    ("hex", HEX, "secret", True),
    ("ident", IDENTIFIER, "identifier", False),
    ("short", SHORT, "secret", False),
    ("keylike", KEYLIKE, "secret", False),
    ("endpoint", ENDPOINT, "endpoint", False),
)
#: What must stand within the scope of a weak candidate, by its part.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
#: One test that every text with a strong or weak candidate of use passes.
TRACE = r"(?i:passw|secret|token|api_?key|pwd|passphrase|client_?id|key_?id|account_?id|user_?name|login)|AKIA|[0-9a-f]{32}"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _places(text: Column, kind: int, pattern: str) -> Column:
    """The (start, kind, end) of every leftmost non-overlapping hit that its kind takes."""
    whole = F.lit(r"\G(?s:(.*?))(" + pattern + ")")
    gaps, hits = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    taken = F.transform(hits, lambda x: F.lit(True))
    if KINDS[kind][0] == "assign":
        taken = F.transform(F.regexp_extract_all(text, whole, F.lit(4)), lambda x: F.length(x) >= 8)
    elif KINDS[kind][0] == "keylike":
        taken = F.transform(hits, lambda x: x.rlike(KEY_CLASSES[0]) & x.rlike(KEY_CLASSES[1]) & x.rlike(KEY_CLASSES[2]))
    found = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), taken.alias("taken"))

    # running sums in two levels: spans are gathered within pieces, and pieces begin where those before them end
    long = F.lit(0).cast("long")

    def cut(hits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / PIECE).cast("int")), lambda c: F.slice(hits, c * PIECE + 1, PIECE))

    def bases(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.aggregate(p, long, lambda n, x: n + x["gap"] + x["hit"]))
        return F.aggregate(lengths, F.array(long), lambda b, n: F.concat(b, F.array(F.element_at(b, -1) + n)))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["hit"]
        span = F.when(x["taken"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.concat(state["spans"], span).alias("spans"))

    def placed(pieces: Column, begin: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.aggregate(p, F.struct(F.element_at(begin, i + 1).alias("at"), F.array().cast(_SPAN).alias("spans")), add)["spans"])

    # each step is bound once: inside a lambda the hits would be searched for again, piece by piece
    return F.flatten(let(found, lambda hits: let(cut(hits), lambda pieces: let(bases(pieces), lambda begin: placed(pieces, begin)))))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(candidates: DataFrame, scope: int) -> DataFrame:
    """Weak candidates whose complementary parts stand within `scope` code points. candidates: key, start, kind, end."""
    part = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), F.col("kind") + 1)
    weak = F.element_at(F.array(*[F.lit(not k[3]) for k in KINDS]), F.col("kind") + 1)
    all_parts = candidates.withColumns({"part": part, "weak": weak, "bucket": F.floor(F.col("start") / scope)})
    kept = None
    for own, needs in NEEDS.items():
        mine = all_parts.where(F.col("weak") & (F.col("part") == own))
        for need in needs:
            # a partner is met in its own bucket and in the buckets beside it
            other = all_parts.where(F.col("part") == need).select("key", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("start").alias("s"), F.col("end").alias("e"))
            apart = F.greatest(F.col("m.start"), F.col("o.s")) - F.least(F.col("m.end"), F.col("o.e"))
            # a part does not complete itself: overlapping spans are one part
            meets = (F.col("m.key") == F.col("o.key")) & (F.col("m.bucket") == F.col("o.bucket")) & (apart >= 0) & (F.abs(F.col("m.start") - F.col("o.s")) <= scope)
            mine = mine.alias("m").join(other.alias("o"), meets, "left_semi")
        kept = mine if kept is None else kept.unionByName(mine)
    return kept.select("key", "start", "kind", "end")


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of `documents`: its id, base (array of strong spans), linked (array of reported weak spans)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    traced = documents.select(F.col(id_col), text.alias("_text")).withColumn("_hit", F.col("_text").rlike(TRACE))
    none = F.array().cast(_SPAN)
    strong = F.concat(*[_places(F.col("_text"), i, k[1]) for i, k in enumerate(KINDS) if k[3]])
    weak = F.concat(*[_places(F.col("_text"), i, k[1]) for i, k in enumerate(KINDS) if not k[3]])
    key = F.when(F.col("_hit"), F.concat_ws(":", F.col(id_col).cast("string"), F.sha2("_text", 256)))
    rows = traced.select(id_col, key.alias("key"), F.when(F.col("_hit"), strong).otherwise(none).alias("base"), F.when(F.col("_hit"), weak).otherwise(none).alias("weak"))
    rows = written(rows, "spans")

    hit = rows.where(F.size("weak") > 0).dropDuplicates(["key"])
    # a weak span that overlaps a strong one is that strong one: the strong spans that begin before its end reach beyond its
    # start. They are met in one running maximum a text, weak spans standing at their ends
    strong_kind = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    every = hit.select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.start", "s.kind", "s.end").withColumn("strong", strong_kind)
    before = Window.partitionBy("key").orderBy(F.when(F.col("strong"), F.col("start")).otherwise(F.col("end")), "strong").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("strong"), F.col("end"))).over(before)
    spans = every.withColumn("reach", reach).where(F.col("strong") | (F.coalesce("reach", F.lit(-1)) <= F.col("start"))).select("key", "start", "kind", "end")
    linked = _linked(written(spans, "candidates"), scope).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    # only rows with candidates meet the links: the many others have no key and would all go to one task
    some = F.size("weak") > 0
    met = rows.where(some).join(linked, "key", "left").select(id_col, "base", F.coalesce("linked", none).alias("linked"))
    return met.unionByName(rows.where(~some).select(id_col, "base", none.alias("linked")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds, hash of the strong spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"),
    )
