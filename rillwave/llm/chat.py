"""Transcript parsing: a hidden Markov model over lines recovers who speaks, and turns are rendered in one canonical form.

States are (role, begin or inside) for each role. A line shows a speaker marker (or none), whether it opens a paragraph
block, a length class, and its end (question, sentence, other); given the state these are independent. Transition and
emission counts come from labelled rows by two aggregations; without labels the priors let markers decide.

Viterbi decoding is a product of max-plus matrices, which is associative, so a transcript of any length is cut into blocks
of lines, numbered in the total order of all rows, whatever their turns: each block gives the matrix of best scores from
entry to exit state, the matrices are chained into entry and exit states, and each block is then decoded alone between
them. Where a conversation has more than `CHAIN` blocks, so many matrices are first folded into one, level by level, and the
states are handed down again: no task holds more than `LINES` lines or `CHAIN` matrices of a conversation.

Defined results: rows are keyed by conversation, turn and text, so repeated rows get equal results, and ties in turn are
ordered by a hash of the text; a null conversation is one conversation, a null turn comes first; a null or empty text is one
empty line; a very long text is as many lines as it has, in as many blocks; roles outside `ROLES` are not learned from, and
without labels the priors decide; equal scores take the state listed first; an empty table gives no rows. Extra columns pass
through whatever their names; those named like a result (segment, said, rendered) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.arrays import let
from rillwave.functions.ordering import with_global_sums, with_group_number

from .shared import crc_bucket, partitions, written

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(len(ROLES)) for b in (0, 1)]  # (role, 1 if inside)
LINES = 256
#: Matrices that one task chains.
CHAIN = 4096
#: Fixed words that mark a speaker at the start of a line.
MARKERS = (r"system|sys", r"user|human|customer|client|question|me|q", r"assistant|ai|bot|agent|answer|support|model|a")
_MARKER = r"(?i)^\s*(?:[#>*\[(<|_-]*\s*)(" + "|".join(MARKERS) + r")\s*(?:[\])>|*_]*)\s*:+[*_]*\s*"
LENGTHS = 12
FEATURES = {"marker": 4, "opens": 2, "length": LENGTHS, "ends": 3}


def _lines(turns: DataFrame, *keep: str) -> DataFrame:
    """(ckey, turn, thash, line, marker, opens, length, ends): what each line shows."""
    line = F.col("text")
    said = F.lower(F.regexp_extract(line, _MARKER, 1))
    marker = F.lit(0)
    for i, words in enumerate(MARKERS):
        marker = F.when(said.rlike(f"^(?:{words})$"), i + 1).otherwise(marker)
    out = turns.select("ckey", "turn", "thash", "role", *keep, F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return out.select(
        "ckey",
        "turn",
        "thash",
        "role",
        *keep,
        "line",
        marker.alias("marker"),
        (F.col("line") == 0).cast("int").alias("opens"),
        F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(line) + 1.0))).cast("int").alias("length"),
        F.when(line.rlike(r"\?\s*$"), 0).when(line.rlike(r"[.!:;]\s*$"), 1).otherwise(2).alias("ends"),
    )


def _keyed(turns: DataFrame, conv_col: str, turn_col: str, text_col: str, role_col: str | None) -> DataFrame:
    """(ckey, turn, thash, text, role, row): the keys of each row, and the row as one struct, so that no name of its columns can meet ours."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(f"`{role_col}`")).cast("int") - 1 if role_col else F.lit(None).cast("int")
    key = F.coalesce(F.concat(F.lit("c"), F.col(f"`{conv_col}`").cast("string")), F.lit("n"))
    row = F.struct(*[F.col(f"`{c}`") for c in turns.columns])
    return turns.select(key.alias("ckey"), F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(-1)).alias("turn"), F.xxhash64(text).alias("thash"), text.alias("text"), role.alias("role"), row.alias("row"))


def _narrow(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("ckey", "turn", "thash").agg(F.min("text").alias("text"), F.min("role").alias("role"))


class Model:
    """Log probabilities; sizes are fixed by the states and features."""

    def __init__(self, start: np.ndarray, move: np.ndarray, show: dict[str, np.ndarray]):
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        # a tenth of each transition row is the prior: a corpus of one-line turns does not forbid longer ones
        prior = _priors()[1]
        self.start, self.move = norm(start), np.log(0.9 * np.exp(norm(move)) + 0.1 * np.exp(norm(prior)))
        # lengths and ends lean on those of all lines, and a twentieth of each distribution is uniform: what no state has
        # shown, or a state that was hardly seen, speaks for none of them
        for k in ("length", "ends"):
            seen = show[k] - 1
            show = show | {k: seen + 20 * (seen.sum(0) + 1) / (seen.sum() + seen.shape[1])}
        self.show = {k: np.log(0.95 * np.exp(norm(v)) + 0.05 / v.shape[1]) for k, v in show.items()}
        # whether a corpus writes markers at all says nothing of a line without one: only the marker's kind tells states apart
        marked = show["marker"][:, 1:]
        self.show["marker"] = np.concatenate((np.zeros((len(marked), 1)), np.log(marked / marked.sum(-1, keepdims=True) * np.where([[bool(i)] for _, i in STATES], 0.003, 1.0))), 1)
        # nor does a corpus of one turn a row say that rows never hold several
        self.show["opens"] = np.log(np.maximum(np.exp(self.show["opens"]), 0.05))

    def emissions(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.show[k][:, v].T for k, v in columns.items())


def _priors() -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    n = len(STATES)
    start = np.array([1.0 if not inside else 0.01 for _, inside in STATES])
    move = np.full((n, n), 0.05)
    for i, (a, _) in enumerate(STATES):
        for j, (b, inside) in enumerate(STATES):
            if inside:
                move[i, j] = 1.0 if a == b else 0.001
            elif a != b:
                move[i, j] = 0.5
    show = {k: np.ones((n, m)) for k, m in FEATURES.items()}
    for i, (r, inside) in enumerate(STATES):
        show["marker"][i] = 1.0
        show["marker"][i, r + 1] = 1.0 if inside else 50.0
        show["opens"][i] = (1.0, 0.01) if inside else (0.05, 1.0)
    return start, move, show


def fit(labelled: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Counts over all labelled rows, added to the priors."""
    narrow = _narrow(_keyed(labelled, conv_col, turn_col, text_col, role_col)).where("role is not null")
    lines = _lines(narrow)
    start, move, show = _priors()
    state = F.col("role") * 2 + F.when(F.col("line") > 0, 1).otherwise(0)
    for k, m in FEATURES.items():
        for r in lines.groupBy(state.alias("s"), F.col(k).alias("v")).count().collect():  # states times values
            if 0 <= r.v < m:
                show[k][r.s, r.v] += r["count"]
    rows = narrow.select("ckey", "turn", "thash", "role", F.size(F.split("text", "\n", -1)).alias("n"))
    # each row meets the one that follows it in the total order, however often a turn's number occurs
    rows = written(with_group_number(rows, ["ckey"], [F.col("turn"), F.col("thash")], "at"), "turns")
    ahead = rows.select("ckey", (F.col("at") - 1).alias("at"), F.col("role").alias("next"))
    met = rows.join(ahead, ["ckey", "at"], "left").groupBy("role", "next").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("long"), F.sum(F.greatest(F.lit(0), F.col("n") - 2)).alias("stays"))
    for r in met.collect():  # roles times roles
        move[2 * r.role, 2 * r.role + 1] += r.long
        move[2 * r.role + 1, 2 * r.role + 1] += r.stays
        if r.next is not None:
            move[2 * r.role + 1, 2 * r.next] += r.long
            move[2 * r.role, 2 * r.next] += r.rows - r.long
    heads = rows.where("at = 0").groupBy("role").count()
    for r in heads.collect():
        start[2 * r.role] += r["count"]
    return Model(start, move, show)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (ckey, part) from batches sorted by them."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ck, part = t.column("ckey").to_pylist(), t.column("part").to_numpy()
        cuts = [0, *(i for i in range(1, len(ck)) if ck[i] != ck[i - 1] or part[i] != part[i - 1]), len(ck)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = (ck[a], part[a])
            if key is not None and own != key:
                yield pa.concat_tables(held)
                held = []
            key = own
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _emissions(model: Model, t: pa.Table) -> np.ndarray:
    return model.emissions({k: t.column(k).to_numpy() for k in FEATURES})


def transfer(model: Model, show: np.ndarray) -> np.ndarray:
    """Best score from each state before the block to each state at its end."""
    m = model.move + show[0]
    for e in show[1:]:
        m = (m[:, :, None] + model.move[None]).max(1) + e
    return m


def best_path(model: Model, show: np.ndarray, entry: int, leave: int) -> list[int]:
    """The best states of a block between a state before it (-1: the start) and the state at its end."""
    score = (model.start if entry < 0 else model.move[entry]) + show[0]
    back = []
    for e in show[1:]:
        step = score[:, None] + model.move
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def chain(start: np.ndarray, matrices: np.ndarray, entry: int = -1, leave: int | None = None) -> list[tuple[int, int]]:
    """(entry, exit) state of each block, between the states before the first and at the end of the last; `start` has the scores of the first block's exits, entry -1 means the start distribution."""
    alpha = [start]
    for m in matrices[1:]:
        alpha.append((alpha[-1][:, None] + m).max(0))
    leave = int(alpha[-1].argmax()) if leave is None else leave
    out = []
    for k in range(len(matrices) - 1, 0, -1):
        before = int((alpha[k - 1] + matrices[k][:, leave]).argmax())
        out.append((before, leave))
        leave = before
    out.append((entry, leave))
    return out[::-1]


def _matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' matrices in order, and the first block's exits from the start."""
    k = len(STATES)
    return np.stack([np.frombuffer(x.as_buffer(), float).reshape(k, k) for x in table.column("inner")]), np.frombuffer(table.column("first")[0].as_buffer(), float)


def block_ends(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """(ckey, part, entry, leave) of each block. blocks: (ckey, part, inner, first), the parts of a conversation following each other."""
    most = most or CHAIN
    ends = "ckey string, part long, entry int, leave int"

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        inner, first = _matrices(table)
        if "entry" in table.column_names:
            entry, leave = table.column("entry")[0].as_py(), table.column("leave")[0].as_py()
            found = chain(first if entry < 0 else inner[0][entry], inner, entry, leave)
        else:
            found = chain(first, inner)
        return pa.table([table.column("ckey"), table.column("part"), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())], names=["ckey", "part", "entry", "leave"])

    def folded(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables)).sort_by("part")
        inner, opened = _matrices(table)
        whole = inner[0]
        for m in inner[1:]:
            whole = (whole[:, :, None] + m[None]).max(1)
            opened = (opened[:, None] + m).max(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([whole.tobytes()], pa.binary()), pa.array([opened.tobytes()], pa.binary())], names=["ckey", "part", "inner", "first"])

    longest = blocks.groupBy("ckey").count().agg(F.max("count")).first()[0]
    if longest is None or longest <= most:
        return blocks.groupBy("ckey").applyInArrow(chained, ends)
    dealt = blocks.withColumn("outer", F.floor(F.col("part") / most).cast("long"))
    above = written(dealt.groupBy("ckey", "outer").applyInArrow(folded, "ckey string, part long, inner binary, first binary"), "folded")
    states = written(block_ends(above, most).withColumnRenamed("part", "outer"), "outer")
    return dealt.join(states, ["ckey", "outer"]).groupBy("ckey", "outer").applyInArrow(chained, ends)


def recover_roles(narrow: DataFrame, model: Model, size: int = LINES) -> DataFrame:
    """(ckey, turn, thash, segment, said, from_line, n_lines): runs of one role in each row, by Viterbi over the conversation."""
    spark = narrow.sparkSession
    sent = spark.sparkContext.broadcast(model)
    n = partitions(spark)
    numbered = with_global_sums(narrow.withColumn("_n", F.size(F.split("text", "\n", -1))), [F.col("ckey"), F.col("turn"), F.col("thash")], {"_to": F.col("_n")})
    place = F.col("_to") - F.col("_n") + F.col("line")
    cut = F.floor((F.col("_to") - F.col("_n")) / size) != F.floor((F.col("_to") - 1) / size)
    lines = _lines(numbered, "_to", "_n").withColumns({"part": F.floor(place / size).cast("long"), "cut": cut}).drop("role", "_to", "_n")
    dealt = written(lines.repartition(n, "ckey", "part").sortWithinPartitions("ckey", "part", "turn", "thash", "line"), "lines")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        rows: list[tuple[str, int, bytes, bytes]] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["ckey", "part", "inner", "first"])

        for t in _groups(batches):
            show = _emissions(own, t)
            inner = transfer(own, show)
            opened = own.start + show[0]
            for e in show[1:]:
                opened = (opened[:, None] + own.move).max(0) + e
            rows.append((t.column("ckey")[0].as_py(), t.column("part")[0].as_py(), inner.tobytes(), opened.tobytes()))
            if len(rows) >= 2000:
                yield batch()
        yield batch()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["ckey", "turn", "thash", "segment", "said", "from_line", "n_lines", "cut"])

        for t in _groups(batches):
            entry = t.column("entry")[0].as_py()
            path = best_path(own, _emissions(own, t), entry, t.column("leave")[0].as_py())
            ck = t.column("ckey")[0].as_py()
            turn, thash, line = (t.column(c).to_pylist() for c in ("turn", "thash", "line"))
            split = t.column("cut").to_pylist()
            # a row that another block began goes on, as segment -1, unless a turn begins here
            begin, segment = 0, -1 if line[0] > 0 and (STATES[path[0]] == STATES[entry] or STATES[path[0]][1]) else 0
            for i in range(1, len(path) + 1):
                new_row = i == len(path) or (turn[i], thash[i]) != (turn[i - 1], thash[i - 1])
                if new_row or STATES[path[i]] != STATES[path[i - 1]] and not STATES[path[i]][1]:
                    rows.append((ck, turn[begin], thash[begin], segment, STATES[path[begin]][0], line[begin], i - begin, split[begin]))
                    begin, segment = i, 0 if new_row else segment + 1
            if len(rows) >= 2000:
                yield batch()
        yield batch()

    blocks = written(dealt.mapInArrow(matrices, "ckey string, part long, inner binary, first binary"), "blocks")
    # one row of a few hundred bytes for each `size` lines
    several = blocks.groupBy("ckey").agg(F.count("*").alias("n"))
    ends = blocks.join(several, "ckey")
    alone = ends.where("n = 1").mapInArrow(_single, "ckey string, part long, entry int, leave int")
    linked = block_ends(ends.where("n > 1").drop("n"))
    ready = dealt.join(written(alone.unionByName(linked), "ends"), ["ckey", "part"])
    ready = ready.repartition(n, "ckey", "part").sortWithinPartitions("ckey", "part", "turn", "thash", "line")
    found = written(ready.mapInArrow(decode, "ckey string, turn long, thash long, segment int, said int, from_line int, n_lines int, cut boolean"), "found")
    # the pieces of a row that lies in several blocks are put together
    row = ["ckey", "turn", "thash"]
    along = Window.partitionBy(*row).orderBy("from_line").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.where("cut").withColumn("segment", (F.sum((F.col("segment") >= 0).cast("int")).over(along) - 1).cast("int"))
    met = pieces.groupBy(*row, "segment").agg(F.min_by("said", "from_line").alias("said"), F.min("from_line").alias("from_line"), F.sum("n_lines").cast("int").alias("n_lines"))
    return found.where("not cut").drop("cut").unionByName(met)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exit states of conversations of one block."""
    for batch in batches:
        leave = [int(np.frombuffer(x.as_buffer(), float).argmax()) for x in batch.column("first")]
        yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("part"), pa.array([-1] * len(leave), pa.int32()), pa.array(leave, pa.int32())], names=["ckey", "part", "entry", "leave"])


def render(role: Column, text: Column) -> Column:
    """<|role|>, newline, the text without marker and outer white space, newline, <|end|>."""
    body = F.regexp_replace(F.regexp_replace(text, _MARKER, ""), r"^\s+|\s+$", "")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>"))


def parse_transcripts(turns: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", block_turns: int = LINES) -> DataFrame:
    """All columns of `turns` with segment, said (the recovered role) and rendered; a row that holds several speakers is several rows."""
    keyed = _keyed(turns, conv_col, turn_col, text_col, None)
    # written, so that a row repeated very often can be split in the join
    found = written(recover_roles(_narrow(keyed), model, block_turns), "roles")
    # a row's segments come as one array, so its text is carried and cut into lines once
    held = found.groupBy("ckey", "turn", "thash").agg(F.collect_list(F.struct("segment", "said", "from_line", "n_lines")).alias("found"))
    joined = keyed.drop("role").join(held, ["ckey", "turn", "thash"])
    name = F.array(*[F.lit(r) for r in ROLES])

    def shown(lines: Column) -> Column:
        def one(s: Column) -> Column:
            role = F.element_at(name, s["said"] + 1)
            return F.struct(s["segment"].alias("segment"), role.alias("said"), render(role, F.array_join(F.slice(lines, s["from_line"] + 1, s["n_lines"]), "\n")).alias("rendered"))

        return F.transform("found", one)

    made = ("segment", "said", "rendered")
    each = joined.select("row", F.explode(let(F.split("text", "\n", -1), shown)).alias("made"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in turns.columns if c not in made], *[F.col("made").getField(c).alias(c) for c in made])


def training_rows(turns: DataFrame, conv_col: str = "conv_id", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Conversations to learn from: crc32 of the id as text is not `held_out` modulo `modulus`."""
    return turns.where(crc_bucket(conv_col, modulus) != held_out)
