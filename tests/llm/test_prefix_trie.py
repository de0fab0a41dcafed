"""The trie of conversations against a plain one of nested dictionaries, over shards of any size."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rillwave.llm.prefix_trie import Parentheses, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, m int, conv string"


def plain_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        talks[c].append((turn is not None, turn or 0, tie, role, text))
    talks = {c: [x[3:] for x in sorted(v)] for c, v in talks.items()}
    decimal = {c: "" if c is None else str(c) for c in talks}
    nodes = {}
    for c in sorted(talks, key=lambda c: (c is None, c or 0)):
        h = zlib.crc32(decimal[c].encode()) % 9
        first = [] if c is None else talks.get(c - int(np.fmod(c, 5)), [])
        path = tuple(first[:h] + talks[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], {"members": [], "ends": [], "children": set()})["members"].append(c)
            if d:
                nodes[path[: d - 1]]["children"].add(path[:d])
        nodes[path]["ends"].append(decimal[c])
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, v in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not v["children"]
            saved[k[:d]] += (len(v["members"]) - 1) * len(k[-1][1].encode()) if k else 0
    for k, v in nodes.items():
        above = nodes[k[:-1]]["members"][0] if k else None
        out.append((v["members"][0], len(k), above, len(v["members"]), len(v["children"]), leaves[k], saved[k], hashlib.sha256(",".join(v["ends"]).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, families=40):
    draw = random.Random(seed)
    openings = ["hello", "héllo", "", None]
    rows = []
    for c in [c for c in range(-7, families * 5) if draw.random() < 0.7] + [None]:
        for t in range(draw.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, draw.choice([t, t, t, None, 3]), draw.choice(["user", "assistant", None]), draw.choice(openings + [f"line {draw.randrange(3)}"])))
    # a conversation with a third of all rows, its twin in the same family, and rows given twice
    rows += [(15, t, "user", f"long {t % 7}") for t in range(len(rows))]
    rows += [r for r in rows if r[0] == 3] * 2
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 25), (2, 1 << 18)])
def test_trie_equals_nested_dictionaries(spark, seed, size):
    rows = talks(seed)
    df = spark.createDataFrame([(*r, "p", 1, "c") for r in rows], SCHEMA).repartition(5)
    got = prefix_trie(df, shard_size=size).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_trie(rows)


def test_no_rows_and_one_turnless_conversation(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # 6 takes its opening from 5, which is absent, and has fewer turns of its own than the opening
    c = next(c for c in range(6, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    (row,) = prefix_trie(spark.createDataFrame([(c, 0, "user", "x", "p", 1, "c")], SCHEMA)).collect()
    assert tuple(row)[:7] == (c, 0, None, 1, 0, 1, 0) and row.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


@pytest.mark.parametrize("pairs", [1, 5, 300, 5000])
def test_close_equals_a_stack(pairs):
    draw = random.Random(pairs)
    bits, depth, left = [], 0, pairs
    while left or depth:
        up = left and (not depth or draw.random() < 0.6)
        bits.append(bool(up))
        depth, left = depth + (1 if up else -1), left - bool(up)
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.flatnonzero(bits)
    assert Parentheses(np.array(bits)).close(opens).tolist() == [want[i] for i in opens.tolist()]
