"""The prefix trie against brute force on small tables, over many ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie

DDL = "conv_id bigint, turn bigint, role string, text string"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        yield p
        for k in kids[p]:
            yield from under(k)

    out = []
    for p, who in members.items():
        below = list(under(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _table(seed, convs, words, copies):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c * rng.choice([1, 7]) if t == 0 else rows[-1][0], rng.choice([t, None]) if rng.random() < 0.05 else t, rng.choice(["user", None, ""]), rng.choice(words)))
    rows = [(c, len(rows) if t is None and i % 2 else t, r, x) for i, (c, t, r, x) in enumerate(rows)]
    # a third of all conversations are alike, and have no turn of their family's
    for c in range(copies):
        rows += [(100_000 + c, 0, "user", "same"), (100_000 + c, 1, "assistant", "again")]
    return [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(q[0], q[1]) for q in rows[:i]}]  # ties of turn have a test of their own


@pytest.mark.parametrize("ranges", [1, 2, 5, 23])
def test_nodes_equal_brute_force_however_ranges_are_cut(spark, ranges):
    rows = _table(5, 150, ["a", "b", "", None, "a longer text with é and 😀", "c"], 80)
    keys = prefix_trie.rebuilt(spark.createDataFrame(rows, DDL))
    assert _rows(prefix_trie.trie(keys, ranges)) == _brute(rows)


def test_a_long_conversation_and_its_copies_cross_ranges(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 280 or c < 7 else f"turn {t} of {c}") for c in range(12) for t in range(300)]
    keys = prefix_trie.rebuilt(spark.createDataFrame(rows, DDL))
    assert _rows(prefix_trie.trie(keys, 5)) == _brute(rows)


def test_nulls_ties_repeats_extra_columns_and_none(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 3, "user", "x"), (1, 3, "user", "x"), (-3, 0, "user", "x"), (200, 0, "a", "b"), (205, 5, "q", "r")]
    df = spark.createDataFrame([(*r, 1, b"k", 2) for r in rows], DDL + ", part int, key binary, pid int")
    assert _rows(prefix_trie.prefix_trie(df)) == _brute(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], DDL)).collect() == []
    # turns of equal number: the order is by token, whatever the order of rows
    tied = [(7, 0, "user", str(i)) for i in range(5)]
    one, two = (_rows(prefix_trie.prefix_trie(spark.createDataFrame(r, DDL))) for r in (tied, tied[::-1]))
    assert one == two and len(one) == len(_brute(tied))
