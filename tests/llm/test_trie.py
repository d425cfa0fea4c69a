"""The prefix trie against one built from dictionaries, at several band heights."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tremolite.llm.trie import conversation_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(talks.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def below(top):
        todo, leaves, saved = [top], 0, 0
        while todo:
            node = todo.pop()
            todo += children[node]
            leaves += not children[node]
            saved += (len(members[node]) - 1) * len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if built[c] == node)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def compare(spark, rows, height=16):
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), height)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def talks(n, depth, seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"]) if r.random() < 0.2 else "user", r.choice(["a b", "a  c\n", "d"])) for c in range(n) for t in range(r.randrange(1, depth))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_against_dictionaries(spark, height):
    compare(spark, talks(60, 14, height), height)


def test_deep_talk_needs_few_bands(spark):
    compare(spark, [(20, t, "user", f"turn {t // 2}") for t in range(300)] + [(40, t, "user", f"turn {t // 2}") for t in range(290)], 4)


def test_nulls_ties_repeated_rows_and_turnless_talks(spark):
    rows = [
        (0, None, None, "first"), (0, 0, "user", None), (0, 0, "user", ""), (0, 5, "user", "x"), (0, 5, "user", "x"), (1, 2, "user", "alone"),
        (21, 1, "user", "no base"), (22, 1, "user", "no base"), (23, 0, "u", "q"), (None, 0, "user", "no id"), (None, 1, "user", "no id"),
        (9007199254740993, 0, "user", "w " * 50_000), (9007199254740995, 0, "user", "w " * 50_000), (-7, 0, "user", "below zero"), (-20, 0, "user", "base below zero"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    compare(spark, rows)
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_copies_of_one_talk(spark):
    """Ids of one end node fill several chunks of the digest."""
    compare(spark, [(c, t, "user", f"t{t}") for c in range(1200) for t in range(4)])


def test_extra_columns_are_ignored(spark):
    rows = talks(12, 5, 9)
    plain = spark.createDataFrame(rows, SCHEMA)
    more = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", depth int, p1 string, part int")
    assert sorted(map(str, conversation_trie(plain).collect())) == sorted(map(str, conversation_trie(more).collect()))


def test_paths_are_bound_to_their_conversation(spark):
    rows = rebuilt(spark.createDataFrame(talks(40, 6, 1), SCHEMA)).collect()
    keys = {(r["depth"], r["p1"], r["p2"]) for r in rows}
    assert all((r["depth"] - 1, r["q1"], r["q2"]) in keys for r in rows if r["depth"])
