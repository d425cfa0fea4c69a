import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tremolite.llm import jaccard as jc
from tremolite.llm.common import read, shingle_set, shingle_sets
from tremolite.llm.components import components


def sets_of(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))
    links = [set() for _ in rows]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group[find(a)] = find(b)
            if sets[a] != sets[b]:
                links[a].add(frozenset(sets[b]))
                links[b].add(frozenset(sets[a]))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)], len(links[i])) for i, (d, _) in enumerate(rows)}


def answers(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()}


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    assert answers(jc.jaccard_join(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("long,block", [(256, 256), (4, 8)])
def test_near_copies(spark, monkeypatch, long, block):
    monkeypatch.setattr(jc, "LONG", long)
    monkeypatch.setattr(jc, "BLOCK", block)
    monkeypatch.setattr(jc, "FREQUENT", 3)
    rng = random.Random(long)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for d in range(260):
        if d % 3 and rows:
            w = (rng.choice(rows[-40:])[1] or "x").split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randint(1, 120))
            if rng.random() < 0.3:
                w += passage.split()
        rows.append((d, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a  B"), (1005, "a b c d e")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(5)
    assert answers(jc.jaccard_join(docs)) == brute(rows)


def test_null_ids_and_repeats(spark):
    t = " ".join(f"v{i}" for i in range(30))
    got = jc.jaccard_join(spark.createDataFrame([(None, t), (7, t), (7, t), (9, t + " z")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {7} and len(got) == 4
    assert jc.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_is_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 390), replace=False), rng.integers(0, 1 << 60, rng.integers(1, 60)).astype(np.uint64)])) for _ in range(60)]
    want = {(a, b) for a, b in combinations(range(60), 2) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - k)}
    assert set(jc.divide_skip(sets, sets, True)) == want and want


def test_long_lists_over_frames():
    jc_long = 10
    entries = pd.DataFrame([(s, f, 50) for s in range(6) for f in range(100, 100 + (25 if s % 2 else 4))], columns=["shingle", "fp", "n"])
    old, jc.LONG = jc.LONG, jc_long
    try:
        out = pd.concat(jc.merge_lists(iter([entries[i : i + 7] for i in range(0, len(entries), 7)])))
    finally:
        jc.LONG = old
    assert len(out[~out.tie]) == 3 * 6
    assert set(out[out.tie].b) == set(range(101, 125)) and set(out[out.tie].a) == {100}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_one_of_each_stays(spark, sf):
    docs = read(spark, sf, "documents")
    want = {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    kept = jc.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    t = " ".join(f"v{i}" for i in range(30))
    rows = [(None, t, 1), (7, t, 2), (7, t, 2), (9, t + " z", 3), (None, "one two", 4), (None, "one two", 4), (None, None, 5), (3, "", 6)]
    got = jc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(r["n"] for r in got) == [2, 4, 5, 6]


@pytest.mark.parametrize("chars", [1, 25, 10**6])
def test_sets_of_many_texts_are_those_of_each(chars):
    rng = random.Random(chars)
    texts = [None if rng.random() < 0.1 else "".join(rng.choices("ab C\n\té\udc80", k=rng.randint(0, 40))) for _ in range(300)]
    together = list(shingle_sets(texts, 5, chars))
    assert len(together) == 300 and all(np.array_equal(a, shingle_set(t)) for a, t in zip(together, texts, strict=True))
    assert list(shingle_sets([])) == []


def test_large_ids_beside_nulls_and_clashing_names(spark):
    one, two = "a b c d e f g h i j k", "l m n o p q r s t u v"
    rows = [(9007199254740993, one, 1, 2), (9007199254740995, one, 1, 2), (None, two, 1, 2), (9007199254740997, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp_ int, row_ int")
    got = {r["doc_id"]: r["component_id"] for r in jc.jaccard_join(docs).collect()}
    assert got == {9007199254740993: 9007199254740993, 9007199254740995: 9007199254740993, None: None, 9007199254740997: 9007199254740997}
    kept = jc.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {9007199254740993, None, 9007199254740997}
