"""Mixing sources: targets against exact fractions, copies against the stated coin, edge rows."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest

from tremolite.llm.mixing import emit_mix, mix_documents, plan_mix, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes):
    """Targets by source in exact fractions, sharing anew until none is above three times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = Fraction(sum(sizes.values()) - sum(fixed.values()))
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10},
        {"a": 1, "b": 1000, "c": 5, None: 7},
        {"a": 1, "b": 2, "c": 3, "d": 400, "e": 50, "f": 6000, "é": 9, "Z": 0},
        {"a": 0, "b": 0},
        {None: 12},
        {f"s{i}": 3**i for i in range(12)},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert got[s] == pytest.approx(float(t), rel=1e-12, abs=1e-12) and got[s] <= 3 * sizes[s]
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


ROWS = [
    (1, "one two three", "en", "a", 13), (2, None, "en", "a", None), (3, "", None, "a", 0), (4, " \t\n\v\f\r", "en", "a", 6),
    (9007199254740993, "x y z", "en", "b", 5), (None, "no id here", "en", "b", 10), (None, "no id there", "en", "b", 11),
    (7, "same row twice", "en", None, 14), (7, "same row twice", "en", None, 14), (8, "w " * 200_000, "en", "c", 400_000), (10, None, None, "empty", None),
]


def test_copies_follow_the_coin(spark):
    got = plan_mix(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    words = lambda t: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w])
    by = Counter()
    for _, text, _, source, _ in ROWS:
        by[source] += words(text)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, words(t)) for d, t, *_ in ROWS)
    texts = {d: t for d, t, *_ in ROWS if d is not None}
    for r in got:
        assert r["source_size"] == by[r["source"]]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        if r["doc_id"] is not None:
            toss = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
            assert r["copies"] == int(rate) + (toss < rate - int(rate)), texts[r["doc_id"]]
        assert 0 <= r["copies"] <= 3


def test_whole_table_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mix_documents(docs).collect()
    taken, target, spread = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        p = (r["target"] / r["source_size"]) % 1
        spread[r["source"]] += r["size"] ** 2 * p * (1 - p)
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 5 * spread[s] ** 0.5 + 1e-6 for s, t in target.items())
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.05)
    again = mix_documents(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_emitted_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 4}", i, "m") for i in range(200)], "doc_id long, text string, source string, mix_rate int, MIX_KEY string")
    out = emit_mix(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in plan_mix(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_documents(none).count() == 0 and emit_mix(none).count() == 0
