import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tremolite.llm import linear, quality_rules as qr, weak_labels as wl
from tremolite.llm.common import read


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    met = Counter(three)
    hit = {i + k for i, t in enumerate(three) if met[t] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", " ", "  ", "\n", "\x0b", "\x85", "𝄞", "a b a b", "c c c\n"]), max_size=40).map("".join))
def test_counts(text):
    assert qr.counts(text) == slow(text)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return read(spark, d, "documents"), read(spark, d, "labels")


def test_rules_on_a_whole_table(tables):
    docs, labels = tables
    rows = {r["doc_id"]: r for r in qr.quality_rules(docs, labels, sample=300).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == slow(r["text"])
        assert got["base_failed"] == (got["n_words"] < 50 or 100 * got["n_repeat_words"] > 50 * got["n_words"])
    judged = [(rows[d]["kept"], bool(q)) for d, q in truth.items() if not rows[d]["base_failed"]]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert np.mean([rows[d]["kept"] for d, q in truth.items() if q and not rows[d]["base_failed"]]) > 0.98


def test_weak_labels_agree_with_true_ones(tables):
    docs, labels = tables
    rows = {r["doc_id"]: r for r in wl.classify(docs, sample=600).collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: bool(r["quality"]) for r in labels.collect()}
    assert np.mean([rows[d]["kept"] == q for d, q in truth.items()]) > 0.95
    assert np.mean([rows[d]["kept"] for d, q in truth.items() if q]) > 0.98
    kept = wl.keep_good(docs, sample=600)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in rows.items() if r["kept"]}


def test_estimate_finds_the_unreliable_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.9, 0.5, 0.85, 0.8, 0.9, 0.6, 0.7]
    says = [np.where(rng.random(len(truth)) < p, truth, ~truth) for p in right]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 1, np.where(s, 2, 0)) for s in says])
    value, where, n = np.unique((votes.T * wl._PLACES[: len(right)]).sum(axis=1), return_inverse=True, return_counts=True)
    post = wl.estimate(value, n.astype(float))[where]
    assert ((post > 0.5) == truth).mean() > 0.96


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 50_000)
    y = (rng.random(len(z)) < linear.sigmoid(0.5 * z - 1)).astype(float)
    a, b = linear.calibrate(z, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "word " * 50_000, 1), ((1 << 62) + 1, "one two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qr.quality_rules(docs, none).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 0, False), (1, 0, False), (1, 0, False), (2, 50_000, False), ((1 << 62) + 1, 2, False)]
    assert wl.classify(docs).count() == 5 and wl.keep_good(docs).columns == docs.columns
    assert qr.quality_rules(docs.limit(0), none).count() == 0 and wl.classify(docs.limit(0)).count() == 0
