import itertools
import zlib

import numpy as np
import pytest

from tremolite.llm import langid as li
from tremolite.llm.common import read


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    lengths, k = np.array([1, 4, 3]), 3
    emit, moves = rng.normal(size=(8, k)).astype(np.float32), rng.normal(size=(k, k))
    both, expected, log = li.forward_backward(emit, lengths, moves)
    want, pairs, total, at = np.zeros((8, k)), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        w = np.array([np.exp(sum(emit[at + i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        total += np.log(w.sum())
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(p):
                want[at + i, y] += x
            for a, b in itertools.pairwise(p):
                pairs[a, b] += x
        at += n
    assert np.allclose(both, want, atol=1e-5) and np.allclose(expected, pairs, atol=1e-5) and abs(log - total) < 1e-4


@pytest.fixture(scope="module")
def model(spark):
    return li.train(read(spark, "/root/testdata/sf0.01", "documents"), 60)


def test_code_switched_words(model):
    text = "und der die nicht the of thing with\nque los para"
    got = {w: lang for w, lang, _ in li.label_words(model, [text])[0]}
    assert [got[w] for w in ("und", "nicht", "the", "with", "los")] == ["de", "de", "en", "en", "es"]
    assert li.label_words(model, [None, ""]) == [[], []]


def test_held_out_accuracy(spark, model):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = li.identify(docs, model).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in truth}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, model):
    rows = [(None, None, "en"), (1, "", "en"), (2, "123 .. 45\n", None), (3, "the of the and", "de"), (3, "the of the and", "de"), ((1 << 60) + 1, "der " * 40_000, "x"), (4, "\0 ñ", "x")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in li.identify(docs, model).collect())
    assert [g for g in got if g[0] != 4] == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), ((1 << 60) + 1, "de")]
    assert li.identify(docs.limit(0)).count() == 0
    nothing = li.identify(docs.where("lang = 'none'"), li.fit([]))
    assert nothing.count() == 0 and li.judge(li.fit([]), ["the"])[0] == ["und"]


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
        + [(100, "² ³", "en"), (101, "½ ² ③ 7 _", None), (102, "ª", None), (103, "", None), (104, None, "fr")],
        "doc_id long, text string, lang string",
    )
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(docs).collect()}
    assert [got[i] for i in (100, 101, 103, 104)] == ["und"] * 4 and got[102] in ("en", "fr") and got[0] in ("en", "fr")
