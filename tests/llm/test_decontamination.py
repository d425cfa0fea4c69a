import random
import time

import numpy as np
import pytest

from tremolite.llm import decontamination as dc
from tremolite.llm.common import read


def distance(window, text):
    """Edits from the window to the closest stretch of the text, by the whole table."""
    code, ramp = np.array([*map(ord, text)], dtype=np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(window):
        new = np.append(i + 1, np.minimum(row[:-1] + (code != ord(c)), row[1:] + 1))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def edited(text, n, rng, letters="abcdefghij é"):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [rng.choice(letters)], [t[k], rng.choice(letters)]])
    return "".join(t)


@pytest.mark.parametrize("seed", range(12))
def test_filter_and_alignment_lose_nothing(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    items = [dc.plain(" ".join(word() for _ in range(rng.choice([9, 20, 60])))) for _ in range(8)]
    index = dc.Index(list(range(8)), items)
    for _ in range(12):
        k = rng.randrange(8)
        w = min(dc.WINDOW, len(items[k]))
        a = rng.randint(0, len(items[k]) - w)
        text = dc.plain(" ".join(word() for _ in range(50)) + " " + edited(items[k][a : a + w], rng.randint(0, 12), rng) + " " + " ".join(word() for _ in range(30)))
        found = index.matches(text)
        for i in range(8):
            least = [distance(x, text) - dc.edits(len(x)) for _, x in index.windows(i)]
            assert (i in found) == (min(least) <= 0)
            if i in found:
                n, x, y = found[i]
                assert n == min(distance(win, text[max(0, x) : y]) for _, win in index.windows(i))


def test_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        window = "".join(rng.choices("abcd", k=rng.randint(5, 30)))
        text = "".join(rng.choices("abcd", k=rng.randint(0, 10))) + edited(window, rng.randint(0, 5), rng, "abcd") + "".join(rng.choices("abcd", k=rng.randint(0, 10)))
        got = dc.align(window, text, 0, len(text), 6)
        want = distance(window, text)
        assert (got is None) == (want > 6)
        if got:
            assert got[0] == want == distance(window, text[max(got[1], 0) : got[2]])


def test_whole_table(spark, sf):
    docs, bench = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_contamination(docs, bench).collect()}
    items = [(r["item_id"], dc.plain(r["text"])) for r in bench.collect()]
    rows = docs.collect()
    held = {(r["doc_id"], i) for r in rows for i, t in items if t in dc.plain(r["text"])}
    assert held and held <= got
    kept = {r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in rows} - {d for d, _ in got}


def test_odd_rows_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    item = "The quick brown Fox jumps over the lazy dog and runs away from the big bad wolf again."
    other = "completely different words stand here in this second item of the benchmark, or not"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "yes"), (5, ""), (None, item)], "item_id long, text string")
    text = "Intro\n\n" + item.upper().replace(" ", " \t").replace("LAZY", "LASY") + " end"
    rows = [(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (None, other, 0), (5, "oh yes, yes indeed", 0), (7, "eyes yesterday", 0), (6, "é" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = dc.find_contamination(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1, r["edits"]) for r in got) == [(-1, 2, 0), (1, -1, 1), (1, -1, 1), (1, 1, 1), (1, 1, 1), (5, 4, 0)]
    hit = next(r for r in got if r["item_id"] == 1)
    assert dc.plain(text[hit["start"] : hit["end"]]) == dc.plain(item).replace("lazy", "lasy")
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()) == [2, 3, 6, 7]
    assert dc.find_contamination(docs, bench.limit(0)).count() == 0 and dc.drop_contaminated(docs, bench.limit(0)).count() == 8


def test_grams_fold_characters_evenly():
    assert (dc.grams("xxabcdefgé")[2] == dc.grams("abcdefgé")[0]) and len(np.unique(dc.grams("abcdefghijk"))) == 4


def test_windows_count_wherever_they_begin():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    some = lambda n: "".join(rng.choices("vwxyz ", k=n))
    item = dc.plain(" ".join(word() for _ in range(80)))[:300]
    index = dc.Index([0], [item])
    for a in range(len(item) - 99):
        found = index.matches(f"{some(30)}{item[a : a + 100]}{some(30)}")
        assert found[0][0] == 0
    for _ in range(6):
        a = rng.randint(0, 60)
        text = some(20) + edited(item[a : a + 100], rng.randint(4, 10), rng) + some(20)
        want = min(distance(item[b : b + 100], text) for b in range(max(0, a - 12), a + 13))
        found = index.matches(text)
        assert (0 in found) == (want <= 8) and (want > 8 or found[0][0] == want)


def test_one_row_per_item_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 600)
    monkeypatch.setattr(dc, "PART_CHARS", 300)
    rng = random.Random(5)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300))
    docs = spark.createDataFrame([(9007199254740993, f"x {item} y"), (9007199254740993, f"x {item} y"), (None, f"z {item[500:700]}")], "doc_id long, text string")
    got = dc.find_contamination(docs, spark.createDataFrame([(9007199254740995, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["edits"]) for r in got) == [(-1, 9007199254740995, 0)] + [(9007199254740993, 9007199254740995, 0)] * 2


def test_long_white_space_hides_no_window(spark, monkeypatch):
    monkeypatch.setattr(dc, "PART_CHARS", 300)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    item = " ".join(words[:47]) + " " * 900 + " ".join(words[47:])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 25])) for k in range(95)], "doc_id long, text string")
    got = dc.find_contamination(docs, bench).collect()
    assert {r["doc_id"] for r in got} == set(range(95)) and {r["edits"] for r in got} == {0}


def test_repetition_ends_soon():
    index = dc.Index([1, 2, 3], ["-" * 300, "ab" * 60 + " and something else altogether", "no"])
    t0 = time.monotonic()
    found = index.matches("-" * 1_000_000 + " no " + "ab" * 200_000)
    assert {i: n for i, (n, *_) in found.items()} == {0: 0, 1: 0, 2: 0} and time.monotonic() - t0 < 20


@pytest.mark.parametrize("hits", [40, 500])
def test_slices_lose_nothing(monkeypatch, hits):
    rng = random.Random(hits)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 4)))
    items = [dc.plain(" ".join(word() for _ in range(60))) for _ in range(6)]
    texts = [" ".join(word() for _ in range(40)) + " " + edited(rng.choice(items)[:100], rng.randint(0, 9), rng) + " " + rng.choice(items)[40:] for _ in range(10)]
    whole = [dc.Index(list(range(6)), items).matches(dc.plain(t)) for t in texts]
    monkeypatch.setattr(dc, "HITS", hits)
    for t, want in zip(texts, whole, strict=True):
        got = dc.Index(list(range(6)), items).matches(dc.plain(t))
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
