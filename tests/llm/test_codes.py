"""Vector codes against a plain search over all entries in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from tremolite.llm.codes import Slices, compress_vectors, decode, encode, kept_vectors, limbs, train, whole

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, entries=256, rounds=4):
    """Codes, errors and codebooks by exhaustive search; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(4)]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows[k][1]))
    books = [[parts[p][k] for k in order[:entries]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p: [min((dist(x, c), e) for e, c in enumerate(books[p])) for x in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            found = near(p)
            for e in range(len(books[p])):
                own = [x for x, (_, at) in zip(parts[p], found, strict=True) if at == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [near(p) for p in range(4)]
    codes = ["".join(f"{found[p][k][1]:02x}" for p in range(4)) for k in range(len(kept))]
    errors = [sum(found[p][k][0] for p in range(4)) for k in range(len(kept))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, y) for (i, _, y), c, e in zip(kept, codes, errors, strict=True)], sha


def compare(spark, rows):
    got = compress_vectors(spark.createDataFrame([(*r, "own column") for r in rows], SCHEMA)).collect()
    want, sha = brute(rows)
    assert sorted(((r["vec_id"], r["code"], min(r["error"], 2**63 - 1)) for r in got), key=str) == sorted(((i, c, e) for i, c, e, _ in want), key=str)
    assert {r["codebooks_sha256"] for r in got} == {sha}
    by = {}
    for _, _, e, y in want:
        by[y] = by.get(y, 0) + e
    assert sorted(r["label_error"] for r in got) == sorted(by[y] for *_, y in want)


def test_against_exhaustive_search(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16)], int(i % 5) if i % 7 else None) for i in rng.permutation(420)]
    rows += [(1000 + i, [0.25] * 16, 1) for i in range(40)]
    compare(spark, rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (1, [1.0] * 8, None), (None, [-0.0001] * 8, None), (2, [0.5] * 8, 1), (9007199254740993, [0.5] * 8, 2)]
    odd = [(5, None, 1), (6, [0.0] * 7 + [None], 1), (7, [float("nan")] + [0.0] * 7, 1), (8, [0.0] * 7 + [float("-inf")], None)]
    compare(spark, rows + odd)


def test_few_large_and_no_vectors(spark):
    compare(spark, [(1, [0.1, 0.2, 0.3, 0.4], None)])
    big = [(i, [float(3 * i) * 1e30, -2e20, 0.001 * i, 5e15], 0) for i in range(3)]
    got = compress_vectors(spark.createDataFrame([(*r, "") for r in big], SCHEMA)).collect()
    assert [r["error"] for r in got] == [0, 0, 0] and len({r["code"] for r in got}) == 3
    assert compress_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0
    empty = compress_vectors(spark.createDataFrame([(1, [], 1, ""), (2, [], None, "")], SCHEMA)).collect()
    assert [(r["code"], r["error"]) for r in empty] == [("00000000", 0)] * 2
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, [1.0] * 6, 1, "")], SCHEMA)).collect()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_masks_hold_all_entries_inside_the_cube(kind):
    rng = np.random.default_rng(2)
    book = rng.integers(-40, 40, (130, 5)).astype(kind)
    x = rng.integers(-50, 50, (300, 5)).astype(kind)
    s = Slices(book)
    r = s.radius(x)
    masks = s.candidates(x, r)
    for i in range(len(x)):
        inside = {e for e in range(130) if all(abs(int(a) - int(b)) <= int(r[i]) for a, b in zip(x[i], book[e], strict=True))}
        assert inside == {e for e in range(130) if int(masks[i, e >> 6]) >> (e & 63) & 1}
    code, error = s.nearest(x)
    for i in range(len(x)):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e, strict=True)) for e in book]
        assert (int(error[i]), int(code[i])) == (min(d), d.index(min(d)))


def test_whole_numbers():
    assert whole(np.array([[-0.0001, 0.9999]])).tolist() == [[-1, 1023]]
    assert whole(np.array([[1e30, -1.0]])).tolist() == [[int(1e30) * 1024, -1024]]
    for v in (0, -1, 1 << 40, -(1 << 90) + 5, 1 << 139):
        assert sum(x << 32 * k for k, x in limbs(v)) == v


def test_codes_can_be_read_back(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    kept = kept_vectors(vectors)
    books = train(kept, 1)
    rows = decode(encode(kept, books), books).join(kept.select("vec_id", "embedding"), "vec_id").collect()
    for r in rows:
        assert r["error"] == sum((math.floor(1024 * x) - y) ** 2 for x, y in zip(r["embedding"], r["approximate"], strict=True))
