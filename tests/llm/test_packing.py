import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tremolite.llm import packing as pk
from tremolite.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")
IDS = pk.WordIds(PATH)


def direct(text):
    return IDS.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aBéÀß'’st19.,!?-_ \n\t\x0b\x1c ́İΣ<|endoftext|>", max_size=40)))
def test_word_ids_are_the_tokenizers(text):
    assert np.frombuffer(IDS.of(text), dtype="<u4").tolist() == direct(text)


def check(rows, docs, capacity):
    want = []
    for doc_id, text in docs:
        ids = direct(text or "") + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            p = np.array(ids[a : a + capacity], dtype="<u4")
            want.append((doc_id, k, a, len(p), zlib.crc32(p.tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held), -(-sum(w[3] for w in want) // capacity)


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    used, bound = check(pk.pack_documents(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert used <= 1.05 * bound


def test_many_chunks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pk, "CHUNK", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "the", "house", "on"], k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(None, None), (None, None), (5, ""), (5, " \n "), (7, "a " * 1000), (8, "a " * 31), (8, "a " * 31)]
    used, bound = check(pk.pack_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, uid int"), PATH, 32 * 2).collect(), rows, 64)
    assert used <= 1.1 * bound + 1
    assert pk.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_evolution_keeps_every_piece_and_never_loses_to_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(20, 900) for _ in range(300)]
    plain = pk.fresh(sizes, 1000, rng, 0.0)
    best = pk.evolve(sizes, 1000, [], rng)
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in best) and len(best) <= len(plain)
    child = pk.crossover(plain, best, sizes, 1000, rng)
    assert sorted(i for b in child for i in b) == list(range(300)) and pk.bins_of(pk.genome(best, 300)) == [sorted(b) for b in best]
