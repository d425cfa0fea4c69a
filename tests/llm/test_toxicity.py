import zlib

import numpy as np

from tremolite.llm import toxicity as tx
from tremolite.llm.common import read

LEX = tx.Lexicon({"idiot": 4.0}, {"lowei": 5.0})


def marks(text):
    """Circumstances of the matches in a text, one string of letters each."""
    out = []
    for counts, _ in tx.clauses(text, LEX):
        for k in np.flatnonzero(counts):
            out.append("IT"[k // 8] + "".join(c for b, c in enumerate("nrt") if k % 8 >> b & 1))
    return out


def test_grammar():
    assert marks("Something idiot.") == ["I"]
    assert marks("you are an idiot") == ["It"] and marks("an idiot, you") == ["It"]
    assert marks("This is not an idiot") == ["In"] and marks("not in any way that idiot") == ["I"]
    assert marks("He said idiot") == ["Irt"] and marks("someone said: maybe idiot. idiot") == ["Ir", "I"]
    assert marks("loweixyz here") == ["I"] and marks("lowei here") == []
    assert marks("I will kill you") == ["Tt"] and marks("nothing to see") == []


def test_product_machine_is_the_machines_side_by_side():
    machines = (tx.countdown(tx.NEGATOR, 3), tx.latch(tx.REPORT), tx.countdown(tx.TARGET, 5))
    step, on = tx.compose(machines)
    rng = np.random.default_rng(1)
    state, alone = 0, [0, 0, 0]
    for c in rng.integers(0, 6, 2000):
        state, alone = step[state, c], [m.step[x][c] for m, x in zip(machines, alone, strict=True)]
        assert on[state] == sum((x in m.on) << k for k, (m, x) in enumerate(zip(machines, alone, strict=True)))


def test_clauses_add_up(spark):
    one = tx.features("You idiot.", LEX)
    assert (tx.features("You idiot. You idiot.", LEX)[:16] >= one[:16]).all() and not tx.features(None, LEX).any()


def test_held_out_accuracy(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = tx.train(docs, labels, sample=2500)
    rows = docs.join(labels, "doc_id").where(tx.held_out()).select("text", "toxic").toPandas()
    got, truth = model.score(rows["text"].to_numpy()) >= 0.5, rows["toxic"].to_numpy() == 1
    assert (got == truth).mean() > 0.97 and (got & ~truth).sum() <= 0.01 * (~truth).sum() and got[truth].mean() > 0.8


def test_rows(spark, sf):
    rows = [(None, None, 1), (1, "", 1), (5, "you idiot", 1), (5, "you idiot", 1), (7, "fine words " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, none).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in (1, 5, 7)}
    assert tx.score_toxicity(docs.limit(0), none).count() == 0


def test_threats_of_several_words():
    assert marks("they will be killed") == ["Tt"] and marks("she was killed there") == []
    assert marks("I\u2019ll make you pay") == ["Tt"] and marks("I will pay the bill") == [] and marks("you pay well") == []
    assert marks("I don\u2019t kill flies") == ["Tn"] and marks("we are not gonna hurt anyone") == ["Tn"]
    assert marks("he claims they must be destroyed") == ["Trt"] and marks("the beatles will play") == []


def test_clauses_match_plain_windows():
    """Circumstances of every match of random clauses, by looking at the words around it."""
    rng = np.random.default_rng(3)
    step, on = tx.GRAMMAR
    for _ in range(400):
        c = rng.integers(0, tx.CLASSES, rng.integers(0, 25)).tolist()
        near = lambda i, reach, *kinds: any(x in kinds for x in c[max(0, i - reach) : i])  # noqa: B023, E731
        want = []
        for i, x in enumerate(c):
            before, intended = near(i, 5, tx.TARGET), near(i, 4, tx.MARKER)
            bits = [near(i, 3, tx.NEGATOR), near(i, i, tx.REPORT), before or tx.TARGET in c[i + 1 : i + 6], near(i, 3, tx.INSULT, tx.INTENSIFIER), intended]
            if x in (tx.INSULT, tx.THREAT) or x == tx.HARM and intended or x == tx.CONSEQUENCE and intended and before:
                want.append((i, tx.INSULT if x == tx.INSULT else tx.THREAT, sum(b << k for k, b in enumerate(bits))))
        assert list(tx.matches(c, step, on)) == want
