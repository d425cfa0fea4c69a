"""Toxicity by a weighted finite-state pattern grammar.

Five machines read the words of a clause as classes, and their product runs over it once. The insult machine marks what follows
an intensifier or another insult; the threat machine what follows a modal, future or causing word; the others what is negated,
reported or near a target. A verb of harm is a threat in its base form, in other forms ("killed") behind such a word only; a verb
of consequence ("pay") only behind one and a target ("make you pay"). A clause scores its matches by these circumstances, not its
words one by one. Insult stems and their weights, and the weight of each circumstance, are learned from labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, map_texts, windows, word_hashes
from .linear import sigmoid, smallest

#: The most labelled texts that the grammar is learned from.
SAMPLE = 8000
#: Stems of these lengths are tried; an insult needs so many different contexts, log-odds and evidence (count times log-odds).
STEMS, CONTEXTS, ODDS, EVIDENCE = (4, 5, 6, 7, 8), 5, 2.5, 14.0

# Word lists of the grammar's classes in four languages.
INSULTS = ("idiot idiots idiotic moron morons stupid scum loser losers pathetic worthless disgusting trash clown imbecile dumb "
           "idiotin dumm dummkopf trottel abschaum versager widerlich wertlos connard imbécile stupide ordure minable dégoûtant "
           "estúpido estúpida imbécil idiota escoria asqueroso inútil").split()
THREATS = "kill hurt destroy beat töten umbringen schlagen zerstören tuer frapper détruire matar golpear destruir".split()
HARM_STEMS = "kill hurt destroy beat murder stab smash töte getöte umbring umgebracht schlag geschlagen zerstör frapp détrui golpe destrui destruy".split()
CONSEQUENCES = "pay suffer regret bleed bezahlen büßen leiden bereuen payer souffrir regretter pagar sufrir lamentar".split()
MARKERS = ("will shall gonna going must should make i'll we'll werde werden wird wirst sollst muss lass vais allons va vas dois "
           "faire voy vamos vas debes haré").split()
INTENSIFIERS = "such so very really fucking total totally absolute complete piece so völlig total absolut tellement très vraiment muy tan totalmente".split()
TARGETS = ("you your yours he she they them him her those these people du dich dir ihr euch sie er ihn tu te toi vous ils elles "
           "elle lui eux tú ti usted ustedes ellos ellas él ella").split()
NEGATORS = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun nunca ningún ni sin".split()
SPEECH = ("said says called claims claimed wrote quoted alleged sagte nannte behauptete schrieb dit appelé écrit prétend "
          "dijo llamó escribió afirma").split()

CLASSES = 10
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, HARM, CONSEQUENCE, MARKER, INTENSIFIER = range(CLASSES)


@dataclass(frozen=True)
class Machine:
    """A finite-state machine over word classes: `step[state][class]` is the next state; `on` are its marked states."""

    step: tuple[tuple[int, ...], ...]
    on: frozenset[int]


def countdown(trigger: int | tuple[int, ...], reach: int) -> Machine:
    """Marked from a trigger word until `reach` words later."""
    triggers = trigger if isinstance(trigger, tuple) else (trigger,)
    rows = [[reach if c in triggers else max(0, s - 1) for c in range(CLASSES)] for s in range(reach + 1)]
    return Machine(tuple(map(tuple, rows)), frozenset(range(1, reach + 1)))


def latch(trigger: int) -> Machine:
    """Marked from a trigger word to the end of the clause."""
    return Machine((tuple(1 if c == trigger else 0 for c in range(CLASSES)), (1,) * CLASSES), frozenset({1}))


def compose(machines: tuple[Machine, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The product machine: next state by (state, class), and for each state a bit per machine that is marked."""
    states = list(product(*(range(len(m.step)) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    step = np.array([[number[tuple(m.step[x][c] for m, x in zip(machines, s, strict=True))] for c in range(CLASSES)] for s in states])
    marks = np.array([sum((x in m.on) << k for k, (m, x) in enumerate(zip(machines, s, strict=True))) for s in states])
    return step, marks


#: Negation reaches three words, a target five, an insult or intensifier three, a marker four; reported speech lasts to the end
#: of its clause. The bits of a mark, in this order.
GRAMMAR = compose((countdown(NEGATOR, 3), latch(REPORT), countdown(TARGET, 5), countdown((INSULT, INTENSIFIER), 3), countdown(MARKER, 4)))
NEGATED, REPORTED, TARGETED, PRESSED, INTENDED = (1 << k for k in range(5))
#: Features: a count for each kind of match in each of the first three circumstances, whether there is an insult, the heaviest
#: clause, pressed insults and intended threats.
N_FEATURES = 2 * 8 + 4

_LISTS = ((INTENSIFIER, INTENSIFIERS), (MARKER, MARKERS), (CONSEQUENCE, CONSEQUENCES), (TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORT, SPEECH), (THREAT, THREATS))
_FIXED = {w: c for c, words in _LISTS for w in words}
_HARM = {s[:3]: tuple(x for x in HARM_STEMS if x[:3] == s[:3]) for s in HARM_STEMS}
#: Letters that may follow the stem of a verb of harm.
_ENDING = 4
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass
class Lexicon:
    """Insult weights of whole words and of stems."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best


def word_class(word: str) -> int:
    """The class of a lower-cased word by the fixed lists and stems."""
    c = _FIXED.get(word)
    if c is not None:
        return c
    stems = _HARM.get(word[:3])
    if stems and any(word.startswith(x) and len(word) <= len(x) + _ENDING for x in stems):
        return HARM
    return NEGATOR if word.endswith("n't") else OTHER


def spelt(text: str) -> str:
    """The text in lower case and with one kind of apostrophe."""
    return text.lower().replace("\u2019", "'")


def clauses(text: str, lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each clause with a match: counts by kind and circumstance (bits: negated, reported, targeted), and its weight, the
    weight of its pressed insults and its number of intended threats."""
    step, marks = GRAMMAR
    low = spelt(text)
    kinds, weight = {}, {}
    for w in set(_WORD.findall(low)):
        c = word_class(w)
        if c != THREAT and (x := lexicon.weight(w)):
            kinds[w], weight[w] = INSULT, x
        elif c in (THREAT, HARM, CONSEQUENCE):
            kinds[w], weight[w] = c, 1.0
        elif c != OTHER:
            kinds[w] = c
    if not weight:
        return
    for clause in _CLAUSE.split(low):
        words = _WORD.findall(clause)
        if weight.keys().isdisjoint(words):
            continue
        classes = [kinds.get(w, OTHER) for w in words]
        counts, extra = np.zeros(16), np.zeros(3)
        for i, kind, seen in matches(classes, step, marks):
            x = weight[words[i]]
            more = seen & (PRESSED if kind == INSULT else INTENDED)
            counts[(kind - INSULT) * 8 + (seen & 7)] += x
            extra[0] += x * (0.4 if seen & NEGATED else 1) * (0.6 if seen & REPORTED else 1) * (1.3 if seen & TARGETED else 1) * (1.2 if more else 1)
            if more:
                extra[kind] += x
        if counts.any():
            yield counts, extra


def matches(classes: list[int], step: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, INSULT or THREAT, circumstances) of every match in a clause of word classes."""
    seen, states = [], 0
    for c in classes:
        seen.append(int(marks[states]))
        states = int(step[states, c])
    # A target after the match counts as well, so the clause is read in both directions.
    after, states = [0] * len(classes), 0
    for i in range(len(classes) - 1, -1, -1):
        after[i] = int(marks[states]) & TARGETED
        states = int(step[states, classes[i]])
    for i, c in enumerate(classes):
        told = seen[i] & (TARGETED | INTENDED)
        if c in (INSULT, THREAT):
            yield i, c, seen[i] | after[i]
        elif c == HARM and told & INTENDED or c == CONSEQUENCE and told == TARGETED | INTENDED:
            yield i, THREAT, seen[i] | after[i]


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Saturating sums of the clauses' counts, whether there is an insult, the heaviest clause, pressed insults, intended threats."""
    out = np.zeros(N_FEATURES)
    for counts, (total, pressed, intended) in clauses(text or "", lexicon):
        out[:16] += counts
        out[17] = max(out[17], total)
        out[18:] += pressed, intended
    out[16] = float(out[:8].sum() > 0)
    out[:16] = np.minimum(out[:16] / 10, 1)
    out[17:] = np.minimum(out[17:] / 10, 1)
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _forms(word: str) -> Iterator[str]:
    yield "=" + word
    for n in STEMS:
        if len(word) > n:
            yield "^" + word[:n]


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems that stand in many different contexts of toxic texts (rows of text, y) and in few others.

    A context is the pair of neighbouring words, so copies of a text are no evidence.
    """
    schema = "form string, context long"

    def toxic(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            found = set()
            for text in frame["text"]:
                words = _WORD.findall(spelt(text or ""))
                for before, w, after in zip(["", *words], words, [*words[1:], ""]):  # noqa: B905 - the first list is longer
                    context = hash_pair(before, after)
                    found.update((f, context) for f in _forms(w))
            yield pd.DataFrame(list(found), columns=["form", "context"])

    spread = rows.where("y = 1").select("text").mapInPandas(toxic, schema).groupBy("form").agg(F.countDistinct("context").alias("n"))
    count = {r["form"]: r["n"] for r in spread.where(F.col("n") >= CONTEXTS).collect()}
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(count))

    def other(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            met: dict[str, int] = {}
            for text in frame["text"]:
                for f in {f for w in set(_WORD.findall(spelt(text or ""))) for f in _forms(w)} & wanted.value:
                    met[f] = met.get(f, 0) + 1
            yield pd.DataFrame(list(met.items()), columns=["form", "n"])

    clean = {r["form"]: r["n"] for r in rows.where("y = 0").select("text").mapInPandas(other, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = (rows.where(F.col("y") == k).count() for k in (1, 0))
    words, stems = dict.fromkeys(INSULTS, 1.0), {}
    for form, n in sorted(count.items()):
        odds = np.log((n + 0.5) / (n1 + 1)) - np.log((clean.get(form, 0) + 0.5) / (n0 + 1))
        # Every text repeats its frequent words in many contexts: what clean texts hold as often is no insult.
        if odds >= ODDS and n * odds >= EVIDENCE and clean.get(form, 0) * 20 <= n:
            (words if form[0] == "=" else stems)[form[1:]] = float(min(odds, 8.0))
    return Lexicon(words, stems)


def hash_pair(a: str, b: str) -> int:
    raw = np.frombuffer(f"{a} {b}".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    cut = len(a.encode("utf-8", "surrogatepass"))
    h = word_hashes(raw, np.array([0, cut + 1]), np.array([cut, len(raw)]), lower=False)
    return int(windows(h, 2)[0] >> np.uint64(1))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the features and a bias, by Newton steps with a ridge."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(N_FEATURES), np.log(share / (1 - share)))
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.append(np.full(N_FEATURES, 0.3), 1e-3)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (p - y) + ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        move = np.linalg.solve(hessian, gradient)
        beta -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, texts) -> np.ndarray:
        x = np.stack([features(t, self.lexicon) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
        return sigmoid(x @ self.beta[:-1] + self.beta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled rows outside the held-out part, those of smallest hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").alias("y"))
    few = smallest(known, F.xxhash64("doc_id"), sample, known.count())
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y").persist()
    lexicon = learn_lexicon(rows)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            yield pd.DataFrame({"x": [features(t, shared.value).tolist() for t in frame["text"]], "y": frame["y"].to_numpy()})

    got = rows.mapInPandas(scan, "x array<double>, y int").toPandas()
    rows.unpersist()
    x = np.array(got["x"].tolist()).reshape(len(got), N_FEATURES)
    return Model(lexicon, fit(x, got["y"].to_numpy(dtype=float)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every row of `docs` (doc_id, text), learned from `labels` (doc_id, toxic).

    Returns doc_id, held_out, score (0 to 1) and predicted (1 where the score reaches 0.5). Null and empty texts and texts without
    a match get the score of no match. Without labels only the listed insults count, and scores lie under 0.5. Repeated rows and
    null ids are scored like any other; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = shared.value.score(frame["text"].to_numpy())
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy(), "score": score,
                "predicted": (score >= 0.5).astype(np.int32),
            })

    return map_texts(docs, scan, "held_out boolean, score double, predicted int", held_out().alias("held_out"))
