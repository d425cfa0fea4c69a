"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of all vote patterns
(at most 3 ** len(LABELLERS), whatever the corpus) estimates how each labeller votes on good and on bad texts, and thereby a
posterior for each pattern. The posteriors label a bounded sample, on which a hashed linear scorer is trained; it scores all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import linear
from .common import Prepared, bounded, keep_rows, map_texts, prepare
from .quality_rules import counts

#: Texts of fewer words are too short for the labellers that need a share of words.
ENOUGH = 30
THRESHOLD = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "#*$%&|<>~^_=+\\@"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?\"')"]] = True


def measures(text: str | Prepared | None) -> dict[str, float]:
    p = prepare(text)
    raw, starts, ends, h = p.raw, p.starts, p.ends, p.hashes
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = counts(p)
    n = max(1, n_words)
    upper = ((raw >= 65) & (raw <= 90)).sum()
    letters = _LETTER[raw].sum()
    signs = np.concatenate([[0], np.cumsum(_SIGN[raw])])
    # A plain end is a letter or digit, or one mark after a letter or digit.
    last = raw[ends - 1] if n_words else raw[:0]
    before = raw[np.maximum(ends - 2, starts)] if n_words else raw[:0]
    solid = _LETTER | ((np.arange(256) >= 48) & (np.arange(256) < 58))
    plain = solid[last] | (_STOP[last] & solid[before])
    return {
        "pairs": len(np.unique(p.pairs)) / max(1, n_words - 1),
        "words": n_words, "symbols": n_symbols / n, "repeated": n_repeat / n, "upper": upper / max(1, letters),
        "variety": len(np.unique(h)) / n, "letters": letters / max(1, (raw > 32).sum()),
        "signed": (signs[ends] > signs[starts]).sum() / n if n_words else 0.0, "plain": plain.sum() / n,
        "lines": n_dup_lines / max(1, p.text.count("\n") + 1),
    }


def _vote(good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


#: Each votes 1 (good), -1 (bad) or 0 (nothing) on the measures of a text.
LABELLERS = {
    "few symbols": lambda m: _vote(m["symbols"] < 0.03, m["symbols"] > 0.1),
    "unsigned words": lambda m: _vote(m["signed"] < 0.05, m["signed"] > 0.15),
    "mostly letters": lambda m: _vote(m["letters"] > 0.9, m["letters"] < 0.87) if m["words"] >= ENOUGH else 0,
    "plain ends": lambda m: _vote(m["plain"] > 0.9, m["plain"] < 0.8) if m["words"] >= ENOUGH else 0,
    "little repetition": lambda m: _vote(m["repeated"] < 0.3, m["repeated"] > 0.5) if m["words"] >= ENOUGH else 0,
    "rich words": lambda m: _vote(m["variety"] > 0.35, m["variety"] < 0.2) if ENOUGH <= m["words"] < 2000 else 0,
    "fresh pairs": lambda m: _vote(m["pairs"] > 0.7, m["pairs"] < 0.5) if ENOUGH <= m["words"] else 0,
    "mixed case": lambda m: _vote(m["upper"] < 0.15, m["upper"] > 0.4),
    "fresh lines": lambda m: _vote(m["lines"] < 0.1, m["lines"] > 0.4),
}
_PLACES = 3 ** np.arange(len(LABELLERS))


def pattern(text: str | Prepared | None) -> int:
    """All votes on a text as one number, base 3."""
    m = measures(text)
    return int(sum((f(m) + 1) * p for f, p in zip(LABELLERS.values(), _PLACES.tolist(), strict=True)))


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of `good` for each pattern, by expectation-maximisation; starts from the bad votes, as a text
    needs one defect only to be bad: one leaves it open, two speak against it."""
    votes = patterns[:, None] // _PLACES % 3
    post = 1 / (1 + np.exp(1.5 * ((votes == 0).sum(axis=1) - 1)))
    total = weights.sum()
    for _ in range(rounds):
        logs = []
        for p in (1 - post, post):
            mass = weights * p
            log = np.log((mass.sum() + 1) / (total + 2))
            for k in range(votes.shape[1]):
                share = np.bincount(votes[:, k], weights=mass, minlength=3) + 1
                share[1] = 0  # no vote says nothing
                log = log + np.log(np.where(share > 0, share / share.sum(), 1))[votes[:, k]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return new


def posteriors(docs: DataFrame) -> dict[int, float]:
    """Pattern to posterior, from the pattern counts of all rows."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            value, n = np.unique([pattern(t) for t in frame["text"]], return_counts=True)
            yield pd.DataFrame({"pattern": value, "n": n})

    rows = docs.select("text").mapInPandas(scan, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return {}
    value = np.array(sorted((r["pattern"], r["n"]) for r in rows))
    return dict(zip(value[:, 0].tolist(), estimate(value[:, 0], value[:, 1].astype(float)).tolist(), strict=True))


def train(docs: DataFrame, sample: int = linear.SAMPLE) -> tuple[linear.Scorer, dict[int, float]]:
    """The scorer, fitted on posteriors of at most `sample` rows (those of smallest hash), and the posteriors."""
    post = posteriors(docs)
    n = docs.count()
    rows = linear.smallest(docs.select("doc_id", "text"), F.xxhash64("doc_id", "text"), sample, n)
    shared = docs.sparkSession.sparkContext.broadcast(post)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            frame = frame[["text", "_order"]]
            yield frame.assign(y=[shared.value.get(pattern(t), 0.5) for t in frame["text"]])

    labelled = rows.select("text", "_order").mapInPandas(label, "text string, _order long, y double")
    return linear.fit(*linear.collect_features(labelled)), post


def classify(docs: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """Quality of every row of `docs` (doc_id, text), learned without labels.

    Returns doc_id, posterior (of the votes), score (of the trained scorer, 0 to 1) and kept (score >= THRESHOLD). Null and empty
    texts get the score of a text without any feature. Repeated rows and null ids are judged like any other; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, post = shared.value
        for frame in frames:
            score, votes = linear.judged(scorer, frame["text"], pattern)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(), "posterior": [post.get(v, 0.5) for v in votes], "score": score, "kept": score >= THRESHOLD,
            })

    return map_texts(docs, scan, "posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """The rows of `docs` that `classify` keeps, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample)[0])
    return keep_rows(docs, lambda texts: (shared.value.score(linear.matrix(texts)) >= THRESHOLD).tolist())
