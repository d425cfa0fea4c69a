"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import linear
from .common import SPACES, Prepared, map_texts, prepare

# Limits of the base rules, and the scorer's threshold.
LEAST_WORDS, MOST_REPEATED, THRESHOLD = 50, 50, 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True


def counts(text: str | Prepared | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    p = prepare(text)
    chars = int((((p.raw & 0xC0) != 0x80) & ~_SPACE[p.raw]).sum())
    seen, again = set(), 0
    for line in p.text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(p.starts), chars, int(_SYMBOL[p.raw].sum()), again, int(p.covered.sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> linear.Scorer:
    """Fit on at most `sample` rows of `labels` (doc_id, quality), those of smallest hash."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("y"))
    few = linear.smallest(known, F.xxhash64("doc_id"), sample, known.count())
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return linear.fit(*linear.collect_features(rows))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """Judge every row of `docs` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score (calibrated
    probability of good quality). Kept: the base rules hold and the score reaches THRESHOLD. A null or empty text has no words
    and fails. Repeated rows and null ids are judged like any other; an empty table gives no rows; without labels of both
    classes the score is the labels' mean. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for frame in frames:
            score, rows = linear.judged(shared.value, frame["text"], counts)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            out["kept"] = ~out["base_failed"] & (score >= THRESHOLD)
            out["score"] = score
            yield out

    whole = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return map_texts(docs, scan, f"{whole}, base_failed boolean, kept boolean, score double")
