"""Hashed word and character n-grams and word shapes of whole texts, and a logistic scorer with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Prepared, bounded, prepare

#: Hash buckets for word n-grams (one and two words) and for character n-grams (three bytes).
WORD_BITS, CHAR_BITS = 11, 11
#: Word shapes: all upper case, begins so, holds a sign, ends plainly, repeats the word before, lies in a repeated window.
SHAPE_BITS = 6
WIDTH = (1 << WORD_BITS) + (1 << CHAR_BITS) + (1 << SHAPE_BITS)

_CODE = np.arange(256)
_LOWER, _UPPER = (_CODE >= 97) & (_CODE <= 122) | (_CODE >= 128), (_CODE >= 65) & (_CODE <= 90)
_SIGN = (_CODE > 32) & (_CODE < 127) & ~_LOWER & ~_UPPER & ~((_CODE >= 48) & (_CODE < 58)) & ~np.isin(_CODE, [ord(c) for c in ".,;:!?'\"()-"])
#: The most rows that a scorer is fitted on.
SAMPLE = 4000


def _unit(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts.astype(np.float32))
    return root / max(1.0, float(np.sqrt(counts.sum())))


def shapes(p: Prepared) -> np.ndarray:
    """A shape code of each word."""
    raw, starts, ends, h = p.raw, p.starts, p.ends, p.hashes
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    inside = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask[raw])]))
    repeats = np.zeros(n, dtype=bool)
    repeats[1:] = h[1:] == h[:-1]
    last = raw[ends - 1]
    before = raw[np.maximum(ends - 2, starts)]
    word = _LOWER | _UPPER | ((_CODE >= 48) & (_CODE < 58))
    flags = ((inside(_LOWER) == 0) & (inside(_UPPER) > 1), _UPPER[raw[starts]], inside(_SIGN) > 0, word[last] | word[before], repeats, p.covered)
    return sum(f.astype(np.int64) << k for k, f in enumerate(flags))


def features(text: str | Prepared | None) -> np.ndarray:
    """Square roots of the shares of each bucket; all zero without text."""
    p = prepare(text)
    raw, h = p.raw, p.hashes
    grams = np.concatenate([h, p.pairs]) if len(h) > 1 else h
    words = np.bincount((grams >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)
    with np.errstate(over="ignore"):
        b = raw.astype(np.uint32)
        three = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    chars = np.bincount((three >> np.uint32(32 - CHAR_BITS)).astype(np.int64), minlength=1 << CHAR_BITS)
    shape = np.bincount(shapes(p), minlength=1 << SHAPE_BITS)
    return np.concatenate([_unit(words), _unit(chars), _unit(shape)])


def matrix(texts) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, WIDTH), dtype=np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Scorer:
    """Probability of class 1: sigmoid(scale * (x . weights + bias) + shift)."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.margin(x).astype(np.float64) + self.shift)


def judged(scorer: Scorer, texts, measure) -> tuple[np.ndarray, list]:
    """Scores of some texts and `measure` of each; a text is prepared once, used for both, and let go."""
    x, rows = np.zeros((len(texts), WIDTH), dtype=np.float32), []
    for k, text in enumerate(texts):
        p = prepare(text)
        x[k] = features(p)
        rows.append(measure(p))
    return scorer.score(x), rows


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 200, ridge: float = 1e-5) -> Scorer:
    """Logistic regression by accelerated gradient descent on rows outside `held`, calibrated on those inside (Platt).

    `y` are labels or probabilities of class 1. Without rows of both classes the score is their mean everywhere.
    """
    if not len(y) or y.max() - y.min() < 0.5:
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Scorer(np.zeros(x.shape[1] if x.ndim == 2 else WIDTH, dtype=np.float32), float(np.log(mean / (1 - mean))))
    train = ~held if held.any() and (~held).sum() > held.sum() else np.ones(len(y), dtype=bool)
    a, t = x[train], y[train].astype(np.float32)
    # Both classes weigh the same.
    weight = np.where(t >= 0.5, 0.5 / max(1, (t >= 0.5).sum()), 0.5 / max(1, (t < 0.5).sum())).astype(np.float32)
    w, v, b, c, step = np.zeros(a.shape[1], dtype=np.float32), np.zeros(a.shape[1], dtype=np.float32), 0.0, 0.0, 1.0
    for k in range(rounds):
        error = weight * (sigmoid(a @ v + c) - t)
        new, bias = v - step * (a.T @ error + ridge * v), c - step * float(error.sum())
        move = k / (k + 3)
        v, c = new + move * (new - w), bias + move * (bias - b)
        w, b = new, bias
    out = Scorer(w, b)
    check = held if held.any() and y[held].max() - y[held].min() >= 0.5 else np.ones(len(y), dtype=bool)
    out.scale, out.shift = calibrate(out.margin(x[check]).astype(np.float64), y[check].astype(np.float64))
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Scale and shift of margins, by damped Newton steps on softened targets."""
    ones, zeros = (y >= 0.5).sum(), (y < 0.5).sum()
    target = np.where(y >= 0.5, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([margin, np.ones_like(margin)])
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (p - target) + 1e-6 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def smallest(df: DataFrame, order, n: int, total: int) -> DataFrame:
    """The `n` rows of smallest hash. `order`: a hash column; rows far beyond are left before the sort."""
    df = df.withColumn("_order", F.pmod(order, F.lit(1 << 30)))
    if total > n:
        df = df.where(F.col("_order") <= int((1 << 30) * min(1.0, 1.2 * n / total + 1e-6)))
    return df.orderBy("_order").limit(n)


def collect_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels `y` and a held-out flag (every fifth by order) of a bounded sample (text, y, _order)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            x = matrix(frame["text"]).astype(np.float16)
            yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": frame["y"].to_numpy(), "fold": frame["_order"].to_numpy() % 5})

    got = rows.select("text", F.col("y").cast("double").alias("y"), "_order").mapInPandas(scan, "x binary, y double, fold long").toPandas()
    x = np.stack([np.frombuffer(r, dtype=np.float16) for r in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, WIDTH), np.float32)
    return x, got["y"].to_numpy(), got["fold"].to_numpy() == 0
