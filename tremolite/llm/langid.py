"""Language identification by a linear-chain conditional random field.

Words are the positions of a chain, lines are the chains. Affixes, character n-grams and a learned lexicon give each word a
score per language, transitions are learned with them, and forward-backward gives every word a distribution; a document takes
the language with the largest expected share of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_texts, mix, word_hashes

#: Training documents per language, buckets of hashed features, words of each language in the lexicon, passes and chains a step.
PER_LANGUAGE, BUCKETS, LEXICON, PASSES, STEP = 120, 1 << 17, 2000, 4, 400
#: Words that a worker keeps with their scores.
CACHE = 300_000
#: Share of training chains that are joined with one of another language, so that switches are learned.
SWITCHED = 0.3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"


def words_of(line: str) -> list[str]:
    return [w.strip(_EDGE) for w in line.lower().replace("\0", " ").split()]


def word_features(words: list[str], lexicon: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, laid end to end, and how many each has: the word, its first and last one to three bytes, its
    pairs and triples of bytes, and the lexicon's language. Words without letters have none."""
    real = [bool(_LETTER.search(w)) for w in words]
    index = np.flatnonzero(real)
    if not len(index):
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    parts = [f"^{words[i]}$".encode("utf-8", "surrogatepass") for i in index]
    raw = np.frombuffer(b"\0".join([b"\0\0", *parts, b"\0\0\0"]), dtype=np.uint8)
    size = np.array(list(map(len, parts)))
    end = np.cumsum(size + 1) + 2
    start = end - size
    b = raw.astype(np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    three = two[:-1] | b[2:] << np.uint64(16)
    n = len(index)
    each = np.arange(n)
    found = [(each, word_hashes(raw, start, end, lower=False))]
    for kind, value in enumerate((b[start + 1], two[start + 1], three[start + 1], b[end - 2], two[end - 3], three[end - 4])):
        found.append((each, value | np.uint64(kind + 1) << np.uint64(32)))
    for kind, table, width in ((7, two, 2), (8, three, 3)):
        many = np.maximum(size - width + 1, 0)
        at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append((np.repeat(each, many), table[at] | np.uint64(kind) << np.uint64(32)))
    listed = [(k, zlib.crc32(lexicon[words[i]].encode())) for k, i in enumerate(index) if words[i] in lexicon]
    if listed:
        found.append((np.array([k for k, _ in listed]), np.array([v for _, v in listed], dtype=np.uint64) | np.uint64(9) << np.uint64(32)))
    owner = np.concatenate([o for o, _ in found])
    order = np.argsort(owner, kind="stable")
    bucket = mix(np.concatenate([v for _, v in found]))[order] % np.uint64(BUCKETS)
    sizes = np.zeros(len(words), dtype=np.int64)
    sizes[index] = np.bincount(owner, minlength=n)
    return bucket.astype(np.int64), sizes


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, str]
    weights: np.ndarray  # bucket x language
    moves: np.ndarray  # from x to
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "scores": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word in each language; scores of distinct words are kept."""
        if len(self.known) > CACHE:
            self.known, self.scores = {}, None
        fresh = [w for w in set(words) if w not in self.known]
        if fresh:
            new = summed(self.weights, *word_features(fresh, self.lexicon))
            start = len(self.known)
            self.known.update({w: start + k for k, w in enumerate(fresh)})
            if self.scores is None or start + len(fresh) > len(self.scores):
                room = np.zeros((2 * (start + len(fresh)), len(self.languages)), dtype=np.float32)
                if self.scores is not None:
                    room[:start] = self.scores[:start]
                self.scores = room
            self.scores[start : start + len(fresh)] = new
        return self.scores[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]


def summed(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each word's weight rows, over the square root of their number."""
    out = np.zeros((len(sizes), weights.shape[1]), dtype=np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(weights[flat], (np.cumsum(sizes) - sizes)[full]) / np.sqrt(sizes[full])[:, None]
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Chains laid end to end: each position's distribution, expected moves (from x to), and the log of the partition sum."""
    k = emit.shape[1]
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    top = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - top).astype(np.float64)
    a = np.exp(moves - moves.max()).astype(np.float64)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    log = float(top.sum()) + float(moves.max()) * float((lengths - 1).clip(0).sum())
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains with more than t positions
    for t in range(longest):
        at = start[: active[t]] + t
        v = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        total = v.sum(axis=1, keepdims=True)
        alpha[at] = v / total
        log += float(np.log(total).sum())
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        v = (e[at + 1] * beta[at + 1]) @ a.T
        beta[at] = v / v.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both, np.zeros((k, k)), log
    inner = np.ones(len(emit), dtype=bool)
    inner[(np.cumsum(lengths) - 1)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((k, k))
    for part in np.array_split(at, max(1, len(at) // 100_000)):
        pair = alpha[part][:, :, None] * a[None] * (e[part + 1] * beta[part + 1])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both, expected, log


def marginals(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    return forward_backward(emit, lengths, moves, pairs=False)[0]


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Train on (text, language) by Adam steps on the conditional likelihood of the words' languages."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    rng = np.random.default_rng(seed)
    counts = {lang: Counter() for lang in languages}
    lines: list[tuple[list[str], int]] = []
    for text, lang in sorted(rows):
        for line in text.split("\n"):
            w = words_of(line)
            if w:
                counts[lang].update(w)
                lines += [(w[i : i + 60], languages.index(lang)) for i in range(0, len(w), 60)]
    # The lexicon: each language's most frequent words, given to the language that uses them most.
    share = {lang: {w: n / max(1, sum(c.values())) for w, n in c.most_common(LEXICON)} for lang, c in counts.items()}
    lexicon = {w: max(languages, key=lambda x: share[x].get(w, 0)) for lang in languages for w in share[lang]}
    model = Model(languages, lexicon, np.zeros((BUCKETS, k), dtype=np.float32), np.zeros((k, k)))
    if not lines:
        return model
    ids = {w: i for i, w in enumerate(dict.fromkeys(w for x, _ in lines for w in x))}
    flat, sizes = word_features(list(ids), lexicon)
    firsts = np.cumsum(sizes) - sizes
    chains = []
    order = rng.permutation(len(lines))
    for n, i in enumerate(order):
        w, y = [ids[x] for x in lines[i][0]], [lines[i][1]] * len(lines[i][0])
        if rng.random() < SWITCHED:
            other = lines[order[(n + 1) % len(order)]]
            w, y = w + [ids[x] for x in other[0]], y + [other[1]] * len(other[0])
        chains.append((np.array(w), np.array(y)))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.moves)]
    step = 0
    for _ in range(PASSES):
        for a in range(0, len(chains), STEP):
            part = chains[a : a + STEP]
            w, y, lengths = np.concatenate([c[0] for c in part]), np.concatenate([c[1] for c in part]), np.array([len(c[0]) for c in part])
            used, where = np.unique(w, return_inverse=True)
            n = sizes[used]
            at = np.repeat(firsts[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bucket, owner = flat[at], np.repeat(np.arange(len(used)), n)
            root = np.sqrt(np.maximum(n, 1))[:, None]
            score = np.stack([np.bincount(owner, weights=model.weights[bucket, j], minlength=len(used)) for j in range(k)], axis=1) / root
            both, expected, _ = forward_backward(score[where], lengths, model.moves)
            both[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(where, weights=both[:, j], minlength=len(used)) for j in range(k)], axis=1) / root
            touched, place = np.unique(bucket, return_inverse=True)
            grad = np.stack([np.bincount(place, weights=by_word[owner, j], minlength=len(touched)) for j in range(k)], axis=1) / len(y)
            inner = np.ones(len(y), dtype=bool)
            inner[np.cumsum(lengths) - 1] = False
            pairs = np.flatnonzero(inner)
            np.add.at(expected, (y[pairs], y[pairs + 1]), -1)
            step += 1
            for p, g, rows_, (m, v) in ((model.weights, grad, touched, state[0]), (model.moves, expected / len(y) + 1e-3 * model.moves, slice(None), state[1])):
                m[rows_] = 0.9 * m[rows_] + 0.1 * g
                v[rows_] = 0.99 * v[rows_] + 0.01 * g * g
                p[rows_] -= 0.1 * (m[rows_] / (1 - 0.9**step)) / (np.sqrt(v[rows_] / (1 - 0.99**step)) + 1e-6)
    return model


def label_words(model: Model, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
    """(word, language, probability) of every word of each text, marks at the edges of words left out."""
    out = []
    for text in texts:
        lines = [words_of(x) for x in (text or "").split("\n")]
        words = [w for x in lines for w in x]
        if not words or not model.languages:
            out.append([])
            continue
        p = marginals(model.emissions(words), np.array([len(x) for x in lines if x]), model.moves)
        out.append([(w, model.languages[j], float(q)) for w, j, q in zip(words, p.argmax(axis=1), p.max(axis=1), strict=True)])
    return out


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the largest expected share of its words that have letters."""
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    words, lengths, owner, real = [], [], [], []
    for i, text in enumerate(texts):
        if text and model.languages and any(map(str.isalpha, text)):
            real.append(i)
            for line in text.split("\n"):
                w = words_of(line)
                if w:
                    words += w
                    lengths.append(len(w))
                    owner.append(i)
    if real:
        emit = model.emissions(words)
        p = marginals(emit, np.array(lengths), model.moves)
        doc = np.repeat(owner, lengths)
        spoken = np.abs(emit).sum(axis=1) > 0
        weight = np.where(spoken, 1.0, 1e-9)
        share = np.stack([np.bincount(doc, weights=p[:, j] * weight, minlength=len(texts)) for j in range(p.shape[1])], axis=1)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        for i in real:
            names[i] = model.languages[int(share[i].argmax())]
        score[real] = share[real].max(axis=1)
    return names, np.clip(score, 0, 1)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most `per_language` documents of each language, those of smallest hash, outside the held-out part."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    near = rows.withColumn("h", hashed).join(F.broadcast(counts), "lang").where(F.col("h") <= F.lit(1.5 * per_language * (1 << 30)) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    few = near.withColumn("r", rank).where(F.col("r") <= per_language).select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in few])


def identify(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Language of every row of `docs` (doc_id, text, lang; `lang` is used for training only).

    Returns doc_id, held_out, lang_pred and score. A null text, or one without a letter, is `und` with score 0; so are all where
    nothing could be learned. Texts without known features take the likeliest language. Repeated rows and null ids (never held
    out) are judged like any other; an empty table gives no rows; other columns are ignored.
    """
    model = model or train(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, score = judge(shared.value, frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy(), "lang_pred": names, "score": score})

    return map_texts(docs, scan, "held_out boolean, lang_pred string, score double", held_out().alias("held_out"))
