"""Shared by the operators: words, hashes and shingles of whole texts as NumPy arrays, and bounded batches."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\v\f\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        m = max(n, 2 * len(_powers), 1 << 16)
        with np.errstate(over="ignore"):
            steps = np.full(m, _BASE, dtype=np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(m, _BASE_INVERSE, dtype=np.uint64)
            steps[0] = 1
            _inverses = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word: the longest runs without white space."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; `lower` folds A-Z only."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _grow(len(raw))
    codes = _BYTE_CODES[_LOWER[raw]] if lower else _BYTE_CODES[raw]
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(codes * powers[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * inverses[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` words; of the whole sequence where there are fewer."""
    n = len(h)
    if not n:
        return h
    k = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[i : n - k + 1 + i])
    return out


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a lower-cased text; empty without words."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = utf8(text)
    return np.unique(windows(word_hashes(raw, *word_bounds(raw)), width))


def shingle_sets(texts: Iterable[str | None], width: int = 5, chars: int = 200_000) -> Iterator[np.ndarray]:
    """`shingle_set` of every text. Texts are hashed together, about `chars` characters at a time: short ones share the calls."""
    rest: list[str] = []
    size = 0
    for text in texts:
        rest.append(text or "")
        size += len(rest[-1])
        if size >= chars:
            yield from _sets_together(rest, width)
            rest, size = [], 0
    if rest:
        yield from _sets_together(rest, width)


def _sets_together(texts: list[str], width: int) -> Iterator[np.ndarray]:
    raw = utf8(" ".join(texts))
    starts, ends = word_bounds(raw)
    h = word_hashes(raw, starts, ends)
    sizes = [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]
    first = np.searchsorted(starts, np.cumsum([0, *sizes]))  # the first word of each text, then the number of words
    whole = windows(h, width) if len(h) >= width else h[:0]
    for a, b in itertools.pairwise(first.tolist()):
        s = np.sort(whole[a : b - width + 1]) if b - a >= width else windows(h[a:b], width)
        if len(s) > 1:
            new = np.empty(len(s), dtype=bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        yield s


class Prepared:
    """A text with what several measures need, each part made once: bytes, words, hashes and repeated three-word windows."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = utf8(self.text)
        self.starts, self.ends = word_bounds(self.raw)

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.starts, self.ends, lower=False)

    @cached_property
    def pairs(self) -> np.ndarray:
        return windows(self.hashes, 2)

    @cached_property
    def covered(self) -> np.ndarray:
        """Per word, whether it lies in a three-word window that the text holds twice or more."""
        n = len(self.starts)
        cover = np.zeros(n, dtype=bool)
        if n > 3:
            three = windows(self.hashes, 3)
            order = np.sort(three)
            again = order[1:][order[1:] == order[:-1]]
            if len(again):
                twice = np.isin(three, again)
                for k in range(3):
                    cover[k : n - 2 + k] |= twice
        return cover


def prepare(text: str | Prepared | None) -> Prepared:
    return text if isinstance(text, Prepared) else Prepared(text)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of `df` has (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc(value: object) -> int:
    """crc32 of a value's text."""
    return zlib.crc32(str(value).encode())


def bounded(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that a piece holds about `chars` characters: memory follows texts, not row counts."""
    for frame in frames:
        size = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        part = np.cumsum(size) // chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]


def map_texts(docs: DataFrame, scan: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: str, *more) -> DataFrame:
    """mapInPandas over doc_id, text and `more`. The id passes through as text: pandas would round a large one beside a null."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more)
    out = rows.mapInPandas(lambda frames: scan(bounded(frames)), f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_rows(docs: DataFrame, good: Callable[[list], list]) -> DataFrame:
    """The rows of `docs` whose text passes, all columns unchanged. `good` takes texts and gives a flag for each; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array(good(part.column(part.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
