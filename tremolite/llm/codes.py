"""Compression of vectors to four bytes: each of four parts is coded by its nearest codebook entry, entries are refined in rounds.

The nearest entry is found by slice and intersect. Per dimension the entries' coordinates are sorted, and every prefix of that
order has a mask of 256 bits (four words of 64) of the entries in it. A cheap first entry gives a radius; two binary searches per dimension cut the
slice of entries inside it, the XOR of two prefix masks is the slice, and the slices ANDed over all dimensions are the candidates. Any
entry as near as the first one, ties included, lies in that cube, so the least distance among the candidates is exact.

A round is one pass over the vectors: tasks add up their parts per entry, Spark adds the tasks' sums, and the model
(4 x 256 entries, a fixed bound) is all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
_BATCH = 4096
_LONG_MAX = (1 << 63) - 1
_LIMB = (1 << 32) - 1


def fits(most: float, width: int) -> bool:
    """Whether squared distances over `width` components no larger than `most` stay within 62 bits."""
    return 4.0 * most * most * max(width, 1) < float(1 << 62)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) as whole numbers: int64 where squared distances fit in 64 bits, Python's integers otherwise."""
    values = values.astype(np.float64)
    most = np.abs(values).max() if values.size else 0.0
    if most < 1e15 and fits(most * 1024.0 + 1.0, values.shape[-1]):
        return np.floor(values * 1024.0).astype(np.int64)
    exact = [int(v) * 1024 if abs(v) >= 1e15 else math.floor(v * 1024.0) for v in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def limbs(total: int) -> list[tuple[int, int]]:
    """(power of 2**32, value) pairs that add up to `total`, small enough for sums over millions of tasks."""
    out, k = [], 0
    while not -(1 << 40) < total < 1 << 40:
        out.append((k, total & _LIMB))
        total, k = total >> 32, k + 1
    return [*out, (k, total)]


class Slices:
    """Sorted coordinates and prefix masks of one codebook (entries x width)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.columns = [np.ascontiguousarray(book[:, k]) for k in range(book.shape[1])]
        n = len(book)
        words = (n + 63) // 64
        self.order, self.sorted, self.masks = [], [], []
        for column in self.columns:
            order = np.argsort(column, kind="stable")
            masks = np.zeros((n + 1, words), dtype=np.uint64)
            for i, e in enumerate(order):
                masks[i + 1] = masks[i]
                masks[i + 1, e >> 6] |= np.uint64(1 << (int(e) & 63))
            self.order.append(order)
            self.sorted.append(column[order])
            self.masks.append(masks)

    def distance(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of pairs (row of x, entry), one dimension after the other."""
        total = np.zeros(len(rows), dtype=x.dtype)
        for k, column in enumerate(self.columns):
            gap = x[rows, k] - column[entries]
            total += gap * gap
        return total

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Per row a whole radius that the nearest entry does not exceed: its best among the neighbours in each dimension's order."""
        rows = np.arange(len(x))
        best = None
        for k, values in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(values, x[:, k]), len(values) - 1)
            d = self.distance(x, rows, self.order[k][at])
            best = d if best is None else np.minimum(best, d)
        if x.dtype == object:
            return np.array([math.isqrt(d) + 1 for d in best], dtype=object)
        r = np.sqrt(best.astype(np.float64)).astype(np.int64)
        return r + (r * r < best) + 1

    def candidates(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries within r of a row in every dimension."""
        inside = None
        for k, values in enumerate(self.sorted):
            lo = np.searchsorted(values, x[:, k] - r, side="left")
            hi = np.searchsorted(values, x[:, k] + r, side="right")
            cut = self.masks[k][lo] ^ self.masks[k][hi]
            inside = cut if inside is None else inside & cut
        return inside

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        code, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
        if not x.shape[1]:
            return code, error
        for a in range(0, len(x), _BATCH):
            part = x[a : a + _BATCH]
            masks = self.candidates(part, self.radius(part))
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            rows, entries = np.nonzero(bits)
            d = self.distance(part, rows, entries)
            # Pairs come by row, then by entry: the first of the least distance is the lower index.
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            least = np.minimum.reduceat(d, starts)
            hit = np.flatnonzero(d == least[np.searchsorted(starts, np.arange(len(d)), side="right") - 1])
            first = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
            code[a : a + _BATCH], error[a : a + _BATCH] = entries[first], d[first]
        return code, error


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is there and has finite components only."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(e.isNotNull() & ~odd).select("vec_id", e.cast("array<double>").alias("embedding"), "label")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("embedding"))
    lengths = np.diff(values.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components expected, found {sorted(set(lengths.tolist()))[:3]}")
    return whole(values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))


def first_books(kept: DataFrame) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the vectors of the smallest ids (null last, ties by the vector)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    if not rows:
        return []
    width = len(rows[0]["embedding"])
    if width % PARTS:
        raise ValueError(f"{width} components can't be cut into {PARTS} equal parts")
    if any(len(r["embedding"]) != width for r in rows):
        raise ValueError(f"vectors of {width} components expected")
    return np.split(whole(np.array([r["embedding"] for r in rows]).reshape(len(rows), width)), PARTS, axis=1)


def _slices(books: list[np.ndarray], x: np.ndarray, known: dict) -> list[Slices]:
    """Search structures for the books, made once a task and kind of number."""
    kind = object if object in (x.dtype, *(b.dtype for b in books)) else np.int64
    if kind not in known:
        known[kind] = [Slices(b.astype(kind)) for b in books]
    return known[kind]


def refine(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of the parts that it is nearest to; unused entries stay."""
    width = sum(b.shape[1] for b in books)
    part = width // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        sums = np.zeros((PARTS * ENTRIES, part), dtype=object)
        counts = np.zeros(PARTS * ENTRIES, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            for p, (slices, own) in enumerate(zip(_slices(books, x, known), np.split(x, PARTS, axis=1), strict=True)):
                own = own.astype(slices.book.dtype)
                code, _ = slices.nearest(own)
                code = code + p * ENTRIES
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                if part:
                    sums[used] += np.add.reduceat(own[order], starts, axis=0)
                counts[used] += np.diff(np.r_[starts, len(code)])
        used = np.flatnonzero(counts).tolist()
        rows = [(e, k, *limb) for e in used for k, s in enumerate(sums[e]) for limb in limbs(int(s))] + [(e, -1, 0, int(counts[e])) for e in used]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "place", "limb", "value"])

    added = kept.select("embedding").mapInArrow(add, "entry int, place int, limb int, value long").groupBy("entry", "place", "limb").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in added.collect():
        at = r["entry"], r["place"]
        total[at] = total.get(at, 0) + (r["value"] << 32 * r["limb"])
    fresh = []
    for p, book in enumerate(books):
        rows = [[total[p * ENTRIES + e, k] // n for k in range(part)] if (n := total.get((p * ENTRIES + e, -1), 0)) else list(book[e]) for e in range(len(book))]
        most = max((abs(v) for row in rows for v in row), default=0)
        fresh.append(np.array(rows, dtype=np.int64 if fits(most, width) else object).reshape(book.shape))
    return fresh


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def train(kept: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after `rounds` rounds over all kept vectors; none for an empty table."""
    books = first_books(kept)
    for _ in range(rounds if books else 0):
        books = refine(kept, books)
    return books


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed) of every kept vector; no shuffle."""
    width = sum(b.shape[1] for b in books)
    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            codes, errors = [], 0
            for slices, own in zip(_slices(books, x, known), np.split(x, PARTS, axis=1), strict=True):
                code, error = slices.nearest(own.astype(slices.book.dtype))
                codes.append(code)
                errors = errors + error
            packed = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            text = [packed[i : i + 2 * PARTS] for i in range(0, len(packed), 2 * PARTS)]
            exact = errors if errors.dtype != object else [min(int(e), _LONG_MAX) for e in errors]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(text, pa.string()), pa.array(exact, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(scan, schema)


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The whole-number vectors that the codes stand for, as column `approximate`; a code is looked up part by part."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("approximate", F.flatten(F.array(*[table[p][at[p]] for p in range(PARTS)])))


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """Codes of all vectors whose components are there and finite, with the codebooks' digest and the error of each label.

    Returns vec_id, code, error, label_error and codebooks_sha256. Fewer than 256 vectors make smaller codebooks; repeated rows count
    and are coded each; null ids come last in the choice of the first entries; null labels are one label; an error beyond 64 bits
    reads 2**63 - 1; no vectors give no rows; other columns are ignored. Vectors of unequal length, or of a length that four does
    not divide, raise ValueError.
    """
    kept = kept_vectors(vectors)
    books = train(kept)
    if not books:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = materialise(encode(kept, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
