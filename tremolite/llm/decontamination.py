"""Benchmark decontamination by the q-gram lemma.

Every window of a benchmark item counts, at whatever character it begins. A stretch of a document within `e` edits of a window of w characters shares
at least w - q + 1 - q e of its q-grams with it, on diagonals (place in text minus place in item) no more than `e` apart. So:

1. places of a text whose q-gram occurs in the benchmark are marked, and stretches with too few marks are left;
2. the others' hits are counted per item in diagonal bands that overlap by `e`;
3. in a band that meets the bound, the windows whose own hits there meet it are verified by banded alignment, those with the
   most hits first; one whose hits allow no fewer edits than the best one found is left.

Items too short for that (under `LEAST` characters) are looked up as exact sequences of whole words.

The benchmark is the query set: it is taken in blocks of bounded size, and each block makes one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, map_texts

Q = 8
#: Characters of a window; edits allowed per character.
WINDOW, RATE = 100, 0.08
#: Shorter items are matched word by word, without edits.
LEAST = 25
#: Most hits that are held at once; a text with more (one character again and again) is taken in overlapping slices.
HITS = 2_000_000
#: Characters of a benchmark block and of a part of a long item.
BLOCK_CHARS, PART_CHARS = 4_000_000, 100_000
_BITS = 22


def plain(text: str) -> str:
    """Lower case, white space as single blanks."""
    return " ".join(text.lower().split())


def places(text: str) -> np.ndarray:
    """For every character of `plain(text)` (and its end) a position in `text`."""
    out, at, first = [], 0, True
    for word in text.split():
        start = text.index(word, at)
        at = start + len(word)
        if not first:
            out.append(start - 1)
        first = False
        for i, c in enumerate(word):
            out += [start + i] * len(c.lower())
    return np.array([*out, at], dtype=np.int64)


def grams(text: str) -> np.ndarray:
    """The q-grams of a text as 64-bit numbers, characters folded to bytes: equal stretches have equal numbers."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(code) < Q:
        return np.zeros(0, dtype=np.uint64)
    b = (code ^ (code >> np.uint32(8)) ^ (code >> np.uint32(16))).astype(np.uint8)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))


def _bits(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def edits(width: int) -> int:
    return int(width * RATE)


def least_shared(width: int) -> int:
    """The q-gram lemma's bound for a window of this width."""
    return max(1, width - Q + 1 - Q * edits(width))


@dataclass
class Index:
    """The q-grams of one benchmark block."""

    ids: list
    texts: list[str]
    marks: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        # Short items by their first word, the rest by their q-grams.
        self.short: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            if 0 < len(t) < LEAST:
                self.short.setdefault(t.split(" ", 1)[0], []).append(i)
        found = [grams(t) if len(t) >= LEAST else grams("") for t in self.texts]
        sizes = [len(g) for g in found]
        flat = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(found)), sizes)[order]
        self.at = np.concatenate([*map(np.arange, sizes), np.zeros(0, dtype=np.int64)])[order]
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.marks = np.zeros(1 << _BITS, dtype=bool)
        self.marks[_bits(self.keys)] = True
        self.least = np.array([least_shared(min(WINDOW, len(t))) for t in self.texts])
        # The least bound and the widest reach over all windows decide which stretches are left at once.
        widths = [min(WINDOW, len(t)) for t in self.texts if len(t) >= LEAST] or [WINDOW]
        self.bound, self.reach = min(map(least_shared, widths)), max(w + edits(w) for w in widths)

    def without(self, items: set[int]) -> Index:
        """The index without the q-grams of some items."""
        left = Index.__new__(Index)
        left.__dict__.update(self.__dict__)
        keep = ~np.isin(self.item, list(items))
        flat = np.repeat(self.keys, self.many)[keep]
        left.item, left.at, left.short = self.item[keep], self.at[keep], {}
        left.keys, left.first, left.many = np.unique(flat, return_index=True, return_counts=True)
        left.marks = np.zeros(1 << _BITS, dtype=bool)
        left.marks[_bits(left.keys)] = True
        return left

    def marked(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of shared q-grams in stretches of the text that meet the bound, and their numbers in the index."""
        none = np.zeros(0, dtype=np.int64)
        g = grams(text)
        mark = self.marks[_bits(g)]
        total = np.concatenate([[0], np.cumsum(mark)])
        ends = np.minimum(np.arange(len(g)) + self.reach, len(g))
        dense = total[ends] - total[:-1] >= self.bound  # stretches that begin here
        if not dense.any() or not len(self.keys):
            return none, none
        cover = np.zeros(len(g) + 1, dtype=np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, ends[dense], -1)
        place = np.flatnonzero(mark & (np.cumsum(cover[:-1]) > 0))
        k = np.minimum(np.searchsorted(self.keys, g[place]), len(self.keys) - 1)
        true = self.keys[k] == g[place]
        return place[true], k[true]

    def hits(self, place: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, diagonal) of the q-grams at these places, by item and diagonal."""
        n = self.many[k]
        which = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.item[which], self.at[which]
        diagonal = np.repeat(place, n) - at
        order = np.lexsort((diagonal, item))
        return item[order], at[order], diagonal[order]

    def slices(self, place: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places in slices of at most about HITS hits; a slice begins so far before the end of the last one that every
        stretch lies in one whole."""
        total = np.cumsum(self.many[k])
        a = 0
        while a < len(place):
            start = total[a - 1] if a else 0
            b = max(int(np.searchsorted(total, start + HITS, side="right")), a + 1)
            # Past the overlap at least, or the slices would stand still.
            b = min(max(b, int(np.searchsorted(place, place[a] + 2 * self.reach))), len(place))
            yield place[a:b], k[a:b]
            if b == len(place):
                return
            a = int(np.searchsorted(place, place[b] - self.reach))

    def bands(self, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, lowest and highest diagonal, first and end hit) of the overlapping bands that meet the item's bound."""
        item, _, diagonal = hits
        if not len(item):
            return
        step = edits(WINDOW) + 1
        key = item * (1 << 40) + (np.floor_divide(diagonal, step) + (1 << 30))
        value, first, count = np.unique(key, return_index=True, return_counts=True)
        ends = first + count
        # Band b holds the diagonals of steps b and b + 1: those of a step alone, and of two steps in a row.
        begins = np.unique(np.concatenate([value, value - 1]))
        x, y = np.searchsorted(value, begins), np.searchsorted(value, begins + 1, side="right")
        low, high = first[x], ends[y - 1]
        i = value[x] >> 40
        for n in np.flatnonzero(high - low >= self.least[i]).tolist():
            b = (int(begins[n]) - (int(i[n]) << 40)) - (1 << 30)
            yield int(i[n]), b * step, (b + 2) * step - 1, int(low[n]), int(high[n])

    def windows(self, i: int) -> Iterator[tuple[int, str]]:
        text = self.texts[i]
        w = min(WINDOW, len(text))
        for a in range(len(text) - w + 1):
            yield a, text[a : a + w]

    def likely(self, i: int, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(least edits, start) of the item's windows that may match, given the places in it of a band's hits; fewest edits first."""
        n = len(self.texts[i])
        w = min(WINDOW, n)
        seen = np.zeros(n - Q + 2, dtype=np.int64)
        seen[at + 1] = 1
        total = np.cumsum(seen)
        lost = w - Q + 1 - (total[w - Q + 1 :] - total[: n - w + 1])
        least = -(-lost // Q)  # an edit spoils Q q-grams at most
        start = np.flatnonzero(least <= edits(w))
        order = np.argsort(least[start], kind="stable")
        yield from zip(least[start][order].tolist(), start[order].tolist(), strict=True)

    def words(self, text: str) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Short items that a plain text holds as whole words: (item, (0, start, end))."""
        if not self.short:
            return
        around = f" {text} "
        for word in self.short.keys() & set(text.split(" ")):
            for i in self.short[word]:
                at = around.find(f" {self.texts[i]} ")
                if at >= 0:
                    yield i, (0, at, at + len(self.texts[i]))

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found in a plain text its closest window there (one of them): (edits, start, end)."""
        best = dict(self.words(text))
        index, (place, k) = self, self.marked(text)
        work = self.slices(place, k)
        while (part := next(work, None)) is not None:
            item, at, diagonal = found = index.hits(*part)
            for i, low, high, x, y in index.bands(found):
                if i in best and not best[i][0]:
                    continue
                w = min(WINDOW, len(self.texts[i]))
                for least, a in self.likely(i, at[x:y]):
                    if i in best and best[i][0] <= least:
                        break
                    one = align(self.texts[i][a : a + w], text, a + low, a + high, edits(w))
                    if one and (i not in best or one < best[i]):
                        best[i] = one
            if part[0][-1] < place[-1] and (done := {i for i in set(item.tolist()) if i in best and not best[i][0]}):
                # Repetition: what stands there word for word needs no more hits.
                later = int(np.searchsorted(place, part[0][-1] - self.reach))
                index = index.without(done)
                rest = text[place[later] :]
                place, k = (x + place[later] if n == 0 else x for n, x in enumerate(index.marked(rest)))
                work = index.slices(place, k)
        return best


def align(window: str, text: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Banded alignment: the stretch of `text` beginning at low .. high, give or take `most`, that is closest to `window`.

    Returns (edits, start, end), or None beyond `most` edits. Cell (i, d) of the band compares window[:i] with a stretch that
    ends at low - most + d + i.
    """
    base, width = low - most, high - low + 2 * most + 1
    exact = text.find(window, max(0, base), max(0, base) + width + len(window))
    if exact >= 0:
        return 0, exact, exact + len(window)
    code = np.frombuffer(text[max(0, base) : max(0, base + width + len(window))].encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    line = np.full(width + len(window), -1, dtype=np.int64)
    off = max(0, -base)
    code = code[: max(0, len(line) - off)]
    line[off : off + len(code)] = code
    inside = np.zeros(len(line) + 1, dtype=bool)
    inside[off : off + len(code) + 1] = True
    far = 1 << 30
    row = np.where(inside[:width], 0, far)
    came = np.arange(width)  # where the stretch of each cell begins, as a column
    ramp = np.arange(width)
    for i, c in enumerate(window):
        over = np.append(row[1:], far) + 1  # a character of the window is left out
        same = row + (line[i : i + width] != ord(c))
        origin = np.where(same <= over, came, np.append(came[1:], 0))
        step = np.where(inside[i + 1 : i + 1 + width], np.minimum(same, over), far)
        # A character of the text is left over: cheapest cell to the left plus the distance.
        lead = np.minimum.accumulate(step - ramp)
        from_left = np.maximum.accumulate(np.where(step - ramp == lead, ramp, 0))
        row, came = np.minimum(lead + ramp, far), origin[from_left]
        if row.min() > most:
            return None
    d = int(row.argmin())
    return int(row[d]), base + int(came[d]), base + d + len(window)


def item_parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, text) of the plain items; long ones come in overlapping parts. Items without words are left."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = plain(text or "")
                rows += [(item, k, text[a : a + PART_CHARS + 4 * WINDOW]) for k, a in enumerate(range(0, len(text), PART_CHARS))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "text"])

    parts = map_texts(benchmark.select(F.col("item_id").alias("doc_id"), "text"), cut, "part int, text string")
    return parts.select(F.col("doc_id").alias("item_id"), "part", "text")


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    parts = item_parts(benchmark)
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b).orderBy("item_id", "part", "text").collect()
        if rows:
            yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of `benchmark` (item_id, text) in `docs` (doc_id, text): one row per row of `docs` and item found in it.

    Returns doc_id, item_id, edits (of the closest window), start and end (its place in the text, code points). A text holds an
    item where a window of `WINDOW` characters of it, or a whole shorter item, occurs within 8 edits per 100 characters,
    letter case and white space aside; items under `LEAST` characters as a sequence of whole words without edits. Null, empty
    and blank texts and items match nothing. Repeated rows give repeated results; ids may be null or large; empty tables give
    no rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, edits int, start long, end long"
    spark = docs.sparkSession
    found = []
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for doc_id, text, code in zip(frame["doc_id"], frame["text"], frame["code"], strict=True):
                    best: dict = {}
                    for i, place in shared.value.matches(plain(text or "")).items():
                        item = shared.value.ids[i]
                        best[item] = min(place, best.get(item, place))
                    if best:
                        at = places(text)
                        rows += [
                            (doc_id, None if item is None else str(item), n, at[max(a, 0)], at[min(b, len(at)) - 1] + 1, code)
                            for item, (n, a, b) in best.items()
                        ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end", "code"])

        rows = map_texts(docs, scan, "item_id string, edits int, start long, end long, code long", F.xxhash64("text").alias("code"))
        found.append(rows.withColumn("item_id", F.col("item_id").cast("long")))
    if not found:
        return spark.createDataFrame([], schema)
    columns = ["doc_id", "item_id", "edits", "start", "end"]
    if len(found) == 1:
        return found[0].select(columns)
    # Parts of an item may lie in several blocks: the closest window over all of them, as often as the row is repeated.
    best, key = F.min(F.struct("edits", "start", "end")).alias("best"), ["doc_id", "code", "item_id"]
    each = [rows.groupBy(key).agg(best, F.count(F.lit(1)).alias("copies")) for rows in found]
    whole = reduce(DataFrame.union, each).groupBy(key).agg(F.min("best").alias("best"), F.max("copies").alias("copies"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, all columns unchanged; no shuffle."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_rows(docs, lambda texts, shared=shared: [not shared.value.matches(plain(t or "")) for t in texts])
    return docs
