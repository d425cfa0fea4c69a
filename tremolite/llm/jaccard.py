"""Jaccard self-join of word shingle sets by T-occurrence search (DivideSkip).

A text and a partner of Jaccard 0.8 share at least T = ceil(0.8 n) of its n shingles. DivideSkip merges the short inverted
lists of a set, leaves its T - k longest ones aside, and keeps what occurs k times in the short ones; kept candidates are then
probed in the long lists by binary search.

1. Spread over the cluster: sets are ordered by one global order, rare shingles first, and each puts only its
   n - T + k rarest ones (the short lists) into the inverted index. Lists are merged by a shuffle on the shingle and one on
   the pair; pairs below k occurrences fall away. A list beyond `LONG` entries makes no pairs: its members are tied to its
   first entry and meet in step 3.
2. Candidates fall into connected groups.
3. Each group is searched with DivideSkip on whole sets. A large group is dealt into blocks, and a task takes two blocks.

Texts with equal sets are one class throughout, known by a 64-bit fingerprint of the set.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialise
from .common import bounded, free_name, map_texts, mix, shingle_sets
from .components import components

#: Link where 100 * shared >= PERCENT * union.
PERCENT = 80
#: Inverted lists beyond this length make no pairs of their own.
LONG = 256
#: Members of a block, and the most blocks of a group while blocks stay below MOST members.
BLOCK, BLOCKS, MOST = 256, 32, 4096
#: Shingles met this often, and how many of them, the most frequent first, the global order knows. Only speed depends on both.
FREQUENT, KNOWN = 16, 1 << 17
#: Bits of the filter of wanted document ids; a full filter lets all pass and only costs time.
FILTER_BITS = 1 << 23
_PAGE = 1 << 15


def needed(n):
    """T: the least number of shingles that a set of n shares with any partner."""
    return -(-PERCENT * n // 100)


def required(n):
    """k: the least number shared in the short lists."""
    return np.maximum(1, n // 20)


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and the fingerprint of the set (null: no words)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, fps = [], []
            for s in shingle_sets(frame["text"], width):
                sizes.append(len(s))
                fps.append(fingerprint(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_shingles": sizes, "fp": pd.array(fps, dtype="Int64")})

    return map_texts(docs, scan, "n_shingles long, fp long")


def short_lists(docs: DataFrame, width: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, fp, n): each class in the lists of its n - T + k first shingles, by known frequency, then by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = shared.value
        for frame in bounded(frames):
            seen, out = set(), []
            for s in shingle_sets(frame["text"], width):
                n = len(s)
                if not n or (fp := fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    met = np.where(hashes[at] == s, counts[at], 0)
                    s = s[np.argsort(met, kind="stable")]
                p = n - needed(n) + int(required(n))
                out.append((s[:p], fp, n))
            if out:
                sizes = [len(x[0]) for x in out]
                yield pd.DataFrame({
                    "shingle": np.concatenate([x[0] for x in out]).view(np.int64), "fp": np.repeat([x[1] for x in out], sizes),
                    "n": np.repeat(np.array([x[2] for x in out], dtype=np.int32), sizes),
                })

    return docs.select("text").mapInPandas(scan, "shingle long, fp long, n int")


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the index in hash order, sorted, with their counts; at most KNOWN."""
    nothing = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    counts = short_lists(docs, width, nothing).groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "shingle").limit(KNOWN).toPandas()
    h = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["count"].to_numpy(dtype=np.int64)[order]


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[np.ndarray]]:
    """Frames sorted by `keys`, cut so that a run of equal keys is never split; each as a list of its columns."""
    rest: list[np.ndarray] | None = None
    for frame in frames:
        cols = [frame[c].to_numpy() for c in frame.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        places = [list(frame.columns).index(k) for k in keys]
        last = np.ones(len(cols[0]), dtype=bool)
        for p in places:
            last &= cols[p] == cols[p][-1]
        cut = len(last) if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if last.all():
            rest = cols
            continue
        yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def merge_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries sorted by (shingle, fp) to pairs of similar size of each list, or to ties of a long list (`tie`)."""
    nothing = np.zeros(0, dtype=np.int64)
    pivot: tuple[int, int, int] | None = None  # shingle, first and last member of the long list that goes on
    rest = [nothing, nothing, nothing]

    def emit(s: np.ndarray, f: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        nonlocal pivot
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else nothing
        size = np.diff(np.append(starts, len(s)))
        each = np.repeat(size, size)
        first = np.repeat(f[starts], size) if len(s) else nothing
        if pivot and len(s) and s[0] == pivot[0]:
            each[: size[0]] = LONG + 1
            first[: size[0]] = pivot[1]
        long = each > LONG
        if long.any():
            m = long & (f != first)
            yield pd.DataFrame({"a": first[m], "b": f[m], "na": n[m], "nb": n[m], "tie": True})
        s, f, n = s[~long], f[~long], n[~long]
        for lag in range(1, LONG):
            m = s[lag:] == s[:-lag] if len(s) > lag else np.zeros(0, dtype=bool)
            if not m.any():
                break
            i = np.flatnonzero(m)
            na, nb = n[i], n[i + lag]
            fits = np.minimum(na, nb) * 100 >= PERCENT * np.maximum(na, nb)
            i, na, nb = i[fits], na[fits], nb[fits]
            yield pd.DataFrame({"a": f[i], "b": f[i + lag], "na": na, "nb": nb, "tie": False})

    for frame in frames:
        s, f, n = (np.concatenate([r, frame[c].to_numpy(dtype=np.int64)]) for r, c in zip(rest, ("shingle", "fp", "n"), strict=True))
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
        s, f, n = s[fresh], f[fresh], n[fresh]
        cut = int(np.searchsorted(s, s[-1]))
        yield from emit(s[:cut], f[:cut], n[:cut])
        rest = [x[cut:] for x in (s, f, n)]
        if pivot and pivot[0] != s[-1]:
            pivot = None
        if len(rest[0]) > LONG:  # the open list is long: tie what there is, keep its last entry to go on from
            pivot = pivot or (int(s[-1]), int(rest[1][0]))
            yield from emit(*rest)
            rest = [x[-1:] for x in rest]
    yield from emit(*rest)


def enough(na: str, nb: str) -> Column:
    """The least number of short lists that a linked pair of these sizes shares: the set whose short lists end first in the
    global order leaves T - k of its shingles outside, so at least overlap - (T - k) are shared before."""
    a, b = F.col(na).cast("long"), F.col(nb).cast("long")

    def up(x: Column, d: int) -> Column:
        return F.floor((x + (d - 1)) / d)

    overlap = F.greatest(up((a + b) * PERCENT, 100 + PERCENT), up(F.greatest(a, b) * PERCENT, 100))
    outside = F.greatest(*(up(n * PERCENT, 100) - F.greatest(F.lit(1), F.floor(n / 20)) for n in (a, b)))
    return overlap - outside


def candidates(docs: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) between classes that may link, and ties of long lists."""
    known = frequent(docs, width)
    entries = short_lists(docs, width, known).repartition("shingle").sortWithinPartitions("shingle", "fp")
    merged = entries.mapInPandas(merge_lists, "a long, b long, na int, nb int, tie boolean")
    met = merged.groupBy("a", "b", "tie").agg(F.count(F.lit(1)).alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return met.where(F.col("tie") | (F.col("met") >= enough("na", "nb"))).select("a", "b")


def occurrences(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted lists: distinct entries and how many lists hold each. Few entries go through a heap, many through one sort."""
    if sum(map(len, lists)) > 256:
        return np.unique(np.concatenate(lists), return_counts=True)
    ids, counts = [], []
    for x in heapq.merge(*(x.tolist() for x in lists)):
        if ids and ids[-1] == x:
            counts[-1] += 1
        else:
            ids.append(x)
            counts.append(1)
    return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)


def divide_skip(queries: list[np.ndarray], index: list[np.ndarray], same: bool) -> Iterator[tuple[int, int]]:
    """(query, partner) for every linked pair; with `same`, both lists are one and a pair comes once, smaller number first."""
    if not index:
        return
    sizes = np.array([len(x) for x in index])
    flat = np.concatenate(index)
    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(len(index)), sizes)[order]
    keys, starts, lengths = np.unique(flat[order], return_index=True, return_counts=True)
    for q, s in enumerate(queries):
        t = needed(len(s))
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        at = at[keys[at] == s]
        if len(at) < t or same and len(at) and lengths[at].max() < 2:
            continue
        at = at[np.argsort(lengths[at], kind="stable")]
        n_long = min(t - 1, int(t / (0.01 * np.log2(max(2, lengths[at[-1]])) + 1)))
        short, long = at[: len(at) - n_long], keys[at[len(at) - n_long :]]
        ids, counts = occurrences([owners[starts[k] : starts[k] + lengths[k]] for k in short])
        for c, have in zip(ids[counts >= t - n_long].tolist(), counts[counts >= t - n_long].tolist(), strict=True):
            m = len(index[c])
            if same and c <= q or min(m, len(s)) * 100 < PERCENT * max(m, len(s)):
                continue
            found = np.minimum(np.searchsorted(index[c], long), m - 1)
            have += int((index[c][found] == long).sum())
            if 100 * have >= PERCENT * (m + len(s) - have):
                yield q, c


def search_cell(fps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], i: int, j: int) -> Iterator[tuple[int, int, int]]:
    """(class, smallest class that it reaches in this cell, its links in this cell)."""
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    parent, links = {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q, c in divide_skip([sets[k] for k in left], [sets[k] for k in right], i == j):
        a, b = int(fps[left[q]]), int(fps[right[c]])
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    for v, n in links.items():
        yield v, root(v), n


def search_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (label, i, j, block, fp, grams), sorted by cell, to the links inside each cell."""
    for label, i, j, block, fp, grams in runs(frames, ["label", "i", "j"]):
        starts = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for a, b in zip(starts, [*starts[1:], len(label)], strict=True):
            _, once = np.unique(fp[a:b], return_index=True)
            once = a + once
            out = list(search_cell(fp[once], block[once], [np.frombuffer(grams[k], dtype=np.uint64) for k in once], i[a], j[a]))
            if out:
                yield pd.DataFrame(out, columns=["v", "root", "links"])


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """A bit set of fixed size over hashed ids."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    pages = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _PAGE).alias("page")).agg(
        F.expr(f"bitmap_construct_agg(bit % {_PAGE})").alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in pages.collect():
        out[r["page"] * (_PAGE // 8) : (r["page"] + 1) * (_PAGE // 8)] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def wanted_sets(docs: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """(fp, grams) of the documents whose id passes the filter of `ids`: whole sets, as sorted hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(ids))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(frames):
            bit = frame["bit"].to_numpy(dtype=np.int64)
            hit = (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            sets = {fingerprint(s): s.tobytes() for s in shingle_sets(frame["text"][hit.astype(bool)], width) if len(s)}
            if sets:
                yield pd.DataFrame({"fp": list(sets.keys()), "grams": list(sets.values())})

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    return docs.select("text", bit.alias("bit")).mapInPandas(scan, "fp long, grams binary")


def verified(docs: DataFrame, width: int, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root, links) of every cell: `links` partners of other texts, and a class to join `v` with."""
    groups = components(edges)
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.greatest(F.least(F.ceil(F.col("members") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("members") / MOST)).cast("int")
    placed = groups.join(sizes.select("label", blocks.alias("blocks")), "label").withColumn(
        "block", F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int")
    )
    cells = placed.select("v", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("v").alias("fp"), "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    ids = groups.select(F.col("v").alias("fp")).join(classes, "fp").select("doc_id")
    rows = cells.join(wanted_sets(docs, width, ids), "fp").select("label", "i", "j", "block", "fp", "grams")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return rows.mapInPandas(search_cells, "v long, root long, links long")


def jaccard_join(docs: DataFrame, width: int = 5) -> DataFrame:
    """Link the texts of `docs` (doc_id, text) whose word shingle sets have a Jaccard similarity of 0.8 or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links (other texts linked directly;
    texts with the same set count as one). Null, empty and blank texts have no shingles and are linked with nothing; a text of
    fewer words than `width` is one shingle. Repeated rows are copies of each other. Ids may be null; a component takes the
    smallest id that isn't. An empty table gives no rows; other columns are ignored.
    """
    rows, grouped = _grouped(docs.select("doc_id", "text"), width)
    lowest = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    answer = grouped.join(lowest, "label").select("fp", "component_id", "n_links")
    return rows.join(answer, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _grouped(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row, and (fp, doc_id, label, n_links) of every class: its smallest id and its component."""
    rows = materialise(profile(docs, width), "profile")
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    edges = materialise(candidates(docs, width), "candidates")
    links = materialise(verified(docs, width, classes, edges), "links")
    labels = components(links.select(F.col("v").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy(F.col("v").alias("fp")).agg(F.sum("links").alias("n_links"))
    known = labels.select(F.col("v").alias("fp"), "label").join(counts, "fp", "left")
    grouped = classes.join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return rows, grouped.withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of `docs` that stay when one row of each component does, all columns unchanged.

    The row with the smallest id stays, one of them where it is repeated; ids that are null come last. Rows without words stay.
    Other columns may have any names.
    """
    _, grouped = _grouped(docs.select("doc_id", "text"), width)
    fp, row = free_name(docs, "fp_"), free_name(docs, "row_")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    keep = grouped.groupBy("label").agg(first).select(F.col("first.fp").alias(fp), F.col("first.doc_id").alias("doc_id"))
    mark = F.xxhash64(fp, "doc_id")
    keep = keep.select(fp, mark.alias(row))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = shingle_sets(part.column(part.schema.get_field_index("text")).to_pylist(), width)
                fps = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, fps], names=[*part.schema.names, fp])

    tagged = docs.mapInArrow(tag, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    kept = tagged.where(F.col(fp).isNotNull()).withColumn(row, mark).join(keep, [fp, row]).dropDuplicates([fp, row])
    return kept.select(docs.columns).union(tagged.where(F.col(fp).isNull()).select(docs.columns))
