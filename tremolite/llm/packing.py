"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; full pieces are sequences of their own. The others are dealt at random
into chunks of about `CHUNK` pieces, and every chunk is packed by `ISLANDS` populations, each in a task of its own. A genome
is a list of bins. Crossover injects well-filled bins of one parent into the other, drops the bins that hold an injected piece
a second time, and places displaced pieces by best fit; mutation dissolves badly filled bins. After each epoch an island sends
its elite to its neighbour (a shuffle). Pieces left in badly filled bins are dealt into new chunks and packed once more.
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import map_texts

#: Pieces of a chunk; islands of a chunk; epochs between migrations; genomes and crossovers of an epoch.
CHUNK, ISLANDS, EPOCHS, GENOMES, CROSSOVERS = 2048, 2, 2, 3, 12
#: Bins with at least this share filled are final; the pieces of the others are packed anew.
FILLED = 0.985
#: Words that a worker keeps with their ids.
CACHE = 500_000

_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!#$%&*+,./:;=?@^_|~()\[\]{}-]+")
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!#$%&*+,./:;=?@^_|~()\[\]{}-]+")


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds:
    """Ids of words, as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary never joins over blanks or line ends, so a text's ids are those of its words. Words of plain letters, digits
    and signs go straight to the vocabulary's merges; all others (apostrophes, other scripts, special strings) go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Letters beyond ASCII in the vocabulary's spelling of their bytes.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {"": b""}

    def part(self, part: str) -> bytes:
        if (out := self.known.get(part)) is None:
            tokens = self.model.tokenize(part if part.isascii() else part.translate(self.spelling))
            out = self.known[part] = little([t.id for t in tokens])
        return out

    def learn(self, word: str) -> None:
        if _PLAIN.fullmatch(word):
            self.known[word] = b"".join(map(self.part, _PARTS.findall(word.lower())))
        else:
            self.known[word] = little(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.known) > CACHE:
            self.known = {"": b""}
        for w in set(words).difference(self.known):
            self.learn(w)
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece. A document's ids end with id 0."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = word_ids(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = ids.of(text or "") + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs, scan, "piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


class Bench:
    """Best fit of pieces into open bins: bins of equal free space share a slot, and a bit mask finds the tightest one."""

    def __init__(self, sizes: list[int], capacity: int, bins: Bins = ()):
        self.sizes, self.capacity, self.bins, self.mask = sizes, capacity, [], 0
        self.slots: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b in bins:
            self.bins.append(list(b))
            self._open(len(self.bins) - 1, capacity - sum(sizes[i] for i in b))

    def _open(self, k: int, free: int) -> None:
        self.slots[free].append(k)
        self.mask |= 1 << free

    def place(self, items: list[int]) -> Bins:
        """Place the items in the given order; a piece that fits nowhere opens a bin."""
        for i in items:
            size = self.sizes[i]
            rest = self.mask >> size
            if rest:
                free = size + (rest & -rest).bit_length() - 1
                k = self.slots[free].pop()
                if not self.slots[free]:
                    self.mask &= ~(1 << free)
                self.bins[k].append(i)
                self._open(k, free - size)
            else:
                self.bins.append([i])
                self._open(len(self.bins) - 1, self.capacity - size)
        return self.bins


def falling(items: list[int], sizes: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -sizes[i])


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then uneven filling: full bins leave room in others. Larger is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: Bins, donor: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """`into` with well-filled bins of `donor` injected; doubles dropped, displaced pieces placed by best fit."""
    full = [b for b in donor if sum(sizes[i] for i in b) >= 0.995 * capacity] or donor
    injected = rng.sample(full, max(1, len(full) // rng.randint(3, 8)))
    taken = {i for b in injected for i in b}
    keep = [b for b in into if taken.isdisjoint(b)]
    keep, loose = mutate(keep, sizes, capacity, rng)
    displaced = [i for b in into if not taken.isdisjoint(b) for i in b if i not in taken]
    return Bench(sizes, capacity, keep + injected).place(falling(displaced + loose, sizes))


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Dissolve bins with free space, by chance the emptier ones."""
    keep, loose = [], []
    for b in bins:
        free = 1 - sum(sizes[i] for i in b) / capacity
        if rng.random() < min(0.9, 6 * free):
            loose += b
        else:
            keep.append(b)
    return keep, loose


def fresh(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Bins:
    """Best fit in falling order of sizes blurred by `noise`."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    return Bench(sizes, capacity).place(order)


def evolve(sizes: list[int], capacity: int, seeds: list[Bins], rng: random.Random) -> Bins:
    """One epoch of an island; returns its elite. Ends early where the bound of total size is met."""
    bound = -(-sum(sizes) // capacity)
    people = [b for b in seeds if b] or [fresh(sizes, capacity, rng, 0.0)]
    while len(people) < GENOMES:
        people.append(fresh(sizes, capacity, rng, 0.15))
    score = lambda b: fitness(b, sizes, capacity)
    ranked = sorted(((score(b), b) for b in people), key=lambda x: x[0], reverse=True)
    for _ in range(CROSSOVERS):
        if len(ranked[0][1]) <= bound:
            break
        a, b = rng.sample(range(len(ranked)), 2)
        child = crossover(ranked[min(a, b)][1], ranked[max(a, b)][1], sizes, capacity, rng)
        ranked = sorted([*ranked, (score(child), child)], key=lambda x: x[0], reverse=True)[:GENOMES]
    return ranked[0][1]


def genome(bins: Bins, n: int) -> bytes:
    """A bin number for each piece."""
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def bins_of(data: bytes | None) -> Bins:
    if not data:
        return []
    owner = np.frombuffer(data, dtype=np.int32)
    out: Bins = [[] for _ in range(int(owner.max()) + 1)]
    for i, k in enumerate(owner.tolist()):
        out[k].append(i)
    return out


_STATE = "chunk long, island int, uids binary, sizes binary, genome binary"


def pack_chunks(items: DataFrame, capacity: int, chunks: int, epochs: int) -> DataFrame:
    """(uid, chunk, bin, offset, filled) for items (uid, length), none longer than `capacity`."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(chunks)), F.lit(chunks)).alias("chunk"))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        row = (frame["chunk"].iat[0], frame["uid"].to_numpy(np.int64).tobytes(), frame["length"].to_numpy(np.int32).tobytes())
        return pd.DataFrame([(row[0], k, row[1], row[2], None) for k in range(ISLANDS)], columns=["chunk", "island", "uids", "sizes", "genome"])

    def epoch(number: int):
        def live(frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            sizes = np.frombuffer(first["sizes"], dtype=np.int32).tolist()
            rng = random.Random(f"{first['chunk']} {first['island']} {number}")
            best = genome(evolve(sizes, capacity, [bins_of(g) for g in sorted(frame["genome"].dropna())], rng), len(sizes))
            to = [int(first["island"]), (int(first["island"]) + 1) % ISLANDS] if number + 1 < epochs else [int(first["island"])]
            return pd.DataFrame([(first["chunk"], k, first["uids"], first["sizes"], best) for k in to], columns=["chunk", "island", "uids", "sizes", "genome"])

        return live

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        uids, sizes = np.frombuffer(frame["uids"].iat[0], dtype=np.int64), np.frombuffer(frame["sizes"].iat[0], dtype=np.int32).tolist()
        best = max((bins_of(g) for g in sorted(frame["genome"])), key=lambda b: fitness(b, sizes, capacity))
        rows = []
        for k, b in enumerate(best):
            at, filled = 0, sum(sizes[i] for i in b)
            for i in b:
                rows.append((uids[i], frame["chunk"].iat[0], k, at, filled))
                at += sizes[i]
        return pd.DataFrame(rows, columns=["uid", "chunk", "bin", "offset", "filled"])

    state = dealt.groupBy("chunk").applyInPandas(gather, _STATE)
    for number in range(epochs):
        state = state.groupBy("chunk", "island").applyInPandas(epoch(number), _STATE)
    return state.groupBy("chunk").applyInPandas(settle, "uid long, chunk long, bin int, offset long, filled long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pack every document of `docs` (doc_id, text) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null, empty or blank text is the single id 0.
    Longer documents are cut into pieces of `capacity`; repeated rows and null ids are packed as documents of their own; an
    empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, tokenizer, capacity).withColumn("uid", F.monotonically_increasing_id())
    cut = materialise(cut, "pieces")
    small = cut.where(F.col("length") < capacity).select("uid", "length")
    n = small.count()
    out = cut.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for number in (0, 1):
        chunks = -(-n // CHUNK)
        if not chunks:
            break
        packed = materialise(pack_chunks(small, capacity, chunks, EPOCHS), f"packed-{number}")
        final = F.lit(number == 1 or chunks == 1) | (F.col("filled") >= FILLED * capacity)
        numbers = ((F.lit(number) * (1 << 40) + F.col("chunk")) * 4096 + F.col("bin")) * 2 + 1
        out = out.union(packed.where(final).select("uid", numbers.alias("sequence_id"), "offset"))
        if chunks == 1:
            break
        rest = packed.where(~final).select("uid")
        small, n = small.join(rest, "uid"), rest.count()
    return cut.join(out, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
