"""Prefix trie of conversations with subtree totals by depth bands.

A node is known by its depth and the XOR of position-bound 128-bit hashes of its turns, so ids and parents' ids come from one running XOR
along a conversation. Totals of subtrees: nodes explode only to their ancestors inside a band of `HEIGHT` depths; the roots of the
bands form a trie of their own, whose totals are found in the same way; the completed totals of the roots below a band then go to the band's nodes.
A node explodes to at most 2 x HEIGHT rows, and the rounds grow with the logarithm of the depth.

Ranks and running XORs run along one range-partitioned sort, with one carry per conversation that crosses a border of
partitions; a single conversation may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage, materialise
from .mixing import words_in

HEIGHT = 16
GROUP = 20
_KEY = ["depth", "p1", "p2"]
_CHUNK = 256


def _two(at: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a turn at a place."""
    return F.xxhash64(F.lit(1), at, first, second), F.xxhash64(F.lit(2), at, first, second)


def placed_turns(talks: DataFrame) -> DataFrame:
    """conv_id, turn's hashes and words, in one total order that is cut into range partitions and stored with places."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h1, h2 = _two(F.lit(0), role, text)
    slim = talks.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), "turn", h1.alias("h1"), h2.alias("h2"), words_in(text).alias("words"))
    sort = slim.orderBy("c", F.col("turn").asc_nulls_first(), "h1", "h2").withColumn("at", F.monotonically_increasing_id())
    return cut_lineage(sort.select("c", "h1", "h2", "words", "at", F.shiftright("at", 33).alias("part")))


def along(rows: DataFrame, totals: dict[str, Column], join: dict[str, tuple]) -> DataFrame:
    """Add running aggregates within each conversation over the stored order.

    `totals` names a running aggregate and gives its aggregate column; `join` has, per name, the aggregate of totals of parts
    and the operation that puts a carry before a running value.
    """
    inside = W.partitionBy("part", "c").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy("part", "c").agg(*[v.alias(k) for k, v in totals.items()])
    # A conversation has one row per partition that it touches.
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select("part", "c", *[join[k][0](k).over(before).alias(f"_{k}") for k in totals]).where(F.col(f"_{next(iter(totals))}").isNotNull())
    local = rows.select("*", *[v.over(inside).alias(k) for k, v in totals.items()])
    # At most one carry per partition of the sort: a bound by construction.
    met = local.join(F.broadcast(carry), ["part", "c"], "left")
    return met.select(*rows.columns, *[join[k][1](F.coalesce(f"_{k}", F.lit(0)), F.col(k)).alias(k) for k in totals])


def _xor(name: str) -> tuple:
    return F.bit_xor, lambda a, b: a.bitwiseXOR(b)


def rebuilt(talks: DataFrame) -> DataFrame:
    """One row per conversation and depth (0 for the empty start): c, depth, key p1, p2, parent's key q1, q2, words, last (ends here)."""
    numbered = materialise(along(placed_turns(talks), {"pos": F.count(F.lit(1))}, {"pos": (F.sum, lambda a, b: a + b)}), "trie-turns")
    base = lambda c: c - F.pmod(c, F.lit(GROUP))
    own = numbered.groupBy("c").agg(F.max("pos").alias("n")).select("c", "n", base(F.col("c")).alias("b"), F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(4)).alias("h"))
    # The three first turns of a base conversation, in one small array.
    heads = numbered.where((F.pmod("c", F.lit(GROUP)) == 0) & (F.col("pos") <= 3)).groupBy(F.col("c").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head")
    )
    empty = F.array().cast(heads.schema["head"].dataType)
    talk = own.join(heads, "b", "left").withColumn("head", F.slice(F.coalesce("head", empty), F.lit(1), F.col("h").cast("int")))
    # Key of the first d head turns, for every d.
    term = lambda k: F.transform("head", lambda t: _two(t["pos"], t["h1"], t["h2"])[k])
    talk = talk.withColumn("t1", term(0)).withColumn("t2", term(1)).withColumn("k", F.size("head").cast("long"))
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    talk = materialise(
        talk.select("c", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"), "head", "t1", "t2", total("t1").alias("x1"), total("t2").alias("x2")), "trie-talks"
    )
    zero = F.lit(0).cast("long")
    start = talk.select("c", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("words"), (F.col("size") == 0).alias("last"))
    upto = lambda name, d: F.aggregate(F.slice(name, F.lit(1), d), zero, lambda a, x: a.bitwiseXOR(x))
    front = talk.select("c", "size", "t1", "t2", "head", F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(1), F.col("k").cast("int")))).alias("d")).select(
        "c", F.col("d").cast("long").alias("depth"), upto("t1", F.col("d")).alias("p1"), upto("t2", F.col("d")).alias("p2"),
        upto("t1", F.col("d") - 1).alias("q1"), upto("t2", F.col("d") - 1).alias("q2"), F.element_at("head", F.col("d"))["words"].alias("words"), (F.col("d") == F.col("size")).alias("last"),
    )
    rest = numbered.join(talk.select("c", "h", "k", "size", "x1", "x2"), "c").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    e1, e2 = _two(F.col("depth"), F.col("h1"), F.col("h2"))
    rest = rest.select("part", "at", "c", "depth", "size", "words", "x1", "x2", e1.alias("e1"), e2.alias("e2"))
    rest = along(rest, {"r1": F.bit_xor("e1"), "r2": F.bit_xor("e2")}, {"r1": _xor("r1"), "r2": _xor("r2")})
    p1, p2 = F.col("x1").bitwiseXOR(F.col("r1")), F.col("x2").bitwiseXOR(F.col("r2"))
    rest = rest.select("c", "depth", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("e1")).alias("q1"), p2.bitwiseXOR(F.col("e2")).alias("q2"), "words", (F.col("depth") == F.col("size")).alias("last"))
    return start.unionByName(front).unionByName(rest)


def ends_of(rows: DataFrame) -> DataFrame:
    """Key and ends_sha256 of every node at which a conversation ends.

    Ids are joined in chunks of `_CHUNK` neighbouring ids first; the chunks of a node then pass a running digest in order, one
    batch in memory at a time (SHA-256 of one text can only be computed from its front to its end).
    """
    chunk = F.floor(F.col("c") / _CHUNK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    chunks = rows.where("last").groupBy(*_KEY, chunk.alias("chunk")).agg(ids.alias("ids"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for frame in frames:
            done = []
            for depth, p1, p2, ids in zip(frame["depth"], frame["p1"], frame["p2"], frame["ids"], strict=True):
                if (depth, p1, p2) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (depth, p1, p2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=[*_KEY, "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*_KEY, "ends_sha256"])

    sort = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
    return sort.mapInPandas(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def subtree_totals(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int, height: int = HEIGHT, step: int = 1) -> DataFrame:
    """Sums of `values` over the subtree of every node at a depth that `step` divides: key and the sums.

    `nodes`: key, conv_id (a member) and own values, at such depths; `rows`: c, key at the same depths; `deepest`: their largest depth.
    """
    level = lambda: F.floor(F.col("depth") / step)
    band = (level() / height).cast("long")
    # Keys of the nodes that a conversation passes inside a band, at most `height` of them, by depth.
    paths = rows.groupBy(F.col("c").alias("conv_id"), band.alias("band")).agg(F.sort_array(F.collect_list(F.struct(*_KEY))).alias("path"))

    def lift(source: DataFrame, upto: Column) -> DataFrame:
        up = source.select(F.explode(upto).alias("key"), *values)
        return up.groupBy("key").agg(*[F.sum(v).alias(v) for v in values]).select("key.*", *values)

    banded = nodes.withColumn("band", band).join(paths, ["conv_id", "band"])
    inside = lift(banded, F.slice("path", F.lit(1), (level() % height + 1).cast("int")))
    if deepest < step * height:
        return inside
    inside = materialise(inside, "trie-bands")
    root = F.col("depth") % (step * height) == 0
    members = nodes.where(root).select(*_KEY, "conv_id")
    roots = materialise(subtree_totals(inside.where(root).join(members, _KEY), rows.where(root), values, deepest, height, step * height), "trie-roots")
    # What hangs below a band: its completed roots, brought to the nodes of the band above except to that band's own root.
    below = roots.where("depth > 0").join(members, _KEY).withColumn("band", band - 1).join(paths, ["conv_id", "band"])
    lifted = lift(below, F.slice("path", F.lit(2), F.lit(height)))
    rest = inside.where(~root).unionByName(lifted).groupBy(*_KEY).agg(*[F.sum(v).alias(v) for v in values])
    return rest.unionByName(roots)


def conversation_trie(talks: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of rebuilt conversations, one row per node.

    `talks` has conv_id, turn, role and text. Turns are ordered by `turn`, null first, equal ones by hash; null roles and texts are
    empty; rows without conv_id belong to no conversation. A conversation begins with the first h turns of conversation c - c % 20
    (h = crc32 of its id modulo 4) and goes on with its own turns after its first h; it may have none and then ends at the root.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Repeated rows are turns of their
    own; no rows give no nodes; other columns are ignored.
    """
    rows = materialise(rebuilt(talks), "trie-rows")
    grouped = rows.groupBy(*_KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    grouped = materialise(grouped, "trie-nodes")
    inner = grouped.where("depth > 0")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = grouped.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = grouped.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialise(nodes, "trie-counts")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = ["n_leaves", "saved_tokens"]
    totals = subtree_totals(nodes.select(*_KEY, "conv_id", *values), rows.select("c", *_KEY), values, deepest, height)
    met = nodes.drop(*values).join(totals, _KEY).join(ends_of(rows), _KEY, "left").join(parents, ["depth", "q1", "q2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
