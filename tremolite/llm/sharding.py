"""Sharding over fixed virtual slots: records hash into slots, bytes are summed per slot, and a stored, versioned map says
which shard owns a slot. Rebalancing edits that map; records never change their slot.

DataFrame functions only. The one table that reaches the driver has a row per slot (`SLOTS`, a fixed parameter).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path

SLOTS = 4096


def slot_of(slots: int = SLOTS) -> Column:
    """The slot of a record, from its id and its text's checksum, so that rows without an id spread as well."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size in bytes (null text: none) plus one, checksum of the text and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return slim.withColumn("virtual_slot", slot_of(slots))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has any."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first version: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def edit_map(owner: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """A rebalanced map: move single slots from the fullest to the emptiest shard while that narrows their gap."""
    owner = list(owner)
    load, held = [0] * shards, [set() for _ in range(shards)]
    for s, k in enumerate(owner):
        load[k] += weight.get(s, 0)
        held[k].add(s)
    while True:
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        moves = [(abs(gap - 2 * weight[s]), s) for s in held[full] if 0 < weight.get(s, 0) < gap]
        if not moves:
            return owner
        s = min(moves)[1]
        held[full].remove(s)
        held[empty].add(s)
        load[full] -= weight[s]
        load[empty] += weight[s]
        owner[s] = empty


def map_rows(spark: SparkSession, owner: list[int], version: int) -> DataFrame:
    """A map as rows (version, virtual_slot, shard)."""
    dealt = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.posexplode(dealt).alias("virtual_slot", "s")).select(
        "version", "virtual_slot", F.col("s").cast("int").alias("shard")
    )


def store_map(spark: SparkSession, owner: list[int], version: int, path: str) -> None:
    """Append one version of the map to the table at `path`."""
    map_rows(spark, owner, version).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The map's rows of one version; the others aren't read."""
    return spark.read.parquet(path).where(F.col("version") == version).select("virtual_slot", "shard")


def newest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """Version and owners of the newest map at `path`, one row per slot; version 0 and no owners where there is none."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return 0, {}
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        return 0, {}
    return version, {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, version).collect()}


def rebalance(spark: SparkSession, path: str, weight: dict[int, int], shards: int, slots: int = SLOTS) -> int:
    """Edit the newest stored map to the bytes per slot, store the result and return its version.

    The first map deals the slots in turn. Slots of shards that are no more are dealt in turn; a map that needs no edit gets no new
    version.
    """
    version, owners = newest_map(spark, path)
    if not owners:
        version, owners = 1, dict(enumerate(even_map(shards, slots)))
        store_map(spark, even_map(shards, slots), version, path)
    if len(owners) != slots:
        raise ValueError(f"the stored map has {len(owners)} slots, not {slots}")
    old = [owners[s] for s in range(slots)]
    new = edit_map([k if k < shards else s % shards for s, k in enumerate(old)], weight, shards)
    if new == old:
        return version
    store_map(spark, new, version + 1, path)
    return version + 1


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Put every row of `docs` (doc_id, text) into one of `shards` shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, law (`bytes`), shard, slot (the record's place in its shard, from 0 without gaps),
    grown_shard (null) and virtual_slot. Version 1 of the map deals the slots in turn, version 2 is edited to equal bytes; both
    are stored at `path`. A later call with that `path` loads the newest map and edits it further. Equal texts spread over slots by
    their ids; rows with equal id and text stay in one slot. A null or empty text has size 1; rows with null ids spread by their texts; repeated rows keep
    their places side by side in one slot; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    recs = records(docs, slots)
    sums = slot_bytes(recs)
    weight = {r["virtual_slot"]: r["bytes"] for r in sums.collect()}
    owned = load_map(spark, path, rebalance(spark, path, weight, shards, slots))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.join(owned, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = recs.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(bases), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
