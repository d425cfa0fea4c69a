"""Mixing sources to target weights: words are summed per source, targets become repetition rates, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction.

The documents are read for one aggregate and for one join with the table of sources; they are never sorted or grouped in one
place. The coin of a document depends on its id alone, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import row_index
from ..session import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
_UNIT = float(1 << 52)


def words_in(text: Column) -> Column:
    """Number of runs of characters other than the contracts' white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(seed: str) -> Column:
    """A number in [0, 1) from `seed` and doc_id; without an id, from the text, so that such rows are tossed apart."""
    of = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit("")))))
    return F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("long") / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the whole by weight, none above `most` times its source.

    Sources take the weights in turn, by code point, null last. What a stop sets free is shared anew among the others by weight; a
    round needs two sums of the small table and there is one only while a further source stops. Whole numbers are summed,
    so a target is one exact division away from them. Sources of size 0 get 0.
    """
    dealt = row_index(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    shares = dealt.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    whole = shares.agg(F.sum("source_size")).first()[0] or 0
    share: Column = F.lit(0.0)
    stopped, free = -1, F.lit(True)
    while True:
        row = shares.agg(
            F.sum(F.when(~free, F.col("cap"))).alias("held"), F.sum(F.when(free, F.col("weight"))).alias("open"), F.count(F.when(~free, 1)).alias("n")
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped = row["n"]
        share = F.col("weight") * F.lit(float(whole - (row["held"] or 0)) / row["open"])
        free = share <= F.col("cap")
    return shares.select("source", "source_size", F.when(free, share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix_rates(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows with source and size; a source without words has rate 0."""
    sizes = materialise(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return materialise(source_targets(sizes, weights, most).withColumn("rate", F.least(rate, F.lit(float(most)))), "mix-rates")


def copies_of(toss: Column, rate: Column) -> Column:
    """floor(rate), and one more where the toss falls below the fraction."""
    return (F.floor(rate) + (toss < rate - F.floor(rate)).cast("int")).cast("int")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, rate and copies (0 to `most`).

    A null or empty text has size 0; a source without words has target, rate and copies 0. Rows with one id share their coin,
    rows without an id toss by their text; repeated rows count each. Other columns are ignored. An empty table gives no rows.
    """
    slim = materialise(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), coin(seed).alias("toss")), "mix-sizes")
    rates = mix_rates(slim, weights, most).withColumnRenamed("source", "at")
    # No hint: Spark broadcasts the table of sources while it is small and splits hot sources otherwise.
    met = slim.join(rates, F.col("source").eqNullSafe(F.col("at")))
    return met.select("doc_id", "source", "size", "source_size", "target", "rate", copies_of(F.col("toss"), F.col("rate")).alias("copies"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of `docs` with all its columns as often as `plan_mix` says, in no order.

    `docs` needs doc_id, text and source; further columns may bear any name.
    """
    rates = mix_rates(docs.select("source", words_in(F.col("text")).alias("size")), weights, most)
    taken = {c.lower() for c in docs.columns}
    key, rate, copy = (name + "_" * sum(c.startswith(name) for c in taken) for name in ("mix_key", "mix_rate", "mix_copy"))
    met = docs.join(rates.select(F.col("source").alias(key), F.col("rate").alias(rate)), F.col("source").eqNullSafe(F.col(key)))
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies_of(coin(seed), F.col(rate))))).select(docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words the mix takes of the document, repeats counted)."""
    plan = plan_mix(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
