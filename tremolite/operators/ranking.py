"""Exact ranks, strides and quantiles of data of any size.

Nothing here sorts a whole data set or a whole group in one task: rows are range-partitioned by the sort order,
written once, and only one total per partition is accumulated across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def running_total(df: DataFrame, order: list[Column | str], weight: Column, out: str) -> DataFrame:
    """Add the running sum of `weight` over the total order `order` (ties must be broken by it)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # The row's position id holds its partition in the upper bits and its place in the sorted partition below.
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
        .withColumn("_w", weight)
    )
    totals = placed.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the sort, hence small by construction.
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = F.sum("_w").over(W.partitionBy("_part").orderBy("_pos"))
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_pos", "_part", "_w", "_local", "_offset")
    )


def row_index(df: DataFrame, order: list[Column | str], out: str = "row_no") -> DataFrame:
    """Zero-based position of every row in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def stride_sample(df: DataFrame, order: list[Column | str], max_points: int) -> DataFrame:
    """Every (n // max_points)-th row in a stated order when there are more than max_points rows."""
    ranked = row_index(df, order, "_rn")
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    return ranked.join(F.broadcast(size), F.lit(True)).filter(F.col("_rn") % step == 0).drop("_rn", "_n")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, also for a key holding most of the rows.

    Equal values are counted first, the distinct ones ranked with `running_total`, and each wanted position is read
    off by an aggregate.
    """
    counted = running_total(value_counts(df, keys, value), [*keys, value], F.col("_cnt"), "_upto")
    sizes = counted.groupBy(*keys).agg(
        F.sum("_cnt").alias("_n"), F.min(F.col("_upto") - F.col("_cnt")).alias("_start")
    )
    ranked = counted.join(sizes, keys)
    first = F.col("_upto") - F.col("_cnt") - F.col("_start")
    last = F.col("_upto") - F.col("_start") - 1
    aggs = [F.max("_n").alias("n_values")]
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_n") - 1)
        for label, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when(pos.between(first, last), F.col(value))).alias(f"_{name}_{label}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    lerp = lambda n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
    return picked.select(*keys, "n_values", *[lerp(n).alias(n) for n in quantiles])


def trimmed(df: DataFrame, value: str, quantile: float, tie: list[str]) -> DataFrame:
    """Rows at sorted positions [round((1-q) n), round(q n))."""
    ranked = row_index(df, [value, *tie], "_rn")
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    lo, hi = F.rint((1 - quantile) * F.col("_n")), F.rint(F.lit(quantile) * F.col("_n"))
    return (
        ranked.join(F.broadcast(size), F.lit(True))
        .filter((F.col("_rn") >= lo) & (F.col("_rn") < hi))
        .drop("_rn", "_n")
    )


def histogram(df: DataFrame, value: str, bins: int = 140) -> DataFrame:
    """Counts in equal-width bins between the extremes, the last bin closed; empty bins are listed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) / bins
    bin_no = F.least(F.coalesce(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(0)), F.lit(bins - 1))
    counts = df.join(F.broadcast(ends), F.lit(True)).groupBy(bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def frame_index(df: DataFrame, day: str, out: str = "frame") -> DataFrame:
    """Number the sorted distinct days from 0 and attach the number to every row."""
    days = row_index(df.select(day).filter(F.col(day).isNotNull()).distinct(), [day], out)
    return df.join(days, day)
