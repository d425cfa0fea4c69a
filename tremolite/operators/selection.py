"""Exact quantiles per key by bisected counts: no sort of the values, neither of all nor of one key's.

Each key has an interval that holds the wanted positions. A round counts the values of the interval in equal bins, keeps the bin with
the wanted positions and takes that bin's own least and greatest value as the next interval, until few values are left; only these are
put in order. All rounds are partial sums; a round's state is one row per open key. Keys with few values need no round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

# Values of a key that may be put in order by one task.
FEW = 4096
BINS = 512


def _positions(q: float) -> tuple[Column, Column, Column]:
    """Lower and upper position of a quantile among n values, and its place between them."""
    at = F.lit(q) * (F.col("_n") - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def quantile(values: DataFrame, keys: list[str], value: str, q: float, out: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """Linear-interpolated quantile `q` of `value` per key (null keys are a key, null values don't count): keys and `out`.

    `values` is read once per round; store it first where it is costly. A round divides the interval by `bins` at least, so
    the number of rounds does not depend on the number of values; equal values end a key's search at once.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    lo, hi, share = _positions(q)
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    state = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b")), "quantile")
    if (state.agg(F.max("_n")).first()[0] or 0) <= few:
        listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), F.count(F.lit(1)).alias("_n"))
        x, y = (F.element_at("_vs", (c + 1).cast("int")) for c in (lo, hi))
        return listed.select(*keys, (x + (y - x) * share).alias(out))
    state = state.select(*keys, lo.alias("_lo"), hi.alias("_hi"), share.alias("_f"), "_a", "_b", F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_skip"))
    done = []
    while True:
        found = state.where("_in = 0 or _a = _b")
        done.append(found.select(*keys, "_f", F.col("_a").alias("_x"), F.col("_b").alias("_y")))
        small = state.where(f"_in > 0 and _a < _b and _in <= {few}")
        inside = _inside(rows, small, keys)
        ordered = inside.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), *[F.first(c).alias(c) for c in ("_lo", "_hi", "_f", "_skip")])
        pick = lambda c: F.element_at("_vs", (F.col(c) - F.col("_skip") + 1).cast("int"))
        done.append(ordered.select(*keys, "_f", pick("_lo").alias("_x"), pick("_hi").alias("_y")))
        open_ = state.where(f"_a < _b and _in > {few}")
        if open_.isEmpty():
            break
        state = materialise(_narrow(rows, open_, keys, bins), "quantile")
    out_rows = done[0]
    for more in done[1:]:
        out_rows = out_rows.unionByName(more)
    return out_rows.select(*keys, (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_f")).alias(out))


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in their key's interval, with the state."""
    named = state.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_lo", "_hi", "_f", "_a", "_b", "_skip")
    on = (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b"))
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(named, on).drop(*[f"_k{n}" for n in range(len(keys))])


def _narrow(rows: DataFrame, state: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """One round: the interval of the bin with both positions; two values and no open interval where they fall apart."""
    at = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    counts = _inside(rows, state, keys).groupBy(*keys, at.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"), *[F.first(c).alias(c) for c in ("_lo", "_hi", "_f", "_skip")]
    )
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = counts.withColumn("_before", F.col("_skip") + before)
    holds = lambda c: (F.col(c) >= F.col("_before")) & (F.col(c) < F.col("_before") + F.col("_c"))
    of = lambda c, v: F.max(F.when(holds(c), F.col(v)))
    ends = upto.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("_lo", "_hi", "_f")], of("_lo", "_bin").alias("_p"), of("_hi", "_bin").alias("_q"), of("_lo", "_before").alias("_skip"),
        of("_lo", "_c").alias("_in"), of("_lo", "_l").alias("_l1"), of("_lo", "_h").alias("_h1"), of("_hi", "_l").alias("_l2"),
    )
    same = F.col("_p") == F.col("_q")
    return ends.select(
        *keys, "_lo", "_hi", "_f", F.when(same, F.col("_l1")).otherwise(F.col("_h1")).alias("_a"), F.when(same, F.col("_h1")).otherwise(F.col("_l2")).alias("_b"),
        F.when(same, F.col("_in")).otherwise(F.lit(0)).cast("long").alias("_in"), "_skip",
    )
