"""Statistics of deviations, counts per sector, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import epoch_micros
from ..session import materialise
from .ranking import exact_quantiles


def extent(df: DataFrame, value: str, margin: float = 0.1) -> DataFrame:
    """Map limits with a margin and the value range, over rows without missing parts."""
    clean = df.dropna(subset=["lon", "lat", value]).agg(
        *[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("a", F.min), ("b", F.max))],
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"),
    )
    width = lambda c: (F.col(f"{c}_b") - F.col(f"{c}_a")) * margin
    return clean.select(
        *[
            e
            for c in ("lon", "lat")
            for e in ((F.col(f"{c}_a") - width(c)).alias(f"{c}_lo"), (F.col(f"{c}_b") + width(c)).alias(f"{c}_hi"))
        ],
        "vmin",
        "vmax",
    )


def relative_to_first(df: DataFrame, key: str, t: str, out: str) -> DataFrame:
    """Subtract each key's smallest value. Aggregate and join, so that a hot key is reduced before the shuffle."""
    first = df.groupBy(key).agg(F.min(t).alias("_first"))
    return df.join(first, key).withColumn(out, F.col(t) - F.col("_first")).drop("_first")


def _implied_micros(arrival: str, model_s: str) -> Column:
    return epoch_micros(arrival) - F.rint(F.col(model_s) * 1e6).cast("long")


def implied_origins(df: DataFrame, arrival: str, model_s: str) -> DataFrame:
    """Origin time implied by each pick; needs no other pick of the quake."""
    return df.withColumn("implied_origin", F.timestamp_micros(_implied_micros(arrival, model_s)).cast("timestamp_ntz"))


def origin_deviation(df: DataFrame, key: str, arrival: str, model_s: str) -> DataFrame:
    """Origin time implied by each pick and its deviation in seconds from the quake's mean implied origin."""
    implied = df.withColumn("_us", _implied_micros(arrival, model_s))
    # Mean of offsets from each quake's earliest origin: exact sums of small integers.
    first = implied.groupBy(key).agg(
        F.min("_us").alias("_base"), F.sum("_us").alias("_sum"), F.count("_us").alias("_n")
    )
    base = F.col("_base")
    mean = (F.col("_sum") - base * F.col("_n")) / F.nullif(F.col("_n"), F.lit(0))
    return (
        implied.join(first, key)
        .withColumn("implied_origin", F.timestamp_micros("_us").cast("timestamp_ntz"))
        .withColumn("deviation_s", ((F.col("_us") - base) - mean) / 1e6)
        .drop("_us", "_base", "_sum", "_n")
    )


def origin_spread(df: DataFrame, key: str, arrival: str, origin: str) -> DataFrame:
    """First arrival and sample deviation of the implied origins in seconds, per quake (NULL for one origin).

    Origins count in whole microseconds; sums and sums of squares are whole numbers, so nothing is lost in their difference.
    """
    at = epoch_micros(origin).cast("long") - F.lit(800_000_000_000_000)
    whole = at.cast("decimal(19,0)")
    sums = df.groupBy(key).agg(
        F.min(arrival).alias("event_dt"), F.count(at).alias("_n"), F.sum(at).cast("decimal(19,0)").alias("_s"), F.sum((whole * whole).cast("decimal(38,0)")).cast("decimal(38,0)").alias("_q")
    )
    n = F.col("_n").cast("decimal(10,0)")
    squares = (n * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    deviation = F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") * (F.col("_n") - 1))) / 1e6)
    return sums.select(key, "event_dt", deviation.alias("deviation_std"))


def split_welch(df: DataFrame, at: str, value: str, cutoff: str) -> DataFrame:
    """Sizes and means before and from a date on, Welch's t and its degrees of freedom (NULL for groups of one)."""
    clean = df.dropna(subset=[at, value])
    before = F.col(at) < F.lit(cutoff).cast("timestamp_ntz")
    side = lambda cond: F.when(cond, F.col(value))
    s = clean.agg(
        F.count(side(before)).alias("n_a"), F.avg(side(before)).alias("mean_a"), F.var_samp(side(before)).alias("_va"),
        F.count(side(~before)).alias("n_b"), F.avg(side(~before)).alias("mean_b"), F.var_samp(side(~before)).alias("_vb"),
    )
    qa, qb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(qa + qb), F.lit(0.0))
    dof = (qa + qb) * (qa + qb) / F.nullif(qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1), F.lit(0.0))
    return s.select(
        "n_a", "n_b", "mean_a", "mean_b", F.when(enough, t).alias("t_stat"), F.when(enough, dof).alias("dof")
    )


def welch_p_value(test: DataFrame) -> DataFrame:
    from ..functions.pvalues import t_test_p

    return test.withColumn("p_val", t_test_p("t_stat", "dof"))


def pairwise_rms(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """RMS of all pairwise differences of station residuals, without forming pairs.

    A key has a handful of rows, which may lie anywhere: summing them up before the shuffle would hold nearly a sum per row in each
    task and save none of the shuffle, so rows meet by key first.
    """
    v = F.col(r)
    sums = df.select(*keys, r).repartition(*keys).groupBy(*keys).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    n = F.col("_n")
    pairs = (n * (n - 1) / 2).cast("long")
    spread = F.greatest(n * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0))
    rms = F.when(n > 1, F.sqrt(spread / F.nullif(pairs, F.lit(0)))).when(n == 1, 0.0)
    return sums.select(*keys, rms.alias("rms"), pairs.alias("n_pairs"))


def rms_summary(per_event: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, exact median, p10, p90 and number of quakes per iteration; iterations without values vanish."""
    have = materialise(per_event.filter(F.col("rms").isNotNull()).select(*keys, "rms"), "rms")
    means = have.groupBy(*keys).agg(F.avg("rms").alias("mean_rms"), F.count(F.lit(1)).alias("n_events"))
    q = exact_quantiles(have, keys, "rms", {"median_rms": 0.5, "p10_rms": 0.1, "p90_rms": 0.9})
    return means.join(q.drop("n_values"), keys)


def model_deviation(model: DataFrame, truth: DataFrame, keys: list[str], cell: list[str], value: str = "vp") -> DataFrame:
    """Mean absolute percent deviation per key; cells whose true value is near 0 do not count."""
    both = model.select(*keys, *cell, F.col(value).alias("_m")).join(
        truth.select(*keys, *cell, F.col(value).alias("_t")), [*keys, *cell]
    )
    size = F.abs("_t")
    pct = F.when(size >= 1e-12, F.abs(F.col("_m") - F.col("_t")) / F.nullif(size, F.lit(0.0)) * 100.0)
    return both.groupBy(*keys).agg(F.avg(pct).alias("avg_abs_pct_dev"))


def rms(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def sector(c: str, lo: float, hi: float, n: int) -> Column:
    """Bin number of n equal bins in [lo, hi); NULL outside."""
    b = F.floor((F.col(c) - lo) / ((hi - lo) / n)).cast("int")
    return F.when((F.col(c) < hi) & b.between(0, n - 1), b)


def dense_fill(counts: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """A count for every wanted combination of labels, 0 where none was seen."""
    return labels.join(counts, labels.columns, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def sector_year_counts(
    quakes: DataFrame, lon: tuple[float, float], lat: tuple[float, float], n: int, years: tuple[int, int] | None = None
) -> DataFrame:
    """Quakes per sector and year for all n x n sectors and all years (of the data, if none are given), zeros included."""
    binned = quakes.select(
        sector("lon", *lon, n).alias("sx"), sector("lat", *lat, n).alias("sy"), F.year("event_dttm").alias("year")
    ).filter(F.col("sx").isNotNull() & F.col("sy").isNotNull())
    if years:
        binned = binned.filter(F.col("year").between(*years))
        period = quakes.sparkSession.range(1).select(F.lit(years[0]).alias("lo"), F.lit(years[1]).alias("hi"))
    else:
        period = quakes.agg(F.year(F.min("event_dttm")).alias("lo"), F.year(F.max("event_dttm")).alias("hi")).filter("lo is not null")
    counts = binned.groupBy("sx", "sy", "year").agg(F.count(F.lit(1)).alias("cnt"))
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    labels = period.select(F.explode(axis).alias("sx"), "lo", "hi").select("sx", F.explode(axis).alias("sy"), "lo", "hi").select(
        "sx", "sy", F.explode(F.sequence("lo", "hi")).alias("year")
    )
    return dense_fill(counts, labels, "cnt")


def sector_extremes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sx", "sy").agg(F.min("cnt").alias("min_events"), F.max("cnt").alias("max_events"))


def sector_centres(stats: DataFrame, centres: DataFrame) -> DataFrame:
    """Statistics left-joined to the sector centres."""
    return stats.join(centres, ["sx", "sy"], "left")


def timing_summary(rows: DataFrame) -> DataFrame:
    """Total, mean and number of iterations per run."""
    return rows.groupBy("run_id").agg(
        F.round(F.sum("elapsed_s"), 3).alias("total_s"),
        F.round(F.avg("elapsed_s"), 3).alias("mean_iter_s"),
        F.count(F.lit(1)).alias("n_iterations"),
    )


def run_info(residuals: DataFrame, iterations: DataFrame, true_cells: DataFrame) -> DataFrame:
    """Stations, quakes and iterations per run and whether a true model is known."""
    per_run = residuals.groupBy("run_id").agg(
        F.count_distinct("iter").alias("n_iterations"),
        F.count_distinct("station_id").alias("n_stations"),
        F.count_distinct("event_id").alias("n_events"),
    )
    logged = iterations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_logged"))
    truth = true_cells.select("run_id").distinct().withColumn("has_true_model", F.lit(True))
    return (
        per_run.join(logged, "run_id", "left")
        .join(truth, "run_id", "left")
        .withColumns(
            {
                "n_logged": F.coalesce("n_logged", F.lit(0)),
                "has_true_model": F.coalesce("has_true_model", F.lit(False)),
            }
        )
    )
