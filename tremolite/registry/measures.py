"""Deviation statistics, sectors, histograms and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as cat, fields as fd, measures as ms, ranking as rk
from . import r, register, fine
from .catalogue import TRAVEL
from .sqltext import fine as st

# Implied origins: arrival minus the travel time from the station to the quake's cell of the location lattice.
LOOKUP_SQL = f"""lk as (select a.event_id, a.pick_id, a.arrival_dttm, t.t as model_s
    from in_arrivals a join in_lattice_times t on 'ST'||cast(t.station_id as varchar) = a.station_nm and t.i = a.event_id % 5
      and t.j = cast(floor(a.event_id/5) as int) % 5 and t.k = (a.event_id*3) % 5
    where a.arrival_dttm is not null)"""
IMPLIED_SQL = (
    LOOKUP_SQL
    + """, io as (select *, epoch_us(arrival_dttm) - cast(round_even(model_s*1e6,0) as bigint) as us from lk)"""
)


def model_times(tb):
    """Picks with the modelled travel time between the station and the quake's cell."""
    field = tb.lattice_times.select(
        F.concat(F.lit("ST"), F.col("station_id").cast("string")).alias("station_nm"), "i", "j", "k",
        F.col("t").alias("model_s"),
    )
    e = F.col("event_id")
    picks = tb.arrivals.filter(F.col("arrival_dttm").isNotNull()).withColumns(
        {"i": (e % 5).cast("int"), "j": (F.floor(e / 5) % 5).cast("int"), "k": ((e * 3) % 5).cast("int")}
    )
    return picks.join(fd.shuffled(field), ["station_nm", "i", "j", "k"]).select("event_id", "pick_id", "arrival_dttm", "model_s")


def implied(tb):
    return ms.origin_deviation(model_times(tb), "event_id", "arrival_dttm", "model_s")


@register(
    "origin_deviation",
    f"""with {IMPLIED_SQL}, b as (select *, us - min(us) over (partition by event_id) as off from io)
    select event_id, pick_id, {st('(off - avg(off) over (partition by event_id))/1e6', 7)} as deviation_s from b""",
    "arrivals lattice_times",
)
def origin_deviation(tb):
    return implied(tb).select("event_id", "pick_id", fine("deviation_s", 7))


SPREAD_SQL = (
    IMPLIED_SQL
    + """, sp as (select event_id, min(arrival_dttm) event_dt, stddev_samp((us - first_us)/1e6) deviation_std from (select *, min(us) over (partition by event_id) first_us from io) z group by 1)"""
)


def spread(tb):
    return ms.origin_spread(ms.implied_origins(model_times(tb), "arrival_dttm", "model_s"), "event_id", "arrival_dttm", "implied_origin")


@register(
    "event_origin_spread",
    f"with {SPREAD_SQL} select event_id, event_dt, {st('deviation_std', 5)} as deviation_std from sp",
    "arrivals lattice_times",
)
def event_origin_spread(tb):
    return spread(tb).select("event_id", "event_dt", fine("deviation_std", 5))


@register(
    "split_welch",
    f"""with {SPREAD_SQL}, a as (select count(*) n, avg(deviation_std) m, var_samp(deviation_std) v from sp where deviation_std is not null and event_dt < timestamp '1998-03-01'),
    b as (select count(*) n, avg(deviation_std) m, var_samp(deviation_std) v from sp where deviation_std is not null and event_dt >= timestamp '1998-03-01')
    select a.n n_a, b.n n_b, round(a.m,6) mean_a, round(b.m,6) mean_b, round((a.m-b.m)/sqrt(a.v/a.n+b.v/b.n),6) t_stat,
      round(pow(a.v/a.n+b.v/b.n,2)/(pow(a.v/a.n,2)/(a.n-1)+pow(b.v/b.n,2)/(b.n-1)),4) dof from a cross join b""",
    "arrivals lattice_times",
)
def split_welch(tb):
    out = ms.split_welch(spread(tb), "event_dt", "deviation_std", "1998-03-01")
    return out.select("n_a", "n_b", r("mean_a"), r("mean_b"), r("t_stat"), r("dof", 4))


@register(
    "split_welch_pvalue",
    f"""with {SPREAD_SQL}, a as (select count(*) n, avg(deviation_std) m, var_samp(deviation_std) v from sp where deviation_std is not null and event_dt < timestamp '1998-03-01'),
    b as (select count(*) n, avg(deviation_std) m, var_samp(deviation_std) v from sp where deviation_std is not null and event_dt >= timestamp '1998-03-01'),
    w as (select a.n n_a, b.n n_b, (a.m-b.m)/sqrt(a.v/a.n+b.v/b.n) t, pow(a.v/a.n+b.v/b.n,2)/(pow(a.v/a.n,2)/(a.n-1)+pow(b.v/b.n,2)/(b.n-1)) d from a cross join b),
    x as (select *, d/2 as h, t*t/(d + t*t) as y from w)
    select n_a, n_b, round(t, 6) t_stat, round(1 - sum(exp(lgamma(h + 0.5e0 + m) - lgamma(h) - lgamma(0.5e0) + lgamma(1.5e0) - lgamma(m + 1.5e0) + (m + 0.5e0)*ln(y) + h*ln(1 - y)) * 2), 6) as p_val
    from x cross join range(100000) r(m) group by n_a, n_b, t""",
    "arrivals lattice_times",
)
def split_welch_pvalue(tb):
    out = ms.welch_p_value(ms.split_welch(spread(tb), "event_dt", "deviation_std", "1998-03-01"))
    return out.select("n_a", "n_b", r("t_stat"), r("p_val"))


@register(
    "relative_arrivals",
    f"""select a.event_id, a.pick_id, round(t - min(t) over (partition by event_id), 6) as rel_s
    from (select a.event_id, a.pick_id, {TRAVEL} as t from in_arrivals a join in_quakes e on e.event_id = a.event_id) a""",
    "arrivals quakes",
)
def relative_arrivals(tb):
    from ..functions.scalars import travel_seconds

    both = tb.arrivals.join(tb.quakes.select("event_id", "event_dttm"), "event_id").select(
        "event_id", "pick_id", travel_seconds("event_dttm", "arrival_dttm").alias("t")
    )
    return ms.relative_to_first(both, "event_id", "t", "rel_s").select("event_id", "pick_id", r("rel_s"))


RMS_SQL = """select run_id, iter, event_id, case when count(r) > 1 then sqrt(greatest(count(r)*sum(r*r) - sum(r)*sum(r), 0)/(count(r)*(count(r)-1)/2))
    else 0.0e0 end rms, cast(count(r)*(count(r)-1)/2 as bigint) n_pairs from in_run_residuals group by 1, 2, 3"""


@register(
    "hypo_rms",
    f"""with p as (select a.run_id, a.iter, a.event_id, sqrt(avg(pow(a.r - b.r, 2))) rms, count(*) n_pairs from in_run_residuals a
      join in_run_residuals b on a.run_id = b.run_id and a.iter = b.iter and a.event_id = b.event_id and a.station_id < b.station_id group by 1,2,3),
    e as (select distinct run_id, iter, event_id from in_run_residuals)
    select e.run_id, e.iter, e.event_id, {st('coalesce(p.rms, 0)', 5)} rms, coalesce(p.n_pairs, 0) n_pairs
    from e left join p on p.run_id = e.run_id and p.iter = e.iter and p.event_id = e.event_id""",
    "run_residuals",
)
def hypo_rms(tb):
    """Per-quake RMS of pair differences; the SQL forms the pairs, the plan does not."""
    out = ms.pairwise_rms(tb.run_residuals, ["run_id", "iter", "event_id"], "r")
    return out.select("run_id", "iter", "event_id", fine("rms", 5), "n_pairs")


@register(
    "hypo_summary",
    f"""select run_id, iter, round(avg(rms),6) mean_rms, {st('quantile_cont(rms, 0.5)', 5)} median_rms, {st('quantile_cont(rms, 0.1)', 5)} p10_rms,
      {st('quantile_cont(rms, 0.9)', 5)} p90_rms, count(*) n_events from ({RMS_SQL}) p group by 1, 2""",
    "run_residuals",
)
def hypo_summary(tb):
    per_event = ms.pairwise_rms(tb.run_residuals, ["run_id", "iter", "event_id"], "r")
    out = ms.rms_summary(per_event, ["run_id", "iter"])
    q = [fine(c, 5) for c in ("median_rms", "p10_rms", "p90_rms")]
    return out.select("run_id", "iter", r("mean_rms"), *q, "n_events")


@register(
    "model_deviation",
    """select m.model_id, round(avg(case when abs(t.vp) >= 1e-12 then abs(m.vp-t.vp)/abs(t.vp)*100 end), 6) avg_abs_pct_dev
    from in_cells m join in_true_cells t on m.model_id = t.model_id and m.i = t.i and m.j = t.j and m.k = t.k group by 1""",
    "cells true_cells",
)
def model_deviation(tb):
    out = ms.model_deviation(tb.cells, tb.true_cells, ["model_id"], ["i", "j", "k"])
    return out.select("model_id", r("avg_abs_pct_dev"))


@register(
    "experiment_vs_truth",
    """select m.model_id, m.i, m.j, m.k, m.vp, t.vp as vp_true, m.vp - t.vp as diff
    from in_cells m join in_true_cells t on m.model_id = t.model_id and m.i = t.i and m.j = t.j and m.k = t.k""",
    "cells true_cells",
)
def experiment_vs_truth(tb):
    cell = ["model_id", "i", "j", "k"]
    truth = tb.true_cells.select(*cell, F.col("vp").alias("vp_true"))
    return tb.cells.select(*cell, "vp").join(truth, cell).withColumn("diff", F.col("vp") - F.col("vp_true"))


@register(
    "rms_by_iteration",
    "select run_id, iter, round(sqrt(avg(r*r)), 6) rms from in_run_residuals group by 1, 2",
    "run_residuals",
)
def rms_by_iteration(tb):
    return ms.rms(tb.run_residuals, ["run_id", "iter"], "r").select("run_id", "iter", r("rms"))


SECTOR_SQL = """b as (select cast(floor((lon - 157.0)/(8.0e0/5)) as int) sx, cast(floor((lat - 50.5e0)/(6.0e0/5)) as int) sy, year(event_dttm) y
      from in_quakes where lon >= 157 and lon < 165 and lat >= 50.5 and lat < 56.5),
    c as (select sx, sy, y, count(*) cnt from b group by 1,2,3),
    f as (select sx, sy, y as year, coalesce(cnt, 0) cnt from (select a.i sx, b.i sy, t.i y from range(5) a(i) cross join range(5) b(i) cross join (select unnest(range(lo, hi + 1)) i from (select min(year(event_dttm)) lo, max(year(event_dttm)) hi from in_quakes)) t) z
      left join c using (sx, sy, y))"""


def _sectors(tb):
    return ms.sector_year_counts(tb.quakes, (157.0, 165.0), (50.5, 56.5), 5)


@register("dense_fill", f"with {SECTOR_SQL} select sx, sy, year, cnt from f", "quakes")
def dense_fill(tb):
    return _sectors(tb).select("sx", "sy", "year", "cnt")


@register(
    "sector_counts",
    f"with {SECTOR_SQL} select sx, sy, min(cnt) min_events, max(cnt) max_events from f group by 1, 2",
    "quakes",
)
def sector_counts(tb):
    return ms.sector_extremes(_sectors(tb))


@register(
    "sector_left_join",
    f"""with {SECTOR_SQL} select sx, sy, round(157 + (sx+0.5)*8.0e0/5, 6) center_lon, round(50.5e0 + (sy+0.5)*6.0e0/5, 6) center_lat,
      min(cnt) min_events, max(cnt) max_events from f group by 1, 2""",
    "quakes",
)
def sector_left_join(tb):
    n = F.col("id")
    sx, sy = F.floor(n / 5).cast("int"), (n % 5).cast("int")
    centres = tb.spark.range(25).select(
        sx.alias("sx"), sy.alias("sy"), r(157 + (sx + 0.5) * 8.0 / 5, 6, "center_lon"), r(50.5 + (sy + 0.5) * 6.0 / 5, 6, "center_lat")
    )
    return ms.sector_centres(ms.sector_extremes(_sectors(tb)), centres)


TRIM_SQL = """w as (select delta_t_s v, row_number() over (order by delta_t_s, event_id, station_nm, pick_no, delta_t_p) - 1 rn, count(*) over () n from in_travel_times),
    t as (select v from w where rn >= round_even((1-0.95e0)*n, 0) and rn < round_even(0.95e0*n, 0))"""


@register(
    "trimmed_histogram",
    f"""with {TRIM_SQL}, e as (select min(v) lo, max(v) hi from t),
    h as (select least(cast(floor((v-lo)/((hi-lo)/140)) as int), 139) bin, count(*) cnt from t cross join e group by 1)
    select cast(z.i as int) bin, coalesce(h.cnt, 0) cnt from range(140) z(i) left join h on h.bin = z.i""",
    "travel_times",
)
def trimmed_histogram(tb):
    kept = rk.trimmed(tb.travel_times, "delta_t_s", 0.95, ["event_id", "station_nm", "pick_no", "delta_t_p"])
    return rk.histogram(kept, "delta_t_s")


@register(
    "stride_sample",
    """select station_id, i, j, k, t from (select *, row_number() over (order by station_id, i, j, k) - 1 rn, count(*) over () n
      from in_lattice_times where t between 0.4 and 0.6) z where rn % greatest(1, cast(floor(n/1000) as bigint)) = 0""",
    "lattice_times",
)
def stride_sample(tb):
    return rk.stride_sample(tb.lattice_times.filter(F.col("t").between(0.4, 0.6)), ["station_id", "i", "j", "k"], 1000)


@register(
    "wavefront_slice",
    "select station_id, i, j, k, t, round((t - 0.4)/0.2, 6) norm_time from in_lattice_times where t >= 0.5e0 - 0.1e0 and t <= 0.5e0 + 0.1e0",
    "lattice_times",
)
def wavefront_slice(tb):
    from ..operators.predicates import wavefront

    out = wavefront(tb.lattice_times, 0.5, 0.1)
    return out.select("station_id", "i", "j", "k", "t", r("norm_time"))


@register(
    "timing_summary",
    """select run_id, round(sum(elapsed_s),3) total_s, round(avg(elapsed_s),3) mean_iter_s, count(*) n_iterations
    from in_run_iterations group by 1""",
    "run_iterations",
)
def timing_summary(tb):
    return ms.timing_summary(tb.run_iterations)


@register(
    "run_info",
    """select r.run_id, count(distinct r.iter) n_iterations, count(distinct station_id) n_stations, count(distinct event_id) n_events,
      (select count(*) from in_run_iterations t where t.run_id = r.run_id) n_logged,
      r.run_id in (select 'run_'||cast(model_id as varchar) from in_true_cells) has_true_model
    from in_run_residuals r group by r.run_id""",
    "run_residuals run_iterations true_cells",
)
def run_info(tb):
    truth = tb.true_cells.select(F.concat(F.lit("run_"), F.col("model_id").cast("string")).alias("run_id"))
    return ms.run_info(tb.run_residuals, tb.run_iterations, truth)


@register(
    "run_listing",
    "select distinct run_id, iter from in_run_residuals",
    "run_residuals",
)
def run_listing(tb):
    """Runs newest first, iterations in numeric order."""
    return tb.run_residuals.select("run_id", "iter").distinct().orderBy(F.desc("run_id"), "iter")


@register(
    "station_list",
    "select distinct lon, lat from in_stations where lon is not null and (station_nm, network_nm) in (select station_nm, network_nm from in_arrivals)",
    "stations arrivals",
)
def station_list(tb):
    seen = tb.arrivals.select(*cat.STATION_KEY).distinct()
    return tb.stations.dropna(subset=["lon", "lat"]).join(seen, cat.STATION_KEY, "left_semi").select("lon", "lat").distinct()
