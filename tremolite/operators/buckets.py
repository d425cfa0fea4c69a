"""Misfits of whole lattices without a row per observation and cell.

Quakes are dealt to buckets by their hash. Stations whose times agree in all cells make one site, and the packed times of every site (one row
per site, with its stations) are sent to each bucket. A bucket's rows arrive sorted, sites first and then quake after quake, so a task holds the
sites' times and a few thousand observations; times beyond `HELD` bytes lie in a mapped temporary file. What is shuffled are the observations
once and the sites once per bucket; a misfit per quake and cell exists only inside a task.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .cells import CELL

# Buckets of quakes; each gets the times of all sites.
BUCKETS = 64
# Cells of a lattice that is searched whole.
WHOLE = 512
# Observations whose times are looked up at once.
ROWS = 8192
# Bytes of times that a task keeps in memory.
HELD = 32 << 20


@dataclass(frozen=True)
class Box:
    """Bounds of the cells of a field."""

    low: tuple[int, int, int]
    sides: tuple[int, int, int]

    @property
    def n_cells(self) -> int:
        return self.sides[0] * self.sides[1] * self.sides[2]

    def place(self):
        i, j, k = (F.col(c) - lo for c, lo in zip(CELL, self.low))
        return ((i * self.sides[1] + j) * self.sides[2] + k).cast("int")

    def cells(self, places: np.ndarray) -> dict[str, np.ndarray]:
        ij, k = np.divmod(places, self.sides[2])
        i, j = np.divmod(ij, self.sides[1])
        return {c: (v + lo).astype(np.int32) for c, v, lo in zip(CELL, (i, j, k), self.low)}


def box_of(field: DataFrame) -> Box | None:
    """Bounds of a field's cells; None without cells."""
    ends = field.agg(*[F.min(c).alias(f"lo_{c}") for c in CELL], *[F.max(c).alias(f"hi_{c}") for c in CELL]).first()
    if ends["lo_i"] is None:
        return None
    return Box(tuple(ends[f"lo_{c}"] for c in CELL), tuple(ends[f"hi_{c}"] - ends[f"lo_{c}"] + 1 for c in CELL))


class Times:
    """Times of sites (rows) in the cells of a box: NaN where a time is missing, infinite where the site lacks the cell.

    Rows beyond `HELD` bytes go to a temporary file without a name, and are read through a map of it.
    """

    def __init__(self, n_cells: int):
        self.n_cells, self.n, self.parts, self.file = n_cells, 0, [], None
        self.known, self.stations, self.sites = np.zeros(n_cells, bool), [], []

    def _put(self, rows: np.ndarray) -> None:
        self.n += len(rows)
        if self.file is None and self.n * self.n_cells * 8 > HELD:
            self.file = tempfile.TemporaryFile()
            for part in self.parts:
                part.tofile(self.file)
            self.parts = []
        if self.file is None:
            self.parts.append(rows)
        else:
            rows.tofile(self.file)

    def add(self, sites: pa.RecordBatch) -> None:
        for a in range(0, len(sites), 1024):
            at, t, stations = (sites.column(c)[a : a + 1024] for c in ("at", "t", "stations"))
            size = at.value_lengths().to_numpy(zero_copy_only=False)
            place, value = at.flatten().to_numpy(zero_copy_only=False), t.flatten().to_numpy(zero_copy_only=False)
            rows = np.full((len(at), self.n_cells), np.inf)
            rows[np.repeat(np.arange(len(at)), size), place] = value
            self.known[place[~np.isnan(value)]] = True
            self.stations.append(stations.flatten().to_numpy(zero_copy_only=False))
            self.sites.append(np.repeat(np.arange(self.n, self.n + len(at), dtype=np.int32), stations.value_lengths().to_numpy(zero_copy_only=False)))
            self._put(rows)

    def close(self) -> Times:
        """All sites are known; the last row is that of a station without a field."""
        self._put(np.full((1, self.n_cells), np.inf))
        if self.file is None:
            self.table = np.concatenate(self.parts)
        else:
            self.file.flush()
            self.table = np.memmap(self.file, np.float64, "r", shape=(self.n, self.n_cells))
        self.parts, self.places = [], np.flatnonzero(self.known)
        self.index = pd.Index(np.concatenate(self.stations) if self.stations else np.zeros(0, np.int64))
        self.site = np.r_[np.concatenate(self.sites) if self.sites else np.zeros(0, np.int32), self.n - 1].astype(np.int32)
        self.stations = self.sites = None
        return self

    def rows_of(self, stations: np.ndarray) -> np.ndarray:
        return self.site[self.index.get_indexer(stations)]

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Times in the known cells."""
        out = self.table[rows]
        return out if len(self.places) == self.n_cells else out[:, self.places]


@dataclass(frozen=True)
class Seen:
    """All observations of the quakes at hand, also those without a time (NaN): the quake's row in the matrix of misfits, station, time."""

    quake: np.ndarray
    station: np.ndarray
    t_obs: np.ndarray
    row: np.ndarray
    table: Times

    def modelled(self, cell: np.ndarray) -> np.ndarray:
        """Time of every observation in its quake's cell (a column of the matrix); infinite where the station's field lacks the cell."""
        return self.table.table[self.row, self.table.places[cell][self.quake]]


# Quakes, cells and a matrix of misfits (NaN where a station lacks the cell's time) to output rows; with `rows`, the observations as well.
Reduce = Callable[..., pd.DataFrame]


def _worker(box: Box, reduce: Reduce, schema: pa.Schema, micros: bool, rows: bool):
    def misfits_of(times: Times, o: np.ndarray, row: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Misfits of the quakes that begin at `starts`; one quake of many observations is taken in pieces."""
        s = q = lacks = 0
        step = ROWS if len(n) == 1 else len(o)
        for a in range(0, len(o), step):
            t = times.of(row[a : a + step])
            r = o[a : a + step, None] - (np.floor(t * 1e6 + 0.5) if micros else t)
            short = ~np.isfinite(r)
            r[short] = 0.0
            if micros:
                if np.abs(r).max(initial=0) * n.max() > 2**31:
                    raise OverflowError("times too long for sums of squares in 64 bits")
                r = r.astype(np.int64)
            at = starts if len(n) > 1 else [0]
            s, q, lacks = (x + np.add.reduceat(v, at, axis=0) for x, v in ((s, r), (q, r * r), (lacks, short.astype(np.int64))))
        n = n[:, None]
        return np.where(lacks > 0, -1 if micros else np.nan, np.maximum(n * q - s * s, 0))

    def made(times: Times, quakes: np.ndarray, station: np.ndarray, o: np.ndarray, timed: np.ndarray):
        """Output of whole quakes, sorted by quake and station."""
        cells = box.cells(times.places)
        new = np.r_[True, quakes[1:] != quakes[:-1]]
        number, quakes = np.cumsum(new) - 1, quakes[new]
        two = np.bincount(number[timed], minlength=len(quakes)) > 1
        if not two.any() or not len(times.places):
            return
        kept = two[number]
        number, quakes = (np.cumsum(two) - 1)[number[kept]], quakes[two]
        station, o, timed = station[kept], o[kept], timed[kept]
        row, every = times.rows_of(station), np.r_[0, np.cumsum(np.bincount(number))]
        n = np.bincount(number[timed])
        begin, c, used = np.r_[0, np.cumsum(n)], o[timed], row[timed]
        c = np.floor(c * 1e6 + 0.5) if micros else c - np.repeat(np.add.reduceat(c, begin[:-1]) / n, n)
        many, at = np.r_[np.flatnonzero(n > ROWS), len(n)], 0
        while at < len(n):
            upto = int(min(np.searchsorted(begin[:-1], begin[at] + ROWS), many[np.searchsorted(many, at)]))
            upto = max(at + 1, upto)
            part = slice(begin[at], begin[upto])
            m = misfits_of(times, c[part], used[part], begin[at:upto] - begin[at], n[at:upto])
            if rows:
                part = slice(every[at], every[upto])
                yield reduce(quakes[at:upto], cells, m, Seen(number[part] - at, station[part], o[part], row[part], times))
            else:
                yield reduce(quakes[at:upto], cells, m)
            at = upto

    def columns(batch: pa.RecordBatch):
        e, s, o = (batch.column(c) for c in ("_e", "_st", "t_obs"))
        return tuple(x.to_numpy(zero_copy_only=False) for x in (e, s, o, o.is_valid()))

    def run(batches):
        bucket, times, held = None, None, []

        def flushed():
            if held:
                yield from made(times, *map(np.concatenate, zip(*held)))
                held.clear()

        def parts():
            """Pieces of one bucket, of sites or of observations only."""
            for batch in batches:
                kind = batch.column("_b").to_numpy() * 2 + batch.column("_seen").to_numpy(zero_copy_only=False)
                cuts = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind)]
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if z > a:
                        yield int(kind[a]) // 2, kind[a] % 2 == 1, batch.slice(a, z - a)

        def results():
            nonlocal bucket, times
            opened = False
            for b, observed, part in parts():
                if b != bucket:
                    yield from flushed()
                    bucket, times, opened = b, Times(box.n_cells), True
                if not observed:
                    times.add(part)
                    continue
                if opened:
                    times, opened = times.close(), False
                now = columns(part)
                # The last quake may go on in the next piece.
                last = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
                if last or (held and held[-1][0][-1] != now[0][0]):
                    held.append(tuple(x[:last] for x in now))
                    yield from flushed()
                held.append(tuple(x[last:] for x in now))
            yield from flushed()

        for out in results():
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return run


def sites(field: DataFrame, box: Box, station: str) -> DataFrame:
    """Stations of equal times: places in the box, times, stations."""
    entries = F.array_sort(F.collect_list(F.struct(box.place().alias("at"), F.col("t").cast("double").alias("t"))))
    packed = field.filter(F.col(station).isNotNull()).groupBy(station).agg(entries.alias("_e"))
    return packed.groupBy(F.col("_e.at").alias("at"), F.col("_e.t").alias("t")).agg(F.collect_list(station).alias("stations"))


def misfits(
    observed: DataFrame, field: DataFrame, box: Box, reduce: Reduce, schema: T.StructType | str, station: str, event: str, micros: bool = False, rows: bool = False
) -> DataFrame:
    """`reduce` of the misfits of quakes with two timed stations at least; every call sees all cells of its quakes.

    With `micros`, times are whole microseconds and misfits exact whole numbers of square microseconds, -1 where a time is missing. With `rows`,
    `reduce` gets the observations (`Seen`) as its fourth argument.
    """
    buckets = F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))
    types = dict(observed.dtypes)
    sent = sites(field, box, station).select(
        F.explode(buckets).alias("_b"), F.lit(None).cast(types[event]).alias("_e"), F.lit(None).cast(types[station]).alias("_st"),
        F.lit(None).cast("double").alias("t_obs"), F.struct("at", "t", "stations").alias("_s"),
    )
    seen = observed.filter(F.col(event).isNotNull() & (F.lit(True) if rows else F.col("t_obs").isNotNull())).select(
        F.pmod(F.xxhash64(event), F.lit(BUCKETS)).alias("_b"), F.col(event).alias("_e"), F.col(station).alias("_st"),
        F.col("t_obs").cast("double").alias("t_obs"), F.lit(None).cast(sent.schema["_s"].dataType).alias("_s"),
    )
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    dealt = seen.unionByName(sent).repartition("_b").sortWithinPartitions("_b", "_e", "_st")
    # Empty lists instead of nulls: Spark sizes an Arrow batch after every row, and runs through all nulls at the end of a list column each time.
    lists = [F.coalesce(f"_s.{f.name}", F.array().cast(f.dataType)).alias(f.name) for f in sent.schema["_s"].dataType]
    dealt = dealt.select("_b", "_e", "_st", "t_obs", F.col("_s").isNull().alias("_seen"), *lists)
    return dealt.mapInArrow(_worker(box, reduce, to_arrow_schema(schema), micros, rows), schema)


def rows_of(event: str, quakes: np.ndarray, cells: dict[str, np.ndarray], chosen: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    """One row per chosen place of the matrix."""
    e, c = np.nonzero(chosen)
    return pd.DataFrame({event: quakes[e], **{k: v[c] for k, v in cells.items()}, **{k: v[e, c] for k, v in values.items()}})


def foremost(values: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n least values per row, the first cells among equal ones; NaN is never chosen."""
    out = np.zeros(values.shape, bool)
    order = np.argsort(values, axis=1, kind="stable")[:, :n]
    np.put_along_axis(out, order, True, axis=1)
    return out & ~np.isnan(values)


def soft_weights(m: np.ndarray, temperature: float, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """exp(-(m - min)/(T * scale)) summing to 1 per row, and the cells that take part; see `location.softmin_weights`."""
    inside = ~np.isnan(m) if threshold is None else np.abs(m) <= threshold
    none = ~inside.any(axis=1, keepdims=True)
    alone = foremost(m, 1) & none
    if not m.size:
        return alone.astype(float), alone
    least = np.where(inside, m, np.inf).min(axis=1, keepdims=True)
    d = np.where(inside, m - np.where(none, 0.0, least), 0.0)
    above = np.sort(np.where(d > 0, d, np.inf), axis=1)
    n = (d > 0).sum(axis=1, keepdims=True)
    at = 0.5 * np.maximum(n - 1, 0)
    x, y = (np.where(n > 0, np.take_along_axis(above, f(at).astype(int), axis=1), 1.0) for f in (np.floor, np.ceil))
    scale = np.maximum(x + (y - x) * (at - np.floor(at)), 1e-12)
    raw = np.where(inside, np.exp(-d / (temperature * scale)), 0.0)
    return np.where(none, alone, raw / np.where(none, 1.0, raw.sum(axis=1, keepdims=True))), inside | alone


cloudpickle.register_pickle_by_value(sys.modules[__name__])
