"""Look-ups in stored travel-time fields (field, cell, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .cells import CELL


def shuffled(field: DataFrame) -> DataFrame:
    """A field as the side of a join that is never broadcast.

    A field has a row per station and cell. Where it is made by an explode the planner counts it as its stations alone, takes it for a
    small table and would collect all of it in the driver.
    """
    return field.hint("merge")


def source_cell(field: DataFrame, key: str, t: str = "t") -> DataFrame:
    """The cell a field starts from: smallest time, smallest cell on a tie."""
    return field.groupBy(key).agg(F.min_by(F.struct(*CELL), F.struct(t, *CELL)).alias("_c")).select(key, "_c.*")


def field_value(rows: DataFrame, field: DataFrame, key: str, cell: list[str], out: str) -> DataFrame:
    """Add the field's value at the cell named by three columns."""
    named = field.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in CELL], F.col("t").alias(out)
    )
    on = (F.col(key) == F.col("_key")) & (F.col(cell[0]) == F.col("_i")) & (F.col(cell[1]) == F.col("_j")) & (
        F.col(cell[2]) == F.col("_k")
    )
    return rows.join(shuffled(named), on).drop("_key", "_i", "_j", "_k")


def field_difference(rows: DataFrame, field: DataFrame, key: str, start: list[str], finish: list[str], out: str) -> DataFrame:
    """Field at `finish` minus field at `start`, to 2 decimals (half-even)."""
    both = field_value(field_value(rows, field, key, start, "_t0"), field, key, finish, "_t1")
    return both.withColumn(out, F.bround(F.col("_t1") - F.col("_t0"), 2)).drop("_t0", "_t1")


def missing_fields(required: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Field keys that have to be computed."""
    return required.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")


def fat_rays(pairs: DataFrame, field: DataFrame, key: str, limit: float | Column) -> DataFrame:
    """Cells whose detour over a source-receiver pair stays within `limit` seconds.

    `pairs` holds pair_id, source and receiver (field keys).
    """
    at = source_cell(field, key)
    cell_of = lambda end: at.select(F.col(key).alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in CELL])
    ends = pairs.join(cell_of("source"), "source").join(cell_of("receiver"), "receiver")

    def at_cell(df, field_end, cell_end, out):
        f = field.select(
            F.col(key).alias(field_end), *[F.col(c).alias(f"_{cell_end}_{c}") for c in CELL], F.col("t").alias(out)
        )
        return df.join(shuffled(f), [field_end, *[f"_{cell_end}_{c}" for c in CELL]])

    direct = at_cell(at_cell(ends, "source", "receiver", "_sr"), "receiver", "source", "_rs").select(
        "pair_id", "source", "receiver", ((F.col("_sr") + F.col("_rs")) / 2).alias("t_travel")
    )
    side = lambda end, out: field.select(F.col(key).alias(end), *CELL, F.col("t").alias(out))
    both = direct.join(shuffled(side("source", "t_sx")), "source").join(shuffled(side("receiver", "t_rx")), ["receiver", *CELL])
    return both.filter(F.col("t_sx") + F.col("t_rx") - F.col("t_travel") <= limit)
