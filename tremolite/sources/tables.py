"""Reading and appending catalogue tables, event tables and models."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.cells import CELL


def run_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Run a query text over named DataFrames; values are bound as parameters (:name), never pasted into the text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)


def read_database(
    spark: SparkSession, url: str, query: str, options: dict[str, str], column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 32,
) -> DataFrame:
    """A database query as a DataFrame, read in parallel ranges of `column` where given. Credentials come in `options`."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column and bounds:
        return (
            reader.option("dbtable", f"({query}) q").option("partitionColumn", column)
            .option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()
        )
    return reader.option("query", query).load()


def append_database(df: DataFrame, url: str, table: str, options: dict[str, str]) -> None:
    """Append rows to a database table; failures raise."""
    df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).options(**options).save()


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a stored table; failures raise."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def with_points(df: DataFrame, lon: str = "lon", lat: str = "lat", srid: int = 4326) -> DataFrame:
    """Replace lon/lat by an EWKT point column."""
    point = F.concat(F.lit(f"SRID={srid};POINT ("), F.col(lon).cast("string"), F.lit(" "), F.col(lat).cast("string"), F.lit(")"))
    return df.withColumn("geometry", point).drop(lon, lat)


def append_points(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    append_table(with_points(df, lon, lat), path)


# --- event tables ------------------------------------------------------------------------------------------------


def write_event_tables(df: DataFrame, path: str, order: list[str], event: str = "event_id", one_folder_each: bool = False) -> None:
    """All quakes' tables as CSV in one job, each quake's rows in order.

    Rows are range-partitioned by quake and time, so one quake may span files and no task gets more than its share.
    `one_folder_each` makes a folder per quake, for exports of moderate numbers of quakes.
    """
    ordered = df.repartitionByRange(F.col(event), *order).sortWithinPartitions(event, *order)
    writer = ordered.write.mode("append").option("header", True)
    (writer.partitionBy(event) if one_folder_each else writer).csv(path)


def scan_event_tables(
    spark: SparkSession, path: str, columns: dict[str, str], required: list[str], pattern: str = "*.csv"
) -> tuple[DataFrame, DataFrame]:
    """Rows of all CSV files whose header has the required columns, and the list of skipped files.

    Files are grouped by their first line and each group is read by Spark's own CSV reader, so files may differ in column order
    and quoting. Only first lines and file names reach the driver, as for any listing of files.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )
    # The block that begins a file is read in order by one task.
    heads = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("head"))
    groups: dict[str, list[str]] = {}
    for r in heads.collect():
        groups.setdefault(r["head"], []).append(r["file"])
    names = {head: next(csv.reader([head])) for head in groups}
    known = [head for head in groups if set(required) <= set(names[head])]
    skipped = [(file,) for head in groups if head not in known for file in groups[head]]
    out = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()) + ", file string")
    for head in sorted(known):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names[head]])
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(groups[head])
        pick = [(F.col(f"`{c}`") if c in names[head] else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        out = out.unionByName(rows.select(*pick, F.col("_metadata.file_path").alias("file")))
    return out, spark.createDataFrame(skipped, "file string")


# --- models ------------------------------------------------------------------------------------------------------

GRID = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
MODEL = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("lon", "lat", "height", "azimuth", "side_size")]
    + [T.StructField(n, T.IntegerType()) for n in ("n_x", "n_y", "n_z")]
    + [T.StructField("data", T.StructType([T.StructField("vp", GRID), T.StructField("vs", GRID)]))]
)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Model documents, one JSON file or line each."""
    return spark.read.schema(MODEL).option("multiLine", True).json(path)


def parse_models(docs: DataFrame, text: str) -> DataFrame:
    """Model documents held as JSON text in a column."""
    others = [c for c in docs.columns if c != text]
    return docs.withColumn("_m", F.from_json(text, MODEL)).select(*others, "_m.*")


def models_to_cells(models: DataFrame, keys: list[str]) -> DataFrame:
    """Nested vp/vs grids to cell rows."""
    layer = models.select(*keys, F.posexplode(F.arrays_zip("data.vp", "data.vs")).alias("i", "_x"))
    line = layer.select(*keys, "i", F.posexplode(F.arrays_zip("_x.vp", "_x.vs")).alias("j", "_y"))
    cell = line.select(*keys, "i", "j", F.posexplode(F.arrays_zip("_y.vp", "_y.vs")).alias("k", "_z"))
    return cell.select(*keys, *CELL, F.col("_z.vp").alias("vp"), F.col("_z.vs").alias("vs"))


def cells_to_models(cells: DataFrame, keys: list[str], geometry: dict[str, float], include_data: bool = True) -> DataFrame:
    """One JSON document per model: geometry and, if wanted, the nested vp/vs grids.

    A document holds a whole model by its format; lines and layers are nested step by step, so each aggregate only
    collects one axis. Larger models belong in the cell table.
    """
    shape = cells.groupBy(*keys).agg(*[(F.max(c) + 1).alias(n) for c, n in zip(CELL, ("n_x", "n_y", "n_z"))])
    fixed = [F.lit(float(v)).alias(n) for n, v in geometry.items()]
    parts = [*fixed, "n_x", "n_y", "n_z"]
    if not include_data:
        return shape.select(*keys, F.to_json(F.struct(*parts)).alias("doc"))
    nested = cells.select(*keys, *CELL, F.struct("vp", "vs").alias("_v"))
    for axis in range(2, -1, -1):
        c = CELL[axis]
        nested = nested.groupBy(*keys, *CELL[:axis]).agg(
            F.array_sort(F.collect_list(F.struct(c, "_v"))).alias("_l")
        )
        pick = lambda v: F.transform("_l", lambda e: e["_v"][v])
        nested = nested.select(*keys, *CELL[:axis], F.struct(pick("vp").alias("vp"), pick("vs").alias("vs")).alias("_v"))
    whole = nested.withColumnRenamed("_v", "data").join(shape, keys)
    return whole.select(*keys, F.to_json(F.struct(*parts, "data")).alias("doc"))


def save_model_version(cells: DataFrame, path: str, model: str) -> None:
    """Store cells as the next version (one more than the latest) of each model."""
    spark = cells.sparkSession
    latest = latest_versions(spark, path, model)
    nxt = F.coalesce(F.col("_latest"), F.lit(0)) + 1
    stamped = cells.join(latest, model, "left") if latest is not None else cells.withColumn("_latest", F.lit(0))
    append_table(stamped.withColumn("version", nxt).drop("_latest"), path, [model, "version"])


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def latest_versions(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """The highest version of each model. Both are partition columns, so no data file is opened."""
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).select(model, "version").distinct().groupBy(model).agg(F.max("version").alias("_latest"))


def load_model(spark: SparkSession, path: str, model: str, version: int | str = "latest") -> DataFrame:
    """Cells of one version, or of each model's latest; other versions are pruned."""
    stored = spark.read.parquet(path)
    if version != "latest":
        return stored.filter(F.col("version") == version)
    newest = latest_versions(spark, path, model)
    # A join on both partition columns lets Spark prune the partitions of older versions at run time.
    return stored.join(newest.withColumnRenamed("_latest", "version"), [model, "version"])


def latest_file(files: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """Per key the file with the highest number after `_v` (numeric order); files without a number do not count."""
    v = F.regexp_extract(file, r"_v(\d+)\.[a-z]+$", 1).try_cast("int")
    numbered = files.withColumn("_v", v).filter(F.col("_v").isNotNull())
    return numbered.groupBy(*keys).agg(F.max_by(F.col(file), F.struct("_v", file)).alias(file))
