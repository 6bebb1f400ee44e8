"""Readers and sinks for the raw file shapes: monthly grid CSVs, feature exports,
point-climate JSON, soil JSON, sub-monthly scene samples; panel / history sinks."""
from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.scalar import clip
from ..session import ensure_checkpoint_dir

RAW_GRID_SCHEMA = T.StructType([
    T.StructField("system:index", T.StringType()),
    T.StructField("LST", T.DoubleType()),
    T.StructField("NDVI", T.DoubleType()),
    T.StructField("Precipitation", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField(".geo", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/verdure-{name}-{uuid.uuid4().hex}"


def write_grid_csvs(df: DataFrame, path: str) -> str:
    """One folder per source file (``source_file=<name>``), CSV with header; a file's rows go to one task, so a month
    is not scattered over a file per task."""
    df.repartition("source_file").write.mode("overwrite").option("header", True).partitionBy("source_file").csv(path)
    return path


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """Paths of the files under ``path``, from the listing alone: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    return sorted(r["path"] for r in files.collect())


#: Headers that are read at the same time.
HEADER_JOBS = 16


def header_index(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names -> files that begin with them.  Spark's CSV reader opens each file in a task that takes its first line
    and stops, so the bytes read do not grow with the files, and quoted names are parsed as such."""
    def names(file: str) -> tuple[str, ...]:
        return tuple(c.strip() for c in spark.read.option("header", True).csv(file).columns)

    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        found = list(pool.map(names, files))
    out: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(found, files):
        out.setdefault(header, []).append(file)
    return out


def read_csvs_by_name(spark: SparkSession, path: str, schema: T.StructType, partitions: list[T.StructField] = (),
                      index: dict[tuple[str, ...], list[str]] | None = None) -> DataFrame:
    """The CSVs under ``path`` (those of ``index``, or all), columns bound by their names in each file's own header; missing ones
    are NULL, columns beyond the schema are dropped.  Raises when there is no file, or one shares no column with the
    schema."""
    index = header_index(spark, list_files(spark, path)) if index is None else index
    if not index:
        raise FileNotFoundError(f"no CSV file under {path}")
    types = {f.name: f.dataType for f in schema.fields}
    out = None
    for names, files in index.items():
        if not set(names) & set(types):
            raise ValueError(f"{files[0]} has none of the columns {sorted(types)}")
        own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names] + list(partitions))
        df = (spark.read.schema(own).option("header", True).option("mode", "PERMISSIVE").option("basePath", path).csv(files)
              .withColumn("__file", F.col("_metadata.file_name")))
        have = [F.col(f"`{c}`") if c in names else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        df = df.select(*have, *[p.name for p in partitions], "__file")
        out = df if out is None else out.unionByName(df)
    return out


def read_grid_csvs(spark: SparkSession, path: str, schema: T.StructType = RAW_GRID_SCHEMA, files: list[str] | None = None) -> DataFrame:
    """Monthly grid CSVs under ``path`` (``files`` of them, or all), by column name; ``source_file`` comes back from the
    folder names by partition discovery.  Raises when no file is found."""
    index = None if files is None else header_index(spark, files)
    return read_csvs_by_name(spark, path, schema, [T.StructField("source_file", T.StringType())], index).drop("__file")


def first_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """Paths of the files whose ``source_file`` is among its first ``n`` values under ``path``, from the listing alone; raises when there
    are fewer."""
    by_name: dict[str, list[str]] = {}
    for file in list_files(spark, path):
        m = re.search(r"source_file=([^/]+)", file)
        if m:
            by_name.setdefault(m[1], []).append(file)
    if len(by_name) < n:
        raise ValueError(f"{len(by_name)} files under {path}; {n} are needed")
    return [f for name in sorted(by_name)[:n] for f in by_name[name]]


def export_schema() -> T.StructType:
    fields = []
    for c in K.EXPORT_COLUMNS:
        if c in ("grid_id", "date"):
            fields.append(T.StructField(c, T.StringType()))
        elif c.startswith("has_") or c in ("year", "month"):
            fields.append(T.StructField(c, T.IntegerType()))
        else:
            fields.append(T.StructField(c, T.DoubleType()))
    return T.StructType(fields)


def write_export_files(lines: DataFrame, path: str) -> str:
    """Export files as they come: ``lines`` (file, ord, value), the header at the smallest ``ord``; a folder per file."""
    lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    return path


def read_export_csvs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers: file, header; rows of the feature exports by column name, with their file)."""
    index = header_index(spark, list_files(spark, path, "*"))
    # a row per file, from the index
    headers = spark.createDataFrame([(re.search(r"file=([^/]+)", unquote(f))[1], ",".join(names)) for names, files in index.items() for f in files],
                                    "file STRING, header STRING")
    rows = read_csvs_by_name(spark, path, export_schema(), [T.StructField("file", T.StringType())], index).drop("__file")
    return headers, rows


CLIMATE_SCHEMA = "MAP<STRING, MAP<STRING, DOUBLE>>"


def parse_climate_json(docs: DataFrame, body="body", keys=("grid_id",)) -> DataFrame:
    """{param: {YYYYMM: value}} -> one row per (key, month) with canonical columns;
    pseudo-month 13 (annual) dropped."""
    m = F.from_json(F.col(body), CLIMATE_SCHEMA)
    x = docs.select(*keys, F.explode(m).alias("param", "series"))
    x = x.select(*keys, "param", F.explode("series").alias("ym", "value"))
    x = x.where(~F.col("ym").endswith("13"))
    params = {k: v for k, v in K.CLIMATE_PARAMS.items()}
    aggs = [F.max(F.when(F.col("param") == p, F.col("value"))).alias(c) for p, c in params.items()]
    out = x.groupBy(*keys, "ym").agg(*aggs)
    return out.withColumn("date", F.to_date("ym", "yyyyMM")).drop("ym")


SOIL_SCHEMA = "properties STRUCT<layers: ARRAY<STRUCT<name: STRING, depths: ARRAY<STRUCT<values: STRUCT<mean: DOUBLE>>>>>>"


def parse_soil_json(docs: DataFrame, body="body", keys=("grid_id",)) -> DataFrame:
    """Soil layers -> sand, clay, soc (first depth mean; defaults 350/220/80) and
    soil_moisture = clip(clay / (sand + clay + 1) * 0.8, .05, .9)."""
    j = F.from_json(F.col(body), SOIL_SCHEMA)
    layers = docs.select(*keys, F.explode_outer(j["properties"]["layers"]).alias("l"))
    v = F.col("l.depths")[0]["values"]["mean"]
    wide = layers.groupBy(*keys).agg(*[F.max(F.when(F.col("l.name") == n, v)).alias(n) for n in K.SOIL_DEFAULTS])
    wide = wide.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in K.SOIL_DEFAULTS.items()})
    return wide.withColumn("soil_moisture",
                           clip(F.col("clay") / (F.col("sand") + F.col("clay") + 1) * 0.8, 0.05, 0.9))


def scene_filter(samples: DataFrame, start: str, end: str, cloud_max: float = 45.0,
                 ts="ts", cloud="cloud_pct") -> DataFrame:
    """Scenes with cloud % below the limit and start <= ts < end."""
    return samples.where((F.col(cloud) < cloud_max) & (F.col(ts) >= F.lit(start).cast("timestamp"))
                         & (F.col(ts) < F.lit(end).cast("timestamp")))


#: Reducers by name.  ``median`` is exact (its partial aggregates keep value counts); ``median_sketch`` is bounded in
#: memory with a relative rank error of 1e-5, for callers who choose it.
COMPOSITE_RULES = {"mean": F.avg, "sum": F.sum, "median": F.median,
                   "median_sketch": lambda c: F.percentile_approx(c, 0.5, 100000).cast("double")}


def composite_month(samples: DataFrame, rules: dict[str, str], keys=("grid_id",), ts="ts") -> DataFrame:
    """Monthly composite of long (key, ts, band, value) samples; per-band reducer by name.  One scan, one grouped
    aggregate for all bands, whatever the size of a group."""
    s = samples.withColumn("date", F.trunc(F.col(ts).cast("date"), "month"))
    return s.groupBy(*keys, "date").agg(*[COMPOSITE_RULES[how](F.when(F.col("band") == b, F.col("value"))).alias(b)
                                          for b, how in rules.items()])


def region_reduce(df: DataFrame, bands: list[str], lon=(67.0, 69.0), lat=(24.0, 26.0), date_col="date") -> DataFrame:
    """Mean of bands over a bounding box per month."""
    box = F.col("longitude").between(*lon) & F.col("latitude").between(*lat)
    return df.where(box).groupBy(date_col).agg(*[F.avg(b).alias(b) for b in bands])


def sink_panel(df: DataFrame, path: str, partition_col: str = "year") -> str:
    """Panel to Parquet partitioned by year (partition pruning on reads), cells clustered: range partitions by
    (year, cell) give each task a stretch of cells of a year, however large one year is."""
    if partition_col not in df.columns:
        df = df.withColumn(partition_col, F.year("date"))
    df.repartitionByRange(partition_col, "grid_id").sortWithinPartitions(partition_col, "grid_id", "date").write.mode(
        "overwrite").partitionBy(partition_col).parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A (small) report table as one JSON document per row."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_reports(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Union of JSON reports with their name in ``report``; an absent one adds no rows."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], schema).selectExpr("CAST(NULL AS STRING) AS report", "*")
    for name, path in paths.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            out = out.unionByName(spark.read.schema(schema).json(path).select(F.lit(name).alias("report"), "*"))
    return out


def append_history(df: DataFrame, path: str, batch_id: str) -> str:
    """Append one batch to a history table.  Its rows go to a folder of their own; then a commit row, which a repeated batch
    overwrites, names that folder.  So the same batch twice leaves its rows once, and readers see whole batches only.
    Rows of attempts that were never committed, or are so no longer, stay on disk unread."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/batch=b-{batch_id}/attempt=a-{attempt}")
    commit = df.sparkSession.range(1).select(F.lit(f"a-{attempt}").alias("attempt"))
    commit.write.mode("overwrite").parquet(f"{path}/commits/batch=b-{batch_id}")
    return path


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches.  The commits (a row per batch) select folders, before their files are opened."""
    commits = spark.read.parquet(f"{path}/commits")
    return spark.read.parquet(f"{path}/data").join(commits, ["batch", "attempt"], "left_semi").drop("batch", "attempt")
