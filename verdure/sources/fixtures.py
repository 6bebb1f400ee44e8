"""Domain tables derived from the given test tables.

The grid-month panel comes from ``lineitem``: supplier = grid cell, ship month =
date, integer sums divided once, so Spark and DuckDB produce bit-identical
doubles.  Everything downstream reads these frames, so the work grows with the
input tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(c: str):
    return F.trunc(F.col(c).cast("date"), "month")


def _signals():
    n = F.count(F.lit(1))
    return [
        (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / (F.lit(50) * n)).alias("ndvi"),
        (F.lit(20) + F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double")
         / (F.lit(350000) * n)).alias("lst"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).cast("double") * F.lit(27.5) / n).alias("rainfall"),
    ]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, date, ndvi, lst, rainfall): one row per cell-month.  Partial
    (map-side) aggregation keeps a hot supplier from landing in one task."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias("grid_id"), _month("l_shipdate").alias("date"))
              .agg(*_signals()))


#: Rows of ``lineitem`` behind one task of work that widens the panel: few enough that a task's rows stay small, and as many
#: where the table is small that tasks are worth their start.
ROWS_PER_TASK, LEAST_ROWS = 1_000_000, 25_000


def tasks_for(rows: int, cores: int) -> int:
    """Tasks for work on ``rows`` rows: bounded rows a task at any size, all cores as soon as there is work for them, and then
    whole rounds of the cores: a fit waits for its last tasks hundreds of times."""
    tasks = -(-rows // ROWS_PER_TASK)
    return -(-tasks // cores) * cores if tasks > cores else max(1, tasks, min(cores, -(-rows // LEAST_ROWS)))


def spread(p: DataFrame, sf_dir: str, keys=("grid_id",)) -> DataFrame:
    """The panel dealt out by cell for windows and features that make its narrow rows many times wider.  Left alone, the shuffle
    is merged by the bytes of the narrow rows, down to a task a core; here the rows of ``lineitem`` (from the files' footers), which
    are no fewer than the panel's, give the number of tasks.  A panel that one task holds stays as it is."""
    spark = p.sparkSession
    tasks = tasks_for(table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism)
    return p.repartition(tasks, *keys) if tasks > 1 else p


def district_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, district, date, ndvi, lst, rainfall) via the order/customer/nation chain."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, F.col("o_custkey") == F.col("c_custkey"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.groupBy(F.col("r_name").alias("state"), F.col("n_name").alias("district"),
                     _month("l_shipdate").alias("date")).agg(*_signals())


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction history (id, state, district, risk_score, created_at) from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("state"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("district"),
        F.least(F.lit(100.0), F.col("value")).alias("risk_score"),
        F.col("ts").alias("created_at"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System log: sign-ups and clicks are registrations and logins, their message holds the user's email."""
    ev = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org"))
    kind = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(kind == "signup", "user_signup").when(kind == "click", "user_login").otherwise(kind).alias("event"),
        F.when(kind == "signup", F.concat(F.lit("User registered: "), user))
         .when((kind == "click") & (F.col("event_id") % 50 == 0), F.lit("Login without a user"))
         .when(kind == "click", F.concat(F.lit("User logged in: "), user))
         .otherwise(F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" "), kind)).alias("message"),
        F.col("ts").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User directory derived from events: one row per user_id with a synthetic
    email/role and an active flag (user saw any event that is not an error)."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy("user_id")
              .agg(F.min("ts").alias("created_at"),
                   F.max(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("active"))
              .select(F.col("user_id").alias("id"),
                      F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"),
                      F.when(F.col("user_id") % 10 == 0, "admin").otherwise("analyst").alias("role"),
                      (F.col("active") == 1).alias("is_active"),
                      "created_at"))


def panel_gappy(p: DataFrame) -> DataFrame:
    """ndvi -> NULL where (grid + month) % 7 == 0; exercises fills and interpolation."""
    hole = (F.col("grid_id").cast("int") + F.month("date")) % 7 == 0
    return p.withColumn("ndvi", F.when(hole, F.lit(None).cast("double")).otherwise(F.col("ndvi")))


def raster(p: DataFrame) -> DataFrame:
    """Cells laid on a lat/lon raster: lat = id div 10, lon = id % 10."""
    gid = F.col("grid_id").cast("int")
    return p.withColumn("lat", (gid / 10).cast("int")).withColumn("lon", gid % 10)


def raw_grid(p: DataFrame) -> DataFrame:
    """Panel rendered like the raw monthly grid files: string dates ``YYYY_MM``,
    GeoJSON point, source file name; some rows lose their date string."""
    gid = F.col("grid_id").cast("int")
    lon = (F.lit(66) + gid % 5).cast("double")
    lat = (F.lit(24) + gid % 4).cast("double")
    ym = F.date_format("date", "yyyy_MM")
    return p.select(
        F.col("grid_id").alias("system:index"),
        F.col("lst").alias("LST"), F.col("ndvi").alias("NDVI"), F.col("rainfall").alias("Precipitation"),
        F.when((gid + F.month("date")) % 11 == 0, F.lit(None).cast("string")).otherwise(ym).alias("date"),
        F.month("date").alias("month"), F.year("date").alias("year"),
        F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","),
                 lat.cast("string"), F.lit("]}")).alias(".geo"),
        F.concat(F.lit("Grid_"), ym, F.lit(".csv")).alias("source_file"),
    )


def climate_json(p: DataFrame) -> DataFrame:
    """One JSON document per grid: {"T2M": {"YYYYMM": v, ..., "YYYY13": annual}, "RH2M": {...}}."""
    ym = F.date_format("date", "yyyyMM")
    per_month = p.select("grid_id", F.year("date").alias("y"), ym.alias("k"),
                         F.col("lst").alias("t2m"), F.col("rainfall").alias("rh2m"))
    annual = (per_month.groupBy("grid_id", "y")
              .agg(F.avg("t2m").alias("t2m"), F.avg("rh2m").alias("rh2m"))
              .select("grid_id", "y", F.concat(F.col("y").cast("string"), F.lit("13")).alias("k"), "t2m", "rh2m"))
    both = per_month.unionByName(annual)
    doc = both.groupBy("grid_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "t2m"))).alias("T2M"),
        F.map_from_entries(F.collect_list(F.struct("k", "rh2m"))).alias("RH2M"))
    return doc.select("grid_id", F.to_json(F.struct("T2M", "RH2M")).alias("body"))


EXPORT_PREFIX = "gee_export_"
MISSING_MONTH = "1996-02-01"
DUPLICATE_MONTH = "1997-03-01"
TOO_NULL_MONTH = "1998-06-01"


def export_files(p: DataFrame) -> DataFrame:
    """Rows of monthly feature-export files (file, grid_id, date, modis_ndvi, modis_lst,
    chirps_rainfall): one file per month, -9999 fills where id % 10 == 3, one month
    missing, one month exported twice (second copy ``(1)``, even cells only), one
    month fully masked."""
    gid = F.col("grid_id").cast("int")
    ym = F.date_format("date", "yyyy_MM")
    masked = (gid % 10 == 3) | (F.col("date") == F.lit(TOO_NULL_MONTH).cast("date"))

    def v(c):
        return F.when(masked, F.lit(-9999.0)).otherwise(F.col(c))
    base = p.where(F.col("date") != F.lit(MISSING_MONTH).cast("date")).select(
        F.concat(F.lit(EXPORT_PREFIX), ym, F.lit(".csv")).alias("file"), "grid_id", "date",
        v("ndvi").alias("modis_ndvi"), v("lst").alias("modis_lst"), v("rainfall").alias("chirps_rainfall"))
    dup = (base.where((F.col("date") == F.lit(DUPLICATE_MONTH).cast("date")) & (gid % 2 == 0))
               .withColumn("file", F.concat(F.lit(EXPORT_PREFIX), ym, F.lit("(1).csv"))))
    return base.unionByName(dup)


INVALID_MONTH = "1995-05-01"
EMPTY_MONTH = "1995-08-01"
EXPORT_HEADER = ("grid_id", "date", "modis_ndvi", "modis_lst", "chirps_rainfall")


def export_lines(p: DataFrame) -> DataFrame:
    """``export_files`` as text lines (file, ord, value), header first.  One file swaps two columns, one misnames a
    column, one holds its header only."""
    rows = export_files(p)
    month = F.col("date")
    empty, invalid = (month == F.lit(m).cast("date") for m in (EMPTY_MONTH, INVALID_MONTH))
    swapped = F.month(month) == 7
    day = F.date_format("date", "yyyy-MM-dd")
    value = F.concat_ws(",", F.col("grid_id"), day, F.when(swapped, F.col("modis_lst")).otherwise(F.col("modis_ndvi")).cast("string"),
                        F.when(swapped, F.col("modis_ndvi")).otherwise(F.col("modis_lst")).cast("string"),
                        F.col("chirps_rainfall").cast("string"))
    head = (F.when(invalid, F.lit("grid_id,date,modis_ndvi,LST,chirps_rainfall"))
            .when(swapped, F.lit("grid_id,date,modis_lst,modis_ndvi,chirps_rainfall")).otherwise(F.lit(",".join(EXPORT_HEADER))))
    first = rows.select("file", F.lit(0).alias("ord"), head.alias("value")).distinct()
    return first.unionByName(rows.where(~empty).select("file", F.lit(1).alias("ord"), value.alias("value")))


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring payloads: one per district-month.  ``state`` cycles through the
    states that have crop lists plus one without (by nation key)."""
    from ..functions import constants as K
    dp = district_panel(spark, sf_dir)
    nat = table(spark, sf_dir, "nation").select(F.col("n_name").alias("district"), "n_nationkey")
    states = list(K.STATE_CROPS) + ["Sindh"]
    st = F.element_at(F.array(*[F.lit(s) for s in states]), (F.col("n_nationkey") % len(states) + 1).cast("int"))
    lst, rain, ndvi = F.col("lst"), F.col("rainfall"), F.col("ndvi")
    return dp.join(nat, "district").select(
        F.concat(F.col("district"), F.lit("-"), F.date_format("date", "yyyyMM")).alias("id"),
        st.alias("state"), "district", "date",
        (F.lit(6.0) + F.col("n_nationkey")).alias("latitude"), (F.lit(68.0) + F.col("n_nationkey")).alias("longitude"),
        "ndvi", "lst", "rainfall", (lst - 2.0).alias("temperature"),
        clip(65 - lst + rain / 8, 15.0, 95.0).alias("humidity"),
        clip(2.5 + lst / 30, 0.2, 8.0).alias("wind_speed"),
        clip(0.12 + rain / 300 + ndvi / 3, 0.02, 0.95).alias("soil_moisture_proxy"))
