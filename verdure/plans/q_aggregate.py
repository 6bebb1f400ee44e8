"""Registered queries: aggregations, reshapes, joins and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import md5_bucket
from ..operators import aggregate as A
from ..operators import conform as C
from ..operators import joins as J
from ..operators.datasets import TWO32
from ..operators.temporal import order_window
from ..sources import fixtures as FX
from . import sqlfrag as S
from .q_indices import vhi_panel
from .q_quality import EXPORT_COLS, EXPORT_CTES, _isnull
from .q_temporal import GAPPY
from .registry import register, rounded

D = "CAST(date AS VARCHAR) AS date"
SIG = ["ndvi", "lst", "rainfall"]


def _mixed_input(p):
    a = p.withColumns({"source_file": F.lit("a.csv"), "flag": F.concat(F.lit("a-"), F.col("grid_id"))})
    b = (p.where(F.col("grid_id").cast("int") % 2 == 0)
          .withColumns({"ndvi": F.col("ndvi") * 2, "source_file": F.lit("b.csv"),
                        "flag": F.concat(F.lit("b-"), F.col("grid_id"))}))
    return a.unionByName(b)


@register("agg_collapse_mixed", S.with_(panel=S.PANEL) + f""", m AS (
  SELECT grid_id, date, ndvi, lst, rainfall, 'a.csv' AS source_file, 'a-' || grid_id AS flag FROM panel UNION ALL
  SELECT grid_id, date, ndvi * 2, lst, rainfall, 'b.csv', 'b-' || grid_id FROM panel WHERE CAST(grid_id AS INTEGER) % 2 = 0)
SELECT grid_id, {D}, {', '.join(f"{S.r6(f'avg({c})')} AS {c}" for c in SIG)}, min(source_file) AS source_file,
  arg_min(flag, source_file) AS flag FROM m GROUP BY grid_id, date""")
def agg_collapse_mixed(spark, d):
    return rounded(A.collapse_mixed(_mixed_input(FX.panel(spark, d))))


@register("agg_district_month", S.with_(district=S.DISTRICT) + f"""
SELECT state, district, {D}, {', '.join(f"{S.r6(c)} AS {c}" for c in SIG)} FROM district""")
def agg_district_month(spark, d):
    return rounded(FX.district_panel(spark, d))


@register("agg_region_month", S.with_(panel=S.PANEL) + f"""
SELECT {D}, {', '.join(f"{S.r6(f'avg({c})')} AS {c}" for c in SIG)} FROM panel GROUP BY date""")
def agg_region_month(spark, d):
    return rounded(A.region_month(FX.panel(spark, d), SIG))


RASTER = "SELECT *, CAST(CAST(grid_id AS INTEGER) // 10 AS INTEGER) AS lat, CAST(grid_id AS INTEGER) % 10 AS lon FROM panel"


@register("agg_raster_summary", S.with_(panel=S.PANEL, raster=RASTER) + f"""
SELECT {D}, count(DISTINCT lat) AS n_lat, {', '.join(f"{S.r6(f'avg({c})')} AS {c}_mean" for c in SIG)} FROM raster GROUP BY date""")
def agg_raster_summary(spark, d):
    r = FX.raster(FX.panel(spark, d))
    return rounded(r.groupBy("date").agg(F.countDistinct("lat").alias("n_lat"),
                                         *[F.avg(c).alias(f"{c}_mean") for c in SIG]))


LONS = list(range(10))


@register("agg_raster_pivot", S.with_(panel=S.PANEL, raster=RASTER) + f"""
SELECT {D}, lat, {', '.join(f"{S.r6(f'avg(CASE WHEN lon = {v} THEN ndvi END)')} AS lon_{v}" for v in LONS)}
FROM raster GROUP BY date, lat""")
def agg_raster_pivot(spark, d):
    r = FX.raster(FX.panel(spark, d))
    return rounded(A.raster_pivot(r, "ndvi", LONS))


def _stretch_sql():
    long = " UNION ALL ".join(f"SELECT date, lat, lon, '{c}' AS channel, {c} AS value FROM raster" for c in SIG)
    part = "PARTITION BY date, channel"
    filled = f"SELECT date, lat, lon, channel, coalesce(value, quantile_cont(value, 0.5) OVER ({part})) AS value FROM long"
    lo, hi = (f"quantile_cont(value, {q}) OVER ({part})" for q in (0.02, 0.98))
    val = S.clip(f"(value - {lo}) / greatest({hi} - {lo}, 1e-6)", 0.0, 1.0)
    return S.with_(panel=S.PANEL, gappy=GAPPY, raster=RASTER.replace("FROM panel", "FROM gappy"), long=long, filled=filled) + (
        f"SELECT {D}, lat, lon, channel, {S.r6(val)} AS value FROM filled")


@register("agg_raster_stretch", _stretch_sql())
def agg_raster_stretch(spark, d):
    r = FX.raster(FX.panel_gappy(FX.panel(spark, d)))
    return rounded(A.raster_stretch(A.raster_long(r, SIG)))


@register("agg_distinct_counts", S.with_(panel=S.PANEL) + """
SELECT count(DISTINCT grid_id) AS n_cells, count(DISTINCT date) AS n_dates,
  (SELECT quantile_cont(n, 0.5) FROM (SELECT count(DISTINCT date) AS n FROM panel GROUP BY grid_id)) AS median_dates_per_cell FROM panel""")
def agg_distinct_counts(spark, d):
    return rounded(A.distinct_counts(FX.panel(spark, d)))


# ---- joins -----------------------------------------------------------------------------------
def _exports_collapsed(spark, d):
    rows = FX.export_files(FX.panel(spark, d))
    clean = C.sentinel_null(rows, EXPORT_COLS).withColumnRenamed("modis_ndvi", "ndvi")
    return A.collapse_mean(clean.drop("file"))


@register("join_left_exports", S.with_(**EXPORT_CTES) + f""", ex AS (
  SELECT grid_id, date, {', '.join(f"avg(CASE WHEN {_isnull(c)} = 1 THEN NULL ELSE {c} END) AS {c}" for c in EXPORT_COLS)}
  FROM exp GROUP BY grid_id, date)
SELECT p.grid_id, CAST(p.date AS VARCHAR) AS date, {', '.join(f"{S.r6('p.' + c)} AS {c}" for c in SIG)},
  {S.r6('ex.modis_ndvi')} AS ndvi_gee, {S.r6('ex.modis_lst')} AS modis_lst, {S.r6('ex.chirps_rainfall')} AS chirps_rainfall
FROM panel p LEFT JOIN ex ON p.grid_id = ex.grid_id AND p.date = ex.date""")
def join_left_exports(spark, d):
    return rounded(J.left_join_suffixed(FX.panel(spark, d), _exports_collapsed(spark, d)))


@register("join_image_target", S.with_(panel=S.PANEL) + f""", img AS (
  SELECT date, {', '.join(f"avg({c}) AS {c}_mean" for c in SIG)} FROM panel GROUP BY date),
tgt AS (SELECT date, lead(m, 1) OVER (ORDER BY date) AS target_next FROM
  (SELECT date, avg(v) AS m FROM (SELECT date, {S.clip(f"0.5 * {S.scaled('ndvi', 'grid_id')} + 0.5 * {S.scaled('lst', 'grid_id', invert=True)}", 0.0, 1.0)} AS v FROM panel) GROUP BY date))
SELECT {D}, {', '.join(f"{S.r6(f'{c}_mean')} AS {c}_mean" for c in SIG)}, {S.r6('target_next')} AS target_next
FROM img JOIN tgt USING (date) WHERE target_next IS NOT NULL""")
def join_image_target(spark, d):
    from pyspark.sql import Window
    p = FX.panel(spark, d)
    img = p.groupBy("date").agg(*[F.avg(c).alias(f"{c}_mean") for c in SIG])
    monthly = vhi_panel(spark, d).groupBy("date").agg(F.avg("vhi").alias("m"))
    # the monthly series has one row per month: a global window over it is tiny
    tgt = monthly.select("date", F.lead("m", 1).over(Window.orderBy("date")).alias("target_next"))
    return rounded(img.join(tgt, "date").where(F.col("target_next").isNotNull()))


@register("join_semi_sample", S.with_(panel=S.PANEL) + f"""
SELECT grid_id, {D}, {S.r6('ndvi')} AS ndvi FROM panel
WHERE grid_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)""")
def join_semi_sample(spark, d):
    sup = FX.table(spark, d, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").cast("string").alias("grid_id"))
    return rounded(J.semi(FX.panel(spark, d).select("grid_id", "date", "ndvi"), sup))


@register("join_anti_holdout", S.with_(panel=S.PANEL) + f"""
SELECT grid_id, {D}, {S.r6('ndvi')} AS ndvi FROM panel
WHERE grid_id NOT IN (SELECT DISTINCT grid_id FROM panel WHERE {S.md5_bucket('grid_id', '41')} < {0.2 * TWO32!r})""")
def join_anti_holdout(spark, d):
    p = FX.panel(spark, d).select("grid_id", "date", "ndvi")
    hold = p.select("grid_id").distinct().where(md5_bucket("grid_id", seed="41") < F.lit(0.2 * TWO32))
    return rounded(J.anti(p, hold))


@register("join_group_stat", S.with_(panel=S.PANEL) + f"""
SELECT grid_id, {D}, {S.r6('avg(ndvi) OVER (PARTITION BY grid_id)')} AS ndvi_avg,
  {S.r6('ndvi - avg(ndvi) OVER (PARTITION BY grid_id)')} AS ndvi_dev FROM panel""")
def join_group_stat(spark, d):
    p = J.group_stat(FX.panel(spark, d), "ndvi")
    return rounded(p.select("grid_id", "date", "ndvi_avg", (F.col("ndvi") - F.col("ndvi_avg")).alias("ndvi_dev")))


@register("set_union_by_name", S.with_(panel=S.PANEL, district=S.DISTRICT) + f"""
SELECT grid_id, NULL::VARCHAR AS state, {D}, {S.r6('ndvi')} AS ndvi FROM panel UNION ALL
SELECT district AS grid_id, state, {D}, {S.r6('ndvi')} AS ndvi FROM district""")
def set_union_by_name(spark, d):
    a = FX.panel(spark, d).select("grid_id", "date", "ndvi")
    b = FX.district_panel(spark, d).select(F.col("district").alias("grid_id"), "state", "date", "ndvi")
    return rounded(a.unionByName(b, allowMissingColumns=True))


@register("set_common_index", S.with_(panel=S.PANEL) + """, r AS (
  SELECT grid_id, date, row_number() OVER (PARTITION BY grid_id ORDER BY date) AS rn FROM panel)
SELECT grid_id, CAST(date AS VARCHAR) AS date FROM (
  SELECT grid_id, date FROM r WHERE rn >= 3 INTERSECT SELECT grid_id, date FROM r WHERE rn >= 6
  INTERSECT SELECT grid_id, date FROM r WHERE rn >= 12)""")
def set_common_index(spark, d):
    p = FX.panel(spark, d).withColumn("rn", F.row_number().over(order_window(["grid_id"])))
    frames = [p.where(F.col("rn") >= n) for n in (3, 6, 12)]
    return rounded(J.common_keys(frames))


@register("set_distinct_grid", S.with_(panel=S.PANEL) + """
SELECT grid_id, arg_min(CAST(66 + CAST(grid_id AS INTEGER) % 5 AS DOUBLE), date) AS longitude,
  arg_min(CAST(24 + CAST(grid_id AS INTEGER) % 4 AS DOUBLE), date) AS latitude FROM panel GROUP BY grid_id""")
def set_distinct_grid(spark, d):
    raw = C.geojson_point(C.rename_conform(FX.raw_grid(FX.panel(spark, d))))
    raw = raw.withColumn("order_date", F.make_date("year", "month", F.lit(1)))
    return rounded(J.distinct_first(raw, order="order_date"))

