"""Registered queries: sources, sinks and schema conformance.

File-based sources first write the given tables in the raw shape (CSV per
month, JSON documents, Parquet) into a fresh folder under the shared checkpoint
dir, then read them back through the reader — so the reader does the real work
on data that grows with the input tables.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import clip
from ..operators import conform as C
from ..sources import fixtures as FX
from ..sources import readers as R
from . import sqlfrag as S
from .q_quality import EXPORT_CTES, _isnull
from .q_temporal import GAPPY_CTE
from .registry import register, rounded

D = "CAST(date AS VARCHAR) AS date"
PANEL_CTE = S.with_(panel=S.PANEL)
SIG = ["ndvi", "lst", "rainfall"]
LON = "CAST(66 + CAST(grid_id AS INTEGER) % 5 AS DOUBLE)"
LAT = "CAST(24 + CAST(grid_id AS INTEGER) % 4 AS DOUBLE)"


def _raw_read(spark, d):
    path = R.write_grid_csvs(FX.raw_grid(FX.panel(spark, d)), R.scratch_path(spark, "grid"))
    return R.read_grid_csvs(spark, path)


def conformed(raw):
    x = C.rename_conform(raw)
    x = C.date_coalesce(x)
    return C.geojson_point(x)


@register("src_grid_csv_union", PANEL_CTE + f"""
SELECT grid_id, {D}, {', '.join(f"{S.r6(c)} AS {c}" for c in SIG)}, {LON} AS longitude, {LAT} AS latitude,
  'Grid_' || strftime(date, '%Y_%m') || '.csv' AS source_file FROM panel""")
def src_grid_csv_union(spark, d):
    x = conformed(_raw_read(spark, d))
    return rounded(x.select("grid_id", "date", *SIG, "longitude", "latitude", "source_file"))


@register("src_pruned_scan", """
SELECT CAST(l_suppkey AS VARCHAR) AS grid_id, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem GROUP BY 1""")
def src_pruned_scan(spark, d):
    li = FX.table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("grid_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@register("src_file_window", PANEL_CTE + f""", f AS (SELECT DISTINCT 'Grid_' || strftime(date, '%Y_%m') || '.csv' AS source_file FROM panel),
firstn AS (SELECT source_file FROM f ORDER BY source_file LIMIT 24)
SELECT grid_id, {D}, 'Grid_' || strftime(date, '%Y_%m') || '.csv' AS source_file FROM panel
WHERE 'Grid_' || strftime(date, '%Y_%m') || '.csv' IN (SELECT source_file FROM firstn)""")
def src_file_window(spark, d, n_files: int = 24):
    path = R.write_grid_csvs(FX.raw_grid(FX.panel(spark, d)), R.scratch_path(spark, "grid"))
    # names come from the listing; headers and rows are read of the chosen files only
    raw = R.read_grid_csvs(spark, path, files=R.first_files(spark, path, n_files))
    x = C.date_coalesce(C.rename_conform(raw))
    return rounded(x.select("grid_id", "date", "source_file"))


@register("src_month_selector", PANEL_CTE + f"""
SELECT grid_id, {D}, 'range' AS chosen FROM panel WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-01' UNION ALL
SELECT grid_id, {D}, 'list' FROM panel WHERE date IN (DATE '1995-01-01', DATE '1996-06-01', DATE '1998-07-01')""")
def src_month_selector(spark, d, start="1996-03", end="1997-02", months=("1995_01", "1996_06", "1998-07")):
    p = FX.panel(spark, d).select("grid_id", "date")
    a = C.select_months(p, start, end).withColumn("chosen", F.lit("range"))
    return rounded(a.unionByName(C.select_months(p, months=list(months)).withColumn("chosen", F.lit("list"))))


@register("src_geojson_point", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE WHEN CAST(grid_id AS INTEGER) % 13 = 0 THEN NULL ELSE {LON} END AS longitude,
  CASE WHEN CAST(grid_id AS INTEGER) % 13 = 0 THEN NULL ELSE {LAT} END AS latitude FROM panel""")
def src_geojson_point(spark, d):
    raw = C.rename_conform(FX.raw_grid(FX.panel(spark, d)))
    broken = F.col("grid_id").cast("int") % 13 == 0
    raw = raw.withColumn(".geo", F.when(broken, F.lit('{"type":"Point","coordinates":[')).otherwise(F.col("`.geo`")))
    x = C.geojson_point(C.date_coalesce(raw))
    return rounded(x.select("grid_id", "date", "longitude", "latitude"))


@register("src_climate_json", PANEL_CTE + f"""
SELECT grid_id, {D}, {S.r6('lst')} AS temperature, {S.r6('rainfall')} AS humidity, NULL::DOUBLE AS wind_speed,
  NULL::DOUBLE AS solar_radiation FROM panel""")
def src_climate_json(spark, d):
    docs = FX.climate_json(FX.panel(spark, d))
    path = R.scratch_path(spark, "climate")
    docs.write.mode("overwrite").json(path)
    back = spark.read.schema("grid_id STRING, body STRING").json(path)
    out = R.parse_climate_json(back)
    return rounded(out.select("grid_id", "date", "temperature", "humidity", "wind_speed", "solar_radiation"))


def soil_docs(spark, d):
    s = FX.table(spark, d, "supplier")
    sand = (F.floor(F.abs(F.col("s_acctbal"))) % 400 + 100).cast("double")
    clay = (F.col("s_suppkey") % 300 + 50).cast("double")
    soc = F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_suppkey") % 90).cast("double"))

    def layer(name, v):
        return F.struct(F.lit(name).alias("name"), F.array(F.struct(F.struct(v.alias("mean")).alias("values"))).alias("depths"))
    layers = F.filter(F.array(layer("sand", sand), layer("clay", clay), layer("soc", soc)),
                      lambda l: l["depths"][0]["values"]["mean"].isNotNull())
    return s.select(F.col("s_suppkey").cast("string").alias("grid_id"),
                    F.to_json(F.struct(F.struct(layers.alias("layers")).alias("properties"))).alias("body"))


@register("src_soil_json", f"""
SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 400 + 100 AS DOUBLE) AS sand,
  CAST(s_suppkey % 300 + 50 AS DOUBLE) AS clay,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 90 AS DOUBLE) ELSE 80.0 END AS soc,
  {S.r6(S.clip('CAST(s_suppkey % 300 + 50 AS DOUBLE) / (CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 400 + 100 AS DOUBLE) + CAST(s_suppkey % 300 + 50 AS DOUBLE) + 1) * 0.8', 0.05, 0.9))} AS soil_moisture
FROM supplier""")
def src_soil_json(spark, d):
    out = R.parse_soil_json(soil_docs(spark, d))
    return rounded(out.select("grid_id", "sand", "clay", "soc", "soil_moisture"))


def scene_samples(spark, d):
    """Sub-monthly scene samples from lineitem lines: three bands per line, cloud %
    from the line number."""
    li = FX.table(spark, d, "lineitem")
    bands = F.array(F.struct(F.lit("modis").alias("band"), F.col("l_discount").alias("value")),
                    F.struct(F.lit("chirps").alias("band"), F.col("l_tax").alias("value")),
                    F.struct(F.lit("s2").alias("band"), F.col("l_quantity").alias("value")))
    return li.select(F.col("l_suppkey").cast("string").alias("grid_id"), F.col("l_shipdate").alias("ts"),
                     ((F.col("l_linenumber") * 13) % 100).cast("double").alias("cloud_pct"), F.inline(bands))


COMPOSITE_RULES = {"modis": "mean", "chirps": "sum", "s2": "median"}


@register("src_composite_month", f"""
SELECT CAST(l_suppkey AS VARCHAR) AS grid_id, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS date,
  {S.r6('avg(l_discount)')} AS modis, {S.r6('sum(l_tax)')} AS chirps, {S.r6('median(l_quantity)')} AS s2
FROM lineitem GROUP BY 1, 2""")
def src_composite_month(spark, d):
    return rounded(R.composite_month(scene_samples(spark, d), COMPOSITE_RULES))


@register("src_scene_filter", f"""
SELECT CAST(l_suppkey AS VARCHAR) AS grid_id, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS date,
  {S.r6('avg(l_discount)')} AS modis, {S.r6('sum(l_tax)')} AS chirps, {S.r6('median(l_quantity)')} AS s2
FROM lineitem WHERE (l_linenumber * 13) % 100 < 45 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
GROUP BY 1, 2""")
def src_scene_filter(spark, d):
    s = R.scene_filter(scene_samples(spark, d), "1996-01-01", "1998-01-01")
    return rounded(R.composite_month(s, COMPOSITE_RULES))


@register("src_region_reduce", PANEL_CTE + f"""
SELECT {D}, {', '.join(f"{S.r6(f'avg({c})')} AS {c}" for c in SIG)} FROM panel
WHERE {LON} BETWEEN 67.0 AND 69.0 AND {LAT} BETWEEN 24.0 AND 26.0 GROUP BY date""")
def src_region_reduce(spark, d):
    raw = C.geojson_point(C.rename_conform(FX.raw_grid(FX.panel(spark, d))))
    raw = raw.withColumn("date", F.make_date("year", "month", F.lit(1)))
    return rounded(R.region_reduce(raw, SIG))


@register("sink_panel", PANEL_CTE + "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows FROM panel GROUP BY 1")
def sink_panel(spark, d):
    path = R.sink_panel(FX.panel(spark, d), R.scratch_path(spark, "panel"))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("sink_history_append", S.with_(hist=S.HISTORY) + f"""
SELECT {S.sev_label_risk('risk_score')} AS severity, count(*) AS n_rows FROM hist GROUP BY 1""")
def sink_history_append(spark, d):
    from ..operators.history import with_severity
    h = with_severity(FX.history(spark, d))
    path = R.scratch_path(spark, "history")
    even, odd = (h.where(F.col("id") % 2 == r) for r in (0, 1))
    for batch, rows in (("even", even), ("odd", odd), ("even", even)):  # one batch comes twice
        R.append_history(rows, path, batch)
    back = R.read_history(spark, path)
    return back.groupBy("severity").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- conformance projections -----------------------------------------------------------------
@register("prj_rename_conform", PANEL_CTE + f"""
SELECT grid_id, {', '.join(f"{S.r6(c)} AS {c}" for c in SIG)}, CASE WHEN (CAST(grid_id AS INTEGER) + month(date)) % 11 = 0
  THEN NULL ELSE strftime(date, '%Y_%m') END AS raw_date FROM panel""")
def prj_rename_conform(spark, d):
    x = C.rename_conform(FX.raw_grid(FX.panel(spark, d)))
    return rounded(x.select("grid_id", *SIG, F.col("date").alias("raw_date")))


@register("prj_date_coalesce", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE (CAST(grid_id AS INTEGER) + month(date)) % 11 WHEN 0 THEN 'year_month' WHEN 1 THEN 'file' ELSE 'date' END AS date_source
FROM panel WHERE (CAST(grid_id AS INTEGER) + month(date)) % 11 <> 2""")
def prj_date_coalesce(spark, d):
    raw = C.rename_conform(FX.raw_grid(FX.panel(spark, d)))
    # some rows keep their file name only, some no date at all (those are dropped)
    k = (F.col("grid_id").cast("int") + F.col("month")) % 11
    raw = raw.withColumns({"date": F.when(~k.isin(1, 2), F.col("date")), "year": F.when(~k.isin(1, 2), F.col("year")),
                           "source_file": F.when(k != 2, F.col("source_file")),
                           "date_source": F.when(k == 0, "year_month").when(k == 1, "file").otherwise("date")})
    x = C.date_coalesce(raw)
    return rounded(x.select("grid_id", "date", "date_source"))


PROXY_OUT = ["temperature", "humidity", "evapotranspiration", "soil_moisture"]


@register("prj_proxy_fill", S.with_(panel=S.PANEL) + f""", p1 AS (SELECT grid_id, date, ndvi, lst, {S.clip('rainfall', lo=0.0)} AS rainfall FROM panel),
p2 AS (SELECT *, lst - 2.0 AS temperature, {S.clip('65 - lst + rainfall / 8', 15.0, 95.0)} AS humidity FROM p1),
p3 AS (SELECT *, {S.clip(f"0.08 * {S.clip('temperature', lo=0.0)} + 0.02 * (100 - humidity) + 0.01 * lst", 0.0, 12.0)} AS evapotranspiration FROM p2),
p4 AS (SELECT *, {S.clip(f"0.08 + rainfall / 350 + {S.clip('ndvi', 0.0, 1.0)} / 3 - evapotranspiration / 60", 0.02, 0.95)} AS soil_moisture FROM p3)
SELECT grid_id, {D}, {', '.join(f"{S.r6(c)} AS {c}" for c in PROXY_OUT)} FROM p4""")
def prj_proxy_fill(spark, d):
    return rounded(C.proxy_fill(FX.panel(spark, d)).select("grid_id", "date", *PROXY_OUT))


PROXY_X = ["solar_radiation", "wind_speed", "soil_moisture", "mndwi"]


@register("prj_proxy_fill_x", PANEL_CTE + f"""
SELECT grid_id, {D}, {S.r6(S.clip('22 + lst * 0.35', 8.0, 35.0))} AS solar_radiation, {S.r6(S.clip('2.5 + lst / 30', 0.2, 8.0))} AS wind_speed,
  {S.r6(S.clip('0.12 + rainfall / 300 + ndvi / 3', 0.02, 0.95))} AS soil_moisture,
  {S.r6(S.clip('rainfall / 250 - lst / 80', -1.0, 1.0))} AS mndwi FROM panel""")
def prj_proxy_fill_x(spark, d):
    return rounded(C.proxy_fill_x(FX.panel(spark, d)).select("grid_id", "date", *PROXY_X))


@register("prj_clip", GAPPY_CTE + f"""
SELECT grid_id, {D}, {S.r6(S.clip('ndvi', 0.3, 0.6))} AS ndvi, {S.r6(S.clip('rainfall - 1.0', lo=0.0))} AS rainfall FROM gappy""")
def prj_clip(spark, d):
    g = FX.panel_gappy(FX.panel(spark, d))
    return rounded(g.select("grid_id", "date", clip("ndvi", 0.3, 0.6).alias("ndvi"),
                            clip(F.col("rainfall") - 1.0, lo=0.0).alias("rainfall")))


def raw_bands(p):
    """Raw band units with -9999 fills where id % 10 == 3."""
    fill = F.col("grid_id").cast("int") % 10 == 3

    def v(e):
        return F.when(fill, F.lit(K.FILL_VALUE)).otherwise(e)
    return p.select("grid_id", "date",
                    v(F.col("lst") + 273.15).alias("temperature_2m"),
                    v(F.col("ndvi") * 10000).alias("NDVI"),
                    v((F.col("lst") + 273.15) / 0.02).alias("LST_Day_1km"),
                    v(-F.col("rainfall") / 1000).alias("total_evaporation_sum"))


def _fill(e):
    return f"CASE WHEN CAST(grid_id AS INTEGER) % 10 = 3 THEN -9999.0 ELSE {e} END"


@register("prj_band_scaling", PANEL_CTE + f""", raw AS (SELECT grid_id, date, {_fill('lst + 273.15')} AS t2m, {_fill('ndvi * 10000')} AS nd,
  {_fill('(lst + 273.15) / 0.02')} AS lstd, {_fill('-rainfall / 1000')} AS ev FROM panel)
SELECT grid_id, {D}, {S.r6("CASE WHEN t2m = -9999.0 THEN NULL ELSE t2m END - 273.15")} AS temperature,
  {S.r6("CASE WHEN nd = -9999.0 THEN NULL ELSE nd END * 0.0001")} AS modis_ndvi,
  {S.r6("CASE WHEN lstd = -9999.0 THEN NULL ELSE lstd END * 0.02 - 273.15")} AS modis_lst,
  {S.r6("abs(CASE WHEN ev = -9999.0 THEN NULL ELSE ev END)")} AS evapotranspiration FROM raw""")
def prj_band_scaling(spark, d):
    x = C.band_scaling(raw_bands(FX.panel(spark, d)))
    return rounded(x.select("grid_id", "date", "temperature", "modis_ndvi", "modis_lst", "evapotranspiration"))


@register("prj_relative_humidity", PANEL_CTE + f"""
SELECT grid_id, {D}, {S.r6(S.clip('100 * exp(17.625 * (lst - 10 - rainfall / 50) / ((lst - 10 - rainfall / 50) + 243.04)) / exp(17.625 * lst / (lst + 243.04))', 0.0, 100.0))} AS humidity FROM panel""")
def prj_relative_humidity(spark, d):
    p = FX.panel(spark, d)
    td = F.col("lst") - 10 - F.col("rainfall") / 50
    return rounded(p.select("grid_id", "date", C.relative_humidity(F.col("lst"), td).alias("humidity")))


@register("prj_wind_speed", PANEL_CTE + f"SELECT grid_id, {D}, {S.r6('sqrt((ndvi * 10) * (ndvi * 10) + (rainfall / 10) * (rainfall / 10))')} AS wind_speed FROM panel")
def prj_wind_speed(spark, d):
    p = FX.panel(spark, d)
    return rounded(p.select("grid_id", "date", C.wind_speed(F.col("ndvi") * 10, F.col("rainfall") / 10).alias("wind_speed")))


@register("prj_mndwi", GAPPY_CTE + f"""
SELECT grid_id, {D}, {S.r6('CASE WHEN ndvi IS NULL THEN NULL ELSE (ndvi - lst / 100) / (ndvi + lst / 100) END')} AS mndwi FROM gappy""")
def prj_mndwi(spark, d):
    g = FX.panel_gappy(FX.panel(spark, d))
    return rounded(g.select("grid_id", "date", C.mndwi(F.col("ndvi"), F.col("lst") / 100).alias("mndwi")))


@register("prj_first_existing", S.with_(**EXPORT_CTES) + f"""
SELECT file, grid_id, {D}, {S.r6('modis_ndvi')} AS ndvi_source FROM exp""")
def prj_first_existing(spark, d):
    rows = FX.export_files(FX.panel(spark, d))
    x = C.first_existing(rows, ["modis_ndvi", "evi", "ndvi"], "ndvi_source")
    return rounded(x.select("file", "grid_id", "date", "ndvi_source"))


@register("prj_availability_flag", S.with_(**EXPORT_CTES) + f""", m AS (
  SELECT strftime(date, '%Y_%m') AS month, max(CASE WHEN {_isnull('modis_ndvi')} = 0 THEN 1 ELSE 0 END) AS has_modis,
    max(CASE WHEN {_isnull('chirps_rainfall')} = 0 THEN 1 ELSE 0 END) AS has_chirps FROM exp GROUP BY 1)
SELECT * FROM m""")
def prj_availability_flag(spark, d):
    from ..functions.scalar import sentinel_to_null
    rows = FX.export_files(FX.panel(spark, d))
    return rows.groupBy(F.date_format("date", "yyyy_MM").alias("month")).agg(
        F.max(sentinel_to_null("modis_ndvi").isNotNull().cast("int")).alias("has_modis"),
        F.max(sentinel_to_null("chirps_rainfall").isNotNull().cast("int")).alias("has_chirps"))


@register("prj_grid_code", PANEL_CTE + """, g AS (SELECT DISTINCT grid_id FROM panel),
r AS (SELECT grid_id, dense_rank() OVER (ORDER BY grid_id) - 1 AS code, count(*) OVER () AS n FROM g)
SELECT grid_id, round(code / greatest(n - 1, 1) * 1000000) / 1000000 + 0.0 AS grid_code FROM r""")
def prj_grid_code(spark, d):
    from ..operators.joins import global_rank
    g = FX.panel(spark, d).select("grid_id").distinct()
    r = global_rank(g, "grid_id", out="code")
    n = g.agg(F.count(F.lit(1))).scalar()
    return rounded(r.select("grid_id", (F.col("code") / F.greatest(n - 1, F.lit(1))).alias("grid_code")))


def _feature_frame(spark, d):
    from .frames import feature_panel
    return feature_panel(spark, d, signals=("ndvi", "vhi"), wavelet=False)


def _feature_sql():
    """DuckDB text of ``feature_panel(signals=(ndvi, vhi), wavelet=False)`` plus the
    schema-level column catalogue the selections run on."""
    from .q_indices import PROXY_CTES, _zs
    w = "OVER (PARTITION BY grid_id ORDER BY date)"

    def rows(a, b):
        return f"OVER (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {-a} PRECEDING AND {-b} PRECEDING)"
    sig = ["ndvi", "vhi"]
    cols = {c: "double" for c in ["ndvi", "lst", "rainfall", "temperature", "humidity", "evapotranspiration",
                                   "soil_moisture", "vci", "tci", "vhi", "spi", "spei"]}
    cols.update({"month": "int", "month_sin": "double", "month_cos": "double", "season": "int",
                 "season_sin": "double", "season_cos": "double"})
    win = []
    for c in sig:
        for k in K.LAGS:
            win.append(f"lag({c}, {k}) {w} AS {c}_lag_{k}")
            cols[f"{c}_lag_{k}"] = "double"
        for k in K.ROLLING_WINDOWS:
            win.append(f"avg({c}) {rows(-k, -1)} AS {c}_roll_{k}")
            cols[f"{c}_roll_{k}"] = "double"
        for k in K.ROLLING_WINDOWS:
            win.append(f"stddev_samp({c}) {rows(-k, -1)} AS {c}_std_{k}")
            cols[f"{c}_std_{k}"] = "double"
    for h in K.HORIZONS:
        win.append(f"lead(vhi, {h}) {w} AS target_vhi_h{h}")
        cols[f"target_vhi_h{h}"] = "double"
    ctes = dict(
        **PROXY_CTES,
        idx=f"SELECT *, {S.scaled('ndvi', 'grid_id')} AS vci, {S.scaled('lst', 'grid_id', invert=True)} AS tci FROM proxy",
        vh=f"SELECT *, {S.clip('0.5 * vci + 0.5 * tci', 0.0, 1.0)} AS vhi FROM idx",
        z=f"""SELECT *, {_zs('rainfall', 'grid_id')} AS spi, {_zs('rainfall - evapotranspiration * 20', 'grid_id')} AS spei,
              CAST(month(date) AS INTEGER) AS month, CAST(floor((month(date) % 12) / 3) AS INTEGER) AS season FROM vh""",
        cal=f"""SELECT *, sin({S.TWO_PI} * month / 12) AS month_sin, cos({S.TWO_PI} * month / 12) AS month_cos,
                sin({S.TWO_PI} * season / 4) AS season_sin, cos({S.TWO_PI} * season / 4) AS season_cos FROM z""",
        feat=f"SELECT *, {', '.join(win)} FROM cal",
    )
    return S.with_(**ctes), cols


FEATURE_CTE, FEATURE_COLS = _feature_sql()


def _feature_select_sql(chosen):
    out = [f"{S.r6(c)} AS {c}" if FEATURE_COLS[c] == "double" else c for c in chosen]
    return FEATURE_CTE + f"SELECT grid_id, CAST(date AS VARCHAR) AS date, {', '.join(out)} FROM feat"


# The columns each selection must give, spelled out.
NUMERIC_EXPECTED = """ndvi lst rainfall temperature humidity evapotranspiration soil_moisture vci tci vhi spi spei
month month_sin month_cos season season_sin season_cos
ndvi_lag_1 ndvi_lag_2 ndvi_lag_3 ndvi_lag_6 ndvi_roll_3 ndvi_roll_6 ndvi_roll_12 ndvi_std_3 ndvi_std_6 ndvi_std_12
vhi_lag_1 vhi_lag_2 vhi_lag_3 vhi_lag_6 vhi_roll_3 vhi_roll_6 vhi_roll_12 vhi_std_3 vhi_std_6 vhi_std_12""".split()
UNBLOCKED_EXPECTED = [c for c in NUMERIC_EXPECTED if c not in ("vci", "tci", "vhi")]
GROUP_EXPECTED = """ndvi lst rainfall vci tci vhi temperature humidity soil_moisture month month_sin month_cos season season_sin season_cos
ndvi_lag_1 ndvi_lag_2 ndvi_lag_3 ndvi_roll_3 vhi_lag_1 vhi_lag_2 vhi_lag_3 vhi_roll_3""".split()


@register("prj_numeric_features", _feature_select_sql(NUMERIC_EXPECTED))
def prj_numeric_features(spark, d):
    f = _feature_frame(spark, d)
    return rounded(f.select("grid_id", "date", *C.numeric_features(f)))


@register("prj_leakage_block", _feature_select_sql(UNBLOCKED_EXPECTED))
def prj_leakage_block(spark, d):
    f = _feature_frame(spark, d)
    return rounded(f.select("grid_id", "date", *C.leakage_block(C.numeric_features(f))))


@register("prj_group_features", _feature_select_sql(GROUP_EXPECTED))
def prj_group_features(spark, d):
    f = _feature_frame(spark, d)
    chosen = C.select_group_features(C.numeric_features(f), lag_window=3, wavelet_level=1, off={"vhi_wavelet"})
    return rounded(f.select("grid_id", "date", *chosen))


@register("dq_required_columns", FEATURE_CTE + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('vhi')} AS vhi, {S.r6('target_vhi_h1')} AS vhi_next_month FROM feat""")
def dq_required_columns(spark, d):
    f = _feature_frame(spark, d).withColumn("vhi_next_month", F.col("target_vhi_h1"))
    return rounded(C.require_columns(f, ["grid_id", "date", "vhi", "vhi_next_month"]))

