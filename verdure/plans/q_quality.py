"""Registered queries: data quality (fills, winsorising, profiles, export validation)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conform as C
from ..operators import indices as I
from ..operators import quality as Q
from ..operators.temporal import order_window
from ..session import cut_lineage
from ..sources import fixtures as FX
from ..sources import readers as R
from . import sqlfrag as S
from .q_indices import PROXY_CTES
from .q_temporal import GAPPY_CTE
from .registry import register, rounded

D = "CAST(date AS VARCHAR) AS date"
MAX_NULL_PCT = 50.0


@register("dq_median_fill", GAPPY_CTE + f"""
SELECT grid_id, {D}, {S.r6('coalesce(ndvi, (SELECT quantile_cont(ndvi, 0.5) FROM gappy))')} AS ndvi FROM gappy""")
def dq_median_fill(spark, d):
    g = FX.panel_gappy(FX.panel(spark, d)).select("grid_id", "date", "ndvi")
    return rounded(Q.median_fill(g, ["ndvi"]))


def _wins_sql(c):
    q1 = f"(SELECT quantile_cont({c}, 0.25) FROM panel)"
    q3 = f"(SELECT quantile_cont({c}, 0.75) FROM panel)"
    iqr = f"({q3} - {q1})"
    lo, hi = f"({q1} - 1.5 * {iqr})", f"({q3} + 1.5 * {iqr})"
    return f"CASE WHEN {iqr} > 0 AND {c} < {lo} THEN {lo} WHEN {iqr} > 0 AND {c} > {hi} THEN {hi} ELSE {c} END"


@register("dq_iqr_winsorize", S.with_(panel=S.PANEL) + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(_wins_sql(c))} AS {c}" for c in ("ndvi", "lst", "rainfall")) + " FROM panel")
def dq_iqr_winsorize(spark, d):
    p = FX.panel(spark, d)
    return rounded(Q.iqr_winsorize(p, ["ndvi", "lst", "rainfall"]))


@register("dq_profile", GAPPY_CTE + """
SELECT count(*) AS n_rows, count(DISTINCT grid_id) AS n_cells, CAST(min(date) AS VARCHAR) AS date_min,
  CAST(max(date) AS VARCHAR) AS date_max, CAST(count_if(ndvi IS NULL) AS BIGINT) AS null_ndvi, CAST(count_if(lst IS NULL) AS BIGINT) AS null_lst,
  CAST(count_if(rainfall IS NULL) AS BIGINT) AS null_rainfall FROM gappy""")
def dq_profile(spark, d):
    return rounded(Q.profile(FX.panel_gappy(FX.panel(spark, d))))


@register("dq_null_top", GAPPY_CTE + """, t AS (
  SELECT 'grid_id' AS "column", CAST(count_if(grid_id IS NULL) AS BIGINT) AS n_null FROM gappy UNION ALL
  SELECT 'date', CAST(count_if(date IS NULL) AS BIGINT) FROM gappy UNION ALL SELECT 'ndvi', CAST(count_if(ndvi IS NULL) AS BIGINT) FROM gappy UNION ALL
  SELECT 'lst', CAST(count_if(lst IS NULL) AS BIGINT) FROM gappy UNION ALL SELECT 'rainfall', CAST(count_if(rainfall IS NULL) AS BIGINT) FROM gappy)
SELECT * FROM t ORDER BY n_null DESC, "column" LIMIT 30""")
def dq_null_top(spark, d):
    return Q.null_counts_tidy(FX.panel_gappy(FX.panel(spark, d)))


RANGE_SQL = S.with_(panel=S.PANEL) + """, g AS (
  SELECT CAST(66 + CAST(grid_id AS INTEGER) % 5 AS DOUBLE) AS longitude, CAST(24 + CAST(grid_id AS INTEGER) % 4 AS DOUBLE) AS latitude,
         ndvi, rainfall FROM panel)
SELECT coalesce(latitude >= 6.0 AND latitude <= 38.0 AND longitude >= 68.0 AND longitude <= 98.0
  AND ndvi >= -1.0 AND ndvi <= 1.0 AND rainfall >= 0.0, false) AS valid, count(*) AS n_rows FROM g GROUP BY 1"""


@register("dq_range_check", RANGE_SQL)
def dq_range_check(spark, d):
    raw = C.geojson_point(C.rename_conform(FX.raw_grid(FX.panel(spark, d))))
    checked = C.range_check(raw.select("longitude", "latitude", "ndvi", "rainfall"))
    return checked.groupBy(F.coalesce("valid", F.lit(False)).alias("valid")).agg(F.count(F.lit(1)).alias("n_rows"))


SCREEN = ["rainfall", "temperature", "humidity", "evapotranspiration", "soil_moisture"]


def _screen_sql():
    idx = f"""SELECT *, {S.scaled('ndvi', 'grid_id')} AS vci, {S.scaled('lst', 'grid_id', invert=True)} AS tci FROM proxy"""
    tgt = "SELECT *, lead(0.5 * vci + 0.5 * tci, 1) OVER (PARTITION BY grid_id ORDER BY date) AS target FROM idx"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, corr({c}, target) AS r, count_if({c} IS NOT NULL AND target IS NOT NULL) AS n FROM tg"
        for c in SCREEN)
    return S.with_(**PROXY_CTES, idx=idx, tg=tgt) + f"SELECT variable, {S.r6('abs(r)')} AS score FROM ({parts}) WHERE n > 30"


@register("dq_screen_correlation", _screen_sql())
def dq_screen_correlation(spark, d):
    p = I.add_vci_tci_vhi(C.proxy_fill(FX.panel(spark, d)), clip_vhi=False)
    p = p.withColumn("target", F.lead("vhi", 1).over(order_window(["grid_id"])))
    return rounded(Q.screen_correlation(p, SCREEN, "target"))


# ---- export files -----------------------------------------------------------------------------
PFX = FX.EXPORT_PREFIX


def _mask(c):
    return (f"CASE WHEN CAST(grid_id AS INTEGER) % 10 = 3 OR date = DATE '{FX.TOO_NULL_MONTH}' "
            f"THEN -9999.0 ELSE {c} END")


EXPORT_CTES = dict(
    panel=S.PANEL,
    exp_base=f"""SELECT '{PFX}' || strftime(date, '%Y_%m') || '.csv' AS file, grid_id, date,
      {_mask('ndvi')} AS modis_ndvi, {_mask('lst')} AS modis_lst, {_mask('rainfall')} AS chirps_rainfall
      FROM panel WHERE date <> DATE '{FX.MISSING_MONTH}'""",
    exp=f"""SELECT * FROM exp_base UNION ALL
      SELECT '{PFX}' || strftime(date, '%Y_%m') || '(1).csv', grid_id, date, modis_ndvi, modis_lst, chirps_rainfall
      FROM exp_base WHERE date = DATE '{FX.DUPLICATE_MONTH}' AND CAST(grid_id AS INTEGER) % 2 = 0""",
)
MONTH_RE = "^" + PFX + r"(\d{4})_(\d{2})(?:\(\d+\))?\.csv$"


def _isnull(c):
    return f"(CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} IN (-9999.0, -10272.15) THEN 1 ELSE 0 END)"


INSPECT_SQL = f"""SELECT file, CASE WHEN regexp_extract(file, '{MONTH_RE}', 1) = '' THEN NULL ELSE
    regexp_extract(file, '{MONTH_RE}', 1) || '_' || regexp_extract(file, '{MONTH_RE}', 2) END AS month,
  count(*) AS row_count,
  {S.bround(f"sum({_isnull('modis_ndvi')} + {_isnull('modis_lst')} + {_isnull('chirps_rainfall')}) / (count(*) * 3) * 100", 2)} AS null_pct
FROM exp GROUP BY file"""
EXPORT_COLS = ["modis_ndvi", "modis_lst", "chirps_rainfall"]


def _inspected(spark, d):
    """Export files written, read again and inspected: one row per file."""
    path = R.write_export_files(FX.export_lines(FX.panel(spark, d)), R.scratch_path(spark, "exports"))
    headers, rows = R.read_export_csvs(spark, path)
    return Q.inspect_files(headers, rows, list(FX.EXPORT_HEADER), EXPORT_COLS, PFX, MAX_NULL_PCT)


# invalid and empty files keep their name and month; only readable ones have a NULL share
STATUS_SQL = f"""SELECT file, month, CASE WHEN month = '{FX.EMPTY_MONTH[:7].replace('-', '_')}' THEN 0 ELSE row_count END AS row_count,
  CASE WHEN month IN ('{FX.EMPTY_MONTH[:7].replace('-', '_')}', '{FX.INVALID_MONTH[:7].replace('-', '_')}') THEN NULL ELSE null_pct END AS null_pct,
  CASE WHEN month = '{FX.INVALID_MONTH[:7].replace('-', '_')}' THEN 'invalid' WHEN month = '{FX.EMPTY_MONTH[:7].replace('-', '_')}' THEN 'empty'
    WHEN null_pct <= {MAX_NULL_PCT} THEN 'valid' ELSE 'too_null' END AS status FROM ins"""


@register("dq_export_month_parse", S.with_(**EXPORT_CTES) + f"""
SELECT file, CASE WHEN regexp_extract(file, '{MONTH_RE}', 1) = '' THEN NULL ELSE
    regexp_extract(file, '{MONTH_RE}', 1) || '_' || regexp_extract(file, '{MONTH_RE}', 2) END AS month
FROM (SELECT DISTINCT file FROM exp)""")
def dq_export_month_parse(spark, d):
    files = FX.export_files(FX.panel(spark, d)).select("file").distinct()
    return files.select("file", Q.parse_export_month(F.col("file"), PFX).alias("month"))


@register("dq_export_inspect", S.with_(**EXPORT_CTES, ins=INSPECT_SQL) + f"""
{STATUS_SQL}""")
def dq_export_inspect(spark, d):
    return rounded(_inspected(spark, d))


COVERAGE_CTES = dict(
    **EXPORT_CTES,
    ins=INSPECT_SQL,
    ins2=STATUS_SQL,
    expected="SELECT DISTINCT strftime(date, '%Y_%m') AS month, true AS expected FROM panel",
    ranked="""SELECT month, file, null_pct, count(*) OVER (PARTITION BY month) AS n_files,
      row_number() OVER (PARTITION BY month ORDER BY CASE WHEN status = 'valid' THEN 1 ELSE 0 END DESC, row_count DESC, file DESC) AS rk
      FROM ins2 WHERE month IS NOT NULL""",
    cov=f"""SELECT coalesce(e.month, r.month) AS month, coalesce(r.n_files, 0) AS n_files, r.file AS best_file,
      r.n_files IS NULL AS is_missing, coalesce(r.n_files > 1, false) AS is_duplicate,
      coalesce(e.expected AND r.null_pct > {MAX_NULL_PCT}, false) AS is_too_null
      FROM expected e FULL JOIN (SELECT * FROM ranked WHERE rk = 1) r ON e.month = r.month""",
)


def _coverage(spark, d):
    p = FX.panel(spark, d)
    expected = p.select(F.date_format("date", "yyyy_MM").alias("month")).distinct()
    inspected = cut_lineage(_inspected(spark, d))  # one row per file, read by coverage and broken months
    return Q.month_coverage(expected, inspected, MAX_NULL_PCT), inspected


@register("dq_month_coverage", S.with_(**COVERAGE_CTES) + "SELECT * FROM cov")
def dq_month_coverage(spark, d):
    return _coverage(spark, d)[0]


@register("dq_broken_months", S.with_(**COVERAGE_CTES) + """
SELECT month FROM cov WHERE is_missing OR is_too_null UNION SELECT month FROM ins2 WHERE status <> 'valid' AND month IS NOT NULL""")
def dq_broken_months(spark, d):
    return Q.broken_months(*_coverage(spark, d))


@register("prj_sentinel_null", S.with_(**EXPORT_CTES) + f"""
SELECT file, grid_id, {D}, {', '.join(f"{S.r6(f'CASE WHEN {_isnull(c)} = 1 THEN NULL ELSE {c} END')} AS {c}" for c in EXPORT_COLS)} FROM exp""")
def prj_sentinel_null(spark, d):
    rows = FX.export_files(FX.panel(spark, d))
    return rounded(C.sentinel_null(rows, EXPORT_COLS))

