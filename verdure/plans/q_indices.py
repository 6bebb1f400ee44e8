"""Registered queries: panel collapse, drought indices, severity."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clip, severity_class_vhi, severity_label_vhi, severity_label_vhi100
from ..operators import indices as I
from ..operators.conform import proxy_fill
from ..sources import fixtures as FX
from . import sqlfrag as S
from .registry import register, rounded

PANEL_CTE = S.with_(panel=S.PANEL)


def vhi_panel(spark, d):
    return I.add_vci_tci_vhi(FX.panel(spark, d))


VHI_SQL_CTE = S.with_(
    panel=S.PANEL,
    idx=f"""SELECT *, {S.scaled('ndvi', 'grid_id')} AS vci, {S.scaled('lst', 'grid_id', invert=True)} AS tci FROM panel""",
    vhi=f"""SELECT *, {S.clip('0.5 * vci + 0.5 * tci', 0.0, 1.0)} AS vhi FROM idx""",
)


@register("agg_collapse_cell_month", PANEL_CTE + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('ndvi')} AS ndvi, {S.r6('lst')} AS lst, {S.r6('rainfall')} AS rainfall FROM panel""")
def agg_collapse_cell_month(spark, d):
    return rounded(FX.panel(spark, d))


@register("idx_vci", VHI_SQL_CTE + f"SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('vci')} AS vci FROM idx")
def idx_vci(spark, d):
    return rounded(vhi_panel(spark, d).select("grid_id", "date", "vci"))


@register("idx_tci", VHI_SQL_CTE + f"SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('tci')} AS tci FROM idx")
def idx_tci(spark, d):
    return rounded(vhi_panel(spark, d).select("grid_id", "date", "tci"))


@register("idx_vhi", VHI_SQL_CTE + f"SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('vhi')} AS vhi FROM vhi")
def idx_vhi(spark, d):
    return rounded(vhi_panel(spark, d).select("grid_id", "date", "vhi"))


def _until(x, invert=False):
    lo, hi = (f"quantile_cont(CASE WHEN date <= DATE '1996-12-01' THEN {x} END, {q}) OVER (PARTITION BY grid_id)" for q in (0.05, 0.95))
    v = S.clip(f"({x} - {lo}) / greatest({hi} - {lo}, 1e-6)", 0.0, 1.0)
    return f"(1.0 - {v})" if invert else v


@register("idx_vhi_fit_until", S.with_(panel=S.PANEL, idx=f"SELECT *, {_until('ndvi')} AS vci, {_until('lst', True)} AS tci FROM panel") + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6(S.clip('0.5 * vci + 0.5 * tci', 0.0, 1.0))} AS vhi FROM idx""")
def idx_vhi_fit_until(spark, d):
    """VHI whose quantiles come from the training months only."""
    return rounded(I.add_vci_tci_vhi(FX.panel(spark, d), fit_until="1996-12-01").select("grid_id", "date", "vhi"))


@register("prj_severity_vhi", VHI_SQL_CTE + f"""
SELECT {S.sev_label('vhi')} AS severity, {S.sev_class('vhi')} AS severity_class, COUNT(*) AS n_cells
FROM vhi GROUP BY 1, 2""")
def prj_severity_vhi(spark, d):
    v = vhi_panel(spark, d)
    return (v.groupBy(severity_label_vhi("vhi").alias("severity"), severity_class_vhi("vhi").alias("severity_class"))
             .agg(F.count(F.lit(1)).alias("n_cells")))


VHI100_CTE = S.with_(
    panel=S.PANEL,
    idx=f"""SELECT *, {S.scaled('ndvi', 'grid_id', scale=100.0)} AS vci,
                      {S.scaled('lst', 'grid_id', invert=True, scale=100.0)} AS tci FROM panel""",
    vhi=f"""SELECT *, {S.clip('0.5 * vci + 0.5 * tci', 0.0, 100.0)} AS vhi FROM idx""",
)


@register("idx_vhi100", VHI100_CTE + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('vci')} AS vci, {S.r6('tci')} AS tci, {S.r6('vhi')} AS vhi FROM vhi""")
def idx_vhi100(spark, d):
    v = I.add_vci_tci_vhi(FX.panel(spark, d), scale=100.0)
    return rounded(v.select("grid_id", "date", "vci", "tci", "vhi"))


@register("prj_severity_vhi100", VHI100_CTE + f"""
SELECT {S.sev_label100('vhi')} AS severity, COUNT(*) AS n_cells FROM vhi GROUP BY 1""")
def prj_severity_vhi100(spark, d):
    v = I.add_vci_tci_vhi(FX.panel(spark, d), scale=100.0)
    return v.groupBy(severity_label_vhi100("vhi").alias("severity")).agg(F.count(F.lit(1)).alias("n_cells"))


def _zs(x, part):
    sd = f"stddev_samp({x}) OVER (PARTITION BY {part})"
    mu = f"avg({x}) OVER (PARTITION BY {part})"
    return f"(CASE WHEN {sd} IS NULL OR {sd} = 0 THEN 0.0 ELSE {S.clip(f'(({x}) - {mu}) / {sd}', -3.0, 3.0)} END)"


PROXY_SQL = f"""SELECT *, lst - 2.0 AS temperature,
  {S.clip('65 - lst + rainfall / 8', 15.0, 95.0)} AS humidity FROM (SELECT grid_id, date, ndvi, lst,
  {S.clip('rainfall', lo=0.0)} AS rainfall FROM panel)"""
PROXY2_SQL = f"""SELECT *, {S.clip(f"0.08 * {S.clip('temperature', lo=0.0)} + 0.02 * (100 - humidity) + 0.01 * lst", 0.0, 12.0)}
  AS evapotranspiration FROM proxy1"""
PROXY3_SQL = f"""SELECT *, {S.clip(f"0.08 + rainfall / 350 + {S.clip('ndvi', 0.0, 1.0)} / 3 - evapotranspiration / 60", 0.02, 0.95)}
  AS soil_moisture FROM proxy2"""
PROXY_CTES = dict(panel=S.PANEL, proxy1=PROXY_SQL, proxy2=PROXY2_SQL, proxy=PROXY3_SQL)


@register("idx_spi_grid", S.with_(panel=S.PANEL) + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6(_zs('rainfall', 'grid_id'))} AS spi FROM panel""")
def idx_spi_grid(spark, d):
    p = FX.panel(spark, d)
    return rounded(p.select("grid_id", "date", I.zscore("rainfall").alias("spi")))


@register("idx_spei_grid", S.with_(**PROXY_CTES) + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6(_zs('rainfall - evapotranspiration * 20', 'grid_id'))} AS spei,
  {S.r6(_zs(f"rainfall - {S.clip('temperature', lo=0.0)} * 2", 'grid_id'))} AS spei_temp FROM proxy""")
def idx_spei_grid(spark, d):
    p = proxy_fill(FX.panel(spark, d))
    wb = F.col("rainfall") - F.col("evapotranspiration") * 20
    wb2 = F.col("rainfall") - clip("temperature", lo=0.0) * 2
    return rounded(p.select("grid_id", "date", I.zscore(wb).alias("spei"), I.zscore(wb2).alias("spei_temp")))


def _zs_month(x):
    part = "grid_id, month"
    sd = f"stddev_samp({x}) OVER (PARTITION BY {part})"
    mu = f"avg({x}) OVER (PARTITION BY {part})"
    return S.clip(f"CASE WHEN {sd} IS NULL OR {sd} = 0 OR ({x}) IS NULL THEN 0.0 ELSE (({x}) - {mu}) / {sd} END", -3.0, 3.0)


def _roll(x, k):
    return f"sum({x}) OVER (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


CLIM_CTE = S.with_(
    **PROXY_CTES,
    base=f"""SELECT grid_id, date, CAST(month(date) AS INTEGER) AS month, rainfall, evapotranspiration,
      {', '.join(f"{_roll('rainfall', k)} AS r{k}, {_roll('evapotranspiration', k)} AS e{k}" for k in (1, 3, 6, 12))}
      FROM proxy""",
    clim=f"""SELECT grid_id, date, month,
      rainfall - avg(rainfall) OVER (PARTITION BY grid_id, month) AS rainfall_anomaly,
      {', '.join(f"{_zs_month(f'r{k}')} AS spi_{k}, {_zs_month(f'r{k} - e{k}')} AS spei_{k}" for k in (1, 3, 6, 12))}
      FROM base""")


def climate_panel(spark, d):
    return I.add_climate_indices(proxy_fill(FX.panel(spark, d)))


@register("idx_rain_anomaly", CLIM_CTE + f"SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6('rainfall_anomaly')} AS rainfall_anomaly FROM clim")
def idx_rain_anomaly(spark, d):
    return rounded(climate_panel(spark, d).select("grid_id", "date", "rainfall_anomaly"))


@register("idx_spi_k", CLIM_CTE + "SELECT grid_id, CAST(date AS VARCHAR) AS date, "
          + ", ".join(f"{S.r6(f'spi_{k}')} AS spi_{k}" for k in (1, 3, 6, 12)) + " FROM clim")
def idx_spi_k(spark, d):
    return rounded(climate_panel(spark, d).select("grid_id", "date", *[f"spi_{k}" for k in (1, 3, 6, 12)]))


@register("idx_spei_k", CLIM_CTE + "SELECT grid_id, CAST(date AS VARCHAR) AS date, "
          + ", ".join(f"{S.r6(f'spei_{k}')} AS spei_{k}" for k in (1, 3, 6, 12)) + " FROM clim")
def idx_spei_k(spark, d):
    return rounded(climate_panel(spark, d).select("grid_id", "date", *[f"spei_{k}" for k in (1, 3, 6, 12)]))


def _risk_sql():
    return S.clip(
        f"100 * (0.35 * {S.clip('0.75 - ndvi', 0.0, 1.0)} + 0.25 * {S.clip('1 - rainfall / 220', 0.0, 1.0)}"
        f" + 0.2 * {S.clip('(lst - 28) / 18', 0.0, 1.0)} + 0.2 * {S.clip('1 - soil_moisture', 0.0, 1.0)})", 0.0, 100.0)


def _risk_fb_sql():
    return S.clip(
        f"35 * {S.clip('0.75 - ndvi', lo=0.0)} + 25 * {S.clip('1 - rainfall / 220', lo=0.0)}"
        f" + 20 * {S.clip('(lst - 28) / 18', lo=0.0)} + 20 * (1 - soil_moisture)", 0.0, 100.0)


@register("idx_risk_target", S.with_(**PROXY_CTES) + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6(_risk_sql())} AS risk_score FROM proxy""")
def idx_risk_target(spark, d):
    p = proxy_fill(FX.panel(spark, d))
    return rounded(p.select("grid_id", "date", I.risk_target().alias("risk_score")))


@register("idx_risk_fallback", S.with_(**PROXY_CTES) + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {S.r6(_risk_fb_sql())} AS risk_score FROM proxy""")
def idx_risk_fallback(spark, d):
    p = proxy_fill(FX.panel(spark, d))
    return rounded(p.select("grid_id", "date", I.risk_fallback(soil="soil_moisture").alias("risk_score")))


@register("idx_severity_score", VHI_SQL_CTE + f"""
SELECT grid_id, CAST(date AS VARCHAR) AS date, {', '.join(f"{S.r6(S.clip(f'1.0 - lead(vhi, {h}) OVER (PARTITION BY grid_id ORDER BY date)', 0.0, 1.0))} AS target_severity_score_h{h}" for h in (1, 2, 3, 6))}
FROM vhi""")
def idx_severity_score(spark, d):
    from ..operators.temporal import order_window
    v = vhi_panel(spark, d)
    w = order_window(["grid_id"])
    return rounded(v.select("grid_id", "date", *[I.severity_score_col(F.lead("vhi", h).over(w)).alias(
        f"target_severity_score_h{h}") for h in (1, 2, 3, 6)]))


@register("idx_source_choice", S.with_(panel=S.PANEL) + """,
ex AS (SELECT grid_id, CAST(date AS VARCHAR) AS date, CASE WHEN CAST(grid_id AS INTEGER) % 10 = 3 THEN NULL ELSE ndvi END AS modis_ndvi FROM panel),
pick AS (SELECT CASE WHEN count(modis_ndvi) > (SELECT count(ndvi) FROM panel) * 0.5 THEN 'modis_ndvi' ELSE 'ndvi' END AS src FROM ex),
src AS (SELECT p.grid_id, p.date, ex.modis_ndvi AS ndvi, p.lst FROM panel p JOIN ex ON p.grid_id = ex.grid_id AND CAST(p.date AS VARCHAR) = ex.date),
""" + f"""v AS (SELECT *, {S.scaled('ndvi', 'grid_id')} AS vci, {S.scaled('lst', 'grid_id', invert=True)} AS tci FROM src)
SELECT grid_id, CAST(date AS VARCHAR) AS date, (SELECT src FROM pick) AS ndvi_source, 'lst' AS lst_source,
  {S.r6('vci')} AS vci, {S.r6('tci')} AS tci, {S.r6(S.clip('0.5 * vci + 0.5 * tci', 0.0, 1.0))} AS vhi FROM v""")
def idx_source_choice(spark, d):
    """NDVI is covered well enough by its second source, LST (a tenth of the cells) is not; VCI, TCI and VHI use the choice."""
    gid = F.col("grid_id").cast("int")
    p = FX.panel(spark, d)
    ex = p.withColumns({"modis_ndvi": F.when(gid % 10 != 3, F.col("ndvi")), "modis_lst": F.when(gid % 10 == 3, F.col("lst"))})
    nd, ls = I.choose_source(ex, "ndvi", "modis_ndvi"), I.choose_source(ex, "lst", "modis_lst")
    chosen = ex.select("grid_id", "date", F.col(nd).alias("ndvi"), F.col(ls).alias("lst"))
    v = I.add_vci_tci_vhi(chosen).select("grid_id", "date", F.lit(nd).alias("ndvi_source"), F.lit(ls).alias("lst_source"), "vci", "tci", "vhi")
    return rounded(v)
