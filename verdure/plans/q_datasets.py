"""Registered queries: supervised sequences, sampling and evaluation splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as DS
from ..operators import indices as I
from ..operators.temporal import order_window
from ..sources import fixtures as FX
from . import sqlfrag as S
from .q_indices import VHI_SQL_CTE, vhi_panel
from .registry import register, rounded

D = "CAST(date AS VARCHAR) AS date"
W = "OVER (PARTITION BY grid_id ORDER BY date)"
SEQ_FEATS = ["ndvi", "lst", "rainfall"]
PANEL_CTE = S.with_(panel=S.PANEL)
DAYS = "date_diff('day', DATE '1970-01-01', date)"


def _seq_sql(length: int, exclude_current: bool):
    offs = range(length, 0, -1) if exclude_current else range(length - 1, -1, -1)
    arr = ", ".join(f"coalesce(lag({c}, {o}) {W}, 0.0)" if o else f"coalesce({c}, 0.0)"
                    for o in offs for c in SEQ_FEATS)
    need = length + 1 if exclude_current else length
    n = length * len(SEQ_FEATS)
    return VHI_SQL_CTE + f""", s AS (
  SELECT grid_id, date, lead(vhi, 1) {W} AS label, [{arr}] AS arr, row_number() {W} AS rn FROM vhi)
SELECT grid_id, {D}, {S.r6('label')} AS label, unnest(generate_series(0, {n - 1})) AS pos, {S.r6('unnest(arr)')} AS value
FROM s WHERE rn >= {need}"""


def _seq(spark, d, length, exclude):
    v = I.add_vci_tci_vhi(FX.spread(FX.panel(spark, d), d))
    v = v.withColumn("target_vhi_h1", F.lead("vhi", 1).over(order_window(["grid_id"])))
    s = DS.supervised_sequences(v, SEQ_FEATS, length, exclude_current=exclude)
    out = s.select("grid_id", "date", "label", F.posexplode("features").alias("pos", "value"), *[c for c in s.columns if c == "length"])
    return rounded(out.withColumn("pos", F.col("pos").cast("bigint")))


LENGTHS = (3, 6, 12)


@register("ds_supervised_seq", " UNION ALL ".join(f"SELECT {n} AS length, * FROM ({_seq_sql(n, False)})" for n in LENGTHS))
def ds_supervised_seq(spark, d):
    """Windows of every length from one pass over the panel, an entry a row."""
    return _seq(spark, d, LENGTHS, False)


@register("ds_sequence_excl", _seq_sql(3, True))
def ds_sequence_excl(spark, d):
    return _seq(spark, d, 3, True)


@register("ds_drop_incomplete", VHI_SQL_CTE + f""", f AS (
  SELECT grid_id, date, lag(vhi, 6) {W} AS vhi_lag_6, lead(vhi, 1) {W} AS target_vhi_h1 FROM vhi)
SELECT grid_id, {D} FROM f WHERE vhi_lag_6 IS NOT NULL AND target_vhi_h1 IS NOT NULL""")
def ds_drop_incomplete(spark, d):
    w = order_window(["grid_id"])
    v = vhi_panel(spark, d).select("grid_id", "date", F.lag("vhi", 6).over(w).alias("vhi_lag_6"),
                                   F.lead("vhi", 1).over(w).alias("target_vhi_h1"))
    return rounded(DS.drop_incomplete(v, ["vhi_lag_6", "target_vhi_h1"]).select("grid_id", "date"))


@register("ds_cap_rows", PANEL_CTE + f"""
SELECT grid_id, {D}, {S.r6('ndvi')} AS ndvi FROM panel ORDER BY md5('42' || grid_id || CAST(date AS VARCHAR)), grid_id, panel.date LIMIT 500""")
def ds_cap_rows(spark, d):
    p = FX.panel(spark, d).select("grid_id", "date", "ndvi")
    return rounded(DS.cap_rows(p, 500))


@register("ds_cap_by_grid", PANEL_CTE + f""", per AS (SELECT grid_id, count(DISTINCT date) AS nd FROM panel GROUP BY grid_id),
k AS (SELECT greatest(8, CAST(trunc(2000 / greatest(1, CAST(trunc(quantile_cont(nd, 0.5)) AS BIGINT))) AS BIGINT)) AS k FROM per),
cells AS (SELECT grid_id FROM per QUALIFY row_number() OVER (ORDER BY md5('42' || grid_id), grid_id) <= (SELECT k FROM k))
SELECT grid_id, {D} FROM panel WHERE grid_id IN (SELECT grid_id FROM cells)""")
def ds_cap_by_grid(spark, d):
    p = FX.panel(spark, d).select("grid_id", "date")
    return rounded(DS.cap_by_grid(p, 2000))


@register("split_chrono", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE WHEN {DAYS} <= (SELECT quantile_cont({DAYS}, 0.8) FROM panel) THEN 'train' ELSE 'test' END AS split FROM panel""")
def split_chrono(spark, d):
    return rounded(DS.split_chrono(FX.panel(spark, d).select("grid_id", "date")))


@register("split_valid_quantile", PANEL_CTE + f""", tr AS (
  SELECT grid_id, date FROM panel WHERE {DAYS} <= (SELECT quantile_cont({DAYS}, 0.8) FROM panel))
SELECT grid_id, {D}, CASE WHEN {DAYS} <= (SELECT quantile_cont({DAYS}, 0.85) FROM tr) THEN 'fit' ELSE 'valid' END AS split FROM tr""")
def split_valid_quantile(spark, d):
    c = DS.split_chrono(FX.panel(spark, d).select("grid_id", "date"))
    tr = c.where(F.col("split") == "train").drop("split")
    return rounded(DS.split_valid_quantile(tr))


@register("split_valid_rows", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE WHEN row_number() OVER (ORDER BY date, grid_id) <= floor((SELECT count(*) FROM panel) * CAST(0.8 AS DOUBLE))
  THEN 'fit' ELSE 'valid' END AS split FROM panel""")
def split_valid_rows(spark, d):
    return rounded(DS.split_valid_rows(FX.panel(spark, d).select("grid_id", "date")))


@register("split_random", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE WHEN CAST(('0x' || substr(md5('42' || grid_id || CAST(date AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 70
  THEN 'train' ELSE 'test' END AS split FROM panel""")
def split_random(spark, d):
    return rounded(DS.split_random(FX.panel(spark, d).select("grid_id", "date")))


@register("split_spatial", PANEL_CTE + f"""
SELECT grid_id, {D}, CASE WHEN {S.md5_bucket('grid_id', '41')} < {0.2 * DS.TWO32!r} THEN 'test' ELSE 'train' END AS split FROM panel""")
def split_spatial(spark, d):
    return rounded(DS.split_spatial(FX.panel(spark, d).select("grid_id", "date")))


DATE_IDX = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)"


@register("split_rolling_origin", S.with_(panel=S.PANEL, di=DATE_IDX) + f""", f AS (
  SELECT * FROM (VALUES (1, CAST(0.55 AS DOUBLE)), (2, CAST(0.65 AS DOUBLE)), (3, CAST(0.75 AS DOUBLE))) t(fold, frac)),
tg AS (SELECT date, fold, CASE WHEN idx <= floor(n * frac) THEN 'train' WHEN idx <= floor(n * frac) + 12 THEN 'test' END AS role
  FROM di, f)
SELECT p.grid_id, CAST(p.date AS VARCHAR) AS date, fold, role FROM panel p JOIN tg ON p.date = tg.date WHERE role IS NOT NULL""")
def split_rolling_origin(spark, d):
    return rounded(DS.rolling_origin_folds(FX.panel(spark, d).select("grid_id", "date")))


@register("split_time_series_cv", S.with_(panel=S.PANEL, di=DATE_IDX) + f""", kk AS (
  SELECT least(5, greatest(2, n // 18)) AS k, n // (least(5, greatest(2, n // 18)) + 1) AS size, n FROM di LIMIT 1),
f AS (SELECT CAST(i AS INTEGER) AS fold, n - (k - i + 1) * size AS test_start, size FROM kk, range(1, 6) r(i) WHERE i <= k),
tg AS (SELECT date, fold, CASE WHEN idx < test_start THEN 'train' WHEN idx < test_start + size THEN 'test' END AS role FROM di, f)
SELECT p.grid_id, CAST(p.date AS VARCHAR) AS date, fold, role FROM panel p JOIN tg ON p.date = tg.date WHERE role IS NOT NULL""")
def split_time_series_cv(spark, d):
    return rounded(DS.time_series_cv_folds(FX.panel(spark, d).select("grid_id", "date")))


def _sizes_sql(tagged):
    return f"SELECT fold, role, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS n_rows FROM ({tagged}) GROUP BY fold, role"


@register("split_rolling_origin_ranges", S.with_(panel=S.PANEL, di=DATE_IDX) + f""", f AS (
  SELECT * FROM (VALUES (1, CAST(0.55 AS DOUBLE)), (2, CAST(0.65 AS DOUBLE)), (3, CAST(0.75 AS DOUBLE))) t(fold, frac)),
tg AS (SELECT date, fold, CASE WHEN idx <= floor(n * frac) THEN 'train' WHEN idx <= floor(n * frac) + 12 THEN 'test' END AS role FROM di, f)
{_sizes_sql('SELECT p.date, fold, role FROM panel p JOIN tg ON p.date = tg.date WHERE role IS NOT NULL')}""")
def split_rolling_origin_ranges(spark, d):
    """Folds as nested date ranges, with the rows that each range selects."""
    p = FX.panel(spark, d).select("grid_id", "date")
    return rounded(DS.fold_sizes(p, DS.rolling_origin_ranges(p)))


@register("split_time_series_cv_ranges", S.with_(panel=S.PANEL, di=DATE_IDX) + f""", kk AS (
  SELECT least(5, greatest(2, n // 18)) AS k, n // (least(5, greatest(2, n // 18)) + 1) AS size, n FROM di LIMIT 1),
f AS (SELECT CAST(i AS INTEGER) AS fold, n - (k - i + 1) * size AS test_start, size FROM kk, range(1, 6) r(i) WHERE i <= k),
tg AS (SELECT date, fold, CASE WHEN idx < test_start THEN 'train' WHEN idx < test_start + size THEN 'test' END AS role FROM di, f)
{_sizes_sql('SELECT p.date, fold, role FROM panel p JOIN tg ON p.date = tg.date WHERE role IS NOT NULL')}""")
def split_time_series_cv_ranges(spark, d):
    p = FX.panel(spark, d).select("grid_id", "date")
    return rounded(DS.fold_sizes(p, DS.time_series_cv_ranges(p)))


@register("ds_same_month_target", VHI_SQL_CTE + f"""
SELECT grid_id, {D}, {S.r6('vhi')} AS label, {S.r6('ndvi')} AS ndvi, {S.r6('lst')} AS lst, {S.r6('rainfall')} AS rainfall FROM vhi""")
def ds_same_month_target(spark, d):
    v = vhi_panel(spark, d)
    out, feats = DS.same_month_target(v, ["ndvi", "lst", "rainfall", "vhi"])
    return rounded(out.select("grid_id", "date", "label", *feats))


def _std_sql():
    tr = f"(SELECT * FROM panel WHERE {DAYS} <= (SELECT quantile_cont({DAYS}, 0.8) FROM panel))"
    cols = []
    for c in SEQ_FEATS:
        m, s = f"(SELECT avg({c}) FROM {tr})", f"(SELECT stddev_pop({c}) FROM {tr})"
        cols.append(f"{S.r6(f'CASE WHEN {s} = 0 THEN 0.0 ELSE ({c} - {m}) / {s} END')} AS {c}")
    return PANEL_CTE + f"SELECT grid_id, {D}, {', '.join(cols)} FROM panel"


@register("ds_standardize", _std_sql())
def ds_standardize(spark, d):
    p = FX.panel(spark, d)
    train = DS.split_chrono(p).where(F.col("split") == "train")
    return rounded(DS.standardize(p, SEQ_FEATS, fit_on=train).select("grid_id", "date", *SEQ_FEATS))


def _robust_sql():
    cols = []
    for c in SEQ_FEATS:
        q = lambda x: f"(SELECT quantile_cont({c}, {x}) FROM panel)"
        iqr = f"({q(0.75)} - {q(0.25)})"
        cols.append(f"{S.r6(f'({c} - {q(0.5)}) / CASE WHEN {iqr} = 0 THEN 1.0 ELSE {iqr} END')} AS {c}")
    return PANEL_CTE + f"SELECT grid_id, {D}, {', '.join(cols)} FROM panel"


@register("ds_robust_scale", _robust_sql())
def ds_robust_scale(spark, d):
    p = FX.panel(spark, d)
    return rounded(DS.robust_scale(p, SEQ_FEATS).select("grid_id", "date", *SEQ_FEATS))
