"""Registered queries: temporal (window) features and gap handling."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.wavelet import approx_sql
from ..operators import conform as C
from ..operators import temporal as T
from ..sources import fixtures as FX
from . import sqlfrag as S
from .q_indices import VHI_SQL_CTE, vhi_panel
from .registry import register, rounded

W = "OVER (PARTITION BY grid_id ORDER BY date)"
D = "CAST(date AS VARCHAR) AS date"


def rows(a, b):
    def side(x):
        if x == 0:
            return "CURRENT ROW"
        return f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"OVER (PARTITION BY grid_id ORDER BY date ROWS BETWEEN {side(a)} AND {side(b)})"


def _sel(cols):
    return ", ".join(f"{S.r6(c)} AS {c}" for c in cols)


LAG_SIG, LAGS = ["ndvi", "rainfall", "vhi"], [1, 2, 3, 6]


@register("win_lag", VHI_SQL_CTE + f"""SELECT grid_id, {D}, """
          + ", ".join(f"{S.r6(f'lag({c}, {k}) {W}')} AS {c}_lag_{k}" for c in LAG_SIG for k in LAGS) + " FROM vhi")
def win_lag(spark, d):
    v = vhi_panel(spark, d)
    return rounded(v.select("grid_id", "date", *[e.alias(k) for k, e in T.lag_exprs(LAG_SIG, LAGS).items()]))


MONTH_NO = "(year(date) * 12 + month(date))"


@register("win_lag_calendar", VHI_SQL_CTE + f""", g AS (SELECT * FROM vhi WHERE (CAST(grid_id AS INTEGER) + year(date) * 12 + month(date)) % 9 <> 0)
SELECT grid_id, {D}, """ + ", ".join(f"{S.r6(f'max({c}) OVER (PARTITION BY grid_id ORDER BY {MONTH_NO} RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)')} AS {c}_lag_{k}"
                                     for c in LAG_SIG for k in LAGS) + " FROM g")
def win_lag_calendar(spark, d):
    """Lags by calendar month over a panel with missing months."""
    v = vhi_panel(spark, d)
    v = v.where((F.col("grid_id").cast("int") + F.year("date") * 12 + F.month("date")) % 9 != 0)
    return rounded(v.select("grid_id", "date", *[e.alias(k) for k, e in T.lag_exprs(LAG_SIG, LAGS, calendar=True).items()]))


RM_SIG = ["ndvi", "lst", "rainfall", "vhi"]


@register("win_roll_mean_past", VHI_SQL_CTE + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(f'avg({c}) {rows(-k, -1)}')} AS {c}_roll_{k}" for c in RM_SIG for k in (3, 6, 12))
          + " FROM vhi")
def win_roll_mean_past(spark, d):
    v = vhi_panel(spark, d)
    return rounded(v.select("grid_id", "date", *[e.alias(k) for k, e in T.roll_mean_past_exprs(RM_SIG, (3, 6, 12)).items()]))


@register("win_roll_mean_incl", S.with_(panel=S.PANEL) + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(f'avg({c}) {rows(-2, 0)}')} AS {c}_roll_3" for c in ("ndvi", "rainfall", "lst"))
          + " FROM panel")
def win_roll_mean_incl(spark, d):
    p = FX.panel(spark, d)
    return rounded(p.select("grid_id", "date", *[e.alias(k) for k, e in T.roll_mean_incl_exprs(["ndvi", "rainfall", "lst"], 3).items()]))


@register("win_roll_std_past", VHI_SQL_CTE + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(f'stddev_samp({c}) {rows(-k, -1)}')} AS {c}_std_{k}" for c in ("vhi", "ndvi") for k in (3, 6, 12))
          + " FROM vhi")
def win_roll_std_past(spark, d):
    v = vhi_panel(spark, d)
    return rounded(v.select("grid_id", "date", *[e.alias(k) for k, e in T.roll_std_past_exprs(["vhi", "ndvi"], (3, 6, 12)).items()]))


@register("win_roll_sum", S.with_(panel=S.PANEL) + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(f'sum(rainfall) {rows(-(k - 1), 0)}')} AS rainfall_sum_{k}" for k in (1, 3, 6, 12))
          + " FROM panel")
def win_roll_sum(spark, d):
    p = FX.panel(spark, d)
    return rounded(p.select("grid_id", "date", *[e.alias(k) for k, e in T.roll_sum_exprs(["rainfall"], (1, 3, 6, 12)).items()]))


WV_SIG = ["vhi", "ndvi", "rainfall"]


def _wavelet_sql():
    s1 = ", ".join(f"lag({c}, 1) {W} AS s1_{c}" for c in WV_SIG)
    s2 = ", ".join(
        f"coalesce(last_value(s1_{c} IGNORE NULLS) {rows(-10**9, 0).replace('1000000000 PRECEDING', 'UNBOUNDED PRECEDING')}, "
        f"first_value(s1_{c} IGNORE NULLS) {rows(0, 10**9).replace('1000000000 FOLLOWING', 'UNBOUNDED FOLLOWING')}) AS s_{c}"
        for c in WV_SIG)
    n = f"least(row_number() {W}, 12)"
    s3 = [f"{n} AS n"]
    for c in WV_SIG:
        s3.append(f"s_{c}")
        s3 += [f"lag(s_{c}, {k}) {W} AS h{k}_{c}" for k in range(1, 12)]
    out = []
    for c in WV_SIG:
        hist = [f"s_{c}"] + [f"h{k}_{c}" for k in range(1, 12)]
        ap = approx_sql(hist, "n")
        out.append(f"{S.r6(ap)} AS {c}_wavelet_approx, {S.r6(f's_{c} - ({ap})')} AS {c}_wavelet_detail")
    return (VHI_SQL_CTE + f""", w1 AS (SELECT grid_id, date, {s1} FROM vhi),
w2 AS (SELECT grid_id, date, {s2} FROM w1),
w3 AS (SELECT grid_id, date, {', '.join(s3)} FROM w2)
SELECT grid_id, {D}, {', '.join(out)} FROM w3""")


@register("win_wavelet_causal", _wavelet_sql())
def win_wavelet_causal(spark, d):
    v = vhi_panel(spark, d).select("grid_id", "date", *WV_SIG)
    out = T.add_wavelet_causal(v, WV_SIG)
    return rounded(out.select("grid_id", "date", *[f"{c}_wavelet_{k}" for c in WV_SIG for k in ("approx", "detail")]))


@register("win_target_variants", VHI_SQL_CTE + f""", t AS (
  SELECT grid_id, date, lag(vhi, 1) {W} AS vhi_lag_1, avg(vhi) {rows(-3, -1)} AS vhi_smoothed_past FROM vhi),
mm AS (SELECT month(date) AS m, avg(vhi_lag_1) AS mm FROM t GROUP BY 1)
SELECT grid_id, {D}, {S.r6('vhi_smoothed_past')} AS vhi_smoothed_past,
  {S.r6('coalesce(vhi_lag_1 - vhi_smoothed_past, 0.0)')} AS vhi_residual_past,
  {S.r6('coalesce(vhi_lag_1 - mm, 0.0)')} AS vhi_anomaly_past
FROM t LEFT JOIN mm ON month(t.date) = mm.m""")
def win_target_variants(spark, d):
    v = T.target_variants(vhi_panel(spark, d))
    return rounded(v.select("grid_id", "date", "vhi_smoothed_past", "vhi_residual_past", "vhi_anomaly_past"))


@register("win_lead_target", VHI_SQL_CTE + f"SELECT grid_id, {D}, "
          + ", ".join(f"{S.r6(f'lead(vhi, {h}) {W}')} AS target_vhi_h{h}" for h in (1, 2, 3, 6)) + " FROM vhi")
def win_lead_target(spark, d):
    v = vhi_panel(spark, d)
    return rounded(v.select("grid_id", "date", *[e.alias(k) for k, e in T.lead_exprs("vhi", (1, 2, 3, 6)).items()]))


@register("win_persistence_target", VHI_SQL_CTE + f"""
SELECT grid_id, {D}, {S.r6(f'coalesce(lead(vhi, 1) {W}, vhi)')} AS target_vhi_next FROM vhi""")
def win_persistence_target(spark, d):
    v = vhi_panel(spark, d)
    w = T.order_window(["grid_id"])
    return rounded(v.select("grid_id", "date", F.coalesce(F.lead("vhi", 1).over(w), F.col("vhi")).alias("target_vhi_next")))


@register("win_rank_topk_latest", VHI_SQL_CTE + f"""
SELECT grid_id, CAST(max(date) AS VARCHAR) AS date, {S.r6('arg_max(vhi, date)')} AS vhi, {S.r6('arg_max(ndvi, date)')} AS ndvi
FROM vhi GROUP BY grid_id""")
def win_rank_topk_latest(spark, d):
    v = vhi_panel(spark, d).select("grid_id", "date", "vhi", "ndvi")
    return rounded(T.latest_per_key(v))


@register("win_downsample_even", S.with_(panel=S.PANEL) + f""", q AS (
  SELECT grid_id, date, ndvi, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY grid_id) AS n FROM panel)
SELECT grid_id, {D}, {S.r6('ndvi')} AS ndvi FROM q
WHERE n <= 12 OR floor(ceil(pos * 11 / greatest(n - 1, 1)) * (n - 1) / 11) = pos""")
def win_downsample_even(spark, d):
    p = FX.panel(spark, d).select("grid_id", "date", "ndvi")
    return rounded(T.downsample_even(p, n_out=12))


@register("prj_calendar", S.with_(panel=S.PANEL) + f""", c AS (SELECT grid_id, date, CAST(month(date) AS INTEGER) AS month,
  CAST(floor((month(date) % 12) / 3) AS INTEGER) AS season FROM panel)
SELECT grid_id, {D}, month, {S.r6(f'sin({S.TWO_PI} * month / 12)')} AS month_sin, {S.r6(f'cos({S.TWO_PI} * month / 12)')} AS month_cos,
  season, {S.r6(f'sin({S.TWO_PI} * season / 4)')} AS season_sin, {S.r6(f'cos({S.TWO_PI} * season / 4)')} AS season_cos FROM c""")
def prj_calendar(spark, d):
    p = C.calendar(FX.panel(spark, d))
    return rounded(p.select("grid_id", "date", "month", "month_sin", "month_cos", "season", "season_sin", "season_cos"))


# ---- gap handling on the gappy panel ---------------------------------------------------------
GAPPY = f"SELECT grid_id, date, CASE WHEN (CAST(grid_id AS INTEGER) + month(date)) % 7 = 0 THEN NULL ELSE ndvi END AS ndvi, lst, rainfall FROM panel"
GAPPY_CTE = S.with_(panel=S.PANEL, gappy=GAPPY)
UP = rows(-10**9, 0).replace("1000000000 PRECEDING", "UNBOUNDED PRECEDING")
AHEAD = rows(0, 10**9).replace("1000000000 FOLLOWING", "UNBOUNDED FOLLOWING")


@register("dq_ffill_bfill", GAPPY_CTE + f"""
SELECT grid_id, {D}, {S.r6(f'coalesce(last_value(ndvi IGNORE NULLS) {UP}, first_value(ndvi IGNORE NULLS) {AHEAD})')} AS ndvi FROM gappy""")
def dq_ffill_bfill(spark, d):
    g = FX.panel_gappy(FX.panel(spark, d)).select("grid_id", "date", "ndvi")
    return rounded(T.ffill_bfill(g, ["ndvi"]))


@register("dq_interpolate", GAPPY_CTE + f""", q AS (SELECT grid_id, date, ndvi, row_number() {W} AS pos FROM gappy),
b AS (SELECT *, last_value(CASE WHEN ndvi IS NOT NULL THEN pos END IGNORE NULLS) {UP} AS pp,
  last_value(ndvi IGNORE NULLS) {UP} AS pv,
  first_value(CASE WHEN ndvi IS NOT NULL THEN pos END IGNORE NULLS) {AHEAD} AS np,
  first_value(ndvi IGNORE NULLS) {AHEAD} AS nv FROM q)
SELECT grid_id, {D}, {S.r6('CASE WHEN ndvi IS NOT NULL THEN ndvi WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * ((pos - pp) / (np - pp)) END')} AS ndvi FROM b""")
def dq_interpolate(spark, d):
    g = FX.panel_gappy(FX.panel(spark, d)).select("grid_id", "date", "ndvi")
    return rounded(T.interpolate(g, ["ndvi"]))



def _wavelet_full_sql():
    """Periodised db4 low band in SQL: analysis a[k] = sum_j h_j x[(4+2k-j) mod N],
    synthesis r[p] = sum_{(4+2k-j) mod N = p} h_j a[k]; odd lengths padded with the
    last sample, reconstructions trimmed; level 2 from 28 samples."""
    from ..functions.constants import DB4_DEC_LO
    taps = ", ".join(f"({j}, {t!r})" for j, t in enumerate(DB4_DEC_LO))
    sig = ["ndvi", "rainfall", "lst"]
    long = " UNION ALL ".join(f"SELECT grid_id, date, '{c}' AS sig, {c} AS x FROM vhi" for c in sig)

    def analysis(src, n_col, out):
        # src(grid_id, sig, pos, v, N): N = padded length; returns out(grid_id, sig, k, a, N)
        return (f"SELECT s.grid_id, s.sig, k.k, sum(t.tap * s.v) AS a, s.N FROM "
                f"(SELECT DISTINCT grid_id, sig, N FROM {src}) g, LATERAL (SELECT unnest(range(0, g.N // 2)) AS k) k, taps t, {src} s "
                f"WHERE s.grid_id = g.grid_id AND s.sig = g.sig AND s.pos = ((4 + 2 * k.k - t.j) % g.N + g.N) % g.N "
                f"GROUP BY s.grid_id, s.sig, k.k, s.N")

    def synthesis(coef, out_len):
        # coef(grid_id, sig, k, a, N) -> rows (grid_id, sig, pos, v) for pos < out_len column
        return (f"SELECT c.grid_id, c.sig, ((4 + 2 * c.k - t.j) % c.N + c.N) % c.N AS pos, sum(t.tap * c.a) AS v "
                f"FROM {coef} c, taps t GROUP BY 1, 2, 3")
    ctes = f""", taps(j, tap) AS (VALUES {taps}),
lg AS ({long}),
b AS (SELECT grid_id, date, sig, x, CAST(row_number() OVER (PARTITION BY grid_id, sig ORDER BY date) - 1 AS BIGINT) AS pos,
        count(*) OVER (PARTITION BY grid_id, sig) AS n FROM lg),
s1 AS (SELECT grid_id, sig, pos, x AS v, n + n % 2 AS N, n FROM b WHERE n >= 4 UNION ALL
       SELECT grid_id, sig, n AS pos, x AS v, n + 1 AS N, n FROM b WHERE n >= 4 AND n % 2 = 1 AND pos = n - 1),
a1 AS ({analysis('s1', 'N', 'a1')}),
m1 AS (SELECT grid_id, sig, count(*) AS M FROM a1 GROUP BY 1, 2),
s2 AS (SELECT a1.grid_id, a1.sig, a1.k AS pos, a1.a AS v, m1.M + m1.M % 2 AS N FROM a1 JOIN m1 USING (grid_id, sig)
         JOIN (SELECT DISTINCT grid_id, sig, n FROM b) nn USING (grid_id, sig) WHERE nn.n >= 28 UNION ALL
       SELECT a1.grid_id, a1.sig, m1.M AS pos, a1.a AS v, m1.M + 1 AS N FROM a1 JOIN m1 USING (grid_id, sig)
         JOIN (SELECT DISTINCT grid_id, sig, n FROM b) nn USING (grid_id, sig) WHERE nn.n >= 28 AND m1.M % 2 = 1 AND a1.k = m1.M - 1),
a2 AS ({analysis('s2', 'N', 'a2')}),
r2 AS ({synthesis('a2', 'M')}),
c1 AS (SELECT r2.grid_id, r2.sig, r2.pos AS k, r2.v AS a, nn.n + nn.n % 2 AS N FROM r2 JOIN m1 USING (grid_id, sig)
         JOIN (SELECT DISTINCT grid_id, sig, n FROM b) nn USING (grid_id, sig) WHERE r2.pos < m1.M UNION ALL
       SELECT a1.grid_id, a1.sig, a1.k, a1.a, a1.N FROM a1 JOIN (SELECT DISTINCT grid_id, sig, n FROM b) nn USING (grid_id, sig)
         WHERE nn.n < 28),
r1 AS ({synthesis('c1', 'n')}),
ap AS (SELECT b.grid_id, b.date, b.sig, b.x, CASE WHEN b.n < 4 THEN b.x ELSE r1.v END AS approx
       FROM b LEFT JOIN r1 ON b.grid_id = r1.grid_id AND b.sig = r1.sig AND b.pos = r1.pos)
SELECT grid_id, CAST(date AS VARCHAR) AS date, """
    outs = []
    for c in sig:
        outs.append(f"{S.r6(f"max(CASE WHEN sig = '{c}' THEN approx END)")} AS {c}_wavelet_approx")
        outs.append(f"{S.r6(f"max(CASE WHEN sig = '{c}' THEN x - approx END)")} AS {c}_wavelet_detail")
    return VHI_SQL_CTE + ctes + ", ".join(outs) + " FROM ap GROUP BY grid_id, date"


@register("win_wavelet_full", _wavelet_full_sql())
def win_wavelet_full(spark, d):
    v = vhi_panel(spark, d).select("grid_id", "date", "ndvi", "rainfall", "lst")
    return rounded(T.wavelet_full(v, ["ndvi", "rainfall", "lst"]))
