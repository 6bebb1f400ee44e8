"""DuckDB text for the oracle side: fixture CTEs and scalar helpers mirroring
``verdure.functions.scalar``."""
from __future__ import annotations

import math

from ..functions import constants as K

PANEL = """SELECT CAST(l_suppkey AS VARCHAR) AS grid_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (50 * COUNT(*)) AS ndvi,
  20 + CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (350000 * COUNT(*)) AS lst,
  CAST(SUM(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 27.5 / COUNT(*) AS rainfall
FROM lineitem GROUP BY 1, 2"""

DISTRICT = """SELECT r_name AS state, n_name AS district, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (50 * COUNT(*)) AS ndvi,
  20 + CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (350000 * COUNT(*)) AS lst,
  CAST(SUM(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 27.5 / COUNT(*) AS rainfall
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""

HISTORY = """SELECT event_id AS id, concat('S', CAST(user_id % 5 AS VARCHAR)) AS state,
  concat('D', CAST(user_id AS VARCHAR)) AS district, least(100.0, value) AS risk_score, ts AS created_at
FROM events"""

LOGS = """SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'user_signup' WHEN 'click' THEN 'user_login' ELSE event_type END AS event,
  CASE WHEN event_type = 'signup' THEN 'User registered: user' || user_id || '@example.org'
    WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'Login without a user'
    WHEN event_type = 'click' THEN 'User logged in: user' || user_id || '@example.org'
    ELSE concat('User ', CAST(user_id AS VARCHAR), ' ', event_type) END AS message, ts AS created_at FROM events"""

USERS = """SELECT user_id AS id, concat('user', CAST(user_id AS VARCHAR), '@example.org') AS email,
  CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'analyst' END AS role,
  max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) = 1 AS is_active, min(ts) AS created_at
FROM events GROUP BY user_id"""


def r6(x: str) -> str:
    return f"(round(({x}) * 1000000) / 1000000 + 0.0)"


def bround(x: str, digits: int) -> str:
    """Python ``round`` / Spark ``bround``: half-even on the exact binary value
    (a DECIMAL(38,18) image of the double), back to DOUBLE."""
    return f"CAST(round_even(CAST(({x}) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def clip(x: str, lo=None, hi=None) -> str:
    if lo is not None and hi is not None:
        return f"(CASE WHEN ({x}) < {lo!r} THEN {lo!r} WHEN ({x}) > {hi!r} THEN {hi!r} ELSE ({x}) END)"
    if lo is not None:
        return f"(CASE WHEN ({x}) < {lo!r} THEN {lo!r} ELSE ({x}) END)"
    return f"(CASE WHEN ({x}) > {hi!r} THEN {hi!r} ELSE ({x}) END)"


def sev_class(x: str) -> str:
    t = K.VHI_THRESHOLDS
    return (f"CAST(CASE WHEN ({x}) < {t[0]} THEN 4 WHEN ({x}) < {t[1]} THEN 3 WHEN ({x}) < {t[2]} THEN 2 "
            f"WHEN ({x}) < {t[3]} THEN 1 ELSE 0 END AS INTEGER)")


def _ladder(x: str, th, ascending: bool) -> str:
    L = K.SEVERITY_LABELS
    op = "<" if ascending else ">="
    parts = " ".join(f"WHEN ({x}) {op} {t!r} THEN '{lab}'" for t, lab in zip(th, L[:4]))
    return f"(CASE {parts} ELSE '{L[4]}' END)"


def sev_label(x: str) -> str:
    return _ladder(x, K.VHI_THRESHOLDS, True)


def sev_label100(x: str) -> str:
    return _ladder(x, K.VHI100_THRESHOLDS, True)


def sev_label_risk(x: str) -> str:
    return _ladder(x, K.RISK_THRESHOLDS, False)


def md5_bucket(expr: str, seed: str = "") -> str:
    return f"CAST(('0x' || substr(md5('{seed}' || CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


TWO_PI = repr(2 * math.pi)


def scaled(x: str, part: str, invert=False, scale=1.0) -> str:
    lo = f"quantile_cont({x}, 0.05) OVER (PARTITION BY {part})"
    hi = f"quantile_cont({x}, 0.95) OVER (PARTITION BY {part})"
    v = clip(f"({x} - {lo}) / greatest({hi} - {lo}, 1e-6) * {scale!r}", 0.0, scale)
    return f"({scale!r} - {v})" if invert else v


def with_(**ctes) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"
