"""Data-quality operators: global fills, winsorising, profiles, export validation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sentinel_to_null


def global_quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True):
    """Every requested quantile of every column over all rows, as literals per
    column (``q[c][i]``).  Exact: distributed selection (bounded state per task,
    see ``quantiles.py``); ``exact=False``: one pass of a bounded-memory sketch."""
    from .quantiles import exact_quantiles
    if exact:
        vals = exact_quantiles(df, cols, probs)
    else:
        arr = F.array(*[F.lit(p) for p in probs])
        row = df.agg(*[F.percentile_approx(c, arr, 100000).alias(c) for c in cols]).first()
        vals = {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    return {c: [F.lit(v).cast("double") for v in vs] for c, vs in vals.items()}


def median_fill(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Remaining NULLs -> column median over all rows."""
    q = global_quantiles(df, cols, [0.5], exact)
    return df.withColumns({c: F.coalesce(F.col(c), q[c][0]) for c in cols})


def iqr_winsorize(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Clip to [q1 - 1.5 IQR, q3 + 1.5 IQR] when IQR > 0."""
    q = global_quantiles(df, cols, [0.25, 0.75], exact)
    out = {}
    for c in cols:
        q1, q3 = q[c][0], q[c][1]
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = F.col(c)
        out[c] = F.when((iqr > 0) & (x < lo), lo).when((iqr > 0) & (x > hi), hi).otherwise(x)
    return df.withColumns(out)


def profile(df: DataFrame, key="grid_id", date_col="date") -> DataFrame:
    """One row: rows, distinct cells, date range, NULL count per column (one pass)."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns if c not in (key, date_col)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_cells"),
                  F.min(date_col).alias("date_min"), F.max(date_col).alias("date_max"), *nulls)


def null_counts_tidy(df: DataFrame, top: int = 30) -> DataFrame:
    """(column, n_null) sorted desc, first ``top`` (report view; the limit is the feature)."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null").orderBy(F.desc("n_null"), "column").limit(top)


def screen_correlation(df: DataFrame, candidates: list[str], target: str, min_pairs: int = 30) -> DataFrame:
    """abs(corr(candidate, target)) with > min_pairs complete pairs, sorted desc."""
    aggs = []
    for c in candidates:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [F.corr(c, target).alias(f"r_{c}"), F.count_if(both).alias(f"n_{c}")]
    wide = df.agg(*aggs)
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"r_{c}").alias("r"),
                                                   F.col(f"n_{c}").alias("n")) for c in candidates])))
    return (rows.where(F.col("n") > min_pairs)
                .select("variable", F.abs("r").alias("score")))


def parse_export_month(file_col, prefix: str):
    pat = "^" + prefix + r"(\d{4})_(\d{2})(?:\(\d+\))?\.csv$"
    y = F.regexp_extract(file_col, pat, 1)
    m = F.regexp_extract(file_col, pat, 2)
    return F.when(y == "", F.lit(None)).otherwise(F.concat(y, F.lit("_"), m))


def export_inspect(rows: DataFrame, value_cols: list[str], prefix: str, max_null_pct: float,
                   file_col="file") -> DataFrame:
    """Per file: month, row count, mean NULL share (%) over value columns after
    sentinel masking, status valid / too_null."""
    nulls = sum((sentinel_to_null(c).isNull().cast("int") for c in value_cols), F.lit(0))
    per = rows.groupBy(file_col).agg(F.count(F.lit(1)).alias("row_count"),
                                     F.sum(nulls).alias("__nulls"))
    pct = F.bround(F.col("__nulls") / (F.col("row_count") * len(value_cols)) * 100, 2)
    return per.select(file_col, parse_export_month(F.col(file_col), prefix).alias("month"), "row_count",
                      pct.alias("null_pct"),
                      F.when(pct <= max_null_pct, "valid").otherwise("too_null").alias("status"))


def inspect_files(headers: DataFrame, rows: DataFrame, required: list[str], value_cols: list[str], prefix: str,
                  max_null_pct: float) -> DataFrame:
    """Per export file (``headers``: file, header; ``rows``: file and the columns by name): month, row count, NULL share
    and status: ``invalid`` (a required column is not in its header), ``empty`` (no rows), ``too_null`` or ``valid``.
    Only readable files have a NULL share."""
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    ok = F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0
    counts = export_inspect(rows, value_cols, prefix, max_null_pct).select("file", "row_count", "null_pct", F.col("status").alias("__s"))
    j = headers.select("file", ok.alias("__ok")).join(counts, "file", "left")
    n = F.coalesce("row_count", F.lit(0).cast("long"))
    return j.select(
        "file", parse_export_month(F.col("file"), prefix).alias("month"), n.alias("row_count"),
        F.when(F.col("__ok"), F.col("null_pct")).alias("null_pct"),
        F.when(~F.col("__ok"), "invalid").when(n == 0, "empty").otherwise(F.col("__s")).alias("status"))


def month_coverage(expected_months: DataFrame, inspected: DataFrame, max_null_pct: float) -> DataFrame:
    """Per month (expected or exported): number of files, best file by (valid, rows,
    name) and flags missing / duplicate / too_null."""
    best = inspected.where(F.col("month").isNotNull()).groupBy("month").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.max_by(F.struct("file", "null_pct", "status"),
                 F.struct((F.col("status") == "valid").cast("int"), F.col("row_count"), F.col("file"))).alias("b"))
    j = expected_months.withColumn("expected", F.lit(True)).join(best, "month", "full")
    return j.select(
        "month", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("b.file").alias("best_file"),
        F.col("n_files").isNull().alias("is_missing"),
        F.coalesce(F.col("n_files") > 1, F.lit(False)).alias("is_duplicate"),
        F.coalesce(F.col("expected") & (F.col("b.null_pct") > max_null_pct), F.lit(False)).alias("is_too_null"))


def broken_months(coverage: DataFrame, inspected: DataFrame) -> DataFrame:
    """missing U invalid U too-null months, distinct."""
    bad_files = inspected.where((F.col("status") != "valid") & F.col("month").isNotNull()).select("month")
    flagged = coverage.where(F.col("is_missing") | F.col("is_too_null")).select("month")
    return flagged.unionByName(bad_files).distinct()

