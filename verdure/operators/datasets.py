"""Supervised datasets, sampling and evaluation splits.

Split boundaries are global scalars (a date quantile, a row count) computed as
scalar subqueries, so the big table is never cross-joined or funnelled through
one task; random and spatial splits are md5 hashes of the row key, which are
deterministic, engine independent and need no ranking at all.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import md5_bucket
from .temporal import order_window

TWO32 = float(2 ** 32)


def _day(date_col="date") -> Column:
    return F.unix_date(F.col(date_col))


def date_quantile_cut(df: DataFrame, q: float, date_col="date") -> Column:
    """Interpolated quantile of the row dates (pandas ``Series.quantile`` on dates),
    in days since epoch.  The exact percentile buffers one entry per distinct date,
    which is bounded by the calendar, not by the row count."""
    return df.agg(F.percentile(_day(date_col).cast("double"), F.lit(q))).scalar()


def date_cut_now(df: DataFrame, q: float, date_col="date") -> Column:
    """``date_quantile_cut`` found once, as a literal: for rows that many jobs read, each of which would run the subquery anew."""
    return F.lit(df.agg(F.percentile(_day(date_col).cast("double"), F.lit(q))).first()[0]).cast("double")


def split_chrono(df: DataFrame, q: float = 0.8, date_col="date", out="split", cut: Column | None = None) -> DataFrame:
    """train: date <= q-quantile of row dates; test: after.  ``cut``: that quantile, if it is known."""
    cut = date_quantile_cut(df, q, date_col) if cut is None else cut
    return df.withColumn(out, F.when(_day(date_col) <= cut, "train").otherwise("test"))


def split_valid_quantile(train: DataFrame, q: float = 0.85, date_col="date", out="split", cut: Column | None = None) -> DataFrame:
    """Second chronological cut inside the training rows: fit / valid.  ``cut`` as in ``split_chrono``."""
    cut = date_quantile_cut(train, q, date_col) if cut is None else cut
    return train.withColumn(out, F.when(_day(date_col) <= cut, "fit").otherwise("valid"))


def split_valid_rows(df: DataFrame, frac: float = 0.8, date_col="date", tie="grid_id", out="split") -> DataFrame:
    """First floor(frac*n) rows in (date, tie) order -> fit, rest -> valid (may cut a month).
    Per-date counts (one row per date) say which dates lie wholly on one side; only the one date that
    is cut has its ties ranked, by the distributed ``global_rank``."""
    from .joins import global_rank
    n = df.agg(F.count(F.lit(1))).first()[0]
    limit = int(n * frac)
    per_date = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("__c"))
    cum = per_date.select(date_col, "__c", F.coalesce(F.sum("__c").over(
        Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    edge = cum.where((F.col("__before") < limit) & (F.col("__before") + F.col("__c") > limit)).first()
    last = cum.where(F.col("__before") + F.col("__c") <= limit).agg(F.max(date_col)).first()[0]
    whole = F.col(date_col) <= F.lit(last) if last is not None else F.lit(False)
    if edge is None:
        return df.withColumn(out, F.when(whole, "fit").otherwise("valid"))
    at = F.col(date_col) == F.lit(edge[date_col])
    # ties are unique within a date (a cell has one row a month)
    ranks = global_rank(df.where(at), tie, out="__r").withColumnRenamed(tie, "__t")
    j = df.join(ranks, at & (F.col(tie) == F.col("__t")), "left")
    inside = at & (F.col("__r") < limit - edge["__before"])
    return j.withColumn(out, F.when(whole | inside, "fit").otherwise("valid")).drop("__r", "__t")


def split_random(df: DataFrame, test_pct: int = 30, keys=("grid_id", "date"), seed: str = "42",
                 out="split") -> DataFrame:
    b = md5_bucket(*keys, seed=seed) % 100
    return df.withColumn(out, F.when(b < 100 - test_pct, "train").otherwise("test"))


def split_spatial(df: DataFrame, holdout_frac: float = 0.2, key="grid_id", seed: str = "41",
                  out="split", exact_count: bool = False) -> DataFrame:
    """Hold out ~``holdout_frac`` of the cells (md5 of seed||cell below the fraction
    of the hash range).  Whole cells move together; no ranking, no join.
    ``exact_count=True`` holds out exactly max(1, floor(frac * n)) cells, the first
    in md5 order, ranked with the distributed ``global_rank`` (no single-task sort)."""
    b = md5_bucket(key, seed=seed)
    if not exact_count:
        return df.withColumn(out, F.when(b < F.lit(holdout_frac * TWO32), "test").otherwise("train"))
    from .joins import global_rank
    cells = df.select(key).distinct()
    order_key = F.concat(F.lpad(md5_bucket(key, seed=seed).cast("string"), 10, "0"), F.lit("|"), F.col(key))
    ranked = global_rank(cells.select(key, order_key.alias("__o")), "__o", out="__r")
    n = cells.agg(F.count(F.lit(1))).first()[0]
    k = max(1, int(n * holdout_frac))
    hold = ranked.where(F.col("__r") < k).select(F.element_at(F.split("__o", r"\|", 2), 2).alias(key))
    tagged = hold.withColumn(out, F.lit("test"))
    return df.join(tagged, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("train")))


def date_index(df: DataFrame, date_col="date") -> DataFrame:
    """Distinct dates with their 0-based position (table size = number of months)."""
    d = df.select(date_col).distinct()
    return d.withColumn("date_idx", F.row_number().over(Window.orderBy(date_col)) - 1)


def rolling_origin_folds(df: DataFrame, fractions=(0.55, 0.65, 0.75), horizon: int = 12,
                         date_col="date") -> DataFrame:
    """Rows tagged with (fold, role): origin = dates[int(n*f)], train = date <= origin,
    test = the next ``horizon`` dates.  A row may appear in several folds."""
    di = date_index(df, date_col)
    n = di.agg(F.count(F.lit(1))).scalar()
    folds = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(float(f)).alias("frac"))
                      for i, f in enumerate(fractions)])
    origin = F.floor(n * F.col("frac"))
    # each distinct date fans out to the (few) folds: a generator, not a join
    tagged = di.select(date_col, "date_idx", F.inline(folds)).select(
        date_col, "fold",
        F.when(F.col("date_idx") <= origin, "train")
         .when(F.col("date_idx") <= origin + horizon, "test").alias("role"))
    tagged = tagged.where(F.col("role").isNotNull())
    return df.join(tagged, date_col)


def time_series_cv_folds(df: DataFrame, date_col="date", divisor: int = 18, max_folds: int = 5) -> DataFrame:
    """Expanding-window folds on distinct dates (not rows):
    k = min(max_folds, max(2, n_dates // divisor)); test block = n // (k+1) dates."""
    di = date_index(df, date_col)
    n = int(di.agg(F.count(F.lit(1))).first()[0])  # fold count is a driver decision (one row)
    k = min(max_folds, max(2, n // divisor))
    size = n // (k + 1)
    folds = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(n - (k - i) * size).alias("test_start"))
                      for i in range(k)])
    tagged = di.select(date_col, "date_idx", F.inline(folds)).select(
        date_col, "fold",
        F.when(F.col("date_idx") < F.col("test_start"), "train")
         .when(F.col("date_idx") < F.col("test_start") + size, "test").alias("role"))
    return df.join(tagged.where(F.col("role").isNotNull()), date_col)


def rolling_origin_ranges(df: DataFrame, fractions=(0.55, 0.65, 0.75), horizon: int = 12, date_col="date") -> DataFrame:
    """The folds of ``rolling_origin_folds`` as a table: fold, train_start, train_end, test_start, test_end (dates, inclusive).
    A row of the data stays one row; a fit filters by its fold's dates (``fold_rows``)."""
    return _ranges(rolling_origin_folds(date_index(df, date_col).select(date_col), fractions, horizon, date_col), date_col)


def time_series_cv_ranges(df: DataFrame, date_col="date", divisor: int = 18, max_folds: int = 5) -> DataFrame:
    """The folds of ``time_series_cv_folds`` as a table of date ranges."""
    return _ranges(time_series_cv_folds(date_index(df, date_col).select(date_col), date_col, divisor, max_folds), date_col)


def _ranges(tagged: DataFrame, date_col: str) -> DataFrame:
    def of(role, how):
        return how(F.when(F.col("role") == role, F.col(date_col)))
    return tagged.groupBy("fold").agg(of("train", F.min).alias("train_start"), of("train", F.max).alias("train_end"),
                                      of("test", F.min).alias("test_start"), of("test", F.max).alias("test_end"))


def fold_rows(df: DataFrame, fold, role: str, date_col="date") -> DataFrame:
    """Rows of one role (train or test) of a fold, a row of a table of ranges: a filter on the date, which reaches the scan."""
    return df.where(F.col(date_col).between(F.lit(fold[f"{role}_start"]), F.lit(fold[f"{role}_end"])))


def fold_sizes(df: DataFrame, ranges: DataFrame, date_col="date") -> DataFrame:
    """fold, role, first_date, last_date, n_rows of every fold.  Rows are counted by date before they meet the folds, so only
    the calendar fans out to them."""
    per_date = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("__n"))
    long = ranges.select("fold", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("first_date"), F.col(f"{r}_end").alias("last_date"))
                                                    for r in ("train", "test")])))
    # a dated row of the fold table for each of its months: an equi-join with the calendar
    spread = long.withColumn(date_col, F.explode(F.expr("sequence(first_date, last_date, interval 1 month)")))
    return spread.join(per_date, date_col).groupBy("fold", "role", "first_date", "last_date").agg(F.sum("__n").alias("n_rows"))


def supervised_sequences(df: DataFrame, features: list[str], length: int | tuple[int, ...], label="target_vhi_h1",
                         keys=("grid_id",), exclude_current: bool = False) -> DataFrame:
    """Windows of ``length`` rows per key, flattened oldest -> newest into
    ``features`` (ARRAY<DOUBLE>); NULL/NaN -> 0.  ``exclude_current`` ends the window
    at t-1 (the other alignment).  The frame is bounded (``length`` rows).  Several lengths give the windows of each, with a column
    ``length``: the rows pass one window, of the longest, and the others are its newest ends."""
    w = order_window(keys)
    longest = length if isinstance(length, int) else max(length)
    frame = w.rowsBetween(-longest, -1) if exclude_current else w.rowsBetween(-(longest - 1), 0)
    vec = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
    seq = F.collect_list(vec).over(frame)
    out = df.select(*keys, "date", F.col(label).alias("label"), seq.alias("__seq"))
    if not isinstance(length, int):
        ends = F.array(*[F.struct(F.lit(n).alias("length"), F.slice("__seq", -n, n).alias("__end")) for n in length])
        each = out.select(*keys, "date", "label", F.inline(F.filter(ends, lambda x: F.size(x["__end"]) == x["length"])))
        return each.select(*keys, "date", F.flatten("__end").alias("features"), "label", "length")
    return (out.where(F.size("__seq") == length)
               .select(*keys, "date", F.flatten("__seq").alias("features"), "label"))


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def smallest(df: DataFrame, n: int, keys, seed: str = "42") -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest md5 of seed and ``keys``, ties by the keys.

    The n-th smallest hash is found by distributed selection: rows are counted by the upper 16 bits of its first 32, then, where the
    n-th lies, by the lower ones (65,536 counts at most each time).  Rows below it are kept where they are; only those that share
    its 32 bits are sorted, and as many taken as are missing."""
    if n <= 0:
        return df.limit(0)
    taken = {c.lower() for c in df.columns}
    h = "__h"
    while h in taken:
        h = "_" + h
    text = F.concat(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])  # a NULL key counts as empty text
    md5 = F.md5(text.cast("binary"))
    keyed = df.withColumn(h, F.conv(F.substring(md5, 1, 8), 16, 10).cast("bigint"))
    low, below, within = 0, 0, 32
    while within:
        within -= 16
        part = F.shiftright(F.col(h), within)
        inside = keyed.where((F.col(h) >= low) & (F.col(h) < low + (1 << (within + 16)))) if within < 16 else keyed
        counts = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.orderBy("part"))  # a window over 65,536 counts at most
        found = counts.withColumn("upto", upto).where(F.col("upto") >= n - below).orderBy("part").limit(1).collect()
        if not found:  # fewer rows than asked for
            return df
        below += found[0]["upto"] - found[0]["rows"]
        low = found[0]["part"] << within
    kept = keyed.where(F.col(h) < low).drop(h)
    return kept.unionByName(keyed.where(F.col(h) == low).orderBy(md5, *keys).limit(n - below).drop(h))


def cap_rows(df: DataFrame, n: int, keys=("grid_id", "date"), seed: str = "42") -> DataFrame:
    """Uniform sample of exactly min(n, rows) rows, the same in every run (sampling operator)."""
    return smallest(df, n, keys, seed)


def cap_by_grid(df: DataFrame, max_rows: int, key="grid_id", date_col="date", seed: str = "42") -> DataFrame:
    """A sample of exactly min(k, cells) whole cells, k = max_rows / median(dates per cell), at least 8 (sampling operator)."""
    per = df.groupBy(key).agg(F.countDistinct(date_col).alias("__d"))
    median = per.agg(F.percentile("__d", 0.5)).first()[0]
    if median is None:
        return df
    cells = smallest(per.select(key), max(8, int(max_rows / max(1, int(median)))), [key], seed)
    return df.join(cells, key, "left_semi")


def same_month_target(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Estimation protocol: label = current VHI; VHI removed from the predictors."""
    return df.withColumn("label", F.col("vhi")), [c for c in features if c != "vhi"]


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, pop: bool = True) -> DataFrame:
    """z-score with statistics fitted on ``fit_on`` (train rows) only."""
    fit = fit_on if fit_on is not None else df
    sd = F.stddev_pop if pop else F.stddev_samp
    stats = fit.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[sd(c).alias(f"s_{c}") for c in cols])
    out = {}
    for c in cols:
        m = stats.select(f"m_{c}").scalar()
        s = stats.select(f"s_{c}").scalar()
        out[c] = F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - m) / s)
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """(x - median) / IQR (IQR 0 -> 1), statistics from ``fit_on``.  Exact global
    quantiles by distributed selection; ``exact=False`` swaps to a sketch."""
    from .quality import global_quantiles
    fit = fit_on if fit_on is not None else df
    q = global_quantiles(fit, cols, [0.25, 0.5, 0.75], exact)
    out = {}
    for c in cols:
        iqr = q[c][2] - q[c][0]
        out[c] = (F.col(c) - q[c][1]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return df.withColumns(out)
