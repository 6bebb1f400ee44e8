"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear from ``start`` to
``end``.  Its integral, scaled to the source's target, is the source's cumulative word demand.
A source's documents stand in a fixed pseudo-random order and are passed through again and
again until the target is met; the word a document copy begins at is put through the inverse
of the demand and gives the copy's training position.  Sorting by position (range partitions)
gives the training order.

The windows over sources hold a row per source in one task: meant for some thousands of sources.

Scale: texts are shuffled twice (into the order of their source, and into training order); per-source sums are
partial aggregates; the running word count inside a source is a
two-level prefix sum over hash buckets of about ``docs_per_bucket`` documents, so a source with
a third of all rows is many windows, never one.  Only per-source rows (a handful) and
per-bucket rows meet in one place.

Defined results: null text has size 0; a null source is a source of its own, after all others;
equal rows are told apart only by their place in the order, so each outcome occurs as often as
the rows do; with no words at all every target is 0 and nothing is taken.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import n_words, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: (start, end) of the linear weight schedule by place in ``WEIGHTS``: heavy sources early, light ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
DOCS_PER_BUCKET = 2000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source_size``, ``weight_place``, ``target``.

    Water-filling in closed form: sources saturate in the order of cap / weight.  With the first j
    saturated, each unit of weight gets (total - their caps) / (the other weights); the sources
    whose ratio lies under that level are exactly the saturated ones.  ``sizes``: source, size.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight_place", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("weight_place") + 1).cast("long"))
    s = s.withColumn("cap", max_repeats * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "caps_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights_from": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    # this source is open (not saturated) if its cap is over its share of what the earlier ones leave
    is_open = F.col("cap") * F.col("weights_from") > (F.col("total") - F.col("caps_before")) * F.col("weight")
    level = (F.col("total") - F.col("caps_before")).cast("double") / F.col("weights_from").cast("double")
    s = s.withColumn("level", F.min(F.when(is_open, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(),
                                                             F.col("source"), level.alias("v")))).over(everything)["v"])
    s = s.withColumn("target", F.when(is_open, F.col("weight") * F.col("level")).otherwise(F.col("cap").cast("double")))
    return s.select("source", "source_size", "source_docs", "weight_place", "target")


BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _position(share: Column, place: Column, schedules) -> Column:
    """Training time at which ``share`` of a source's demand is used up: the inverse integral of its schedule."""
    out = share
    for i, (a, b) in enumerate(schedules):
        if a != b:
            t = (F.sqrt(F.lit(a * a) + F.lit((b - a) * (a + b)) * share) - F.lit(a)) / F.lit(b - a)
            out = F.when(place == i, t).otherwise(out)
    return out


def plan(docs: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES,
         docs_per_bucket: int = DOCS_PER_BUCKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, source_size, target, copies, taken, position of its first copy
    (null if it has none).  ``keep``: further columns of ``docs`` to carry (as ``k_...``)."""
    t = text_of("text")
    slim = [F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(t).alias("size"),
            # by id and text: rows that share an id, or have none, spread like others
            F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(t.cast("binary"))).cast("binary")).alias("h"),
            F.md5(t.cast("binary")).alias("h2")]
    # sizes are read several times, texts once: the slim rows go to the shared checkpoint folder
    sizes = cut_lineage(docs.select(*slim))
    d = docs.select(*slim, *[F.col(c).alias(f"k_{c}") for c in keep]) if keep else sizes
    targets = source_targets(sizes.select("source", "size"), weights, max_repeats)
    targets = cut_lineage(targets)
    tg = small(targets.select(F.col("source").alias("s_source"), "source_size", "source_docs", "weight_place", "target"), targets.count())
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    bucket = F.shiftright(u * F.ceil(F.col("source_docs") / docs_per_bucket), 32)

    def placed(df):
        return df.join(tg, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("bucket", bucket)

    d = placed(d)
    per = placed(sizes).groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket")).agg(F.sum("size").alias("b_size"))
    running = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("b_size").over(running), F.lit(0))).drop("b_size")
    per = cut_lineage(per)
    d = d.join(small(per, per.count()), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    inside = (Window.partitionBy("b_source", "b_bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "h2")
              .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("begin", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    d = d.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    extra = (2 * F.col("begin") + F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    d = d.withColumn("copies", F.col("full") + extra.cast("long"))
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("begin") / F.col("target"))).otherwise(F.lit(0.0))
    return d.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, _position(share, F.col("weight_place"), schedules)).alias("position"),
        "begin", "weight_place", *[f"k_{c}" for c in keep])


def curriculum(docs: DataFrame, *, schedules=SCHEDULES, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, in the columns of ``docs``, range-sorted by
    training position."""
    p = plan(docs, schedules=schedules, keep=tuple(docs.columns), **options)
    p = p.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = F.when(F.col("target") > 0, F.least(
        F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("begin")) / F.col("target"))).otherwise(F.lit(0.0))
    p = p.withColumn("__position", _position(share, F.col("weight_place"), schedules))
    p = p.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id")
    return p.select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])
