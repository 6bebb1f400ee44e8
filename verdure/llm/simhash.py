"""SimHash fingerprints and a permuted block index over them.

A text's terms are its five-word shingles (the whole sequence when shorter), each as often as it
occurs: the weight of a term is its count.  Bit b of the 64-bit fingerprint is 1 if more than half
of the weight hashes to 1 there.  Two bits are counted in one long (32 bits each), so a text needs 32 sums.

Search: the fingerprint is cut into ``BLOCKS`` blocks; one table for every choice of
``BLOCKS - radius`` of them, keyed by the chosen blocks.  Fingerprints within the radius differ in
``radius`` blocks at most, so they meet in a table.  Equal fingerprints are one row with a count.

Scale: texts are shuffled once by document key (both joins use that exchange) and prefixes once;
terms are counted in the task that holds the text.  The order of documents comes from range
partitions of the keys alone, with one boundary row a partition.

Defined results: a null text is empty; an empty text has no terms and fingerprint 0; null ids come
last in descending order; equal ids are ordered by text hash; equal rows stand once in the order and
each gets the same result; extra columns are ignored.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import files_for, let_sql, text_of, words

SHINGLE = 5
RADIUS = 3
BLOCKS = 6
#: Stands for a null id; what tells it from a real one is the lowest bit of the row's hash.
NULL_ID = -(1 << 63)


def terms(text: Column, size: int = SHINGLE) -> Column:
    """Array of the ``size``-word shingles of ``text``."""
    w = words(text)
    return F.transform(F.array(w), lambda a: F.when(F.size(a) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - (size - 1))),
        lambda i: F.array_join(F.slice(a, i, size), " "))))[0]


def _hash(term: str) -> Column:
    """64 bits of the term's MD5 as a long."""
    return F.conv(F.left(F.md5(F.col(term).cast("binary")), F.lit(16)), 16, -10).cast("long")


def fingerprints(df: DataFrame, keys: list[str], text: str, size: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp`` (long) of every row; rows with equal keys must have equal texts."""
    t = df.select(*keys, F.explode_outer(terms(F.col(text), size)).alias("term"))
    t = t.select(*keys, "term", _hash("term").alias("z"))
    two = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("z", b).bitwiseAND(two)).alias(f"s{b}") for b in range(32)]
    t = t.groupBy(*keys).agg(F.count("term").alias("n"), *sums)
    # the 64 votes are read from an array in one loop: 64 expressions would make a method too large to compile well
    votes = t.select(*keys, "n", F.array(*[f"s{b}" for b in range(32)]).alias("s"))
    low, high = "2 * (v[b] & 4294967295L) > n", "2 * shiftrightunsigned(v[b], 32) > n"
    fp = F.expr(let_sql("s", "v", "aggregate(sequence(0, 31), 0L, (a, b) -> "
                        f"a | CASE WHEN {low} THEN shiftleft(1L, b) ELSE 0L END | CASE WHEN {high} THEN shiftleft(1L, b + 32) ELSE 0L END)"))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def next_keys(keys: DataFrame, files: int | None = None) -> DataFrame:
    """``keys`` (id, h, unique; written in ``files`` files) with next_id, next_h: the next in descending id, then ascending h; after the last the first."""
    order = [F.col("id").desc(), F.col("h").asc()]
    k = keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # the partition numbers are data from here on
    k = cut_lineage(k.coalesce(files) if files else k)
    inside = Window.partitionBy("part").orderBy(*order)
    k = k.withColumns({"next": F.lead(F.struct("id", "h")).over(inside), "place": F.row_number().over(inside)})
    # one row a partition: the first key of the next one, the last goes back to the first
    heads = k.where("place = 1").select("part", F.struct("id", "h").alias("head"))
    by_part = Window.orderBy("part")
    heads = heads.withColumn("wrap", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part)))
    k = k.join(heads.select("part", "wrap"), "part")
    return k.withColumn("next", F.coalesce("next", "wrap")).select(
        *keys.columns, F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def _blocks(fp: str, count: int) -> list[Column]:
    edges = [64 * i // count for i in range(count + 1)]
    return [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]


def block_tables(df: DataFrame, fp: str, radius: int = RADIUS, count: int = BLOCKS) -> DataFrame:
    """``df`` with a row per table: ``table`` and the key of its chosen blocks."""
    parts = _blocks(fp, count)
    rows = []
    for i, chosen in enumerate(combinations(range(count), count - radius)):
        key, used = F.lit(0).cast("long"), 0
        for c in chosen:
            width = 64 * (c + 1) // count - 64 * c // count
            key = F.shiftleft(key, width).bitwiseOR(parts[c])
            used += width
        if used > 64:
            raise ValueError("the chosen blocks must fit 64 bits")
        rows.append(F.struct(F.lit(i).alias("table"), key.alias("key")))
    return df.select("*", F.explode(F.array(*rows)).alias("x")).select(*df.columns, "x.table", "x.key")


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, count: int = BLOCKS) -> DataFrame:
    """Distinct (q, fp, docs): for every fingerprint ``q`` of ``queries`` (column fp), all rows of ``index`` (fp, docs;
    distinct fingerprints) within ``radius`` bits."""
    q = block_tables(queries.select(F.col("fp").alias("q")).distinct(), "q", radius, count)
    x = block_tables(index.select("fp", "docs"), "fp", radius, count)
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    hit = q.alias("a").join(x.alias("b"), (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & near)
    return hit.groupBy("q", "fp").agg(F.max("docs").alias("docs"))


def edited_fingerprints(docs: DataFrame, *, radius: int = RADIUS, query_ids: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and the number of other documents within
    ``radius`` for rows whose id ``query_ids`` divides."""
    none = F.lit(1).cast("long")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text_of("text").alias("t"), F.col("doc_id").isNull().cast("long").alias("none"))
    d = d.withColumn("h", F.xxhash64("t").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("none"))).drop("none")
    files = files_for(docs.count())
    keys = next_keys(d.groupBy("id", "h").agg(F.count("*").alias("copies"), F.max(F.length("t")).cast("long").alias("n_chars")), files)
    keys = keys.withColumn("need", F.floor(F.col("n_chars") / 2))
    texts = d.groupBy("id", "h").agg(F.first("t").alias("t"))
    front = keys.select("id", "h", "n_chars", "need", "copies", "next_id", "next_h")
    # the next document's front part, sent to the document that is edited
    prefix = (texts.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("t").alias("next_t"))
              .join(front, ["next_id", "next_h"])
              .select("id", "h", "n_chars", "need", "copies", "next_id", "next_h",
                      F.left("next_t", F.col("need").cast("int")).alias("prefix")))
    both = texts.join(prefix, ["id", "h"]).withColumn(
        "edited", F.concat(F.left("t", (F.col("n_chars") - F.col("need")).cast("int")), F.col("prefix")))
    versions = both.select("id", "h", "n_chars", "copies", "next_id", "next_h", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("t").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    versions = versions.select("id", "h", "n_chars", "copies", "next_id", "next_h", "x.v", "x.t",
                               F.when(F.col("x.v") == 1, F.sha2(F.col("x.t").cast("binary"), 256)).alias("sha"))
    fps = fingerprints(versions, ["id", "h", "n_chars", "copies", "next_id", "next_h", "v", "sha"], "t")
    fps = fps.groupBy("id", "h", "n_chars", "copies", "next_id", "next_h").agg(
        F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp"),
        F.max("sha").alias("edited_sha256"))
    # the texts end here: 100 bytes a document are dealt to a few writers
    fps = cut_lineage(fps.repartition(files))
    other = fps.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    out = fps.join(other, ["next_id", "next_h"])
    has_id = F.col("h").bitwiseAND(none) == 0
    asked = has_id & (F.col("id") % query_ids == 0)
    near = within(fps.where(asked), fps.groupBy("fp").agg(F.sum("copies").alias("docs")), radius)
    near = near.groupBy("q").agg((F.sum("docs") - 1).alias("n_near"))
    out = out.join(near, (F.col("fp") == F.col("q")) & asked, "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.coalesce(files).select(
        F.when(has_id, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
