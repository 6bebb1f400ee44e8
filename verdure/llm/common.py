"""Shared column helpers of the corpus operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of ``text`` (no empty entries)."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_case(word: str) -> str:
    """Regex for ``word`` with ASCII letters in either case, the same in every engine."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and in whatever lambda it is used.

    (A plain column reference inside a lambda may be replaced by its expression, and then runs for every element.)"""
    return F.transform(F.array(value), body)[0]


def let_sql(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def pinned(condition: Column) -> Column:
    """The same condition, but one that no optimizer moves below the projection it stands in (where its costly
    inputs would be computed a second time)."""
    return (F.monotonically_increasing_id() >= 0) & condition


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df`` and all its columns as the struct ``__row``: names added later cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *cols)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns packed in ``__row``, some of them replaced."""
    return df.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in columns])


#: Rows of a slim table (ids and numbers) that one task writes: small tables make few files, large ones many.
ROWS_PER_FILE = 100_000


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))
