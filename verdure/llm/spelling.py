"""Spelling variant grouping: words that differ by one code point, found by probing generated edits in Bloom filters.

A word's neighbourhood is generated, not joined: its deletions (probed among the words one code point shorter) and its
replacements by greater letters (among the words as long).  A word one code point longer finds this one by its own
deletions, and a replacement by a smaller letter is found from the other end, so every near pair is met exactly once.
Edits are probed, as 64-bit polynomial hashes updated in place, in Bloom filters sharded by word length, whose blocks
are single 64-bit words.  Only edits that the filters hold are spelled out; they are shuffled to an exact join with
the vocabulary, which removes the false ones.

The filters are broadcast, ``PASS_BLOCKS`` blocks (32 MB) at a time: a larger vocabulary is probed in several
passes, a shard too large for one pass in parts by hash.  Nothing else is broadcast.

Each word's form is its most frequent near word, if at least ``ratio`` times as frequent.  Counts so grow by that factor
from form to form, and the walk from the words without a form down to those that point at them ends after
log(largest count) rounds; a word has a few thousand near words at most, so no row is hot.

Defined results: null and empty texts have no words; a null id counts as empty text in the hash; repeated rows and ids
count as often as they stand.  Ties go to the smaller word in code-point order.  Other columns are ignored.  An empty
table gives no rows.  A text is worked on whole by one task (its words as an array); probes are made for
``BLOCK_POINTS`` code points at a time, a longer word alone.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import files_for, lower_az
from .hashing import U, mix

RUN = r"[A-Za-zÀ-ÿ]+"
#: Every code point of a run after lower-casing: 90 at most.
LETTERS = sorted({*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)})
#: One occurrence in so many of a (document, run) pair loses a code point.
NOISE = 97
LEAST_POINTS, LEAST_COUNT, RATIO = 5, 3, 2

BITS_PER_WORD = 16
#: Words of this many code points and more share a shard.
LAST_SHARD = 64
#: Blocks (64 bits each) of the filters that are broadcast at once.
PASS_BLOCKS = 1 << 22
BLOCK_POINTS = 1 << 18

BASE = U(0x9E3779B97F4A7C15)
UNDO = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SALT = U(0xD1B54A32D192ED03)


def noisy(doc_id: str, run: str) -> str:
    """SQL for the run, less one code point where the checksum of document and run says so."""
    h = f"crc32(encode(concat(coalesce(cast({doc_id} as string), ''), ':', {run}), 'UTF-8'))"
    at = f"cast({h} % length({run}) as int)"
    return f"if({h} % {NOISE} = 0, concat(substring({run}, 1, {at}), substring({run}, {at} + 2)), {run})"


def vocabulary(docs: DataFrame, *, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts and their occurrences, combined in the map tasks before they are shuffled."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_az(F.col("text").cast("string")), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_points).select(F.expr(noisy("doc_id", "run")).alias("word"))
    return words.where(F.length("word") >= least_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, one after another; code points of each word)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


class Hashes:
    """Polynomial hashes of words (sum of letter hash times BASE^position, mod 2^64), and of what edits make of them."""

    def __init__(self, words: list[str]):
        self.point, self.length = points(words)
        self.start = np.cumsum(self.length) - self.length
        self.owner = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.point)) - self.start[self.owner]
        self.power = np.cumprod(np.r_[U(1), np.full(int(self.length.max()), BASE)])[self.place]
        self.letter = mix(self.point.astype(U) + SALT)
        total = np.r_[U(0), np.cumsum(self.letter * self.power)]
        self.before = total[:-1] - total[self.start][self.owner]
        self.whole = total[self.start + self.length] - total[self.start]

    def deleted(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the distinct deletions: the first of equal letters in a row."""
        first = np.ones(len(self.point), bool)
        first[1:] = (self.point[1:] != self.point[:-1]) | (self.place[1:] == 0)
        at = np.flatnonzero(first)
        after = self.whole[self.owner[at]] - self.before[at] - self.letter[at] * self.power[at]
        return at, self.before[at] + after * UNDO

    def replaced(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the replacements of smaller letters by ``letter``."""
        at = np.flatnonzero(self.point < letter)
        new = mix(np.array([letter], U) + SALT)[0]
        return at, self.whole[self.owner[at]] + (new - self.letter[at]) * self.power[at]


def mask_of(h: np.ndarray) -> np.ndarray:
    """The four bits of its block that a word sets."""
    m = np.zeros(len(h), U)
    for i in range(4):
        m |= U(1) << ((h >> U(6 * i)) & U(63))
    return m


def shard_of(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LAST_SHARD)


class Layout:
    """Where the filters lie: each shard has parts (by hash) of equal numbers of blocks, and passes take whole parts."""

    def __init__(self, words_of: dict[int, int]):
        self.parts, self.blocks = np.ones(LAST_SHARD + 1, np.int64), np.zeros(LAST_SHARD + 1, np.int64)
        for shard, n in words_of.items():
            blocks = -(-n * BITS_PER_WORD // 64)
            self.parts[shard] = -(-blocks // PASS_BLOCKS)
            self.blocks[shard] = -(-blocks // self.parts[shard])
        self.first = np.cumsum(self.parts) - self.parts
        self.offset, self.in_pass = np.zeros(self.parts.sum(), np.int64), np.zeros(self.parts.sum(), np.int64)
        self.size = [0]
        for shard in sorted(words_of):
            for part in range(self.parts[shard]):
                if self.size[-1] + self.blocks[shard] > PASS_BLOCKS:
                    self.size.append(0)
                self.offset[self.first[shard] + part] = self.size[-1]
                self.in_pass[self.first[shard] + part] = len(self.size) - 1
                self.size[-1] += int(self.blocks[shard])

    def where(self, h: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pass, block) of hashes of words in shards that are not empty."""
        part = self.first[shard] + ((h >> U(24)) % self.parts[shard].astype(U)).astype(np.int64)
        return self.in_pass[part], self.offset[part] + ((h >> U(32)) % self.blocks[shard].astype(U)).astype(np.int64)


def filters(words: DataFrame, layout: Layout) -> DataFrame:
    """pass, block, bits of the filters: bits of one block are merged in the map task and again after the shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = Hashes(batch.column("word").to_pylist())
                h = mix(k.whole)
                turn, block = layout.where(h, shard_of(k.length))
                yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(block), pa.array(mask_of(h).view("i8"))],
                                                 names=["pass", "block", "bits"])

    return words.mapInArrow(run, "pass int, block long, bits long").groupBy("pass", "block").agg(F.expr("bit_or(bits)").alias("bits"))


def _slices(words: list[str]):
    """Starts and ends of pieces with about ``BLOCK_POINTS`` code points; a longer word is a piece of its own."""
    start, held = 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > BLOCK_POINTS:
            yield start, i
            start, held = i, 0
        held += len(w)
    if words:
        yield start, len(words)


def probed(words: DataFrame, layout: Layout, turn: int, bits, letters: list[int], least_points: int) -> DataFrame:
    """word, n, near: edits of the words that the filters of one pass hold; ``bits`` is a broadcast array of blocks."""

    def run(batches):
        for batch in batches:
            all_words, counts = batch.column("word").to_pylist(), batch.column("n")
            for lo, hi in _slices(all_words):
                word = all_words[lo:hi]
                k = Hashes(word)
                found_word, found = [], []

                def held(at, h, length):
                    """Positions whose edits (hashes ``h``, lengths ``length``) the filters hold."""
                    shard = shard_of(length)
                    ok = np.flatnonzero((length >= least_points) & (layout.blocks[shard] > 0))
                    at, h = at[ok], mix(h[ok])
                    of, block = layout.where(h, shard[ok])
                    if len(layout.size) > 1:
                        now = np.flatnonzero(of == turn)
                        at, h, block = at[now], h[now], block[now]
                    m = mask_of(h)
                    at = at[(bits.value[block] & m) == m]
                    return zip(k.owner[at].tolist(), k.place[at].tolist())

                at, h = k.deleted()
                for w, i in held(at, h, k.length[k.owner[at]] - 1):
                    found_word.append(w)
                    found.append(word[w][:i] + word[w][i + 1:])
                for letter in letters:
                    at, h = k.replaced(letter)
                    for w, i in held(at, h, k.length[k.owner[at]]):
                        found_word.append(w)
                        found.append(word[w][:i] + chr(letter) + word[w][i + 1:])
                if found:
                    who = pa.array(np.array(found_word) + lo)
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(who), counts.take(who), pa.array(found, pa.string())],
                                                     names=["word", "n", "near"])

    return words.mapInArrow(run, "word string, n long, near string")


def near_pairs(words: DataFrame, *, least_points: int = LEAST_POINTS) -> DataFrame:
    """word, n, near, near_n: every unordered pair of words that differ by one code point, once."""
    spark = words.sparkSession
    shards = words.groupBy(F.least(F.length("word"), F.lit(LAST_SHARD)).alias("s")).count().collect()
    layout = Layout({r["s"]: r["count"] for r in shards})
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()
    letters = sorted(ord(r["c"]) for r in letters)
    built = cut_lineage(filters(words, layout)) if len(layout.size) > 1 else filters(words, layout)
    found = None
    for turn, size in enumerate(layout.size):
        rows = built.where(F.col("pass") == turn).select("block", "bits").toArrow()
        bits = np.zeros(size, U)
        bits[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(U)
        hits = probed(words, layout, turn, spark.sparkContext.broadcast(bits), letters, least_points)
        found = hits if found is None else found.unionByName(hits)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, "near").select("word", "n", "near", "near_n")


def group(words: DataFrame, *, least_points: int = LEAST_POINTS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    both = near_pairs(words, least_points=least_points).select(F.explode(F.array(
        F.struct("word", F.struct(-F.col("near_n"), F.col("near").alias("w")).alias("best")),
        F.struct(F.col("near").alias("word"), F.struct(-F.col("n"), F.col("word").alias("w")).alias("best")))).alias("x"))
    near = both.groupBy("x.word").agg(F.count("*").alias("n_near"), F.min("x.best").alias("best"))
    near = near.select("word", "n_near", F.col("best.w").alias("w"), (-F.col("best.col1")).alias("w_n"))
    large = F.col("w_n") >= ratio * F.col("n")
    named = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("w")).alias("form"),
        F.when(large, F.col("w_n")).alias("form_n")))
    return named.join(roots(named), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(named: DataFrame) -> DataFrame:
    """word, root: level by level, from the words without a form to the words whose form they are."""
    level = named.where("form IS NULL").select("word", F.col("word").alias("root"))
    below = named.where("form IS NOT NULL").select(F.col("word").alias("child"), F.col("form").alias("word"))
    every, left = level, below.count()
    while left:
        level = below.join(level, "word").select(F.col("child").alias("word"), "root")
        level = cut_lineage(level.coalesce(files_for(left)))
        every, left = every.unionByName(level), left - level.count()
    return every


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text)."""
    words = cut_lineage(vocabulary(docs))
    return group(words)
