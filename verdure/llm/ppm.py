"""Language-model scoring by prediction by partial matching over bytes.

Training gathers how often each (order + 1)-gram of bytes occurs: a byte-context trie of depth
``ORDER`` whose leaves are counted, with every shorter context the sum of the leaves under it.
A symbol is coded from its longest context down.  A context with total T and d distinct symbols
gives symbol s the share n(s) / (T + d) and escape d / (T + d) (method C); after an escape the
symbols of the longer context are excluded from the next (all of them occur in it too, so its
totals just shrink).  Under order 0, what is left of the 257 symbols (256 bytes and the end) is
equally likely.  The document's score is the log10 sum over its bytes and its end.

The probability depends on the last ``ORDER`` bytes and the symbol alone, so it is computed once
per distinct gram, not per position.  Scan tasks send each distinct gram once with its training
count; counts are summed; grams meet in groups that share their last three context bytes (their
subtrie) and get their probability.  Documents are dealt to buckets of bounded size; a bucket asks for
its distinct grams and scores its texts with the answers.  Words for the base score take the same way.  No table is broadcast but the
trie above those groups: contexts of two bytes or less, at most 256 * 256 * 257 + ... counts
(packed: 140 MB if every byte pair were followed by every byte; a few hundred kB in text).

Defined results: a null text is empty (its end only); a null id counts as the text '' in the fold
rule; equal rows are scored alike, in one bucket; with no training rows every gram has the uniform
probability; no documents give no rows; further columns are ignored, whatever their names.  A text is one
piece of work with several numbers of eight bytes for each of its bytes, however long it is.
"""
from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .hashing import U, Lookup, lowered, slices, word_hashes

ORDER = 4
FOLDS, HELD_OUT = 7, 2
BUCKET_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20
START, END = 0xFF, 0xFE  # never in UTF-8: in front of a text, after its last byte
SYMBOLS = 257
WORD_END = 0  # hash that stands for the end token


def _positions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte and end as one number, number of them per text); A-Z count as a-z."""
    data, at = lowered(texts)
    n = np.diff(at)
    # one line of bytes: ORDER starts, the text, the end; then the next text
    ends = np.cumsum(n + ORDER + 1)
    line = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint8)
    keep = np.ones(len(line), bool)
    front = (ends - n - ORDER - 1)[:, None] + np.arange(ORDER)
    keep[front.ravel()] = False
    line[ends - 1] = END
    body = keep.copy()
    body[ends - 1] = False
    line[body] = data
    gram = line.astype(U)
    for i in range(1, ORDER + 1):
        gram[i:] |= line[:-i].astype(U) << U(8 * i)
    return gram[keep], n + 1


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word and of the end, number of them per text)."""
    h, counts = word_hashes(texts)
    h = np.where(h == WORD_END, U(1), h)
    return np.insert(h, np.cumsum(counts), U(WORD_END)), counts + 1


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of each are training ones."""
    keys, train = keys[o := np.argsort(keys)], train[o]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(train.astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, n = keys[o := np.argsort(keys)], n[o]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       (fold == HELD_OUT).alias("held_out"))


def _distinct(pieces, train: bool):
    """(kind, key, n) of grams (0) and words (1) in pieces of texts: distinct keys and their training counts."""
    found = {0: [], 1: []}
    for piece in pieces:
        text = piece.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        learn = ~piece.column("held_out").to_numpy(**({} if isinstance(piece, pa.Table) else {"zero_copy_only": False}))
        for kind, cut in ((0, _positions), (1, _tokens)):
            keys, per = cut(text)
            found[kind].append(_counted(keys, np.repeat(learn, per)) if train else (np.unique(keys), np.zeros(0)))
            if sum(len(k) for k, _ in found[kind][1:]) > 1 << 20:
                found[kind] = [_merged(found[kind])] if train else [(np.unique(np.concatenate([k for k, _ in found[kind]])), np.zeros(0))]
    for kind, parts in found.items():
        if parts:
            keys, n = _merged(parts) if train else (np.unique(np.concatenate([k for k, _ in parts])), None)
            yield kind, keys, n


#: A task gives its distinct keys back after this many bytes of text, so its tables stay small.
GATHER_BYTES = 64 << 20


def gathered(docs: DataFrame) -> DataFrame:
    """kind, key, n over all documents: how often each gram and word occurs in training rows (0: only in held-out ones)."""

    def run(batches):
        waiting, size = [], 0

        def out():
            for kind, keys, n in _distinct(waiting, True):
                for i in range(0, len(keys), 1 << 18):
                    k = keys[i:i + (1 << 18)]
                    yield pa.RecordBatch.from_pydict({"kind": np.full(len(k), kind, np.int32), "key": k.view("i8"), "n": n[i:i + (1 << 18)]})

        for batch in batches:
            for piece in slices(batch, "text", BLOCK_BYTES):
                waiting.append(piece)
                size += piece.column("text").nbytes
            if size >= GATHER_BYTES:
                yield from out()
                waiting, size = [], 0
        yield from out()

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet (narrower than a row checkpoint) and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ppm-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Trie:
    """Counts under one set of grams: for every order, context totals and distinct symbols."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, low: int):
        """``grams``: (order + 1)-grams with training counts; contexts shorter than ``low`` are left out."""
        self.low = low
        self.levels: dict[int, tuple] = {}
        grams, n = grams[n > 0], n[n > 0]
        for k in range(ORDER, low - 1, -1):
            mask = U((1 << (8 * (k + 1))) - 1)
            keys, counts = _merged([(grams & mask, n)]) if len(grams) else (np.zeros(0, U), np.zeros(0, np.int64))
            contexts, inverse = np.unique(keys >> U(8), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(contexts))
            distinct = np.bincount(inverse, minlength=len(contexts))
            self.levels[k] = (keys, counts, contexts, total, distinct)
            grams, n = keys, counts

    def count(self, k: int, grams: np.ndarray) -> np.ndarray:
        keys, counts = self.levels[k][:2]
        return _lookup(keys, counts, grams & U((1 << (8 * (k + 1))) - 1))

    def context(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, contexts, total, distinct = self.levels[k]
        c = (grams >> U(8)) & U((1 << (8 * k)) - 1)
        return _lookup(contexts, total, c), _lookup(contexts, distinct, c)

    def children(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts of length k, their symbols' grams, index of the context of each)."""
        keys, _, contexts, _, _ = self.levels[k]
        return contexts, keys, np.searchsorted(contexts, keys >> U(8))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(grams: np.ndarray, high: Trie, base: Trie) -> np.ndarray:
    """log10 probability of each gram's last byte after the bytes before it.

    ``high`` holds the longer contexts of these grams, ``base`` all contexts under ``high.low``."""

    def trie(k):
        return high if k >= high.low else base

    out = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    excluded_n, excluded_d = np.zeros(len(grams)), np.zeros(len(grams))
    for k in range(ORDER, -1, -1):
        t = trie(k)
        total, distinct = t.context(k, grams)
        count = t.count(k, grams)
        if k < ORDER:
            # what the longer context has seen is excluded: its symbols' counts in this context
            up = trie(k + 1)
            contexts, keys, of = up.children(k + 1)
            mass = np.bincount(of, weights=t.count(k, keys), minlength=len(contexts)) if len(keys) else np.zeros(0)
            c = (grams >> U(8)) & U((1 << (8 * (k + 1))) - 1)
            excluded_n = _lookup(contexts, mass, c)
            excluded_d = up.context(k + 1, grams)[1]
        left, kinds = total - excluded_n, distinct - excluded_d
        here = open_ & (kinds > 0)  # nothing new in this context: it is skipped
        hit = here & (count > 0)
        out[hit] += np.log10(count[hit] / (left + kinds)[hit])
        miss = here & ~hit
        out[miss] += np.log10(kinds[miss] / (left + kinds)[miss])
        open_ &= ~hit
    seen = base.context(0, grams)[1]
    out[open_] -= np.log10(SYMBOLS - seen[open_])
    return out


LOW = 3  # context bytes that a group of grams shares


def probabilities(counts: DataFrame) -> DataFrame:
    """kind, key, v for every gram in ``counts`` (key, n: summed training counts): its log10 probability."""
    mask = (1 << (8 * LOW)) - 1
    grams = counts.where("kind = 0")
    short = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n"))
    # at most 2^24 rows whatever the input; counts of all contexts of LOW - 1 bytes
    rows = short.toArrow()
    b_keys, b_n = rows.column("key").to_numpy().view(U), rows.column("n").to_numpy()
    shared = counts.sparkSession.sparkContext.broadcast((b_keys, b_n))

    def run(batches):
        keys, n = shared.value
        base = None
        waiting: list[pa.RecordBatch] = []
        size, last = 0, None

        def emit(table):
            nonlocal base
            if base is None:
                base = _base(keys, n)
            g = table.column("key").to_numpy().view(U)
            t = Trie(g, table.column("n").to_numpy(), LOW)
            return pa.RecordBatch.from_pydict({"kind": np.zeros(len(g), np.int32), "key": g.view("i8"), "v": code_lengths(g, t, base)})

        # rows come sorted by group; a piece ends where a group ends
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("g").to_numpy()
            waiting.append(batch)
            size += batch.num_rows
            last = groups[-1]
            if size >= 1 << 18:
                cut = int(np.searchsorted(groups, last, side="left"))
                whole = pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)])
                if cut or len(waiting) > 1 and waiting[-2].column("g")[-1].as_py() != last:
                    if whole.num_rows:
                        yield emit(whole)
                    waiting = [batch.slice(cut)]
                    size = batch.num_rows - cut
        if waiting:
            yield emit(pa.Table.from_batches(waiting))

    g = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(mask))
    dealt_out = grams.select("key", "n", g.alias("g")).repartition("g").sortWithinPartitions("g", "key")
    return dealt_out.mapInArrow(run, "kind int, key long, v double")


def _base(keys: np.ndarray, n: np.ndarray) -> Trie:
    """Contexts under LOW from the counts of (LOW)-grams."""
    t = Trie.__new__(Trie)
    t.low, t.levels = 0, {}
    for k in range(LOW - 1, -1, -1):
        keys, n = _merged([(keys & U((1 << (8 * (k + 1))) - 1), n)]) if len(keys) else (keys, n)
        contexts, inverse = np.unique(keys >> U(8), return_inverse=True)
        t.levels[k] = (keys, n, contexts, np.bincount(inverse, weights=n, minlength=len(contexts)),
                       np.bincount(inverse, minlength=len(contexts)))
    return t


def score(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    ``bits_per_byte`` is the code length in bits over the text's bytes and its end, which tells texts that the model
    knows (repeated ones, too) from others whatever their length."""
    d = prepared(docs)
    counts = saved(gathered(d))
    totals = counts.where("kind = 1 AND n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = totals["n"] or 0, totals["v"]
    text_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-text_bytes // bucket_bytes)))))
    # both uses of the buckets read one exchange of the texts
    buckets = buckets.repartition("bucket")

    def ask(table: pa.Table) -> pa.Table:
        out = list(_distinct(slices(table, "text", BLOCK_BYTES), False))
        keys = np.concatenate([k for _, k, _ in out]).view("i8")
        return pa.table({"bucket": np.full(len(keys), table.column("bucket")[0].as_py()),
                         "kind": np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in out]), "key": keys})

    asked = buckets.groupBy("bucket").applyInArrow(ask, "bucket long, kind int, key long")
    words = counts.where("kind = 1").select("kind", "key", F.col("n").cast("double").alias("v"))
    answers = asked.join(probabilities(counts).unionByName(words), ["kind", "key"]).select("bucket", "kind", "key", "v")
    schema = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kind, keys, v = (right.column(c).to_numpy() for c in ("kind", "key", "v"))
        grams, words = (Lookup(keys[kind == k].view(U), v[kind == k]) for k in (0, 1))
        out = []
        for part in slices(left, "text", BLOCK_BYTES):
            text = part.column("text").combine_chunks()
            at, per = _positions(text)
            total = np.add.reduceat(grams(at), np.cumsum(per) - per)
            bits = -total / np.log10(2) / per
            at, per = _tokens(text)
            c, begin = words(at), np.cumsum(per) - per
            base = np.add.reduceat(np.log10((c + 1) / (n_all + v_all + 1)), begin)
            known = np.add.reduceat((c > 0).astype(np.int64), begin)
            out.append(pa.table({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(per, pa.int64()),
                                 "n_known": known, "train_tokens": np.full(len(per), n_all, np.int64), "base_score": base, "score": total,
                                 "bits_per_byte": bits}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in schema})

    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
             "bits_per_byte double")
