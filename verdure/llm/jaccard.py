"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word n-grams, as 64-bit hashes.  Sets that link at threshold t
differ in at most k = (1 - t) / (1 + t) * (|a| + |b|) elements.  Sizes are banded; for each band
the element domain is partitioned into groups, and each group into two parts.  For every group the subsets of its parts
that leave one out, so either part, give a signature: the elements in it.  With more than k / 2 groups, two
sets that link have a group with at most one differing element, hence an equal part.  A set of a band also signs
for the next band if it can link upwards.

An empty part says nothing and is not emitted.  Where one part of a group is empty, the other also signs with each
element left out: if the equal part is the empty one, the other parts differ by one element at most, and meet so.  Only a
group with one element or none may fail; ``spare`` groups are added, so that as many such groups cost no link.  A set
with more of them signs again under another seed (up to ``SEEDS``), under the last one also by its thin groups: two sets
that link either share a signature with elements, or both sign under the next seed.  Each band takes the number of
spare groups that makes for the fewest signatures.

A set is named by 64 bits of its content, so documents with equal sets are one set (a scan task signs for each once), and
ids, null or repeated, play no part until the result.  Sets under one signature are candidates.  A signature of up to
``PAIRED`` sets gives their pairs as rows.  A signature of more is hot, and most often one of a few shingles that many
documents quote.  ``HOT_SPARE`` percent of further groups make most sets independent of such signatures: two sets that
link share signatures of 1 + spare - thin groups at least, so if either of them has fewer hot signatures than that, they
meet under another one too.  Only sets with as many hot ones (``exposed``) are compared under these.

Candidates are first compared by sketches: the domain dealt to 4 k parts, two bits of every part's sum.  Each differing
part costs a differing element, so more than k of them refute the pair, whatever the bits that happen to agree.  Pairs are
compared as rows, exposed sets under a hot signature block by block: each set of a block is linked with the first one, by id, of
its part, and those first ones with each other, so signatures of the same near copies give the same few links.  The
components of what is left are clusters: two sets that link are in the same one.  In a cluster every set is checked
exactly, on the shingles of the texts, against the first one; the sets that do not link with it, if any, against all
others, block by block.  Components of those links are the result.

Scale: a set has about 0.2 signatures an element at 90 %, 0.6 at 80 %; they are shuffled once, about 13 bytes each.
Pairs grow with the signatures, whatever the number of documents.  Sketches take a ninth of a byte an element at 90 %.
Only texts in a cluster move, once where all link with the first one.  Two things may grow faster than the input: exposed sets
under a hot signature that do not link, and clusters in which many do not link with the first.

Defined results: null and empty texts, and texts without words, are empty sets, linked with nothing.  Null ids take part;
repeated rows are one set.  Extra columns are ignored by ``join`` and kept by ``deduplicate``.  Empty tables give no rows.  A
text of any length is worked on whole, by itself, with some 100 bytes a word.
"""
from __future__ import annotations

from math import erfc, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import files_for, fresh
from .components import components
from .hashing import U, mix, slices, word_hashes

SEEDS = 5
#: Groups added, in percent of those needed, so that hot signatures can be done without.
HOT_SPARE = 10
#: Size bands grow by this many threshold steps: wider ones sign less often upwards, with more groups than needed.
BAND_STEPS = 2

ODD1, ODD2, ODD3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, sorted within each text; number of them per text)."""
    w, counts = word_hashes(texts)
    n = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = np.maximum(np.where(counts > 0, 1, 0), counts - size + 1)
    owner = np.repeat(np.arange(n), grams)
    first = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + starts[owner]
    h = np.zeros(len(first), U)
    limit = ends[owner]
    for i in range(size):
        at = first + i
        inside = at < limit
        step = mix((h + U(i + 1)) * ODD1 + w[np.minimum(at, max(len(w) - 1, 0))]) if len(w) else h
        h = np.where(inside, step, h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.bincount(owner[keep], minlength=n)


class Bands:
    """Size bands of a threshold given as percent, and how many groups each needs."""

    def __init__(self, percent: int, steps: int = BAND_STEPS, largest: int = 1 << 31):
        self.percent = percent
        low = [1]
        while low[-1] < largest:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 ** steps // percent ** steps)))
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        # integer form of k = (100 - p) * (|a| + |b|) / (100 + p)
        self.k = (100 - percent) * 2 * high // (100 + percent)
        self.spare = np.array([self._spare(int(k), float(n)) for k, n in zip(self.k, self.low)], np.int64) + -(-self._least(self.k) * HOT_SPARE // 100)
        self.groups = np.where(self.k == 0, 0, self._least(self.k) + self.spare)

    @staticmethod
    def _least(k):
        return -(-(k + 1) // 2)

    def _spare(self, k: int, n: float) -> int:
        """Spare groups with the fewest expected signatures for a set of ``n`` elements: more of them cost signatures, fewer
        make more sets sign again."""
        least = int(self._least(k))
        best, fewest = 1, np.inf
        for spare in sorted({1, 2, 3, *(-(-least * f // 100) for f in range(2, 42, 2))}):
            groups = least + spare
            mean = n / groups
            thin = groups * (1 + mean) * exp(-mean)
            # chance that more than ``spare`` groups are thin (normal tail, by the error function)
            again = 0.5 * erfc((spare + 0.5 - thin) / sqrt(2 * max(thin, 1e-9)))
            cost = groups * sum(again ** i for i in range(SEEDS))
            if cost < fewest:
                best, fewest = spare, cost
        return best

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def up(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set of the next band can be near enough in size."""
        return sizes * 100 >= self.low[band + 1] * self.percent


def signatures(h: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, signature) of every signature of the sets in ``h`` (concatenated, ``counts`` each), and for every
    set, how many signatures it has at least in common with any set it links with."""
    out_set, out_sig = [], []
    slack = np.full(len(counts), 1 << 40)
    sizes = counts.astype(np.int64)
    mine = bands.of(np.maximum(sizes, 1))
    alive = sizes > 0
    for shift in (0, 1):
        band = mine + shift
        use = alive & (bands.groups[band] > 0)
        if shift:
            use &= bands.up(sizes, mine)
        for seed in range(SEEDS):
            who = np.flatnonzero(use)
            if not len(who):
                break
            element = np.repeat(use, counts)
            owner = np.repeat(np.arange(len(counts)), counts)[element]
            x = mix(h[element] + mix(np.array([seed + 1], U)))
            n_groups = bands.groups[band]
            slot_of = (x % (2 * n_groups[owner]).astype(U)).astype(np.int64)
            first = np.zeros(len(counts), np.int64)
            first[who] = np.cumsum(n_groups[who]) - n_groups[who]
            slot = 2 * first[owner] + slot_of
            groups = int(n_groups[who].sum())
            order = np.argsort(slot, kind="stable")
            s, part = slot[order], mix(x[order] * ODD3)
            cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sums, filled = np.zeros(2 * groups, U), np.zeros(2 * groups, np.int64)
            sums[s[cut]] = np.add.reduceat(part, cut)
            filled[s[cut]] = np.diff(np.r_[cut, len(s)])
            set_of = np.repeat(who, n_groups[who])
            group_of = np.arange(groups) - np.repeat(first[who], n_groups[who])
            key = mix((band[set_of].astype(U) * U(SEEDS) + U(seed)) * ODD1 + group_of.astype(U) * ODD2)

            def of(slots, content):
                return mix((key[slots // 2] + (slots % 2 + 1).astype(U) * ODD3) * ODD1 + content)

            parts = np.flatnonzero(filled)
            out_set.append(set_of[parts // 2])
            out_sig.append(of(parts, sums[parts]))
            # the other part is empty: this one also without each of its elements
            alone = (filled[s ^ 1] == 0) & (filled[s] > 1)
            out_set.append(set_of[s[alone] // 2])
            out_sig.append(of(s[alone], sums[s[alone]] - part[alone]))
            in_group = filled.reshape(-1, 2).sum(axis=1)
            if seed == SEEDS - 1:
                thin = np.flatnonzero(in_group <= 2)
                out_set.append(set_of[thin])
                out_sig.append(mix(key[thin] + ODD3))
            # one signature in common is sure unless more groups are thin than were added
            thin_groups = np.bincount(set_of[in_group <= 1], minlength=len(counts))
            if not seed:
                slack[who] = np.minimum(slack[who], np.maximum(0, 1 + bands.spare[band] - thin_groups)[who])
            use = use & (thin_groups > bands.spare[band])
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, U), slack
    return np.concatenate(out_set), np.concatenate(out_sig), slack


#: Texts are worked on in pieces of about this many bytes.
BLOCK_BYTES = 4 << 20

#: A block of a candidate cluster: rows, and elements of their sets.
BLOCK_ROWS, BLOCK_ELEMENTS = 256, 1 << 17


#: Signatures of more sets than this are hot.
PAIRED = 8
#: Rows of a block in the comparisons of hot signatures, and of one signature that a task holds before it takes it for a hot one.
SKETCH_BLOCK, HELD = 512, 20_000
DOC = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("slack", pa.int64())])
DOC_SQL = "doc struct<doc_id: long, row: long, n: long, slack: long>"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``row``: a hash of both, which names what repeated rows share."""
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), text.alias("text"), row_of(id_, text).alias("row"))


def row_of(id_, text):
    return F.xxhash64(id_.isNull(), id_, text.isNull(), text)


def names(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of the content of every set; 0 for an empty one."""
    name = np.zeros(len(counts), U)
    full = np.flatnonzero(counts)
    if len(full):
        name[full] = mix(np.add.reduceat(mix(h * ODD1), (np.cumsum(counts) - counts)[full]) + counts[full].astype(U))
    return name.view("i8")


def sign(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Two kinds of rows: a row of ``docs`` (id: its set's name; doc: doc_id, row, n, and slack if it is one that signs), and a signature of
    the set ``id``."""

    def run(batches):
        bands = Bands(percent)
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                h, counts = shingle_sets(batch.column("text").fill_null(""), size)
                name = names(h, counts)
                # equal sets of a piece sign once
                once = np.zeros(len(counts), bool)
                once[np.unique(name, return_index=True)[1]] = True
                once &= counts > 0
                who, sig, slack = signatures(h[np.repeat(once, counts)], counts[once], bands)
                every = np.zeros(len(counts), np.int64)
                every[once] = slack
                doc = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(every, mask=~once)],
                                                 fields=list(DOC))
                dealt = mix(batch.column("row").to_numpy(zero_copy_only=False).view(U)).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(name), doc], names=["sig", "id", "doc"])
                owner = name[once][who]
                for i in range(0, len(sig), 1 << 19):
                    n = len(sig[i:i + (1 << 19)])
                    yield pa.RecordBatch.from_arrays([pa.array(sig[i:i + n].view("i8")), pa.array(owner[i:i + n]), pa.nulls(n, DOC)],
                                                     names=["sig", "id", "doc"])

    return _rows(docs).mapInArrow(run, "sig long, id long, " + DOC_SQL)


def _pairs(sig: np.ndarray, id_: np.ndarray, hot):
    """(pairs of sets under one signature; signatures and sets of hot ones) of whole groups, sorted by signature."""
    order = np.lexsort((id_, sig))
    sig, id_ = sig[order], id_[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (id_[1:] != id_[:-1])]
    sig, id_ = sig[new], id_[new]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[first, len(sig)])
    is_hot = (size > PAIRED) | (sig[first] == hot if hot is not None else False)
    out = []
    for z in np.unique(size[(size > 1) & ~is_hot]):
        group = id_[first[(size == z) & ~is_hot][:, None] + np.arange(z)]
        i, j = np.triu_indices(z, 1)
        out.append(np.stack([group[:, i].ravel(), group[:, j].ravel()], axis=1))
    rows = np.repeat(is_hot, size)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64), sig[rows], id_[rows]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs


def candidates(signed: DataFrame) -> DataFrame:
    """The document rows, pairs of sets under small signatures (id, other), each once a task, and sets of hot ones (id, hot:
    the signature): one shuffle of the signatures."""
    columns = ["id", "other", "hot", "doc"]

    def out(id_, other=None, hot=None):
        n = len(id_)
        return pa.RecordBatch.from_arrays([pa.array(id_, pa.int64()), pa.nulls(n, pa.int64()) if other is None else pa.array(other, pa.int64()),
                                           pa.nulls(n, pa.int64()) if hot is None else pa.array(hot, pa.int64()), pa.nulls(n, DOC)], names=columns)

    def run(batches):
        held_sig, held_id, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        held_pairs, known = [np.zeros((0, 2), np.int64)], 0

        for batch in batches:
            plain = pc.is_null(batch.column("doc"))
            docs_ = batch.filter(pc.invert(plain))
            if docs_.num_rows:
                n = docs_.num_rows
                yield pa.RecordBatch.from_arrays([docs_.column("id"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), docs_.column("doc")], names=columns)
            rows = batch.filter(plain)
            sig = np.r_[held_sig, rows.column("sig").to_numpy()]
            id_ = np.r_[held_id, rows.column("id").to_numpy()]
            if not len(sig):
                continue
            cut = int(np.searchsorted(sig, sig[-1], side="left"))  # the last group may go on
            held_sig, held_id = sig[cut:], id_[cut:]
            if cut:
                pairs, s, members = _pairs(sig[:cut], id_[:cut], hot)
                held_pairs.append(pairs)
                if len(members):
                    yield out(members, hot=s)
            if len(held_sig) > HELD:
                distinct = np.unique(held_id)
                if hot is not None and hot == held_sig[0] or len(distinct) > HELD // 2:
                    hot = held_sig[0]
                    yield out(distinct, hot=np.full(len(distinct), hot))
                    held_sig, held_id = held_sig[:0], held_id[:0]
                else:
                    held_sig, held_id = held_sig[:len(distinct)], distinct
            if sum(map(len, held_pairs)) > 2 * known + (1 << 18):
                held_pairs = [_distinct(np.concatenate(held_pairs))]
                known = len(held_pairs[0])
                if known > 1 << 20:
                    yield out(held_pairs[0][:, 0], other=held_pairs[0][:, 1])
                    held_pairs, known = [held_pairs[0][:0]], 0
        if len(held_sig):
            pairs, s, members = _pairs(held_sig, held_id, hot)
            held_pairs.append(pairs)
            if len(members):
                yield out(members, hot=s)
        last = _distinct(np.concatenate(held_pairs))
        if len(last):
            yield out(last[:, 0], other=last[:, 1])

    dealt = signed.repartition("sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(run, "id long, other long, hot long, " + DOC_SQL)


SKETCH = "id long, n long, band int, own binary, up binary"
_FIELDS = np.array([sum(1 for f in range(4) if x >> (2 * f) & 3) for x in range(256)], np.int64)


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, n, band and the sketches for the set's band and, if it signs there, the next one; ``docs``: id, text."""

    def run(batches):
        bands = Bands(percent)
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                h, counts = shingle_sets(batch.column("text").fill_null(""), size)
                x = mix(h * ODD3 + ODD1)
                band = bands.of(np.maximum(counts, 1))
                up = bands.up(counts, band)
                at = np.cumsum(counts) - counts
                made = [[], []]
                for shift in (0, 1):
                    parts = 4 * np.maximum(1, bands.k[band + shift])
                    for a, n, m, ok in zip(at.tolist(), counts.tolist(), parts.tolist(), (up if shift else np.ones(len(up), bool)).tolist()):
                        if not ok or not n:
                            made[shift].append(None)
                            continue
                        e = x[a:a + n]
                        sums = np.zeros(m, np.uint8)
                        np.add.at(sums, (e % U(m)).astype(np.int64), ((e >> U(56)).astype(np.uint8) & 3) | 1)
                        v = (sums & 3).reshape(-1, 4)
                        made[shift].append((v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(band, pa.int32()),
                                                  pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary())],
                                                 names=["id", "n", "band", "own", "up"])

    return docs.mapInArrow(run, SKETCH)


def may_link(a: dict, b: dict, percent: int) -> bool:
    """False only if the sketches refute the link."""
    if abs(a["band"] - b["band"]) > 1:
        return False
    if a["band"] > b["band"]:
        a, b = b, a
    x, y = a["own"] if a["band"] == b["band"] else a["up"], b["own"]
    if x is None or y is None:
        return False
    d = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    differ = ((d | d >> 1) & int.from_bytes(b"\x55" * len(x), "little")).bit_count()
    return differ * (100 + percent) <= (100 - percent) * (a["n"] + b["n"])


def _paired_links(pairs: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sketches do not refute."""
    cols = ["n", "band", "own", "up"]
    side = {x: sk.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols]) for x in "ab"}

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = [may_link({c: r[f"a_{c}"] for c in cols}, {c: r[f"b_{c}"] for c in cols}, percent) for r in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(run, "a long, b long")


def _reach(s: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(for every row the first one that unrefuted pairs of ``left`` and ``right`` rows join it with, a spanning forest of them)."""
    unseen, first, forest = np.ones(len(s), bool), np.arange(len(s)), []
    for root in range(len(s)):
        if not unseen[root]:
            continue
        unseen[root], front = False, [root]
        while front:
            x = front.pop()
            rest = np.flatnonzero(unseen & np.where(left[x], right, False) | unseen & np.where(right[x], left, False))
            if not len(rest):
                continue
            differ = _FIELDS[s[rest] ^ s[x]].sum(axis=1)
            hit = rest[differ * (100 + percent) <= (100 - percent) * (n[rest] + n[x])]
            unseen[hit], first[hit] = False, root
            forest.extend((x, y) for y in hit.tolist())
            front.extend(hit.tolist())
    return first, forest


def _stars(s: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join, with those of the other pairs of blocks, what unrefuted pairs of ``left`` and ``right`` rows join.

    A block with itself gives a link of each row with the first row of its part.  Two blocks only give links between
    first rows of their parts, so all pairs of a group's blocks together have about as many links as the group has rows.
    A block without an ``own`` row of the band was not compared with itself there: its rows stand for themselves."""
    if (left & right).all():
        first, _ = _reach(s, n, left, right, percent)
        return [(int(x), y) for y, x in enumerate(first) if x != y]
    _, forest = _reach(s, n, left, right, percent)
    if not forest:
        return []
    first = np.arange(len(s))
    for side in (left, right):
        if own[side].any():
            first = np.where(side, _reach(s, n, side, side, percent)[0], first)
    return sorted({(int(first[x]), int(first[y])) for x, y in forest})


def _blocked_links(members: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what the unrefuted pairs under hot signatures (cluster, id) join, compared block by block."""
    # signatures of the same sets are compared once: their number and two exclusive ors of hashes tell
    alike = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in range(2)]
    blocks = members.groupBy("cluster").agg(F.count("*").alias("sets"), *alike).where("sets > 1").groupBy("sets", "x0", "x1").agg(
        F.min("cluster").alias("cluster")).select("cluster", F.ceil(F.col("sets") / SKETCH_BLOCK).alias("blocks"))
    m = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sk, "id")
    m = _block_pairs(m, ["id", "n", "band", "own", "up"])

    def run(table: pa.Table) -> pa.Table:
        # in the order of the ids, whatever order the shuffle has: the same sets give the same links under each signature
        table = table.sort_by("id")
        id_, n, band = (table.column(c).to_numpy() for c in ("id", "n", "band"))
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        left, right = block == i, block == j
        own, up = table.column("own").to_pylist(), table.column("up").to_pylist()
        found = []
        for at in np.unique(band):
            who = np.array([k for k in range(len(id_)) if band[k] == at or band[k] == at - 1 and up[k] is not None])
            s = np.stack([np.frombuffer(own[k] if band[k] == at else up[k], np.uint8) for k in who])
            links = _stars(s, n[who], left[who], right[who], band[who] == at, percent)
            found.extend((who[x], who[y]) for x, y in links)
        return pa.table({"a": pa.array([id_[x] for x, _ in found], pa.int64()), "b": pa.array([id_[y] for _, y in found], pa.int64())})

    return m.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _block_pairs(members: DataFrame, keep: list[str]) -> DataFrame:
    """``members`` (cluster, block, blocks and ``keep``) once for every pair of blocks (i, j) of its cluster that its own is in."""
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    m = members.select(*keep, "cluster", "block", F.explode(every).alias("other"))
    return m.select(*keep, "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def links_within(h: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets flagged ``left`` and those flagged ``right``.

    Intersections are counted for the whole block at once: elements that two sets share or more, as
    columns of 0/1 matrices, some thousands at a time."""
    m = len(counts)
    owner = np.repeat(np.arange(m), counts)
    order = np.argsort(h, kind="stable")
    e, o = h[order], owner[order]
    new = np.r_[True, e[1:] != e[:-1]] if len(e) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(e) else np.zeros(0, bool)
    keep = shared[column] if len(e) else np.zeros(0, bool)
    column, o = (np.cumsum(shared) - 1)[column[keep]] if len(e) else column, o[keep]
    common = np.zeros((m, m), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[o[lo:hi], column[lo:hi] - at] = 1
        common += block @ block.T
    both = common.astype(np.int64)
    union = counts[:, None] + counts[None, :] - both
    linked = (100 * both >= percent * union) & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))
    np.fill_diagonal(linked, False)
    unseen, forest = np.ones(m, bool), []
    for root in range(m):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            x = front.pop()
            reached = np.flatnonzero(linked[x] & unseen)
            unseen[reached] = False
            forest.extend((x, int(y)) for y in reached)
            front.extend(reached.tolist())
    return forest


def labelled(docs: DataFrame, *, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, row, n, id, component: a row per row of ``docs``; ``row`` as in ``_rows``, id and component names of sets (0: an empty one)."""
    found = cut_lineage(candidates(sign(docs, size, percent)))
    signed = found.where("doc IS NOT NULL").select("id", "doc.*")
    # one row of each set stands for it
    node = cut_lineage(signed.where("n > 0").groupBy("id").agg(F.min("row").alias("row"), F.min("slack").alias("slack"), F.min("n").alias("n")))
    pairs = cut_lineage(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())
    hot = found.where("hot IS NOT NULL").select("id", F.col("hot").alias("cluster")).distinct()
    exposed = hot.groupBy("id").agg(F.count("*").alias("hot")).join(node.select("id", "slack"), "id").where("hot >= slack").select("id")
    hot = cut_lineage(hot.join(exposed, "id"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(hot.select("id")).distinct()
    sk = cut_lineage(sketches(_texts(docs, wanted.join(node.select("id", "row"), "id")), size, percent))
    maybe = _paired_links(pairs, sk, percent).unionByName(_blocked_links(hot, sk, percent))
    linked = components(_links(docs, components(maybe), node, size, percent))
    return signed.select("doc_id", "row", "n", "id").join(linked.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "doc_id", "row", "n", "id", F.coalesce("component", "id").alias("component"))


def join(docs: DataFrame, *, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, its own included), a row per row of ``docs``.

    Rows without an id take part, and a component of such rows only has a null component_id; an id with several texts has the
    component of each text in its row."""
    rows = cut_lineage(labelled(docs, size=size, percent=percent))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    # most components are one row, whose id is its own
    joined = rows.join(least.where("rows > 1").select("component", "component_id", F.lit(True).alias("several")), "component", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("several") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, *, size: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of every component: that with the smallest id (null last; ties by a hash of the text).  Rows
    whose set is empty link with nothing and all stay.

    Rows that the sieve of removed and repeated rows lets through cannot be among them and stay where they are; only the
    others are shuffled and decided exactly."""
    row_, gone_ = fresh(docs, "__row"), fresh(docs, "__gone")
    found = cut_lineage(labelled(docs, size=size, percent=percent).where("n > 0").select("doc_id", "row", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept_rows = found.groupBy("component").agg(first, F.count("*").alias("rows")).where("rows > 1")
    several = found.join(kept_rows, "component")
    gone = several.where("row <> first.row").select(F.col("row").alias(gone_)).distinct()
    repeated = kept_rows.select(F.col("first.row").alias("row"))
    words = cut_lineage(sieve(gone.select(F.col(gone_).alias("id")).unionByName(repeated.select(F.col("row").alias("id")))).coalesce(
        files_for(1 << (SIEVE_BITS - 6))))
    keyed = docs.withColumn(row_, row_of(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    clear, doubtful = (sifted(keyed, row_, words, held) for held in (False, True))
    kept = doubtful.join(gone, F.col(row_) == F.col(gone_), "left_anti")
    once = kept.join(repeated.select(F.col("row").alias(gone_)), F.col(row_) == F.col(gone_), "left_semi").dropDuplicates([row_])
    others = kept.join(repeated.select(F.col("row").alias(gone_)), F.col(row_) == F.col(gone_), "left_anti")
    return clear.select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(others.select(*docs.columns))


SIEVE_BITS = 26


def _place(id_: str) -> str:
    return f"pmod(xxhash64(`{id_}`), {1 << SIEVE_BITS}L)"


def sieve(ids: DataFrame) -> DataFrame:
    """A bitmap of the hashed ``id``s as rows (word, bits): 2^20 of them at most, 16 MB, for any number of ids.  An id
    that it does not hold is surely none of them; the fuller it is, the more others it holds too."""
    p = ids.select(F.expr(_place("id")).alias("p"))
    return p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits"))


def sifted(df: DataFrame, id_: str, words: DataFrame, held: bool) -> DataFrame:
    """Rows of ``df`` whose id the sieve holds, or does not.  The broadcast side is bounded by the sieve's size."""
    word_, bits_ = fresh(df, "__word"), fresh(df, "__bits")
    w = words.select(F.col("word").alias(word_), F.col("bits").alias(bits_))
    j = df.join(F.broadcast(w), F.expr(f"shiftright({_place(id_)}, 6)") == F.col(word_), "left")
    bit = F.expr(f"coalesce(shiftrightunsigned(`{bits_}`, CAST({_place(id_)} & 63 AS INT)) & 1L, 0L)")
    return j.where(bit == (1 if held else 0)).select(*[F.col(f"`{c}`") for c in df.columns])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (row and other columns) with the text of each row, once.  Texts of other rows are left behind before the shuffle."""
    texts = sifted(_rows(docs).select("row", "text"), "row", sieve(wanted.select(F.col("row").alias("id"))), True)
    return wanted.join(texts.groupBy("row").agg(F.min("text").alias("text")), "row").drop("row")


def _links(docs: DataFrame, clusters: DataFrame, node: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that join what links join inside the candidate clusters.

    First every set of a cluster is checked against that with the smallest name, whose text goes to each block of the cluster.
    The sets left over are checked against all sets of the cluster: every pair of their blocks and the cluster's blocks is
    one group, and only a spanning forest of the links leaves it."""
    member = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).unionByName(
        clusters.select(F.col("component").alias("id"), F.col("component").alias("cluster")).distinct()).join(node.select("id", "row", "n"), "id")

    def blocks(of):
        return F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ELEMENTS)).alias(of)

    weight = member.groupBy("cluster").agg(blocks("blocks"))
    member = member.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    member = cut_lineage(_texts(docs, member))

    def verify(table: pa.Table) -> pa.Table:
        h, counts = shingle_sets(table.column("text").combine_chunks(), size)
        left = table.column("left").to_numpy(zero_copy_only=False)
        found = links_within(h, counts, left, ~left, percent) if "both" not in table.column_names else links_within(
            h, counts, left, table.column("both").to_numpy(zero_copy_only=False), percent)
        id_ = table.column("id").to_numpy()
        return pa.table({"a": pa.array([id_[x] for x, _ in found], pa.int64()), "b": pa.array([id_[y] for _, y in found], pa.int64())})

    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    is_first = F.col("id") == F.col("cluster")
    firsts = member.where(is_first).select("cluster", "id", "text", F.explode(every).alias("block"), F.lit(True).alias("left"))
    others = member.where(~is_first).select("cluster", "id", "text", "block", F.lit(False).alias("left"))
    star = cut_lineage(firsts.unionByName(others).groupBy("cluster", "block").applyInArrow(verify, "a long, b long"))

    done = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    rest = member.where(~is_first).select("cluster", "id", "n").join(done, "id", "left_anti")
    rest = rest.join(rest.groupBy("cluster").agg(blocks("rests")), "cluster").withColumn("rest", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rests")))
    rest = cut_lineage(rest.select("cluster", "id", "rests", "rest"))
    open_ = member.join(rest.select("cluster", "rests").distinct(), "cluster").join(rest.select("id", "rest"), "id", "left")
    every_rest = F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)
    # a row goes to its block for each block of the rest, and if it is of the rest, to each block of the cluster
    side = F.array_distinct(F.concat(F.transform(every_rest, lambda r: F.struct(F.col("block").alias("i"), r.alias("j"))),
                                     F.when(F.col("rest").isNull(), F.array().cast("array<struct<i:long,j:long>>")).otherwise(
                                         F.transform(every, lambda i: F.struct(i.alias("i"), F.col("rest").alias("j"))))))
    spread = open_.select("cluster", "id", "text", "block", "rest", F.explode(side).alias("x")).select(
        "cluster", "id", "text", F.col("x.i").alias("i"), F.col("x.j").alias("j"),
        F.coalesce(F.col("rest") == F.col("x.j"), F.lit(False)).alias("left"), (F.col("block") == F.col("x.i")).alias("both"))
    more = spread.groupBy("cluster", "i", "j").applyInArrow(verify, "a long, b long")
    return star.unionByName(more)
