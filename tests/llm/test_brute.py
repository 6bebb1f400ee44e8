"""Operators that SQL does not express, against brute force, libraries and round trips."""
import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdure.llm import jaccard, licenses, mixing, ppm, sentencepieces, simhash, tokens, warc
from verdure.llm.hashing import ChunkTable, Lookup, run_hashes, word_hashes

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "  a", "a ", "▁", "a▁b", " ▁ x", "\n\n x\n", "é日本 語\t\x00\x1f ok", "　 a", "a" * 3000 + " b", "  \n  ", "it's we'll  x",
       "same text twice", "same text twice", "a <|endoftext|> b<|endoftext|>", "Straße İstanbul K"]


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def small(spark, sf, n=None):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    return d if n is None else d.head(n)


# ------------------------------------------------------------------ words
def test_word_hashes_tell_words_apart():
    texts = ["The the  THE\tcat", "", None, "cat\x0b" + "x" * 200 + " " + "x" * 199, "é É"]
    h, n = word_hashes(pa.array(texts))
    assert n.tolist() == [4, 0, 0, 3, 2]
    words = [w for t in texts for w in WORD.findall((t or "").translate(AZ))]
    assert len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i, j in combinations(range(len(words)), 2))


def test_lookup_finds_every_key():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    values = rng.normal(size=len(keys))
    order = rng.permutation(len(keys))
    assert (Lookup(keys[order], values[order])(keys) == values).all()

@pytest.mark.parametrize("bits,limit", [(64, 1 << 20), (2, 1 << 20), (0, 1 << 20), (64, 3), (2, 0)])
def test_chunks_that_share_a_hash_keep_their_own_ids(monkeypatch, bits, limit):
    monkeypatch.setattr("verdure.llm.hashing.run_hashes", lambda *a: run_hashes(*a) & np.uint64((1 << bits) - 1))
    asked = []

    def ask(chunks):
        asked.extend(chunks)
        return [[len(c), f, *c] for c, f in chunks]

    table = ChunkTable("<u4", ask, limit=limit)
    rng = np.random.default_rng(5)
    for _ in range(4):
        chunks = [(bytes(rng.integers(97, 99, rng.integers(1, 5), dtype=np.uint8)), int(rng.integers(0, 2))) for _ in range(300)]
        length = np.array([len(c) for c, _ in chunks])
        ids, size = table.encode(np.frombuffer(b"".join(c for c, _ in chunks), np.uint8), np.cumsum(length) - length,
                                 np.array([f for _, f in chunks]))
        assert size.tolist() == (length + 2).tolist()
        assert ids.tolist() == [i for c, f in chunks for i in (len(c), f, *c)]
    if bits == 64 and limit > 1000:
        assert len(asked) == len(set(asked))
    assert table.encode(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []



# ------------------------------------------------------------------ op2
def brute_ppm(docs, held):
    tokens_seen, trie = Counter(), {}
    for i, t in docs:
        if not held(i):
            tokens_seen.update([*WORD.findall(t), None])
            b = [-2] * ppm.ORDER + list(t.encode()) + [-1]
            for p in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    trie.setdefault(tuple(b[p - k:p]), Counter())[b[p]] += 1

    def share(context, symbol):
        """Probability by the definition: excluded symbols are kept as a set."""
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in trie.get(tuple(context[len(context) - k:]), {}).items() if s not in excluded}
            if c:
                whole = sum(c.values()) + len(c)
                if symbol in c:
                    return p * c[symbol] / whole
                p *= len(c) / whole
                excluded |= set(c)
        return p / (ppm.SYMBOLS - len(excluded))

    return tokens_seen, share


@pytest.mark.parametrize("case", ["table", "odd", "untrained"])
def test_ppm_matches_brute_force(spark, sf, case):
    if case == "table":
        d = small(spark, sf, 40)
        pairs = list(zip(d.doc_id.tolist(), d.text.tolist()))
    elif case == "odd":
        pairs = [*enumerate(ODD), (3, "again"), (None, "no id"), (None, None)]
    else:
        pairs = [(i, "abc abc") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    clean = [(i, (t or "").translate(AZ)) for i, t in pairs]

    def held(i):
        return zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2

    seen, share = brute_ppm(clean, held)
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in clean:
        w = [*WORD.findall(t), None]
        b = [-2] * ppm.ORDER + list(t.encode()) + [-1]
        want.append((-1 if i is None else i, held(i), len(w), sum(seen[x] > 0 for x in w), n,
                     sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w),
                     sum(math.log10(share(b[:p], b[p])) for p in range(ppm.ORDER, len(b)))))
        want[-1] += (-want[-1][-1] / math.log10(2) / (len(t.encode()) + 1),)
    got = ppm.score(spark.createDataFrame(pairs, "doc_id long, text string"), bucket_bytes=20_000).toPandas()
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    a = sorted(got.itertuples(index=False, name=None))
    for x, y in zip(a, sorted(want), strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_ppm_bits_tell_repeated_texts_whatever_their_length(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    own = ["".join(rng.choice(letters, int(n))) for n in rng.integers(300, 3000, 60)]
    copied = ["".join(rng.choice(letters, n)) for n in (400, 3000)] * 12
    got = ppm.score(docs_of(spark, [*own, *copied]).selectExpr("*", "1 AS key", "2 AS n", "3 AS bucket", "4 AS score")).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert held.bits_per_byte[held.index >= 60].max() < held.bits_per_byte[held.index < 60].min()
    assert (got.score[60::2].nunique(), got.bits_per_byte[61::2].nunique()) == (1, 1)


def test_ppm_probabilities_add_up_to_one():
    texts = pa.array(["abracadabra", "a cadabra", "abba"])
    grams, _ = ppm._positions(texts)
    keys, n = ppm._counted(grams, np.ones(len(grams), bool))
    base = ppm._base(*ppm._merged([(keys & np.uint64((1 << (8 * ppm.LOW)) - 1), n)]))
    for context in np.unique(keys >> np.uint64(8))[:8]:
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        p = 10 ** ppm.code_lengths(every, ppm.Trie(keys, n, ppm.LOW), base)
        # 256 byte values stand for 257 symbols here (the end is one of them), so one uniform share is missing
        assert 0.9 < p.sum() <= 1 + 1e-9


# ------------------------------------------------------------------ op4
def test_warc_round_trip_with_awkward_pages(spark):
    sep = "x\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "u", sep), (2, "u", sep), (2, "u", sep), (None, None, None), (None, None, sep), (3, "a\r\nb", ""),
            (4, "é", "é" * 600_000), (5, "v", "short"), (6, "v", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS copy")
    got = warc.round_trip(pages).toPandas()
    assert got.complete.all() and got.verified.all()
    newest = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 1000:
            newest[h] = max(newest.get(h, -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        m = newest.get(h)
        revisit = m is not None and m != p
        want.append((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if revisit else "response", m if revisit else None))
    key = [tuple(None if pd.isna(v) else v for v in r[:5]) for r in got.itertuples(index=False, name=None)]
    assert Counter(key) == Counter(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_can_be_read_alone(spark, tmp_path):
    """One gzip member a record at the place the index gives; archives end by bytes; revisits name their response's record."""
    import gzip

    body = "".join(f"<p>{i * 7919 % 9973}</p>" for i in range(400))
    rows = [(i, f"http://x.org/{i}", f"{i} {body[i:]}" if i % 3 else body) for i in range(60)] + [(59, "http://x.org/b\nb", "small"), (57, "http://x.org/c", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS main", "3 AS type")
    folder = warc.write(pages, f"file://{tmp_path}/a", bytes_per_file=4000)
    found = warc.index(spark, folder).collect()
    by_id = {}
    for r in found:
        head, block = warc.read_record(r.path, r.main_start, r.main_length)
        assert head["WARC-Record-ID"] == r.record_id and head["WARC-Type"] == r.type and int(head["X-Page-ID"]) == r.page_id
        by_id[r.record_id] = head, block.split(b"\r\n\r\n", 1)[1].decode()
        raw = open(r.path.replace("file://", ""), "rb").read()
        kinds = [h["WARC-Type"] for h, _ in warc._parse(raw[r.start:r.start + r.length])]
        assert kinds == ["request", r.type, "metadata"] and gzip.decompress(raw[r.start:r.start + r.length]).count(b"WARC/1.1\r\n") == 3
    assert Counter((h["WARC-Type"], p) for h, p in by_id.values() if h["WARC-Type"] == "response") == Counter(
        {**{("response", f"{i} {body[i:]}"): 1 for i in range(60) if i % 3}, ("response", body): 2, ("response", "small"): 1})
    revisits = [h for h, _ in by_id.values() if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 19 and {h["WARC-Refers-To-Target-URI"] for h in revisits} == {"http://x.org/c"}
    assert all(by_id[h["WARC-Refers-To"]][0]["X-Page-ID"] == h["X-Refers-To-Page"] == "57" for h in revisits)
    ends = Counter()
    for r in found:
        ends[r.path] = max(ends[r.path], r.start)
    assert len(ends) > 4 and max(ends.values()) < 4000
    whole = warc.captures(warc.read_records(spark, folder)).collect()
    assert len(whole) == len(rows) and all(r.records == 3 for r in whole)
    with pytest.raises(ValueError):
        list(warc._parse(gzip.compress(b"x" * 100)[:-9]))


def test_warc_archives_read_by_several_gzip_members():
    import gzip
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc._parse(gzip.compress(record * 2) + gzip.compress(record))] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(warc._parse(gzip.compress(record[:-8])))


# ------------------------------------------------------------------ op5
def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 30)]
    fps = set(base)
    for b in base:
        for k in range(1, 6):
            f = b
            for bit in rng.choice(64, k, replace=False).tolist():
                f ^= 1 << bit if bit < 63 else -(1 << 63)
            fps.add(f)
    index = spark.createDataFrame([(f, 1) for f in fps], "fp long, docs long")
    queries = spark.createDataFrame([(f,) for f in base], "fp long")
    for radius in (0, 1, 3):
        got = {(r.q, r.fp) for r in simhash.within(queries, index, radius).collect()}
        want = {(a, b) for a in base for b in fps if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
        assert got == want


def test_simhash_odd_rows(spark):
    texts = [*ODD, "w " * 50, "w " * 50]
    ids = [*range(len(ODD)), 7, None]
    d = docs_of(spark, texts, ids).selectExpr("*", "1 AS id", "2 AS h", "'x' AS t")
    got = simhash.edited_fingerprints(d).toPandas()
    assert len(got) == len(texts)
    by_text = {}
    for r in got.itertuples():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t in zip(ids, texts):
        if i is not None and i != 7:
            by_text.setdefault(t or "", set()).add(got[got.doc_id == i].fingerprint.iloc[0])
    assert all(len(v) == 1 for v in by_text.values())
    assert simhash.edited_fingerprints(d.limit(0)).count() == 0
    one = simhash.edited_fingerprints(docs_of(spark, ["just one text here"])).toPandas()
    assert one.near_next.tolist() == [1.0]


# ------------------------------------------------------------------ op6
@pytest.mark.parametrize("case", ["table", "odd"])
def test_token_files_hold_the_library_ids(spark, sf, case):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    if case == "table":
        d = small(spark, sf, 60)
        ids, texts = d.doc_id.tolist(), d.text.tolist()
    else:
        ids, texts = list(range(100, 100 + len(ODD))), ODD
    manifest = tokens.write(docs_of(spark, texts, ids), path, sequence=64, shards=3)
    got = tokens.read_documents(manifest).toPandas().sort_values("doc_id")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    coded = [lib.encode(texts[i] or "", add_special_tokens=False).ids + [0] for i in order]
    n = [len(c) for c in coded]
    assert got.doc_id.tolist() == [ids[i] for i in order]
    assert got.n_tokens.tolist() == n
    assert got.start.tolist() == [sum(n[:k]) for k in range(len(n))]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in coded]
    flat = []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        for a, mask in tokens.sequences(re.sub("^file:/+", "/", r.path)):
            assert a.shape == mask.shape == (64,)
            flat.extend(a[mask].tolist())
    assert flat == [x for c in coded for x in c]


def test_token_files_ties_nulls_and_no_rows(spark):
    path = P.path("byte_bpe_50k.json")
    got = tokens.read_documents(tokens.write(docs_of(spark, ["b", "a", "a", None, "x"], [5, 5, 5, None, None]), path)).toPandas()
    assert got.doc_id.isna().sum() == 2 and (got.doc_id == 5).sum() == 3
    assert got.sort_values("start").start.tolist() == (got.sort_values("start").n_tokens.cumsum() - got.sort_values("start").n_tokens).tolist()
    assert tokens.read_documents(tokens.write(docs_of(spark, ["x"]).limit(0), path)).count() == 0


def test_token_sequences_lie_at_computable_places(spark):
    """Batches of one size, whatever the texts' lengths; sequence k by index, as views of the memory map."""
    path = P.path("byte_bpe_50k.json")
    texts = ["w " * 9000, "short", "", "é x " * 4000, *["some words here " * (i % 40) for i in range(300)]]
    manifest = tokens.write(docs_of(spark, texts), path, sequence=32, rows=16, shards=2).collect()
    for r in manifest:
        name = re.sub("^file:/+", "/", r.path)
        file = tokens.SequenceFile(name)
        n = file.reader.num_record_batches
        assert len(file) == r.n_sequences == -(-r.n_tokens // 32) and n == -(-len(file) // 16)
        assert all(file.reader.get_batch(i).num_rows == 16 for i in range(n - 1))
        one_by_one = [file[k] for k in range(len(file))]
        assert all((a == b).all() and (m == w).all() for (a, m), (b, w) in zip(one_by_one, tokens.sequences(name), strict=True))
        assert sum(int(m.sum()) for _, m in one_by_one) == r.n_tokens and all(m.all() for _, m in one_by_one[:-1])
        assert (file[-1][0] == one_by_one[-1][0]).all()
        with pytest.raises(IndexError):
            file[len(file)]
        whole = file.map.size()
        file.map.seek(0)
        start = file.map.read_buffer(whole).address
        assert all(start <= a.ctypes.data < start + whole for a, _ in one_by_one)
        assert len({m.ctypes.data for _, m in [file[0], file[1]]}) == 1 and not file[0][0].flags.writeable


# ------------------------------------------------------------------ op8
def split_ids(coded):
    ids, n = coded
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def test_agenda_equals_library(spark, sf):
    c = sentencepieces.codec(P.path("piece_bpe_32k.model"))
    texts = [*small(spark, sf).text.tolist(), *(t or "" for t in ODD), "▁▁", "  ▁", " "]
    want = [[c.lib.bos_id(), *c.lib.encode(t), c.lib.eos_id()] for t in texts]
    assert split_ids(c.encode(pa.array(texts))) == want
    c.table.limit = 10  # a table that starts anew with every block gives the same ids
    assert [split_ids(c.encode(pa.array([t])))[0] for t in texts] == want
    c.table.limit = 2_000_000


def test_chunked_encoder_equals_library(spark, sf):
    e = tokens.encoder(P.path("byte_bpe_50k.json"))
    blanks = ["\u0085", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\x1c", "\x1f", "\t", "\n", " ", "“", "…", "é"]
    texts = [*small(spark, sf).text.tolist(), *(t or "" for t in ODD), *(f"a{x} {y}b {x} {y} c{x}" for x in blanks for y in blanks)]
    want = [e.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert split_ids(e.encode(pa.array(texts))) == want
    assert split_ids(e.encode(pa.array([], pa.string()))) == []


def test_sentencepiece_columns(spark):
    path = P.path("piece_bpe_32k.model")
    d = docs_of(spark, ODD).selectExpr("*", "'clash' AS __text", "3 AS n_chars")
    lib = sentencepieces.codec(path).lib
    got = sentencepieces.encode(d, path).collect()
    assert len(got) == len(ODD)
    for r in got:
        t = ODD[r.doc_id]
        ids = [lib.bos_id(), *lib.encode(t or ""), lib.eos_id()]
        assert r.piece_ids == ids and r["__text"] == "clash"
        assert r.text == (None if t is None else lib.decode(ids))
    for r in sentencepieces.digests(d, path).collect():
        ids = [lib.bos_id(), *lib.encode(ODD[r.doc_id] or ""), lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


# ------------------------------------------------------------------ op10
def shingles(text, size):
    w = WORD.findall((text or "").translate(AZ))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return sets, label


def near_texts(seed, n=120):
    """Groups of texts whose similarity to each other lies around the threshold, short and long."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n // 6):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.choice([3, 9, 12, 14, 25, 60, 200])))]
        for k in range(6):
            copy = list(words)
            for _ in range(int(rng.integers(0, 3)) * max(1, len(words) // 60)):
                copy[int(rng.integers(0, len(copy)))] = f"v{rng.integers(0, 5000)}"
            texts.append(" ".join(copy if k else words))
    return texts


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, size, percent):
    texts = [*near_texts(size), *ODD, "One two", "one TWO", "one"]
    sets, label = brute_components(texts, size, percent)
    got = jaccard.join(docs_of(spark, texts), size=size, percent=percent).toPandas().set_index("doc_id")
    assert got.n_shingles.reindex(range(len(texts))).tolist() == [len(s) for s in sets]
    assert got.component_id.reindex(range(len(texts))).tolist() == label


def test_signatures_meet_for_every_link():
    """Completeness of the signatures themselves, many sets, without Spark."""
    for seed in range(4):
        texts = pa.array(near_texts(seed, 360))
        h, n = jaccard.shingle_sets(texts, 3)
        ends = np.cumsum(n)
        sets = [frozenset(h[e - c:e].tolist()) for e, c in zip(ends, n)]
        who, sig, slack = jaccard.signatures(h, n, jaccard.Bands(90))
        own = [set() for _ in sets]
        for w, s in zip(who.tolist(), sig.tolist()):
            own[w].add(s)
        for i, j in combinations(range(len(sets)), 2):
            a, b = sets[i], sets[j]
            if a and a != b and 100 * len(a & b) >= 90 * len(a | b):
                assert len(own[i] & own[j]) >= max(1, min(slack[i], 1 << 20), min(slack[j], 1 << 20)), (len(a), len(b))


def test_jaccard_blocks_of_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1:]]) for i in range(0, 120, 3)]
    _, label = brute_components(texts, 3, 90)
    got = jaccard.join(docs_of(spark, texts)).toPandas().set_index("doc_id").component_id
    assert got.reindex(range(len(texts))).tolist() == label


def test_jaccard_of_texts_that_quote_one_passage(spark, monkeypatch):
    """Signatures of a common passage are hot; copies of such texts still meet, whether they are exposed to them or not."""
    rng = np.random.default_rng(31)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(90):
        own = [f"o{i}_{k}" for k in range([3, 40, 200][i % 3])]
        at = int(rng.integers(0, len(own)))
        whole = own[:at] + passage + own[at:]
        texts.append(" ".join(whole))
        if i % 4 == 0:
            whole[int(rng.integers(len(whole)))] = "edit"
            texts.append(" ".join(whole))
    monkeypatch.setattr(jaccard, "PAIRED", 3)
    monkeypatch.setattr(jaccard, "HELD", 50)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 20)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    sets, label = brute_components(texts, 5, 80)
    got = jaccard.join(docs_of(spark, texts).repartition(7), size=5, percent=80).toPandas().set_index("doc_id").component_id
    assert len(set(label)) < 90 and got.reindex(range(len(texts))).tolist() == label


def test_jaccard_links_under_hot_signatures_are_few_and_whole(spark, monkeypatch):
    """Ten hot signatures of nearly the same 100 near copies: about a link a set, whatever the order of the rows and the number of
    blocks.  Among sets of several bands, whose sketches agree for some, every unrefuted pair stays joined."""
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 20)
    schema = "cluster long, id long"

    def links(members, sk):
        shuffled = members.orderBy(F.rand(7))
        return {tuple(r) for r in jaccard._blocked_links(shuffled, spark.createDataFrame(sk, jaccard.SKETCH), 80).collect()}

    copies = [(i, 40, 5, bytes([85] * 4), None) for i in range(100)]
    found = links(spark.createDataFrame([(c, i) for c in range(10) for i in range(100) if i != 7 * c], schema), copies)
    assert 99 <= len(found) <= 250 and set(brute_of(100, found)) == {0}

    rng = np.random.default_rng(3)
    kinds = [bytes(rng.integers(0, 256, 4).tolist()) for _ in range(40)]
    several = [(i, 40, 5 + i % 3 % 2, kinds[i * 7 % 40], kinds[i * 11 % 40] if i % 2 else None) for i in range(150)]
    found = links(spark.createDataFrame([(0, i) for i in range(150)], schema), several)
    rows = [dict(zip(("id", "n", "band", "own", "up"), r)) for r in several]
    label = brute_of(150, found)
    pairs = {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and jaccard.may_link(a, b, 80)}
    assert len(pairs) > 100 and len(set(label)) > 5 and all(label[a] == label[b] for a, b in pairs)


def brute_of(n, links):
    """The smallest number that links join each of ``n`` with."""
    label = list(range(n))
    while True:
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_jaccard_ids_of_any_size_and_several_texts(spark):
    t, u = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    big = 1 << 62
    d = docs_of(spark, [t, t + " end", u, u, u + " end", u, "c c c", "", "", None], [big + 5, big + 12, -1 << 63, (1 << 63) - 1, 1, 1, 1, 7, 7, 8])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect())
    low = -1 << 63
    assert got == sorted([(big + 5, 38, big + 5), (big + 12, 39, big + 5), (low, 38, low), ((1 << 63) - 1, 38, low), (1, 39, low), (1, 38, low),
                          (1, 1, 1), (7, 0, 7), (7, 0, 7), (8, 0, 8)])
    kept = jaccard.deduplicate(d).toPandas()
    # one of the two groups each, the other text of id 1, and rows without words
    assert sorted(zip(kept.doc_id, kept.text.fillna("-"))) == sorted([(big + 5, t), (low, u), (1, "c c c"), (7, ""), (7, ""), (8, "-")])


def test_jaccard_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    texts = [" ".join(words), " ".join([*words[:100], "x", *words[101:]]), "x" * 2_000_000, "x" * 2_000_000 + " y"]
    got = jaccard.join(docs_of(spark, texts)).toPandas().set_index("doc_id")
    assert got.component_id.reindex(range(4)).tolist() == [0, 0, 2, 3] and got.n_shingles[0] == 149_998


def test_jaccard_null_ids_and_repeats(spark):
    t = " ".join(f"a{i}" for i in range(40))
    u = " ".join(f"b{i}" for i in range(40))
    d = docs_of(spark, [t, t, t, u, u, None, None], [9, 4, None, None, None, None, 3])
    got = jaccard.join(d).toPandas()
    assert len(got) == 7
    assert got[got.doc_id == 9].component_id.tolist() == [4]
    assert sorted(got[got.doc_id.isna()].component_id.fillna(-1).tolist()) == [-1, -1, -1, 4]
    kept = jaccard.deduplicate(d.selectExpr("*", "1 AS __id", "2 AS component"))
    assert kept.columns == ["doc_id", "text", "__id", "component"]
    rows = kept.toPandas()
    assert (rows.text == t).sum() == 1 and (rows.text == u).sum() == 1 and rows[rows.text == t].doc_id.tolist() == [4]
    assert jaccard.join(d.limit(0)).count() == 0


# ------------------------------------------------------------------ ids
def test_the_least_long_is_an_id_like_others(spark):
    low = -1 << 63
    texts = ["one text of some words", "another text of words", "one text of some words", "third"]
    got = {(r.doc_id, r.n_chars) for r in simhash.edited_fingerprints(docs_of(spark, texts, [low, None, low + 1, 100])).collect()}
    assert got == {(low, 22), (None, 21), (low + 1, 22), (100, 5)}
    page = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(low, "u", page), (None, "u", page), (None, "u", "s"), (low, "u", "s")], "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert rows == sorted([(low, 2003, "response", None), (None, 2003, "revisit", low), (None, 1, "response", None), (low, 1, "response", None)], key=str)
    mit = "Released under the MIT License."
    files = spark.createDataFrame([(low, "a/LICENSE", mit), (None, "a/LICENSE", mit), (-1 << 62, "b/x", "t"), (None, "a/y", "t")], "doc_id long, path string, text string")
    assert sorted(((r.doc_id, r.path, r.license) for r in licenses.scan(files).collect()), key=str) == sorted(
        [(low, "a/LICENSE", "MIT"), (None, "a/LICENSE", "MIT"), (-1 << 62, "b/x", None), (None, "a/y", "MIT")], key=str)


def test_rows_without_ids_spread_over_buckets(spark, monkeypatch):
    seen = []
    whole = mixing.cut_lineage
    monkeypatch.setattr(mixing, "cut_lineage", lambda df: seen.append(whole(df)) or seen[-1])
    d = spark.range(6000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('word ', id) AS text", "'s' AS source")
    assert mixing.plan(d, docs_per_bucket=200).count() == 6000
    per_bucket = next(x for x in seen if "b_bucket" in x.columns)
    assert per_bucket.count() >= 25


def test_very_long_texts(spark):
    """One text of megabytes among short ones: simhash, PPM, tokens, pieces."""
    long = " ".join(f"w{i % 9000}" for i in range(200_000)) + "y" * 100_000
    d = docs_of(spark, [long, "short text", long, ""]).selectExpr("*", "1 AS fp", "2 AS h")
    got = {r.doc_id: r for r in simhash.edited_fingerprints(d).collect()}
    assert got[0].fingerprint == got[2].fingerprint and got[0].n_chars == len(long)
    scores = {r.doc_id: r for r in ppm.score(d).collect()}
    assert scores[0].n_tokens == len(WORD.findall(long)) + 1 and scores[0].score == scores[2].score
    ids = {r.doc_id: r for r in tokens.read_documents(tokens.write(d, P.path("byte_bpe_50k.json"), special_as_text=False)).collect()}
    assert ids[0].ids_crc32 == ids[2].ids_crc32 and ids[3].n_tokens == 1
    back = {r.doc_id: r for r in sentencepieces.digests(d, P.path("piece_bpe_32k.model")).collect()}
    lib = sentencepieces.codec(P.path("piece_bpe_32k.model")).lib
    assert back[0].n_tokens == len(lib.encode(long)) + 2
