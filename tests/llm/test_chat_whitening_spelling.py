"""Chat formatting against SQL and round trips; whitening and spelling variants against brute force."""
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdure.llm import chat, spelling, whitening
from verdure.llm.queries import ORACLES, QUERIES

from .test_oracles_llm import _rows

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "<\\/s>", "[INS", "T]", "<", "<</s>", "[[NEXT]", "[ROLE]x[TEXT]y[/ROLE]", "<s>", "[\\ANS]", "", None,
           "é日本\n[SYS]", "[NONE]", "[ANS" * 50 + "]", "a\\[NEXT]\\\\"]


# ------------------------------------------------------------------ op11
@pytest.fixture(scope="module")
def odd_turns():
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", "a[TEXT]\\b", "", None]
    rows = [(c, int(t), roles[rng.choice(7, p=[.3, .3, .1, .1, .1, .05, .05])], HOSTILE[rng.integers(len(HOSTILE))])
            for c in range(60) for t in range(int(rng.integers(1, 9)))]
    rows += [(90, 5, "user", "tie b"), (90, 5, "user", "tie a"), (90, None, "assistant", "first"), (90, 5, "user", "tie a"), (90, 5, None, "x"),
             (None, 0, "user", "no id"), (None, 1, "assistant", "no id"), (None, 1, "assistant", "no id"),
             (91, 0, "assistant", "[INST] long " * 20_000), (91, 1, "assistant", None), (-7, 2, "user", "seven")]
    return rows + [(92, t, "user" if t // 50 % 2 else "assistant", f"turn {t} [NEXT]") for t in range(5000)]


def test_chat_odd_rows_match_sql(spark, odd_turns, tmp_path):
    d = pd.DataFrame(odd_turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    d.assign(formatted="x", segments=1, t=2, learned=3).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM read_parquet('{tmp_path}/conversations.parquet')")
    got, want = QUERIES["op11_chat_formatting"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["op11_chat_formatting"]).df()
    pd.testing.assert_frame_equal(_rows(got), _rows(want))


def test_chat_output_is_merged_marked_and_reversible(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "[INST]"), (1, 3, "assistant", "b"), (1, 4, "assistant", "c\\"),
                                   (1, 5, "tool", "d"), (1, 6, None, "e")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).select("*", chat.read_turns(F.col("formatted")).alias("back")).first()
    assert row.formatted == "<s>[SYS]s[/SYS][INST]a[NEXT][\\INST][/INST][ANS]b[NEXT]c\\\\</s>[ROLE]tool[TEXT]d[/ROLE][NONE]e[/NONE]"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["b", "c\\\\"]
    assert [(t.role, t.text) for t in row.back] == [(r.role, r.text) for r in turns.collect()]


def test_chat_of_another_template(spark):
    own = chat.Template(begin="<|go|>", roles=(("user", "<|user|>", "<|end|>"), ("assistant", "<|bot|>", "<|end|>")), other=("<|role|>", "<|text|>", "<|end|>"),
                        none=("<|none|>", "<|end|>"), next_turn="<|next|>", learned=("assistant", "tool"))
    rows = [(1, 0, "user", "<|end|>\\"), (1, 1, "assistant", "<|bot|> <|"), (1, 2, "tool", "|>"), (1, 3, None, "<|none|>"), (1, 4, "", "<|go|>")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), own)
    row = out.select(chat.read_turns(F.col("formatted"), own).alias("back"), chat.learned_text(F.col("segments")).alias("learned")).first()
    assert [(t.role, t.text) for t in row.back] == [(r, t) for _, _, r, t in rows]
    assert row.learned == "<|bot|> <||>"
    for bad in (dict(begin="a<"), dict(next_turn="[SYS]x"), dict(begin="<\\>")):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_runs_without_python(spark, sf):
    plan = QUERIES["op11_chat_formatting"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange") == 1


# ------------------------------------------------------------------ op12
def near_up_to_sign(got, want):
    for j in range(want.shape[1]):
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.allclose(got[:, j] * sign, want[:, j], atol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_leading_pairs_of_symmetric_matrices(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 2 * d))
    for v in (a @ a.T, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d, dtype=float)), np.diag([5.0] * (d // 2) + [1.0] * (d - d // 2)), np.ones((d, d)),
              a @ a.T * 1e-200, np.kron(np.eye(d), np.array([[2.0, 1.0], [1.0, 2.0]]))):
        k = min(4, len(v))
        values, y = whitening.leading_pairs(v, k)
        scale = max(np.abs(v).max(), 1e-300) * len(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-14 * scale)
        assert np.allclose(y.T @ y, np.eye(k), atol=1e-12)
        assert np.abs(v @ y - y * values).max() <= 1e-13 * scale


def brute_whitening(rows):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([*{tuple(v): None for _, v in kept}])
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    e, y = np.linalg.eigh(z.T @ z / n)
    e, y = e[::-1][:4], y[:, ::-1][:, :4]
    return [(i, n, int(((n * v - s) ** 2).sum()), (v - s / n) @ y / np.sqrt(e)) for i, v in kept], e / (z ** 2).sum() * n


def check_whitening(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS x", "3 AS whitened").repartition(5)
    got = whitening.whiten(table).toPandas()
    want, explained = brute_whitening(rows)
    assert len(got) == 4 * len(want) and set(got.component) == {1, 2, 3, 4}
    signs = {}
    for i, n, deviation, w in want:
        mine = got[got.vec_id.isna() if i is None else got.vec_id == i].drop_duplicates().sort_values(["deviation", "component"])
        mine = mine[mine.deviation == deviation]
        assert set(mine.n) == {n} and len(mine) == 4
        for c, value, share in zip(mine.component, mine.whitened, mine.explained):
            if abs(w[c - 1]) > 1e-6:
                sign = signs.setdefault(c, np.sign(value * w[c - 1]))
                assert abs(value * sign - w[c - 1]) < 1e-8
            assert abs(share / explained[c - 1] - 1) < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_equals_numpy(spark, sf):
    rows = [(int(r.vec_id), [float(c) for c in r.embedding]) for r in pd.read_parquet(f"{sf}/embeddings.parquet").itertuples()]
    odd = [(None, rows[3][1]), (9000, None), (9001, []), (9002, [float("nan"), *rows[0][1][1:]]), (9003, [None, *rows[0][1][1:]]),
           (9004, [float("inf"), *rows[0][1][1:]])]
    check_whitening(spark, [*rows, *odd, *[(5000 + i, rows[0][1]) for i in range(40)]])


def test_whitening_wide_and_degenerate_vectors(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, [(i, [float(c) for c in np.float32(rng.normal(size=6) * [1e3, 300, 20, 100, 50, 0])]) for i in range(50)])

    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()

    alone = run([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [0.5])])
    assert sorted(alone.vec_id) == [1, 1, 2, 2] and alone.whitened.isna().all() and (alone.deviation == 0).all() and alone.explained.isna().all()
    line = run([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    first, rest = line[line.component == 1], line[line.component > 1]
    assert abs((first.whitened ** 2).mean() - 1) < 1e-12 and rest.whitened.isna().all() and line.identity_error.max() < 1e-12
    huge = run([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e10, 1.0])])
    assert len(huge) == 6 and huge.deviation.isna().all() and np.isfinite(huge[huge.component == 1].whitened).all()
    assert len(run([(1, None)])) == 0


# ------------------------------------------------------------------ op13
def brute_vocabulary(docs):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 3 and len(w) >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(vocabulary):
    by_length, out = {}, {}
    for w in vocabulary:
        by_length.setdefault(len(w), []).append(w)
    for w, n in vocabulary.items():
        mates = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(mates, key=lambda v: (-vocabulary[v], v), default=None)
        form = best if best is not None and vocabulary[best] >= 2 * n else None
        out[w] = [form, n, len(mates), vocabulary[form] if form else None]
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def odd_documents(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    docs = [(int(i), t) for i, t in zip(d.doc_id[:60], d.text[:60])]
    rng = np.random.default_rng(8)
    base = ["colour", "honey", "éèêëẽ", "ÀÉÎÕÜ", "aaaaaaa", "x" * 70, "y" * 3000, "abcdeÿ", "banana"]
    texts = []
    for w in base:
        for k in range(6):
            v = w
            for _ in range(k // 2):
                p = int(rng.integers(len(v)))
                v = v[:p] + rng.choice(["", "a", "ÿ", v[p] + "b", "z"]) + v[p + 1:]
            texts += [f"{v}, {v.upper()}-{v}9{v}" for _ in range(2 ** (6 - k))]
    docs += [(5000 + i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:40]] + [(7, None), (8, ""), (None, None), (5000, texts[0]), (5000, texts[0])]
    return docs


@pytest.mark.parametrize("blocks", [1 << 22, 40])
def test_variants_equal_brute_force(spark, sf, monkeypatch, blocks):
    """Also with filters so small that shards are split and several passes are made."""
    monkeypatch.setattr(spelling, "PASS_BLOCKS", blocks)
    docs = odd_documents(sf)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run")
    vocabulary = brute_vocabulary(docs)
    got = rows_of(spelling.variants(table))
    assert len(vocabulary) > 300 and sum(r[1] is not None for r in got) > 10 and any(r[2] not in (r[0], r[1]) for r in got)
    assert sorted(got, key=str) == sorted(brute_variants(vocabulary), key=str)


def test_variants_chain_ties_and_letters_outside_ascii(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "éaaaa": 6, "ÿÿÿÿÿ": 5, "ÿÿÿÿ÷": 11, "lonely": 9, "aaaaac": 5, "z" * 100: 4, "z" * 99: 8}
    got = rows_of(spelling.group(spark.createDataFrame([*words.items()], "word string, n long")))
    assert sorted(got, key=str) == sorted(brute_variants(words), key=str)
    row = {r[0]: r for r in got}
    assert row["aaaaa"][1:3] == ("aaaab", "aabbb") and row["aaaaa"][4] == 3 and row["z" * 100][1] == "z" * 99


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcdeéè"), int(rng.integers(5, 12)))) for _ in range(20_000)})
    k = spelling.Hashes(words)
    layout = spelling.Layout(Counter(spelling.shard_of(k.length).tolist()))
    bits = np.zeros(layout.size[0], np.uint64)
    h = spelling.mix(k.whole)
    np.bitwise_or.at(bits, layout.where(h, k.length)[1], spelling.mask_of(h))
    other = spelling.Hashes([w + "z" for w in words if len(w) < 11])
    g = spelling.mix(other.whole)
    m = spelling.mask_of(g)
    assert ((bits[layout.where(h, k.length)[1]] & spelling.mask_of(h)) == spelling.mask_of(h)).all()
    assert ((bits[layout.where(g, other.length)[1]] & m) == m).mean() < 0.02
