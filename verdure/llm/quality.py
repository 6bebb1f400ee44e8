"""Line-first quality rules.

Every line is judged by itself: terminal punctuation, navigation separators, symbol noise,
shouting and boilerplate phrases.  Failing lines go; a document that loses too large a share
of its text, or fails the document rules, is rejected.  All of it is one projection per
document: no shuffle, no Python, one row in and one row out whatever the group of copies.

Defined results: a null text is an empty one (rejected: under ``min_words`` words); repeated
rows each get the same result; ids may be null; extra columns are left alone.
"""
from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, let_sql, packed, pinned, text_of, unpacked, words

SYMBOLS = r"[#*$%&|<>]"
TERMINALS = ".!?:;…。！？؟।۔\"'”’»)]}"
SENTENCE_END = r"[.!?…]['\")»]*\x20+\p{Lu}"
SEPARATORS = r"[|»›•·→]"
UPPER, LOWER = r"\p{Lu}", r"\p{Ll}"
BLANKS = " \t\n\x0b\x0c\r"

# Fixed phrases of page furniture: English, German, French, Spanish.
BOILERPLATE_PHRASES = [
    "all rights reserved", "click here", "cookie policy", "cookies to improve", "enable javascript",
    "javascript is disabled", "lorem ipsum", "privacy policy", "read more", "sign in", "sign up",
    "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung",
    "hier klicken", "javascript aktivieren", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "accepter les cookies", "activer javascript", "aller au contenu", "cliquez ici", "conditions générales",
    "lire la suite", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "activar javascript", "aviso legal", "haga clic aquí", "iniciar sesión", "leer más",
    "política de cookies", "política de privacidad", "términos de uso", "todos los derechos reservados",
]

#: A line is page furniture if its phrases make up this share of its words.
PHRASE_PERCENT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 40


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def has_phrase(low: Column) -> Column:
    """True if a lower-cased text holds the letters of a boilerplate phrase."""
    return reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE_PHRASES])


def phrase_words(low: Column) -> Column:
    """Words of a lower-cased text inside boilerplate phrases that stand between word boundaries."""
    by_size: dict[int, list[str]] = {}
    for p in BOILERPLATE_PHRASES:
        by_size.setdefault(len(p.split()), []).append(p)
    return reduce(add, [n * F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ps)})(?![\p{{L}}\p{{N}}])"))
                        for n, ps in sorted(by_size.items())])


def line_fails(line: Column, symbols: Column, phrase: Column) -> Column:
    """True if a line with words breaks a rule.  ``symbols``, ``phrase``: whether its document has any at all,
    which spares most lines the costly rules.

    * punctuation: it neither ends in terminal punctuation nor holds a sentence's end before a capital;
    * symbols: as many symbol characters as half its words;
    * navigation: two separators or more, one for each five words at least;
    * shouting: ten capitals or more and no small letter;
    * boilerplate: known phrases make up ``PHRASE_PERCENT`` of its words; prose that uses one is kept.
    """
    def n(pattern):
        return F.regexp_count(line, F.lit(pattern))

    return ((~F.contains(F.lit(TERMINALS), F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1))) & ~line.rlike(SENTENCE_END))
            | (symbols & (2 * n(SYMBOLS) >= n(WORD)))
            | (line.rlike(SEPARATORS) & (n(SEPARATORS) >= 2) & (5 * n(SEPARATORS) >= n(WORD)))
            | (~line.rlike(LOWER) & (n(UPPER) >= 10))
            | (phrase & has_phrase(F.lower(line)) & (100 * phrase_words(F.lower(line)) >= PHRASE_PERCENT * n(WORD))))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def _repeated_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    Each window is packed as 32 hash bits and its position, and the packed longs are sorted:
    neighbours that share the hash bits are candidates.  Candidates are compared as words (sorted by
    window, then position), and a pass over the sorted starts adds the part of each window not yet covered.
    """
    window = "concat_ws(' ', w[i], w[i + 1], w[i + 2])"
    packed = ("CASE WHEN size(w) >= 3 THEN sort_array(transform(sequence(0, size(w) - 3), "
              "i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & -4294967296L) | i)) END")
    candidates = let_sql(packed, "p", "filter(p, (x, i) -> (i > 0 AND shiftright(p[i - 1] ^ x, 32) = 0) "
                                      "OR (i < size(p) - 1 AND shiftright(p[i + 1] ^ x, 32) = 0))")
    same = let_sql(f"sort_array(transform(transform(c, x -> CAST(x & 4294967295L AS int)), i -> struct({window} AS g, i AS p)))",
                   "s", "transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].g = x.g) OR (i < size(s) - 1 AND s[i + 1].g = x.g)), x -> x.p)")
    covered = (f"aggregate(sort_array({same}), named_struct('last', -3, 'n', 0), "
               "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)")
    n = let_sql(w, "w", let_sql(candidates, "c", f"CASE WHEN size(c) > 0 THEN {covered} ELSE 0 END"))
    return df.withColumn(out, F.expr(n).cast("long"))


def measure(docs: DataFrame, text_col: str = "text", *, min_words: int = MIN_WORDS,
            max_repeat_percent: int = MAX_REPEAT_PERCENT, max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """``docs`` with ``q_`` columns: counts, lost characters and the verdict (columns of these names are replaced)."""
    t = text_of(text_col)
    df = docs.withColumns({"__w": words(t), "__lines": F.filter(F.split(t, "\n", -1), _has_word), "__low": F.lower(t),
                           "q_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long")})
    df = _repeated_words(df, "__w", "q_repeat_words")
    # the phrases are looked for in the whole text once, outside the per-line function
    flags = F.struct((F.col("q_symbols") > 0).alias("symbols"), has_phrase(F.col("__low")).alias("phrase"))
    df = df.withColumn("__bad", let(flags, lambda f: F.filter("__lines", lambda x: line_fails(x, f["symbols"], f["phrase"]))))
    df = df.withColumns({
        "q_words": F.size("__w").cast("long"),
        "q_word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "q_lines": F.size("__lines").cast("long"),
        "q_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "q_bad_lines": F.size("__bad").cast("long"),
        "q_line_chars": _chars(F.col("__lines")),
        "q_lost_chars": _chars(F.col("__bad")),
    })
    df = df.withColumn("q_base_failed", pinned((F.col("q_words") < min_words)
                       | (100 * F.col("q_repeat_words") > max_repeat_percent * F.col("q_words"))))
    df = df.withColumn("q_kept", ~F.col("q_base_failed")
                       & (100 * F.col("q_lost_chars") <= max_loss_percent * F.col("q_line_chars")))
    return df.drop("__w", "__lines", "__low", "__bad")


def clean(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The accepted documents, their failing lines removed, in the columns of ``docs``."""
    kept = measure(packed(docs, text_col), text_col, **limits).where("q_kept")
    lines = F.filter(F.split(text_of(text_col), "\n", -1), lambda x: ~(_has_word(x) & line_fails(
        x, F.lit(True), F.lit(True))))
    text = F.when(F.col("q_bad_lines") > 0, F.array_join(lines, "\n")).otherwise(F.col(text_col))
    return unpacked(kept, docs.columns, **{text_col: text})
