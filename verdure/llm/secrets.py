"""Secret scans: three keyed patterns and a randomness test battery.

The patterns give spans of assignments, access keys and long hex runs.  Every other run of
encoding characters is a candidate: its encoding is inferred from its characters, and three
tests ask whether its symbols look uniform and independent (chi-squared over the alphabet, runs
about the middle, serial correlation).  Their smallest p-value, corrected for three tests, is
uniform for random strings.  False discoveries are held down per stratum of encoding and length:
from the share of p-values in the upper half, where only random strings lie in any number, comes
the number of random strings of the stratum, and the lowest cut is taken at which non-random
ones make up at most ``q`` of what passes, two standard deviations of that estimate allowed for.
Each different string counts once, so copies move no cut; a stratum too small to show non-random
strings has the lowest cut.

Scale: spans are found inside the row that holds the text (no Python); the different candidates of
a stratum are counted by a grouped hash.  The strata table has at most 5 encodings x 64 lengths x
10 cuts whatever the input, and comes back as one scalar map.

Defined results: null text is empty and has no spans; repeated rows each get the same spans; all
positions are code points, end exclusive; extra columns are left alone.
"""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .common import any_case, let_sql, packed, text_of, unpacked

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # whole runs of 24 or more, as a run cannot hold a longer one
MIN_VALUE, MIN_ACCESS = 6, 20
#: ``=`` only as the padding behind a string: in name=value each side is a candidate of its own.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
Q = 0.05
NOISE = 2.0  # standard deviations that an estimate may be off by chance

# Fixed alphabets of the encodings, in their value order.
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE64_URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"

#: name, the whole value's pattern, alphabet; the first that fits is inferred.  A value must
#: mix letters with digits, or both cases: bare words and numbers encode nothing.
ENCODINGS = [
    ("hex", "[0-9a-f]*", HEX_LOWER),
    ("hex", "[0-9A-F]*", HEX_UPPER),
    ("base32", "[A-Z2-7]*", BASE32),
    ("base36", "[0-9a-z]*", BASE36),
    ("base62", "[0-9A-Za-z]*", BASE62),
    ("base64", "[0-9A-Za-z+/]*", BASE64),
    ("base64", "[0-9A-Za-z_-]*", BASE64_URL),
]
MIXED = r"\A(.*[0-9].*[A-Za-z].*|.*[A-Za-z].*[0-9].*)\z"
CUTS = (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL array of struct(s, e, v): leftmost non-overlapping matches in the column ``text``.

    ``split`` gives the texts between the matches, ``regexp_extract_all`` the matches; one pass
    adds up their lengths."""
    rx = _quoted(pattern)
    return (
        f"CASE WHEN {text} RLIKE {rx} THEN aggregate("
        f"zip_with(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0), (g, m) -> struct(length(g) AS g, m AS m)), "
        "named_struct('p', 0, 'out', CAST(array() AS array<struct<s:int,e:int,v:string>>)), "
        "(a, x) -> named_struct('p', a.p + x.g + coalesce(length(x.m), 0), 'out', CASE WHEN x.m IS NULL THEN a.out "
        "ELSE concat(a.out, array(named_struct('s', a.p + x.g, 'e', a.p + x.g + length(x.m), 'v', x.m))) END), a -> a.out) "
        "ELSE CAST(array() AS array<struct<s:int,e:int,v:string>>) END")


def _normal_tail(z: str) -> str:
    """SQL: upper tail of the standard normal (Zelen and Severo's polynomial), for any z."""
    a = f"least(abs({z}), 37D)"
    t = f"(1D / (1D + 0.2316419D * {a}))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"(exp(-0.5D * {a} * {a}) * 0.3989422804014327D * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1D - {tail} END)"


def _battery(values: str, k: str) -> str:
    """SQL: corrected smallest p-value of the battery over the array of symbol values (0 .. k-1)."""
    v, n = values, f"size({values})"
    # sum of squared counts = sum over symbols, by runs of the sorted values
    squares = (f"aggregate(sort_array({v}), named_struct('l', -1, 'c', 0L, 's', 0L), "
               "(a, y) -> CASE WHEN y = a.l THEN named_struct('l', y, 'c', a.c + 1L, 's', a.s + 2L * a.c + 1L) "
               "ELSE named_struct('l', y, 'c', 1L, 's', a.s + 1L) END, a -> a.s)")
    chi = f"((({k} * {squares}) / CAST({n} AS double) - {n}) - ({k} - 1)) / sqrt(2D * ({k} - 1) * ({n} - 1) / {n})"
    high = f"aggregate({v}, 0L, (a, y) -> a + CASE WHEN 2 * y >= {k} THEN 1L ELSE 0L END)"
    runs = (f"aggregate({v}, named_struct('l', -1, 'r', 0L), (a, y) -> named_struct('l', CASE WHEN 2 * y >= {k} THEN 1 ELSE 0 END, "
            f"'r', a.r + CASE WHEN a.l = CASE WHEN 2 * y >= {k} THEN 1 ELSE 0 END THEN 0L ELSE 1L END), a -> a.r)")
    serial = (f"aggregate({v}, named_struct('l', -1, 's', 0D), (a, y) -> named_struct('l', y, 's', a.s + CASE WHEN a.l < 0 THEN 0D "
              f"ELSE (a.l - ({k} - 1) / 2D) * (y - ({k} - 1) / 2D) END), a -> a.s) / ((({k} * {k} - 1) / 12D) * sqrt(CAST({n} - 1 AS double)))")
    return chi, high, runs, serial


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``z_base`` (array of s, k, e by start, then kind) and ``z_tests`` (candidates,
    or what base spans leave of them: s, e, stratum, p, hash of the string)."""
    df = docs.withColumn("__t", text_of(text_col))
    df = df.withColumns({
        "__assign": F.expr(f"filter({_matches('__t', ASSIGN)}, x -> length(regexp_extract(x.v, {_quoted(ASSIGN)}, 2)) >= {MIN_VALUE})"),
        "__access": F.expr(f"filter({_matches('__t', ACCESS)}, x -> length(x.v) >= {MIN_ACCESS})"),
        "__hex": F.expr(_matches("__t", HEX)),
        "__cand": F.expr(_matches("__t", CANDIDATE)),
    })
    as_span = "transform({c}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))"
    df = df.withColumn("z_base", F.expr("sort_array(concat({}))".format(
        ", ".join(as_span.format(c=f"__{k}", i=i) for i, k in enumerate(KINDS[:3])))))
    # the parts of a candidate that lie outside base spans
    part = "named_struct('s', {s}, 'e', {e}, 'v', substring(x.v, {s} - x.s + 1, {e} - {s}))"
    apart = (f"aggregate(z, named_struct('p', x.s, 'out', CAST(array() AS array<struct<s:int,e:int,v:string>>)), (a, b) -> CASE "
             f"WHEN b.e <= a.p OR b.s >= x.e THEN a ELSE named_struct('p', b.e, 'out', CASE WHEN b.s > a.p THEN concat(a.out, array("
             f"{part.format(s='a.p', e='b.s')})) ELSE a.out END) END, a -> CASE WHEN a.p < x.e THEN concat(a.out, array("
             f"{part.format(s='a.p', e='x.e')})) ELSE a.out END)")
    df = df.withColumn("__cand", F.expr(let_sql("z_base", "z", "flatten(transform(__cand, x -> CASE WHEN exists(z, b -> b.s < x.e "
                                                               f"AND x.s < b.e) THEN {apart} ELSE array(x) END))")))
    # a part's body goes without padding
    encoding = "CASE " + " ".join(
        f"WHEN b RLIKE '^{rx}$' AND (b RLIKE '[0-9]' AND b RLIKE '[A-Za-z]' OR {i} >= 4 AND b RLIKE '[a-z]' AND b RLIKE '[A-Z]') "
        f"THEN {i}" for i, (_, rx, _) in enumerate(ENCODINGS)) + " ELSE -1 END"
    alphabets = "array(" + ", ".join(_quoted(a) for _, _, a in ENCODINGS) + ")"
    names = "array(" + ", ".join(_quoted(n) for n, _, _ in ENCODINGS) + ")"
    body = "regexp_replace(x.v, '=+$', '')"
    df = df.withColumn("__cand", F.expr(
        f"filter(transform(transform(__cand, x -> named_struct('s', x.s, 'e', x.e, 'b', {body})), "
        f"y -> named_struct('s', y.s, 'e', y.e, 'b', y.b, 'c', {encoding.replace('b RLIKE', 'y.b RLIKE')})), w -> w.c >= 0 AND length(w.b) >= 20)"))
    df = df.withColumn("__cand", F.expr(
        f"transform(__cand, x -> named_struct('s', x.s, 'e', x.e, 'n', {names}[x.c], 'k', length({alphabets}[x.c]), "
        f"'h', xxhash64(x.b), 'v', transform(filter(split(x.b, ''), c -> c <> ''), c -> locate(c, {alphabets}[x.c]) - 1)))"))
    chi, high, runs, serial = _battery("x.v", "x.k")
    df = df.withColumn("__cand", F.expr(
        f"transform(__cand, x -> named_struct('s', x.s, 'e', x.e, 'n', x.n, 'h', x.h, 'len', size(x.v), 'chi', {chi}, 'high', {high}, "
        f"'runs', {runs}, 'serial', {serial}))"))
    m = "(2D * x.high * (x.len - x.high))"
    z_runs = (f"(CASE WHEN x.high = 0 OR x.high = x.len THEN 37D ELSE (x.runs - {m} / x.len - 1) / "
              f"sqrt({m} * ({m} - x.len) / (CAST(x.len AS double) * x.len * (x.len - 1))) END)")
    df = df.withColumn("__cand", F.expr(
        f"transform(__cand, x -> named_struct('s', x.s, 'e', x.e, 'n', x.n, 'h', x.h, 'len', x.len, 'p', least({_normal_tail('x.chi')}, "
        f"2D * {_normal_tail('abs(' + z_runs + ')')}, 2D * {_normal_tail('abs(x.serial)')})))"))
    df = df.withColumn("z_tests", F.expr(
        "transform(__cand, x -> named_struct('s', x.s, 'e', x.e, 'stratum', concat(x.n, ':', CAST(floor(2 * log2(x.len)) AS string)), "
        "'p', round(1D - pow(1D - least(1D, greatest(0D, x.p)), 3D), 9), 'h', x.h))"))
    return df.drop("__t", "__assign", "__access", "__hex", "__cand")


def cuts(scanned: DataFrame, q: float = Q) -> DataFrame:
    """stratum, cut: the lowest p-value cut at which the estimated share of non-random strings is ``q`` at most.

    Of a stratum's different strings, random ones number twice those over one half.  Were all ``c`` strings over a cut
    ``a`` random, c - 2 (1 - a) upper would be 0 but for a standard deviation of sqrt(c (1 - 2 a)): ``NOISE`` of these
    are allowed, which is nothing to speak of in a large stratum and lets a small one keep the lowest cut."""
    c = scanned.select(F.explode("z_tests").alias("x")).select("x.stratum", "x.h", "x.p")
    c = c.groupBy("stratum", "h").agg(F.max("p").alias("p"))
    sums = c.groupBy("stratum").agg(F.count_if(F.col("p") > 0.5).alias("upper"),
                                    *[F.count_if(F.col("p") >= a).alias(f"c{i}") for i, a in enumerate(CUTS)])
    best = F.coalesce(*[F.when(F.col(f"c{i}") - 2 * (1 - a) * F.col("upper") - NOISE * F.sqrt(F.col(f"c{i}") * (1 - 2 * a))
                               <= q * F.col(f"c{i}"), F.lit(a)) for i, a in enumerate(CUTS)], F.lit(CUTS[-1]))
    return sums.select("stratum", best.alias("cut"))


def with_spans(scanned: DataFrame, cut_table: DataFrame) -> DataFrame:
    """Adds ``z_spans``: base spans and the accepted random ones (array of s, k, e; by start, then kind)."""
    as_map = cut_table.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("m")).scalar()
    df = scanned.withColumn("__m", as_map)
    df = df.withColumn("z_spans", F.expr(
        "sort_array(concat(z_base, transform(" + let_sql("__m", "m", "filter(z_tests, x -> x.p >= coalesce("
        "try_element_at(m, x.stratum), 2D))") + ", x -> named_struct('s', x.s, 'k', 3, 'e', x.e))))"))
    return df.drop("__m")


def span_text(spans: str, only_base: bool = False) -> Column:
    kinds = "array(" + ", ".join(map(_quoted, KINDS)) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame, text_col: str = "text", *, keep: tuple[str, ...] = ("doc_id",), q: float = Q) -> DataFrame:
    """``keep`` columns of every document with ``z_base``, ``z_tests``, ``z_spans``.  What the tests found is
    written to the shared checkpoint folder, so the texts are scanned once."""
    slim = cut_lineage(scan(docs.select(*keep, *([] if text_col in keep else [text_col])), text_col)
                       .select(*keep, "z_base", "z_tests"))
    return with_spans(slim, cuts(slim, q))


def _written(df: DataFrame) -> DataFrame:
    if "void" in df.schema.simpleString():  # a column of no type, which Parquet cannot hold
        return cut_lineage(df)
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/secrets-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def redact(docs: DataFrame, text_col: str = "text", *, mark: str = "[secret]", q: float = Q) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark`` (overlapping spans as one); all rows stay.

    The scanned rows are written to the shared checkpoint folder, as Parquet: texts are scanned once, and the cuts read the column of
    the tests only."""
    scanned = _written(scan(packed(docs, text_col), text_col))
    df = with_spans(scanned, cuts(scanned, q))
    pieces = let_sql("__t", "t", f"aggregate(z_spans, named_struct('p', 0, 'out', CAST(array() AS array<string>)), (a, x) -> CASE "
              f"WHEN x.s < a.p THEN named_struct('p', greatest(a.p, x.e), 'out', a.out) ELSE named_struct('p', x.e, 'out', "
              f"concat(a.out, array(substring(t, a.p + 1, x.s - a.p), {_quoted(mark)}))) END, "
              "a -> concat(array_join(a.out, ''), substring(t, a.p + 1)))")
    df = df.withColumn("__t", text_of(text_col))
    text = F.when(F.size("z_spans") > 0, F.expr(pieces)).otherwise(F.col(text_col))
    return unpacked(df, docs.columns, **{text_col: text})
