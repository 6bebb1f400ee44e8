"""DuckDB SQL for the rows of the queries that SQL can express.

Written from what each query returns, with set operations where the operators use arrays and blocks.
"""
from __future__ import annotations

from .licenses import FULL_TEXTS, TEMPLATES

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _words(t: str) -> str:
    return WORDS.format(t=t)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- op1
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# phrases by their number of words; every character that is no letter or digit stands twice in ``low2``, so that a match can take one on
# each side and leave the other to its neighbour
_PHRASES = {1: "datenschutzerklärung|nutzungsbedingungen",
            2: "click  here|cookie  policy|enable  javascript|lorem  ipsum|privacy  policy|read  more|sign  in|sign  up|"
               "allgemeine  geschäftsbedingungen|cookies  akzeptieren|hier  klicken|javascript  aktivieren|newsletter  abonnieren|"
               "activer  javascript|cliquez  ici|conditions  générales|mentions  légales|"
               "aceptar  cookies|activar  javascript|aviso  legal|iniciar  sesión|leer  más",
            3: "all  rights  reserved|cookies  to  improve|javascript  is  disabled|skip  to  content|terms  of  service|terms  of  use|"
               "alle  rechte  vorbehalten|zum  inhalt  springen|accepter  les  cookies|aller  au  contenu|lire  la  suite|"
               "politique  de  confidentialité|tous  droits  réservés|haga  clic  aquí|política  de  cookies|política  de  privacidad|términos  de  uso",
            4: "subscribe  to  our  newsletter|todos  los  derechos  reservados"}
_PHRASE_WORDS = " + ".join(rf"{n} * len(regexp_extract_all(low2, '(^|[^\p{{L}}\p{{N}}])({p})($|[^\p{{L}}\p{{N}}])'))" for n, p in _PHRASES.items())
ORACLES["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_words('t')} AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gram AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
twice AS (SELECT r, i FROM gram QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, line, regexp_replace(lower(line), '([^\p{{L}}\p{{N}}])', '\1\1', 'g') AS low2, len({_words('line')}) AS n,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(line, '[|»›•·→]')) AS sep
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bad AS (SELECT *, (NOT contains('.!?:;…。！？؟।۔"''”’»)]}}', right(rtrim(line, {_BLANKS}), 1))
                   AND NOT regexp_matches(line, '[.!?…][''")»]*\x20+\p{{Lu}}'))
          OR (sym > 0 AND 2 * sym >= n) OR (sep >= 2 AND 5 * sep >= n)
          OR (NOT regexp_matches(line, '\p{{Ll}}') AND len(regexp_extract_all(line, '\p{{Lu}}')) >= 10)
          OR 100 * ({_PHRASE_WORDS}) >= 30 * n AND {_PHRASE_WORDS} > 0 AS fails FROM lw),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS n_bad,
            sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (fails), 0) AS lost FROM bad GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_bad_lines,
        coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(chars, 0) AS chars
      FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * chars AS kept,
  n_lines, n_bad_lines, lost_chars FROM m"""

# ---------------------------------------------------------------- op3
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    rx = _text(pattern)
    return f"""SELECT r, {kind} AS k, s, s + length(v) AS e, v FROM (
      SELECT r, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, {rx}) AS m, string_split_regex(t, {rx}) AS g FROM d WHERE regexp_matches(t, {rx}))))
      WHERE {keep}"""


def _tail(z: str) -> str:
    a = f"least(abs({z}), 37.0::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * {a}))"
    p = (f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))")
    q = f"(exp(-0.5::DOUBLE * {a} * {a}) * 0.3989422804014327::DOUBLE * {p})"
    return f"(CASE WHEN {z} >= 0 THEN {q} ELSE 1.0::DOUBLE - {q} END)"


# encoding, the whole value's pattern, alphabet
_ENCODINGS = [
    ("hex", "[0-9a-f]*", "0123456789abcdef"),
    ("hex", "[0-9A-F]*", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]*", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "[0-9A-Za-z]*", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "[0-9A-Za-z+/]*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "[0-9A-Za-z_-]*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
_ENCODED = "CASE " + " ".join(
    f"WHEN regexp_matches(b, '^{rx}$') AND (regexp_matches(b, '[0-9]') AND regexp_matches(b, '[A-Za-z]') "
    f"OR {i} >= 4 AND regexp_matches(b, '[a-z]') AND regexp_matches(b, '[A-Z]')) THEN {i}" for i, (_, rx, _) in enumerate(_ENCODINGS)) + " ELSE -1 END"
_ALPHABET = "CASE c " + " ".join(f"WHEN {i} THEN {_text(a)}" for i, (_, _, a) in enumerate(_ENCODINGS)) + " END"
_ENC_NAME = "CASE c " + " ".join(f"WHEN {i} THEN {_text(n)}" for i, (n, _, _) in enumerate(_ENCODINGS)) + " END"
# the lowest cut whose strings are not random in 5 % at most, two standard deviations allowed for
_BEST_CUT = "coalesce(" + ", ".join(
    f"CASE WHEN count(*) FILTER (p >= {a}::DOUBLE) - 2 * (1 - {a}::DOUBLE) * count(*) FILTER (p > 0.5::DOUBLE) "
    f"- 2.0::DOUBLE * sqrt(count(*) FILTER (p >= {a}::DOUBLE) * (1 - 2 * {a}::DOUBLE)) <= 0.05::DOUBLE * count(*) FILTER (p >= {a}::DOUBLE) THEN {a}::DOUBLE END"
    for a in (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)) + ", 0.5::DOUBLE)"
_M = "(2.0::DOUBLE * high * (n - high))"
_Z_RUNS = (f"(CASE WHEN high = 0 OR high = n THEN 37.0::DOUBLE ELSE (runs - {_M} / n - 1) / sqrt({_M} * ({_M} - n) / (n::DOUBLE * n * (n - 1))) END)")
ORACLES["op3_secret_scans"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans(0, _ASSIGN, f"length(regexp_extract(v, {_text(_ASSIGN)}, 2)) >= 6")}
  UNION ALL {_spans(1, 'AKIA[A-Z0-9]+', 'length(v) >= 20')} UNION ALL {_spans(2, '[0-9a-f]{24,}', 'true')}),
runs AS ({_spans(9, '[A-Za-z0-9+/_-]{20,}=*', 'true')}),
-- "=" belongs to a candidate only where nothing of an encoding follows
cand0 AS (SELECT runs.r, s, CASE WHEN v LIKE '%=' AND regexp_matches(substr(t, (e + 1)::BIGINT, 1), '[A-Za-z0-9+/_-]') THEN e - length(v) + length(regexp_replace(v, '=+$', '')) ELSE e END AS e
  FROM runs JOIN d ON d.r = runs.r),
touch AS (SELECT x.r, x.s, x.e, y.s AS bs, y.e AS be, greatest(x.s, coalesce(max(y.e) OVER (PARTITION BY x.r, x.s ORDER BY y.s, y.k, y.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x.s)) AS p
  FROM cand0 x JOIN base y ON y.r = x.r AND y.s < x.e AND x.s < y.e),
parts AS (SELECT r, s, e FROM cand0 x WHERE NOT EXISTS (SELECT 1 FROM touch y WHERE y.r = x.r AND y.s = x.s)
  UNION ALL SELECT r, p, bs FROM touch WHERE bs > p UNION ALL SELECT r, greatest(s, max(be)), e FROM touch GROUP BY r, s, e HAVING max(be) < e),
cand AS (SELECT parts.r, s, e, regexp_replace(substr(t, (s + 1)::BIGINT, (e - s)::BIGINT), '=+$', '') AS b FROM parts JOIN d ON d.r = parts.r),
coded AS (SELECT *, {_ENCODED} AS c FROM cand WHERE length(b) >= 20),
named AS (SELECT r, s, e, b, {_ENC_NAME} AS name, {_ALPHABET} AS abc FROM coded WHERE c >= 0),
sym AS (SELECT r, s, e, name, b, length(abc) AS k, length(b) AS n, i, instr(abc, b[i]) - 1 AS v
  FROM (SELECT *, unnest(range(1, length(b) + 1)) AS i FROM named)),
counts AS (SELECT r, s, sum(c * c) AS sq FROM (SELECT r, s, v, count(*) AS c FROM sym GROUP BY r, s, v) GROUP BY r, s),
walk AS (SELECT *, lag(v) OVER (PARTITION BY r, s ORDER BY i) AS u FROM sym),
stat AS (SELECT r, s, e, name, any_value(b) AS b, k, n, count(*) FILTER (2 * v >= k) AS high,
    count(*) FILTER (u IS NULL OR (2 * v >= k) <> (2 * u >= k)) AS runs,
    coalesce(sum((u - (k - 1) / 2) * (v - (k - 1) / 2)), 0) / (((k * k - 1) / 12) * sqrt((n - 1)::DOUBLE)) AS serial
  FROM walk GROUP BY r, s, e, name, k, n),
z AS (SELECT r, s, e, name, b, n, ((k * sq::DOUBLE / n - n) - (k - 1)) / sqrt(2.0::DOUBLE * (k - 1) * (n - 1) / n) AS chi,
    {_Z_RUNS} AS zr, serial FROM stat JOIN counts USING (r, s)),
tests AS (SELECT r, s, e, b, name || ':' || floor(2 * log2(n))::BIGINT AS stratum,
    round(1.0::DOUBLE - pow(1.0::DOUBLE - least(1.0::DOUBLE, greatest(0.0::DOUBLE, least({_tail('chi')}, 2.0::DOUBLE * {_tail('abs(zr)')},
      2.0::DOUBLE * {_tail('abs(serial)')}))), 3.0::DOUBLE), 9) AS p FROM z),
cuts AS (SELECT stratum, {_BEST_CUT} AS cut FROM (SELECT stratum, b, max(p) AS p FROM tests GROUP BY stratum, b) GROUP BY stratum),
found AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, 3, s, e FROM tests JOIN cuts USING (stratum) WHERE p >= cut),
text AS (SELECT r, k, s, e, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS x FROM found),
per AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY s, k, e) AS spans FROM text GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""

# ---------------------------------------------------------------- op4
ORACLES["op4_warc_transactions"] = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
newest AS (SELECT digest, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN m IS NULL OR m IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to, true AS complete, true AS verified
FROM p LEFT JOIN newest USING (digest)"""

# ---------------------------------------------------------------- op5
_HIGH = "('0x' || substr(md5(term), 1, 8))::BIGINT"
_LOW = "('0x' || substr(md5(term), 9, 8))::BIGINT"


def _half(x: str) -> str:
    return " + ".join(f"(CASE WHEN 2 * sum(({x} >> {b}) & 1) > count(*) THEN {1 << b} ELSE 0 END)" for b in range(32))


_XOR = "bit_count(xor({a}.hi, {b}.hi)) + bit_count(xor({a}.lo, {b}.lo))"
ORACLES["op5_simhash"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents),
o AS (SELECT doc_id, t, n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid
  FROM d WINDOW w AS (ORDER BY doc_id DESC)),
v AS (SELECT doc_id, 0 AS v, t FROM o UNION ALL SELECT doc_id, 1, left(t, n - n // 2) || left(nt, n // 2) FROM o),
w AS (SELECT doc_id, v, {_words('t')} AS w FROM v),
terms AS (SELECT doc_id, v, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS term
  FROM (SELECT doc_id, v, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, v, {_HIGH} AS h, {_LOW} AS l FROM terms),
f AS (SELECT doc_id, v, ({_half('h')})::BIGINT AS hi, ({_half('l')})::BIGINT AS lo FROM z GROUP BY doc_id, v),
fp AS (SELECT v.doc_id, v.v, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo, sha256(t) AS sha FROM v LEFT JOIN f USING (doc_id, v)),
near AS (SELECT q.doc_id, count(*) - 1 AS n_near FROM fp q JOIN fp x ON q.v = 0 AND x.v = 0 AND q.doc_id % 100 = 0
  AND {_XOR.format(a='q', b='x')} <= 3 GROUP BY q.doc_id)
SELECT o.doc_id, o.n AS n_chars, e.sha AS edited_sha256, printf('%08x%08x', a.hi, a.lo) AS fingerprint,
  printf('%08x%08x', e.hi, e.lo) AS edited_fingerprint, 1 - ({_XOR.format(a='a', b='e')}) / 64 AS near_edited,
  1 - ({_XOR.format(a='a', b='x')}) / 64 AS near_next, n_near
FROM o JOIN fp a ON a.doc_id = o.doc_id AND a.v = 0 JOIN fp e ON e.doc_id = o.doc_id AND e.v = 1
JOIN fp x ON x.doc_id = o.nid AND x.v = 0 LEFT JOIN near ON near.doc_id = o.doc_id"""

# ---------------------------------------------------------------- op7
ORACLES["op7_source_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, len({_words("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h,
    md5(coalesce(text, '')) AS h2 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
p AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS place FROM s),
c AS (SELECT *, [5, 2, 1][place + 1]::BIGINT AS weight, 3 * source_size AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM c),
q AS (SELECT *, cap * rest > (total - before) * weight AS is_open FROM l),
level AS (SELECT (total - before)::DOUBLE / rest::DOUBLE AS v FROM q WHERE is_open ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, place, CASE WHEN is_open THEN weight * (SELECT v FROM level) ELSE cap::DOUBLE END AS target FROM q),
r AS (SELECT d.*, source_size, place, target,
    (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size, h2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, whole + (2 * b + size <= 2 * (target - whole * source_size) AND target - whole * source_size > 0)::BIGINT AS copies,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, b / target) ELSE 0.0::DOUBLE END AS share FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, CASE WHEN copies > 0 THEN CASE place
    WHEN 0 THEN (sqrt(2.25::DOUBLE + (-2.0::DOUBLE) * share) - 1.5::DOUBLE) / (-1.0::DOUBLE) WHEN 1 THEN share
    ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * share) - 0.5::DOUBLE) / 1.0::DOUBLE END END AS position FROM x"""

# ---------------------------------------------------------------- op9
# statements and full texts, from which SQL works out terms, document frequencies and unit vectors by itself; paragraphs of the shortest
# full text are templates too
_MIT = next(t for n, t in FULL_TEXTS if n == "MIT")
_TEXTS = ", ".join([f"(0, {i}, {_text(n)}, {_text(t)}, 0)" for i, (n, t) in enumerate(TEMPLATES)]
                   + [f"(1, {i}, {_text(n)}, {_text(t)}, 1)" for i, (n, t) in enumerate(FULL_TEXTS)]
                   + [f"(1, {len(FULL_TEXTS) + i}, 'MIT', {_text(t)}, 0)" for i, t in enumerate(_MIT.strip().split("\n\n"))])
_CUE = "licen[cs]e|copyright|spdx|rights reserved|hereby granted|redistribut|public domain|cc by|cc0"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECORATION = r"(?m)^[ \t\v\f\r]*[#/*;!%<>\"''-]*[ \t\v\f\r]*|[ \t\v\f\r]*[*/#>-]*[ \t\v\f\r]*$"
_SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+(-][a-z0-9.+()-]*(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+()-]+)*)"
_NAMES = ", ".join(f"({_text(n.lower())}, {_text(n)})" for n in sorted({n for n, _ in [*TEMPLATES, *FULL_TEXTS]}))
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
ORACLES["op9_license_scans"] = rf"""
WITH given_texts(grp, template, license, text, whole) AS (VALUES {_TEXTS}), names(low, name) AS (VALUES {_NAMES}),
tt AS (SELECT grp, template, license, whole, term, count(*) AS n FROM (SELECT grp, template, license, whole, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM given_texts)
  GROUP BY ALL),
size AS (SELECT grp, count(*) AS k FROM given_texts GROUP BY grp),
idf AS (SELECT grp, term, ln((1 + k)::DOUBLE / (1 + count(*))) + 1 AS idf FROM tt JOIN size USING (grp) GROUP BY grp, term, k),
tw AS (SELECT tt.*, n * idf AS w FROM tt JOIN idf USING (grp, term)),
vec AS (SELECT grp, template, license, whole, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, template)) AS weight FROM tw),
f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS raw, {_LOWER.format(t="coalesce(text, '')")} AS t,
    concat_ws('/', source, lang, floor(doc_id / 1000)::BIGINT, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
p AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches(path, '(^|/)LICENSE$') AS is_file FROM f),
speaks AS (SELECT * FROM p WHERE regexp_matches(t, '{_CUE}')),
u AS (SELECT DISTINCT r, unit FROM (SELECT r, unnest(string_split(t, chr(10))) AS unit FROM speaks
    UNION ALL SELECT r, unnest(string_split_regex(regexp_replace(t, '{_DECORATION}', '', 'g'), '\n{{2,}}')) FROM speaks UNION ALL SELECT r, t FROM speaks WHERE is_file)
  WHERE regexp_matches(unit, '{_CUE}')),
tf AS (SELECT r, unit, term, count(*) AS tf FROM (SELECT r, unit, unnest(regexp_extract_all(unit, '{_TERM}')) AS term FROM u) GROUP BY ALL),
w AS (SELECT grp, r, unit, tf.term, tf * coalesce(idf, ln((1 + k)::DOUBLE) + 1) AS w FROM tf CROSS JOIN size LEFT JOIN idf USING (grp, term)),
norm AS (SELECT grp, r, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY grp, r, unit),
score AS (SELECT r, whole, template, license, round(sum(w * weight) / any_value(norm), 6) AS score FROM w JOIN vec USING (grp, term) JOIN norm USING (grp, r, unit)
  GROUP BY grp, r, unit, template, license, whole
  UNION ALL SELECT r, 0, 0, coalesce(name, tag), 1.0 FROM (SELECT r, unnest(regexp_extract_all(raw, '{_SPDX}', 1)) AS tag FROM speaks)
    LEFT JOIN names ON low = regexp_replace(lower(tag), '(-only|-or-later|\+)$', '')),
own AS (SELECT r, license, score FROM score WHERE score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY license <> 'Proprietary' DESC, whole DESC, score DESC, template, license DESC) = 1),
given AS (SELECT dir, license FROM p JOIN own USING (r) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) = 1),
near AS (SELECT d.dir, g.dir AS at, g.license FROM (SELECT DISTINCT dir FROM p) d JOIN given g ON g.dir = d.dir OR starts_with(d.dir, g.dir || '/') OR g.dir = ''
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, path, own.license AS own_license, own.score AS own_score, coalesce(own.license, near.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.at IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.license IS NULL THEN near.at END AS license_dir
FROM p LEFT JOIN own USING (r) LEFT JOIN near ON near.dir = p.dir"""

# ---------------------------------------------------------------- op10
ORACLES["op10_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

# ---------------------------------------------------------------- op11
ORACLES["op11_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(\[)(/?(SYS|INST|ROLE|NONE)\]|(ANS|TEXT|NEXT)\])', '\1\\\2', 'g'),
    '(<)(/?s>)', '\1\\\2', 'g')) AS escaped,
  length(regexp_replace(regexp_replace(replace(coalesce(role, ''), '\', '\\'), '(\[)(/?(SYS|INST|ROLE|NONE)\]|(ANS|TEXT|NEXT)\])', '\1\\\2', 'g'),
    '(<)(/?s>)', '\1\\\2', 'g')) AS escaped_role,
  row_number() OVER w AS k, row_number() OVER w = 1 OR lag(role) OVER w IS DISTINCT FROM role AS opens FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
m AS (SELECT *, escaped + CASE WHEN NOT opens THEN 6 WHEN role IS NULL THEN 13 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
  WHEN role = 'assistant' THEN 9 ELSE 19 + escaped_role END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(chars))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""
