"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Base patterns give spans that always stand. Generators propose further spans, which may overlap (a card that a phone
number runs into, obfuscated addresses, identity and account numbers). Boosted trees score every proposal from its format
and its context, and a threshold calibrated for each kind selects what is added. The trees are trained on proposals made
by rule (``synthetic``), a fixed number of rows, and are evaluated as SQL.

DataFrame and SQL functions only: one narrow pass over the documents, without a shuffle.

Spark's regular expressions give matches but no places. Splitting by the same pattern gives the gaps between them, and
running sums of both lengths give the places, in code points. All patterns are linear: possessive where nothing that
follows could use a shorter match, and a match may start within a run only where the last one ended (``\\G``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import positional, restored
from tessera.llm.supervised import sigmoid

#: Fixed values. Java's dialect; the same matches as the plain patterns in the docstrings of ``tests/llm``.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried at all (regular expressions of a single character class).
HINT = {"email": "@", "phone": "+"}
#: Obfuscated addresses, in any case: after (at) or [at] dots may be plain, after the word "at" one must be a word or in
#: brackets. A name has 127 labels at most, as in DNS.
_AT, _LABEL, _DOT = r" ?(?:\(at\)|\[at\]) ?", "[a-z0-9-]{1,63}+", r" ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?"
_EMAIL = rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{_AT}| at (?={_LABEL}(?:\.{_LABEL}){{0,125}}+{_DOT})){_LABEL}(?:{_DOT}|\.)(?:{_LABEL}(?:{_DOT}|\.)){{0,125}}[a-z]{{2,24}}(?![a-z])"
#: Eight groups, or fewer on both sides of ``::``; the last two may be written as IPv4.
_H, _V4 = "[0-9A-Fa-f]{1,4}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SHORT = "|".join([*(f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)), f":(?::{_H}){{1,7}}", f"(?:{_H}:){{1,7}}:"])
_IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:(?:{_H}:){{6}}|::(?:{_H}:){{0,5}}|(?:{_H}:){{1,5}}:(?:{_H}:){{0,4}}){_V4}|(?:{_H}:){{7}}{_H}|{_SHORT})(?![0-9A-Za-z:])"
#: 3-3-4 digits, or 7 to 15 in other groups, of which the first may be in brackets; not four groups like an IPv4 address.
_PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])(?<![0-9]\.)(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))(?=\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}+(?![ ./-]?[0-9]))(?:\([0-9]{1,5}\)|[0-9]{1,15}+)(?:[ ./-]{0,2}[0-9]{1,8}+){0,14}+(?![0-9])"
#: Generators: kind -> (pattern, plain string that a text must contain, or "").
PROPOSALS = {
    "email": (_EMAIL, ""),
    "ip": (_IPV6, ":"),
    "card": (r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])", ""),
    "phone": (_PHONE, ""),
    "id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
}
KINDS = ["email", "ip", "card", "phone", "id"]
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay|account",
    "phone": "tel|phone|call|mobile|fax|dial", "id": "ssn|social|iban|passport|account|bank",
}
#: A proposal's probability must reach what gave this precision on held-out synthetic rows.
PRECISION = 0.98
#: Of ``synthetic``.
CASES = 36


def quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else repr(s)


def _scan(lens: str, offset: str) -> str:
    """SQL: the exclusive running sums of an array, from ``offset``."""
    return f"aggregate({lens}, named_struct('o', cast(array() as array<bigint>), 's', cast({offset} as bigint)), (q, v) -> named_struct('o', concat(q.o, array(q.s)), 's', q.s + v), q -> q.o)"


def located(df: DataFrame, name: str, text: str, pattern: str, needs: str = "") -> DataFrame:
    """Adds ``name``: the matches of ``pattern`` in the column ``text`` as array<struct<s, e, m>> (code points, e exclusive).

    Running sums go by blocks of 256 matches, then over the blocks, so a text with very many matches takes no quadratic time.
    """
    p = quoted(pattern)
    found = f"regexp_extract_all({text}, {p}, 0)"
    if needs:
        found = f"CASE WHEN contains({text}, '{needs}') THEN {found} ELSE cast(array() as array<string>) END"
    df = df.withColumn("_m", F.expr(found))
    df = df.withColumn("_g", F.expr(f"CASE WHEN size(_m) > 0 THEN split({text}, {p}, -1) END"))
    df = df.withColumn("_b", F.expr("CASE WHEN size(_m) > 0 THEN transform(sequence(0, (size(_m) - 1) div 256), k -> transform(slice(_m, cast(k * 256 + 1 as int), 256), (m, i) -> cast(length(m) + length(_g[cast(k * 256 + i as int)]) as bigint))) END"))
    df = df.withColumn("_o", F.expr(_scan("transform(_b, x -> aggregate(x, 0L, (a, v) -> a + v))", "0")))
    df = df.withColumn("_s", F.expr(f"flatten(zip_with(_b, _o, (x, o) -> {_scan('x', 'o')}))"))
    spans = "CASE WHEN size(_m) > 0 THEN transform(_m, (m, i) -> named_struct('s', _s[i] + length(_g[i]), 'e', _s[i] + length(_g[i]) + length(m), 'm', m)) ELSE cast(array() as array<struct<s: bigint, e: bigint, m: string>>) END"
    return df.withColumn(name, F.expr(spans)).drop("_m", "_g", "_b", "_o", "_s")


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    one = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {one} ELSE {one} * 2 - CASE WHEN {one} > 4 THEN 9 ELSE 0 END END) % 10 = 0)"


def _base_filter(kind: str) -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": "true",
        "ip": rf"x.m rlike r'^{octet}(?:\.{octet}){{3}}$'",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn(digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds a column of base spans for each kind of ``BASE``."""
    for kind, pattern in BASE.items():
        df = located(df, f"b_{kind}", text, pattern, HINT.get(kind, ""))
        df = df.withColumn(f"b_{kind}", F.expr(f"CASE WHEN size(b_{kind}) > 0 THEN filter(b_{kind}, x -> {_base_filter(kind)}) ELSE b_{kind} END"))
    return df


# --- format and context features -------------------------------------------------------------------------------------

FEATURES = {
    "n": "length(c.m)",
    "digits": "length(regexp_replace(c.m, '[^0-9]', ''))",
    "distinct_digits": "size(array_distinct(split(regexp_replace(c.m, '[^0-9]', ''), '')))",
    "groups": "size(split(c.m, '[^0-9A-Za-z]+'))",
    "letters": "length(regexp_replace(c.m, '[^A-Za-z]', ''))",
    "luhn": "CASE WHEN length(regexp_replace(c.m, '[^0-9]', '')) BETWEEN 13 AND 19 THEN cast(" + luhn("regexp_replace(c.m, '[^0-9]', '')") + " as int) ELSE 0 END",
    "plus": "cast(c.m like '+%' as int)",
    "bracket": "cast(c.m like '%(%' as int)",
    "lead": "cast(substring(regexp_replace(c.m, '[^0-9]', ''), 1, 1) in ('3', '4', '5', '6') as int)",
    "before_tight": r"cast(c.b rlike r'[0-9A-Za-z.=/_#-]$' as int)",
    "after_tight": r"cast(c.a rlike r'^[0-9A-Za-z/_=@-]|^[.][0-9]' as int)",
    "cue": "CASE " + " ".join(f"WHEN c.kind = {i} THEN cast(c.b rlike '{CUES[k]}' as int)" for i, k in enumerate(KINDS)) + " ELSE 0 END",
    "foil": "cast(c.b rlike 'order|version|serial|ref|isbn|sku|invoice|no[.]|id ' as int)",
    "known_end": "cast(c.m rlike '(?i)[ .)\\\\]](?:com|org|net|edu|gov|info|io|[a-z]{2})$' as int)",
    "kind": "c.kind",
}


def featured(cands: str) -> str:
    """SQL: candidates (kind, s, e, m, b, a) with their features as doubles."""
    fields = ", ".join(f"'{k}', cast({v} as double)" for k, v in FEATURES.items())
    return f"transform({cands}, c -> named_struct('k', c.kind, 's', c.s, 'e', c.e, 'f', named_struct({fields})))"


def proposals(df: DataFrame, text: str) -> DataFrame:
    """Adds ``cands``: every generator's spans with 24 code points before and 8 after."""
    parts = []
    for kind, (pattern, needs) in PROPOSALS.items():
        df = located(df, f"p_{kind}", text, pattern, needs)
        i = KINDS.index(kind)
        parts.append(f"transform(p_{kind}, x -> named_struct('kind', {i}, 's', x.s, 'e', x.e, 'm', x.m, 'b', lower(substring({text}, cast(greatest(x.s - 23, 1) as int), cast(least(x.s, 24) as int))), 'a', substring({text}, cast(x.e + 1 as int), 8)))")
    return df.withColumn("cands", F.expr(f"concat({', '.join(parts)})")).drop(*[f"p_{k}" for k in PROPOSALS])


# --- training --------------------------------------------------------------------------------------------------------


def synthetic(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled proposals made by rule: (id, y, cands), a candidate a row. Numbers come from hashes of the row's number."""
    digits = lambda n, salt: f"substring(lpad(cast(abs(xxhash64(id, {salt})) as string), 19, '7'), 3, {n})"
    word = lambda salt: f"element_at(array('alpha', 'delta', 'river', 'stone', 'maple', 'north', 'cloud', 'ember'), cast(1 + pmod(xxhash64(id, {salt}), 8) as int))"
    body = f"concat('4', {digits(14, 1)})"
    check = f"element_at(filter(transform(sequence(0, 9), d -> concat({body}, cast(d as string))), z -> {luhn('z')}), 1)"
    spaced = f"concat(substring({check}, 1, 4), ' ', substring({check}, 5, 4), ' ', substring({check}, 9, 4), ' ', substring({check}, 13, 4))"
    wrong = f"element_at(filter(transform(sequence(0, 9), d -> concat({body}, cast(d as string))), z -> NOT {luhn('z')}), 1)"
    iban = f"concat('DE', {digits(2, 5)}, ' ', {digits(4, 6)}, ' ', {digits(4, 7)}, ' ', {digits(4, 8)}, ' ', {digits(4, 9)}, ' ', {digits(2, 10)})"
    ipv6 = "concat_ws(':', transform(sequence(1, 8), g -> lower(substring(hex(xxhash64(id, g)), 3, 4))))"
    short6 = "concat('2001:db8::', concat_ws(':', transform(sequence(1, cast(1 + pmod(xxhash64(id), 3) as int)), g -> lower(substring(hex(xxhash64(id, g)), 3, 4)))))"
    # (kind, label, text, words before, words after)
    cases = [
        (0, 1, f"concat({word(1)}, ' at ', {word(2)}, ' dot com')", "' contact '", "' for'"),
        (0, 1, f"concat({word(1)}, {digits(2, 3)}, ' (at) ', {word(2)}, ' (dot) org')", "' '", "' or'"),
        (0, 0, f"concat({word(1)}, ' at ', {word(2)}, ' dot ', {word(3)}, 'x')", "' the '", "' and'"),
        (0, 1, f"concat({word(1)}, '(at)', {word(2)}, '.com')", "' mail '", "' for'"),
        (0, 1, f"upper(concat({word(1)}, ' at ', {word(2)}, ' dot com'))", "' contact '", "' or'"),
        (0, 1, f"concat({word(1)}, ' at mail dot ', {word(2)}, ' dot com')", "' '", "' for'"),
        (1, 1, short6, "' host '", "' '"),
        (1, 1, short6, "' '", "', '"),
        (1, 0, "element_at(array('add::face', 'a::b', 'dead::beef', 'c::', 'bad::cafe'), cast(1 + pmod(xxhash64(id), 5) as int))", "' '", "'(x) '"),
        (1, 1, ipv6, "' host '", "' '"),
        (1, 1, ipv6, "' '", "', '"),
        (1, 0, ipv6, "' key='", "'=='"),
        (2, 1, check, "' '", "' '"),
        (2, 1, spaced, "' '", "' '"),
        (2, 1, check, "' card '", "'. '"),
        (2, 0, wrong, "' '", "' '"),
        (2, 0, wrong, "' order '", "' '"),
        (2, 0, check, "' ref='", "'-1'"),
        (3, 1, f"concat('+1 (', {digits(3, 1)}, ') ', {digits(3, 2)}, '-', {digits(4, 3)})", "' '", "' '"),
        (3, 1, f"concat('+44 ', {digits(3, 1)}, ' ', {digits(3, 2)}, ' ', {digits(4, 3)})", "' '", "', '"),
        (3, 1, f"concat('(', {digits(3, 1)}, ') ', {digits(3, 2)}, '-', {digits(4, 3)})", "' call '", "' '"),
        (3, 0, f"concat({digits(3, 1)}, ' ', {digits(3, 2)}, ' ', {digits(4, 3)})", "' '", "' '"),
        (3, 0, f"concat({digits(3, 1)}, {digits(3, 2)}, '-', {digits(4, 3)})", "' serial '", "'-2'"),
        (3, 0, f"concat({digits(3, 1)}, '.', {digits(3, 2)}, '.', {digits(4, 3)})", "' version '", "'.1'"),
        (3, 1, f"concat('0', {digits(3, 1)}, ' ', {digits(7, 2)})", "' tel '", "' '"),
        (3, 1, f"concat('0', {digits(1, 1)}, ' ', {digits(2, 2)}, ' ', {digits(2, 3)}, ' ', {digits(2, 4)}, ' ', {digits(2, 5)})", "' phone '", "', '"),
        (3, 1, f"concat('(0', {digits(2, 1)}, ') ', {digits(6, 2)})", "' call '", "' '"),
        (3, 1, digits(10, 1), "' call '", "' '"),
        (3, 1, f"concat({digits(3, 1)}, '-', {digits(4, 2)})", "' dial '", "'. '"),
        (3, 0, digits(10, 1), "' '", "' '"),
        (3, 0, f"concat({digits(4, 1)}, '-', {digits(2, 2)}, '-', {digits(2, 3)})", "' '", "' '"),
        (3, 0, f"concat({digits(3, 1)}, ' ', {digits(4, 2)})", "' order '", "' '"),
        (4, 1, f"concat({digits(3, 1)}, '-', {digits(2, 2)}, '-', {digits(4, 3)})", "' ssn '", "' '"),
        (4, 1, iban, "' iban '", "' '"),
        (4, 0, f"concat({digits(3, 1)}, '-', {digits(2, 2)}, '-', {digits(4, 3)})", "' order '", "'/3'"),
        (4, 0, f"concat('AB', {digits(2, 5)}, {digits(4, 6)}, {digits(4, 7)}, {digits(4, 8)})", "' sku_'", "'_x'"),
    ]
    assert len(cases) == CASES
    pick = lambda j: "CASE " + " ".join(f"WHEN k = {i} THEN {c[j]}" for i, c in enumerate(cases)) + " END"
    df = spark.range(rows).withColumn("k", F.expr(f"cast(pmod(id, {len(cases)}) as int)"))
    df = df.select("id", F.expr(pick(0)).alias("kind"), F.expr(pick(1)).alias("y"), F.expr(pick(2)).alias("m"), F.expr(f"concat({word(11)}, {pick(3)})").alias("b"), F.expr(f"concat({pick(4)}, {word(12)})").alias("a"))
    # A few labels are wrong on purpose, so that probabilities are calibrated and not all 0 or 1.
    df = df.withColumn("y", F.expr("CASE WHEN pmod(xxhash64(id, 99), 100) < 1 THEN 1 - y ELSE y END"))
    return df.select("id", "y", F.expr("array(named_struct('kind', kind, 's', 0L, 'e', cast(length(m) as bigint), 'm', m, 'b', b, 'a', substring(a, 1, 8)))").alias("cands"))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree as nested tuples (feature, cut, below, not below), or a leaf value."""
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best, base = (1e-6, None), g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2 if len(values) <= 24 else np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)):
            low = x[:, f] < cut
            if 10 <= low.sum() <= len(low) - 10:
                a, b = g[low].sum(), h[low].sum()
                gain = a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - base
                if gain > best[0]:
                    best = (gain, (f, float(cut)))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low = x[:, f] < cut
    return f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] < cut, _apply(a, x), _apply(b, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = sigmoid(z)
        out.append(_grow(x, y - p, p * (1 - p), depth))
        z += rate * _apply(out[-1], x)
    return [(rate, t) for t in out]


def _calibrated(z: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least raw score above which the precision holds."""
    order = np.argsort(-z, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= precision) & (np.append(z[order][1:], -np.inf) < z[order]))
    return float(z[order][last[-1]]) - 1e-6 if len(last) else float("inf")


_TRAINED: list = []


def trained(spark: SparkSession):
    """(weighted trees, a threshold for each kind); made once in a driver, the same each time."""
    if not _TRAINED:
        _TRAINED.append(_train(spark))
    return _TRAINED[0]


def _train(spark: SparkSession):
    rows = synthetic(spark).select("id", "y", F.expr(f"{featured('cands')}[0].f").alias("f")).select("id", "y", "f.*").orderBy("id").collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows])
    y = np.array([r["y"] for r in rows], dtype=float)
    held = np.arange(len(y)) // CASES % 3 == 0
    trees = boost(x[~held], y[~held])
    z = sum(w * _apply(t, x) for w, t in trees)
    kind = x[:, list(FEATURES).index("kind")]
    return trees, [_calibrated(z[held & (kind == k)], y[held & (kind == k)], PRECISION) for k in range(len(KINDS))]


def _tree_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    f, cut, a, b = tree
    return f"CASE WHEN c.f.{names[f]} < {cut!r}D THEN {_tree_sql(a, names)} ELSE {_tree_sql(b, names)} END"


def selected(spark: SparkSession, cands: str) -> str:
    """SQL: the featured candidates that the trees accept, as array<struct<k, s, e>>."""
    trees, cuts = trained(spark)
    names = list(FEATURES)
    z = " + ".join(f"{w!r}D * ({_tree_sql(t, names)})" for w, t in trees)
    cut = "CASE " + " ".join(f"WHEN c.k = {i} THEN {v!r}D" for i, v in enumerate(cuts) if np.isfinite(v)) + " ELSE double('Infinity') END"
    return f"transform(filter({cands}, c -> ({z}) >= {cut}), c -> named_struct('k', c.k, 's', c.s, 'e', c.e))"


# --- the operator ----------------------------------------------------------------------------------------------------


def _found(named: DataFrame, text: Column) -> DataFrame:
    """Adds ``base`` and ``spans`` to a table whose columns are named by ``positional``."""
    names = named.columns
    df = proposals(base_spans(named.withColumn("_t", F.coalesce(text, F.lit(""))), "_t"), "_t")
    parts = ", ".join(f"transform(b_{k}, x -> named_struct('k', {KINDS.index(k)}, 's', x.s, 'e', x.e))" for k in BASE)
    df = df.withColumn("base", F.expr(f"concat({parts})"))
    df = df.withColumn("_f", F.expr(f"CASE WHEN size(cands) > 0 THEN {featured('cands')} END"))
    df = df.withColumn("spans", F.expr(f"CASE WHEN size(cands) > 0 THEN array_sort(array_distinct(concat(base, {selected(named.sparkSession, '_f')}))) ELSE base END"))
    return df.select(*names, "base", "spans")


def find_pii(docs: DataFrame, *, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with ``<prefix>base`` and ``<prefix>spans``: array<struct<k, s, e>> (index into ``KINDS``, start, end), in order of kind and start.

    ``spans`` has the base spans and the proposals that the trees accept, without repetitions; spans of different kinds
    may overlap. Null texts have none. Rows are independent of each other, so null ids, repeated rows and empty tables need
    no care. Columns of any name come back unchanged, but for columns of the two new names, which are replaced.
    """
    named, at = positional(docs)
    new = {f"{prefix}base": "base", f"{prefix}spans": "spans"}
    return restored(_found(named, F.col(at[text_col])), {k: v for k, v in at.items() if k not in new} | new)


def joined(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({kinds}), x.k + 1), cast(x.s as string), cast(x.e as string))), ',')")


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` in the text replaced by its kind in brackets; overlapping spans become one.

    Null and empty texts stay as they are; repeated rows, null ids and empty tables need no care. All other columns come
    back unchanged, whatever their names.
    """
    named, at = positional(docs)
    text = at[text_col]
    df = _found(named, F.col(text))
    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # Spans by start; one that begins before the furthest end so far only pushes that end.
    merged = "aggregate(array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k))), cast(array() as array<struct<s: bigint, e: bigint, k: int>>), (q, x) -> CASE WHEN size(q) > 0 AND x.s < element_at(q, -1).e THEN concat(slice(q, 1, size(q) - 1), array(named_struct('s', element_at(q, -1).s, 'e', greatest(element_at(q, -1).e, x.e), 'k', element_at(q, -1).k))) ELSE concat(q, array(x)) END)"
    df = df.withColumn("_u", F.expr(f"CASE WHEN size(spans) > 0 THEN {merged} END"))
    piece = f"transform(_u, (x, i) -> concat(substring({text}, cast(CASE WHEN i = 0 THEN 1 ELSE _u[i - 1].e + 1 END as int), cast(x.s - CASE WHEN i = 0 THEN 0 ELSE _u[i - 1].e END as int)), element_at(array({tags}), x.k + 1)))"
    new = f"CASE WHEN _u IS NULL THEN {text} ELSE concat(array_join({piece}, ''), substring({text}, cast(element_at(_u, -1).e + 1 as int))) END"
    return restored(df.withColumn(text, F.expr(new)), at)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """``find_pii`` over all documents; odd rows as stated there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    counts = [F.expr(f"cast(size(filter(pii_base, x -> x.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
