"""Personal data: fixed base patterns, and spans that boosted trees pick among overlapping candidates. DataFrame functions only.

Base spans (email, ip, card, phone) are all matches of their pattern that pass its check. High-recall generators propose further
candidates: secrets, account and other long numbers, groups of digits inside longer runs, bank account codes and disguised e-mail addresses. Each candidate gets
features of its format and of the words around it; gradient-boosted trees score them, and a candidate whose calibrated chance
reaches its kind's threshold is a span, unless a base span covers part of it; of candidates that overlap the likeliest stays. The
trees are fitted once in a session, on generated examples (TRAIN_ROWS, a fixed number) that pass through the same feature
expressions, and are compiled to one Column; calibration and thresholds come from a third of the examples that no tree has seen.

Repetitions are written so that Java's matcher neither recurses nor backtracks over long runs: a separator inside an address or a
number is first replaced by a private-use character of the same length, and then a plain class of characters matches the run.

Offsets are code points, ends are exclusive. Defined results: a null text counts as empty and has no spans; redact() leaves it
null; repeated rows each get their row; of equally likely candidates that overlap (ties) the first, then the longest stays; very
long texts are searched whole; an empty table gives an empty result; other columns pass through redact(), whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import boost
from leafmill.llm.common import columns_of

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "number", "grouped", "iban", "address")
TRAIN_ROWS = 1890
#: Stand-ins for a dot inside a domain, for a separator inside a number, and for either where a text has them itself.
_DOT, _SEP, _OTHER = "", "", ""
_LOCAL = rf"A-Za-z0-9._%+{_DOT}\-"
_LABEL = r"A-Za-z0-9\-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{_DOT}[{_LABEL}{_DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{_SEP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
    "number": r"(?<![0-9])[0-9][0-9 ().-]{5,}[0-9]",
    "grouped": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}(?![A-Za-z0-9])",
    "address": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,24}",
}
#: What a text must hold for a pattern to match in it; the check is far cheaper than the pattern.
_NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][ -]?){12}[0-9]",
    "phone": r"\+[0-9]",
    "secret": r"[0-9]",
    "number": r"[0-9][0-9 ().-]{5,}",
    "grouped": r"[0-9][0-9 ().-]{8,}[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "address": r"(?i)[(\[ ]dot[)\] ]",
}
#: Words that stand before personal data (fixed values).
_SECRET_WORDS = "(?i)token|secret|passw|key|pwd|auth|bearer|credential"
_NUMBER_WORDS = "(?i)account|acct|card|ssn|social|passport|tax|iban|bank|phone|tel|call|mobile|fax|konto|cuenta|compte|member|patient|licen[cs]e no"
_PLAIN_WORDS = "(?i)order|version|build|page|isbn|issue|ticket|item|sku|serial|commit|sha|hash|release|total|price|year"
_WINDOW = 24


def _empty(of: str) -> Column:
    return F.array().cast(of)


_SPAN = "array<struct<s:int,e:int,v:string>>"


def _parts(text: Column, pattern: str, needs: Column) -> Column:
    """Matches and what stands between them."""
    return F.when(needs, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")))


def _located(parts: str) -> Column:
    """Start, end and text of each match."""
    m, p = F.col(f"{parts}.m"), F.col(f"{parts}.p")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(p, i))
        end = start + F.length(F.get(m, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), F.get(m, i).alias("v")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), _empty(_SPAN).alias("out"))
    return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda acc: acc["out"])).otherwise(_empty(_SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0).otherwise(False)


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        small = lambda x: (F.length(F.regexp_replace(x, "^0+(?=[0-9])", "")) <= 3) & (F.substring(F.regexp_replace(x, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255)
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(v))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(text: Column, x: Column, kind: str) -> list[Column]:
    v = x["v"]
    size, digits = F.length(v).cast("double"), F.length(_digits(v)).cast("double")
    before = F.substring(text, F.greatest(x["s"] - _WINDOW + 1, F.lit(1)), F.least(x["s"], F.lit(_WINDOW)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.lit(float(EXTRA.index(kind))),
        size,
        digits,
        digits / size,
        F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        flag(v.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        flag(v.rlike("[a-z]") & v.rlike("[A-Z]")),
        flag(luhn(_digits(v)) & (digits > 11)),
        flag(before.rlike(_SECRET_WORDS)),
        flag(before.rlike(_NUMBER_WORDS)),
        flag(before.rlike(_PLAIN_WORDS)),
        flag(before.rlike(r"[=:][ \"']*$")),
        F.length(F.regexp_replace(v, "[^ ().-]", "")).cast("double"),
        F.length(F.regexp_replace(v, "[^.]", "")).cast("double"),
        F.length(F.regexp_extract(v, "([A-Za-z]+)", 1)).cast("double"),
    ]


def _proposed(text: Column, kind: str) -> Column:
    """Candidates of one generator with their features."""
    return F.transform(F.col(f"_at_{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*_features(text, x, kind)).alias("f")))


# Generated examples. They are made from a seed, so that every session fits the same trees.


def _examples(n: int, seed: int = 7) -> list[tuple[str, str, int]]:
    """Kind of the candidate, text with one candidate of that kind, and if it is personal."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = low + low.upper() + digit
    word = lambda: pick(low, r.randint(2, 9))
    some = lambda: " ".join(word() for _ in range(r.randint(2, 5)))
    secret_word = lambda: r.choice(["token", "secret", "api key", "password", "pwd", "auth", "access key", "bearer", "TOKEN"])
    number_word = lambda: r.choice(["account", "card", "ssn", "passport", "tax id", "bank", "phone", "tel", "call", "mobile", "konto", "cuenta", "compte"])
    plain_word = lambda: r.choice(["order", "version", "build", "isbn", "issue", "ticket", "item", "sku", "serial", "commit", "release", "total"])
    group = lambda s, k, sep: sep.join(s[i : i + k] for i in range(0, len(s), k))
    out = []
    while len(out) < n:
        end = f" {some()}."
        out += [
            ("secret", f"{some()} {secret_word()}{r.choice([' = ', ': ', '=', ' '])}{r.choice(['', chr(34)])}{pick(r.choice(['0123456789abcdef', '0123456789ABCDEF', mixed]), r.randint(20, 64))}1{end}", 1),
            ("secret", f"{some()} {pick('0123456789abcdef', r.choice([32, 40, 64]))}{end}", 1),
            ("secret", f"{some()} {r.choice(['sk-', 'ghp_', 'AKIA'])}{pick(mixed, r.randint(16, 40))}7{end}", 1),
            ("secret", f"{some()} {plain_word()} {pick('0123456789abcdef', 39)}4{end}", 0),
            ("secret", f"{some()} {word()}{word()}{pick(low, 12)}{r.choice(digit)}{end}", 0),
            ("secret", f"{some()} {r.choice('-=_')}{pick('-=_', 20)}{r.choice(digit)}{end}", 0),
            ("secret", f"{some()} {word()}-{word()}-{word()}-{pick(low, 6)}-20{pick(digit, 2)}{end}", 0),
            ("number", f"{some()} {number_word()} {group(pick('123456789', r.randint(9, 16)), r.choice([3, 4]), r.choice(['', ' ', '-', '.']))}{end}", 1),
            ("number", f"{some()} {group(pick('123456789', 16), 4, r.choice(['', ' ', '-']))}{end}", 1),
            ("number", f"{some()} {pick('23456789', 3)}-{pick(digit, 2)}-{pick(digit, 3)}5{end}", 1),
            ("number", f"{some()} {pick('23456789', 3)}{r.choice(' -.')}{pick(digit, 3)}{r.choice('-.')}{pick(digit, 3)}7{end}", 1),
            ("number", f"{some()} {plain_word()} {pick('123456789', r.randint(7, 13))}{end}", 0),
            ("number", f"{some()} {' '.join(pick('123456789', r.randint(1, 2)) for _ in range(r.randint(5, 12)))}{end}", 0),
            ("number", f"{some()} 20{pick(digit, 2)}-0{pick('123456789', 1)}-1{pick(digit, 1)}{end}", 0),
            ("number", f"{some()} {pick('123456789', r.randint(1, 3))}.{pick('123456789', r.randint(6, 9))}{end}", 0),
            ("number", f"{some()} {pick('123456789', r.randint(7, 8))}{end}", 0),
            ("grouped", f"{some()} {pick('123456789', 4)} {group(pick('123456789', 16), 4, r.choice(['', ' ', '-']))}{end}", 1),
            ("grouped", f"{some()} {number_word()} ({pick('23456789', 3)}) {pick(digit, 3)}-{pick(digit, 4)}{end}", 1),
            ("grouped", f"{some()} {plain_word()} {group(pick('123456789', 16), 4, '-')}{end}", 0),
            ("grouped", f"{some()} {plain_word()} {pick('123456789', 3)}.{pick('123456789', 3)}.{pick('123456789', 4)}{end}", 0),
            ("iban", f"{some()} {r.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{pick(digit, 2)}{r.choice(['', ' '])}{group(pick(digit, r.choice([16, 18, 20])), 4, r.choice(['', ' ']))}{end}", 1),
            ("iban", f"{some()} {number_word()} {pick(low.upper(), 2)}{pick(digit, 2)}{pick(digit, 18)}{end}", 1),
            ("iban", f"{some()} {pick(low.upper(), 2)}{pick(digit, 2)}{pick(low.upper(), 14)}{end}", 0),
            ("iban", f"{some()} {plain_word()} {pick(low.upper(), 2)}{pick(digit, 2)}{pick(low.upper() + digit, 11)}{end}", 0),
            ("address", f"{some()} {word()}{r.choice(['(at)', '[at]', ' [at] ', ' (at) '])}{word()}{r.choice(['(dot)', '[dot]', ' [dot] '])}com{end}", 1),
            ("address", f"{some()} {word()} at {word()} dot {r.choice(['com', 'org', 'net'])}{end}", 1),
            ("address", f"{some()} the at the dot {pick(low, r.randint(6, 12))}{end}", 0),
        ]
    return out[:n]


_models: dict[int, tuple[boost.Boosted, dict[str, float]]] = {}


def fit(spark: SparkSession, n: int = TRAIN_ROWS, precision: float = 0.5) -> tuple[boost.Boosted, dict[str, float]]:
    """Trees over all kinds of candidates, and for each kind the least raw score whose calibrated chance is above precision."""
    if n in _models:
        return _models[n]
    rows = _examples(n)
    quoted = ", ".join("({}, '{}', '{}', {})".format(i, k, t.replace("'", ""), y) for i, (k, t, y) in enumerate(rows))
    given = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(i, kind, text, label)").withColumn("_text", F.col("text"))
    got = _with_candidates(given).select("i", "kind", "label", *[_proposed(F.col("_text"), k).alias(k) for k in EXTRA]).collect()
    x, y, kinds, cal = [], [], [], []
    for row in sorted(got, key=lambda r: r.i):
        for c in row[row.kind][:1]:
            x.append(list(c.f))
            y.append(float(row.label))
            kinds.append(row.kind)
            cal.append(row.i // 27 % 3 == 0)
    x, y, cal, kinds = np.array(x), np.array(y), np.array(cal), np.array(kinds)
    model = boost.fit(x[~cal], y[~cal], x[cal], y[cal], trees=30, depth=4)
    raw = model.raw(x)
    chance = np.interp(raw, model.knots, model.levels)
    least = {k: float(raw[cal & (kinds == k) & (chance > precision)].min(initial=np.inf)) for k in EXTRA}
    _models[n] = (model, least)
    return _models[n]


def _compiled(model: boost.Boosted, f: Column) -> Column:
    """The raw score as one expression of conditions on the features."""

    def node(tree: boost.Tree, i: int) -> Column:
        if tree.feature[i] < 0:
            return F.lit(tree.value[i])
        return F.when(F.get(f, F.lit(tree.feature[i])) <= tree.threshold[i], node(tree, tree.left[i])).otherwise(node(tree, tree.right[i]))

    total = F.lit(model.base)
    for tree in model.trees:
        total = total + node(tree, 0)
    return total


def _with_candidates(df: DataFrame) -> DataFrame:
    """df with _at_<kind>, the located matches of every pattern, for its column _text; base matches are checked."""
    text = F.col("_text")
    needs = {k: (text.contains(p) if p == "@" else text.rlike(p)) for k, p in _NEEDS.items()}
    safe = F.regexp_replace(text, f"[{_DOT}{_SEP}]", _OTHER)
    dotted = F.regexp_replace(safe, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", _DOT)
    joined = F.regexp_replace(safe, "(?<=[0-9])[ -](?=[0-9])", _SEP)
    df = df.withColumns({"_dotted": F.when(needs["email"], dotted), "_joined": F.when(needs["card"], joined)})
    sources = {"email": ("_dotted", EMAIL), "ip": ("_text", IP), "card": ("_joined", CARD), "phone": ("_text", PHONE)} | {k: ("_text", p) for k, p in GENERATORS.items()}
    df = df.withColumns({f"_parts_{k}": _parts(F.col(c), p, F.col(c).isNotNull() if c != "_text" else needs[k]) for k, (c, p) in sources.items()}).drop("_dotted", "_joined")
    df = df.withColumns({f"_at_{k}": F.coalesce(_located(f"_parts_{k}"), _empty(_SPAN)) for k in sources}).drop(*[f"_parts_{k}" for k in sources])
    return df.withColumns({f"_at_{k}": _checked(k) for k in ("ip", "card", "phone")})


def _checked(kind: str) -> Column:
    return F.filter(F.col(f"_at_{kind}"), lambda x: _valid(kind, x["v"]))


def _spanned(df: DataFrame, text: str = "text") -> DataFrame:
    """_kept (the row), _text, and _lm_base and _lm_extra: spans (kind, s, e) by kind as listed and start. The row is packed, so that no column of it meets one of ours."""
    model, least = fit(df.sparkSession)
    inner = df.select(F.struct(*columns_of(df)).alias("_kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    got = _with_candidates(inner)
    named = lambda k: F.transform(F.col(f"_at_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    got = got.withColumns({"_lm_base": F.concat(*[named(k) for k in BASE])} | {f"_c_{k}": F.when(F.size(f"_at_{k}") > 0, _proposed(F.col("_text"), k)) for k in EXTRA})
    scored = lambda k: F.transform(F.col(f"_c_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _compiled(model, x["f"]).alias("p")))
    chosen = lambda k: F.filter(scored(k), lambda x: (x["p"] >= least[k]) & ~F.exists(F.col("_lm_base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    got = got.withColumn("_chosen", F.concat(*[F.when(F.size(f"_c_{k}") > 0, chosen(k)).otherwise(_empty("array<struct<kind:string,s:int,e:int,p:double>>")) for k in EXTRA]))
    # Of candidates that overlap the likeliest stays, of equals the first, then the longest.
    ranked = F.array_sort(F.transform("_chosen", lambda x: F.struct((-x["p"]).alias("p"), x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    kind_of = "array<struct<kind:string,s:int,e:int>>"

    def taken(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["s"] < -x["e"]) & (x["s"] < y["e"]))
        return F.when(free, F.concat(acc, F.array(F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["e"]).alias("e"))))).otherwise(acc)

    picked = F.when(F.size("_chosen") > 0, F.aggregate(ranked, _empty(kind_of), taken)).otherwise(_empty(kind_of))
    placed = F.transform(F.array_sort(F.transform("_picked", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    got = got.withColumn("_picked", picked).withColumn("_swept", F.when(F.size("_picked") > 1, placed).otherwise(F.col("_picked")))
    return got.withColumn("_lm_extra", F.concat(*[_of_kind(k) for k in EXTRA])).select("_kept", "_text", "_lm_base", "_lm_extra")


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _lm_base and _lm_extra, spans (kind, s, e) by kind as listed and start, in place of any columns so named."""
    kept = [F.col("_kept").getField(c).alias(c) for c in df.columns if c.lower() not in ("_lm_base", "_lm_extra")]
    return _spanned(df, text).select(*kept, "_lm_base", "_lm_extra")


def _of_kind(kind: str) -> Column:
    return F.filter("_swept", lambda x: x["kind"] == kind)


def _joined_spans(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every document."""
    got = spans(documents.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_lm_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined_spans(F.col("_lm_base")).cast("binary"), 256).alias("base_sha256"), _joined_spans(F.concat("_lm_base", "_lm_extra")).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first. n_chars follows a changed text."""
    got = _spanned(documents)
    placed = F.array_sort(F.transform(F.concat("_lm_base", "_lm_extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    of = "array<struct<s:int,e:int,kind:string>>"

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (x["s"] < F.when(F.size(acc) > 0, last["e"]).otherwise(0))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    got = got.withColumn("_placed", placed).withColumn("_merged", F.when(F.size("_placed") > 0, F.aggregate("_placed", _empty(of), merge)))
    text, merged = F.col("_text"), F.col("_merged")
    before = lambda i: F.when(i > 0, F.get(merged, i - 1)["e"]).otherwise(0)
    pieces = F.transform(merged, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    tail = F.substring(text, F.element_at(merged, -1)["e"] + 1, F.length(text))
    got = got.withColumn("_new", F.when(merged.isNotNull(), F.concat(F.array_join(pieces, ""), tail)))
    kept = lambda c: F.col("_kept").getField(c)

    def shown(c: str) -> Column:
        if c == "text":
            return F.coalesce(F.col("_new"), kept(c))
        if c == "n_chars":
            return F.when(F.col("_new").isNull(), kept(c)).otherwise(F.length("_new")).cast(documents.schema[c].dataType)
        return kept(c)

    return got.select(*[shown(c).alias(c) for c in documents.columns])
