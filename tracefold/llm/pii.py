"""PII (operator 10, native): patterns and high-recall candidates, decided by gradient-boosted trees.

Four base kinds (email, ip, card, phone) are taken by pattern, leftmost and non-overlapping, failing
matches dropped; they always stay. Looser generators then propose further, overlapping spans: addresses
written out ("name at host dot com"), e-mail addresses without a dot, telephone numbers without a plus,
numbers of identity papers, bank accounts and dotted quads out of range. Features of a candidate's format and of the
words beside it go through boosted trees; spans above their kind's calibrated threshold that no chosen span
overlaps are added. Everything over documents is SQL functions; trees become CASE expressions.

Positions come from split() and regexp_extract_all(), whose pieces alternate, so no row is scanned by
anything but the JVM's matcher. Patterns repeat characters, never groups without bound: an address's host
is all characters up to the first that can't go on, however many labels it has.

The trees are fitted on labelled candidates: true and false kinds as rules below, filled from a seeded
generator (the tables have no labels for personal data), by Newton boosting with logistic loss; each
kind's threshold is the least at which held-out candidates of that kind reach the wanted precision.

Defined cases: null and empty texts have no spans; very long texts and matches are taken whole; repeated rows
each get their row; an empty table gives no rows; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of kinds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_words", "email_host", "phone_local", "id_number", "account")
#: A match may start after the match before it or where no character of its first run stands before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_words": r"(?i)\b[a-z0-9._%+-]{2,40}(?: ?\[at\] ?| ?\(at\) ?| at )[a-z0-9-]{2,40}(?: ?\[dot\] ?| ?\(dot\) ?| dot )[a-z]{2,10}\b",
    "email_host": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}@[A-Za-z0-9-]{2,40}(?![A-Za-z0-9.-])",
    "phone_local": r"(?<![0-9A-Za-z.+@-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9A-Za-z@-])",
    "id_number": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,8}[A-Z]?)(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried at all; null: always tried.
NEEDS = {"email": "@", "email_host": "@", "phone": "+", "ip": "."}
CONTEXT = {
    "c_phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|contact|dial|whatsapp)",
    "c_mail": r"(?i)(?:e-?mail|mail|contact|write|reach)",
    "c_id": r"(?i)\b(?:ssn|social|passport|licen[cs]e|national|identity|dni|nif|id)\b",
    "c_bank": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)",
    "c_person": r"(?i)\b(?:my|mine|name|mr|mrs|ms|born|address|customer|patient|employee)\b",
    "c_other": r"(?i)\b(?:version|order|invoice|isbn|page|pages|figure|table|date|price|total|ref|item|part|score|section|chapter|fig|no)\b",
}
FEATURES = ("n_chars", "n_digits", "n_marks", "n_letters", "dated", "repeated", *CONTEXT)
NEAR = 28
ROUNDS, LEAVES_DEPTH, RATE, FINDINGS, PRECISION, SEED = 24, 3, 0.4, 2400, 0.97, 5


# --- candidates of a text, as SQL ---------------------------------------------------------------


def _found(kind: str) -> Column:
    """ARRAY<STRUCT<s, e, v>> of a pattern's matches, with positions in code points."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    outside = F.transform(F.split("text", PATTERNS[kind], -1), lambda p: F.length(p))
    row = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.expr("CAST(array() AS array<struct<s:int,e:int,v:string>>)").alias("out"))
    # pairs of (characters before, match); a text with matches has one more piece outside than matches
    pairs = F.zip_with(matches, F.slice(outside, 1, F.size(matches)), lambda m, o: F.struct(m.alias("m"), o.alias("o")))
    steps = F.aggregate(
        pairs,
        row,
        lambda a, p: F.struct(
            (a["at"] + p["o"] + F.length(p["m"])).alias("at"),
            (a["k"] + 1).alias("k"),
            F.concat(a["out"], F.array(F.struct((a["at"] + p["o"]).alias("s"), (a["at"] + p["o"] + F.length(p["m"])).alias("e"), p["m"].alias("v")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return steps


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second doubled, less 9 above 9."""
    d = F.reverse(_digits(v))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda n, k: n + F.when(k % 2 == 1, F.substring(d, k, F.lit(1)).cast("int")).otherwise(
            2 * F.substring(d, k, F.lit(1)).cast("int") - F.when(F.substring(d, k, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        # leading zeros don't count; more than three digits are above 255
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lpad(F.ltrim(p, F.lit("0")), 3, "0")), F.lit("999")), F.lit(999)) <= 255))
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _context(text: Column, s: Column, e: Column) -> tuple[Column, Column]:
    low = F.greatest(F.lit(0), s - NEAR)
    return F.substring(text, low + 1, s - low), F.substring(text, e + 1, F.lit(NEAR // 2))


def _features(v: Column, beside: Column) -> Column:
    digits = F.length(_digits(v))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    return F.struct(
        F.length(v).cast("double").alias("n_chars"),
        digits.cast("double").alias("n_digits"),
        (F.length(v) - digits - letters).cast("double").alias("n_marks"),
        letters.cast("double").alias("n_letters"),
        v.rlike(r"^(?:[0-3]?[0-9][./ -][01]?[0-9][./ -](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./ -][0-9]{2}[./ -][0-9]{2})").cast("double").alias("dated"),
        v.rlike(r"([0-9])\1{3}").cast("double").alias("repeated"),
        *(beside.rlike(p).cast("double").alias(n) for n, p in CONTEXT.items()),
    )


# --- trees --------------------------------------------------------------------------------------


def _plain_features(v: str, beside: str) -> list[float]:
    """The same features for a training candidate."""
    digits, letters = len(re.sub("[^0-9]", "", v)), len(re.sub("[^A-Za-z]", "", v))
    dated = bool(re.match(r"^(?:[0-3]?[0-9][./ -][01]?[0-9][./ -](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./ -][0-9]{2}[./ -][0-9]{2})", v))
    return [float(x) for x in (len(v), digits, len(v) - digits - letters, letters, dated, bool(re.search(r"([0-9])\1{3}", v)), *(bool(re.search(p, beside)) for p in CONTEXT.values()))]


def labelled_candidates(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, list[float], int]]:
    """(kind, features, label): rules for true and false candidates, filled by a seeded generator."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    up = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTXY") for _ in range(k))
    prose = lambda: " ".join(w() for _ in range(3))
    tell = {
        "phone_local": ["call me at ", "phone: ", "tel. ", "my number is ", "mobile ", "contact "],
        "email_words": ["email me: ", "write to ", "contact ", "reach me: ", "my mail is "],
        "email_host": ["email: ", "my mail ", "contact "],
        "id_number": ["SSN ", "passport ", "my id ", "national identity ", "license "],
        "account": ["IBAN ", "my account ", "bank: ", "account number "],
    }
    true = {
        "phone_local": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}"]),
        "email_words": lambda: r.choice([f"{w()} at {w()} dot com", f"{w()} [at] {w()} [dot] org", f"{w()}{d(2)} (at) {w()} (dot) net"]),
        "email_host": lambda: f"{w()}.{w()}@{w()}",
        "id_number": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{up(1)}{d(8)}", f"{up(2)}{d(7)}"]),
        "account": lambda: f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
    }
    false = {
        "phone_local": lambda: r.choice([f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}/{d(2)} {d(2)}"]),
        "email_words": lambda: f"{w()} at {w()} dot {w()[:6]}",
        "email_host": lambda: r.choice([f"{w()}@{w()}", f"{d(2)}@{d(3)}"]),
        "id_number": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{up(1)}{d(6)}", f"{up(2)}{d(6)}"]),
        "account": lambda: f"{up(2)}{d(2)} {up(4)} {d(4)} {up(4)}",
    }
    other = ["version ", "order ", "invoice ", "pages ", "table ", "figure ", "item ", "ref ", "section ", "part ", "", "", ""]
    out = []
    for k in range(n):
        kind, label = ADDED[k // 2 % len(ADDED)], k % 2
        v = (true if label else false)[kind]()
        before = r.choice(tell[kind]) if label and r.random() < 0.9 else r.choice(["my ", ""]) if label else r.choice(other)
        out.append((kind, _plain_features(v, f"{prose()} {before} {w()}"), label))
    return out


def _boost(x: list[list[float]], y: list[int]) -> list:
    """Newton boosting of small trees with logistic loss; a tree is a nested (feature, cut, left, right) or a value."""
    score = [0.0] * len(x)
    cuts = [sorted({(a + b) / 2 for a, b in zip(v, v[1:], strict=False)})[:24] for v in (sorted({row[f] for row in x}) for f in range(len(x[0])))]

    def grow(rows: list[int], depth: int, g: list[float], h: list[float]):
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best, gain = None, 1e-6
        if depth:
            for f, at in enumerate(cuts):
                for c in at:
                    lg = lh = 0.0
                    for i in rows:
                        if x[i][f] <= c:
                            lg += g[i]
                            lh += h[i]
                    if lh > 1 and sh - lh > 1:
                        now = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                        if now > gain:
                            best, gain = (f, c), now
        if best is None:
            return RATE * sg / (sh + 1)
        f, c = best
        return (f, c, grow([i for i in rows if x[i][f] <= c], depth - 1, g, h), grow([i for i in rows if x[i][f] > c], depth - 1, g, h))

    trees = []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(list(range(len(x))), LEAVES_DEPTH, [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p])
        trees.append(tree)
        score = [s + _value(tree, row) for s, row in zip(score, x, strict=True)]
    return trees


def _value(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(1)
def model() -> dict[str, tuple[list, float]]:
    """For each added kind its trees and the least score that is redacted."""
    found, out = labelled_candidates(), {}
    for kind in ADDED:
        own = [(f, y) for k, f, y in found if k == kind]
        fit, held = own[: 2 * len(own) // 3], own[2 * len(own) // 3 :]
        trees = _boost([f for f, _ in fit], [y for _, y in fit])
        scored = sorted(((sum(_value(t, f) for t in trees), y) for f, y in held), reverse=True)
        cut, good = math.inf, 0
        for n, (s, y) in enumerate(scored, 1):
            good += y
            if good / n >= PRECISION:
                cut = s
        out[kind] = trees, cut
    return out


def _tree_sql(tree, c: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN {c}.f.{FEATURES[tree[0]]} <= {tree[1]!r}D THEN {_tree_sql(tree[2], c)} ELSE {_tree_sql(tree[3], c)} END"


# --- the operator -------------------------------------------------------------------------------


def _spans(kind: str) -> Column:
    """A kind's spans that pass its check: ARRAY<STRUCT<s, k, e, v>>."""
    found = F.filter(_found(kind), lambda m: _passes(kind, m["v"]))
    order = (BASE + ADDED).index(kind)
    shaped = F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(order).alias("k"), m["e"].alias("e"), m["v"].alias("v")))
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int,v:string>>)")
    tried = F.contains("text", F.lit(NEEDS[kind])) & F.col("text").rlike(PATTERNS[kind]) if kind in NEEDS else F.col("text").rlike(PATTERNS[kind])
    return F.when(tried, shaped).otherwise(none)


def _joined(name: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in BASE + ADDED)
    return f"array_join(transform({name}, x -> concat(element_at(array({kinds}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans, n_added. Each row by itself: no shuffle."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.select("*", F.explode(F.array(F.struct(*(_spans(k).alias(k) for k in BASE + ADDED)))).alias("m"))
    df = df.select("*", F.explode(F.array(F.array_sort(F.concat(*(F.col(f"m.{k}") for k in BASE))))).alias("base"))
    # candidates clear of the base spans, with features, in order of score: the best first
    near = lambda c: F.concat_ws(" ", *_context(F.col("text"), c["s"], c["e"]))
    free = F.filter(F.concat(*(F.col(f"m.{k}") for k in ADDED)), lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    df = df.select("*", F.explode(F.array(F.transform(free, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), _features(c["v"], near(c)).alias("f"))))).alias("c"))
    pick = " ".join(f"WHEN {len(BASE) + n} THEN ({' + '.join(_tree_sql(t, 'c') for t in trees)}) - {min(cut, 1e9)!r}D" for n, (trees, cut) in enumerate(model()[k] for k in ADDED))
    scored = f"filter(transform(c, c -> struct(-(CASE c.k {pick} END) AS r, c.s AS s, c.k AS k, c.e AS e)), x -> x.r <= 0)"
    df = df.select("doc_id", "base", F.explode(F.array(F.expr(f"sort_array({scored})"))).alias("c"))
    df = df.select("doc_id", "base", F.explode(F.array(F.expr(
        "aggregate(c, CAST(array() AS array<struct<s:int,k:int,e:int>>), (a, x) -> IF(exists(a, y -> y.s < x.e AND x.s < y.e), a, concat(a, array(struct(x.s AS s, x.k AS k, x.e AS e)))))"
    ))).alias("added"))
    return df.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{n}") for k, n in enumerate(BASE)),
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("sort_array(concat(transform(base, x -> struct(x.s AS s, x.k AS k, x.e AS e)), added))")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
