"""Statistics as column expressions: no collected samples, no UDFs."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the C library's lgamma from 8 on, so that SQL's p and ours agree to the last digits.
STIRLING = (4.18938533204672725052e-01, 8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04, -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def _parts(v: Decimal) -> tuple[float, float]:
    """A number as a multiple of 2^-40 and the rest, so that sums of first parts are exact."""
    high = math.floor(v * 2**40) / 2**40
    return high, float(v - Decimal(high))


LOG2, LOGS = _parts(Decimal(2).ln()), [_parts((Decimal(2 * k + 257) / 256).ln()) for k in range(128)]


def exact_log(x: Column) -> Column:
    """ln of a whole number of 1 or more, rounded once: the JVM's own may be off by a digit, which n ln n makes visible."""
    k = F.length(F.bin(x.cast("long"))) - 1
    m = x / F.pow(F.lit(2.0), k)
    at = F.floor((m - 1) * 128).cast("int")
    c = (2 * at + 257) / 256.0
    of = lambda part: F.get(F.array(*(F.lit(v[part]) for v in LOGS)), at)
    return (k * F.lit(LOG2[0]) + of(0)) + (F.log1p((m - c) / c) + (k * F.lit(LOG2[1]) + of(1)))


def log_factorial(n: Column) -> Column:
    """ln n!, n a whole number of 0 or more."""
    x = n.cast("double") + 1
    z = 1 / x
    y = z * z
    series = F.lit(STIRLING[-1])
    for c in STIRLING[-2:0:-1]:
        series = F.lit(c) + y * series
    large = (x - 0.5) * (exact_log(x) - 1) + (F.lit(STIRLING[0]) + z * series)
    few = F.element_at(F.array(*(F.lit(math.log(math.factorial(k))) for k in range(7))), (F.least(n, F.lit(6)) + 1).cast("int"))
    return F.when(n < 7, few).otherwise(large)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table [[a, b], [c, d]]: all tables no likelier than the seen one (within 1e-10); null if empty.

    Each table's p comes from its own factorials, in SQL's order: steps from one to the next would add up their errors.
    All tables within 1e-10 of nothing count, so p isn't below some 1e-11 unless there are few tables; by Hoeffding's
    bound those farther than sqrt(40 m) from the mean, m the least margin, are below e^-80 each and can't change a digit.
    """

    def of(t: Column) -> Column:
        row, col, n = t["row"], t["col"], t["n"]
        mean, reach = (row.cast("double") * col / n), F.sqrt(40.0 * F.least(row, col, n - row, n - col)) + 2
        low = F.greatest(F.lit(0).cast("long"), row + col - n, F.floor(mean - reach))
        high = F.least(row, col, F.ceil(mean + reach))
        p = lambda x: F.exp(t["col_"] - log_factorial(x) - log_factorial(col - x) + t["rest_"] - log_factorial(row - x) - log_factorial(n - col - row + x) - t["n_"] + t["row_"] + t["other_"])
        add = lambda s, x: F.struct((s["sum"] + let(p(x), lambda v: F.when(v <= s["seen"], v).otherwise(0.0))).alias("sum"), s["seen"].alias("seen"))
        return F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("sum"), (p(t["a"]) + 1e-10).alias("seen")), add, lambda s: s["sum"])

    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    named = {"col_": col, "rest_": n - col, "n_": n, "row_": row, "other_": n - row}
    table = F.struct(a.alias("a"), row.alias("row"), col.alias("col"), n.alias("n"), *(log_factorial(v).alias(k) for k, v in named.items()))
    return F.when(n > 0, F.least(F.lit(1.0), let(table, of)))


def sign_test(positive: Column, negative: Column, least: int = 5) -> Column:
    """Two-sided exact binomial p; null with fewer than ``least`` signs."""
    n, k = positive + negative, F.least(positive, negative)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda s, i: s + F.exp(log_choose(n, i) - n * F.log(F.lit(2.0))))
    return F.when(n >= least, F.least(F.lit(1.0), 2 * tail))


def adjusted(rows: DataFrame, p: str = "p_value", q: str = "q_value", by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg within ``by``: least p * m / rank from the back; null p stays null. A window over
    candidates, not rows of data; give ``by`` where there are many."""
    part = Window.partitionBy(*by, F.col(p).isNull())
    ranked = rows.withColumn("__m", F.count(p).over(part)).withColumn("__r", F.row_number().over(part.orderBy(p)))
    back = part.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(back)))).drop("__m", "__r")


def cohens_h(p1: Column, p2: Column) -> Column:
    root = lambda p: 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))
    return root(p1) - root(p2)


def delta_interval(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    """Wald interval of p2 - p1; (-1, 1) where a side is empty."""
    half = 1.96 * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    empty = (n1 == 0) | (n2 == 0)
    return F.when(empty, -1.0).otherwise(p2 - p1 - half), F.when(empty, 1.0).otherwise(p2 - p1 + half)


def effect_magnitude(h: Column) -> Column:
    size = F.abs(h)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def erfc(x: Column) -> Column:
    """Complementary error function: by its series within 3, by its continued fraction beyond."""

    def of(a: Column) -> Column:
        series = F.aggregate(
            F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("sum")),
            lambda s, n: let(-s["t"] * a * a / n, lambda t: F.struct(t.alias("t"), (s["sum"] + t / (2 * n + 1)).alias("sum"))), lambda s: s["sum"],
        )
        tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda f, k: a + k / 2.0 / f)
        return F.when(a < 3, 1 - series * (2 / math.sqrt(math.pi))).otherwise(F.exp(-a * a) / math.sqrt(math.pi) / tail)

    return let(x.cast("double"), lambda v: let(of(F.abs(v)), lambda half: F.when(v < 0, 2 - half).otherwise(half)))


def chi2_survival(x: Column, df: Column) -> Column:
    """Share of the chi-squared distribution above x, by the cube-root normal approximation; 1 at 0 and below."""
    spread = 2 / (9 * df)
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread)
    return F.when(x <= 0, 1.0).otherwise(0.5 * erfc(z / math.sqrt(2)))


def chi2_table(branches: Column) -> Column:
    """p of an ARRAY<STRUCT<n_pass, n_fail>> against equal rates; branches without known outcomes don't count, and one branch alone is 1."""

    def of(known: Column) -> Column:
        total = lambda c: F.aggregate(known, F.lit(0.0), lambda a, x: a + x[c])

        def part(x: Column, c: str, side: Column, all_: Column) -> Column:
            return let((x["n_pass"] + x["n_fail"]) * side / all_, lambda e: F.when(e > 0, (x[c] - e) * (x[c] - e) / e).otherwise(0.0))

        def chi(t: Column) -> Column:
            all_ = t["p"] + t["f"]
            return F.aggregate(known, F.lit(0.0), lambda a, x: a + part(x, "n_pass", t["p"], all_) + part(x, "n_fail", t["f"], all_))

        df = F.size(known) - 1
        found = let(F.struct(total("n_pass").alias("p"), total("n_fail").alias("f")), chi)
        return F.when(df <= 0, 1.0).otherwise(let(found, lambda x: chi2_survival(x, df.cast("double"))))

    return let(F.filter(branches, lambda x: x["n_pass"] + x["n_fail"] > 0), of)


def phi(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Correlation of a 2x2 table; null where a margin is empty."""
    return F.try_divide((a * d - b * c).cast("double"), F.sqrt(((a + b) * (c + d) * (a + c) * (b + d)).cast("double")))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total))
