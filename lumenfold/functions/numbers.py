"""Column functions for numbers: exact tests, tail probabilities, quantiles, bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sign_p(up, down, empty: float | None = None) -> Column:
    """Two-sided exact sign test; without pairs the value of empty (None or 1.0).

    The binomial terms follow from each other in log space, so any number of pairs is in range.
    """
    m, k = col(up) + col(down), F.least(col(up), col(down))
    start = F.struct((-m * math.log(2)).cast("double").alias("t"), F.exp((-m * math.log(2)).cast("double")).alias("s"))

    def step(acc, i):
        t = acc["t"] + F.log((m - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: F.least(F.lit(1.0), 2 * a["s"]))
    return F.when(m == 0, F.lit(empty).cast("double")).otherwise(total)


#: Coefficients of the complementary error function's exponent in t, from the constant on: fixed values.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_tail(z) -> Column:
    """P(Z > |z|), with a relative error below 1.2e-7 however far out, so small p keep their order."""
    x = F.abs(col(z)) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return 0.5 * t * F.exp(-x * x + poly)


def normal_tail_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::double))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = f"{ERFC[-1]}::double"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}::double + {t} * {poly})"
    return f"(0.5 * {t} * exp(-{x} * {x} + {poly}))"


def sigmoid(z, bound: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(col(z), F.lit(bound)), F.lit(-bound))))


def log1p_clamped(x) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), col(x).cast("double")))


def cut_bin(x, cuts: list[float]) -> Column:
    """The index of the first cut that is not below x; the number of cuts if all are."""
    out = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        out = F.when(col(x) <= cuts[i], i).otherwise(out)
    return F.when(col(x).isNotNull(), out)


def months(first, last) -> Column:
    """Months of 30.44 days between two dates, three at least."""
    return F.greatest(F.lit(3.0), F.datediff(col(last), col(first)) / 30.44)


def fisher_p(a, b, c, d) -> Column:
    """Two-sided exact test of a 2 x 2 table: the tables that are no likelier than the one seen.

    Log-odds between neighbouring tables follow from each other, so nothing overflows and no gamma
    function is needed: one pass finds the seen and the largest term, another sums.
    """
    a, b, c, d = (col(x).cast("long") for x in (a, b, c, d))
    row, column, rest = a + b, a + c, d - a
    lo = F.greatest(F.lit(0).cast("long"), -rest)
    steps = F.sequence(lo, F.least(row, column))
    nxt = lambda x: F.log(((row - x + 1) * (column - x + 1)).cast("double") / (x * (x + rest)))
    zero = F.lit(0.0)
    first = F.struct(zero.alias("l"), zero.alias("seen"), zero.alias("top"))

    def look(acc, x):
        l = F.when(x == lo, zero).otherwise(acc["l"] + nxt(x))
        return F.struct(l.alias("l"), F.when(x == a, l).otherwise(acc["seen"]).alias("seen"), F.greatest(acc["top"], l).alias("top"))

    def total(found):
        def add(acc, x):
            l = F.when(x == lo, zero).otherwise(acc["l"] + nxt(x))
            e = F.exp(l - found["top"])
            return F.struct(l.alias("l"), (acc["s"] + F.when(l <= found["seen"] + 1e-7, e).otherwise(zero)).alias("s"), (acc["all"] + e).alias("all"))

        return F.aggregate(steps, F.struct(zero.alias("l"), zero.alias("s"), zero.alias("all")), add, lambda t: F.least(F.lit(1.0), t["s"] / t["all"]))

    # bound as an element of an array, the first pass is made once, not once a table
    return F.get(F.transform(F.array(F.aggregate(steps, first, look)), total), 0)


def rule_of_three(k, n) -> Column:
    """The customary upper bound 3 / n of a rate of which nothing was seen; null if something was."""
    return F.when((col(k) == 0) & (col(n) > 0), 3 / col(n))


def sign_mde(n, alpha: float = 0.05) -> Column:
    """The least number of n pairs on one side that the exact sign test calls significant, else null."""
    k = F.sequence(F.ceil(col(n) / 2), col(n))
    return F.array_min(F.filter(k, lambda x: sign_p(x, col(n) - x) <= alpha))


def beta_upper(k, n, level: float = 0.975, rounds: int = 50) -> Column:
    """The exact upper bound of k in n: the rate at which k or fewer have the probability 1 - level, by bisection."""
    k, n = col(k).cast("long"), col(n).cast("long")

    def below(p):
        first = F.struct((n * F.log1p(-p)).alias("l"), F.exp(n * F.log1p(-p)).alias("s"))

        def add(acc, i):
            l = acc["l"] + F.log((n - i + 1) / i) + F.log(p) - F.log1p(-p)
            return F.struct(l.alias("l"), (acc["s"] + F.exp(l)).alias("s"))

        return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), first, add, lambda t: t["s"])

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        over = below(mid) > 1 - level
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    bound = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ends, halve, lambda t: t["hi"])
    return F.when(n == 0, None).when(k >= n, 1.0).otherwise(bound)
