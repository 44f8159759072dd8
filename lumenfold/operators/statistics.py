"""Small-sample statistics on long tables (test, group, value): one shuffle by test serves every test.

Ranks are taken over distinct values: rows are first counted by (test, value), so ties cost nothing and a
large test sends one row a value to its window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn
from ..functions.numbers import col, fisher_p, normal_tail, sign_p


def midranks(df: DataFrame, test: str, value: str, *groups: str) -> DataFrame:
    """(test, value, n, midrank, and the number of rows of each boolean group column)."""
    held = [F.count_if(F.col(g)).alias(g) for g in groups]
    c = df.where(F.col(value).isNotNull()).groupBy(test, value).agg(F.count("*").alias("n"), *held)
    upto = Window.partitionBy(test).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("midrank", F.coalesce(F.sum("n").over(upto), F.lit(0)) + (F.col("n") + 1) / 2)


def placed(df: DataFrame, by: Column, key: str, parts: int = 64) -> DataFrame:
    """df in the falling order of by, nulls last, then of key, with place: 1 for the first row.

    Ranges of by are ranked side by side and their counts summed, so no task has all rows. The bounds are
    read from df first; places do not depend on them.
    """
    r = df.withColumn("__by", by.cast("double"))
    cuts = r.agg(F.percentile_approx("__by", [i / parts for i in range(1, parts)]).alias("c")).first().c or []
    part = F.when(F.col("__by").isNull(), -1).otherwise(sum([(F.col("__by") > c).cast("int") for c in sorted(set(cuts))], F.lit(0)))
    r = r.withColumn("__part", part)
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("__by").desc_nulls_last(), key))
    out = r.withColumn("__here", here).join(F.broadcast(before), "__part")
    return out.withColumn("place", (F.col("__before") + F.col("__here")).cast("long")).orderBy("place").drop("__by", "__part", "__here", "__before")


def auc_mann_whitney(df: DataFrame, test: str, value: str, positive: str) -> DataFrame:
    """By test: n1, n0, auc and the tie-corrected normal p; auc is null with one class, p below two rows a class."""
    r = midranks(df, test, value, positive)
    a = r.groupBy(test).agg(F.sum(positive).alias("n1"), F.sum(F.col("n") - F.col(positive)).alias("n0"), F.sum(F.col(positive) * F.col("midrank")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n = F.col("n1") + F.col("n0")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0)))
    z = (u - F.col("n1") * F.col("n0") / 2) / F.sqrt(F.nullif(var, F.lit(0.0)))
    p = F.when((F.col("n1") < 2) | (F.col("n0") < 2), None).when(var <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z)))
    return a.select(test, "n1", "n0", (u / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"), p.alias("p"))


def wilcoxon(df: DataFrame, test: str, diff: str, least: int = 5) -> DataFrame:
    """By test: non-zero differences n, rank sum w of the positive ones, tie-corrected p with 0.5 continuity."""
    d = df.where(F.col(diff) != 0).select(test, F.abs(F.col(diff)).alias("a"), (F.col(diff) > 0).alias("pos"))
    r = midranks(d, test, "a", "pos")
    a = r.groupBy(test).agg(F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("midrank")).alias("w"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")  # the cube of a few million is no long
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    # the continuity term goes towards the mean, and counts as below it where w is the mean itself
    z = (F.col("w") - mean - F.when(F.col("w") > mean, 0.5).otherwise(-0.5)) / F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0)))
    return a.select(test, "n", "w", F.when(n >= least, F.when(var <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z)))).alias("p"))


def bh_fdr(df: DataFrame, p: str, *by: str, parts: int = 1024) -> DataFrame:
    """q by Benjamini and Hochberg over the non-null p of each family.

    Equal p share their largest rank, so distinct values are ranked, range of p by range of p: a family of any
    size is the work of many tasks, and only sums and minima of the ranges meet in one.
    """
    keys = list(by)
    part = F.least(F.floor(F.col(p) * parts), F.lit(parts - 1))
    d = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("__n")).withColumn("__part", part)
    up, down = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part"), Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__part"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy(*keys, "__part").agg(F.sum("__n").alias("__held"))
    held = held.select(*keys, "__part", F.coalesce(F.sum("__held").over(past(up)), F.lit(0)).alias("__before"), F.sum("__held").over(Window.partitionBy(*(keys or [F.lit(0)]))).alias("__m"))
    inner = Window.partitionBy(*keys, "__part")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("__before") + F.sum("__n").over(upto(inner.orderBy(p)))
    d = d.join(held, [*keys, "__part"]).withColumn("__raw", F.col(p) * F.col("__m") / rank)
    least = d.groupBy(*keys, "__part").agg(F.min("__raw").alias("__least"))
    least = least.select(*keys, "__part", F.min("__least").over(past(down)).alias("__later"))
    d = d.join(least, [*keys, "__part"])
    q = F.least(F.lit(1.0), F.min("__raw").over(upto(inner.orderBy(F.desc(p)))), F.col("__later"))
    return df.join(d.select(*keys, p, q.alias("q")), [*keys, p], "left")


def order_statistics(df: DataFrame, keys: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """(keys, a column a name): the element of each group's sorted values at a 0-based place, an expression of n.

    Values are counted first and their counts summed in order, so no group's values are gathered in one row.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    c = c.withColumn("__upto", F.sum("__k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("__k").over(w))
    at = lambda i: F.max(F.when((i < F.col("__upto")) & (i >= F.col("__upto") - F.col("__k")), F.col(value)))
    return c.groupBy(*keys).agg(*[at(i).alias(name) for name, i in indexes.items()])


def mann_whitney_auto(df: DataFrame, test: str, value: str, positive: str, small: int = 8) -> DataFrame:
    """By test: n1, n0, U of the positive rows and p as statistics libraries give it by default.

    Exact without ties where a side has small rows or fewer (counts of the arrangements with at most that U, by
    recurrence, of tests that are small themselves), else normal with the 0.5 continuity and ties corrected.
    """
    r = midranks(df, test, value, positive)
    a = r.groupBy(test).agg(F.sum(positive).alias("n1"), F.sum(F.col("n") - F.col(positive)).alias("n0"), F.sum(F.col(positive) * F.col("midrank")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n, u = F.col("n1") + F.col("n0"), F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0)))
    z = (F.abs(u - F.col("n1") * F.col("n0") / 2) - 0.5) / F.sqrt(F.nullif(var, F.lit(0.0)))
    tail = normal_tail(z)
    normal = F.when(var <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(z < 0, 1 - tail).otherwise(tail)))
    a = a.select(test, "n1", "n0", u.alias("u"), normal.alias("p"), ((F.least("n1", "n0") <= small) & (F.greatest("n1", "n0") <= 200) & (F.col("ties") == 0)).alias("__exact"))
    kind = df.schema[test].dataType.simpleString()

    def exact(it):
        for g in it:
            g["p"] = [_exact_u(int(x.n1), int(x.n0), float(x.u)) for x in g.itertuples()]
            yield g

    some = a.where("__exact").mapInPandas(exact, f"{test} {kind}, n1 bigint, n0 bigint, u double, p double, __exact boolean")
    return a.where("not __exact").unionByName(some).select(test, "n1", "n0", "u", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("p")).alias("p"))


def _exact_u(n1: int, n0: int, u: float) -> float:
    """Two-sided exact p: twice the share of arrangements whose U is as far out."""
    ways = [1] + [0] * (n1 * n0)
    for i in range(1, min(n1, n0) + 1):  # the Gaussian binomial, factor by factor
        top = max(n1, n0) + i
        for k in range(len(ways) - 1, top - 1, -1):
            ways[k] -= ways[k - top]
        for k in range(i, len(ways)):
            ways[k] += ways[k - i]
    low = int(min(u, n1 * n0 - u))
    return min(1.0, 2 * sum(ways[: low + 1]) / sum(ways))


def univariate(df: DataFrame, test: str, value: str, positive: str) -> DataFrame:
    """By feature: auc, medians of both classes, direction, Mann-Whitney p and q."""
    a = auc_mann_whitney(df, test, value, positive)
    med = df.groupBy(test).agg(F.median(F.when(F.col(positive), F.col(value))).alias("median1"), F.median(F.when(~F.col(positive), F.col(value))).alias("median0"))
    way = F.when(F.col("median1") > F.col("median0"), ">").when(F.col("median1") < F.col("median0"), "<").otherwise("=")
    return bh_fdr(a.join(med, test).withColumn("direction", way), "p")


def selection(df: DataFrame, items: dict[str, Column], chosen: str) -> DataFrame:
    """By yes/no item: k and n with an answer among the chosen and the rest, and Fisher's exact p."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("item"), c.alias("v")) for name, c in items.items()]))
    d = df.select(chosen, each.alias("x")).select(chosen, "x.item", "x.v").where("v is not null")
    n = lambda g, v: F.count_if((F.col(chosen) == g) & (F.col("v") == v))
    t = d.groupBy("item").agg(n(True, True).alias("k1"), n(True, False).alias("m1"), n(False, True).alias("k0"), n(False, False).alias("m0"))
    return t.select("item", "k1", (F.col("k1") + F.col("m1")).alias("n1"), "k0", (F.col("k0") + F.col("m0")).alias("n0"), fisher_p("k1", "m1", "k0", "m0").alias("p"))


def paired_contrast(df: DataFrame, test: str, entity: str, window: str, value: str, near: str = "peri", base: str = "base") -> DataFrame:
    """By test: shares of each entity's two windows compared; an entity without a valid value in a window is left out for that test."""
    side = lambda w, f: f(F.when(F.col(window) == w, F.col(value)))
    e = df.groupBy(test, entity).agg(side(near, F.avg).alias("p1"), side(base, F.avg).alias("p0"), side(near, F.sum).alias("k1"), side(base, F.sum).alias("k0"), side(near, F.count).alias("n1"), side(base, F.count).alias("n0")).where("p1 is not null and p0 is not null")
    e = e.withColumn("d", F.round(F.col("p1") - F.col("p0"), 9))
    s = paired(e, test, "p1", "p0").join(e.groupBy(test).agg(*[F.sum(c).alias(c) for c in ("k1", "n1", "k0", "n0")]), test)
    return bh_fdr(s.join(wilcoxon(e, test, "d").select(test, F.col("p").alias("wilcoxon_p")), test, "left"), "wilcoxon_p")


def kappa(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Two raters' 0/1 labels: n, prevalences, both, agreement, Cohen's kappa (null if chance is 1), PABAK."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("prev_a"), F.sum(b).alias("prev_b"), F.sum(F.col(a) * F.col(b)).alias("both"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"))
    pa, pb = F.col("prev_a") / F.col("n"), F.col("prev_b") / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return s.withColumn("kappa", (F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0))).withColumn("pabak", 2 * F.col("po") - 1)


def smd(df: DataFrame, test: str, value: str, case: str) -> DataFrame:
    """Standardised mean difference by population variances: 0 if both are 0, null if a side is empty."""
    pick = lambda f, on: f(F.when(F.col(case) == F.lit(on), F.col(value)))
    s = df.groupBy(test).agg(*[pick(f, on).alias(f"{n}{int(on)}") for on in (True, False) for n, f in (("m", F.avg), ("v", F.var_pop), ("md", F.median))])
    den = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return s.withColumn("smd", F.when(den == 0, F.lit(0.0)).otherwise((F.col("m1") - F.col("m0")) / den))


def delong(df: DataFrame, test: str, value: str, positive: str, z: float = 1.959963984540054) -> DataFrame:
    """By test: auc and its normal interval from placement values, clipped to 0 and 1.

    A row's placement is its rank among all less its rank within its class, so ranks of distinct values
    take the place of all pairs of classes.
    """
    r = midranks(df, test, value, positive)
    upto = Window.partitionBy(test).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(test)
    p, q = F.col(positive), F.col("n") - F.col(positive)
    r = r.withColumn("__q", q)
    r = r.withColumn("__below1", F.coalesce(F.sum(p).over(upto), F.lit(0))).withColumn("__below0", F.coalesce(F.sum("__q").over(upto), F.lit(0)))
    r = r.withColumn("__n1", F.sum(p).over(whole)).withColumn("__n0", F.sum("__q").over(whole))
    r = r.withColumn("__v1", (F.col("__below0") + F.col("__q") / 2) / F.nullif("__n0", F.lit(0)))
    r = r.withColumn("__v0", 1 - (F.col("__below1") + p / 2) / F.nullif("__n1", F.lit(0)))
    r = r.withColumn("__auc", F.sum(p * F.col("__v1")).over(whole) / F.nullif("__n1", F.lit(0)))
    spread = lambda n, v: F.sum(n * F.pow(F.col(v) - F.col("__auc"), F.lit(2))) / F.nullif(F.sum(n) - 1, F.lit(0)) / F.nullif(F.sum(n), F.lit(0))
    a = r.groupBy(test).agg(F.max("__auc").alias("auc"), F.sqrt(spread(p, "__v1") + spread(F.col("__q"), "__v0")).alias("se"))
    return a.select(test, "auc", "se", F.greatest(F.lit(0.0), F.col("auc") - z * F.col("se")).alias("lo"), F.least(F.lit(1.0), F.col("auc") + z * F.col("se")).alias("hi"))


def paired(df: DataFrame, test: str, near: str, base: str) -> DataFrame:
    """By test over entities with both values: n, up, down, tie, median difference, exact sign p."""
    d = df.where(F.col(near).isNotNull() & F.col(base).isNotNull()).select(test, F.round(F.col(near) - F.col(base), 9).alias("d"))
    s = d.groupBy(test).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("tie"), F.median("d").alias("diff"))
    return s.withColumn("sign_p", sign_p("up", "down"))


def kappa_grade(k) -> Column:
    """The customary name of a kappa."""
    out = F.lit("almost perfect")
    for bound, name in ((0.8, "substantial"), (0.6, "moderate"), (0.4, "fair"), (0.2, "slight")):
        out = F.when(col(k) < bound, name).otherwise(out)
    return F.when(col(k).isNull(), "undefined").when(F.round(col(k), 9) < 0, "poor").otherwise(out)


def kappa_grade_of_five(k) -> Column:
    """The five grades from below 0.20 up, and n/a where chance agreement is certain."""
    out = F.lit("almost perfect")
    for bound, name in ((0.8, "substantial"), (0.6, "moderate"), (0.4, "weak"), (0.2, "poor")):
        out = F.when(col(k) < bound, name).otherwise(out)
    return F.when(col(k).isNull(), "n/a").otherwise(out)


def _replicated(df: DataFrame, replicates: int, fn, schema: str, tasks: int = 64) -> DataFrame:
    """fn(the study's frame, its replicates' numbers) in tasks that have a share of the replicates and the whole study each."""
    each = df.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "__task")
    return each.groupBy("__task").applyInPandas(lambda g: fn(g, range(int(g["__task"].iloc[0]), replicates, tasks)), schema)


def _interval(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"), F.count(value).alias("replicates"))


def auc_boot(df: DataFrame, value: str, positive: str, replicates: int = 2000, seed: str = "a") -> DataFrame:
    """(lo, hi, replicates): percentile interval of the area under the curve over rows redrawn class by class.

    Values are numbered in order within their class, nulls last; a drawn null does not count. Draws are counted by
    value where they are made, so rows never travel with replicates: a task holds the values of one study.
    """

    def areas(g: pd.DataFrame, bs: range) -> pd.DataFrame:
        known = np.unique(g["value"][~(g["none"] | g["value"].isna())].to_numpy())
        codes = {}
        for c in (True, False):
            v = g[g["pos"] == c]
            codes[c] = len(v), np.sort(known.searchsorted(v["value"][~v["none"]].to_numpy()))  # a NaN is above all
        out = []
        for b in bs:
            k = {}
            for c, (n, of) in codes.items():
                k[c] = np.zeros(len(known) + 1, np.int64)
                for at in drawn(f"{seed}:{b}:{str(c).lower()}:", n):
                    k[c] += np.bincount(of[at[at < len(of)]], minlength=len(known) + 1)
            n1, n0 = int(k[True].sum()), int(k[False].sum())
            u = float((k[True] * (k[False].cumsum() - k[False] / 2)).sum())
            out.append((b, u / (n1 * n0) if n1 * n0 else None))
        return pd.DataFrame(out, columns=["b", "auc"])

    v = F.col(value).cast("double")
    rows = df.where(F.col(positive).isNotNull()).select(F.col(positive).alias("pos"), v.alias("value"), v.isNull().alias("none"))
    return _interval(_replicated(rows, replicates, areas, "b int, auc double"), "auc")


def ratio_boot(df: DataFrame, ratio: str, replicates: int = 2000, seed: str = "r") -> DataFrame:
    """(lo, hi, replicates): percentile interval of the geometric mean of a ratio over redrawn rows, nulls last in order and not counted."""

    def means(g: pd.DataFrame, bs: range) -> pd.DataFrame:
        v, out = np.sort(g["value"][~g["none"]].to_numpy()), []
        for b in bs:
            total, k = 0.0, 0
            for at in drawn(f"{seed}:{b}:", len(g)):
                at = at[at < len(v)]
                total, k = total + v[at].sum(), k + len(at)
            out.append((b, np.exp(total / k) if k else None))
        return pd.DataFrame(out, columns=["b", "g"])

    v = F.ln(F.col(ratio))
    return _interval(_replicated(df.select(v.alias("value"), v.isNull().alias("none")), replicates, means, "b int, g double"), "g")


def kappa_boot(df: DataFrame, a: str, b: str, replicates: int = 2000, seed: str = "k") -> DataFrame:
    """(lo, hi, replicates): percentile interval of kappa over resampled rows.

    Kappa depends on four cell counts alone, so draws fall into the cells by their cumulative counts: rows
    are never joined with replicates, and a replicate's draws are counted where they are made.
    """
    names = [f"c{x}{y}" for x in (0, 1) for y in (0, 1)]
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"c{x}{y}") for x in (0, 1) for y in (0, 1)])

    def count(it):
        for g in it:
            out = []
            for r, *k in g[["b", *names]].itertuples(index=False):
                upto, below = np.cumsum(k), np.zeros(4, np.int64)
                for at in drawn(f"{seed}:{r}:", int(upto[-1])):
                    below += [np.count_nonzero(at < x) for x in upto]
                out.append((r, *np.diff(below, prepend=0)))
            yield pd.DataFrame(out, columns=["b", *names])

    each = df.sparkSession.range(0, replicates, 1, min(replicates, 96)).select(F.col("id").alias("b")).crossJoin(F.broadcast(cells))  # one row
    k = each.mapInPandas(count, "b bigint, c00 bigint, c01 bigint, c10 bigint, c11 bigint")
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    po, pa, pb = (F.col("c00") + F.col("c11")) / F.nullif(n, F.lit(0)), (F.col("c10") + F.col("c11")) / F.nullif(n, F.lit(0)), (F.col("c01") + F.col("c11")) / F.nullif(n, F.lit(0))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return _interval(k.select(((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa")), "kappa")
