"""Tables of a study: overlapping cohorts, descriptions, envelopes, coverage, samples, contrasts of versions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .statistics import order_statistics


def cohorts(df: DataFrame, of: dict[str, Column], name: str = "cohort") -> DataFrame:
    """df once for each cohort that a row belongs to: cohorts may overlap."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in of.items()]))))


def table1(df: DataFrame, items: dict[str, Column], names: list[str], cohort: str = "cohort") -> DataFrame:
    """By variable and cohort: k that hold it and n that have it recorded, a column each."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), c.alias("v")) for n, c in items.items()]))
    d = df.select(cohort, each.alias("x")).select(cohort, "x.variable", "x.v")
    of = lambda c: F.col(cohort) == c
    return d.groupBy("variable").agg(*[x for c in names for x in (F.count_if(of(c) & F.col("v")).alias(f"{c}_k"), F.count(F.when(of(c), F.col("v"))).alias(f"{c}_n"))])


def describe(posts: DataFrame, group: str, account: str, words: str, video: Column, ts: str, until: str, recent: int) -> DataFrame:
    """The description of each group's posts: by account first, then by group."""
    pct = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 6)
    a = posts.groupBy(group, account).agg(F.count("*").alias("k"), F.sum(words).alias("w"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("k"), account))
    top = a.withColumn("__place", best).where("__place <= 4").groupBy(group).agg(F.sum("k").alias("__top"))
    by = a.groupBy(group).agg(F.count("*").alias("accounts"), F.median("k").alias("per_account"), F.min("k").alias("least"), F.max("k").alias("most"), F.count_if(F.col("w") == 0).alias("wordless"))
    n = F.col("n")
    by = by.join(order_statistics(a, [group], "k", {"q1": F.floor(0.25 * (n - 1)), "q3": F.floor(0.75 * (n - 1))}), group).join(top, group)
    age = F.datediff(F.lit(until).cast("date"), F.to_date(ts))
    p = posts.groupBy(group).agg(
        F.count("*").alias("posts"), F.sum(words).alias("words"), F.median(words).alias("words_median"), pct(F.col(words) > 0).alias("with_text_pct"), pct(F.col(words) > 10).alias("over_10_pct"),
        pct(video).alias("video_pct"), F.to_date(F.min(ts)).cast("string").alias("first_post"), F.to_date(F.max(ts)).cast("string").alias("last_post"), pct(age <= recent).alias("last_week_pct"),
    )
    return p.join(by, group).withColumn("top4_pct", F.round(100 * F.col("__top") / F.col("posts"), 6)).drop("__top")


def envelope(df: DataFrame, value: str) -> DataFrame:
    """Range and quartiles of a value, and the limits of admission: half the least, and 1.5 times the ninetieth percentile."""
    q = lambda p: F.percentile(value, F.lit(p))
    lo = F.greatest(F.lit(0), F.floor(F.min(value) * 0.5)).cast("long")
    return df.agg(F.min(value).alias("least"), F.max(value).alias("most"), q(0.25).alias("p25"), F.median(value).alias("mid"), q(0.75).alias("p75"), lo.alias("admit_lo"), F.floor(q(0.9) * 1.5).alias("admit_hi"))


def distinct_handles(tables: list[DataFrame]) -> DataFrame:
    """The handles of several one-column tables, lower-cased, each once."""
    return reduce(DataFrame.unionByName, tables).where("h is not null").select(F.lower("h").alias("handle")).distinct()


def _covered(declared: str, taken: str) -> Column:
    return 100 * F.col(taken) / F.nullif(F.col(declared), F.lit(0))


def short_of(df: DataFrame, declared: str, taken: str, least: float, floor: int = 15) -> DataFrame:
    """Accounts with at least floor declared posts whose coverage is below least percent."""
    return df.where((F.col(declared) >= floor) & (_covered(declared, taken) < least))


def coverage(df: DataFrame, declared: str, taken: str, least: float, floor: int = 15) -> DataFrame:
    c = _covered(declared, taken)
    return df.agg(F.count("*").alias("accounts"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.count_if((F.col(declared) >= floor) & (c < least)).alias("below"))


def round_robin(df: DataFrame, seed: str, key: str, n: int, salt: str) -> DataFrame:
    """A sample of n rows, dealt in turn from each seed's rows in a hashed order, with the turn k."""
    order = F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    k = F.row_number().over(Window.partitionBy(seed).orderBy(order, key))
    return df.withColumn("k", k).where(F.col("k") <= n).orderBy("k", seed).limit(n)


def runs(df: DataFrame, by: str, order: list[str], bad: Column) -> DataFrame:
    """df with run: how many bad rows in a row stand up to here, 0 at a good one."""
    w = Window.partitionBy(by).orderBy(*order)
    d = df.withColumn("__bad", bad).withColumn("__island", F.sum((~F.col("__bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    nth = F.row_number().over(Window.partitionBy(by, "__island", "__bad").orderBy(*order))
    return d.withColumn("run", F.when(F.col("__bad"), nth).otherwise(0)).drop("__bad", "__island")


def nearest(df: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group in an order of several keys, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def _near(scores: np.ndarray, at: np.ndarray, n: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in scores, place in at) for the n scores nearest to each of at, with all within slack of the last; scores are sorted."""
    here, k = scores.searchsorted(at), min(n, len(scores))
    lo, hi = np.maximum(here - k, 0), np.minimum(here + k, len(scores))
    each = np.minimum(lo[:, None] + np.arange(2 * k)[None], len(scores) - 1)
    apart = np.where(lo[:, None] + np.arange(2 * k)[None] < hi[:, None], np.abs(scores[each] - at[:, None]), np.inf)
    last = np.partition(apart, k - 1, axis=1)[:, k - 1] + slack
    a, b = scores.searchsorted(at - last), scores.searchsorted(at + last, side="right")
    row = np.repeat(np.arange(len(at)), b - a)
    return np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row], row


def nearest_candidates(left: DataFrame, right: DataFrame, block: str, level: str, score: str, key: str, n: int, slack: float) -> DataFrame:
    """Pairs of equal block, among them each left row's first n by (distance of level, distance of score, key of right).

    Both sides have block, level (a whole number) and score; pairs have left's columns with l_ and right's with r_ before.
    slack is by how much rounding may bring distances of scores together. Of right's rows with equal level and score, the
    n smallest keys can be among the first n, so no more are read; rows without a score come last. What is returned is a
    few rows a left row, for an exact order after it: all pairs are never made. A block is one group of its rows.
    """
    first = F.row_number().over(Window.partitionBy(block, level, score).orderBy(key))
    right = right.where(F.col(block).isNotNull() & F.col(level).isNotNull()).withColumn("__n", first).where(F.col("__n") <= n).drop("__n")
    left = left.where(F.col(block).isNotNull() & F.col(level).isNotNull())
    left, right = (d.withColumn("__nan", F.coalesce(F.isnan(score), F.lit(False))) for d in (left, right))  # pandas has one name for NaN and null
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    kinds = ", ".join(f"{p}{f.name} {f.dataType.simpleString()}" for p, df in (("l_", left), ("r_", right)) for f in df.schema)

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.reset_index(drop=True), b.sort_values([f"r_{score}", f"r_{key}"]).reset_index(drop=True)
        levels, out = b[f"r_{level}"].to_numpy(), []
        for of, mine in a.groupby(f"l_{level}"):
            left_over, far = mine.index.to_numpy(), np.abs(levels - of)
            held = 0
            for d in np.unique(far):
                if held >= n:
                    break
                some = np.flatnonzero(far == d)
                held += len(some)
                s, at = b[f"r_{score}"].to_numpy(float)[some], a[f"l_{score}"].to_numpy(float)[left_over]
                low = some[np.argsort(b[f"r_{key}"].to_numpy()[some], kind="stable")]
                known = np.isfinite(s)
                if known.any() and (good := np.isfinite(at)).any():
                    x, y = _near(s[known], at[good], n, slack)
                    out.append((left_over[good][y], some[known][x]))
                fine = np.isfinite(b[f"r_{score}"].to_numpy(float)[low])
                bare = low[~fine]  # at most n of each of null, NaN and the infinities
                for rows, pool in ((left_over[~np.isfinite(at)], np.concatenate([low[fine][:n], bare])), (left_over[np.isfinite(at)], bare)):
                    out.append((np.repeat(rows, len(pool)), np.tile(pool, len(rows))))
        x, y = (np.concatenate(z) if out else np.zeros(0, int) for z in (zip(*out) if out else ((), ())))
        return pd.concat([a.iloc[x].reset_index(drop=True), b.iloc[y].reset_index(drop=True)], axis=1)

    out = named(left, "l_").groupBy(f"l_{block}").cogroup(named(right, "r_").groupBy(f"r_{block}")).applyInPandas(pick, kinds)
    return out.withColumns({f"{p}{score}": F.when(F.col(f"{p}__nan"), F.lit(float("nan"))).otherwise(F.col(f"{p}{score}")) for p in ("l_", "r_")}).drop("l___nan", "r___nan")


def upsert(stages: list[DataFrame], keys: list[str], stage: str) -> DataFrame:
    """One row a key, from the latest stage that has it."""
    u = reduce(DataFrame.unionByName, stages)
    rest = [c for c in u.columns if c not in keys]
    best = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), stage).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def split_rows(df: DataFrame, text: str, chrome: str, tail: str, stop: list[str]) -> DataFrame:
    """Kept and discarded rows with an audit: how many, how many had a tail cut, characters left, handles seen.

    Handles are counted apart, so no side's texts are gathered in one row but its distinct handles.
    """
    d = df.select(F.coalesce(F.col(text).rlike(chrome), F.lit(False)).alias("chrome"), F.col(text).alias("__t"))
    cut = F.regexp_replace("__t", tail, "")
    a = d.groupBy("chrome").agg(F.count("*").alias("n"), F.count_if(cut != F.col("__t")).alias("trimmed"), F.coalesce(F.sum(F.length(cut)), F.lit(0)).alias("chars"))
    h = d.select("chrome", F.explode(X.handles_in("__t", stop)).alias("h")).groupBy("chrome").agg(F.array_join(F.array_sort(F.collect_set("h")), " ").alias("handles"))
    return a.join(h, "chrome", "left").withColumn("handles", F.coalesce("handles", F.lit("")))


def counter(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, counts): a map of each non-null value to its number of rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, "__n"))).alias("counts"))


def merged_struct(a: Column, a_fields: list[str], b: Column, b_fields: list[str]) -> Column:
    """The fields of both structs; where both have one, the later value unless it is null."""
    shared = [F.coalesce(b[c], a[c]).alias(c) if c in b_fields else a[c].alias(c) for c in a_fields]
    return F.struct(*shared, *[b[c].alias(c) for c in b_fields if c not in a_fields])


def versions(df: DataFrame, a: str, b: str, pre: Column, entity: str = "user_id", window: str = "win") -> DataFrame:
    """(entity, window, version, v): two raters' labels, what they agree on, either's, and either's before the anchor."""
    x, y = F.col(a), F.col(b)
    entry = lambda n, v: F.struct(F.lit(n).alias("version"), v.alias("v"))
    each = F.array_compact(F.array(entry("a", x), entry("b", y), entry("consensus", F.when(x == y, x)), entry("union", F.greatest(x, y)), F.when(pre, entry("pre", F.greatest(x, y)))))
    return df.select(entity, window, F.explode(each).alias("x")).select(entity, window, "x.version", "x.v")
