"""Case-control matching: strata from the cases' cut points, greedy pairs without replacement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strata(df: DataFrame, value: str, case: str, shares: list[float]) -> DataFrame:
    """df with stratum: the number of the cases' cut points that lie below the value."""
    cuts = df.where(F.col(case)).agg(F.array(*[F.percentile_disc(value, s) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({s}) within group (order by {value})") for s in shares]).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda c: F.col(value) > c))
    return df.crossJoin(F.broadcast(cuts)).withColumn("stratum", below).drop("__cuts")  # one row


def matched(df: DataFrame, block: list[str], key: str, case: str, score: str, ratio: int) -> DataFrame:
    """(block, case_key, control_key, distance): for each case up to ratio controls of its block, each used once.

    Scarce rows go first: in a block both sides are taken in order of score, and each case takes the free
    controls nearest to it. A block is one group, sorted by score and walked with two pointers, so its work
    is linear; blocks must be fine enough for a group to fit a task.
    """
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in block)
    kind = df.schema[key].dataType.simpleString()

    def pair(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, key])
        cases, pool = g[g[case]], g[~g[case]]
        values, keys = pool[score].to_numpy(), pool[key].to_numpy()
        left, right = list(range(-1, len(keys) - 1)), list(range(1, len(keys) + 1))
        used, out = [False] * len(keys), []

        def free(i: int, to: list[int], end: int) -> int:
            path = []
            while i != end and used[i]:
                path.append(i)
                i = to[i]
            for p in path:  # the way is shortened for who comes next
                to[p] = i
            return i

        at = values.searchsorted(cases[score].to_numpy())
        for (_, c), here in zip(cases.iterrows(), at, strict=True):
            for _ in range(ratio):
                lo = free(here - 1, left, -1) if here > 0 else -1
                hi = free(here, right, len(keys)) if here < len(keys) else len(keys)
                if lo < 0 and hi == len(keys):
                    break
                take = lo if hi == len(keys) or (lo >= 0 and c[score] - values[lo] <= values[hi] - c[score]) else hi
                used[take] = True
                out.append((*[c[b] for b in block], c[key], keys[take], abs(float(values[take] - c[score]))))
        return pd.DataFrame(out, columns=[*block, "case_key", "control_key", "distance"])

    return df.select(*block, key, case, score).groupBy(*block).applyInPandas(pair, f"{fields}, case_key {kind}, control_key {kind}, distance double")
