"""Work that goes on where it stopped: what is left to do, appended state, retries, growth to a fixed point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of todo whose key has no result yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


def retry(done: DataFrame, failed) -> DataFrame:
    """done without the rows that failed, so that resume takes them again."""
    return done.where(~F.coalesce(failed, F.lit(False)))


def append(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Runs work over each batch of new rows and writes one folder a batch, which a repeated batch overwrites.

    A batch that is tried again after a failure has the same number, so its rows are written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        work(batch.dropDuplicates(keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(stream: DataFrame, entity: str, at: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events by entity and window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), entity).agg(F.count("*").alias("n")).select(entity, F.col("w.start").alias("start"), "n")


def snowball(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, store: Callable[[DataFrame], DataFrame], most: int = 50) -> DataFrame:
    """seeds and all that step reaches from them, round by round, until nothing new comes up; store cuts the lineage."""
    known = frontier = store(seeds.select(key).distinct())
    for _ in range(most):
        frontier = store(step(frontier).select(key).distinct().join(known, key, "left_anti"))
        if frontier.isEmpty():
            return known
        known = store(known.unionByName(frontier))
    raise RuntimeError(f"no fixed point within {most} rounds")


def budgeted(todo: DataFrame, order: list, spent: int, daily: int, share: float) -> DataFrame:
    """What one stage may take today: its share of what is left of a common daily number, in order."""
    return todo.orderBy(*order).limit(max(0, int((daily - spent) * share)))


def fixpoint(round_: Callable[[int], DataFrame], key: str, store: Callable[[DataFrame], DataFrame], target: int, still: int = 2) -> tuple[DataFrame, int]:
    """Rounds of growth until target keys are known, or so many rounds in a row bring nothing new: (known, rounds)."""
    known, without, n = None, 0, 0
    while True:
        new = round_(n).select(key).distinct()
        fresh = store(new if known is None else new.join(known, key, "left_anti"))
        n += 1
        without = without + 1 if fresh.isEmpty() else 0
        known = fresh if known is None else known if without else store(known.unionByName(fresh))
        if without == still or known.count() >= target:
            return known, n
