"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions alone.

Targets. Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a target
stops at max_repeat times its source's size and the excess goes to the others by weight (water-filling,
closed by one ordered scan over the sources).

Schedule. Slot i of the mix has the golden-ratio point frac((i + 1/2) * phi) in 64-bit fixed point; mapped
through the cumulative targets it names a source. Slots are ranked within their source. The source's
documents, in the order of a hash, are one shuffled stream of words cut into equal-token blocks; rank r is
joined to block r modulo the number of blocks, so ranks walk round the stream and each word taken has the
slot in which it is taken. A source's last rank is cut to the words its target still lacks; ranks that the
schedule leaves short follow after its last slot, as slots SLOTS, SLOTS + 1 and so on, and ranks beyond the
need are empty. So the quota says how much is taken and the schedule where in the mix it stands: first_slot
and last_slot of a document, and the order in which the pipeline's stage writes its rows.

Scale. Both rankings are two-level: a count by (source, chunk), a running sum over those counts, and a
rank within the chunk, so a source with a third of all rows is ranked by many tasks; chunks are CHUNK_ROWS
rows or so, and MOST_CHUNKS at most. Each source has at most SLOTS slots and blocks of as many words as that
takes: the number of (source, block) rows is bounded by the number of sources, and a document meets only the
blocks that it overlaps. What has one row a source is one task's work.

Defined results: a null or empty text has size 0 and is not taken; a source without words has target 0;
no documents give no rows; rows that repeat are rows of their own; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, packed, stored, tie_order, unpacked

#: Slots of the whole mix, at least one for each source's share.
SLOTS = 1 << 16
#: Rows that one ranking task sorts, about.
CHUNK_ROWS = 1 << 12
#: Chunks of the whole table at most: their counts are summed source by source.
MOST_CHUNKS = 1 << 16
#: Words that a task of the written mix has, about.
PART_WORDS = 1 << 21
MAX_REPEAT = 3
#: The golden ratio's fraction in 62-bit fixed point.
PHI62 = (math.isqrt(5 << 124) - (1 << 62)) >> 1
WORD = r"[^\x20\x09-\x0D]+"


def sized(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, tp, uid, source, size): tp is the text's fingerprint, size is the number of words of the whole text."""
    return df.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("tp"), F.monotonically_increasing_id().alias("uid"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): sizes has a row for each document; what follows has one for each source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    s = s.withColumn("weight", (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("total", F.sum("source_size").over(one)).withColumn("cap", max_repeat * F.col("source_size"))
    # by the level at which a source is full: those that are full below the level of the rest
    fill = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("full", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))).withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.coalesce("full", F.lit(0))) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(one))
    return s.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def schedule(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(sid, rank, slot) of each slot of the mix: the source that its point falls to, its rank there.

    goal: sid, lo, hi: the source's part of the 62-bit circle.
    """
    spark, circle = goal.sparkSession, 1 << 62
    i = F.col("id").cast("decimal(38,0)")
    point = ((i * 2 + 1) * F.lit(PHI62 // 2).cast("decimal(38,0)") % F.lit(circle).cast("decimal(38,0)")).cast("long")
    # a source's part covers whole cells or ends in one: points meet the sources of their cell only
    cells = 1024
    cell = lambda c: F.shiftright(c, 52)
    parts = goal.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    assert cells << 52 == circle
    hit = points.join(parts, "cell").where("point >= lo and point < hi").select("sid", "slot")
    return ranked(hit, F.shiftright("slot", 12), ["slot"], None).select("sid", F.col("place").alias("rank"), "slot")


def ranked(rows: DataFrame, chunk, order: list, size: str | None) -> DataFrame:
    """rows with place: the number (or the sum of size) of the rows of its sid that stand before.

    chunk rises with the order, so the sums over chunks are few and each chunk is a task's work.
    """
    of = F.sum(size) if size else F.count(F.lit(1))
    r = rows.withColumn("chunk", chunk)
    upto = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy("sid", "chunk").agg(of.cast("long").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0))).drop("held")
    inner = Window.partitionBy("sid", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce((F.sum(size) if size else F.count(F.lit(1))).over(inner), F.lit(0))
    return r.withColumn("here", here).join(before, ["sid", "chunk"]).withColumn("place", F.col("before") + F.col("here")).drop("chunk", "here", "before")


def plan(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(sid, block, from, until, slot): words [from, until) of the source's stream are taken in this slot."""
    rank = schedule(goal, slots)
    quota = goal.where("quota > 0").select("sid", "source_size", "quota", "block_words", F.ceil(F.col("source_size") / F.col("block_words")).alias("blocks"))
    # words before rank r: whole rounds of the stream and the blocks of the last one
    start = lambda r: F.floor(r / F.col("blocks")) * F.col("source_size") + F.least((r % F.col("blocks")) * F.col("block_words"), F.col("source_size"))
    last = quota.select("*", (F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("quota") % F.col("source_size")) / F.col("block_words"))).alias("needed"))
    given = rank.groupBy("sid").agg(F.count("*").alias("given"))
    lack = last.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long"))).where("given < needed")
    short = lack.select("sid", "given", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)).alias("rank")).select("sid", "rank", (F.col("rank") - F.col("given") + slots).alias("slot"))
    taken = rank.select("sid", "rank", "slot").unionByName(short).join(last, "sid").where(F.col("rank") < F.col("needed"))
    words = F.least(start(F.col("rank") + 1), F.col("quota")) - start(F.col("rank"))
    block = F.col("rank") % F.col("blocks")
    return taken.select("sid", block.alias("block"), (block * F.col("block_words")).alias("from"), (block * F.col("block_words") + words).alias("until"), "slot")


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", slots: int = SLOTS, max_repeat: int = MAX_REPEAT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, tp, uid, source, size, source_size, target, taken, first_slot, last_slot, place, starts) of each row of df.

    place is the document's first word in its source's stream; starts are the slots that take that word, in order.
    """
    docs = stored(sized(df, text, key, source), "mix-sizes")
    goal = targets(docs, max_repeat)
    goal = goal.withColumn("sid", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    one = Window.partitionBy(F.lit(0))
    share = F.sum("target").over(one.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.nullif(F.sum("target").over(one), F.lit(0.0))
    goal = goal.withColumn("hi", (F.least(share, F.lit(1.0)) * (1 << 62)).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(one.orderBy("sid")), F.lit(0)))
    goal = goal.withColumn("quota", F.least(F.floor("target"), max_repeat * F.col("source_size")))
    goal = goal.withColumn("block_words", F.greatest(F.ceil(F.sum("target").over(one) / slots), F.lit(1)).cast("long"))
    goal = stored(goal, "mix-goal")
    chunks = min(max(1, docs.count() // chunk_rows), MOST_CHUNKS)
    # chunks by range of the hash that orders the documents
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    placed = docs.where("size > 0").join(goal.select("source", "sid", "block_words", "quota"), docs["source"].eqNullSafe(goal["source"])).drop(goal["source"]).withColumn("order", order)
    chunk = F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * chunks / (1 << 28))
    placed = ranked(placed.select("doc_id", "uid", "sid", "size", "block_words", "order"), chunk, ["order", "uid"], "size")
    first = F.floor(F.col("place") / F.col("block_words"))
    spans = placed.select("uid", "sid", "size", "place", first.alias("first"), F.explode(F.sequence(first, F.floor((F.col("place") + F.col("size") - 1) / F.col("block_words")))).alias("block"))
    met = spans.join(plan(goal, slots), ["sid", "block"]).withColumn("words", F.least(F.col("place") + F.col("size"), F.col("until")) - F.greatest("place", "from")).where("words > 0")
    begins = F.when((F.col("block") == F.col("first")) & (F.col("until") > F.col("place")), F.col("slot"))
    # the stream is walked max_repeat times at most, so a list has no more slots than that
    taken = met.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.min("place").alias("place"), F.array_sort(F.collect_list(begins)).alias("starts"))
    out = docs.join(goal.select("source", "source_size", "target"), docs["source"].eqNullSafe(goal["source"])).drop(goal["source"]).join(taken, "uid", "left")
    return out.select("doc_id", "tp", "uid", "source", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", "place", "starts")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("tp", "uid", "source", "place", "starts")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, written in the order of the schedule's slots.

    A source's stream ends within one document at most, which stays if half of its words are taken. Of rows
    that agree in doc_id, source and text the first by all its columns stands for all.
    """
    planned = stored(mix(docs), "mix-plan")
    often = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.greatest("size", F.lit(1))).cast("int")
    copies = planned.withColumn("often", often).where("often > 0").select("doc_id", "source", "tp", "place", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("often") - 1), lambda i: F.coalesce(F.get("starts", i), F.col("last_slot")))).alias("nth", "slot"))
    named = copies.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("tp").alias("t"), "place", "slot")
    row = F.col("row")
    rows = packed(docs).withColumn("fp", F.xxhash64(row["text"]))
    of = [row["doc_id"].alias("d"), row["source"].alias("s"), F.col("fp").alias("t")]
    again = stored(planned.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("tp").alias("t")).agg(F.count("*").alias("k")).where("k > 1"), "mix-again")
    if not again.isEmpty():
        same = row["doc_id"].eqNullSafe(again["d"]) & row["source"].eqNullSafe(again["s"]) & (F.col("fp") == again["t"])
        rank = F.row_number().over(Window.partitionBy(row["doc_id"], row["source"], "fp").orderBy(*tie_order()))
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").withColumn("rank", rank).where("rank = 1").drop("rank"))
    on = row["doc_id"].eqNullSafe(named["d"]) & row["source"].eqNullSafe(named["s"]) & (F.col("fp") == named["t"])
    out = rows.join(named, on).select("row", "slot", "place")
    total = planned.agg(F.sum("taken")).first()[0] or 0
    parts = min(max(1, -(-total // PART_WORDS)), SLOTS)
    part = F.least(F.floor(F.col("slot") * parts / SLOTS), F.lit(parts - 1)).cast("int")
    out = out.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("slot", "place")
    return unpacked(out, docs)


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {
    "op8_mixing": rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size) as source_size, 3 * sum(size) as cap from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, sum(source_size) over () as total from s),
f as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
g as (select source, source_size, cap, weight, max(case when level * weight <= cap then level end) over () as level from f),
t as (select source, source_size, least(coalesce(level * weight, cap::double), cap::double) as target from g),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as quota,
  coalesce(sum(size) over (partition by d.source order by md5(doc_id::varchar || ':' || size::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) as place
  from d join t on d.source is not distinct from t.source),
h as (select source, source_size::bigint as source_size, floor(target)::bigint as quota, row_number() over (order by source nulls last) as sid,
  trunc(least(1.0, sum(target) over (order by source nulls last) / nullif(sum(target) over (), 0)) * {float(1 << 62)!r}::double)::bigint as hi,
  greatest(1, ceil(sum(target) over () / {SLOTS}))::bigint as bw from t),
b as (select *, coalesce(lag(hi) over (order by sid), 0) as lo, (source_size + bw - 1) // bw as blocks from h),
q as (select *, quota // source_size * blocks + (quota % source_size + bw - 1) // bw as needed from b where quota > 0),
i as (select i as slot, ((2 * i + 1)::hugeint * {PHI62 // 2}::hugeint % {1 << 62}::hugeint)::bigint as point from range({SLOTS}) x(i)),
k as (select sid, slot, row_number() over (partition by sid order by slot) - 1 as r from i join b on point >= lo and point < hi),
n as (select sid, count(*) as given from k group by sid),
e as (select sid, slot, r from k union all select sid, {SLOTS} + r - coalesce(given, 0), r from (select q.sid, given, unnest(range(coalesce(given, 0), needed)) as r from q left join n using (sid))),
v as (select source, slot, r % blocks * bw as a, r % blocks * bw + least((r + 1) // blocks * source_size + least((r + 1) % blocks * bw, source_size), quota)
  - (r // blocks * source_size + least(r % blocks * bw, source_size)) as z from e join q using (sid) where r < needed),
m as (select p.doc_id, p.source, place, min(slot) as first_slot, max(slot) as last_slot from p join v on p.source is not distinct from v.source and a < place + size and z > place where size > 0 group by all)
select p.doc_id, size::bigint as size, source_size::bigint as source_size, target,
  case when size = 0 then 0 else (quota // source_size::bigint) * size + greatest(0, least(p.place + size, quota % source_size::bigint) - p.place) end::bigint as taken,
  first_slot::bigint as first_slot, last_slot::bigint as last_slot
from p left join m on size > 0 and p.doc_id is not distinct from m.doc_id and p.source is not distinct from m.source and p.place = m.place"""
}
