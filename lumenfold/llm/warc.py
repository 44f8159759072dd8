"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is one string (header, HTTP header, payload) and the writer's line separator is the
CRLF CRLF that ends a record, so each part file is an archive, committed by Spark on any file system.
Payloads of at least min_payload bytes that are equal by digest and length become one response (the
smallest id) and revisits of it; map-side aggregation finds the smallest ids.

Reading. The text reader cuts the archives at the magic line, wherever it stands, splits included; the
pieces' order within a split and their lengths give each candidate's offset. A candidate's header
gives the offset of its successor. Pointer jumping from the start of each file, in which every
candidate's pointer doubles its reach each round, keeps the reachable records only, so a magic line
inside a payload is no record. Pieces up to the next record are joined to its payload again.

Jumping works on runs: a candidate whose successor is the next piece is in one run with it, so files
without magic in payloads end after a round, and payload text never enters the joins.

Defined results: null html is an empty payload; a null url gives a urn of the id; ids that repeat with
equal payloads are all responses if they are the smallest; no pages give no records; a record cut off
at the end of a file, or one whose header has no length, ends its chain and is not returned.

Torn payloads, those with magic inside, are read again: the number of splits is fixed for both scans, so that
lost executors do not change it, and a payload of another size than the first scan's is an error, not a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's bytes in upper-case base32: 20 bits of the hex at a time, 5 a letter."""
    return base32(F.sha1(payload))


def base32(hexed: Column) -> Column:
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, min_payload: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column `record`: each page as a WARC record, without the CRLF CRLF that ends it."""
    p = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # only payloads that repeat; a written table has a known size, by which Spark broadcasts it or shuffles
    first = p.where(F.col("size") >= min_payload).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    p = p.join(stored(first.where("n > 1").drop("n"), "warc-first"), ["digest", "size"], "left").withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(F.col("again"), 0).otherwise(F.col("size"))
    safe = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "_"), F.concat(F.lit("urn:page:"), F.col("id").cast("string")), F.lit("urn:page"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        F.when(F.col("id").isNull(), "WARC-Record-ID: <urn:page>\r\n").otherwise(line("WARC-Record-ID", urn(F.col("id")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(F.col("again"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, http, F.when(F.col("again"), "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, path: str, min_payload: int = 0, **columns) -> None:
    records(pages, min_payload, **columns).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at the magic line: file, split and row (their order), the piece after the magic."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("size", F.octet_length("value").cast("long"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each magic line of the archives: file, offset, succ (null if none follows), fields, digest."""
    magic, gap = len(MAGIC), F.instr("value", END)
    p = _pieces(spark, path).withColumn("head", F.when(gap > 0, F.expr("left(value, instr(value, '\r\n\r\n') - 1)")))
    body = F.expr("substring(value, instr(value, '\r\n\r\n') + 4)")
    http = F.expr("substring(body, instr(body, '\r\n\r\n') + 4)")
    p = p.withColumn("body", body).withColumn("length", _field("Content-Length").try_cast("long"))
    # the payload of a record without magic inside ends where its length says
    p = p.withColumn("payload", F.when(F.octet_length("body") == F.col("length") + 4, F.expr("left(body, char_length(body) - 4)")))
    p = p.withColumn("payload", F.when(F.col("payload").isNotNull(), F.expr("substring(payload, instr(payload, '\r\n\r\n') + 4)")))
    p = p.select(
        "file", "split", "row", "size",
        (F.octet_length("head") + len(END) + F.col("length") + len(END) + magic).alias("span"),
        _field("WARC-Type").alias("type"),
        F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"sha1:([A-Z2-7]+)", 1).alias("said"),
        F.regexp_extract("body", r"(?i)^HTTP/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*?Content-Length:[ \t]*(\d+)", 1).try_cast("long").alias("http_length"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    p = stored(p, "warc-pieces")
    order = Window.partitionBy("file").orderBy("split", "row")
    # the first piece of a file is what stands before its first magic: nothing, if the file is sound
    p = p.withColumn("n", F.row_number().over(order) - 2)
    p = p.withColumn("offset", F.sum("size").over(order) - F.col("size") + F.col("n") * magic)
    p = p.withColumn("succ", F.col("offset") + F.col("span"))
    # a run: candidates of which each ends where the next begins
    begins = F.when(F.lag("succ").over(order).eqNullSafe(F.col("offset")), 0).otherwise(1)
    return p.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).drop("begins").where("n >= 0")


def reachable(found: DataFrame) -> DataFrame:
    """(file, run, enter): the runs on the chain from offset 0 of each file, and where it enters them.

    A pointer first leaps to the end of its run; it then doubles each round, until no pointer of what is
    reached leads to anything new. A file without magic in payloads is one run.
    """
    c = found.select("file", "run", "offset", "succ")
    runs = c.groupBy("file", "run").agg(F.min("offset").alias("head"), F.max_by("succ", "offset").alias("jump"))
    at = c.select("file", F.col("offset").alias("jump"), F.col("run").alias("to"))
    edges = stored(runs.join(at, ["file", "jump"], "left").select("file", "run", "head", F.col("jump").alias("enter"), "to"), "warc-runs")
    # after k rounds: what less than 2**k leaps reach; a pointer leaps 2**k runs, and one row of each run holds it
    reached = edges.where("head = 0").select("file", "run", F.lit(0).cast("long").alias("enter"))
    jump = edges.where("to is not null").select("file", "run", "to", "enter")
    while not jump.isEmpty():
        leap = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "enter")
        leap = stored(leap, "warc-reached")
        if leap.isEmpty():
            break
        reached = reached.unionByName(leap)
        a, b = jump.alias("a"), jump.alias("b")
        far = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.run")))
        jump = stored(far.select("a.file", "a.run", F.col("b.to").alias("to"), F.col("b.enter").alias("enter")), "warc-jump")
    return reached


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Both scans of the archives are cut alike, however many executors there are at the time."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives.

    A response's size and digest come from the payload read; a revisit's from its headers.
    """
    with _same_splits(spark):
        found = stored(candidates(spark, path), "warc-candidates")
        kept = found.join(reachable(found), ["file", "run"]).where("offset >= enter")
        alone = F.col("succ") == F.col("offset") + F.col("size") + len(MAGIC)
        again = F.col("type") == "revisit"
        columns = [
            "page_id",
            F.when(again, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(again, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
            F.col("type").alias("record_type"),
            "refers_to",
        ]
        out = kept.where(alone & (again | F.col("payload_bytes").isNotNull())).select(*columns)
        torn = kept.where(~alone & (F.col("type") == "response")).select("file", "offset", "succ", "page_id")
        return out if torn.isEmpty() else out.unionByName(_rejoined(spark, path, found, torn))


def _rejoined(spark: SparkSession, path: str, found: DataFrame, torn: DataFrame) -> DataFrame:
    """The responses whose payload holds magic lines: their pieces in order, joined to one payload."""
    magic = len(MAGIC)
    rows = found.select("file", "split", "row", "size", F.col("n").alias("piece"), F.col("offset").alias("place"))
    parts = rows.join(torn, "file").where("place >= offset and place < succ")
    # pieces that end before or beyond the record's end are those of a record cut off
    sound = F.sum(F.col("size") + magic).over(Window.partitionBy("file", "offset")) == F.col("succ") - F.col("offset")
    parts = parts.withColumn("sound", sound).where("sound").select("file", "split", "row", "piece", "offset", "succ", "page_id")
    text = _pieces(spark, path).select("file", "split", "row", "value")
    # a piece that the second scan lacks is null, and its payload then too short
    both = stored(parts, "warc-torn").join(text, ["file", "split", "row"], "left").groupBy("file", "offset", "succ", "page_id")
    block = both.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    wrong = F.raise_error(F.lit("the second scan of the archives has other pieces than the first"))
    same = F.octet_length("value") + magic == F.col("succ") - F.col("offset")
    block = block.select("page_id", F.when(same, F.col("value")).otherwise(wrong.cast("string")).alias("value"))
    block = block.select("page_id", F.expr("substring(value, instr(value, '\r\n\r\n') + 4)").alias("body"))
    body = block.select("page_id", F.expr("substring(body, instr(body, '\r\n\r\n') + 4)").alias("payload"))
    body = body.select("page_id", F.expr("left(payload, char_length(payload) - 4)").alias("payload"))
    none = F.lit(None).cast("long").alias("refers_to")
    made = body.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), F.lit("response").alias("record_type"), none)
    return stored(made, "warc-rejoined")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(documents(spark, sf_dir, "pages"), path)
    return read(spark, path)


def _oracle() -> str:
    hexed = "sha1(coalesce(html, ''))"
    nibble = lambda i: f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"
    bits = lambda i: "(" + " + ".join(f"{16 ** (4 - k)} * {nibble(5 * i + 1 + k)}" for k in range(5)) + ")"
    letters = " || ".join(f"substr('{_BASE32}', ((({bits(i)}) >> {s}) & 31)::int + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, strlen(coalesce(html, '')) as size, {hexed} as h from pages),
q as (select *, min(page_id) over (partition by h, size) as first from p)
select page_id, size::bigint as payload_bytes, {letters} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from q"""


QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": _oracle()}
