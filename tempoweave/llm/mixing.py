"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: each source's share of all words by its weight, never above
   `cap` times its own words; what is cut off is shared again by weight.  The
   level at which this comes to rest is the largest of the levels that follow
   from capping the first k sources, in order of cap per weight.
2. Schedule: slot i of `slots` lies at the golden-ratio point i * phi mod 1 (in
   fixed point, 2**32 steps), and belongs to the source whose interval of
   cumulative target weight holds that point.  Slots are ranked within their
   source.  Every slot stands for a block of the same number of words, the
   slots' share of all words (a block's ends are rounded to whole words), so
   the slots that a source got decide how many words are taken of it: they
   are within a few blocks of its target, as the points' discrepancy is.
3. Streams: a source's documents, shuffled by a hash of their ids, follow each
   other as one stream of words, read up to `cap` times.  The slot of rank r
   takes the stream's r-th block.  `taken` is how many words of a document lie
   in its source's blocks, `first_slot` the slot that reads its first word
   first, which gives the order of the mix.

Only DataFrame functions are used.  A document's place in its stream is a sum
over hash buckets and then within its bucket, and a slot's rank one over cells
of slots, so neither a source with a third of all rows nor the schedule is
ordered in one task.  Only the table of sources is.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; repeated rows and rows without an id are
documents of their own (the latter are shuffled by their text); a source with
a target but no point has one slot after all others; an empty table gives no
rows; a rerun gives the same rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.llm._store import written

GOLDEN = 2654435769  #: 2**32 divided by the golden ratio, to the nearest odd number
SCALE = 1 << 32
SLOTS = 1 << 17
_CELLS = 1 << 10


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: sid (its number in order), source, source_size, weight, target, total (words of all sources)."""
    order, every = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    by = F.array(*(F.lit(w) for w in weights))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(order).cast("long"))
    sources = sources.withColumn("weight", F.get(by, ((F.col("sid") - 1) % len(weights)).cast("int")).cast("long")).withColumn("most", cap * F.col("source_size"))
    rising = W.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(rising), F.lit(0))
    level = (F.sum("source_size").over(every) - before("most")) / (F.sum("weight").over(every) - before("weight"))
    sources = sources.withColumn("level", level).withColumn("level", F.max("level").over(every)).withColumn("total", F.sum("source_size").over(every))
    return sources.select("sid", "source", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"), "total")


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per slot: slot (its place in the whole schedule), sid, rank among the source's slots."""
    whole = F.round("target").cast("long")
    running = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    share = F.coalesce(F.sum(whole).over(running), F.lit(0)).cast("double") / F.sum(whole).over(W.partitionBy()).cast("double")
    spark, none, width = sources.sparkSession, F.lit(None).cast("long"), SCALE // _CELLS
    starts = sources.filter(whole > 0).select(F.floor(share * SCALE).alias("point"), "sid", none.alias("slot"))
    # the source in force where each cell of points begins, then within the cells
    edges = spark.range(_CELLS).select((F.col("id") * width).alias("point"), none.alias("sid"), none.alias("slot"))
    along = W.orderBy("point", F.col("sid").asc_nulls_last())
    edges = starts.unionByName(edges).withColumn("first", F.col("sid").isNull()).withColumn("sid", F.last("sid", ignorenulls=True).over(along)).filter("first").drop("first")
    points = spark.range(slots).select(F.expr(f"(id * {GOLDEN}) % {SCALE}").alias("point"), none.alias("sid"), F.col("id").alias("slot"))
    cell = W.partitionBy(F.floor(F.col("point") / width)).orderBy("point", F.col("slot").asc_nulls_first(), F.col("sid").asc_nulls_first())
    dealt = starts.unionByName(edges).unionByName(points).withColumn("sid", F.last("sid", ignorenulls=True).over(cell)).filter("slot IS NOT NULL AND sid IS NOT NULL")
    # ranks: slots of earlier cells of slots, and earlier ones of the same cell
    dealt = dealt.select("sid", "slot", F.floor(F.col("slot") / _CELLS).alias("cell"))
    counts = dealt.groupBy("sid", "cell").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("sid").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("sid", "cell").orderBy("slot")) - 1
    return dealt.withColumn("inside", inside).join(counts.select("sid", "cell", before.alias("before")), ["sid", "cell"]).select("sid", "slot", (F.col("before") + F.col("inside")).cast("long").alias("rank"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **more: Column) -> DataFrame:
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc.cast("string"), F.concat(F.lit(":"), text))).cast("binary"))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(doc.alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *(c.alias(n) for n, c in more.items()))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slots: int = SLOTS, seed: str = "mix", bucket_rows: int = 5000, carry: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words that the mix takes of it, repeats counted), first_slot.

    With carry also `row`, a struct of all columns of docs.
    """
    sizes = written(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    digits = max(0, math.ceil(math.log(max(1, sizes.count()) / bucket_rows, 16)))
    sources = written(source_targets(sizes, weights=weights, cap=cap), "mix-sources")
    slot = written(schedule(sources, slots), "mix-slots")
    # words that the slots of a source stand for
    words = F.round(F.col("n").cast("double") * F.col("total").cast("double") / slots).cast("long")
    n = F.coalesce(F.col("n"), F.when(F.round("target") > 0, 1), F.lit(0)).cast("long")
    goals = sources.join(slot.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid", "left").withColumn("n", n)
    goals = written(goals.withColumn("goal", F.least(F.greatest(words, F.least(F.col("n"), F.lit(1))), cap * F.col("source_size"))), "mix-goals")

    bucket = F.substring("key", 1, digits).alias("bucket")
    placed = lambda df: df.join(goals, df["source"].eqNullSafe(goals["source"])).select("doc_id", "sid", "size", "source_size", "target", "goal", "total", "n", "key", bucket, *(["row"] if "row" in df.columns else []))
    sums = placed(sizes).groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("held").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = placed(_sized(docs, id_col, text_col, source_col, seed, row=F.struct("*")) if carry else sizes)
    inside = F.coalesce(F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(sums, ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    # the words of each pass over the stream that the source's blocks hold
    start = lambda p: F.col("at") + p * F.col("source_size")
    held = sum((F.greatest(F.lit(0), F.least(start(p) + F.col("size"), F.col("goal")) - start(p)) for p in range(1, cap)), F.greatest(F.lit(0), F.least(start(0) + F.col("size"), F.col("goal")) - start(0)))
    rank = F.when((F.col("size") > 0) & (F.col("at") < F.col("goal")), F.least(F.expr(f"(at * {slots}) div total"), F.col("n") - 1)).alias("rank")
    rows = rows.select("doc_id", "sid", "size", "source_size", "target", held.cast("long").alias("taken"), rank, *(["row"] if carry else []))
    rows = rows.join(F.broadcast(slot), ["sid", "rank"], "left")  # at most `slots` rows
    first = F.when(F.col("rank").isNotNull(), F.coalesce("slot", F.lit(slots))).alias("first_slot")
    return rows.select("doc_id", "size", "source_size", "target", "taken", first, *(["row"] if carry else []))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM n),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER r, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS DOUBLE) AS level
      FROM w WINDOW r AS (ORDER BY most / CAST(weight AS DOUBLE), sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sid, source, source_size, CAST(sum(source_size) OVER () AS BIGINT) AS total, least(CAST(most AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, floor(CAST(coalesce(sum(CAST(round(target) AS BIGINT)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(CAST(round(target) AS BIGINT)) OVER () AS DOUBLE) * {SCALE}) AS point FROM t WHERE round(target) > 0),
i AS (SELECT *, coalesce(lead(point) OVER (ORDER BY sid), {SCALE}) AS until FROM e),
p AS (SELECT range AS slot, (range * {GOLDEN}) % {SCALE} AS point FROM range({SLOTS})),
g AS (SELECT i.sid, p.slot, row_number() OVER (PARTITION BY i.sid ORDER BY p.slot) - 1 AS rank FROM p JOIN i ON p.point >= i.point AND p.point < i.until),
c AS (SELECT t.*, coalesce(k.n, CASE WHEN round(target) > 0 THEN 1 ELSE 0 END) AS n FROM t LEFT JOIN (SELECT sid, count(*) AS n FROM g GROUP BY sid) k ON t.sid = k.sid),
o AS (SELECT *, least(greatest(CAST(round(CAST(n AS DOUBLE) * CAST(total AS DOUBLE) / {SLOTS}) AS BIGINT), least(n, 1)), 3 * source_size) AS goal FROM c),
a AS (SELECT d.doc_id, d.size, o.sid, o.source_size, o.target, o.goal, o.total, o.n,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
r AS (SELECT *, CASE WHEN size > 0 AND pos < goal THEN least((pos * {SLOTS}) // total, n - 1) END AS rank FROM a)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(pos + size, goal) - pos) + greatest(0, least(pos + source_size + size, goal) - pos - source_size)
            + greatest(0, least(pos + 2 * source_size + size, goal) - pos - 2 * source_size) AS BIGINT) AS taken,
       CASE WHEN r.rank IS NOT NULL THEN coalesce(g.slot, {SLOTS}) END AS first_slot
FROM r LEFT JOIN g ON r.sid = g.sid AND r.rank = g.rank
"""
