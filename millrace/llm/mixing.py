"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes (words) are summed per source; targets come from the weights, none
   above ``max_epochs`` times its source, the excess shared by weight among the
   others (the level at which the sources fill up is found in one sort).
2. The mix is cut into slots of about ``block`` words. Slot j gets the point
   frac((j + 1/2) / golden ratio), and the source whose interval of cumulative
   target shares holds it; slots are then ranked per source, in ranges of slots
   so that no source's slots meet in one task.
3. Each source's documents are put in an order drawn anew for every epoch by a
   hash of their id, and laid end to end; positions come from sums of
   hash buckets and running sums inside each, so a large source is not sorted
   in one task either.
4. That line, up to the target, is cut into as many equal blocks as the source
   has slots (block sizes differ by a word at most), and blocks join slots on
   (source, rank). A source with a positive target and no slot gets one behind
   the others.

Every source so takes exactly its rounded target. Everything is DataFrame code.

Null texts and texts without words have size 0 and are never taken. Null sources
form one source, ordered last. Rows of equal ids are ordered by size, and
those that tie in both are interchangeable. Very long texts may fill several blocks. An empty table gives an
empty plan. Columns of the input other than the three named are not read, and may have any names.

Sources are taken to be few next to documents: targets and the intervals of the schedule come from windows over one row for
each source, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, word_count, written

GOLDEN = 0.6180339887498949
#: Slots whose ranks are counted together; grid cells that map points to sources; documents summed together.
RANGE, CELLS, BUCKET = 1024, 1024, 1024


@dataclass
class Mix:
    sized: DataFrame  #: row, id, size, src
    sources: DataFrame  #: src, source, weight, source_size, target, goal (whole words), slots
    plan: DataFrame  #: slot, src, block, epoch, row, id, first_word, words


def targets(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row per source: its weight, size and target. Sources are few next to documents."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("src", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * float(max_epochs))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    everything = Window.partitionBy()
    per = (
        per.withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("filled", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce("filled", F.lit(0.0))) / F.col("open"))
        .withColumn("fits", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("rank")))
        .withColumn("level", F.min_by("level", "fits").over(everything))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .withColumn("goal", F.round("target").cast("long"))
    )
    return per.select("src", "source", "weight", "docs", "source_size", "target", "goal", "total")


def schedule(spark, sources: DataFrame, total: int, block: int) -> DataFrame:
    """slot, src, rank: the slots in order, each with its source and rank among the source's."""
    n = -(-total // block)
    order = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.filter("goal > 0").withColumn("high", F.sum("target").over(order) / F.sum("target").over(Window.partitionBy()))
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), 2.0).otherwise(F.col("high")))
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS)).cast("long")
    cells = written(shares.select("src", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("long"), last)).alias("cell")), "cells")
    x = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    points = spark.range(0, n).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * CELLS).cast("long"))
    slots = points.join(cells, "cell").filter("x >= low AND x < high").select("slot", "src")
    absent = sources.filter("goal > 0").join(slots.select("src").distinct(), "src", "left_anti")
    extra = absent.select((F.lit(n) + F.col("src")).alias("slot"), "src")
    slots = cut(slots.unionByName(extra).withColumn("range", F.floor(F.col("slot") / RANGE).cast("long")))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("src", "range").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("src", "range").orderBy("slot")) - 1
    return slots.join(counts.select("src", "range", "before"), ["src", "range"]).select("slot", "src", (F.col("before") + inside).cast("long").alias("rank"))


def lines(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """row, id, size, src, epoch, start: the documents of each source laid end to end, epoch after epoch."""
    per = sources.select("src", "docs", "source_size", "goal").filter("goal > 0")
    epochs = F.sequence(F.lit(0).cast("long"), F.expr("(goal - 1) div source_size"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "id", "size"), 11) / float(1 << 53)
    laid = (
        sized.filter("size > 0").join(per, "src").withColumn("epoch", F.explode(epochs)).withColumn("u", u)
        .withColumn("bucket", F.floor(F.col("u") * (F.expr(f"docs div {BUCKET}") + 1)).cast("long"))
    )
    key = ["src", "epoch", "bucket"]
    before = Window.partitionBy("src", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(key).agg(F.sum("size").alias("n"))
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*key, "before"))
    running = F.sum("size").over(Window.partitionBy(key).orderBy("u", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("running", running).join(sums, key)
    return laid.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("before") + F.col("running") - F.col("size"))


def mix(
    docs: DataFrame, *, id: str = "doc_id", source: str = "source", size: Column | None = None, mark: Column | None = None,
    weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, block: int = 4096, seed: int = 20260101,
) -> Mix:
    """The mix of ``docs``: sizes, targets, and the plan of (slot, block, document, words). ``mark`` is carried along as is."""
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    raw = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size.alias("size"), (F.lit(None) if mark is None else mark).cast("long").alias("mark"))
    raw = cut(raw.withColumn("row", F.monotonically_increasing_id()))
    sources = written(targets(raw, weights, max_epochs), "sources")
    sized = raw.join(sources.select("src", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    top = sources.agg(F.max("total")).first()[0] or 0
    slots = cut(schedule(spark, sources, int(top), block))
    counts = slots.groupBy("src").agg(F.count(F.lit(1)).alias("slots"))
    sources = written(sources.join(counts, "src", "left").fillna(0, ["slots"]), "sources")

    cuts = sources.select("src", "slots", "goal").filter("goal > 0").withColumnsRenamed({"goal": "end"})
    per, rest = F.expr("end div slots"), F.expr("end % slots")
    stop = F.least(F.col("start") + F.col("size"), F.col("end"))

    def block_of(p: Column) -> Column:
        long = rest * (per + 1)
        return F.when(p < long, F.floor(p / (per + 1))).otherwise(rest + F.floor((p - long) / F.greatest(per, F.lit(1)))).cast("long")

    def begin_of(k: Column) -> Column:
        return k * per + F.least(k, rest)

    parts = (
        lines(sized, sources, seed).select("row", "id", "src", "epoch", "size", "start").join(cuts, "src").filter(F.col("start") < F.col("end"))
        .withColumn("stop", stop).withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("stop") - 1))))
        .withColumn("a", F.greatest(F.col("start"), begin_of(F.col("block")))).withColumn("b", F.least(F.col("stop"), begin_of(F.col("block") + 1)))
        .filter("b > a")
    )
    plan = parts.join(slots.withColumnRenamed("rank", "block"), ["src", "block"]).select(
        "slot", "src", "block", "epoch", "row", "id", (F.col("a") - F.col("start")).alias("first_word"), (F.col("b") - F.col("a")).alias("words")
    )
    return Mix(sized, sources, plan)


def mixed(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes (part of) them. Rows that repeat id, text and source share what is taken of them,
    each as often as any other or once more; which ones it is is undefined, as is what tells them apart. Rows without words are not taken."""
    m = mix(docs, id=id, source=source, size=word_count(F.col(text)), mark=F.xxhash64(text), **options)
    copies = m.plan.select("row", "epoch").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    same = m.sized.select("row", "id", "mark", "src").join(copies, "row", "left").groupBy("id", "mark", "src")
    taken = same.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).filter("n > 0").join(m.sources.select("src", "source"), "src")
    i, mark, src, n, r, k = apart(docs, "_id", "_mark", "_src", "_n", "_r", "_k")
    taken = written(taken.select(F.col("id").alias(i), F.col("mark").alias(mark), F.col("source").alias(src), F.col("n").alias(n), F.col("rows").alias(r)), "copies")
    found = docs.join(taken, F.col(id).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(mark)) & F.col(source).eqNullSafe(F.col(src)))
    if taken.filter(F.col(r) > 1).isEmpty():
        times = found
    else:
        times = found.filter(F.col(r) == 1).unionByName(_shared_out(found.filter(F.col(r) > 1), i, mark, src, n, r))
    return times.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def _shared_out(rows: DataFrame, i: str, mark: str, src: str, n: str, r: str) -> DataFrame:
    """Rows that repeat others, with ``n`` (of all of them) dealt out to each. They are numbered within buckets, so that
    rows of which very many are alike do not meet in one task."""
    row, bucket, rank, before = apart(rows, "_row", "_bucket", "_rank", "_before")
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "repeats")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(BUCKET)))
    key = [i, mark, src]
    sums = rows.groupBy(*key, bucket).agg(F.count(F.lit(1)).alias(before))
    ahead = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy(*key, bucket).orderBy(row)) - 1
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, bucket)]
    both = rows.withColumn(rank, inside).alias("l").join(sums.alias("r"), on).select("l.*", F.col(f"r.{before}"))
    share = F.call_function("div", F.col(n), F.col(r)) + F.when(F.col(before) + F.col(rank) < F.col(n) % F.col(r), 1).otherwise(0)
    return both.withColumn(n, share).filter(F.col(n) > 0).drop(row, bucket, rank, before)
