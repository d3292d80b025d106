"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Each source's documents, shuffled by a hash of their id, text and source, lie on a line of words that is cut into
equal-token blocks. Slot i of the mix falls on the golden-ratio point frac((i + 1) / phi); the
interval of cumulative weights that holds the point names the source, so any run of slots has each
source near its share. A slot's rank among its source's slots (modulo blocks) names the block that
it takes: a source is read in passes over its line, and its last slot takes the rest of its words.
Slots that the points give a source beyond its need go to the sources that fell short, at the end.

Prefix sums and ranks have two levels (hash ranges of a source, or runs of slots, then within), so
a source with a third of all rows is spread over many tasks. Rows that are equal in all that counts share
a hash; where there are many, they are counted first and lie in stretches of their own, dealt by a number of
the row. As they are equal, their order among themselves says nothing, and reruns agree (kept columns break
ties, but for those of more than RANGE_ROWS rows that are equal otherwise).

Null ids are shuffled like any other, null texts have size 0, a null source is a source of its own,
the last. Sources without words take none; an empty table gives an empty result. Repeated rows are
documents of their own. Extra columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as c

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks that a smaller source has at least (if it has the words).
BLOCK, LEAST_BLOCKS = 4096, 64
#: Rows of a hash range, slots of a run, cells of the grid that finds a point's interval.
RANGE_ROWS, RUN, GRID = 10_000, 1 << 15, 1024
GOLDEN = 0.6180339887498949


@dataclass
class Mix:
    """docs: a row for each document; slots: the schedule, a row for each slot (slot, source,
    pass, block, first word of the block on the source's line, words)."""

    docs: DataFrame
    slots: DataFrame


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds k (order by code point, null last), weight and target to rows (source, source_size).
    Raising the share of a weight until all words are given out, with caps of most * size, is the
    largest share that any number of sources, capped in the order of cap by weight, leaves."""
    every = W.partitionBy(F.lit(0))
    out = sources.withColumn("k", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    before = every.orderBy(most * F.col("source_size") / F.col("weight"), "k").rowsBetween(W.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = left.cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("share", share).withColumn("share", F.max("share").over(every))
    return out.withColumn("target", F.least(cap.cast("double"), F.col("share") * F.col("weight"))).drop("share")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> Mix:
    """docs: id_col, size, source_size, target, taken (words the mix takes, repeats counted), source
    and the columns of keep."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own_columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *(F.col(x).alias(f"keep_{x}") for x in keep)]
    order = F.xxhash64(F.lit(42), F.col(id_col), F.col(text_col), F.col(source_col))
    kept = F.xxhash64(F.lit(42), *(F.col(x) for x in keep))
    rows = c.spread(docs).select(*own_columns, order.alias("h"), kept.alias("kept"), F.monotonically_increasing_id().alias("tie"))
    rows = c.stash(rows)
    hot = c.stash(rows.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > RANGE_ROWS).select("h", F.ceil(F.col("m") / RANGE_ROWS).alias("parts")))
    rows = c.join_small(rows, hot, "h", "left", hot.count())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, weights, most)
    budget = F.floor("target").cast("long")
    of_size = F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("blocks", F.least(of_size, F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK))).cast("long"))
    sources = sources.withColumn("budget", budget).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    # The last pass needs the blocks that begin before the rest of the budget ends.
    sources = sources.withColumn("need", F.when(F.col("source_size") > 0, F.col("passes") * F.col("blocks") + F.expr("(rest * blocks + source_size - 1) div source_size")).otherwise(0).cast("long"))
    sources = c.stash(sources.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()

    # Places on the lines.
    own = sources.select(F.col("source").alias("s"), "k", "ranges")
    own = F.broadcast(own) if n_sources * 200 <= 32 << 20 else own
    placed = rows.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("range", F.floor(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * F.col("ranges")))
    # In a range, rows whose hash many share come after the others, hash by hash.
    often = F.col("parts").isNotNull()
    placed = placed.withColumn("apart", F.when(often, F.struct("h", F.pmod(F.xxhash64("tie"), "parts").alias("part"))).otherwise(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("part"))))
    placed = placed.withColumns({"own_h": F.col("apart.h"), "part": F.col("apart.part")}).drop("apart", "parts")
    stretch = ["k", "range", "own_h", "part"]
    sums = placed.groupBy(*stretch).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("k").orderBy("range", F.col("own_h").asc_nulls_first(), "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    within = W.partitionBy(*stretch).orderBy(F.shiftrightunsigned("h", 11), "h", "id", "size", "kept").rowsBetween(W.unboundedPreceding, -1)
    same = (F.col("k") == F.col("k_")) & (F.col("range") == F.col("range_")) & F.col("own_h").eqNullSafe(F.col("own_h_")) & (F.col("part") == F.col("part_"))
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums.withColumnsRenamed({x: f"{x}_" for x in stretch}), same)
    placed = c.stash(placed.withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "h", "kept", "ranges", "tie", *stretch[1:], *(f"{x}_" for x in stretch)))

    # The schedule.
    every = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    cells = sources.where("need > 0").withColumn("high", F.sum("need").over(every) / F.lit(float(max(1, total)))).withColumn("low", F.lag("high", 1, 0.0).over(W.partitionBy(F.lit(0)).orderBy("k")))
    cells = cells.select("k", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1)))).alias("cell"))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(total).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"), F.expr(f"id div {RUN}").alias("run"))
    points = points.withColumn("cell", F.floor(F.col("u") * GRID))
    points = points.join(F.broadcast(cells) if n_sources * 64 + GRID * 40 <= 32 << 20 else cells, "cell").where("u >= low and u < high").select("slot", "run", "k")
    counts = points.groupBy("run", "k").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = points.withColumn("r", F.row_number().over(W.partitionBy("run", "k").orderBy("slot")) - 1).join(counts.select("run", "k", "base"), ["run", "k"]).select("slot", "k", (F.col("base") + F.col("r")).alias("rank"))
    given = counts.groupBy("k").agg(F.sum("n").alias("given"))
    short = sources.join(given, "k", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < need").select("k", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    slots = ranked.unionByName(short.select((F.lit(total) + F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rank", "k")) - 1).alias("slot"), "k", "rank"))
    shape = sources.select("k", "source", "source_size", "blocks", "passes", "rest", "need")
    slots = slots.join(F.broadcast(shape) if n_sources * 200 <= 32 << 20 else shape, "k").where("rank < need")
    slots = slots.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    slots = slots.withColumn("first", F.expr("(block * source_size) div blocks")).withColumn("end", F.expr("((block + 1) * source_size) div blocks"))
    words = F.when(F.col("pass") < F.col("passes"), F.col("end") - F.col("first")).otherwise(F.least("end", "rest") - F.col("first"))
    slots = c.stash(slots.select("slot", "k", "source", "pass", "block", "first", words.alias("words"), (F.col("end") - F.col("first")).alias("whole")))

    # What the slots take of each document: its share of the blocks it lies in.
    taken = slots.groupBy("k", "block", "first", "whole").agg(F.sum((F.col("words") == F.col("whole")).cast("long")).alias("full"), F.max(F.when(F.col("words") < F.col("whole"), F.col("words")).otherwise(0)).alias("cut"))
    shape = sources.select("k", "source_size", "target", "blocks")
    docs_at = placed.join(F.broadcast(shape) if n_sources * 200 <= 32 << 20 else shape, "k")
    # Block b begins at floor(b * size / blocks): the last that begins by word w is ((w + 1) * blocks - 1) div size.
    at = lambda w: F.expr(f"(({w} + 1) * blocks - 1) div greatest(source_size, 1)")
    docs_at = docs_at.withColumn("row", F.monotonically_increasing_id())
    docs_at = c.stash(docs_at)
    spans = docs_at.where("size > 0").select("row", "k", "start", "size", F.explode(F.sequence(at("start"), at("start + size - 1"))).alias("block"))
    overlap = lambda end: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), end) - F.greatest("start", "first"))
    got = spans.join(taken, ["k", "block"]).groupBy("row").agg(F.sum(F.col("full") * overlap(F.col("first") + F.col("whole")) + overlap(F.col("first") + F.col("cut"))).alias("taken"))
    out = docs_at.join(got, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *(F.col(f"keep_{x}").alias(x) for x in keep))
    return Mix(out, slots.drop("k", "whole"))
