"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources share ``SHARE`` of all words by weight; none gets more than ``EPOCHS`` times its own words, and what a full source leaves
is shared again by weight. Schedule: slot i has the golden-ratio point frac(i * 0.618...), mapped through the cumulative targets to a source; a
slot's rank among its source's slots picks the source's next block of equal tokens. Blocks cut the source's documents, shuffled by hash and
laid end to end (twice, where the target asks for repeats). The last block of a source ends at its target. Where the schedule leaves a
source short of slots, which the low discrepancy keeps to a handful, the missing ranks follow at the end. The words taken of a document are settled by the
targets; the schedule gives the mix's order: a document stands at the first slot that takes a block with words of it.

Running sums are in two steps, over buckets of the hash and within a bucket, and ranks likewise over stretches of slots, so that a source
with a third of all rows is many small groups; rows alike in id, text and source are one row with a number until the sums are known. A slot
finds its source by a join on stretches of the unit interval, of which there are a few for each source. One window holds a row per source.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, last in order; a null ``doc_id`` is a row of
its own; repeated rows stand side by side in the order; an empty table, or one without words, takes nothing; a very long text is counted and cut
by one task, in time linear in its length; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, saved

#: Fixed values of the contract: weights in turn, the share of all words, the most times that a source is taken.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
GOLDEN = 0.6180339887498949
#: Words in a block; where all targets together have fewer than ``LEAST_SLOTS`` blocks, smaller ones make so many.
BLOCK, LEAST_SLOTS = 1024, 1024
#: Distinct rows in a bucket of a source's hash range, about; slots in a stretch; copies of a row that are dealt at once.
BUCKET, STRETCH, COPIES = 1024, 8192, 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, h): key stands for id and text, h is the document's place in its source's shuffled order."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key()).withColumn("h", F.xxhash64("key", F.lit("order")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(s, source, source_size, target): s numbers the sources by code point, null last; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("s", (F.row_number().over(order) - 1).cast("long")).withColumn("w", weight.cast("double"))
    # Sources fill up in the order of limit over weight: k of them are full if the level that the others would then get lies below the next one's limit.
    limit = F.col("source_size") * F.lit(float(epochs))
    filling = Window.orderBy(limit / F.col("w"), "s")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = own.withColumn("limit", limit).withColumn("level", level)
    full = F.col("level") > F.col("limit") / F.col("w")
    # the first source that isn't full sets the level for itself and all after it
    last = F.min(F.when(~full, F.struct(F.col("limit") / F.col("w"), F.col("s"), F.col("level")))).over(every)
    return levels.withColumn("at", last).select("s", "source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("limit"), F.coalesce(F.col("at")["level"] * F.col("w"), F.col("limit")))).alias("target"))


def running(df: DataFrame, of: str, group: list[str], order: list[Column], bucket: str) -> DataFrame:
    """Adds ``before``: the sum of ``of`` over the rows of the group that come earlier by (bucket, order)."""
    per = df.groupBy(*group, bucket).agg(F.sum(of).alias("part"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part")
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("within", F.coalesce(F.sum(of).over(within), F.lit(0))).join(per, [*group, bucket]).withColumn("before", F.col("base") + F.col("within")).drop("base", "within")


def block_size(goals: DataFrame) -> int:
    return max(1, min(BLOCK, int(goals.agg(F.sum("target")).head()[0] or 0) // LEAST_SLOTS))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(slot, s, rank): which source, and which of its blocks, each slot of the mix takes."""
    total, n, n_sources = goals.agg(F.sum("target"), F.sum(F.ceil(F.col("target") / block)), F.count(F.lit(1))).head()
    n, cells = int(n or 0), 4 * n_sources + 64
    quota = goals.select("s", F.ceil(F.col("target") / block).cast("long").alias("quota"))
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = goals.where("target > 0").select("s", (F.sum("target").over(upto) / F.lit(total or 1.0)).alias("edge"))
    share = share.select("s", F.coalesce(F.lag("edge").over(Window.orderBy("s")), F.lit(0.0)).alias("low"), F.when(F.lead("s").over(Window.orderBy("s")).isNull(), F.lit(2.0)).otherwise(F.col("edge")).alias("high"))
    # sources by the cells of the unit interval that their shares touch: about as many rows as cells, and each slot meets few
    edges = share.select("s", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"))
    slots = goals.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("point", F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))).withColumn("cell", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)))
    mapped = slots.join(edges, "cell").where("point >= low and point < high").select("slot", "s", F.lit(1).alias("one"), F.floor(F.col("slot") / STRETCH).alias("stretch"))
    ranked = running(mapped, "one", ["s"], [F.col("slot")], "stretch").select("slot", "s", F.col("before").alias("rank"))
    ranked = ranked.join(quota, "s").where("rank < quota").select("slot", "s", "rank")
    short = quota.join(mapped.groupBy("s").agg(F.count(F.lit(1)).alias("have")), "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
    late = short.select(F.lit(n).alias("slot"), "s", F.explode(F.sequence("have", F.col("quota") - 1)).alias("rank"))
    return ranked.unionByName(late.withColumn("slot", F.col("slot").cast("long")))


def copies_of(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row as many times as its column ``n`` says, numbered from 0 in the column ``name``: a number beyond ``COPIES`` is dealt to several tasks."""
    one = rows.where(F.col(n) == 1).withColumn(name, F.lit(0).cast("long"))
    first = F.col("chunk") * COPIES
    chunks = rows.where(F.col(n) > 1).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / COPIES)))).repartition(*rows.columns, "chunk")
    return one.unionByName(chunks.withColumn(name, F.explode(F.sequence(first, F.least(first + COPIES, F.col(n)) - 1))).drop("chunk"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken, slot, rank, offset): one row per document with the words that the mix takes of it, repeats counted.

    slot is the first that takes words of it (null if none does) rank its source's block there, offset where the words stand in it: (slot, source, rank, offset) is the mix's order.
    """
    sizes = saved(sized(docs))
    goals = saved(targets(sizes, weights, share, epochs))
    block = block_size(goals)
    slots = schedule(goals, block)
    # as many rows as sources, each of a few bytes: broadcast by size if Spark finds it small, else joined
    goal = goals.select("s", F.col("source").alias("goal_source"), "source_size", "target")
    alike = sizes.where("size > 0").groupBy("doc_id", "key", "h", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.join(goal, alike["source"].eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("words", F.col("size") * F.col("n"))
    # bucket of the hash's range, in its order
    placed = alike.withColumn("bucket", F.shiftrightunsigned("h", 64 - max(1, min(24, (sizes.count() // BUCKET).bit_length()))))
    lined = saved(running(placed, "words", ["s"], [F.col("h"), F.col("key")], "bucket").drop("bucket", "words", "h"))
    rows = copies_of(lined, "n", "copy").withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    # a document's stretches in the endless repetition of its source, up to the target, cut at the blocks' ends
    copies = rows.select("s", "before", F.explode(F.expr(f"transform(sequence(0, {epochs - 1}), e -> struct(e * source_size + before as a, least(e * source_size + before + size, cast(round(target) as bigint)) as b))")).alias("x")).where("x.a < x.b")
    parts = copies.select("s", "before", "x", F.explode(F.sequence(F.floor(F.col("x.a") / block), F.floor((F.col("x.b") - 1) / block))).alias("rank"))
    parts = parts.select("s", "before", "rank", (F.least(F.col("x.b"), (F.col("rank") + 1) * block) - F.greatest(F.col("x.a"), F.col("rank") * block)).alias("words"), F.greatest(F.col("x.a") - F.col("rank") * block, F.lit(0)).alias("offset"))
    taken = parts.join(slots, ["s", "rank"]).groupBy("s", "before").agg(F.sum("words").alias("taken"), F.min(F.struct("slot", "s", "rank", "offset")).alias("first"))
    found = rows.join(taken, ["s", "before"], "left").select("doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("first.slot").alias("slot"), F.col("first.rank").alias("rank"), F.col("first.offset").alias("offset"))
    empty = sizes.where("size = 0").join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select("doc_id", "key", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *(F.lit(None).cast("long").alias(x) for x in ("slot", "rank", "offset")))
    return found.unionByName(empty)


def numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``copy``: the row's number, from 0, among those alike in the group's columns; a group may be large, its rows are counted in stretches first."""
    own = saved(rows.withColumn("at", F.monotonically_increasing_id()))
    placed = running(own.select(*group, "at", F.lit(1).alias("one"), F.floor(F.col("at") / STRETCH).alias("stretch")), "one", group, [F.col("at")], "stretch")
    return own.join(placed.select("at", F.col("before").alias("copy")), "at").drop("at")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: left out, whole, or repeated in one text, a line end between; n_chars, if there, is counted anew.

    The one document of each source at which its target is reached is cut after the last word taken, with single spaces between its words; of rows
    alike in id, text and source the first ones take a word more where the words don't divide evenly. The rows are in the mix's order.
    """
    same = ["mix_key", "mix_source"]
    shares = saved(mix(docs).groupBy(F.col("key").alias("mix_key"), F.col("source").alias("mix_source")).agg(F.sum("taken").alias("mix_taken"), F.count(F.lit(1)).alias("mix_n"), F.max("size").alias("mix_size"), F.min(F.when(F.col("slot").isNotNull(), F.struct("slot", "source", "rank", "offset"))).alias("mix_place")).where("mix_taken > 0"))
    uneven = shares.where("mix_taken % mix_n > 0")
    row = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("mix_key"), F.col("source").cast("string").alias("mix_source"))

    def met(some: DataFrame) -> DataFrame:
        other = some.withColumnsRenamed({"mix_key": "other_key", "mix_source": "other_source"})
        return row.join(other, (F.col("mix_key") == F.col("other_key")) & F.col("mix_source").eqNullSafe(F.col("other_source"))).drop("other_key", "other_source")

    every = met(shares.where("mix_taken % mix_n = 0")).withColumn("words", F.expr("mix_taken div mix_n"))
    if not uneven.isEmpty():  # one group of copies in each source at most
        every = every.unionByName(numbered(met(uneven), same).withColumn("words", F.expr("mix_taken div mix_n + if(copy < mix_taken % mix_n, 1, 0)")).drop("copy"))
    rest = F.when(F.col("words") % F.col("mix_size") > 0, F.array_join(F.slice(F.filter(F.split("row.text", SPACE + "+"), lambda x: x != ""), F.lit(1), (F.col("words") % F.col("mix_size")).cast("int")), " "))
    parts = F.array_join(F.concat(F.array_repeat(F.col("row.text"), F.floor(F.col("words") / F.col("mix_size")).cast("int")), F.array(rest)), "\n")
    taken = every.where("words > 0").select("row", parts.alias("mix_text"), "mix_place").orderBy("mix_place")
    new = {"text": F.col("mix_text"), "n_chars": F.length("mix_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return taken.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "slot", "rank", "offset")
