"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each one block of words. Slot ``i`` belongs to the source on which
the golden-ratio point ``frac(i * phi)`` falls when the sources lie side by side as long as their targets, so
that every stretch of the mix, not only its whole, has nearly the target shares. A source's documents,
shuffled by a seeded hash, lie end to end, start over after the last one, and are cut up to the target into as many
blocks of the same number of words as the source has slots; its r-th slot takes its r-th block. So every source's words
taken are its target, whatever the corpus' size and however small the source.

Sizes are words. Points are 32-bit integers (a multiple of 2**32 / phi, modulo 2**32), so that every engine
gets the same schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.scratch import written

#: 2**32 divided by the golden ratio, odd: multiples of it modulo 2**32 are the schedule's points.
GOLDEN_STEP = 2654435769
POINTS = 1 << 32
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: The mix is cut into this many slots at least; beyond some thousands of sources the slots grow with them.
SLOTS = 1 << 18
#: Each source has nearly this many slots at least, or, beside thousands of others, half of ``SLOTS_A_SOURCE``. The points of a golden-ratio
#: row leave no gap as long as three slots, so every source with words has its slots.
LEAST_SLOTS = 64
SLOTS_A_SOURCE = 8
#: A source's part of the circle is rounded to one of this many, so that products fit 63 bits.
PARTS = 1 << 29
#: Shuffled documents are dealt into runs by so many hexadecimal digits of their hash at least, and more where a run would hold more than
#: about ``RUN_ROWS`` of them; the position of a document is a sum over whole runs and a running sum inside its own, so no task holds a source.
RUNS_DIGITS = 3
RUN_ROWS = 1 << 20
WORD_BYTES = "[\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    """Number of maximal runs of characters other than space and ``\\t``..``\\r``; 0 for null."""
    bare = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.coalesce(F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_BYTES))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target size per source from ``(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn. A source's target is its weight's share
    of all words, but at most ``max_repeats`` times its own size; what that leaves goes to the others by weight.
    With the sources in order of cap over weight, those up to some place are capped and the rest share what is
    left, so one pass over the sorted sources finds the level. One row per source: this runs in one task, as it
    holds names and sums only.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weight_left).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # levels rise up to the first open source and fall behind it, so the highest open one is the first's
    share = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return level.select("source", "source_size", F.coalesce(F.least(F.col("cap"), share * F.col("weight")), F.col("cap")).alias("target"))


def slots_for(sources: int, least: int = SLOTS) -> int:
    """Slots of a mix: a power of two, ``SLOTS_A_SOURCE`` or more for each source on average."""
    return max(least, 1 << (SLOTS_A_SOURCE * sources - 1).bit_length()) if sources else least


def slot_takes(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slots of each source, with the block each takes, from ``(source_no, words)``: ``slot, source_no, block, slots_of``.

    A source's r-th slot takes its r-th block; ``slots_of`` is the number of its slots, by which its target of ``words`` is
    cut into blocks. A source's part of the circle is as long as its target, but long enough for LEAST_SLOTS slots, so
    that a tiny source beside a huge one has its blocks too.
    """
    in_order, every = Window.orderBy("source_no"), Window.partitionBy()
    share = F.col("words") / F.sum("words").over(every)
    least = F.least(F.lit(LEAST_SLOTS / slots), F.lit(0.5) / F.count(F.lit(1)).over(every))
    edges = (
        targets.where("words > 0")
        .withColumn("part", F.floor(F.greatest(share, least) * PARTS).cast("long"))
        .withColumn("upto", F.sum("part").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("parts", F.sum("part").over(every))
        .withColumn("hi", F.expr(f"upto * {POINTS} div parts"))
        .withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0)).cast("long"))
    )
    edges = edges.select("source_no", "lo", "hi")
    # cut the circle of points into cells so that slots meet their source by an equal key, not by a range
    cell_bits = 20
    cells = edges.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", cell_bits), F.shiftright(F.greatest(F.col("hi") - 1, F.col("lo")), cell_bits))))
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN_STEP % POINTS).alias("point")).withColumn("cell", F.shiftright("point", cell_bits))
    dealt = points.join(cells, "cell").where("point >= lo and point < hi")
    of_source = Window.partitionBy("source_no")
    return dealt.select("slot", "source_no", (F.row_number().over(of_source.orderBy("slot")) - 1).cast("long").alias("block"), F.count(F.lit(1)).over(of_source).alias("slots_of"))


def mixed(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix",
          weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` without their text, with what the mix takes of each.

    Returns ``key, source, size, source_size, target, taken, starts, first_slot``: ``taken`` counts words, repeats
    included; ``starts`` counts how often the document's first word is taken, which is how often the mix begins the
    document, ``first_slot`` is the first slot that does (null if none). Other columns of ``df`` don't matter, whatever their names.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null or repeated keys: rows of their
    own; rows with equal key, source and size are alike and interchangeable. Empty table: no rows.
    A document of no words starts once if its position is taken.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    rows = rows.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    rows = written(rows, "mix-rows")
    n_rows, digits = rows.count(), RUNS_DIGITS
    while n_rows > RUN_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("run", F.substring("mix_order", 1, digits))

    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    sizes = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    targets = written(source_targets(sizes, weights), "mix-targets")
    numbered = targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    numbered = numbered.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long"))
    per_source = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("run_size").over(per_source), F.lit(0))).drop("run_size")
    same_source = F.col("a.source").eqNullSafe(F.col("b.source"))
    starts = starts.alias("a").join(numbered.alias("b"), same_source).select("a.source", "run", "before", "source_size", "target", "words", "source_no")

    takes = written(slot_takes(numbered.select("source_no", "words"), slots_for(targets.count(), slots)), "mix-takes")
    blocks = takes.groupBy("source_no").agg(F.first("slots_of").alias("slots_of"))
    starts = starts.join(blocks, "source_no", "left").withColumn("slots_of", F.coalesce("slots_of", F.lit(0)))

    placed = (
        rows.alias("a").join(starts.alias("b"), same_source & (F.col("a.run") == F.col("b.run")))
        .select("a.key", "a.source", "a.size", "a.mix_order", "a.run", "b.before", "b.source_size", "b.target", "b.words", "b.source_no", "b.slots_of")
    )
    inside = Window.partitionBy("source_no", "run").orderBy("mix_order", F.col("key"), "size")
    start = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("start", start).withColumn("nth", F.row_number().over(inside))
    # block b is the words from b * width to (b + 1) * width of the source's row of words, gone through again and again
    width = F.greatest(F.ceil(F.col("words") / F.greatest("slots_of", F.lit(1))), F.lit(1)).cast("long")
    placed = placed.withColumn("width", width).withColumn("round", F.explode(F.array(*map(F.lit, range(MAX_REPEATS)))))
    placed = placed.withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
    last_word = F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.col("width")), F.floor(last_word / F.col("width")))))
    lo = F.greatest(F.col("at"), F.col("block") * F.col("width"))
    end = F.least((F.col("block") + 1) * F.col("width"), F.col("words"))
    hi = F.least(F.col("at") + F.col("size"), end)
    met = parts.join(takes.select("source_no", "block", "slot"), ["source_no", "block"], "left")
    met = met.withColumn("here", F.when(F.col("slot").isNotNull(), F.greatest(hi - lo, F.lit(0))).otherwise(0))
    first = F.col("slot").isNotNull() & (F.floor(F.col("at") / F.col("width")) == F.col("block")) & (F.col("at") < end)
    return (
        met.groupBy("source_no", "run", "nth")
        .agg(
            F.first("key").alias(key), F.first("source").alias(source), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
            F.first("target").alias("target"), F.sum("here").cast("long").alias("taken"), F.sum(first.cast("long")).alias("starts"), F.min(F.when(first, F.col("slot"))).alias("first_slot"),
        )
        .select(key, source, "size", "source_size", "target", "taken", "starts", "first_slot")
    )


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The rows of ``df`` as often as the mix begins each of them: some not at all, some up to MAX_REPEATS times.

    Rows alike in key, source and size share what the mix takes of them, rounded up.
    """
    takes = mixed(df, text, source, key, seed).groupBy(F.col(key).alias("k"), F.col(source).alias("s"), F.col("size").alias("z"))
    takes = takes.agg(F.ceil(F.sum("starts") / F.count(F.lit(1))).cast("int").alias("times")).where("times > 0")
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")
    rows = df.select(own, F.col(key).alias("key"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return rows.join(takes, same).select("own", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("own.*")
