"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import WORD, whole_text
from duebook.session import materialise

#: Rows of one cell that one task numbers; larger cells are dealt over several.
CELL_ROWS = 1_000
#: Repeated rows that are written out at a time.
REPEATS = 1_000


def _key(source: str) -> Column:
    """The source as a join key that is never null and sorts as the source does, null last."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source)))


def source_targets(cells: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Target words of every source: ``key, source_size, target``.

    ``cells`` has ``key, size, n``. Sources in code point order weigh ``weights``, repeating, and share all words. A target ends at
    ``most`` times the size of its source; what is cut off is shared again by weight. The level at which that ends is the largest of
    (words - what the first k sources can give) / (weight of the others), sources in the order in which they reach their bound.
    The windows run over one row per source.
    """
    sizes = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    at = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    weighed = sizes.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")).alias("weight"),
                           (F.lit(float(most)) * F.col("source_size")).alias("bound"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    levels = weighed.select(
        "*", ((F.sum("source_size").over(total) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
              / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    return levels.select("key", "source_size", F.least("bound", F.max("level").over(total) * F.col("weight")).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = 1e-9, steps: int = 60) -> DataFrame:
    """Tilt of every source: ``key, source_size, target, mean, tilt``.

    Rates that differ least from 1 in relative entropy, every document counting alike, and meet the words of each source are
    r = min(most, exp(tilt * size / mean)). The tilt solves the convex dual, one unknown for each source: its gradient is
    sum(size * r) - target, its curvature sum(size^2 * r) / mean over the rates below the bound. A Newton step is one aggregate over the
    cells of equal source and size; a step that leaves the bracket of the root is replaced by the bracket's middle. Only the
    largest violation of a step comes to the driver.
    """
    words = cells.where("size > 0")
    facts = words.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least_size"))
    start = targets.join(facts, "key").where("target > 0").withColumn("z", F.col("least_size") / F.col("mean")) \
        .withColumn("full", F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")) \
        .withColumn("share", F.log(F.col("target") / F.col("source_size")) / F.col("z"))
    end = F.lit(math.log(most)) / F.col("z")
    state = materialise(start.select(
        "key", "source_size", "target", "mean",
        F.when(F.col("full"), end).otherwise(F.lit(0.0)).alias("tilt"),
        F.when(F.col("full"), end).when(F.col("share") < 0, F.col("share")).otherwise(F.lit(0.0)).alias("low"),
        F.when(F.col("full") | (F.col("share") >= 0), end).otherwise(F.lit(0.0)).alias("high"),
        F.when(F.col("full"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("off")), "tilts")
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))
    mass = F.col("n") * F.col("size") * rate
    for _ in range(steps):
        moved = state.join(words, "key").groupBy("key", "source_size", "target", "mean", "tilt", "low", "high").agg(
            (F.sum(mass) - F.col("target")).alias("gradient"),
            F.sum(F.when(rate < most, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("curvature"))
        off = F.abs(F.col("gradient")) / F.col("target")
        low = F.when(F.col("gradient") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gradient") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.col("gradient") / F.col("curvature")
        inside = (F.col("curvature") > 0) & (newton >= F.col("low")) & (newton <= F.col("high"))
        state = materialise(moved.withColumn("low", low).withColumn("high", high).select(
            "key", "source_size", "target", "mean",
            F.when(off <= tolerance, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            "low", "high", off.alias("off")), "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("key", "source_size", "target", "mean", "tilt")


def _corrected(plan: DataFrame, most: float, part: int) -> DataFrame:
    """Give or take copies in cells of sizes up to a part of what a source is off, largest size first, as many as come nearest."""
    every, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("size"))
    off = F.round("target") - F.sum(F.col("copies") * F.col("size")).over(every)
    room = F.when(F.col("off") > 0, F.col("n") * F.lit(int(most)) - F.col("copies")).otherwise(F.col("copies"))
    usable = (F.col("size") > 0) & (F.col("size") * part <= F.abs("off"))
    eligible = plan.withColumn("off", off).withColumn("room", F.when(usable, F.greatest(room, F.lit(0))).otherwise(F.lit(0)))
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("off") - before) / F.greatest(F.col("size"), F.lit(1)) + 0.5)))
    return eligible.withColumn("copies", (F.col("copies") + F.signum("off") * take).cast("long")).drop("off", "room")


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, text: str = "text",
        source: str = "source") -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source_size, target, rate, copies, taken``, one row per input row.

    Size is the number of words; null text has none, and a document without words is taken once, which adds no words. A null source is a
    source of its own, last in order. Rates come from ``balance`` over cells of equal source and size, so a source with a third of
    all rows is one row per distinct size. Rounding: per source, sizes falling, the running sum of ideal copies is rounded, which keeps
    the words within half of the largest document; three corrections then give or take copies of smaller documents. Inside a cell
    the copies go to documents in the order of a hash of ``doc_id``. Rows equal in ``doc_id``, source and size are counted first and
    written out at the end; cells of over ``CELL_ROWS`` rows are dealt over several tasks by ranges of the hash, and the rows of the
    deals before come from a count, so the order is one over the whole cell. Repeated rows are taken one by one. An empty table gives an
    empty result.
    """
    sized = materialise(documents.select("doc_id", _key(source).alias("key"),
                                         F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"))
                        .groupBy("doc_id", "key", "size").agg(F.count("*").alias("rows")), "sizes")
    cells = materialise(sized.groupBy("key", "size").agg(F.sum("rows").alias("n")), "cells")
    targets = materialise(source_targets(cells, weights, float(most)), "targets")
    tilts = balance(cells, targets, float(most))
    rate = F.when((F.col("size") == 0) | F.col("tilt").isNull(), F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(
        F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    rated = cells.join(targets, "key").join(tilts.select("key", "mean", "tilt"), "key", "left").select(
        "key", "size", "n", "source_size", "target", rate.alias("rate"))
    order = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ideal = rated.withColumn("upto", F.floor(upto + 0.5))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))
    plan = ideal.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n") * most)).drop("upto")
    plan = plan.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("copies")))
    for part in (4, 1, 1):
        plan = _corrected(plan, most, part)
    plan = materialise(plan.withColumn("deals", F.ceil(F.col("n") / CELL_ROWS)), "copies")
    place = F.xxhash64("doc_id", F.lit(7))
    range_of = F.floor((place.cast("double") / F.lit(2.0 ** 64) + 0.5) * F.col("deals"))
    dealt = sized.join(plan, ["key", "size"]).withColumn("place", place).withColumn(
        "deal", F.greatest(F.lit(0), F.least(range_of, F.col("deals") - 1)).cast("long"))
    upto_deal = Window.partitionBy("key", "size").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.where("deals > 1").groupBy("key", "size", "deal").agg(F.sum("rows").alias("held")).select(
        "key", "size", "deal", F.sum("held").over(upto_deal).alias("offset"))
    within = Window.partitionBy("key", "size", "deal").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("before", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(offsets, ["key", "size", "deal"], "left")
    more = F.col("copies") % F.col("n") - F.col("before") - F.coalesce("offset", F.lit(0))
    parts = ranked.withColumn("more", more).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / REPEATS))))
    first, last = F.col("part") * REPEATS + 1, F.least(F.col("rows"), (F.col("part") + 1) * REPEATS)
    each = parts.withColumn("number", F.explode(F.sequence(first, last)))
    taken = F.floor(F.col("copies") / F.col("n")) + (F.col("number") <= F.col("more")).cast("long")
    return each.withColumn("taken", taken).select(
        "doc_id", "size", "source_size", "target", "rate", F.col("taken").alias("copies"), (F.col("taken") * F.col("size")).alias("taken"))


def apply_mix(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as ``mixed`` takes them, whatever their columns are called; rows that share a ``doc_id`` are matched by size."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").alias("own"),
                            F.row_number().over(Window.partitionBy("doc_id").orderBy(size, F.xxhash64("text"))).alias("n"))
    counts = mixed.select(F.col("doc_id").alias("id"), "copies", F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "copies")).alias("m"))
    return rows.join(counts, rows["own"].eqNullSafe(counts["id"]) & (F.col("n") == F.col("m"))).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
