"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions.

Each source gets ``min(max_epochs * its size, level * its weight)`` words, with the one level at
which the targets add up to the budget: sources whose cap lies below their share are clamped and
their excess goes to the others in proportion to the weights, until none is above its cap. With
the sources in the order of cap / weight that level follows from running sums, so no loop is
needed.

A source whose target is ``e`` times its size has every row ``floor(e)`` times. The remaining words are
filled in a seeded order, ``md5(seed:key:text)``: a row is taken once more if it fits into what is left when its
turn comes, so a long row that doesn't fit blocks none behind it, and in the end every row not taken is longer than the rest.
Then one more row is taken, or one taken row is exchanged for another, whichever brings the sum nearest to
the target. Reruns agree.

Only DataFrame functions. Texts are never shuffled: rows are measured where they are read, into a
narrow table (source, digest, size). The order is walked in rounds, each up to the first row that doesn't
fit; rows longer than the rest are out from then on, so the rest falls by about half in a round or two. A round sums sizes per
source and leading digits of the digest (a source holding a third of all rows is 4096 cells,
pre-aggregated on the map side), and only the one cell per source that holds the border is ordered row by row. What
comes back to the texts is one line per source, with the borders of its rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundscope.llm.common import WORD, set_aside, store


def word_count(col: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Weights dealt to the sources in code point order, null last, repeating.

    One row per source: the sort behind the row number sees the list of sources, never rows."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    i = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), i + 1))


def water_fill(sources: DataFrame, max_epochs: int, budget: Column | None = None) -> DataFrame:
    """``sources``: source, size (long), weight (long > 0). Adds ``target`` (double).

    The budget is the sum of all sizes unless given. If all caps together lie below it, every
    source stops at its cap. Sums are integers, so the result does not depend on row order."""
    cap = (F.col("size") * F.lit(int(max_epochs)))
    whole = Window.partitionBy(F.lit(1))
    by_ratio = (Window.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source")))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (sources.withColumn("cap", cap)
         .withColumn("budget", F.sum("size").over(whole) if budget is None else budget)
         .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0)))
         .withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))))
    # clamped: with this source and all of a larger ratio open, its share would reach its cap
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two sums can pass 64 bits
    s = s.withColumn("clamped", wide("rest") * wide("weight") >= wide("cap") * wide("share"))
    # the first open source, the one with the most weight open, has the level of all open ones
    first = F.max(F.when(~F.col("clamped"), F.struct("share", "rest"))).over(whole)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        first["rest"].cast("double") * F.col("weight").cast("double") / first["share"].cast("double"))
    return s.withColumn("target", target).select(*sources.columns, "target")


def mix(df: DataFrame, key_cols: Sequence[str], text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
        cells: int = 4096) -> DataFrame:
    """Every row of ``df`` with ``size``, ``source_size``, ``target`` and ``repeats`` (int, 0 to
    ``max_epochs``); a clash with input columns of these names replaces them.

    A null source is a source of its own; null or empty texts have size 0, add no words and are never
    taken beyond the whole repetitions; rows with equal keys, null ones too, differ by their texts, and rows equal in both
    share one decision; an empty table stays empty.
    """
    own = ("size", "source_size", "target", "repeats")
    base = df.drop(*[c for c in own if c != source_col and c != text_col])
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    order = F.md5(F.concat_ws("\u0001", F.lit(seed), *[told(F.col(c).cast("string")) for c in key_cols], told(F.md5(F.col(text_col).cast("binary")))))
    # the leading digits name the cell, so cells follow the order of the digests
    digits = max(1, (cells - 1).bit_length() // 4)
    rows = store(base.select(F.col(source_col).alias("source"), order.alias("h"), word_count(F.col(text_col)).alias("size"))
                 .groupBy("source", "h").agg(F.sum("size").alias("size")), "mix-rows")
    rows = rows.withColumn("cell", F.substring("h", 1, digits))
    per_cell = store(rows.groupBy("source", "cell").agg(F.sum("size").alias("size")), "mix-cells")
    sources = cycle_weights(per_cell.groupBy("source").agg(F.sum("size").alias("size")), weights)
    filled = water_fill(sources, max_epochs).withColumn(
        "whole", F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs)))
        .otherwise(0).cast("int")).withColumn("part", F.col("target") - F.col("whole") * F.col("size"))
    plan = store(filled.select("source", F.col("size").alias("source_size"), "target", "whole", "part"), "mix-plan")

    same = lambda c: F.col("source").eqNullSafe(F.col(c))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    at = plan.select(F.col("source").alias("s"), F.lit("").alias("cut"), F.col("part").alias("left"))
    rounds = []
    while True:  # each round: rows behind the cut that are not longer than the rest, up to the first that doesn't fit
        fitting = rows.join(at, same("s")).where((F.col("h") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
        sums = fitting.groupBy("source", "cell").agg(F.sum("size").alias("size"), F.first("left").alias("left"), F.first("cut").alias("cut"))
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        # a source has one border cell at most; without one all fitting rows are in
        at_border = (F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left"))
        every = sums.groupBy("source").agg(F.sum("size").alias("all"), F.first("left").alias("left"), F.first("cut").alias("cut"),
                                           F.max(F.when(at_border, F.struct("cell", "before"))).alias("b"))
        border = every.where("b is not null").select(F.col("source").alias("b_source"), F.col("b.cell").alias("b_cell"), F.col("b.before").alias("b_before"))
        inside = (fitting.join(border, same("b_source") & (F.col("cell") == F.col("b_cell"))).withColumn("upto", F.col("b_before") + F.sum("size").over(run))
                  .where(F.col("upto") <= F.col("left")).groupBy(F.col("source").alias("l_source")).agg(F.max("h").alias("h"), F.max("upto").alias("upto")))
        # without a row of the border cell, all cells before it are in
        done = store(every.join(inside, same("l_source"), "left").select(
            F.col("source").alias("s"), F.col("cut").alias("from"), F.when(F.col("b").isNull(), "~").otherwise(F.coalesce("h", "b.cell")).alias("to"), "left",
            (F.col("left") - F.when(F.col("b").isNull(), F.col("all")).otherwise(F.coalesce("upto", "b.before"))).alias("rest")), "mix-round")
        if not done.limit(1).count():
            break
        rounds.append(done)
        at = done.select("s", F.col("to").alias("cut"), F.col("rest").alias("left"))
    walked = plan.select(F.col("source").alias("s"), F.lit("").alias("from"), F.lit("").alias("to"), F.col("part").alias("left"), F.col("part").alias("rest"))
    for done in rounds:
        walked = walked.unionByName(done)
    edge = store(walked.groupBy("s").agg(F.collect_list(F.struct("from", "to", "left")).alias("steps"), F.min("rest").alias("rest")), "mix-edge")
    taken = F.exists("steps", lambda r: (F.col("h") > r["from"]) & (F.col("h") <= r["to"]) & (F.col("size") > 0) & (F.col("size") <= r["left"]))
    # what brings the sum nearer: one more row, or another row for a taken one (sizes stand for their first rows)
    sizes = store(rows.where("size > 0").join(edge, same("s")).groupBy("source", "size", taken.alias("in")).agg(
        F.min("h").alias("h"), F.first("rest").alias("rest")), "mix-sizes")
    out = sizes.where(~F.col("in"))
    add = out.select("source", F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.lit(0).alias("kind"), "size", F.lit(0).cast("long").alias("gone"),
                                        "h", F.lit(None).cast("string").alias("away")).alias("best"))
    marks = sizes.select("source", "rest", "size", "h", "in", F.when(F.col("in"), F.col("size").cast("double")).otherwise(F.col("size") - F.col("rest")).alias("v"))
    near = Window.partitionBy("source").orderBy("v", F.desc("in"))
    given = F.when(F.col("in"), F.struct("size", "h"))
    sides = marks.select("*", F.last(given, True).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("low"),
                         F.first(given, True).over(near.rowsBetween(0, Window.unboundedFollowing)).alias("high")).where(~F.col("in"))
    swap = sides.select("*", F.explode(F.array("low", "high")).alias("t")).where("t is not null and t.size < size").select(
        "source", F.struct(F.abs(F.col("size") - F.col("t.size") - F.col("rest")).alias("off"), F.lit(1).alias("kind"), "size", F.col("t.size").alias("gone"),
                           "h", F.col("t.h").alias("away")).alias("best"))
    fill = add.unionByName(swap).groupBy(F.col("source").alias("f_source")).agg(F.min("best").alias("f"))
    cuts = store(plan.join(edge, same("s")).join(fill, same("f_source"), "left").withColumn("f", F.when(F.col("f.off") < F.col("rest"), F.col("f")))
                 .select(*[F.col(c).alias(f"__mix_{n}") for c, n in (("source", "source"), ("source_size", "size"), ("target", "target"),
                                                                     ("whole", "whole"), ("steps", "steps"), ("f.h", "filler"), ("f.away", "away"))]), "mix-cuts")
    # the stored table has a known size: Spark broadcasts it below its threshold and joins by key above
    measured = base.withColumns({"__mix_h": order, "__mix_n": word_count(F.col(text_col))})
    h, n = F.col("__mix_h"), F.col("__mix_n")
    taken = F.exists("__mix_steps", lambda r: (h > r["from"]) & (h <= r["to"]) & (n > 0) & (n <= r["left"]))
    extra = F.when(h == F.col("__mix_away"), 0).when(taken | (h == F.col("__mix_filler")), 1).otherwise(0)
    return measured.join(cuts, F.col(source_col).eqNullSafe(F.col("__mix_source"))).select(
        *[c for c in base.columns if c != "size"], n.alias("size"), F.col("__mix_size").alias("source_size"),
        F.col("__mix_target").alias("target"), F.least(F.col("__mix_whole") + extra, F.lit(max_epochs)).cast("int").alias("repeats"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row of a mix ``repeats`` times."""
    return (mixed.where(F.col("repeats") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).drop("__copy"))


def mixed_rows(df: DataFrame, key_cols: Sequence[str], **options) -> DataFrame:
    """The mix itself: the rows of ``df``, as often as the mix takes them, with their own columns."""
    rows, own = set_aside(df, ("size", "source_size", "target", "repeats"))
    return own(repeat_rows(mix(rows, key_cols, **options)))
