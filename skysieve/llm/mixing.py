"""Mixing sources to target weights by Pareto order sampling.

Sources share all words by weight, each at most ``most`` times its own size
(the excess is shared again by weight). A source's ratio of target to size
gives each document floor(ratio) certain whole copies; what is left is filled
by a Pareto order sample: a document's rank is its random odds u / (1 - u)
divided by its inclusion odds p / (1 - p), and documents are taken by rank
until the source's words meet the target. u comes from a digest of the id, so
reruns and retries agree.

Plan: DataFrame operations only. The text is read once, into a narrow scratch
table (id, source, size). The cut in a source's order is found by sums over
bins of the rank, then over bins of the cut's bin, so a source that holds a
third of all rows is never sorted in one task; only the rows of the last bin
meet in a window. Sources' totals are joined by broadcast where there are at
most ``FEW_SOURCES`` of them, else by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BINS, FEW_SOURCES = 4096, 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def allot(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``target`` to (source, n, source_size): one row a source.

    The target is level * weight up to ``most`` * size. The level is found by
    one pass over sources in the order in which they reach their limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("weight", weight.cast("long")).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If the sources before this one, by limit, are full, the rest share what is left.
    out = out.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    out = out.withColumn("rest_weight", F.sum("weight").over(onward))
    fits = F.col("rest") * F.col("weight") <= F.col("limit") * F.col("rest_weight")
    level = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "rest", "rest_weight"))).over(everything)
    out = out.withColumn("level", level)
    full = F.coalesce(F.col("limit") * F.col("level.rest_weight") <= F.col("level.rest") * F.col("weight"), F.lit(True))
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("level.rest").cast("double") * F.col("weight") / F.col("level.rest_weight"))
    return out.select("source", "n", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 7,
) -> DataFrame:
    """One row per document row: id, size, source_size, target, taken.

    ``size`` counts words (null text: 0); ``taken`` counts the words the mix
    takes, whole copies times size, at most ``most`` times the size. A null
    source is a source of its own, last in the order that deals the weights. A
    source without words has target 0 and takes nothing. A null id draws as an
    empty one. Repeated rows draw the same number and are taken in turn. The
    words taken from a source differ from its target by at most half of the
    document at the cut.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    docs = scratch.keep(documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    plan = allot(sources, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    plan = scratch.keep(plan.withColumn("gap", F.col("p") * F.col("source_size")), "plan")
    small = F.broadcast if plan.count() <= FEW_SOURCES else lambda x: x

    odds, chance = F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p"))
    rank = F.when(F.col("p") > 0, odds / chance)
    scaled = F.col("rank") / (1 + F.col("rank")) * BINS
    ranked = (
        docs.join(small(plan), docs["source"].eqNullSafe(plan["source"]), "left").drop(plan["source"])
        .withColumn("u", uniform(F.col("id"), seed)).withColumn("rank", rank)
        .withColumn("bin", F.floor(scaled)).withColumn("bin2", F.floor((scaled - F.floor(scaled)) * BINS))
    )
    first = _cut(ranked.filter("p > 0"), "bin", F.lit(0).cast("long"))
    ranked = _beside(ranked, small(first), "bin")
    second = _cut(ranked.filter("p > 0 AND bin = cut_bin"), "bin2", F.first("below_bin"))
    ranked = _beside(ranked, small(second), "bin2")

    last = F.col("bin").eqNullSafe(F.col("cut_bin")) & F.col("bin2").eqNullSafe(F.col("cut_bin2")) & (F.col("p") > 0)
    sure = (F.col("p") > 0) & ((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("bin2") < F.col("cut_bin2"))))
    copies = F.col("whole") + F.when(sure, 1).otherwise(0)
    final = lambda df, copies: df.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = ranked.filter(last).withColumn("upto", F.col("below_bin2") + F.sum("size").over(order))
    fits = F.when(F.col("upto") - F.col("size") / 2 <= F.col("gap"), 1).otherwise(0)
    return final(ranked.filter(~F.coalesce(last, F.lit(False))), copies).unionByName(final(at_cut, F.col("whole") + fits))


def _cut(ranked: DataFrame, name: str, below: Column) -> DataFrame:
    """The bin of each source in which its words pass the gap, and the words below it."""
    bins = ranked.groupBy("source", name).agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), below.alias("base"))
    order = Window.partitionBy("source").orderBy(name)
    upto = F.col("base") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("gap"))
    return passed.groupBy(F.col("source").alias("of")).agg(F.min(name).alias(f"cut_{name}"), F.min_by(F.col("upto") - F.col("words"), name).alias(f"below_{name}"))


def _beside(ranked: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    """Joins the cut; a source without one (rounding) has it past its last bin."""
    out = ranked.join(cut, ranked["source"].eqNullSafe(cut["of"]), "left").drop("of")
    return out.withColumn(f"cut_{name}", F.coalesce(f"cut_{name}", F.lit(BINS + 1).cast("long"))).withColumn(f"below_{name}", F.coalesce(f"below_{name}", F.lit(0).cast("long")))
