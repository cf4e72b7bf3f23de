"""Exact nearest neighbours in a plane, by buckets that widen until the neighbours are proven."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysieve.operators.scratch import keep


def nearest(nodes: DataFrame, points: DataFrame, k: int, *, side: float | None = None, others: bool = False) -> DataFrame:
    """(node, id, d, rn): the k nearest points of each node, ties by id; all points where there are fewer.

    ``nodes``: node, x, y. ``points``: id, x, y. Rows meet by square buckets of
    ``side`` (by default about k points a bucket): a node sees the nine around it,
    and its k nearest are proven once the k-th is no farther than the side.
    Nodes not proven go on with buckets of twice the side, until one round's
    buckets span all, so sparse regions cost a few nodes a few wide buckets.
    With ``others`` a point with the node's own key is no neighbour.
    """
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    around = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    kind = nodes.schema["node"].dataType.simpleString()
    if not box["n"] or around["x0"] is None:
        return nodes.sparkSession.createDataFrame([], f"node {kind}, id {points.schema['id'].dataType.simpleString()}, d double, rn int")
    low, high = (f(box[c], around[c]) for f, c in ((min, "x0"), (max, "x1")))
    bottom, top = (f(box[c], around[c]) for f, c in ((min, "y0"), (max, "y1")))
    span = max(high - low, top - bottom, 1e-9) * (1 + 1e-9)
    area = max(box["x1"] - box["x0"], 1e-9 * span) * max(box["y1"] - box["y0"], 1e-9 * span)
    side = min(span, side or max(math.sqrt(area * (k + 1) / box["n"]), 1e-6 * span))
    left, done = nodes, None
    while True:
        last = side >= span
        near = _round(left, points, k, side, low, bottom, others)
        if last:
            return near if done is None else done.unionByName(near)
        near = keep(near, "near")
        proven = near.groupBy("node").agg(F.max("rn").alias("c"), F.max("d").alias("far")).filter((F.col("c") >= k) & (F.col("far") <= side)).select("node")
        good = near.join(proven, "node", "left_semi")
        done = good if done is None else done.unionByName(good)
        left = keep(left.join(proven, "node", "left_anti"), "left")
        if left.isEmpty():
            return done
        side *= 2


def _round(nodes: DataFrame, points: DataFrame, k: int, side: float, low: float, bottom: float, others: bool) -> DataFrame:
    bx, by = F.floor((F.col("x") - low) / side), F.floor((F.col("y") - bottom) / side)
    around = F.explode(F.array(*(F.struct((bx + a).alias("bx"), (by + b).alias("by")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    # The nodes are sent to nine buckets; points, often more, stay in their own.
    asked = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), around.alias("b")).select("node", "nx", "ny", "b.bx", "b.by")
    met = asked.join(points.select("id", "x", "y", bx.alias("bx"), by.alias("by")), ["bx", "by"])
    if others:
        met = met.filter("node <> id")
    d = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "id"))
    return met.select("node", "id", d.alias("d")).withColumn("rn", rank).filter(F.col("rn") <= k)
