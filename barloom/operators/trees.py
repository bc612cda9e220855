"""Fitted tree models as tables: one row per node, scored by joins down the levels.

The table is what MLlib stores of a forest or of boosted trees, laid flat, so a model
can be read, joined and checked in SQL anywhere. Nodes number trees x 2**(depth + 1) at
most, whatever the rows. Scoring gives every row one place per tree and moves all places
a level down per join; the places meet again in one partial sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, scratch_dir


def node_table(spark: SparkSession, model) -> DataFrame:
    """tree, weight, node, left, right, feature, threshold, prediction, stats, gain of a fitted MLlib ensemble.

    left is -1 in a leaf. A row goes left if its feature is at most the threshold. stats are the
    weights of the classes, or moments of the label. The splits must be of numbers.
    """
    path = scratch_dir(spark, "trees")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").select("treeID", F.col("weight").cast("double").alias("weight"))
    return cut(nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"), "weight", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "prediction",
        F.col("impurityStats").alias("stats"), "gain"), "nodes")


def leaves_of(df: DataFrame, nodes: DataFrame, cols: list[str], keys: list[str], depth: int) -> DataFrame:
    """keys, tree, weight, prediction, stats: the leaf that each row reaches in each tree."""
    trees = nodes.agg(F.array_sort(F.collect_set("tree")).alias("t")).scalar()
    at = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"), F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    step = nodes.select("tree", "node", "left", "right", "feature", "threshold")
    for _ in range(depth):
        here = at.join(step, ["tree", "node"])
        down = F.when(F.col("left") < 0, F.col("node")).when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = here.select(*keys, "_x", "tree", down.alias("node"))
    return at.join(nodes.select("tree", "node", "weight", "prediction", "stats"), ["tree", "node"]).select(*keys, "tree", "weight", "prediction", "stats")


def score_mean(df: DataFrame, nodes: DataFrame, cols: list[str], keys: list[str], depth: int) -> DataFrame:
    """Forest regression: the mean of the trees."""
    return leaves_of(df, nodes, cols, keys, depth).groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def score_sum(df: DataFrame, nodes: DataFrame, cols: list[str], keys: list[str], depth: int) -> DataFrame:
    """Boosting: the weighted sum of the trees."""
    return leaves_of(df, nodes, cols, keys, depth).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("prediction")).alias("prediction"))


def score_share(df: DataFrame, nodes: DataFrame, cols: list[str], keys: list[str], depth: int) -> DataFrame:
    """Forest of two classes: the mean share of class 1 in the leaves."""
    share = F.get("stats", F.lit(1)) / (F.get("stats", F.lit(0)) + F.get("stats", F.lit(1)))
    return leaves_of(df, nodes, cols, keys, depth).groupBy(*keys).agg(F.avg(share).alias("confidence"))


def importances(nodes: DataFrame, cols: list[str], classes: bool = False) -> DataFrame:
    """feature, importance: gain x weight of the rows split, shares of each tree, then of all trees."""
    rows = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x) if classes else F.get("stats", F.lit(0))
    inner = nodes.where(F.col("left") >= 0).groupBy("tree", "feature").agg(F.sum(F.col("gain") * rows).alias("g"))
    total = inner.groupBy("tree").agg(F.sum("g").alias("total")).where("total > 0")
    share = inner.join(total, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("s"))
    all_ = share.agg(F.sum("s")).scalar()
    names = F.array(*[F.lit(c) for c in cols])
    return share.select(F.get(names, F.col("feature")).alias("feature"), (F.col("s") / all_).alias("importance"))
