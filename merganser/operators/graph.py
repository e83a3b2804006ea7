"""Extraction from an edge table (pre, post, weight): adjacency, populations, projections of groups, fan-in, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges_between(edges: DataFrame, pre: DataFrame, post: DataFrame) -> DataFrame:
    """Edges with both ends among the ids (column `id`): two semi-joins, which may become runtime filters of the scan."""
    return edges.join(pre.select(F.col("id").alias("pre")), "pre", "left_semi").join(post.select(F.col("id").alias("post")), "post", "left_semi")


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))


def dense_index(ids: DataFrame) -> DataFrame:
    """(id, place): sorted ids numbered from 0. Ids are ranged and counted by range first, so no task ranks all of them."""
    ranged = ids.select("id").distinct().repartitionByRange("id").withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1).join(before, "_part").select("id", (F.col("_at") + F.col("_before")).cast("long").alias("place"))


def adjacency(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, col, weight) over dense indexes of the ids; edges that leave the set go, parallel edges are summed."""
    index = ids.select("id").distinct().select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("place"))
    a, b = index.select(F.col("id").alias("pre"), F.col("place").alias("row")), index.select(F.col("id").alias("post"), F.col("place").alias("col"))
    return summed(edges).join(a, "pre").join(b, "post").select("row", "col", "weight")


def group_projection(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, post, weight): weights from all members of a group (columns id, group) into each cell."""
    return edges.join(groups.select(F.col("id").alias("pre"), "group"), "pre").groupBy("group", "post").agg(F.sum("weight").alias("weight"))


def fan_in_stats(projection: DataFrame) -> DataFrame:
    """Different groups by connected cell: cells, mean, median, population deviation, smallest, largest."""
    per = projection.groupBy("post").agg(F.countDistinct("group").alias("d"))
    return per.agg(F.count("*").alias("cells"), F.round(F.avg("d"), 6).alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.round(F.stddev_pop("d"), 6).alias("std"), F.min("d").alias("least"), F.max("d").alias("most"))


def centroids(points: DataFrame, scale: float = 0.008) -> DataFrame:
    """(post, x, y): means of each cell's points, less the mean of all, scaled."""
    per = points.groupBy("post").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    whole = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return per.crossJoin(F.broadcast(whole)).select("post", F.round((F.col("x") - F.col("mx")) * scale, 4).alias("x"), F.round((F.col("y") - F.col("my")) * scale, 4).alias("y"))


def near_misses(annotations: DataFrame, pattern: str) -> DataFrame:
    """Types (column `type`) that match a pattern without being in the resolved population (column `resolved`)."""
    found = annotations.filter(F.col("type").rlike(pattern)).select("type").distinct()
    return found.join(annotations.filter("resolved").select("type").distinct(), "type", "left_anti")
