"""Whether a stream could have taught a baseline, and whether a target began to refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Status codes that count as misses and as refusals.
MISSES = (400, 401, 403, 404, 405, 406, 410, 429, 500, 502, 503)
REFUSALS = (401, 403, 405, 406, 429, 503)


def status_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy("status").agg(F.count("*").alias("n"))


def shares(responses: DataFrame, surfaced) -> DataFrame:
    """total, miss_share, surfaced_share of a stream; `surfaced` is a condition."""
    return responses.agg(F.count("*").alias("total"), F.round(F.avg(F.col("status").isin(*MISSES).cast("double")), 6).alias("miss_share"), F.round(F.avg(surfaced.cast("double")), 6).alias("surfaced_share"))


def thin_keys(responses: DataFrame, least: int = 25) -> DataFrame:
    """keys, thin: how many keys there are and how many have fewer records than `least`."""
    return responses.groupBy("key").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") < least).alias("thin"))


def warnings(responses: DataFrame, surfaced) -> DataFrame:
    """The names of what is wrong, as an array: empty, thin, few misses, many surfaced, thin keys."""
    one = shares(responses, surfaced).crossJoin(thin_keys(responses))
    some = F.col("total") > 0
    found = (("empty", ~some), ("thin", some & (F.col("total") < 200)), ("few misses", some & (F.col("miss_share") < 0.10)), ("many surfaced", some & (F.col("surfaced_share") > 0.20)), ("thin keys", (F.col("thin") * 2 > F.col("keys"))))
    return one.select("total", F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in found))), ", ").alias("warnings"))


def block_watch(responses: DataFrame, first: int = 40, last: int = 25, jump: float = 0.5, keys: list[str] = ("key",)) -> DataFrame:
    """(key, seq) of the first record at which the refusals of the last records exceed those of the first by the jump."""
    refused = F.col("status").isin(*REFUSALS).cast("double")
    stream = Window.partitionBy(*keys).orderBy("seq")
    rows = responses.withColumn("_place", F.row_number().over(stream)).withColumn("_late", F.avg(refused).over(stream.rowsBetween(1 - last, 0))).withColumn("_early", F.avg(F.when(F.col("_place") <= first, refused)).over(Window.partitionBy(*keys)))
    return rows.filter((F.col("_place") >= first + last) & (F.col("_late") - F.col("_early") >= jump)).groupBy(*keys).agg(F.min("seq").alias("seq"))


def walls(responses: DataFrame, share: float = 0.9) -> DataFrame:
    """(key, refused, status): keys that refuse nearly everything, with their most frequent status (ties: the smaller)."""
    per = responses.groupBy("key", "status").agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.round(F.sum(F.when(F.col("status").isin(*REFUSALS), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("refused"), F.min_by("status", F.struct(-F.col("n"), "status")).alias("status")).filter(F.col("refused") >= share)
