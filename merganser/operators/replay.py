"""Frames of a run for replay: what a viewer shows of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_line(rows: DataFrame) -> DataFrame:
    """(seq, line) in fixed width."""
    return rows.select("seq", F.format_string("%6d %3d %8d %s", F.col("seq"), F.col("status"), F.col("length"), F.col("url")).alias("line"))


def thinned(frames: DataFrame, stride: int = 10) -> DataFrame:
    return frames.filter((F.col("seq") % stride == 0) | F.col("shown"))


def paged(frames: DataFrame, since: int, size: int = 400) -> DataFrame:
    return frames.filter((F.col("seq") >= since) & (F.col("seq") < since + size))


def quantised(totals: DataFrame, cells: int) -> DataFrame:
    """(key, weights): a byte for each cell, round(weight * 255), in base64; untouched cells are full."""
    per = totals.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.round(F.col("weight") * 255).cast("int").alias("w")))).alias("m"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(255))), 2, "0"))
    return per.select("key", F.regexp_replace(F.base64(F.unhex(F.array_join(bytes_, ""))), "[\r\n]", "").alias("weights"))


def payload(frames: DataFrame) -> DataFrame:
    """(seq, frame): each frame as JSON."""
    return frames.select("seq", F.to_json(F.struct(*frames.columns)).alias("frame"))
