"""Running statistics of a stream, per key: what stood before each record, or at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("length", "words", "lines", "duration")


def with_units(df: DataFrame) -> DataFrame:
    """Adds `duration`, in whole microseconds, so that every sum is of integers and comes out the same in any order."""
    return df.withColumn("duration", F.round(F.col("duration_ms") * 1000).cast("long"))


def square(c: str):
    """A square that neither overflows nor rounds: durations of half a minute, squared in microseconds, pass 2^63 after 10,000 records."""
    return F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(18,0)")


def sums() -> list:
    out = [F.count("*").alias("n")]
    for c in FIELDS:
        out += [F.sum(c).alias(f"s_{c}"), F.sum(square(c)).alias(f"q_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    return out


def frozen(df: DataFrame, keys: list[str]) -> DataFrame:
    """Final statistics of each key, joined to its rows: an aggregate with map-side sums."""
    rows = with_units(df)
    return rows.join(rows.groupBy(*keys).agg(*sums()), keys)


def prefix(df: DataFrame, keys: list[str], chunk: int = 65_536, order: str = "seq") -> DataFrame:
    """Statistics of the rows before each row of its key, in `order`.

    A scan in two steps: the stream of each key is cut into chunks by `order`, chunks are summed and these few sums added up, and within a chunk a window
    runs on from there. No task holds more than a chunk, even where all rows have one key.
    """
    rows = with_units(df).withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    of_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    names = ["n", *(f"{p}_{c}" for c in FIELDS for p in ("s", "q", "lo", "hi"))]
    fold = lambda name: F.min if name.startswith("lo_") else F.max if name.startswith("hi_") else F.sum
    totals = rows.groupBy(*keys, "_chunk").agg(*sums())
    before = totals.select(*keys, "_chunk", *(fold(name)(name).over(of_chunk).alias(f"_b_{name}") for name in names))
    local = {"n": F.count("*").over(inside)}
    for c in FIELDS:
        local |= {f"s_{c}": F.sum(c).over(inside), f"q_{c}": F.sum(square(c)).over(inside), f"lo_{c}": F.min(c).over(inside), f"hi_{c}": F.max(c).over(inside)}
    joined = rows.select("*", *(v.alias(f"_l_{k}") for k, v in local.items())).join(before, [*keys, "_chunk"])
    merged = {name: (F.least if name.startswith("lo_") else F.greatest)(F.col(f"_l_{name}"), F.col(f"_b_{name}")) if name[:3] in ("lo_", "hi_") else F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_b_{name}", F.lit(0)) for name in names}
    return joined.select(*rows.columns[:-1], *(v.alias(k) for k, v in merged.items()))
