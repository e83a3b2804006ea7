"""Gates, bands and cut-offs over scores (key, seq, novelty)."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from merganser.functions.expressions import BANDS
from merganser.sources.staging import staged

#: Rows of a gate over all rows that one task takes.
CHUNK = 65_536


def banded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("band", F.expr(BANDS))


def rolling(scores: DataFrame, percentile: float = 0.995, window: int = 1000, least: int = 200, keys: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Adds `cutoff` and `shown`: the percentile of the last `window` scores, this one included, once there are `least`.

    The window is by count, so rows are chained in order. `keys` make independent gates, each of them in one task; a gate over all rows is cut into chunks.
    """
    if keys:
        last = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1 - window, 0)
        rows = scores.withColumn("cutoff", F.when(F.count("*").over(last) >= least, F.percentile("novelty", F.lit(percentile)).over(last)))
    else:
        rows = in_chunks(scores, percentile, window, least, chunk)
    rows = rows.withColumn("cutoff", F.round("cutoff", 10))
    return rows.withColumn("shown", F.coalesce((F.col("novelty") >= F.col("cutoff")) & (F.col("novelty") > 0), F.lit(False)))


def numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """Adds `_place`, from 0 in order of seq: rows are counted by chunk of seq, and the few counts added up."""
    cut = rows.withColumn("_chunk", F.floor(F.col("seq") / chunk))
    counts = cut.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_chunk").alias("_of"), (F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).alias("_before"))
    local = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_chunk").orderBy("seq")) - 1)
    return local.join(before, F.col("_chunk").eqNullSafe(F.col("_of"))).withColumn("_place", F.col("_at") + F.col("_before")).select(*rows.columns, "_place")


def in_chunks(scores: DataFrame, percentile: float, window: int, least: int, chunk: int) -> DataFrame:
    """Adds `cutoff`. A task takes `chunk` rows and, once more, the `window` - 1 before them; it holds the window as a sorted list, with one score in and one out a row."""
    part = lambda place: F.floor(place / chunk).cast("long")
    rows = numbered(staged(scores), chunk)
    dealt = rows.withColumn("_part", F.explode(F.sequence(part(F.col("_place")), part(F.col("_place") + window - 1))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        first = table["_part"][0].as_py() * chunk
        places, x = table["_place"].to_pylist(), table["novelty"].to_pylist()
        held, out = [], []
        for i, (place, v) in enumerate(zip(places, x)):
            if i >= window and x[i - window] is not None:
                del held[bisect_left(held, x[i - window])]
            if v is not None:
                insort(held, v)
            if place >= first:
                at = (len(held) - 1) * percentile
                lo, up = math.floor(at), math.ceil(at)
                enough = held and min(place + 1, window) >= least
                out.append((held[lo] if lo == up else (up - at) * held[lo] + (at - lo) * held[up]) if enough else None)
        own = table.slice(len(x) - len(out)).drop_columns(["_place", "_part"])
        return own.append_column("cutoff", pa.array(out, pa.float64()))

    return dealt.groupBy("_part").applyInArrow(run, StructType([*scores.schema, StructField("cutoff", DoubleType())]))


def warmed(scores: DataFrame, warm_up: int = 50) -> DataFrame:
    """Without the first records of the stream and those of keys that aren't settled, which the gate never sees."""
    return scores.filter((F.col("seq") >= warm_up) & F.col("settled"))


def offline_cutoff(scores: DataFrame, percentile: float = 0.995) -> DataFrame:
    """Rows at or above the percentile of the whole run, a scalar that is joined to them."""
    cutoff = scores.agg(F.round(F.coalesce(F.percentile("novelty", F.lit(percentile)), F.lit(0.0)), 10).alias("cutoff"))
    return scores.join(F.broadcast(cutoff), F.col("novelty") >= F.col("cutoff"))


def budget(scores: DataFrame, top: int = 25) -> DataFrame:
    """The first rows of the ranking: a sort of `top` rows a task."""
    return scores.orderBy(F.desc("settled"), F.desc("novelty"), "seq").limit(top)


def footer(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("total"), F.count_if("shown").alias("shown"), F.count_if(~F.col("settled")).alias("suppressed"))
