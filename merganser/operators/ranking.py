"""Rankings: live, offline with leave-one-out, with a fallback key, and against a stored baseline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.functions.expressions import key
from merganser.operators import novelty, stats, tags

#: Cells of the engine, and of a small form whose tags SQL can check.
CELLS, SMALL = 8192, 256
SPARSITY, FAN_IN, SETTLED = 0.05, 6, 25


def keyed(responses: DataFrame, how: str) -> DataFrame:
    return responses.withColumn("key", F.expr(key(how)))


def wiring(cells: int = CELLS, version: str = "v3-response", seed: int = 0) -> np.ndarray:
    from merganser.functions.expressions import channel_set

    return tags.random_wiring(len(channel_set(version)), cells, FAN_IN, seed)


def tagged(rows: DataFrame, first_pass: bool, cells: int = CELLS, version: str = "v3-response") -> DataFrame:
    """(key, seq, cells, activations): tags under the statistics before each record, or (second pass) under the final ones."""
    known = stats.prefix(rows, ["key"]) if first_pass else stats.frozen(rows, ["key"])
    return tags.tag(tags.encode(known, version), wiring(cells, version), tags.active(cells, SPARSITY), ["key", "seq"])


def vectors(rows: DataFrame, second: bool, version: str = "v3-response") -> DataFrame:
    """(key, seq, before, n, q) and, for a second pass, q2: vectors under the statistics before each record and under the final ones."""
    first = tags.encode(stats.prefix(rows, ["key"]), version).withColumnsRenamed({"q": "q1", "n": "before"})
    final = stats.with_units(rows).groupBy("key").agg(*stats.sums())
    both = first.select(*(c for c in stats.with_units(rows).columns), "before", "q1").join(final, "key")
    if second:
        both = tags.encode(both, version).withColumnRenamed("q", "q2")
    return both.withColumnRenamed("q1", "q").select("key", "seq", "before", "n", "q", *(["q2"] if second else []))


def live(responses: DataFrame, how: str = "host", cells: int = CELLS) -> DataFrame:
    """(key, seq, novelty): one pass, each record scored before it is learned."""
    return novelty.score_stream(vectors(keyed(responses, how), False), wiring(cells), tags.active(cells, SPARSITY))


def offline(responses: DataFrame, how: str = "host", cells: int = CELLS) -> DataFrame:
    """(key, seq, novelty): two passes; the second scores against all others of the key."""
    return novelty.score_stream(vectors(keyed(responses, how), True), wiring(cells), tags.active(cells, SPARSITY), "offline")


def with_fallback(responses: DataFrame, fine: str = "shape", coarse: str = "host", settled: int = SETTLED, cells: int = CELLS) -> DataFrame:
    """(seq, key, novelty, settled): scored by the fine key if it has enough records, by the coarse one otherwise; each learns through an encoder of its own."""
    f, c = offline(responses, fine, cells), offline(responses, coarse, cells)
    counts = keyed(responses, fine).groupBy("key").agg(F.count("*").alias("n"))
    coarse_counts = keyed(responses, coarse).groupBy("key").agg(F.count("*").alias("n_coarse"))
    c = c.join(coarse_counts, "key").select("seq", F.col("key").alias("coarse_key"), F.col("novelty").alias("coarse_novelty"), "n_coarse")
    return chosen(f.join(counts, "key"), c, settled)


def live_with_fallback(responses: DataFrame, fine: str = "shape", coarse: str = "host", settled: int = SETTLED, cells: int = CELLS) -> DataFrame:
    """The same in one pass: a record is scored by the fine key once that has enough records, this one included."""
    parts = []
    for how in (fine, coarse):
        known = vectors(keyed(responses, how), False)
        scores = novelty.score_stream(known, wiring(cells), tags.active(cells, SPARSITY))
        parts.append(scores.join(known.select("key", "seq", (F.col("before") + 1).alias("n")), ["key", "seq"]))
    c = parts[1].select("seq", F.col("key").alias("coarse_key"), F.col("novelty").alias("coarse_novelty"), F.col("n").alias("n_coarse"))
    return chosen(parts[0], c, settled)


def chosen(f: DataFrame, c: DataFrame, settled: int) -> DataFrame:
    enough = F.col("n") >= settled
    key_, score = (F.when(enough, F.col(x)).otherwise(F.col(f"coarse_{x}")).alias(x) for x in ("key", "novelty"))
    return f.join(c, "seq").select("seq", key_, score, (enough | (F.col("n_coarse") >= settled)).alias("settled"))


def ranked(scores: DataFrame, settled: int = SETTLED) -> DataFrame:
    """Adds `settled`, by records of the key."""
    counts = scores.groupBy("key").agg((F.count("*") >= settled).alias("settled"))
    return scores.join(counts, "key")


def order(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("settled"), F.desc("novelty"), "seq")


def watch(old: DataFrame, new: DataFrame, how: str = "host", threshold: float = 0.5, cells: int = CELLS) -> DataFrame:
    """(key, seq, novelty) of new records at or above the threshold, against what `old` taught; the new stream isn't learned."""
    state = novelty.totals(tagged(keyed(old, how), True, cells))
    return novelty.against(state, tagged(keyed(new, how), True, cells)).filter(F.col("novelty") >= threshold)
