"""Measures of rankings, from ranks. Ties share the mean of their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_ranks(rows: DataFrame, column: str, name: str = "r") -> DataFrame:
    """Adds the rank of each value from 1, ties averaged: values are counted first, so what is sorted is a row for each different value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(Window.orderBy(column))
    return rows.join(counts.select(column, (up_to - F.col("_c") + (F.col("_c") + 1) / 2).alias(name)), column)


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """n_pos, n_neg, auc and u (Mann-Whitney) of label 1 against 0; null if one is missing."""
    r = mean_ranks(rows, score)
    a = r.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"), F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"))
    u = F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return a.select("n_pos", "n_neg", F.round(u / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)), 6).alias("auc"), F.round(u, 1).alias("u"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rho: the correlation of ranks, from exact sums of doubled ranks; their products are summed as decimals, as a few million rows pass 2^63."""
    r = mean_ranks(mean_ranks(rows, a, "ra"), b, "rb").select((2 * F.col("ra")).cast("long").alias("x"), (2 * F.col("rb")).cast("long").alias("y"))
    product = lambda p, q: F.col(p).cast("decimal(19,0)") * F.col(q).cast("decimal(18,0)")
    s = r.agg(F.count("*").cast("double").alias("n"), *(F.sum(F.col(k).cast("decimal(19,0)")).cast("double").alias(k) for k in "xy"), *(F.sum(product(*k)).cast("double").alias(k) for k in ("xx", "yy", "xy")))
    return s.select(F.round(F.expr("(n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y))"), 6).alias("rho"))


def placed(rows: DataFrame, score: str = "score", tie: str = "id") -> DataFrame:
    """Adds `place` from 1: highest score first, ties by id."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def ranking_metrics(places: DataFrame, budgets: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """hits, first, worst, and recall and precision at each budget, of rows with `place` and `hit`."""
    hit = F.col("hit") == 1
    return places.agg(
        F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("place"))).alias("first"), F.max(F.when(hit, F.col("place"))).alias("worst"),
        *(F.round(F.count_if(hit & (F.col("place") <= b)) / F.count_if(hit), 6).alias(f"recall_{b}") for b in budgets), *(F.round(F.count_if(hit & (F.col("place") <= b)) / b, 6).alias(f"precision_{b}") for b in budgets),
    )


def filter_metrics(rows: DataFrame, kept) -> DataFrame:
    """reviewed, recall, precision and reviewed-to-first of a filter, in stream order (column `place`)."""
    hit, k = F.col("hit") == 1, kept
    first = F.min(F.when(hit & k, F.col("place")))
    return rows.agg(F.count_if(k).alias("reviewed"), F.round(F.count_if(hit & k) / F.count_if(hit), 6).alias("recall"), F.round(F.count_if(hit & k) / F.count_if(k), 6).alias("precision"), first.alias("first_hit"))


def modal(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The most frequent value of each column by key (ties: the smallest)."""
    out = None
    for c in columns:
        m = rows.groupBy(*keys, c).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(f"modal_{c}"))
        out = m if out is None else out.join(m, keys)
    return out


def nearest(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, place) of the k nearest points, the query's own left out. `queries` is a stated set; distances are exact in millionths squared."""
    diff = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = points.join(F.broadcast(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))), F.col("id") != F.col("query_id")).select("query_id", "id", diff.alias("distance"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("place") <= k)


def variance_share(vectors: DataFrame) -> DataFrame:
    """(channel, share): each channel's part of the summed population variances, from exact sums over vectors `q`."""
    each = vectors.select(F.posexplode("q").alias("channel", "x")).groupBy("channel").agg(F.count("*").cast("double").alias("n"), F.sum("x").cast("double").alias("s"), F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).cast("double").alias("ss"))
    v = each.select("channel", F.expr("(n * ss - s * s) / (n * n)").alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("all")))).select("channel", F.round(F.col("v") / F.col("all"), 5).alias("share"))


def joint_null(results: DataFrame) -> DataFrame:
    """seeds, matches, p = (k + 1) / (n + 1): seeds whose every surface (column `ok`) matches."""
    per = results.groupBy("seed").agg(F.bool_and("ok").alias("ok"))
    return per.agg(F.count("*").alias("seeds"), F.count_if("ok").alias("matches")).withColumn("p", F.round((F.col("matches") + 1) / (F.col("seeds") + 1), 6))
