"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Size: words of a text. Sources take part in order of their names, null last, with the given weights in turn. Targets share the whole of all sizes
by weight and stop at `most` times their source's size; the excess is shared again by weight until none is above. That fixed
point is found at once: in order of (limit / weight), sources stand at their limit up to the first that doesn't reach it.

Words are dealt out in blocks of equal size. Each source's blocks come by highest quotients target / (2 seats + 1). Only quotients that can be in
doubt are made: the number of sources bounds how far any seats can be from the proportional share. Then each source's blocks go to its shards
in the same way, by the shards' sizes. A shard is a few thousand documents by hash, so no source, however large, is one group.

Selection: the documents of a shard stand in a seeded order and form one stream of words, cut into blocks. With q blocks to take
of n, block b is taken floor((b + 1 + u) q / n) - floor((b + u) q / n) times, u seeded: each as often as any other or once
more, q in all. The sum up to any word has a closed form, so a document's words are a difference of two such sums: no block becomes a row, nothing is joined to blocks.
The last block of a shard may be short.

Null text has size 0. Rows with a null id, and repeated rows, take part as documents of their own; rows equal in id and size share their sum evenly in order of the stream.
Empty input gives no rows. A source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merganser.llm.shared import WORD, matched, staged

#: Words of a block, unless the smallest source is below 8 blocks.
BLOCK = 16
#: Documents of a shard, about.
SHARD = 4096
#: A document's words are taken at most so many times.
MOST = 3


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2^32 that follows from the seed and the values: the first digits of an MD5, which all engines agree on."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], most: int = MOST) -> DataFrame:
    """Adds `weight` and `target` to a table of sources (source, source_size). It has a row for each source, and is the only thing gathered in one task."""
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    level = F.min(F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.struct("place", "share"))).over(every)
    rows = rows.withColumn("share", share).withColumn("place", F.row_number().over(by_limit)).withColumn("level", level)
    return rows.withColumn("target", F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap").cast("double")).otherwise(F.col("level.share") * F.col("weight"))).select("source", "source_size", "weight", "target")


def sainte_lague(parties: DataFrame, seats: str, votes: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds `quota`: the seats of each party, out of the number in column `seats`, by highest quotients votes / (2 k + 1); ties go to the smaller name.

    Seats are votes / divisor, rounded, so all quotas add up to between n / 2 fewer and more than total / divisor, for n parties:
    a party's quota is sure up to the share of (seats - n / 2), and can't pass that of (seats + n / 2).
    """
    group = Window.partitionBy(*within)
    rows = parties.withColumn("_n", F.count("*").over(group)).withColumn("_total", F.sum(votes).over(group))
    part = F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_sure", F.greatest(F.floor(part * (F.col(seats) - F.col("_n") / 2) - 1), F.lit(0)).cast("long")).withColumn("_most", F.when(part > 0, F.ceil(part * (F.col(seats) + F.col("_n") / 2) + 1).cast("long")).otherwise(F.lit(0)))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    keys = [*within, name]
    doubt = rows.filter("_most > _sure").select(*keys, "_left", F.col(votes).cast("double").alias("_votes"), F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    order = Window.partitionBy(*within).orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") + 1)), F.col(name).isNull(), F.col(name))
    won = doubt.withColumn("_place", F.row_number().over(order)).filter("_place <= _left").groupBy(*keys).agg(F.count("*").alias("_won"))
    return matched(rows, won, keys, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def taken_up_to(at: Column, block: Column, n: Column, q: Column, u: Column) -> Column:
    """Words taken among the first `at` words of a shard's stream."""
    b = F.floor(at / block)
    blocks = F.floor((b + u) * q / n) - F.floor(u * q / n)
    again = F.floor((b + 1 + u) * q / n) - F.floor((b + u) * q / n)
    return blocks * block + (at - b * block) * again


def mix(df: DataFrame, weights: Sequence[int] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 42) -> DataFrame:
    """One row for each row: the id, source, size, source_size, target (the source's, in words) and taken (words the mix takes of this document, repeats counted)."""
    sizes = staged(df.select(df[id_col].alias("_id"), df[source_col].alias("source"), F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / shard).alias("shards"))
    shards_of = sources.select("source", "shards")
    mixed = targets(sources.select("source", "source_size"), weights, most)
    every = Window.partitionBy()
    mixed = mixed.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every) / 8))), F.lit(1)).cast("long"))
    mixed = mixed.withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    quotas = sainte_lague(mixed, "seats", "target", "source").withColumnRenamed("quota", "source_quota")
    known = staged(matched(quotas, shards_of, ["source"]))

    in_shard = F.pmod(seeded(seed, F.col("_id")), F.col("shards"))
    shards = known.select("source", "shards")
    rows = matched(sizes, F.broadcast(shards) if known.count() <= 10_000 else shards, ["source"]).withColumn("shard", in_shard).drop("shards")
    by_shard = matched(rows.groupBy("source", "shard").agg(F.sum("size").alias("words")), known.select("source", "source_quota", "block"), ["source"])
    dealt = sainte_lague(by_shard, "source_quota", "words", "shard", ["source"]).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block")))).withColumn("q", F.least("quota", F.lit(most) * F.col("n")))

    stream = Window.partitionBy("source", "shard").orderBy(seeded(seed + 1, F.col("_id")), F.col("_id"), F.col("size"))
    ends = rows.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    full = matched(ends, dealt.select("source", "shard", "n", "q", "block"), ["source", "shard"])
    u = F.pmod(seeded(seed + 2, F.col("source"), F.col("shard")), F.col("n"))
    args = F.col("block"), F.col("n"), F.col("q"), u
    words = taken_up_to(F.col("end"), *args) - taken_up_to(F.col("end") - F.col("size"), *args)
    out = full.select("_id", "source", "size", words.cast("long").alias("taken"))
    return matched(out, known.select("source", "source_size", "target"), ["source"]).select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken")


def repeated_rows(df: DataFrame, weights: Sequence[int] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = 42) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it: taken / size, rounded up or down by a draw that follows from seed and id. Documents without words stay once."""
    mixed = mix(df, weights, id_col, text_col, source_col, most, seed=seed)
    share = F.col("taken") / F.col("size")
    draw = seeded(seed + 3, F.col(id_col)) / F.lit(float(1 << 32))
    times = F.when(F.col("size") > 0, F.floor(share) + (draw < share - F.floor(share)).cast("int")).otherwise(F.lit(1)).cast("int")
    per_id = mixed.groupBy(F.col(id_col)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).select(id_col, times.alias("_times"))
    rows = matched(df, per_id.filter("_times > 0"), [id_col])
    return rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)
