"""The novelty filter: cells lose weight whenever a tag uses them; a tag is as novel as the weight its cells have left.

A tag is valued: it holds the activation of each winning cell, negative ones as none. Scoring weighs cells by these values, sum(v * w) / sum(v * rest); learning takes
rate * v / max(v) of a cell's weight. A tag without a positive value scores 0 and teaches nothing.

Without decay the filter is a commutative fold: weight = rest * product of (1 - rate * strength) over touches. So the state is a sum of logarithms per
key and cell, kept in whole units of 1e-12 so that it comes out the same in any order: learning is a group-by with map-side sums, live scoring a running sum, leaving one out a
subtraction.

Functions that take tags (key, seq, cells, activations) work on a row for each cell, which any engine can check. `score_stream` is the same as a kernel: it takes
vectors and never makes a row of a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merganser.operators.tags import winners

RATE = 0.4
#: Units of a logarithm, and how near a half its fraction must be for the last bits to matter (a bit is 6e-5 of a unit).
UNIT, NEAR = 1e12, 1e-3
#: Records of a key that one task folds.
CHUNK = 4096


def units(left: np.ndarray) -> np.ndarray:
    """The logarithms of what touches leave of weights, in whole units; halves go away from zero.

    Libraries differ in the last bit of a logarithm, which moves a unit where the fraction is near a half: there the logarithm is the C library's, as it is in SQL engines.
    """
    x = np.log(left) * UNIT
    near = np.abs(np.abs(x - np.trunc(x)) - 0.5) < NEAR
    x[near] = np.fromiter(map(math.log, left[near].tolist()), np.float64) * UNIT
    whole = np.trunc(x)
    return (whole - (np.abs(x - whole) >= 0.5)).astype(np.int64)


def touches(tags: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each cell a tag drives: (key, seq, cell, v, log)."""
    kinds = dict(tags.dtypes)

    def run(batches):
        for batch in batches:
            cells, act = batch.column("cells"), batch.column("activations")
            v = act.flatten().to_numpy(zero_copy_only=False)
            row = act.value_parent_indices().to_numpy()
            most = np.zeros(len(batch), np.int64)
            np.maximum.at(most, row, v)
            on = v > 0
            at, v = row[on], v[on]
            log = units(1 - rate * v / most[at])
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(place), batch.column("seq").take(place), cells.flatten().filter(pa.array(on)), pa.array(v), pa.array(log)], names=["key", "seq", "cell", "v", "log"])

    return tags.select("key", "seq", "cells", "activations").mapInArrow(run, f"key {kinds['key']}, seq {kinds['seq']}, cell int, v long, log long")


def weight(log: Column) -> Column:
    return F.exp(F.least(F.coalesce(log, F.lit(0)), F.lit(0)) / UNIT)


def held(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)


def scores(rows: DataFrame, tags: DataFrame, rest: Column | None = None) -> DataFrame:
    """(key, seq, novelty) from rows (key, seq, v, w); tags that drive no cell have 0."""
    rest = F.lit(1.0) if rest is None else rest
    found = rows.groupBy("key", "seq").agg(held(F.sum(F.col("v") * F.col("w") * rest) / F.sum(F.col("v") * rest)).alias("novelty"))
    empty = tags.filter(F.coalesce(F.array_max("activations"), F.lit(0)) <= 0).select("key", "seq", F.lit(0.0).alias("novelty"))
    return found.unionByName(empty)


def live(tags: DataFrame, rate: float = RATE, rest: Column | None = None, read: Column | None = None) -> DataFrame:
    """(key, seq, novelty): each record against those before it. `rest` gives cells weights of their own, `read` limits the cells that are read."""
    before = Window.partitionBy("key", "cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = touches(tags, rate).withColumn("w", weight(F.sum("log").over(before)))
    return scores(rows if read is None else rows.filter(read), tags, rest)


def totals(tags: DataFrame, rate: float = RATE) -> DataFrame:
    """(key, cell, touches, log, weight) after the whole stream."""
    return touches(tags, rate).groupBy("key", "cell").agg(F.count("*").alias("touches"), F.sum("log").alias("log")).withColumn("weight", weight(F.col("log")))


def leave_one_out(learned: DataFrame, scored: DataFrame, rate: float = RATE) -> DataFrame:
    """(key, seq, novelty): tags of the second pass against all that the first pass learned, their own touch taken out; weights never pass rest."""
    state = totals(learned, rate).select("key", "cell", F.col("log").alias("all"))
    rows = touches(scored, rate).join(state, ["key", "cell"], "left")
    return scores(rows.withColumn("w", weight(F.col("all") - F.col("log"))), scored)


def against(state: DataFrame, scored: DataFrame, rate: float = RATE) -> DataFrame:
    """(key, seq, novelty): tags against a stored state that doesn't learn; cells it lacks are at rest."""
    rows = touches(scored, rate).drop("log").join(state.select("key", "cell", "log"), ["key", "cell"], "left")
    return scores(rows.withColumn("w", weight(F.col("log"))), scored)


def saturation(tags: DataFrame, cells: int, rate: float = RATE) -> DataFrame:
    """(key, saturation): the share of all weight that is gone; untouched cells count as full."""
    return totals(tags, rate).groupBy("key").agg(F.round(F.sum(1 - F.col("weight")) / cells, 6).alias("saturation"))


def decayed(tags: DataFrame, half_life: float, mode: str = "halflife", rate: float = RATE) -> DataFrame:
    """(key, seq, novelty) with recovery by records of the key.

    Between touches a cell's deficit shrinks by 2^-g(gap): g = gap / h in `halflife` mode; in `compounding` mode every record in between shrinks it again from its
    last touch, g = gap (gap + 1) / 2h. A cell's course is one fold over its own touches in order.
    """
    if mode not in ("halflife", "compounding"):
        raise ValueError(f"unknown mode {mode!r}")
    place = Window.partitionBy("key").orderBy("seq")
    rows = touches(tags, rate).join(tags.select("key", "seq", F.row_number().over(place).alias("tick")), ["key", "seq"]).withColumn("kept", F.exp(F.col("log") / UNIT))

    def courses(batches):
        """Rows come in order of key, cell and tick: one cell's course after the other, of which only the last weight and tick are held."""
        at, w, last = None, 1.0, 0
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, (key, cell, tick, kept) in enumerate(zip(pdf["key"].tolist(), pdf["cell"].tolist(), pdf["tick"].tolist(), pdf["kept"].tolist())):
                if at != (key, cell):
                    at, w, last = (key, cell), 1.0, 0
                gap = tick - last
                g = gap / half_life if mode == "halflife" else gap * (gap + 1) / (2 * half_life)
                out[i] = w = 1 - (1 - w) * 2.0**-g
                w, last = w * kept, tick
            yield pdf[["key", "seq", "v"]].assign(w=out)

    kinds = dict(rows.dtypes)
    ordered = rows.select("key", "seq", "cell", "tick", "v", "kept").repartition("key", "cell").sortWithinPartitions("key", "cell", "tick")
    return scores(ordered.mapInPandas(courses, f"key {kinds['key']}, seq {kinds['seq']}, v long, w double"), tags)


def wall_clock(tags: DataFrame, half_life: float, rate: float = RATE) -> DataFrame:
    """(key, seq, novelty) with recovery by time: tags have `at`, in seconds, and half_life is in seconds.

    As each record rewrites every weight as it has recovered by then, while only touched cells get a new time, the course of a cell depends on the time of every record of
    its key; so a key is folded in order by one task, in batches, with a state of two numbers a cell.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        cells = max((max(c, default=-1) for c in pdf["cells"]), default=-1) + 1
        w, seen, out = np.ones(cells), np.zeros(cells), []
        for won, act, at in zip(pdf["cells"], pdf["activations"], pdf["at"]):
            now = 1 - (1 - w) * 2.0 ** (-np.maximum(at - seen, 0) / half_life)
            won, act = np.asarray(won, np.int64), np.asarray(act, np.float64)
            won, v = won[act > 0], act[act > 0]
            out.append(float(np.clip((v * now[won]).sum() / v.sum(), 0, 1)) if len(v) else 0.0)
            if len(v):
                w = now
                w[won] *= 1 - rate * v / v.max()
                seen[won] = at
        return pdf[["key", "seq"]].assign(novelty=np.round(out, 6))

    kinds = dict(tags.dtypes)
    return tags.select("key", "seq", "cells", "activations", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandas(run, f"key {kinds['key']}, seq {kinds['seq']}, novelty double")


# --- the kernel -----------------------------------------------------------------------------


def driven(q: np.ndarray, wiring: np.ndarray, k: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, values and logarithms of the tags of vectors, a row each; cells that aren't driven have value and logarithm 0."""
    cells, act = winners(q, wiring, k)
    v = np.maximum(act, 0).astype(np.float64)
    log = units(1 - rate * v / np.maximum(v.max(axis=1, keepdims=True), 1))
    return cells, v, log


def score_rows(v: np.ndarray, log: np.ndarray) -> np.ndarray:
    total = v.sum(axis=-1)
    got = (v * np.exp(np.minimum(log, 0) / UNIT)).sum(axis=-1) / np.where(total > 0, total, 1)
    return np.round(np.where(total > 0, np.clip(got, 0, 1), 0.0), 6)


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def score_stream(rows: DataFrame, wiring: np.ndarray, k: int, how: str = "live", rate: float = RATE, chunk: int = CHUNK, some: int = 256) -> DataFrame:
    """(key, seq, novelty) of vectors, without a row of a cell for keys of one chunk.

    `rows` is (key, seq, before, n, q) or, leaving one out, (key, seq, before, n, q, q2): `before` counts the key's records before each, n all of them; q is the vector that teaches, q2 the one that is
    scored. A key is cut into chunks of records; a task folds one chunk, from the sums of the key's other chunks, so a key of a third of all records is many tasks. Only keys of
    several chunks are gone through twice, for those sums.
    """
    second = how == "offline"
    q_cols = ["q", "q2"] if second else ["q"]
    dealt = rows.select("key", "seq", "n", F.floor(F.col("before") / chunk).cast("long").alias("chunk"), *q_cols)
    key_kind, seq_kind = (dict(rows.dtypes)[c] for c in ("key", "seq"))
    cells_n = len(wiring)

    def own_sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        q = vectors_of(table["q"])
        sums, met = np.zeros(cells_n, np.int64), np.zeros(cells_n, bool)
        for at in range(0, len(q), some):
            cells, v, log = driven(q[at : at + some], wiring, k, rate)
            np.add.at(sums, cells.ravel(), log.ravel())
            met[cells.ravel()] = True
        return sums, met

    def parts(table: pa.Table) -> pa.Table:
        sums, met = own_sums(table)
        if second:
            q = vectors_of(table["q2"])
            for at in range(0, len(q), some):
                met[winners(q[at : at + some], wiring, k)[0].ravel()] = True
        cells = np.flatnonzero(met)
        return pa.table({"key": pa.array([table["key"][0].as_py()] * len(cells), table.schema.field("key").type), "chunk": pa.array(np.full(len(cells), table["chunk"][0].as_py())), "cell": pa.array(cells.astype(np.int32)), "log": pa.array(sums[cells])})

    def fold(table: pa.Table, prior: np.ndarray) -> pa.Table:
        table = table.sort_by("seq")
        out = []
        if second:
            state = prior + own_sums(table)[0]
            q = vectors_of(table["q2"])
            for at in range(0, len(q), some):
                cells, v, log = driven(q[at : at + some], wiring, k, rate)
                out.append(score_rows(v, state[cells] - log))
        else:
            state, q = prior.copy(), vectors_of(table["q"])
            for at in range(0, len(q), some):
                cells, v, log = driven(q[at : at + some], wiring, k, rate)
                then = np.empty_like(log)
                for i, (c, x) in enumerate(zip(cells, log)):
                    then[i] = state[c]
                    state[c] += x
                out.append(score_rows(v, then))
        return pa.table({"key": table["key"], "seq": table["seq"], "novelty": pa.array(np.concatenate(out))})

    schema = f"key {key_kind}, seq {seq_kind}, novelty double"
    one = dealt.filter(F.col("n") <= chunk).groupBy("key").applyInArrow(lambda t: fold(t, np.zeros(cells_n, np.int64)), schema)
    several = dealt.filter(F.col("n") > chunk)
    sums = several.groupBy("key", "chunk").applyInArrow(parts, f"key {key_kind}, chunk long, cell int, log long")
    of_cell = Window.partitionBy("key", "cell")
    before = of_cell.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    prior = sums.withColumn("prior", (F.sum("log").over(of_cell) - F.col("log")) if second else F.coalesce(F.sum("log").over(before), F.lit(0))).drop("log")

    def with_prior(left: pa.Table, right: pa.Table) -> pa.Table:
        base = np.zeros(cells_n, np.int64)
        base[right["cell"].to_numpy()] = right["prior"].to_numpy()
        return fold(left, base)

    many = several.groupBy("key", "chunk").cogroup(prior.groupBy("key", "chunk")).applyInArrow(with_prior, schema)
    return one.unionByName(many)


