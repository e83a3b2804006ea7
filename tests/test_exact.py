"""Results that hang on a last bit, or on sums and windows of large tables."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from merganser.operators import evaluation, gates, novelty, ranking, tags
from merganser.plans import catalog
from merganser.sources.baselines import Baselines


def halfway(spark):
    """A tag whose second logarithm is at the edge between two units: the JVM's logarithm falls to the other side of it."""
    return spark.createDataFrame([("k", 0, [3, 5], [537, 526])], "key string, seq long, cells array<int>, activations array<long>")


UNITS = {3: -510825623766, 5: -497261913973}


def test_logarithms_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    want = {c: duckdb.sql(f"select cast(round(ln(1 - 0.4::double * {v}::double / 537::double) * 1e12) as bigint)").fetchall()[0][0] for c, v in ((3, 537), (5, 526))}
    assert want == UNITS
    assert {r.cell: r.log for r in novelty.totals(halfway(spark)).collect()} == UNITS
    left = 1 - 0.4 * np.arange(1, 100_000) / 100_000
    assert novelty.units(left).tolist() == [math.floor(math.log(x) * 1e12 + 0.5) if math.log(x) * 1e12 % 1 != 0.5 else math.floor(math.log(x) * 1e12) for x in left.tolist()]


def test_a_stored_state_has_the_logarithms_of_sql(spark, tmp_path):
    settings = {"cells": 8}
    store = Baselines(spark, str(tmp_path))
    store.save("week", novelty.totals(halfway(spark)), settings, 1.0)
    assert {r.cell: r.log for r in store.load("week", settings).collect()} == UNITS


def test_rank_products_of_millions_of_rows_do_not_overflow(spark):
    """Two columns of different order whose doubled ranks, squared and summed, pass 2^63."""
    n = 2_000_000
    rows = spark.range(n).selectExpr("id div 20000 as a", "(id * 7) % 100 as b")
    a, b = np.arange(n) // 20000, np.arange(n) * 7 % 100
    assert sum((2 * r) ** 2 for r in range(0, n, 100)) * 100 > 2**63
    assert evaluation.spearman(rows, "a", "b").first().rho == pytest.approx(np.corrcoef(a, b)[0, 1], abs=2e-6)


def test_activations_are_summed_without_a_row_of_a_cell(spark):
    """The same sums as the join form, from a plan that shuffles nothing."""
    rng = np.random.default_rng(5)
    wiring = ranking.wiring(64)
    df = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(rng.integers(-1_000_000, 1_000_000, (40, wiring.shape[1])))], "seq long, q array<long>")
    each = tags.activations(df, tags.wiring_table(spark, wiring), ["seq"]).groupBy("seq")
    want = each.agg(F.count("*").alias("cells"), F.sum("activation").alias("total"), F.sum(F.col("activation") * (F.col("cell") + 1)).alias("weighted"), F.max("activation").alias("most"))
    got = tags.activation_sums(df, wiring, ["seq"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_hash_activations_makes_no_row_of_a_cell(spark, tmp_path):
    rows = [(i, i % 2, "click", float(i % 3), '{"k": %d}' % (i % 4)) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plan = catalog.QUERIES["hash_activations"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_gate_over_all_rows_in_chunks(spark):
    """Windows that begin in earlier chunks, numbers with gaps and missing scores, and no task that takes all rows."""
    rng = np.random.default_rng(7)
    x = [None if u < 0.1 else round(float(u), 6) for u in rng.random(500)]
    at = np.cumsum(rng.integers(1, 90, 500)).tolist()
    rows = spark.createDataFrame([("k", s, v) for s, v in zip(at, x)], "key string, seq long, novelty double")
    plan = gates.rolling(rows, 0.9, 50, 20, chunk=16)
    assert "applyInArrow" in (text := plan._jdf.queryExecution().toString()) or "FlatMapGroupsInArrow" in text
    got = {r.seq: (r.cutoff, r.shown) for r in plan.collect()}
    assert len(got) == 500
    for i, (s, v) in enumerate(zip(at, x)):
        last = [y for y in x[max(0, i - 49) : i + 1] if y is not None]
        want = round(float(np.quantile(last, 0.9)), 10) if i >= 19 else None
        assert got[s][0] == (None if want is None else pytest.approx(want, abs=1e-9)) and got[s][1] == (v is not None and want is not None and v >= got[s][0] and v > 0)


def test_long_streams_have_wider_micro_batches(spark, tmp_path):
    rows = [("k" if i % 3 else "l", i * 5000, [i % 5, 5 + i % 3], [100 + i, 50 - i]) for i in range(60)]
    some = spark.createDataFrame(rows, "key string, seq long, cells array<int>, activations array<long>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog, "fresh", lambda spark, name: str(tmp_path / name))
        got = {(r.key, r.seq): (r.novelty, r.late) for r in catalog.streamed(spark, None, some).collect()}
    assert got == {(r.key, r.seq): (pytest.approx(r.novelty, abs=2e-6), False) for r in novelty.live(some).collect()}
    assert len(list((tmp_path / "stream" / "at" / "offsets").glob("[0-9]*"))) <= 17
