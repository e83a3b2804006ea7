import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from merganser.operators import novelty, ranking, stage2, stats, tags
from merganser.sources.baselines import Baselines, Incompatible
from merganser.sources.responses import parse_lines

FIELDS = "seq long, url string, host string, word string, status int, length long, words long, lines long, content_type string, redirect_location string, duration_ms double"


def record(seq, host="h", word="w", status=404, length=1000, words=100, lines=20):
    return (seq, f"http://{host}/{word}", host, word, status, length, words, lines, "text/html", "", 5.0)


def test_odd_record_ranks_first(spark):
    rows = [record(i, length=1000 + i % 5) for i in range(200)] + [record(200, word="treasure", length=90_000, words=9_000, lines=900)]
    scores = ranking.ranked(ranking.offline(spark.createDataFrame(rows, FIELDS), "host"))
    assert ranking.order(scores).first().seq == 200


def test_prefix_statistics_in_chunks_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    rows = [record(i, host=f"h{i % 3}", length=int(x)) for i, x in enumerate(rng.integers(0, 5000, 300))]
    got = stats.prefix(spark.createDataFrame(rows, FIELDS), ["host"], chunk=7).select("seq", "host", "n", "s_length", "q_length", "lo_length", "hi_length").collect()
    for r in got:
        before = [x[5] for x in rows if x[2] == r.host and x[0] < r.seq]
        assert (r.n, r.s_length, r.q_length) == (len(before), sum(before), sum(x * x for x in before))
        assert (r.lo_length, r.hi_length) == ((min(before), max(before)) if before else (None, None))


def valued_tags(rng, n=60, cells=32, k=4):
    """Tags of unequal strengths, some cells not driven, some tags not at all."""
    out = []
    for _ in range(n):
        c = sorted(rng.choice(cells, k, replace=False).tolist())
        out.append((c, [int(v) for v in (rng.integers(-50, 400, k) if rng.random() > 0.05 else -rng.integers(0, 9, k))]))
    return out


def sequential(tags_, cells=32, rate=0.4, rest=None, first=None):
    """Live and leave-one-out scores, record by record."""
    rest = np.ones(cells) if rest is None else rest
    w, live = rest.copy(), []

    def read(c, v, w):
        v = np.maximum(v, 0.0)
        return round(float(np.clip((v * w).sum() / (v * rest[c]).sum(), 0, 1)), 6) if v.sum() else 0.0

    for c, v in tags_:
        live.append(read(c, v, w[c]))
        v = np.maximum(v, 0.0)
        w[c] *= 1 - rate * v / max(v.max(), 1e-9)
    loo = []
    for c, v in first or tags_:
        p = np.maximum(v, 0.0)
        loo.append(read(c, v, np.minimum(w[c] / (1 - rate * p / max(p.max(), 1e-9)), rest[c])))
    return live, loo


def test_filter_equals_a_sequential_fold(spark):
    rng = np.random.default_rng(1)
    some, other = valued_tags(rng), valued_tags(rng)
    make = lambda t: spark.createDataFrame([("k", i, c, v) for i, (c, v) in enumerate(t)], "key string, seq long, cells array<int>, activations array<long>")
    df, second = make(some), make(other)
    live, loo = sequential(some, first=other)
    assert [r.novelty for r in novelty.live(df).orderBy("seq").collect()] == pytest.approx(live, abs=2e-6)
    assert [r.novelty for r in novelty.leave_one_out(df, second).orderBy("seq").collect()] == pytest.approx(loo, abs=2e-6)
    rest = 1.0 + np.arange(32) % 4
    got = novelty.live(df, rest=1 + F.col("cell") % 4).orderBy("seq").collect()
    assert [r.novelty for r in got] == pytest.approx(sequential(some, rest=rest)[0], abs=2e-6)
    for mode in ("halflife", "compounding"):
        w, seen, decayed = np.ones(32), np.zeros(32), []
        for t, (c, v) in enumerate(some, 1):
            gap, v = t - seen[c], np.maximum(v, 0.0)
            g = gap / 20 if mode == "halflife" else gap * (gap + 1) / 40
            now = 1 - (1 - w[c]) * 2.0**-g
            decayed.append(round(float((v * now).sum() / v.sum()), 6) if v.sum() else 0.0)
            on = v > 0
            w[np.array(c)[on]] = (now * (1 - 0.4 * v / max(v.max(), 1e-9)))[on]
            seen[np.array(c)[on]] = t
        assert [r.novelty for r in novelty.decayed(df, 20.0, mode).orderBy("seq").collect()] == pytest.approx(decayed, abs=2e-6)


def test_wall_clock_recovery_compounds(spark):
    """Every record rewrites all weights; only touched cells get its time."""
    rng = np.random.default_rng(8)
    some, at = valued_tags(rng, 40), np.cumsum(np.random.default_rng(9).random(40) * 3)
    df = spark.createDataFrame([("k", i, c, v, float(t)) for i, ((c, v), t) in enumerate(zip(some, at))], "key string, seq long, cells array<int>, activations array<long>, at double")
    w, seen, want = np.ones(32), np.zeros(32), []
    for (c, v), t in zip(some, at):
        v, c = np.maximum(v, 0.0), np.array(c)
        now = w + (1 - w) * (1 - np.exp2(-(t - seen) / 5.0))
        want.append(float((v * now[c]).sum() / v.sum()) if v.sum() else 0.0)
        if v.sum():
            w = now
            w[c[v > 0]] *= (1 - 0.4 * v / v.max())[v > 0]
            seen[c[v > 0]] = t
    assert [r.novelty for r in novelty.wall_clock(df, 5.0).orderBy("seq").collect()] == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_kernel_equals_a_sequential_fold_at_full_width(spark, chunk):
    """Keys of one chunk and of several, at the engine's number of cells."""
    rng = np.random.default_rng(4)
    wiring, k = ranking.wiring(), tags.active(ranking.CELLS, ranking.SPARSITY)
    q, q2 = (rng.integers(0, 1_000_000, (150, 39)) * (rng.random((150, 39)) < 0.4) for _ in range(2))
    keys = ["a" if i % 3 else "b" for i in range(150)]
    rows, n = [], {x: keys.count(x) for x in "ab"}
    for i, key in enumerate(keys):
        rows.append((key, i, keys[:i].count(key), n[key], q[i].tolist(), q2[i].tolist()))
    df = spark.createDataFrame(rows, "key string, seq long, before long, n long, q array<long>, q2 array<long>")
    want_live, want_loo = {}, {}
    for key in "ab":
        mine = [i for i in range(150) if keys[i] == key]
        one, two = ([(c[j], a[j]) for j in range(len(mine))] for c, a in (tags.winners(x[mine], wiring, k) for x in (q, q2)))
        live, loo = sequential(one, ranking.CELLS, first=two)
        want_live |= dict(zip(mine, live))
        want_loo |= dict(zip(mine, loo))
    got = {r.seq: r.novelty for r in novelty.score_stream(df, wiring, k, chunk=chunk).collect()}
    assert got == pytest.approx(want_live, abs=2e-6) and len(got) == 150
    got = {r.seq: r.novelty for r in novelty.score_stream(df, wiring, k, "offline", chunk=chunk).collect()}
    assert got == pytest.approx(want_loo, abs=2e-6) and len(got) == 150


def test_slow_hosts_do_not_overflow(spark):
    rows = spark.range(11_000).selectExpr("id as seq", "'k' as key", "1L as length", "1L as words", "1L as lines", "30000.0D as duration_ms")
    for f in (stats.frozen(rows, ["key"]), stats.prefix(rows, ["key"])):
        assert f.agg({"q_duration": "max"}).first()[0] >= 10_999 * 9 * 10**14


def test_fallback_in_one_pass_uses_the_fine_key_once_it_has_enough(spark):
    rows = spark.createDataFrame([record(i, length=1000 + i % 3) for i in range(60)] + [record(60, length=5)], FIELDS)
    got = {r.seq: r for r in ranking.live_with_fallback(rows, cells=64).collect()}
    assert len(got) == 61 and got[60].key == "h" and got[60].settled
    assert [got[i].key for i in (0, 23, 24, 59)] == ["h", "h", "h|404|9", "h|404|9"] and not got[23].settled and got[24].settled


def test_tag_kernel_equals_the_join_form(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.integers(0, 1_000_000, 39).tolist()) for i in range(50)], "seq long, q array<long>")
    wiring = tags.random_wiring(39, 64)
    act = {}
    for r in tags.activations(df, tags.wiring_table(spark, wiring), ["seq"]).collect():
        act.setdefault(r.seq, {})[r.cell] = r.activation
    for r in tags.tag(df, wiring, 5, ["seq"]).collect():
        assert list(r.cells) == sorted(sorted(act[r.seq], key=lambda c: (-act[r.seq][c], c))[:5])
        assert list(r.activations) == [act[r.seq][c] for c in r.cells]


def test_ties_go_to_the_lower_cells():
    rng = np.random.default_rng(3)
    q, wiring = rng.integers(0, 3, (200, 6)), tags.random_wiring(6, 40, 2)
    act = (q * 6 - q.sum(axis=1, keepdims=True)) @ wiring.T
    for k in (1, 7, 40):
        cells, values = tags.winners(q, wiring, k)
        for row, c, v in zip(act, cells, values):
            assert c.tolist() == sorted(sorted(range(40), key=lambda i: (-row[i], i))[:k]) and v.tolist() == row[c].tolist()


def test_lines_never_fail(spark):
    lines = ['{"status": "200", "length": 12, "input": {"FUZZ": "YWRtaW4="}, "tls": 1}', "{broken", "[1, 2]", " ", "null", '{"status": "x"}']
    got = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.kind for r in got] == ["ok", "malformed", "malformed", "empty", "malformed", "ok"]
    assert got[0].word == "admin" and got[0].status == 200 and got[0].unknown == ["tls"] and got[5].status == 0 and got[5].failed_status


def test_scope(spark):
    urls = spark.createDataFrame([("https://a.b.c/x",), ("http://b.c/",), ("ftp://a.b.c/",), ("http://z.c:81/",), ("nothing",)], "url string")
    scope = spark.createDataFrame([("*.b.c", 1), ("z.c:81", 2)], "pattern string, place int")
    assert {r.url for r in stage2.decided(urls, scope).filter("allowed").collect()} == {"https://a.b.c/x", "http://z.c:81/"}


def test_baselines_refuse_other_settings(spark, tmp_path):
    b = Baselines(spark, str(tmp_path))
    with pytest.raises(KeyError):
        b.load("x", {})
    b.save("x", spark.createDataFrame([("k", 1, 2, -10, 0.36)], "key string, cell int, touches long, log long, weight double"), {"cells": 256}, 1.0)
    assert b.names() == ["x"] and b.load("x", {"cells": 256}).count() == 1
    with pytest.raises(Incompatible):
        b.load("x", {"cells": 512})


def test_every_query_has_a_name_and_sql_refers_to_one():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)
