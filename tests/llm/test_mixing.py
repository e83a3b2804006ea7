import pytest

from merganser.llm.mixing import mix, repeated_rows, sainte_lague


def table(spark, sizes):
    rows = [(i, s, " ".join(["w"] * n) if n is not None else None, "x") for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string")


def plain_targets(sizes):
    names = sorted({s for s, _ in sizes if s is not None}) + [None] * any(s is None for s, _ in sizes)
    total = {s: sum(n or 0 for t, n in sizes if t == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(total.values())
    while open_:
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > 3 * total[s]}
        if not above:
            return out | {s: left * weight[s] / w for s in open_}
        for s in above:
            out[s] = 3 * total[s]
            left -= 3 * total[s]
        open_ -= above
    return out


SIZES = [("a", 500)] * 40 + [("b", 100)] * 30 + [("c", 7)] * 3 + [(None, 300)] * 20 + [("d", None), ("d", 0), ("e", 1), ("f", 20_000)]


def test_targets_and_taken(spark):
    rows = mix(table(spark, SIZES), shard=16).collect()
    assert len(rows) == len(SIZES)
    want = plain_targets(SIZES)
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.size == (SIZES[r.doc_id][1] or 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 10 + 0.02 * want[s] for s in want)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(table(spark, SIZES).repartition(5), shard=16).collect()), key=str)


def test_quotas_are_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 3, "e": 0, "f": 24}
    df = spark.createDataFrame([(k, v, 20) for k, v in votes.items()], "p string, v long, seats long")
    got = {r.p: r.quota for r in sainte_lague(df, "seats", "v", "p").collect()}
    won = dict.fromkeys(votes, 0)
    for _ in range(20):
        won[min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))] += 1
    assert got == won


def test_rows_and_empty(spark):
    df = table(spark, SIZES)
    out = repeated_rows(df)
    assert out.columns == df.columns
    assert mix(df.limit(0)).count() == 0
