import random

import xxhash

from merganser.llm.simhash import components, fingerprint, groups, neighbours, one_of_each, FREE, list_links
import numpy as np


def plain(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    ids = sorted(prints)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] > group[b]:
                    group[a], changed = group[b], True
    return group


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 300))] for _ in range(15)]
    out = [None, "", "  ", "One", "one", "ONE two", "x" * 50_000]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return out


def test_groups_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, print int")
    prints = {i: plain(t) for i, t in enumerate(texts)}
    want = brute(prints)
    got = {r.doc_id: r for r in groups(df).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    kept = one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_long_list_looks_up_neighbours():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    mask = sum(0xFF << 8 * p for p in FREE[7])
    members = np.unique(np.array([base & ~mask | rng.getrandbits(64) & mask for _ in range(3000)] + [base ^ 1 << 8 * FREE[7][0]], np.uint64))
    want = {(int(a), int(b)) for i, a in enumerate(members) for b in members[i + 1 :][np.bitwise_count(members[i + 1 :] ^ a) <= 3]}
    assert {tuple(sorted(map(int, p))) for p in neighbours(members, FREE[7])} == want
    assert len(list_links(7, members)) < len(members)


def test_lists_of_any_length_over_batches_give_all_links(monkeypatch):
    """Tallies, divided lists and neighbours connect what all pairs connect; lists go on over batches."""
    import pyarrow as pa

    from merganser.llm import simhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    prints = np.unique(np.concatenate([base[rng.integers(0, 6, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, np.uint64)), rng.integers(0, 1 << 63, 300, np.uint64)]))
    want = {(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ a) <= 3]}

    def connected(pairs):
        parent = {int(p): int(p) for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(int(p)) for p in prints]

    rows = []
    for i, positions in enumerate(simhash.LISTS):
        mask = np.uint64(sum(0xFF << 8 * p for p in positions))
        rows += [(i, int((p & mask).view(np.int64)), int(p.view(np.int64))) for p in prints]
    rows.sort()
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate((pa.int8(), pa.int64(), pa.int64()))], names=["list", "bytes", "print"])
    for long, size in ((4096, 10_000), (4096, 7), (50, 300), (12, 40)):
        monkeypatch.setattr(simhash, "LONG", long)
        got = {tuple(np.array([a, b], np.int64).view(np.uint64).tolist()) for out in simhash.index_links(batch(rows[k : k + size]) for k in range(0, len(rows), size)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
        assert {tuple(sorted(p)) for p in got} <= want and connected(got) == connected(want)


def test_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in groups(df).collect()) == [("2", "2"), ("2", "2"), ("None", "2"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in one_of_each(df).collect()) == ["2", "None"]
    assert groups(df.limit(0)).count() == 0 and fingerprint(b"") == 0
