import random

import corpus_pipeline
from merganser.llm import near_copies, simhash


def sets(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(texts):
    """The smallest id of each group of pairs of Jaccard similarity 0.8 or more."""
    of = [sets(t) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]) and group[a] > group[b]:
                    group[a], changed = group[b], True
    return set(group)


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(500)]
    out = [None, "", " ", "One two", "one  TWO", "one two three"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(60, 300))
        for edits in (0, 1, 2, 3, 4, 6, 9, 14):
            c = list(base)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return out


def test_stage_equals_brute_force_and_simhash_does_not(spark):
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    assert len({r.doc_id for r in simhash.one_of_each(df).collect()}) > len(want)


def test_members_unlike_the_smallest_are_compared(spark):
    """All in one list whose smallest member is like no other."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(500)]
    lone, pair = rng.choices(words, k=100), rng.choices(words, k=100)
    texts = [" ".join(lone), " ".join(pair), " ".join(pair[:-1])]
    prints = [near_copies.fingerprint(near_copies.hashed_words(t.encode())) for t in texts]
    prints[0][near_copies.CHOSEN[0]] = prints[1][near_copies.CHOSEN[0]]
    rows = [(i, len(near_copies.shingles(t.encode())), bytearray(p.tobytes()), t) for i, (t, p) in enumerate(zip(texts, prints))]
    entries = spark.createDataFrame(rows, "_row long, _size long, _print binary, _text string")
    assert {(r.a, r.b) for r in near_copies.links(entries).collect()} == {(1, 2)}


def test_pairs_across_groups_of_a_list():
    """A list of several batches, groups of several blocks: pairs of different groups, of like size, of enough shared bytes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, near_copies.BYTES, np.uint8)
    number = 7
    prints = np.where(rng.random((1200, near_copies.BYTES)) < 0.3, base, rng.integers(0, 256, (1200, near_copies.BYTES), np.uint8)).astype(np.uint8)
    prints[:, near_copies.CHOSEN[number]] = base[near_copies.CHOSEN[number]]
    far = rng.random(1200) < 0.3
    whole = np.concatenate([prints, np.where(far[:, None], 255, 0).astype(np.uint8).repeat(near_copies.MORE, axis=1)], axis=1)
    roots, sizes = rng.integers(0, 3, 1200), rng.integers(80, 120, 1200)
    batches = [pa.RecordBatch.from_pydict({"key": pa.array(np.full(400, number << 24)), "root": pa.array(roots[i : i + 400]), "_row": pa.array(np.arange(i, i + 400)), "_size": pa.array(sizes[i : i + 400]), "_print": pa.array([p.tobytes() for p in whole[i : i + 400]], pa.binary())}) for i in (0, 400, 800)]
    got = [tuple(p) for b in near_copies.across(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    want = {(i, j) for i in range(1200) for j in range(i + 1, 1200) if roots[i] != roots[j] and far[i] == far[j] and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and (prints[i] == prints[j]).sum() >= near_copies.SHARED and not any((prints[i] == prints[j])[p].all() for p in near_copies.CHOSEN[:number])}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near_copies.one_of_each(df).collect()) == ["2", "None"]
    assert near_copies.one_of_each(df.limit(0)).count() == 0
