import hashlib
import random
from collections import defaultdict

import pytest

from merganser.llm.suffix_dedup import dedup, dedup_text, kept_bytes


def brute(texts, length):
    """(removed, runs, sha256) of each text, start by start."""
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, t in enumerate(data):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append((i, p))
    gone = [bytearray(len(t)) for t in data]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for t, g in zip(data, gone):
        runs = [len(x) for x in bytes(g).split(b"\0") if x]
        out.append((len(t), sum(runs), len(runs), hashlib.sha256(bytes(c for c, x in zip(t, g) if not x)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé ñ") for _ in range(n))
    shared = [some(n) for n in (35, 60, 90, 200)]
    texts = [None, "", "a" * 300, "ab" * 100, some(39), some(500)]
    for _ in range(60):
        texts.append("".join(rng.choice([some(rng.randint(0, 60)), rng.choice(shared), shared[3][rng.randint(0, 80) :]]) for _ in range(rng.randint(1, 5))))
    return texts + texts[5:9]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_equals_brute_force(spark, crowd):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string")
    got = {r.doc_id: tuple(r)[1:] for r in dedup(df, length=40, gram=12, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_two_lengths_at_once(spark, crowd):
    texts = corpus(5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup(df, length=70, passage=40, gram=12, crowd=crowd).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute(texts, 70)
    assert [got[i].n_passage for i in range(len(texts))] == [x[1] for x in brute(texts, 40)]
    one = {r.doc_id: tuple(r)[1:5] for r in dedup(df, length=40, passage=70, gram=12, crowd=crowd).collect()}
    assert [one[i] for i in range(len(texts))] == brute(texts, 40)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    from merganser.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK", 128)
    docs = [t for t in corpus(7) if t]
    texts = ["".join(docs[:8]), "".join(docs[4:20]), "".join(docs[15:]), "".join(docs[:8])]
    data = [t.encode() for t in texts]
    for lengths in ([40], [70, 40]):
        for array, held in suffix_dedup.batches_of(data, min(lengths), max(lengths)):
            for row, at, begin, end, ahead in held:
                assert array[begin : end + ahead].tobytes() == data[row][at : at + end + ahead - begin]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup(df, length=70, passage=40, gram=12).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute(texts, 70)


def test_repeated_and_null_ids(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=100))
    df = spark.createDataFrame([(None, long), (1, long[20:80]), (1, "other"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, dedup(df, length=40, gram=12).select("n_bytes", "n_removed").collect()))
    assert got == [(0, 0), (5, 0), (60, 60), (100, 60)]
    assert dedup(df.limit(0), length=40, gram=12).count() == 0


def test_text_keeps_whole_characters(spark):
    same = "é" * 3 + "".join(random.Random(2).choices("abcdefgh", k=60)) + "ñ"
    df = spark.createDataFrame([(1, "xè" + same + "ó"), (2, "yê" + same + "ò"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_text(df, length=40, gram=12).collect()}
    assert got == {1: "xèó", 2: "yêò", 3: None}


def test_kept_bytes():
    assert kept_bytes(b"abcdef", [(1, 2), (4, 6)]) == b"acd"
