import hashlib
import random

import numpy as np
import pytest
import tokenizers

from merganser.llm.bpe_automaton import automaton, decode, encode
from merganser.llm.queries import TOKENIZERS, vocabulary
from merganser.llm.token_count import count_tokens, merger


def texts():
    rng = random.Random(5)
    some = ["", None, "a<|endoftext|>b  c\n\n x", "<|endoftext|>", "aaaaaaaaaa" * 300, "日本語テキスト" * 100, "՘x \U0001f600‍", "-=" * 500, "it's we'll I'D 123 4567  ", "\t\r\n \x1c \x85 \xa0."]
    return some + ["".join(rng.choice(["a", "e", " ", "th", "ing", "\n", ".", "1", "é", "ß", "語", "\U0001f600", "'s"]) for _ in range(rng.randint(0, 80))) for _ in range(500)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")


def test_ids_and_counts_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = {r.doc_id: r for r in encode(df, vocabulary(), token_ids=True).collect()}
    counts = {r.doc_id: r for r in count_tokens(df, vocabulary()).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].token_ids == ids and rows[i].n_tokens == counts[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[i].n_bytes == len((t or "").encode()) and counts[i].over_limit == (len(ids) > 512)
    back = {r.doc_id: r.text for r in decode(encode(df, vocabulary(), token_ids=True), vocabulary()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}


def test_every_label_merges_into_one_symbol():
    """By the heap and list alone, for all labels: what the automaton's first state takes for granted."""
    v, m = merger(vocabulary())
    assert all(m.count(label) == 1 for label in v.ids)


def test_gadgets_cut_what_merges_join():
    """No state has the arc of a token that would have been merged with the last one, and paths equal plain merging."""
    v, machine = automaton(vocabulary())
    assert not any(machine.arc(a, b) for a, b, _ in v.merges)
    rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(v.merges)}

    def plain(word):
        out = [v.ids[bytes([b])] for b in word]
        while found := min(((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None):
            i = found[1]
            out[i : i + 2] = [rank[out[i], out[i + 1]][1]]
        return out

    rng = random.Random(3)
    labels = [x for x in v.ids if len(x) < 12]
    words = [b"".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(1500)] + [bytes(rng.choices(b"abest in", k=rng.randint(1, 30))) for _ in range(1500)]
    assert all(machine.encode(w) == plain(w) for w in words)


def test_clashing_columns_and_a_long_text(spark):
    long = "word " * 200_000 + "x" * 5_000
    rows = [(1, long, 5, "a", [1]), (1, "a b", 6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _text string, token_ids array<int>")
    got = sorted(r.n_tokens for r in count_tokens(df, vocabulary()).collect())
    assert got == sorted(r.n_tokens for r in encode(df, vocabulary()).collect()) and got[0] == 2 and got[1] > 200_000
    assert count_tokens(df.limit(0), vocabulary()).count() == 0


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(df, vocabulary()).collect()) == [0, 1, 1, 1]
    assert encode(df.limit(0), vocabulary()).count() == 0
