"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a word form a doubly linked list; a heap holds the adjacent pairs that have a rank. The pair of the
lowest rank, leftmost first, is popped again and again; a pair one of whose ends has changed since is stale and is
skipped. A merge takes one symbol away, and so the count is the number of bytes less the merges; no ids are
looked up or kept for the output.

Null text is the empty text: 0 bytes, 0 tokens. Special tokens count as one. Every row gives one row, repeated and null ids included;
a word of any length takes n log n steps.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from merganser.llm.bpe_automaton import KEPT, Vocabulary
from merganser.llm.shared import map_batches, per_batch


class Merger:
    def __init__(self, vocabulary: Vocabulary):
        self.symbol = [vocabulary.ids[bytes([b])] for b in range(256)]
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary.merges)}

    def count(self, word: bytes) -> int:
        """Symbols left when no adjacent pair has a rank."""
        n = len(word)
        pairs, symbols = self.pairs, [self.symbol[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            merges += 1
            whole = symbols[i] = pairs[a, b][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((whole, symbols[k])):
                    heappush(heap, (p[0], i, whole, symbols[k]))
            h = before[i]
            if h >= 0 and (p := pairs.get((symbols[h], whole))):
                heappush(heap, (p[0], h, symbols[h], whole))
        return n - merges


@lru_cache(2)
def merger(content: bytes) -> tuple[Vocabulary, Merger]:
    v = Vocabulary(content)
    return v, Merger(v)


class Counted(dict):
    """Tokens of a word; starts anew at `KEPT` words. A special token, given by its id, counts 1."""

    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str | int) -> int:
        n = 1 if isinstance(word, int) else self.merger.count(word.encode())
        if len(self) >= KEPT:
            self.clear()
        if isinstance(word, int) or len(word) < 200:
            self[word] = n
        return n


def count_tokens(df: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row: the id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        v, m = merger(sent.value)
        look = Counted(m)

        def work(batch: pa.RecordBatch):
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words, n = iter(v.words(text or "")), 0
                while some := list(islice(words, 500_000)):
                    n += sum(map(look.__getitem__, some))
                n_tokens.append(n)
                n_bytes.append(len((text or "").encode()))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())})

        return work

    few = df.select(df[id_col], df[text_col].cast("string").alias("_text"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
