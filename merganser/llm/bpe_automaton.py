"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts with one state from which every byte leads back. Each merge (u, v) -> w of the vocabulary, in
rank order, adds one gadget: u gets a state of its own, the old one without the arc v, and w becomes an arc of every
state that still has the arc u, leading where v led from there. What it then accepts is exactly the token
sequences that byte-pair merging yields, one for each byte string, and so a word is encoded by one left-to-right
pass over a table: at each byte position stands the last token of that prefix's sequence, and arcs go on from it.

Texts are first split at special tokens, then into words by the vocabulary's pattern. Decoding emits the label
(bytes) of each arc; bytes that aren't UTF-8 decode to U+FFFD.

Null text is the empty text: no tokens. Every row gives one row, repeated and null ids included; there is no limit
on a text's or word's length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from merganser.llm.shared import encoded, map_batches, per_batch

#: The pattern that splits text into words, as the vocabulary's publisher states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode 17 assigned. The tokenizers library classes text by Unicode 16, where they are neither.
UNICODE_17 = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Words whose encoding a task keeps.
KEPT = 1_000_000

WORDS = regex.compile(PATTERN)
_N = rf"\p{{L}}--[{UNICODE_17}]", rf"\p{{N}}--[{UNICODE_17}]"
WORDS_16 = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[{_N[0]}]+| ?[{_N[1]}]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{UNICODE_17}])+|\s+(?!\S)|\s+")
NEW = regex.compile(f"[{UNICODE_17}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: labels (bytes by id), merges in rank order as (left, right, whole), special tokens."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model, letters = data["model"], byte_letters()
        known = model["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in known.items()}
        self.ids = {label: i for i, label in self.labels.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(known[a], known[b], known[a + b]) for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def words(self, text: str) -> Iterator[str | int]:
        """The words of a text in order, and the ids of special tokens between them."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from words_of(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from words_of(text[at:] if at else text)


def words_of(text: str) -> list[str]:
    return (WORDS if text.isascii() or not NEW.search(text) else WORDS_16).findall(text)


class Automaton:
    """States are held by token, as what the last token read leaves open: a list of (cut arcs with the merge that cut them, first merge that no longer counts)."""

    def __init__(self, vocabulary: Vocabulary):
        self.labels = vocabulary.labels
        self.ids = vocabulary.ids
        never = len(vocabulary.merges)
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        cuts: dict[int, dict[int, int]] = {i: {} for i in vocabulary.ids.values()}
        self.state: dict[int, list[tuple[dict[int, int], int]]] = {i: [(cuts[i], never)] for i in vocabulary.ids.values()}
        for rank, (u, v, w) in enumerate(vocabulary.merges):
            self.state[w] = [(cuts[w], never), *((c, min(until, rank)) for c, until in self.state[v])]
            self.left[w], self.born[w] = u, rank
            cuts[u][v] = rank
        #: By the first bytes of a label: its id, or -1 if they are no label themselves.
        self.heads: dict[bytes, int] = {label[:n]: -1 for label in self.ids for n in range(1, len(label))} | self.ids
        #: The transition table, filled as arcs are first tried: by state and token, whether the arc is there.
        self.arcs: dict[int, bool] = {}

    def arc(self, last: int, token: int) -> bool:
        """Whether the state after `last` has the arc `token`: no gadget cut it, nor the arc of a part it began with."""
        if len(self.arcs) > KEPT:
            self.arcs.clear()
        state, part, until = self.state[last], token, len(self.born)
        found = True
        while found and part is not None:
            for cuts, before in state:
                rank = cuts.get(part)
                if rank is not None and rank < before and rank <= until:
                    found = False
                    break
            part, until = self.left.get(part), self.born.get(part, 0)
        self.arcs[last << 20 | token] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word, by one pass over the table: `table[i]` is the last token of the first i bytes."""
        n, heads, arcs = len(word), self.heads, self.arcs
        table = [-1] * (n + 1)
        for end in range(1, n + 1):  # from the first state every token is an arc
            token = heads.get(word[:end])
            if token is None:
                break
            table[end] = token
        for at in range(1, n):
            last = table[at]
            for end in range(at + 1, n + 1):
                token = heads.get(word[at:end])
                if token is None:
                    break
                if token >= 0 and table[end] < 0:
                    found = arcs.get(last << 20 | token)
                    if found or found is None and self.arc(last, token):
                        table[end] = token
        out, at = [], n
        while at:
            out.append(table[at])
            at -= len(self.labels[table[at]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def automaton(content: bytes) -> tuple[Vocabulary, Automaton]:
    v = Vocabulary(content)
    return v, Automaton(v)


class Encoded(dict):
    """Ids of a word (or of a special token, by its id) as little-endian 32-bit integers; starts anew at `KEPT` words."""

    def __init__(self, machine: Automaton):
        self.machine = machine

    def __missing__(self, word: str | int) -> bytes:
        ids = [word] if isinstance(word, int) else self.machine.encode(word.encode())
        if len(self) >= KEPT:
            self.clear()
        out = np.array(ids, "<u4").tobytes()
        if isinstance(word, int) or len(word) < 200:
            self[word] = out
        return out


def pieces(vocabulary: Vocabulary, text: str, look) -> Iterator[bytes]:
    words = iter(vocabulary.words(text))
    while some := list(islice(words, 500_000)):
        yield b"".join(map(look.__getitem__, some))


def encode(df: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", token_ids: bool = False) -> DataFrame:
    """One row for each row: the id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, and token_ids if asked for.

    `vocabulary` is the content of a vocabulary file; it goes to the executors once, by broadcast: a few MB, whatever the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        v, machine = automaton(sent.value)
        look = Encoded(machine)

        def work(batch: pa.RecordBatch):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = b"".join(pieces(v, text or "", look))
                ids = np.frombuffer(data, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
                if token_ids:
                    all_ids.append(ids.astype(np.int32))
            out = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if token_ids:
                ends = np.cumsum([0, *map(len, all_ids)])
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *all_ids])))
            yield pa.RecordBatch.from_pydict(out)

        return work

    few = df.select(df[id_col], df[text_col].cast("string").alias("_text"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * token_ids)


def decode(df: DataFrame, vocabulary: bytes, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row for each row: the id and the text its token ids decode to (null or no ids: the empty text; an id the vocabulary lacks is an error)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        _, machine = automaton(sent.value)

        def work(batch: pa.RecordBatch):
            texts = [machine.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "text": pa.array(texts, pa.string())})

        return work

    few = df.select(df[id_col], df[ids_col].alias("_ids"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, text string")
