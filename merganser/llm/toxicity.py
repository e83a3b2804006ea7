"""Toxicity by Levenshtein automata over a learned lexicon, with context windows.

Terms: words that labelled texts of the learning folds hold far more often when toxic, by the log-likelihood ratio; all that pass. The terms form a
trie; the Levenshtein automaton of distance 1 (insertion, deletion, substitution, or two neighbours swapped) of all terms at once is
its product with the trie, made deterministic as words are read: a state is a set of (trie node, edits so far). A word that ends in no term but
within one edit of one of at least `LONG` letters is a misspelling of it, unless labelled texts that aren't toxic hold that word.

Context: a hit between quotation marks, or near a word that reports speech or speaks of words, counts as quotation, with part of the weight.
The score is a logistic function of the summed weights and hits, fitted on the same labelled texts.

Learning takes a sample of at most about `SAMPLE` labelled documents, chosen by a hash of the id: the one bounded sample there is; all texts are read and scored whole.
A null or empty text scores as one without hits. Without labels of both kinds, every score is the share of toxic labels, or 0 without any. Labels that are
null are left out; a document with several labels is toxic if one says so. Every row gives one row, repeated and null ids included.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merganser.llm.language import fold
from merganser.llm.shared import map_batches, per_batch, staged

#: Labelled documents that are learned from, about.
SAMPLE = 12_000
#: Toxic texts that hold a term, at least; log-likelihood ratio, at least; how much larger its share of toxic texts is, at least.
LEAST, RATIO, LIFT = 3, 15.0, 4
#: Letters of a word up to which a task keeps what it found.
SHORT = 100
#: Letters of a term whose misspellings count; share of the weight they have; share of the weight of quotations.
LONG, MISSPELLED, QUOTED = 5, 0.7, 0.3
#: Words on either side that make the context.
WINDOW = 8
#: Score from which a text is toxic.
CUT = 0.7
#: Quotation marks that open and close, and words that report speech or speak of words.
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
REPORTING = frozenset("said says quote quoted quotes word words term terms called calling wrote phrase slur insult insults".split())
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + OPENING + CLOSING + "…–—¿¡"


def bare(word: str) -> str:
    """A word without punctuation at its ends, in lower case."""
    return word.strip(EDGES).lower()


class Lexicon:
    """Terms in a trie, and the deterministic automaton of words within one edit of a term."""

    def __init__(self, weights: dict[str, float], innocent: frozenset[str] = frozenset()):
        self.weights, self.innocent = weights, innocent
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(weights):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            self.term[node] = term
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[str | None, str | None]] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self.state(self.closed({(0, 0, "")}))
        self.dead = self.state(frozenset())

    def closed(self, places: set[tuple[int, int, str]]) -> frozenset:
        """With deletions: letters of a term that the word lacks."""
        out = set(places)
        for node, edits, due in places:
            if not edits and not due:
                out |= {(child, 1, "") for child in self.next[node].values()}
        return frozenset((n, e, d) for n, e, d in out if not (e and (n, 0, "") in out))

    def state(self, places: frozenset) -> int:
        if places not in self.states:
            self.states[places] = len(self.sets)
            self.sets.append(places)
            exact = next((self.term[n] for n, e, d in places if not e and not d and self.term[n]), None)
            near = [self.term[n] for n, e, d in places if e and not d and self.term[n] and len(self.term[n]) >= LONG]
            self.accepts.append((exact, max(near, key=lambda t: (self.weights[t], t), default=None)))
        return self.states[places]

    def step(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, due in self.sets[state]:
            child = self.next[node].get(c)
            if due:  # a swap: its first letter comes now
                if c == due:
                    out.add((node, 1, ""))
                continue
            if child is not None:
                out.add((child, edits, ""))
            if not edits:
                out.add((node, 1, ""))
                for first, below in self.next[node].items():
                    if first != c:
                        out.add((below, 1, ""))
                    if (second := self.next[below].get(c)) is not None and first != c:
                        out.add((second, 1, first))
        if len(self.moves) > 1_000_000:
            self.moves.clear()
        to = self.moves[state, c] = self.state(self.closed(out))
        return to

    def find(self, word: str) -> tuple[str, bool] | None:
        """The term that a bare word is, or misspells (then True)."""
        state, moves = self.start, self.moves
        for c in word:
            to = moves.get((state, c))
            state = self.step(state, c) if to is None else to
            if state == self.dead:
                return None
        exact, near = self.accepts[state]
        if exact:
            return exact, False
        return (near, True) if near and word not in self.innocent else None


class Hits(dict):
    """By word as it stands in a text: None, or the term's weight and whether it is misspelled."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        found = self.lexicon.find(bare(word))
        out = (self.lexicon.weights[found[0]] * (MISSPELLED if found[1] else 1.0), found[0]) if found else None
        if len(self) > 500_000:
            self.clear()
        if len(word) < SHORT:
            self[word] = out
        return out


def is_quoted(words: list[str], at: int) -> bool:
    """Whether quotation marks open before the word and close after it within the window, or a reporting word is in it."""
    before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
    opened = any(w[0] in OPENING for w in before) and not any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in before[:-1] if w[0] not in OPENING)
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after)
    return opened and closed or any(bare(w) in REPORTING for w in (*before[:-1], *after[1:]))


def features(text: str, hits: Hits) -> tuple[float, float, float]:
    """Summed weight in context, different terms, and hits per hundred words."""
    words = text.split()
    found = list(map(hits.__getitem__, words))
    places = [i for i, f in enumerate(found) if f]
    if not places:
        return 0.0, 0.0, 0.0
    shares = [QUOTED if is_quoted(words, i) else 1.0 for i in places]
    total = sum(found[i][0] * s for i, s in zip(places, shares))
    return math.log1p(total), math.log1p(sum(max(s for i, s in zip(places, shares) if found[i][1] == t) for t in {found[i][1] for i in places})), math.log1p(100 * sum(shares) / len(words))


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a logistic function (the last is constant), by Newton's method with a small quadratic penalty; features only ever speak for toxicity."""
    x = np.column_stack([x, np.ones(len(x))])
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        some, ridge = x[:, free], np.diag([penalty] * (int(free.sum()) - 1) + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w[free] -= np.linalg.solve((some * (p * (1 - p))[:, None]).T @ some + ridge, some.T @ (p - y) + ridge @ w[free])
        if (w[:-1] >= 0).all():
            return w
        free[:-1] &= w[:-1] > 0


def ratio(a: Column, b: Column, n: int, m: int) -> Column:
    """Log-likelihood ratio of a among n against b among m."""
    a, b, low = a.cast("double"), b.cast("double"), F.lit(1e-12)
    ll = lambda k, size, q: k * F.log(F.greatest(q, low)) + (size - k) * F.log(F.greatest(1 - q, low))
    p = (a + b) / (n + m)
    return 2 * (ll(a, n, a / n) + ll(b, m, b / m) - ll(a, n, p) - ll(b, m, p))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str, hits: Hits) -> float:
        z = float(np.dot(self.weights[:-1], features(text, hits)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> Model:
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).alias("_toxic"))
    total = labelled.count()
    chosen = F.pmod(F.xxhash64(F.lit(11), F.col("_label_id")), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(total, 1)))
    few = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    rows = staged(few.join(F.broadcast(labelled.filter(chosen)), F.col("_id") == F.col("_label_id")).select("_toxic", "_text"))

    def words(batches):
        for batch in batches:
            out = [(w, y) for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in {bare(w) for w in (text or "").split()}]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([int(y > 0) for _, y in out], pa.int32())], names=["word", "toxic"])

    sizes = {bool(r[0]): r[1] for r in rows.groupBy(F.col("_toxic") > 0).count().collect()}
    n, m = sizes.get(True, 0), sizes.get(False, 0)
    if not n or not m:
        share = n / (n + m) if n + m else 0.0
        return Model(Lexicon({}), np.array([0, 0, 0, math.log(max(share, 1e-13) / max(1 - share, 1e-13))]))
    counts = staged(map_batches(rows, words, "word string, toxic int").filter("length(word) > 1").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    # All terms of enough weight: no more than the words of the sample.
    terms = counts.filter((F.col("a") >= LEAST) & (F.col("a") * m > LIFT * F.col("b") * n) & (ratio(F.col("a"), F.col("b"), n, m) >= RATIO)).orderBy("word").collect()
    weights = {r.word: math.log((r.a + 0.5) / (n + 1)) - math.log((r.b + 0.5) / (m + 1)) for r in terms}
    lexicon = Lexicon(weights)
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches):
        for batch in batches:
            found = [bool((f := sent.value.find(w)) and f[1]) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    innocent = map_batches(counts.filter("b > 0").select("word"), near, "word string")
    lexicon = Lexicon(weights, frozenset(r.word for r in innocent.toLocalIterator()))
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches):
        hits = Hits(sent.value)
        for batch in batches:
            x = np.array([features(t or "", hits) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([float(y > 0) for y in batch.column(0).to_pylist()], pa.float64()), *(pa.array(x[:, i]) for i in range(3))], names=["y", "a", "b", "c"])

    seen = np.array([tuple(r) for r in map_batches(rows, measured, "y double, a double, b double, c double").collect()])
    order = np.lexsort(seen.T)
    return Model(lexicon, fitted(seen[order, 1:], seen[order, 0]))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """One row for each row: id, held_out (its fold's labels are never learned from), score (0 to 1) and predicted (1 from `CUT` on)."""
    model = learn(df, labels.filter(fold(id_col, folds) != held_out), id_col, text_col, label_col, sample)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        hits = Hits(m.lexicon)

        def work(batch: pa.RecordBatch):
            s = [m.score(t or "", hits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "held_out": batch.column(1), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= CUT) for x in s], pa.int32())})

        return work

    few = df.select(df[id_col], (fold(id_col, folds) == held_out).alias("_held"), df[text_col].cast("string").alias("_text"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, held_out boolean, score double, predicted int")
