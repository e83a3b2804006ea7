"""Quality rules by repetition coverage.

Words get numbers by first occurrence, and a rolling hash over the numbers gives every n-gram of several lengths a
64-bit key. A repeat is an n-gram whose key occurred earlier in the text; the characters of words under repeats,
over all characters of words, are the text's coverage at that length. Lines are measured the same way.

The base rules come first: fewer than 50 words, or more than half of the words within 3-word windows that the text
holds twice or more. A text that passes them is kept unless its coverage at some length, or that of its lines,
exceeds that length's limit, or symbols exceed theirs.

Null text has no words, and so fails the base rules, as the empty text does. Every row gives one row, repeated and
null ids included. A text is measured whole, in memory linear in its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from merganser.llm.shared import encoded, map_batches, per_batch

#: By n-gram length: the largest share of the characters in words that repeats may cover.
LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}
#: The same for lines.
LINE_LIMIT = 0.30
#: The largest share of symbols in those characters: runs of the same few marks repeat below the level of words.
SYMBOL_LIMIT = 0.05
#: Multiplier of the rolling hash, and of the finalizer that spreads word numbers; odd.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

SYMBOLS = bytes.maketrans(b"", b""), bytes(set(range(256)) - set(b"#*$%&|<>"))
#: Every byte but those that begin a character; white space goes too.
NOT_COUNTED = bytes([*range(0x80, 0xC0), *b" \t\n\r\x0b\x0c"])


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: whether the key occurs twice or more, and whether it occurred earlier."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """By word: whether it is in one of the n-grams that begin at `starts` (a flag by position)."""
    depth = np.zeros(words + 1, np.int32)
    depth[: len(starts)] += starts
    depth[n : n + len(starts)] -= starts
    return np.cumsum(depth[:words]) > 0


def rolled(numbers: np.ndarray, n: int) -> np.ndarray:
    """The key of the n-gram at each position: the hash of the one before, with a word taken out and one put in, as sums of powers mod 2^64."""
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * SPREAD
    mixed ^= mixed >> np.uint64(29)
    mixed *= STEP
    key = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for k in range(n):
        key = key * STEP + mixed[k : k + len(key)]
    return key


def triples(numbers: np.ndarray) -> np.ndarray:
    """The number of the 3-gram at each position; equal only where all three words are."""
    a = numbers
    if len(a) < 3:
        return np.empty(0, np.int64)
    if a.max() < 1 << 21:
        return a[:-2] << 42 | a[1:-1] << 21 | a[2:]
    pair = np.unique(a[:-1] << 32 | a[1:], return_inverse=True)[1]
    return pair[:-1] << 32 | a[2:]


def measured(text: bytes) -> tuple[int, int, int, int, int, dict[int, float], float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coverage by n-gram length, coverage by lines."""
    words = text.split()
    n, by = len(words), {}
    numbers = np.fromiter(map(by.setdefault, words, range(n)), np.int64, n)
    total = len(text.translate(None, NOT_COUNTED))
    lines, seen, dup_lines, dup_chars = text.split(b"\n"), set(), 0, 0
    for line in lines if len(lines) > 1 else ():
        if line in seen:
            if bare := line.translate(None, NOT_COUNTED):
                dup_lines += 1
                dup_chars += len(bare)
        else:
            seen.add(line)
    twice, _ = repeats(triples(numbers))
    repeat_words = int(covered(twice, 3, n).sum())
    chars = np.fromiter((len(w.translate(None, NOT_COUNTED)) for w in words), np.int64, n) if repeat_words else None
    coverage = {k: float(chars[covered(repeats(rolled(numbers, k))[1], k, n)].sum() / max(total, 1)) for k in LIMITS} if repeat_words else dict.fromkeys(LIMITS, 0.0)
    return n, total, len(text.translate(*SYMBOLS)), dup_lines, repeat_words, coverage, dup_chars / max(total, 1)


def verdicts(measures: tuple) -> tuple[bool, bool]:
    """base_failed and kept."""
    n, total, symbols, _, repeat_words, coverage, lines = measures
    failed = n < 50 or 100 * repeat_words > 50 * n
    return failed, not failed and lines <= LINE_LIMIT and symbols <= SYMBOL_LIMIT * total and all(coverage[k] <= most for k, most in LIMITS.items())


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and coverage_<n> and coverage_lines."""

    def make():
        def work(batch: pa.RecordBatch):
            rows = [measured(text) for text in encoded(batch.column(1))]
            cols = {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            cols |= {name: pa.array([verdicts(r)[i] for r in rows], pa.bool_()) for i, name in enumerate(("base_failed", "kept"))}
            cols |= {f"coverage_{k}": pa.array([r[5][k] for r in rows], pa.float64()) for k in LIMITS} | {"coverage_lines": pa.array([r[6] for r in rows], pa.float64())}
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0)} | cols)

        return work

    few = df.select(df[id_col], df[text_col].cast("string").alias("_text"))
    longs = ", ".join(f"{x} long" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, {longs}, base_failed boolean, kept boolean, " + ", ".join(f"coverage_{k} double" for k in LIMITS) + ", coverage_lines double")


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; decided row by row, without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([verdicts(measured(text))[1] for text in texts], pa.bool_()))

    return map_batches(df, run, df.schema)
