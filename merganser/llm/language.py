"""Language identification by prediction by partial matching with frozen statistics.

For each language a context tree of up to `ORDER` bytes counts which byte follows which context in its training texts.
The probability of a byte is that of the longest context known: count / (n + kinds), or else the escape probability
kinds / (n + kinds) times that in the next shorter context, down to the uniform order -1 (PPM, method C, without
exclusion). The code length of a text is the sum of the negative logarithms over all of its bytes; the language of the shortest
code wins, and ties go to the smaller name. Statistics don't change while texts are scored.

The trees of all languages are laid out as one table by context and next byte, so that scoring is array lookups.

Training takes up to `ROWS` documents of each language, those of the smallest hash of the id: the one bounded
sample there is. Prediction sees the text alone, whole. A text that is null or has no letter is `und` with score 0, as is every text if nothing was
learned. Every row gives one row, repeated and null ids included. An id's fold is crc32 of its decimal text; a null id counts as the empty text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merganser.llm.shared import encoded, map_batches, per_batch

#: Bytes of the longest context.
ORDER = 3
#: Documents of each language that are learned from, and the bytes of text at which a language has enough: whole documents up to there.
ROWS, BYTES = 300, 1_000_000
#: Candidates for the sample, as a multiple of it. A language most of whose rows are empty or repeated can give fewer documents.
AMPLE = 8
#: Bytes that are scored at once.
CHUNK = 1 << 19
LETTER = regex.compile(r"\p{L}")


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


class Trees:
    """Context trees of several languages as tables: `rows` leads from three bytes to a context, `logs[context, column of the byte, language]` is the code length in nats."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(texts)
        grams = {lang: [self.counted(texts[lang], n + 1) for n in range(order + 1)] for lang in self.languages}
        self.contexts: list[dict[bytes, int]] = [{b"": 0}]
        for n in range(1, order + 1):
            known = {g[:n] for lang in self.languages for g in grams[lang][n]}
            at = sum(map(len, self.contexts))
            self.contexts.append({g: at + i for i, g in enumerate(sorted(known))})
        # A column for each byte that occurs, and one for all others: in any context these have the same probability.
        seen = sorted({g[0] for lang in self.languages for g in grams[lang][0]})
        width = len(seen) + 1
        self.column = np.full(256, width - 1, np.int32)
        self.column[seen] = np.arange(width - 1)
        self.logs = np.zeros((sum(map(len, self.contexts)), width, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            below, place_below = np.full((1, width), 1 / 256), {b"": 0}
            for n, rows in enumerate(self.contexts):
                place = {g: i for i, g in enumerate(rows)}
                counts = np.zeros((len(rows), width), np.float32)
                for g, c in grams[lang][n].items():
                    counts[place[g[:n]], self.column[g[n]]] = c
                shorter = below if n < 2 else below[[place_below.get(g[1:], -1) for g in rows]]
                seen_, kinds = counts.sum(axis=1, keepdims=True, dtype=np.float64), (counts > 0).sum(axis=1, keepdims=True)
                known_ = seen_ + kinds
                p = np.where(counts > 0, counts / np.maximum(known_, 1), np.where(known_ > 0, kinds / np.maximum(known_, 1), 1) * shorter)
                self.logs[list(rows.values()), :, k] = -np.log(p)
                below, place_below = p, place
        self.order = order
        self.lead()

    @staticmethod
    def counted(texts: list[bytes], n: int) -> Counter:
        out: Counter = Counter()
        for text in texts:
            a = np.frombuffer(text, np.uint8).astype(np.uint32)
            if len(a) >= n:
                key = np.zeros(len(a) - n + 1, np.uint32)
                for k in range(n):
                    key = key << np.uint32(8) | a[k : len(a) - n + 1 + k]
                found, count = np.unique(key, return_counts=True)
                for f, c in zip(found.tolist(), count.tolist()):
                    out[f.to_bytes(n, "big")] += c
        return out

    def lead(self) -> None:
        """The row of the longest known context, by order: order 1 by byte; order 2 by two; order 3 by the number of a pair of known bytes and the byte before."""
        one = np.zeros(256, np.int32)
        for g, i in self.contexts[1].items():
            one[g[0]] = i
        two = np.tile(one, 256)
        if self.order > 1:
            for g, i in self.contexts[2].items():
                two[g[0] << 8 | g[1]] = i
        self.one, self.two = one, two
        if self.order > 2:
            pairs = sorted({g[1:] for g in self.contexts[3]})
            self.page = np.full(65536, 0, np.int32)
            self.three = np.zeros((len(pairs) + 1, 256), np.int32)
            for k, g in enumerate(pairs, 1):
                self.page[g[0] << 8 | g[1]] = k
                self.three[k, :] = two[g[0] << 8 | g[1]]
            for g, i in self.contexts[3].items():
                self.three[self.page[g[1] << 8 | g[2]], g[0]] = i

    def rows(self, text: np.ndarray) -> np.ndarray:
        """The context row at each byte of one text."""
        out = np.zeros(len(text), np.int32)
        wide = text.astype(np.int32)
        out[1:2] = self.one[text[:1][: max(0, len(text) - 1)]]
        if len(text) > 2:
            pair = wide[:-2] << 8 | wide[1:-1]
            out[2:] = self.two[pair]
            if self.order > 2 and len(text) > 3:
                page = self.page[pair[1:]]
                out[3:] = np.where(page > 0, self.three[page, wide[:-3]], out[3:])
        return out

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Nats that each language's tree takes for the text."""
        out = np.zeros(len(self.languages))
        a = np.frombuffer(text, np.uint8)
        for at in range(0, len(a), CHUNK):
            begin = max(0, at - self.order)
            some = a[begin : at + CHUNK]
            rows = self.rows(some)[at - begin :]
            out += self.logs[rows, self.column[some[at - begin :]]].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages or not LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        lengths = self.code_lengths(text)
        best = int(np.argmin(lengths))
        return self.languages[best], 1 / float(np.exp(np.minimum(lengths[best] - lengths, 0)).sum())


def training_texts(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, size: int = BYTES) -> dict[str, list[bytes]]:
    """Up to `rows` whole texts of each language, fewer once they have `size` bytes; the choice depends on ids and texts alone."""
    few = df.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.octet_length(F.col(text_col)).alias("n")).filter("lang is not null and n > 0")
    # Only hashes low enough for `AMPLE` times the sample are ordered, whatever the size of the table.
    sizes = df.select(F.col(lang_col).alias("_lang")).filter("_lang is not null").groupBy("_lang").agg(F.count("*").alias("of"))
    low = few.select("lang", "h", "n").join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).filter((F.col("h") / 2.0**64 + 0.5) * F.col("of") < AMPLE * rows)
    order = Window.partitionBy("lang").orderBy("h")
    sample = low.select("lang", "h", "n").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    sample = sample.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).filter(F.col("before") < size).select("lang", "h")
    chosen = few.join(F.broadcast(sample), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    out: dict[str, list[bytes]] = {}
    for r in chosen.select("lang", "text").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text.encode())
    return {k: sorted(v) for k, v in out.items()}


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, order: int = ORDER) -> DataFrame:
    """One row for each row: id, held_out (its fold is never learned from), lang_pred and score (the share of the best language among all, by probability)."""
    texts = training_texts(df.filter(fold(id_col, folds) != held_out), id_col, text_col, lang_col)
    sent = df.sparkSession.sparkContext.broadcast(Trees(texts, order))

    def make():
        trees = sent.value

        def work(batch: pa.RecordBatch):
            out = [trees.predict(t) for t in encoded(batch.column(2))]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([min(1.0, s) for _, s in out], pa.float64())})

        return work

    few = df.select(df[id_col], (fold(id_col, folds) == held_out).alias("_held"), df[text_col].cast("string").alias("_text"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, held_out boolean, lang_pred string, score double")
