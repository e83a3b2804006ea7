"""SimHash near-dedup by similarity: one document of each group of copies whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Shingles are those of `simhash` with five words; a text of fewer words is one shingle, and texts without words (null
included) are copies of each other. Texts of equal sets are one entry.

Fingerprints are SimHashes of 64 bytes: half of them over the distinct words of a text, half over its distinct pairs of neighbouring words. Single words and pairs
change less under an edit than shingles of five words do, so near copies share many of these bytes at their
positions, and other texts few. The inverted index lists each fingerprint under `LISTS` choices of three positions with the bytes there;
shared positional bytes are tallied per pair, pairs that share fewer than `SHARED` go, as do pairs whose SimHashes of 2,048 bits over the shingles differ in more
than `DIFFER`, and the rest are verified by true Jaccard over both texts, unless pairs verified in the same task connect them already.

At a similarity of 0.8 an edit touches one word in 45, and a byte stays as it was with a probability of 0.45 to 0.65, each for
itself: no number of shared bytes is certain. 16 of 64 are missed by one pair in 10,000, and meeting in no list by one in 500. The README gives the recall
that was measured.

Members of a list are first compared with its smallest; then, in lists that still hold several groups, all across groups are, in blocks in memory, so no pair that would
connect is passed over; such a pair only leaves its list if its fingerprints are near.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.shared import dropped, encoded, map_batches, numbered, staged
from merganser.llm.simhash import LOWER, components

WORDS = 5
#: The similarity from which on a pair is linked, as a fraction.
OVER, UNDER = 4, 5
#: Bytes of a fingerprint (half over words, half over pairs of words), and those that candidates share at least.
BYTES, SHARED = 64, 16
#: Bytes of the SimHash over shingles that goes along, and the bits of it that pairs may differ in: at a similarity of 0.8 they differ in 311, with a deviation of 16, so one pair in 8,000 is missed.
MORE, DIFFER = 256, 370
#: Lists of the index: choices of three positions, half of them in each half of the fingerprint.
LISTS = 80
#: Shingles whose bits are added up at once, and members of a list that are compared at once.
BLOCK, SOME = 1 << 12, 512
#: Pairs whose texts are compared together, about, and pairs whose fingerprints are compared at once.
TOGETHER, SLICE = 5_000, 1 << 16
_RNG = np.random.default_rng(5)
POWERS = _RNG.integers(0, 1 << 63, WORDS, np.uint64) | np.uint64(1)
SEEDS = _RNG.integers(0, 1 << 63, BYTES // 16, np.uint64)
MORE_SEEDS = np.random.default_rng(6).integers(0, 1 << 63, MORE // 8, np.uint64)
CHOSEN = np.array([np.sort(_RNG.choice(BYTES // 2, 3, replace=False)) + (i % 2) * (BYTES // 2) for i in range(LISTS)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed_words(text: bytes) -> np.ndarray:
    words = text.translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(of: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct runs of n words, in order; fewer words are one run."""
    n = min(n, len(of))
    if not n:
        return of
    return np.unique(mixed(sum(of[i : len(of) - n + 1 + i] * POWERS[i] for i in range(n))))


def shingles(text: bytes) -> np.ndarray:
    return grams(hashed_words(text), WORDS)


def majority(features: np.ndarray, seeds: np.ndarray = SEEDS) -> np.ndarray:
    """The SimHash of a set of hashes: bits that are set in over half of them, for each seed."""
    ones = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(features), BLOCK):
        digests = mixed(features[at : at + BLOCK, None] ^ seeds)
        ones += np.unpackbits(digests.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(features))


def fingerprint(of: np.ndarray) -> np.ndarray:
    """The positional bytes that are indexed, and the SimHash over shingles."""
    return np.concatenate([majority(grams(of, 1)), majority(grams(of, 2)), majority(grams(of, WORDS), MORE_SEEDS)])


def list_keys(prints: np.ndarray) -> np.ndarray:
    """The lists that fingerprints (rows of bytes) are members of: the number of the choice and its three bytes in one number."""
    b = prints[:, CHOSEN].astype(np.int64)
    return np.arange(LISTS) << 24 | b[:, :, 0] << 16 | b[:, :, 1] << 8 | b[:, :, 2]


def sketched(batches, text_at: int):
    """Each batch with the key of the set, its size and the fingerprint."""
    for batch in batches:
        keys, sizes, prints = [], [], []
        for text in encoded(batch.column(text_at).cast(pa.string())):
            of = hashed_words(text)
            shingled = grams(of, WORDS)
            keys.append(xxhash.xxh128_digest(shingled.tobytes()))
            sizes.append(len(shingled))
            prints.append(fingerprint(of).tobytes())
        yield [*batch.columns, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES + MORE)


def listed(batches):
    """(key, _row) for each list of each fingerprint."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_pydict({"key": pa.array(list_keys(as_bytes(batch.column(1))).ravel()), "_row": pa.array(np.repeat(rows, LISTS))})


def near(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """By pair of fingerprints: whether sizes allow the similarity, enough positional bytes are shared, and few enough bits over shingles differ."""
    kept = UNDER * np.minimum(size_x, size_y) >= OVER * np.maximum(size_x, size_y)
    kept[kept] = (x[kept, :BYTES] == y[kept, :BYTES]).sum(axis=1) >= SHARED
    kept[kept] = np.bitwise_count(x[kept, BYTES:] ^ y[kept, BYTES:]).sum(axis=1, dtype=np.int64) <= DIFFER
    return kept


def linked(a: list[int], b: list[int], similar) -> np.ndarray:
    """Flags the pairs that are similar, enough of them to connect all that similar pairs connect: pairs whose ends are connected already aren't compared."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b)):
        if (p := top(x)) != (q := top(y)) and similar(x, y):
            up[p] = q
            kept[i] = True
    return kept


def by_blocks(pairs: DataFrame, entries: DataFrame, columns: list[str], chosen) -> DataFrame:
    """Of the pairs (a, b) of entries, those at the places that `chosen(a, b, held)` returns: a and b are places in `held`, a table of `columns` of entries.

    Pairs are dealt to tasks by blocks of both their rows, so that an entry goes along once for each block it has pairs with, not for each pair. Entries without pairs aren't shuffled.
    """
    pairs = staged(pairs)
    blocks = max(1, math.ceil(math.sqrt(pairs.count() / TOGETHER)))
    block = lambda column: F.pmod(F.xxhash64(column), F.lit(blocks))
    dealt = pairs.withColumns({"of_a": block("a"), "of_b": block("b")})
    one, other = (dealt.select(F.col("of_a").alias("for_a"), F.col("of_b").alias("for_b"), F.col(k).alias("_row")).distinct() for k in "ab")
    ends = pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct()
    paired = numbered(entries, ends).select("_row", *columns)
    needed = one.union(other).distinct().join(paired, "_row")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right["_row"].to_numpy()
        order = np.argsort(rows)
        a, b = (order[np.searchsorted(rows, left[k].to_numpy(), sorter=order)] for k in "ab")
        return left.select(["a", "b"]).take(pa.array(chosen(a, b, right.select(columns)), pa.int64()))

    out = staged(dealt.groupBy("of_a", "of_b").cogroup(needed.groupBy("for_a", "for_b")).applyInArrow(work, "a long, b long"))
    dropped(pairs)
    return out


def candidates(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs that are near by their fingerprints."""

    def chosen(a: np.ndarray, b: np.ndarray, held: pa.Table) -> np.ndarray:
        size, prints = held["_size"].to_numpy(), as_bytes(held["_print"])
        parts = ((a[k : k + SLICE], b[k : k + SLICE]) for k in range(0, len(a), SLICE))
        return np.flatnonzero(np.concatenate([near(prints[x], prints[y], size[x], size[y]) for x, y in parts]))

    return by_blocks(pairs, entries, ["_size", "_print"], chosen)


def verified(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs whose texts are similar enough, as many as connect all such pairs."""

    def chosen(a: np.ndarray, b: np.ndarray, held: pa.Table) -> np.ndarray:
        of = [shingles(text) for text in encoded(held["_text"].combine_chunks())]

        def similar(x: int, y: int) -> bool:
            both = len(np.intersect1d(of[x], of[y], assume_unique=True))
            return UNDER * both >= OVER * (len(of[x]) + len(of[y]) - both)

        return np.flatnonzero(linked(a.tolist(), b.tolist(), similar))

    return by_blocks(pairs, entries, ["_text"], chosen)


def across(batches):
    """For rows (key, root, _row, _size, _print) in order of their key: pairs of a list that are of different groups, of like size, and share enough positional bytes."""

    def pairs(held):
        root, row, size = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        prints, number = np.concatenate([h[4] for h in held]), int(held[0][0][0]) >> 24
        for at in range(0, len(row), SOME):
            for to in range(at, len(row), SOME):
                i, j = np.nonzero(root[at : at + SOME, None] != root[None, to : to + SOME])
                i, j = i + at, j + to
                if at == to:
                    i, j = i[row[i] < row[j]], j[row[i] < row[j]]
                for k in range(0, len(i), SLICE):
                    x, y = i[k : k + SLICE], j[k : k + SLICE]
                    kept = near(prints[x], prints[y], size[x], size[y])
                    x, y = x[kept], y[kept]
                    # A pair that meets in several lists is given by the first.
                    first = (prints[x, :BYTES] == prints[y, :BYTES])[:, CHOSEN].all(axis=2).argmax(axis=1) == number
                    if first.any():
                        a, b = row[x[first]], row[y[first]]
                        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    held: list[tuple] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = (*(batch.column(i).to_numpy() for i in range(4)), as_bytes(batch.column(4)))
        edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(batch)]
        for begin, end in zip(edges, edges[1:]):
            if held and held[-1][0][0] != cols[0][begin]:
                yield from pairs(held)
                held = []
            held.append(tuple(c[begin:end] for c in cols))
    if held:
        yield from pairs(held)


def links(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of entries (_row, _size, _print, _text) that are similar, enough to connect all that candidates connect."""
    every = map_batches(entries.select("_row", "_print"), listed, "key long, _row long")
    several = every.groupBy("key").agg(F.min("_row").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = staged(every.join(several, "key"))
    first = staged(members.filter("_row != least").select(F.col("least").alias("a"), F.col("_row").alias("b")).distinct())
    found = verified(near_first := candidates(first, entries), entries)
    dropped(near_first)
    roots = components(found)
    grouped = members.join(roots, members["_row"] == roots.node, "left").select("key", "_row", F.coalesce("root", "_row").alias("root"))
    mixed_lists = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2").select("key")
    rest = grouped.join(mixed_lists, "key").join(entries.select("_row", "_size", "_print"), "_row").select("key", "root", "_row", "_size", "_print")
    second = map_batches(rest.repartition("key").sortWithinPartitions("key"), across, "a long, b long")
    also = verified(second.join(first, ["a", "b"], "left_anti"), entries)
    dropped(members, first)
    return found.union(also)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay when each group keeps one: the one of the smallest id (null last), and one of them if that is repeated."""
    added = ["_key", "_size", "_print"]
    places = [f"_c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*places)
    text, id_ = (places[[c.lower() for c in df.columns].index(x.lower())] for x in (text_col, id_col))
    at = places.index(text)

    def work(batches):
        for columns in sketched(batches, at):
            yield pa.RecordBatch.from_arrays(columns, names=[*places, *added])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", _key binary, _size long, _print binary"
    full = staged(map_batches(plain, work, schema).withColumn("_row", F.monotonically_increasing_id()))
    by_key = staged(full.groupBy("_key").agg(F.min("_row").alias("_row")))
    entries = numbered(full, by_key).select("_row", "_size", "_print", F.col(text).cast("string").alias("_text"))
    roots = components(links(entries))
    rooted = by_key.join(roots, by_key["_row"] == roots.node, "left").select("_key", F.coalesce("root", "_row").alias("_root"))
    rank = F.struct(F.col(id_).isNull().alias("x"), F.col(id_).alias("y"), F.col("_row").alias("z"))
    per_key = full.groupBy("_key").agg(F.min(rank).alias("r"))
    first = per_key.join(rooted, "_key").groupBy("_root").agg(F.min("r").alias("r")).select(F.col("r.z").alias("_row"))
    return numbered(full, first).select(*places).toDF(*df.columns)
