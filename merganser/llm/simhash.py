"""SimHash near-duplicate groups by a byte-position inverted index with count filtering.

Fingerprint: XXH64 (seed 42) of every 3-word shingle, repeats included, in lower-cased (A-Z) words joined by one space;
a bit is 1 if set in over half of them. A text of fewer words is one shingle; a text without words (null included)
has the fingerprint zero, which links like any other.

Two fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes: the guaranteed minimum. Of any
5 positions, 3 are in the lower or 3 in the upper four. So the inverted index lists each distinct fingerprint under every choice of 3 positions of
either half with the bytes there, 8 lists in all, and no such pair misses another. In a list, shared positional bytes are tallied for each pair, over all 8 positions; pairs
that reach the minimum are verified bit by bit.

A list is compared in blocks in memory. One of more than `LONG` members is indexed again by two positions more (a pair of the minimum shares two of the other five), and where even that leaves
more, each member looks up its 2,324 neighbours within 3 of the free bits: the same pairs, without comparing all. Copies are
one entry, however many. Each list emits only the links of a spanning forest of its own, which loses no connection.

Groups are the connected components of these links over distinct fingerprints, by alternating large-star and
small-star steps on tables in the shared folder, until nothing changes.

The result has one row for each row of the input, repeated ids included. Rows with a null id take part: they link
others, and get the smallest id that isn't null in their group, or null if there is none.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.shared import encoded, map_batches, per_batch, staged

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints that differ in so many bits at most are linked.
RADIUS = 3
#: Positional bytes that such a pair shares at least.
SHARED = 8 - RADIUS
#: The positions of each list: the choices of 3 in either half.
LISTS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: The positions that a pair of the minimum may differ in: the 56 choices of 3 out of 8.
FREE = list(combinations(range(8), RADIUS))
#: Members beyond which a list is indexed by more positions.
LONG = 4_096
#: Parts that the rows of one fingerprint are dealt to.
SALTS = 8
#: Shingles whose bits are added up at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, k: int = 3) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """The id and the fingerprint, as a signed 64-bit integer, of each row."""

    def make():
        def work(batch: pa.RecordBatch):
            prints = np.array([fingerprint(t, k) for t in encoded(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "print": pa.array(prints)})

        return work

    few = df.select(df[id_col], df[text_col].cast("string").alias("_text"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, print long")


def list_key(number: int, prints: F.Column) -> F.Column:
    """The list's number, and the bytes of a fingerprint at its positions."""
    mask = reduce(lambda m, p: m | 0xFF << 8 * p, LISTS[number], 0)
    return F.struct(F.lit(number).cast("byte").alias("list"), prints.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes"))


def neighbours(prints: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    """Links of a long list: each member with those of its neighbours that are members."""
    ordered = np.sort(prints)
    bits = [np.uint64(1) << np.uint64(8 * p + b) for p in free for b in range(8)]
    out = []
    for n in range(1, RADIUS + 1):
        for some in combinations(bits, n):
            mask = reduce(np.bitwise_or, some)
            near = ordered ^ mask
            at = np.minimum(np.searchsorted(ordered, near), len(ordered) - 1)
            found = (ordered[at] == near) & (ordered < near)
            if found.any():
                out.append(np.stack([ordered[found], near[found]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def compared(prints: np.ndarray) -> np.ndarray:
    """Links of a list: shared positional bytes are tallied for each pair, pairs that reach the minimum are verified."""
    out = []
    for at in range(0, len(prints), 256):
        rest = prints[at:]
        block = rest[:256, None] ^ rest[None, :]
        tally = (block.view(np.uint8).reshape(*block.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(np.triu(tally >= SHARED, 1))
        near = np.bitwise_count(block[i, j]) <= RADIUS
        out.append(np.stack([rest[i[near]], rest[j[near]]], axis=1))
    return np.concatenate(out)


def positional(prints: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    return prints & np.uint64(reduce(lambda m, p: m | 0xFF << 8 * p, positions, 0))


def divided(prints: np.ndarray, shared: tuple[int, ...]) -> np.ndarray:
    """Links of a long list whose members share some positions: lists by two positions more, and neighbours where these are long, too."""
    out = [np.empty((0, 2), np.uint64)]
    for more in combinations([p for p in range(8) if p not in shared], SHARED - len(shared)):
        key = positional(prints, more)
        by = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[by], prepend=key[by[0]] ^ np.uint64(1), append=key[by[-1]] ^ np.uint64(1)))
        free = tuple(p for p in range(8) if p not in (*shared, *more))
        for i in np.flatnonzero(np.diff(edges) > 1).tolist():
            members = prints[by[edges[i] : edges[i + 1]]]
            out.append(compared(members) if len(members) <= LONG else neighbours(members, free))
    return np.concatenate(out)


def forest(links: np.ndarray) -> np.ndarray:
    """Links that connect what `links` connect, one fewer than the members of each component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for a, b in links.tolist():
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def list_links(number: int, prints: np.ndarray) -> np.ndarray:
    links = compared(prints) if len(prints) <= LONG else divided(prints, LISTS[number])
    return links if len(links) < len(prints) else forest(links)


def small_links(prints: np.ndarray) -> np.ndarray:
    """Links of lists of equal length, a row each."""
    out = []
    for i, j in combinations(range(prints.shape[1]), 2):
        differ = prints[:, i] ^ prints[:, j]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = (tally >= SHARED) & (np.bitwise_count(differ) <= RADIUS)
        out.append(np.stack([prints[near, i], prints[near, j]], axis=1))
    return np.concatenate(out)


def index_links(batches):
    """Links of the lists, whose rows (list, bytes, print) come in order; a list may go on in the next batch."""

    def links(numbers: np.ndarray, key: np.ndarray, prints: np.ndarray):
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (numbers[1:] != numbers[:-1]), [True]]))
        sizes = np.diff(edges)
        for n in np.unique(sizes[(sizes > 1) & (sizes <= 8)]).tolist():
            yield small_links(prints[edges[:-1][sizes == n][:, None] + np.arange(n)])
        for i in np.flatnonzero(sizes > 8).tolist():
            yield list_links(int(numbers[edges[i]]), prints[edges[i] : edges[i + 1]])

    def packed(held: list[tuple]):
        pairs = np.concatenate([np.empty((0, 2), np.uint64), *links(*(np.concatenate(c) for c in zip(*held)))])
        if len(pairs):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    held: list[tuple] = []  # rows of the list that is open
    for batch in batches:
        if not len(batch):
            continue
        numbers, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cols = numbers, key, batch.column(2).to_numpy().view(np.uint64)
        other = np.flatnonzero((key != key[-1]) | (numbers != numbers[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or (held[-1][0][-1], held[-1][1][-1]) != (numbers[0], key[0])):
            yield from packed([*held, tuple(c[:cut] for c in cols)])
            held = []
        elif cut:
            yield from packed([tuple(c[:cut] for c in cols)])
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield from packed(held)


def near_links(distinct: DataFrame, column: str = "print") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius, enough to connect all that are connected."""
    rows = distinct.select(F.col(column).alias("print"), F.explode(F.array(*(list_key(i, F.col(column)) for i in range(len(LISTS))))).alias("k"))
    lists = rows.select("k.list", "k.bytes", "print").repartition("list", "bytes").sortWithinPartitions("list", "bytes")
    return map_batches(lists, index_links, "a long, b long").distinct()


def components(links: DataFrame, most: int = 64) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star steps; roots themselves are left out."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, both.a == low.n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small_low.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        small = linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        after = staged(small)
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() for x in (edges, after)]
        edges = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """One row for each row: the id, fingerprint (16 hexadecimal digits) and component_id (smallest id reachable)."""
    prints = staged(fingerprints(df, id_col, text_col, k))
    distinct = prints.groupBy("print").agg(F.min(id_col).alias("least"))
    roots = components(near_links(distinct))
    joined = distinct.join(roots, distinct.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    found = staged(joined)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # Rows of one fingerprint are dealt to several tasks, and so each fingerprint's answer stands once for each.
    by_print = found.join(least, "root").select("print", "component_id", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(by_print, ["print", "_salt"]).select(id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """The rows of `df` that stay when each group keeps one: the one of the smallest id (null last), and one of them if that is repeated."""
    names = {c.lower() for c in df.columns}
    row, print_ = (next(x for x in (stem + "_" * n for n in range(1, len(names) + 2)) if x.lower() not in names) for stem in ("row", "print"))

    def work(batches):
        for batch in batches:
            texts = encoded(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()))
            prints = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, print_])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    full = staged(map_batches(df, work, f"{schema}, {print_} long").withColumn(row, F.monotonically_increasing_id()))
    distinct = full.select(F.col(print_).alias("print")).distinct()
    roots = components(near_links(distinct))
    by_print = distinct.join(roots, distinct.print == roots.node, "left").select(F.col("print").alias(print_), F.coalesce("root", "print").alias("_root"))
    rank = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("y"), F.col(row).alias("z"))
    first = full.select(print_, id_col, row).join(by_print, print_).groupBy("_root").agg(F.min(rank).alias("r")).select(F.col("r.z").alias(row))
    return full.join(first, row, "left_semi").select(*df.columns)
