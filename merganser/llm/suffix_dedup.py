"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts elsewhere in the corpus.

All starts are judged, on the input as it is. To sort no more suffixes than needed, each start is put under an anchor: the
place of the smallest hash among the grams of `GRAM` bytes inside its string. Equal strings have equal anchors at
equal offsets, so starts only ever meet under equal grams. Consecutive starts of one anchor form a block, whose content is the bytes of the
document that their strings cover: those left of the anchor, and the suffix that begins at it. Hashes only bring together and name contents; what is equal is decided by bytes.

1. Every document yields its blocks: gram, name of the content, place. Grams that occur once leave.
2. The bytes of the blocks that stay are fetched. Equal contents are counted by their bytes, with sums on the way, so a passage that a third of all documents share is a few rows a task;
   a content that occurs again is covered whole.
3. Contents of a gram of several are suffixes to compare. They are range-partitioned by their leading bytes with sampled splitters; equal leading bytes share a
   bucket, so what a boundary parts differs within the leading bytes, and each bucket checks that its suffixes come in order.
4. A bucket sorts its suffixes by multikey quicksort, eight bytes a step, and the mirrored left sides likewise. Common prefixes of
   neighbours give, for each offset, classes of equal left parts and of equal right parts; starts that agree in both are repeats.
5. A gram with more contents than `CROWD` is no bucket: its range is split by the bytes that follow and precede. Offsets are halved; starts of one half agree in more bytes around the anchor
   if they are equal, and contents are dealt anew by these, until a part is small enough for a bucket, is one content, or is alike throughout.
6. Ranges go back to all documents that hold the content.

Several lengths can be asked for at once: anchors are then chosen in strings of the smallest.

Null text is empty. Texts shorter than a length keep all. Repeated rows are copies of each other, and so are covered; rows are told apart by
id and text, with null ids among them. Removed runs may begin or end inside a character; `dedup_text` leaves such a
character whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.shared import dropped, encoded, map_batches, matched, per_batch, salted_join, staged

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of the grams among which anchors are chosen.
GRAM = 64
#: Contents beyond which the range of a gram is split.
CROWD = 20_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
#: For powers of BASE mod 2^64 without a loop.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_codes(seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64)


class Rolling:
    """Hashes of all strings of one length in a byte array."""

    def __init__(self, seed: int):
        self.codes, self.up, self.down = byte_codes(seed), powers(BASE, CHUNK), powers(INVERSE, CHUNK)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.codes[data] * self.up[:n], out=sums[1:])
        out = (sums[length:] - sums[: n + 1 - length]) * self.down[: n + 1 - length]
        out ^= out >> np.uint64(32)
        return out * BASE


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row: a prefix and a suffix minimum within pieces of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    pieces = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(pieces, axis=1).ravel()
    behind = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


PLACE = np.uint64(24)


def blocks(data: np.ndarray, rolling: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a byte array of less than 2^24 bytes: first start, number of starts and anchor of each block."""
    hashes = rolling(data, gram)
    ranked = (hashes >> PLACE << PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (sliding_min(ranked, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return first, np.diff(np.append(first, len(anchors))), anchors[first]


def batches_of(texts: list[bytes], length: int, most: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """Texts put together into arrays of about `CHUNK` bytes, a long text in several that overlap: (row, offset in the text, begin, end, bytes known beyond the end) in each.

    Starts of strings of `length` bytes up to `end` are judged in the array; their strings of `most` bytes may need the bytes beyond.
    """
    parts, held, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + most - 1]
            if len(piece) < length:
                continue
            judged = min(len(piece), CHUNK + length - 1)
            held.append((row, at, size, size + judged, len(piece) - judged))
            parts.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), held
                parts, held, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), held


BLOCK_FIELDS = "text_hash long, n_bytes long, sha256 string, blocks array<struct<start:int,starts:int,offset:int,gram:long,content:long>>"
BLOCK_TYPE = pa.struct([("start", pa.int32()), ("starts", pa.int32()), ("offset", pa.int32()), ("gram", pa.int64()), ("content", pa.int64())])


def document_blocks(df: DataFrame, id_col: str, text_col: str, lengths: list[int], gram: int) -> DataFrame:
    """One row for each row: id, text_hash, n_bytes, sha256 of the text, and its blocks."""
    length, most = min(lengths), max(lengths)

    def make():
        choose, wide = Rolling(1), Rolling(2)

        def work(batch: pa.RecordBatch):
            texts = encoded(batch.column(1))
            rows, cols = [], []
            for data, held in batches_of(texts, length, most):
                first, n, anchor = blocks(data, choose, length, gram)
                last = first + n
                grams = wide(data, gram)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(wide.codes[data] * wide.up[: len(data)])])
                for row, at, begin, end, ahead in held:
                    a, b = np.searchsorted(last, begin, "right"), np.searchsorted(first, end - length, "right")
                    f, g, an = np.maximum(first[a:b], begin), np.minimum(last[a:b], end - length + 1), anchor[a:b]
                    starts, until = g - f, np.minimum(g + most - 1, end + ahead)
                    content = (sums[until] - sums[f]) * wide.down[f]
                    content = (content ^ (content >> np.uint64(29))) * BASE + starts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (an - f).astype(np.uint64) + (until - f).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                    rows.append(np.full(len(f), row))
                    cols.append((f - begin + at, starts, an - f, grams[an].view(np.int64), content.view(np.int64)))
            of = np.concatenate(rows) if rows else np.empty(0, np.int64)
            fields = [np.concatenate([c[i] for c in cols]) if cols else np.empty(0, np.int64) for i in range(5)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
            structs = pa.StructArray.from_arrays([pa.array(x).cast(t.type) for x, t in zip(fields, BLOCK_TYPE)], fields=list(BLOCK_TYPE))
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0), "text_hash": batch.column(2), "n_bytes": pa.array(map(len, texts), pa.int64()),
                "sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "blocks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
            })

        return work

    text = F.col("_text")
    few = df.select(df[id_col], df[text_col].cast("string").alias("_text")).withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, {BLOCK_FIELDS}")


def text_bytes(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text_hash, _bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(id_col, F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("_bytes"))


def words8(buffer: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do, zero beyond the end."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        inside = at + k < end
        out = out << np.uint64(8) | np.where(inside, buffer[np.minimum(at + k, len(buffer) - 1)], 0).astype(np.uint64)
    return out


def multikey_sort(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings buffer[begin:end], and the length of the prefix each shares with the one before it.

    Multikey quicksort, a column of eight bytes at a time: members of a run of equal columns so far are ordered by the
    next column; runs of one are done.
    """
    n = len(begin)
    order, shared = np.arange(n), np.zeros(n, np.int64)
    places, run = np.arange(n), np.zeros(n, np.int64)
    depth = 0
    while len(places):
        members = order[places]
        at = begin[members] + depth
        key = words8(buffer, at, end[members])
        by = np.lexsort((np.minimum(end[members] - at, 8), key, run))
        order[places] = members = members[by]
        key, left = key[by], np.minimum(end[members] - begin[members] - depth, 8)
        same_run = np.concatenate([[False], run[1:] == run[:-1]])
        differ = np.concatenate([[np.uint64(0)], key[1:] ^ key[:-1]])
        both = np.minimum(left, np.concatenate([[0], left[:-1]]))
        bits = np.frompyfunc(int.bit_length, 1, 1)(differ).astype(np.int64) if len(differ) < 64 else bit_lengths(differ)
        common = np.minimum((64 - bits) // 8, both)
        shared[places[same_run]] = depth + common[same_run]
        equal = same_run & (differ == 0) & (both == 8)
        new = np.cumsum(~equal)
        stay = equal | np.append(equal[1:], False)
        places, run = places[stay], new[stay]
        depth += 8
    return order, shared


def bit_lengths(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x), np.int64), x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        high = x >= np.uint64(1) << np.uint64(s)
        out[high] += s
        x[high] >>= np.uint64(s)
    return out + (x > 0)


def repeated_starts(contents: list[tuple[bytes, bytes]], starts: np.ndarray, lengths: list[int], low: np.ndarray, high: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each content (left of the anchor, from the anchor on) of a bucket, its starts whose strings stand in another content of the bucket as well, as runs (which length, first, last).

    A start is `d` bytes left of its anchor: its string is the d bytes before and the length - d bytes from it on. Only offsets from `low` to `high` are judged.
    """
    n = len(contents)
    offset = np.fromiter((len(a) for a, _ in contents), np.int64, n)
    sizes = offset + np.fromiter((len(b) for _, b in contents), np.int64, n)
    buffer = np.frombuffer(b"".join(x for pair in contents for x in pair), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    anchor = base + offset
    right_order, right_shared = multikey_sort(buffer, anchor, base + sizes)
    mirrored = np.ascontiguousarray(buffer[::-1])
    left_order, left_shared = multikey_sort(mirrored, len(buffer) - anchor, len(buffer) - base)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for which, length in enumerate(lengths):
        far, near = np.minimum(offset, high), np.maximum(offset - np.minimum(starts, sizes - length + 1) + 1, low)
        found: list[np.ndarray] = []
        for d in range(max(0, int(near.min())), int(far.max()) + 1):
            have = np.flatnonzero((near <= d) & (d <= far))
            left[left_order] = np.cumsum(left_shared < d)
            right[right_order] = np.cumsum(right_shared < length - d)
            key = left[have] * (n + 1) + right[have]
            by = np.argsort(key, kind="stable")
            same = np.diff(key[by]) == 0
            hit = np.concatenate([[False], same]) | np.append(same, False) if len(have) else np.empty(0, bool)
            if hit.any():
                rows = have[by[hit]]
                found.append(np.stack([rows, offset[rows] - d]))
        if found:
            rows, at = np.concatenate(found, axis=1)
            by = np.lexsort((at, rows))
            rows, at = rows[by], at[by]
            new = np.flatnonzero((np.diff(rows) != 0) | (np.diff(at) > 1)) + 1
            for a, b in zip(np.concatenate([[0], new]).tolist(), np.append(new, len(at)).tolist()):
                out[rows[a]].append((which, int(at[a]), int(at[b - 1])))
    return out


FOUND = "array<struct<which:int,first:int,last:int>>"
FOUND_TYPE = pa.list_(pa.struct([("which", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))


def bucket_repeats(lengths: list[int], limit: int = 16 << 20):
    """For a range partition whose rows (gram, content, starts, low, high, group, left, right) come in order of `group`: repeats within each group, as rows (gram, content, found).

    A whole number of groups is compared at a time, up to `limit` bytes unless one group has more; its size is bounded by `CROWD`.
    """

    def run(batches):
        held: list[tuple] = []

        def emit(rows):
            if len({r[:2] + r[3:5] for r in rows}) < len(rows):
                raise ValueError("two contents of one name")
            starts, low, high = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
            found = repeated_starts([r[6:8] for r in rows], starts, lengths, low, high)
            some = [(r[0], r[1], [dict(zip(("which", "first", "last"), x)) for x in f]) for r, f in zip(rows, found) if f]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, t in enumerate((pa.int64(), pa.int64(), FOUND_TYPE))], names=["gram", "content", "found"])

        size, group = 0, []  # a group of one content has nothing to be compared with
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[5] != group[-1][5]:
                    if row[5] < group[-1][5]:
                        raise ValueError("a bucket isn't in order")
                    if len(group) > 1:
                        held += group
                        size += sum(len(r[6]) + len(r[7]) for r in group)
                    group = []
                    if size >= limit:
                        yield emit(held)
                        held, size = [], 0
                group.append(row)
        held += group
        if len(held) > 1:
            yield emit(held)

    return run


def in_buckets(rows: DataFrame, lengths: list[int]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.select("gram", "content", "starts", "low", "high", "group", "left", "right")
    return map_batches(few.repartitionByRange(parts, "group").sortWithinPartitions("group"), bucket_repeats(lengths), f"gram long, content long, found {FOUND}")


def tail(column: str, n) -> F.Column:
    """The last n bytes; none if n is 0."""
    return F.expr(f"substring({column}, greatest(octet_length({column}) - ({n}), 0) + 1, {n})")


def crowded_repeats(rows: DataFrame, which: int, length: int, widest: int, crowd: int) -> list[DataFrame]:
    """(gram, content, found) for the contents (gram, content, starts, left, right) of crowded grams, for one length.

    A part is a range of offsets low..high and the bytes around the anchor that any two equal starts of such offsets share: `low` before, length - high from it on.
    """
    out: list[DataFrame] = []
    far = "octet_length(left)"
    near = f"({far} - least(starts, {far} + octet_length(right) - {length} + 1) + 1)"
    parts = rows.withColumns({"low": F.lit(0), "high": F.lit(widest)})
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        parts = parts.withColumn("half", F.explode(halves)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")}).drop("half").filter("low <= high")
        parts = parts.filter(f"{near} <= high and {far} >= low")
        group = F.concat(F.lpad(F.hex("low"), 4, "0").cast("binary"), F.lpad(F.hex("high"), 4, "0").cast("binary"), tail("left", "low"), F.expr(f"substring(right, 1, {length} - high)"))
        covers = F.expr(f"{near} <= low and {far} >= high")
        whole = F.when(covers, F.concat(tail("left", "high"), F.expr(f"substring(right, 1, {length} - low)"))).otherwise(F.lit(b""))
        parts = staged(parts.withColumns({"group": group, "whole": whole}))
        of = parts.groupBy("group").agg(F.count("*").alias("size"), F.min("whole").alias("a"), F.max("whole").alias("b"))
        of = staged(of.filter("size > 1").select("group", "size", F.expr("a = b and octet_length(a) > 0").alias("alike")))
        known = staged(salted_join(parts.drop("whole"), of, ["group"]))
        first, last = F.greatest(F.lit(0), F.expr(f"{far} - high")), F.expr(f"{far} - greatest(low, {near})")
        run = F.struct(F.lit(which).alias("which"), first.cast("int").alias("first"), last.cast("int").alias("last"))
        out.append(known.filter("alike or low = high").select("gram", "content", F.array(run).alias("found")))
        rest = known.filter("not alike and low < high")
        bucket = in_buckets(rest.filter(F.col("size") <= crowd), [length])
        out.append(bucket.withColumn("found", F.transform("found", lambda x: F.struct(F.lit(which).alias("which"), x["first"].alias("first"), x["last"].alias("last")))))
        parts = rest.filter(F.col("size") > crowd).drop("size", "alike", "group")
        if parts.isEmpty():
            return out


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def covered_starts(df: DataFrame, id_col: str, text_col: str, lengths: list[int], gram: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_bytes, sha256) of each row; (id, text_hash, found) of those with repeated strings, `found` being blocks (start, runs of starts from there). Both are staged."""
    full = staged(document_blocks(df, id_col, text_col, lengths, gram))
    every = full.select(id_col, "text_hash", F.inline("blocks"))
    again = every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    seen = staged(salted_join(every, again, ["gram"]))
    docs = staged(full.drop("blocks"))
    dropped(full)
    wanted = seen.groupBy(id_col, "text_hash").agg(F.collect_set(F.struct("gram", "content", "offset", "starts", "start")).alias("wanted"))
    most = max(lengths)

    def fetch(batches):
        for batch in batches:
            texts, wants = batch.column(0).to_pylist(), batch.column(1)
            flat, ends = wants.flatten(), np.cumsum([0, *pc.list_value_length(wants).to_pylist()])
            start, starts, offset = (flat.field(x).to_numpy() for x in ("start", "starts", "offset"))
            gram_, content = flat.field("gram"), flat.field("content")
            anchor, until = (start + offset).tolist(), (start + starts + (most - 1)).tolist()
            of = np.repeat(np.arange(len(texts)), np.diff(ends)).tolist()
            begin = start.tolist()
            for k in range(0, len(of), 10_000):
                span = range(k, min(k + 10_000, len(of)))
                left, right = ([texts[of[i]][a[i] : b[i]] for i in span] for a, b in ((begin, anchor), (anchor, until)))
                some = slice(k, span.stop)
                yield pa.RecordBatch.from_pydict({"gram": gram_[some], "content": content[some], "starts": pa.array(starts[some]), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})

    texts = text_bytes(df, text_col, id_col)
    fetched = map_batches(matched(texts, wanted, [id_col, "text_hash"]).select("_bytes", "wanted"), fetch, "gram long, content long, starts int, left binary, right binary")
    contents = staged(fetched.groupBy("gram", "content", "starts", "left", "right").agg(F.count("*").alias("n")))
    runs = [F.struct(F.lit(i).alias("which"), F.lit(0).alias("first"), F.expr(f"least(starts, octet_length(left) + octet_length(right) - {x} + 1) - 1").cast("int").alias("last")) for i, x in enumerate(lengths)]
    twins = contents.filter("n > 1").select("gram", "content", F.filter(F.array(*runs), lambda x: x["last"] >= 0).alias("found"))
    widest = min(lengths) - gram
    crowded = staged(contents.groupBy("gram").agg(F.count("*").alias("contents")).filter(F.col("contents") > crowd).select("gram"))
    n_crowded = crowded.count()
    few = contents
    if n_crowded:
        few = contents.join(F.broadcast(crowded) if n_crowded <= 10_000 else crowded, "gram", "left_anti")
    repeated = twins.unionByName(in_buckets(few.withColumns({"low": F.lit(0), "high": F.lit(widest), "group": F.expr(f"substring(right, 1, {gram})")}), lengths))
    if n_crowded:
        crowds = staged(salted_join(contents.drop("n"), crowded, ["gram"]))
        for which, length in enumerate(lengths):
            for found in crowded_repeats(crowds, which, length, widest, crowd):
                repeated = repeated.unionByName(found)
    # A content of several is found in more than one way; its runs go back as one row.
    named = repeated.groupBy("gram", "content").agg(F.flatten(F.collect_list("found")).alias("found"))
    named = staged(named)
    dropped(contents)
    places = salted_join(seen.select(id_col, "text_hash", "start", "gram", "content"), named, ["gram", "content"])
    found = staged(places.groupBy(id_col, "text_hash").agg(F.collect_set(F.struct("start", "found")).alias("found")))
    dropped(seen, named)
    return docs, found


def runs_of(found: pa.ListArray, lengths: list[int]) -> list[list[list[tuple[int, int]]]]:
    """Covered runs of bytes of each row, for each length, from the repeated starts of its blocks; a row may be null."""
    blocks = found.flatten()
    per_row, per_block = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (found, blocks.field("found")))
    flat = blocks.field("found").flatten()
    start = np.repeat(blocks.field("start").to_numpy(zero_copy_only=False), per_block)
    row = np.repeat(np.repeat(np.arange(len(found)), per_row), per_block)
    which, first, last = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("which", "first", "last"))
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in lengths] for _ in range(len(found))]
    for i, length in enumerate(lengths):
        mine = which == i
        of, begin, end = row[mine], (start + first)[mine].astype(np.int64), (start + last)[mine].astype(np.int64) + length
        by = np.lexsort((begin, of))
        of, begin, end = of[by], begin[by], end[by]
        if not len(of):
            continue
        # Rows stand apart by more than any text is long, so that one running maximum serves all.
        apart = of * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + apart)
        new = np.concatenate([[True], (begin + apart)[1:] > reach[:-1]])
        edges = np.flatnonzero(new)
        stop = reach[np.append(edges[1:], len(of)) - 1] - apart[edges]
        for r, a, b in zip(of[edges].tolist(), begin[edges].tolist(), stop.tolist()):
            out[r][i].append((a, b))
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int | None = None, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row for each row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).

    With `passage`, also n_passage: the bytes under strings of that many bytes that start elsewhere, too. These are only counted; what is removed goes by `length`.
    """
    lengths = [length] if passage is None else [length, passage]
    docs, found = covered_starts(df, id_col, text_col, lengths, gram, crowd)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage"] * (passage is not None)

    def finish(batches):
        for batch in batches:
            out = []
            for id_, text, (runs, *rest) in zip(*(batch.column(i).to_pylist() for i in range(2)), runs_of(batch.column(2), lengths)):
                out.append((id_, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest(), *(sum(b - a for a, b in r) for r in rest)))
            types = (batch.schema[0].type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types[: len(names) + 1])], names=[id_col, *names])

    few = matched(text_bytes(df, text_col, id_col), found, [id_col, "text_hash"])
    kind = dict(df.dtypes)[id_col]
    extra = ", n_passage long" * (passage is not None)
    cut = map_batches(few.select(id_col, "_bytes", "found"), finish, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    whole = matched(docs, found.select(id_col, "text_hash"), [id_col, "text_hash"], "left_anti")
    zero = F.lit(0).cast("long")
    whole = whole.select(id_col, "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), *([zero.alias("n_passage")] if passage is not None else []))
    return cut.unionByName(whole)


def dedup_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The rows of `df` with the repeated strings cut out of their texts; a character of which a byte is kept is kept whole. Null text stays null."""
    _, found = covered_starts(df, id_col, text_col, [length], gram, crowd)
    places = [f"_c{i}" for i in range(len(df.columns))]
    lower = [c.lower() for c in df.columns]
    id_, text_ = places[lower.index(id_col.lower())], places[lower.index(text_col.lower())]
    k = places.index(text_)
    plain = df.toDF(*places).withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_).cast("string"), F.lit(""))))
    runs = found.select(F.col(id_col).alias(id_), F.col("text_hash").alias("_hash"), F.col("found").alias("_found"))
    rows = matched(plain, runs, [id_, "_hash"], "left")

    def within(text: bytes, run: tuple[int, int]) -> tuple[int, int]:
        a, b = run
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    def cut(batches):
        for batch in batches:
            texts = []
            for text, (runs,) in zip(batch.column(k).to_pylist(), runs_of(batch.column(batch.num_columns - 1), [length])):
                if text is not None and runs:
                    data = text.encode()
                    text = kept_bytes(data, [within(data, r) for r in runs]).decode()
                texts.append(text)
            columns = batch.columns[:-1]
            columns[k] = pa.array(texts, batch.schema[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.toDF(*places).schema)
    return map_batches(rows.select(*places, "_found"), cut, schema).toDF(*df.columns)
