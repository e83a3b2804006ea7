"""What operators leave on disk while their result is read."""

import pytest
from pyspark.sql import functions as F

from merganser.llm import near_copies, shared, suffix_dedup

PASSAGE = " ".join(f"w{i}" for i in range(200))


def docs(spark):
    return spark.createDataFrame([(i, f"{i} begins here. {PASSAGE} and ends {i}") for i in range(6)], "doc_id long, text string")


def left(spark, work):
    """The columns of what was staged meanwhile and still stands."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared.run_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().toString() for x in fs.listStatus(path)} if fs.exists(path) else set()
    before = names()
    out = work()
    return out, [set(spark.read.parquet(x).columns) for x in names() - before]


def test_suffix_dedup_leaves_no_blocks_and_no_contents(spark):
    out, there = left(spark, lambda: suffix_dedup.dedup(docs(spark), length=100))
    assert there and not any(c & {"blocks", "content", "left", "right"} for c in there)
    rows = out.collect()
    assert len(rows) == 6 and all(r.n_removed >= len(PASSAGE) for r in rows)


def test_near_copies_leave_no_lists(spark):
    out, there = left(spark, lambda: near_copies.one_of_each(docs(spark).withColumn("lang", F.lit("en"))))
    assert not any(c & {"key", "least"} for c in there)
    assert [r.doc_id for r in out.collect()] == [0]


def test_rows_by_number_are_those_of_a_join(spark):
    """Several partitions, first and last numbers, numbers named twice, and more bitmaps than may go to every task."""
    rows = shared.staged(spark.range(0, 100_000, 1, 3).select("id", F.monotonically_increasing_id().alias("_row")))
    few = rows.filter("id % 7 = 3 or id in (0, 32767, 32768, 99999)")
    want = sorted(r.id for r in few.collect())
    with pytest.MonkeyPatch.context() as m:
        for most in (shared.BITMAPS, 1):
            m.setattr(shared, "BITMAPS", most)
            got = shared.numbered(rows, few.union(few))
            assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == want
    assert shared.numbered(rows, few.limit(0)).count() == 0


def test_near_copies_shuffle_no_texts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = near_copies.one_of_each(docs(spark).withColumn("lang", F.lit("en")))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
        assert [r.doc_id for r in out.collect()] == [0]
    finally:
        spark.conf.set(key, before)


def test_an_entry_of_many_pairs_is_named_once(spark):
    """Entry 0 has pairs with all others: its number is dealt out once, not once a pair."""
    entries = spark.range(40).selectExpr("id as _row", "id as _size")
    pairs = spark.range(1, 40).selectExpr("0L as a", "id as b")
    asked = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_copies, "numbered", lambda df, numbers: asked.append(sorted(r._row for r in numbers.collect())) or shared.numbered(df, numbers))
        out = near_copies.by_blocks(pairs, entries, ["_size"], lambda a, b, held: [i for i, x in enumerate(held["_size"].take(b).to_pylist()) if x % 2])
    assert asked == [list(range(40))]
    assert sorted(r.b for r in out.collect()) == list(range(1, 40, 2)) and out.filter("a != 0").count() == 0
