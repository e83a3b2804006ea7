"""What the operators of this package share: staging, Arrow batches and white space.

A *word* everywhere here is a maximal run of characters other than U+0020 and U+0009 to U+000D. Those six are
single bytes in UTF-8 and the very set `bytes.split()` splits on, so words are split on encoded text.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of this machine, by application, where the session names no shared one (tests).
LOCAL: dict[str, str] = {}
#: Applications whose run folder goes when the driver ends.
LEAVING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines of the cluster see; a folder of this machine only where the setting is unset (tests)."""
    name = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return name or LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="staged-"))


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends, or with `released`."""
    app = spark.sparkContext.applicationId
    if app not in LEAVING:
        LEAVING.add(app)
        atexit.register(released, spark)
    return f"{shared_dir(spark).rstrip('/')}/run-{app}"


def released(spark: SparkSession) -> None:
    """Deletes all that was staged by this application. Results that haven't been read yet are lost with it."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as e:  # the session may have ended before
        if spark.sparkContext._jsc is not None:
            raise e


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the run folder and read again: later steps don't compute it anew, and a lost executor loses nothing.

    Spark deletes the shuffle files of a finished step when the driver has collected its plan, which a driver with room to spare does late; so that is asked for here.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them is staged itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]):
    """A function for `mapInArrow`: `make()` runs once a task and returns what is done with each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return run


#: Bytes of a batch that goes to Python at once: with the lists and arrays made of it, a few times this much memory.
BATCH = 8 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """`mapInArrow` with batches bounded in bytes: the session's limit is lowered to `BATCH` if it is higher or unset.

    The plan reads that setting when it runs, which is after this returns, so the setting stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH:
        conf.set(key, str(BATCH))
    return df.mapInArrow(run, schema)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names, where null matches null; `right` adds its other columns."""
    renamed = right.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*(f"_right_{k}" for k in keys))


#: Parts that rows of one key are dealt to.
SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join where one key may hold a great part of `left`: its rows are dealt to `SALTS` tasks, and `right`, of one row a key, stands once for each. Keys aren't null."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    each = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return dealt.join(each, [*keys, "_salt"]).drop("_salt")


#: Numbers that one bitmap of 4 KB holds, as a power of two, and bitmaps that go to every task at most.
SPAN, BITMAPS = 15, 10_000


def numbered(df: DataFrame, numbers: DataFrame, column: str = "_row") -> DataFrame:
    """The rows of `df` whose number is among `numbers`, a left semi-join: numbers go to the tasks that read `df` as bitmaps, so that `df` isn't shuffled.

    Numbers are not negative and dense in stretches, as those of `monotonically_increasing_id` are. Where they take too many bitmaps, it is the plain join.
    """
    number = numbers.select(column)
    bits = number.select(F.shiftright(column, SPAN).alias("_span"), F.col(column).bitwiseAND((1 << SPAN) - 1).alias("_bit"))
    maps = staged(bits.repartition("_span").groupBy("_span").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    if maps.count() > BITMAPS:
        dropped(maps)
        return df.join(number, column, "left_semi").select(*df.columns)
    byte = f"cast(conv(hex(substring(_bits, cast((`{column}` & {(1 << SPAN) - 1}) div 8 + 1 as int), 1)), 16, 10) as int)"
    found = df.join(F.broadcast(maps), F.shiftright(df[column], SPAN) == maps["_span"])
    return found.filter(F.expr(f"getbit({byte}, cast(`{column}` & 7 as int)) = 1")).select(*(df[c] for c in df.columns))
