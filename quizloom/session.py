"""Things every operator needs from the running session."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files are deleted when it ends.
SHUFFLES_DELETED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key that holds more than 1/HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 4096
#: Rows of its main table for each partition that a query shuffles (see sized).
ROWS_A_PARTITION = 400_000
#: Largest number of integer ids that may be broadcast (8 bytes each, about 40 MB as a hash relation).
BROADCAST_IDS = 500_000
#: Largest number of rows with a word or two that may be broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quizloom-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of this name in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_open = threading.local()


def _scopes() -> list[set[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ends with the innermost scope."""
    path = scratch_path(spark, name)
    if _scopes():
        _scopes()[-1].add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, and safe when executors are lost.

    The table is deleted at the end of the innermost scope, or by release. The shuffles by which it was computed are deleted at
    once, and not when the driver happens to collect its garbage, so the disk holds those of one table at a time.
    """
    spark = df.sparkSession
    path, before = own_path(spark, "cut"), spark.conf.get(SHUFFLES_DELETED, None)
    spark.conf.set(SHUFFLES_DELETED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_DELETED)
        else:
            spark.conf.set(SHUFFLES_DELETED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by cut; nothing that is still to be computed may read them."""
    for df in tables:
        delete_path(df.sparkSession, df._cut_path)
        for paths in _scopes():
            paths.discard(df._cut_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what cut and own_path made inside when it ends, also by an error."""
    _scopes().append(set())
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete_path(spark, path)


def scoped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is one table of the shared folder; all tables that f made on its way are deleted.

    The result's table belongs to the scope around the call, or to the caller where there is none. f's first DataFrame or
    session among its arguments gives the session.
    """

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        first = next(x for x in [*args, *kwargs.values()] if isinstance(x, (DataFrame, SparkSession)))
        spark = first if isinstance(first, SparkSession) else first.sparkSession
        with scope(spark):
            out = cut(f(*args, **kwargs))
            _scopes()[-1].discard(out._cut_path)
        if _scopes():
            _scopes()[-1].add(out._cut_path)
        return out

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(table: str) -> Callable:
    """A scoped query (spark, sf_dir) with shuffles of so many partitions that each has ROWS_A_PARTITION rows of table at most.

    So what a task sorts or gathers does not grow with the table; the session's own number holds where it is larger.
    """

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = "spark.sql.shuffle.partitions"
            before = spark.conf.get(key)
            spark.conf.set(key, str(max(int(before), -(-read_table(spark, sf_dir, table).count() // ROWS_A_PARTITION))))
            try:
                return f(spark, sf_dir)
            finally:
                spark.conf.set(key, before)

        return run

    return wrap


def small_ids(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint on ids (one integer column, already cut) where their counted number is within the bound."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def few_rows(rows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on rows of bounded width (already cut) where their counted number is within the bound."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is not among ids; a hash join while ids are few, else a shuffled one."""
    return df.join(small_ids(ids), key, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is among ids; a hash join while ids are few, else a shuffled one."""
    return df.join(small_ids(ids), key, "left_semi")


def look_up(left: DataFrame, groups: DataFrame, key: str, count: str, values: list[str], total: int) -> DataFrame:
    """left with groups' values by key, where groups has one row a key and the key's number of left rows in count.

    Keys with more than total / HOT_SHARE rows are fewer than HOT_SHARE, so they are broadcast whatever the input's
    size, and their rows go to the shuffled join scattered and without a key. Values must be of bounded size; for others
    see spread. Rows with a null key get nulls.
    """
    line = max(1, total // HOT_SHARE)
    # _cold_part is always 0, in a form that is not folded: as a constant it would leave _part out of the join's keys
    hot = groups.where(F.col(count) > line).select(key, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = groups.where(F.col(count) <= line).select(F.col(key).alias("_cold_key"), F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias("_cold_part"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    out = left.join(F.broadcast(hot), key, "left")
    scattered = F.coalesce(F.col("_hot"), F.col(key).isNull())
    # by the row's content and place, so that a task that is run again deals its rows out alike
    place = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(9973)).cast("int")
    out = out.withColumn("_part", F.when(scattered, F.lit(1) + place).otherwise(F.lit(0)))
    out = out.withColumn("_join_key", F.when(~scattered, F.col(key)))
    out = out.join(cold, (F.col("_join_key") == F.col("_cold_key")) & (F.col("_part") == F.col("_cold_part")), "left")
    return out.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values])


def spread(left: DataFrame, right: DataFrame, key: str, total: int, least: int = 1024) -> DataFrame:
    """The inner join of left (many rows a key) with right (one row a key, of any size), total being left's rows.

    A key with more than total / HOT_SHARE rows (and more than least) is split into so many parts that none has more, and
    right's row is there once for each part. What is broadcast is the number of parts of fewer than HOT_SHARE keys.
    """
    line = max(least, total // HOT_SHARE)
    parts = F.ceil(F.col("_n") / line).cast("int").alias("_parts")
    hot = F.broadcast(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > line).select(key, parts))
    n = F.coalesce(F.col("_parts"), F.lit(1))
    many = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("_parts")
    one = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return many.join(one, [key, "_salt"]).drop("_salt")
