"""Scratch tables end with their scope."""

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quizloom import session
from quizloom.plans import registry
from quizloom.session import cut, scope, scoped


def there(df):
    return os.path.exists(urlparse(df._cut_path).path)


def test_scope_deletes_its_tables(spark):
    with scope(spark):
        a = cut(spark.range(3))
        assert there(a)
    assert not there(a)
    with pytest.raises(ValueError), scope(spark):
        b = cut(spark.range(3))
        raise ValueError
    assert not there(b)


def test_scoped_keeps_only_the_result(spark):
    made = []

    @scoped
    def twice(df):
        made.append(cut(df))
        return made[0].unionByName(made[0])

    out = twice(spark.range(3))
    assert out.count() == 6 and there(out) and not there(made[0])
    made.clear()
    with scope(spark):
        inner = twice(spark.range(2))
        assert inner.count() == 4
    assert not there(inner)


@pytest.mark.parametrize("name", ["bank_questions", "relabelled_lines", "repeats_ranked", "clusters_spanning_sets"])
def test_shuffles_have_partitions_by_their_rows(spark, sf, monkeypatch, name):
    """However large its table, no partition has more rows than it may; the session's number is as it was afterwards."""
    seen, real = [], session.cut
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 100)
    monkeypatch.setattr(session, "cut", lambda df: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert registry.queries()[name](spark, sf).count() > 0
    assert set(seen) == {-(-rows // 100)} and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_table_leaves_no_shuffle_files(spark):
    """What was shuffled for a table is gone soon after it is written, and the session's setting is as it was."""
    files = lambda: {x.rsplit("/", 1)[-1] for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    setting, before = spark.conf.get(session.SHUFFLES_DELETED, None), files()
    held = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert held.columns == ["k", "count"] and spark.conf.get(session.SHUFFLES_DELETED, None) == setting
