"""Decisions of a dedup operator carried out on whole rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.session import cut, with_ids, without_ids


def settle(docs: DataFrame, decided: DataFrame, columns: list[str], keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """These columns of docs without the rows that decided drops.

    decided (cut) has doc_id, row_key, stays: rows that go (stays is false), and rows that are there several times of which
    one stays. keyed adds row_key to rows of docs. Only rows whose id is named, or null, are keyed; all others pass as they are.
    """
    own = docs.select(*columns)
    ids = cut(decided.where("doc_id IS NOT NULL").select("doc_id").distinct())
    named, null = own.where("doc_id IS NOT NULL"), own.where("doc_id IS NULL")
    rows = keyed(with_ids(named, ids, "doc_id").unionByName(null))
    told = decided.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "stays")
    rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    free = rows.where("stays IS NULL").select(*columns)
    # groups of rows equal in id and key: the aggregate keeps one struct of each, before and after its exchange
    least = rows.where("stays").groupBy("doc_id", "row_key").agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    return without_ids(named, ids, "doc_id").unionByName(free).unionByName(least)
