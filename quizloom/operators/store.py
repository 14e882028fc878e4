"""The verbs of a document store on DataFrames: one row a document, updates merged in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_doc(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == value)


def where(table: DataFrame, field: str, op: str, value: object) -> DataFrame:
    """One condition: ==, array-contains, or array-contains-any."""
    if op == "==":
        return table.where(F.col(field) == value)
    if op == "array-contains":
        return table.where(F.array_contains(field, value))
    if op == "array-contains-any":
        return table.where(F.arrays_overlap(field, F.array(*map(F.lit, value))))
    raise ValueError(f"unknown condition {op}")


def order_by(table: DataFrame, field: str, direction: str = "asc", tie: str | None = None) -> DataFrame:
    """Documents without the field are left out."""
    order = F.col(field).desc() if direction == "desc" else F.col(field).asc()
    return table.where(F.col(field).isNotNull()).orderBy(order, *([tie] if tie else []))


def limit(table: DataFrame, n: int, most: int = 50) -> DataFrame:
    if n > most:
        raise ValueError(f"a list of more than {most} is refused")
    return table.limit(n)


def merge_maps(old: Column, new: Column) -> Column:
    """Fields of new over those of old; a field whose new value is null is deleted."""
    both = F.map_zip_with(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def upsert(table: DataFrame, updates: DataFrame, key: str, fields: str) -> DataFrame:
    """table (key, map of fields) with updates (key, map) merged in: new documents come, old ones are merged."""
    new = updates.select(key, F.col(fields).alias("_new"))
    out = table.join(new, key, "full")
    merged = F.when(F.col("_new").isNull(), F.col(fields)).otherwise(merge_maps(F.col(fields), F.col("_new")))
    return out.select(key, merged.alias(fields))


def increments(table: DataFrame, changes: DataFrame, key: str, amount: str) -> DataFrame:
    """table (key, amount) with changes (key, amount) added, however many a key has."""
    return table.select(key, amount).unionByName(changes.select(key, amount)).groupBy(key).agg(F.sum(amount).alias(amount))


def array_unions(table: DataFrame, changes: DataFrame, key: str, field: str) -> DataFrame:
    """table (key, array) with the elements of changes (key, array) added that are not there yet; new documents come.

    Elements are brought together one a row, so a key with many changes is combined before the exchange; they come out sorted.
    """
    every = table.select(key, field).unionByName(changes.select(key, field))
    kept = every.select(key, F.explode_outer(field).alias("_x")).distinct()
    return kept.groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias(field))


def claims(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of rows that claim a name at once, the first of each name; the rest is refused."""
    rest = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(name, "_row.*")


def latest(rows: DataFrame, keys: list[str], stamp: list[str], deleted: str) -> DataFrame:
    """The last write of each key by stamp; keys whose last write deletes are gone (later stamps may bring them back)."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*stamp)).alias("_row")).select(*keys, "_row.*")
    return last.where(~F.col(deleted))
