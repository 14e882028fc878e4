"""Keyed joins and updates on question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canon(q: Column, dup_of: Column, lead: Column) -> Column:
    """The id under which a question counts once: the lead of its constellation, else what it is a copy of, else itself."""
    return F.coalesce(lead, dup_of, q)


def permutation(old: Column, new: Column) -> Column:
    """For each element of old, the number of the first equal element of new (null where there is none)."""
    return F.transform(old, lambda x: F.nullif(F.array_position(new, x), F.lit(0)) - 1)


def twin_match(left: DataFrame, right: DataFrame, id_: str, stem: str, options: str, order: str, prefer_order: bool = True) -> DataFrame:
    """left's rows with match: the id of right's first row (by order) with an equal stem and equal options.

    With prefer_order, options equal in order win over options equal as a multiset; rows without a match get null. Both passes are equi-joins
    on one digest column, aggregated to one candidate a key before they meet.
    """
    exact = F.sha2(F.concat_ws("\x1f", F.col(stem), F.concat_ws("\x1e", F.col(options))), 256)
    loose = F.sha2(F.concat_ws("\x1f", F.col(stem), F.concat_ws("\x1e", F.array_sort(options))), 256)
    one = lambda k, name: right.groupBy(k.alias("_k")).agg(F.min_by(id_, order).alias(name)).withColumnRenamed("_k", f"_key{name}")
    out = left.withColumn("_exact", exact).withColumn("_loose", loose)
    out = out.join(one(loose, "_b"), F.col("_loose") == F.col("_key_b"), "left")
    if not prefer_order:
        return out.select(*left.columns, F.col("_b").alias("match"))
    out = out.join(one(exact, "_a"), F.col("_exact") == F.col("_key_a"), "left")
    return out.select(*left.columns, F.coalesce("_a", "_b").alias("match"))


def guarded_update(rows: DataFrame, fixes: DataFrame, key: str, field: str, also: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """rows with fixes (key, ord, was, becomes) applied in the order of ord, and the fixes whose was did not hold.

    A key's fixes are folded one after another; each applies only if the value is what it expects. A fix that applies sets
    the columns in also, too, to its own values of them, but where those are null.
    """
    folded = fixes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "was", "becomes", *also))).alias("_fixes"))
    joined = rows.join(folded, key, "left")
    start = F.struct(F.col(field).alias("v"), F.array().cast("array<bigint>").alias("bad"), *also)

    def step(a: Column, f: Column) -> Column:
        holds = a["v"].eqNullSafe(f["was"])
        return F.struct(F.when(holds, f["becomes"]).otherwise(a["v"]).alias("v"), F.when(holds, a["bad"]).otherwise(F.array_append(a["bad"], f["ord"].cast("bigint"))).alias("bad"), *[F.when(holds, F.coalesce(f[c], a[c])).otherwise(a[c]).alias(c) for c in also])

    done = joined.withColumn("_done", F.aggregate(F.coalesce("_fixes", F.array().cast(folded.schema["_fixes"].dataType)), start, step))
    out = done.select(*[F.col("_done.v").alias(c) if c == field else F.col(f"_done.{c}") if c in also else F.col(c) for c in rows.columns])
    return out, done.select(key, F.explode("_done.bad").alias("ord"))


def checked_label(rows: DataFrame, checked: DataFrame, id_: str, answer: str, label: str, notes: str, suggested: str) -> DataFrame:
    """rows whose answer is the one in checked (id_, answer) are labelled checked; where a suggestion was checked, its own notes go.

    notes is an array of structs with by. Rows that are not in checked, or whose answer has changed since, stay as they are.
    """
    found = rows.join(checked.select(id_, F.col(answer).alias("_checked")), id_, "left")
    holds = F.coalesce(F.col("_checked") == F.col(answer), F.lit(False))
    kept = F.when(holds & (F.col(label) == suggested), F.filter(notes, lambda x: ~x["by"].eqNullSafe(F.lit(suggested)))).otherwise(F.col(notes))
    return found.withColumns({notes: kept, label: F.when(holds, "checked").otherwise(F.col(label))}).drop("_checked")


def current_of(rows: DataFrame, keys: list[str], id_: str, due: str, today: Column) -> DataFrame:
    """For each of keys, the id that is due first of those whose day has not passed, else the one due last."""
    when = F.struct(due, id_)
    out = rows.groupBy(*keys).agg(F.min_by(id_, F.when(F.col(due) >= today, when)).alias("_next"), F.max_by(id_, when).alias("_last"))
    return out.select(*keys, F.coalesce("_next", "_last").alias(id_))


def ordinals(rows: DataFrame, base: str, order: list[str], name: str) -> DataFrame:
    """A repeated base id gets -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n)))


def content_id(*parts: Column) -> Column:
    """Ten hexadecimal digits of the content's digest."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10)


def first_mode(counts: DataFrame, keys: list[str], value: str, weight: str, share: str) -> DataFrame:
    """Each key's value of the largest total weight (the smallest value on ties), and its share of all weight."""
    sums = counts.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    out = sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", F.lit(0))).alias("_any"), F.max("_w").alias("_m"), F.sum("_w").alias("_t"), F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias(value))
    return out.select(*keys, value, (F.col("_m") / F.col("_t")).alias(share))
