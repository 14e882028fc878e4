"""Rule-based assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_lectures(questions: DataFrame, concepts: DataFrame, aspects: DataFrame, rules: DataFrame, moves: DataFrame) -> DataFrame:
    """q, lecture for every question.

    concepts (q, ord, concept) in order; aspects (q, aspect); rules (concept, aspect or null, lecture); moves (q, lecture).
    A move wins; else the first concept with a rule: one for the question's aspect before a plain one, before the next
    concept. Without any rule the lecture is none.
    """
    own = rules.select(F.col("concept"), F.col("aspect").alias("_rule_aspect"), F.col("lecture").alias("_lecture"))
    met = concepts.join(aspects, "q").join(own, "concept").where(F.col("_rule_aspect").isNull() | (F.col("_rule_aspect") == F.col("aspect")))
    best = met.groupBy("q").agg(F.min_by("_lecture", F.struct("ord", F.col("_rule_aspect").isNull(), "_lecture")).alias("_by_rule"))
    moved = moves.select("q", F.col("lecture").alias("_moved"))
    return questions.join(best, "q", "left").join(moved, "q", "left").select("q", F.coalesce("_moved", "_by_rule", F.lit("none")).alias("lecture"))
