"""Lines of parsed documents: kinds, look-ahead rules and segments, in DataFrame expressions.

The kinds of the lines after a line are written as one string, a letter a line, so rules about what follows it are patterns. Windows
look a fixed number of lines ahead, or run from a document's end, so work is linear in its lines.
Letters: s stem candidate, o option, t text, e empty, r roman, c case, u sub-stem, h header, n notes, l legend, i title; a
capital letter is a line that is mostly bold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The patterns that tell kinds of lines.
HEADER = r"(?i)^(finals?|mock|midterms?|second session|questions collected|collected questions|practice questions|in-class|past questions|mcq training|spec[ei]fic .*collected questions)\b"
ROMAN = r"(?i)^\s*(i|ii|iii|iv|v|vi|vii|viii)\s*[.)]\s*\S"
MANUAL_QUESTION = r"^\s*[0-9]{1,3}\s*[.)-]\s*\S"
MANUAL_OPTION = r"^\s*[a-hA-H]\s*[.)]\s*\S"
NOTES = r"(?i)^\s*notes?\s*:"


def line_kind(text: Column, bold: Column, style: Column | None = None, numbering: Column | None = None) -> Column:
    """The letter of a line, by the first rule that holds; the order is part of the meaning."""
    style, numbering = F.lit("") if style is None else F.coalesce(style, F.lit("")), F.lit("") if numbering is None else F.coalesce(numbering, F.lit(""))
    t = F.trim(text)
    return (
        F.when(style == "Title", "i")
        .when(t == "", "e")
        .when(t.startswith("[") & F.lower(t).contains("answers"), "l")
        .when(t.rlike(NOTES), "n")
        .when(t.rlike(HEADER) & ~bold & (numbering == "") & (F.length(t) < 120), "h")
        .when((style == "Heading1") | (numbering == "decimal") | (t.rlike(MANUAL_QUESTION) & bold), "s")
        .when(t.rlike(ROMAN) & (numbering == ""), "r")
        .when(numbering.isin("lowerLetter", "upperLetter") | t.rlike(MANUAL_OPTION), "o")
        .otherwise("t")
    )


def with_rest(lines: DataFrame, doc: str, at: str, kind: str) -> DataFrame:
    """lines with rest: the kinds of the document's next lines that are not empty, AHEAD of them at least where there are so many."""
    empty = F.col(kind).eqNullSafe("e")
    own = Window.partitionBy(doc, "_empty").orderBy(at).rowsBetween(0, AHEAD)
    later = Window.partitionBy(doc).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_empty", empty).withColumn("_from", F.when(~F.col("_empty"), F.array_join(F.collect_list(kind).over(own), "")))
    return rows.withColumn("rest", F.coalesce(F.last("_from", ignorenulls=True).over(later), F.lit(""))).drop("_empty", "_from")


#: Lines that are not empty and that a rule about later lines can look at: seven bold ones, a stem, two of text, two options.
AHEAD = 12
#: A stem needs two options after at most two lines of text.
IS_STEM = "^[tT]{0,2}[oO]{2}"
#: A question begins after at most seven bold lines.
LEADS_TO_STEM = "^[TS]{0,7}?([sS][tT]{0,2}[oO]{2}|[cCuU])"


def valid_stem(kind: Column, rest: Column) -> Column:
    return F.lower(kind).eqNullSafe("s") & rest.rlike(IS_STEM)


def leads_to_stem(rest: Column) -> Column:
    return rest.rlike(LEADS_TO_STEM)


def segments(lines: DataFrame, doc: str, at: str, kind: str) -> DataFrame:
    """doc, question (from 1), first line, number of options of each valid stem with its leading run of options."""
    order = Window.partitionBy(doc).orderBy(at)
    rows = lines.where(F.col(kind) != "e").withColumns({"_no": F.row_number().over(order), "_option": F.lower(kind) == "o"})
    # how many options stand in a row from a line on: up to the next line of another kind, or the last line
    later = Window.partitionBy(doc).orderBy(F.desc(at))
    other = F.last(F.when(~F.col("_option"), F.col("_no")), ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0))
    end = F.coalesce(other, F.first("_no").over(later.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    rows = rows.withColumn("_run", end - F.col("_no"))
    near = lambda c, n: F.collect_list(c).over(order.rowsBetween(1, n))
    rows = rows.withColumns({"rest": F.array_join(near(kind, AHEAD), ""), "_runs": near("_run", 3)}).where(valid_stem(F.col(kind), F.col("rest")))
    options = F.get("_runs", F.length(F.regexp_extract("rest", "^[tT]{0,2}", 0)))
    number = F.row_number().over(order)
    return rows.select(doc, number.cast("long").alias("question"), F.col(at).alias("line"), options.cast("long").alias("options"))


def session_type(header: Column) -> Column:
    low = F.lower(F.trim(header))
    out = F.lit("Collected")
    for beginning, name in (("second session", "Second session"), ("midterm", "Midterms"), ("mock", "Mock"), ("final", "Finals")):
        out = F.when(low.startswith(beginning), name).otherwise(out)
    return out


def session_years(header: Column) -> Column:
    """2019–2020, or null."""
    found = F.regexp_extract(header, r"(20[0-9]{2})\s*[-–]\s*(20[0-9]{2})", 1)
    return F.when(found != "", F.concat(found, F.lit("–"), F.regexp_extract(header, r"(20[0-9]{2})\s*[-–]\s*(20[0-9]{2})", 2)))


def runs_merged(rows: DataFrame, doc: str, at: str, value: str, text: str) -> DataFrame:
    """Adjacent rows of one value as one: doc, run (from 1), value, text joined in order."""
    order = Window.partitionBy(doc).orderBy(at)
    starts = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = rows.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")
    return rows.groupBy(doc, "run").agg(F.first(value).alias(value), joined.alias(text))
