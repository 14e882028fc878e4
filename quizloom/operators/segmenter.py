"""Parsed lines into topics, sets, questions, cases and chapters.

A document's lines are first told apart by what stands in them and after them, in window functions of a bounded frame, as one
letter a line. An automaton over these letters, given as a table, says which part each line plays; it is the only step that
goes through a document line by line. All numbers, owners and cases follow from the parts by running sums and maxima.

Lines are rows of doc, n (the place in doc), para, text, bold, kind (the letters of operators.lines). A document's lines have to fit in
one task. Null texts count as empty, a null bold as not bold; no lines give no questions; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quizloom.session import cut

#: What begins a case, what refers to one, and what stands by itself.
CASE_PREFIX = r"(?i)^\s*(case|vignette|clinical case)\s*:|^\s*[•·]\s*"
DEPENDENT = (
    r"(?i)\b(most likely diagnosis|this (patient|case|woman|man|child|nodule)|the patient|her|his|she|he|expected evolution|best treatment|treatment approach"
    r"|first (laboratory|lab|test|investigation|exam)|next step|initial (test|management|step)|to perform)\b"
)
SELF_CONTAINED = r"(?i)^\s*(\d{1,3}\s*[.)-]\s*)?(a|an)\s+\d{1,3}[- ]?(y|year)|^\s*(\d{1,3}\s*[.)-]\s*)?(mr|mrs|miss|ms|m)\.?\s+[A-Z]"
NUMBER = r"^\s*[0-9]{1,3}\s*[.)-]\s*"
LONG, REACH = 45, 11


def in_order() -> WindowSpec:
    return Window.partitionBy("doc").orderBy("n")


def relabelled(lines: DataFrame) -> DataFrame:
    """An option before a roman line becomes a sub-stem (u), and makes a case (c) of the nearest stem candidate.

    That is one of the REACH lines before it in the same paragraph which no earlier sub-stem has taken. Of a document only stem
    candidates and sub-stems are gathered, and at most REACH candidates are open at a time.
    """
    # from the document's end, where the frame only grows
    back = Window.partitionBy("doc").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.last(F.when(F.col("kind") != "e", F.col("kind")), ignorenulls=True).over(back)
    rows = lines.withColumn("_row", F.row_number().over(in_order())).withColumn("_sub", (F.col("kind") == "o") & later.eqNullSafe("r"))
    steps = rows.where("kind = 's' OR _sub").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_row", "para", "_sub"))).alias("_steps"))

    def step(a: Column, x: Column) -> Column:
        near = F.filter(a["open"], lambda s: s["_row"] >= x["_row"] - REACH)
        taken = F.when(x["_sub"], F.array_max(F.transform(F.filter(near, lambda s: s["para"].eqNullSafe(x["para"])), lambda s: s["_row"])))
        left = F.when(x["_sub"], F.filter(near, lambda s: ~s["_row"].eqNullSafe(taken))).otherwise(F.array_append(near, x))
        return F.struct(left.alias("open"), F.when(taken.isNull(), a["cases"]).otherwise(F.array_append(a["cases"], taken)).alias("cases"))

    start = F.struct(F.expr("slice(_steps, 1, 0)").alias("open"), F.array().cast("array<int>").alias("cases"))
    cases = steps.select("doc", F.explode(F.aggregate("_steps", start, step)["cases"]).alias("_row"), F.lit(True).alias("_case"))
    kind = F.when(F.col("_sub"), "u").when(F.col("_case"), "c").otherwise(F.col("kind"))
    return rows.join(cases, ["doc", "_row"], "left").withColumn("kind", kind).drop("_row", "_sub", "_case")


def classes(lines: DataFrame) -> DataFrame:
    """lines (relabelled) with class: what the automaton reads.

    T title, H header, c case, q stem with options, u sub-stem, r roman, o option, N notes, - what never counts; text is p
    (begins like a case), b (long and bold), k (short), each before a question, or else x; a stem candidate without options
    is P, B, K or X in the same way.
    """
    from quizloom.operators.lines import AHEAD, leads_to_stem, valid_stem

    bold, text = F.coalesce("bold", F.lit(False)), F.trim(F.coalesce("text", F.lit("")))
    lines = lines.withColumns({"text": text, "bold": bold})
    seen = lines.where("kind <> 'e'").withColumn("_mark", F.when(F.col("bold"), F.upper("kind")).otherwise(F.col("kind")))
    rest = F.array_join(F.collect_list("_mark").over(in_order().rowsBetween(1, AHEAD)), "")
    seen = seen.withColumn("_rest", rest).withColumns({"_valid": valid_stem(F.col("kind"), F.col("_rest")), "_leads": leads_to_stem(F.col("_rest"))})
    look = F.when(~F.col("_leads"), "x").when(F.col("text").rlike(CASE_PREFIX), "p").when(F.col("bold") & (F.length("text") > LONG), "b")
    look = look.when((F.length("text") <= LONG) & ~F.col("text").contains("?"), "k").otherwise("x")
    kind = F.col("kind")
    named = F.when(kind == "i", F.when(F.col("text") != "", "T").otherwise("-")).when(kind == "h", "H").when(kind == "n", "N").when(kind.isin("c", "u", "r", "o"), kind)
    named = named.when(kind == "s", F.when(F.col("_valid"), "q").otherwise(F.upper(look))).when(kind == "t", look).otherwise("-")
    return seen.withColumn("class", named).drop("_mark", "_rest", "_valid", "_leads")


#: What a class does in the modes 0 (nothing open), c (case), s (stem), o (options), n (notes of the open question) and z (notes of
#: a closed one): the part it plays, then the next mode. Where a mode is missing, the line is ignored.
#: Parts: T topic, H set, C case, c more of it, K chapter, S stem, U sub-stem, + more of a stem, o option, n note, m line after options.
_ALL, _TEXT, _AFTER = "0csonz", {"s": "+s", "o": "mo", "n": "nn"}, {"o": "mo", "n": "nn"}
_CASE = {**dict.fromkeys("0o", "Cc"), "c": "cc"}
TABLE: dict[str, dict[str, str]] = {
    "T": dict.fromkeys(_ALL, "T0"),
    "H": dict.fromkeys(_ALL, "H0"),
    "c": {**dict.fromkeys("0sonz", "Cc"), "c": "cc"},
    "q": dict.fromkeys(_ALL, "Ss"),
    "u": dict.fromkeys(_ALL, "Us"),
    "r": {"s": "oo", "o": "oo", "n": "nn"},
    "o": {"s": "oo", "o": "oo", "n": "nn"},
    "x": _TEXT,
    "p": {**_TEXT, **_CASE, "n": "Cc", "z": "Cc"},
    "b": {**_TEXT, **_CASE},
    "k": {**_TEXT, **dict.fromkeys("0oc", "K0")},
    "X": _AFTER,
    "P": {**_AFTER, **_CASE, "n": "Cc", "z": "Cc"},
    "B": {**_AFTER, **_CASE},
    "K": {**_AFTER, **dict.fromkeys("0oc", "K0")},
}


def parts_of(letters: str) -> str:
    """The parts that a document's lines play, one letter a line (- for ignored ones; N notes of the open question, M of a closed one).

    Beside the mode, two facts decide whom notes belong to: the open question's number of options, and whether a question
    with two options has been closed in this topic. Nothing counts before the first topic.
    """
    out, mode, options, closed, topic = [], "0", None, False, False
    for letter in letters:
        if letter == "N":
            owner = "N" if options is not None else "M" if closed else "-"
            out.append(owner if topic else "-")
            mode = {"N": "n", "M": "z"}.get(out[-1], mode)
            continue
        part, after = TABLE.get(letter, {}).get(mode, f"-{mode}")
        if not topic and part != "T":
            out.append("-")
            continue
        topic = True
        if part in "THCKSU":
            closed = part != "T" and (closed or (options or 0) >= 2)
            options = 0 if part in "SU" else None
        elif part == "o":
            options += 1
        out.append(part)
        mode = after
    return "".join(out)


def parts(lines: DataFrame) -> DataFrame:
    """lines that are not empty, with class and part."""
    read = cut(classes(lines))
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            played = [list(parts_of("".join(x["class"] for x in seq))) for seq in frame["seq"]]
            yield pd.DataFrame({"doc": frame["doc"], "ns": [[x["n"] for x in seq] for seq in frame["seq"]], "parts": played})

    docs = read.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "class"))).alias("seq"))
    found = docs.mapInPandas(run, f"doc {kinds['doc']}, ns array<{kinds['n']}>, parts array<string>")
    found = found.select("doc", F.explode(F.arrays_zip("ns", "parts")).alias("x")).select("doc", F.col("x.ns").alias("n"), F.col("x.parts").alias("part"))
    return read.join(found, ["doc", "n"])


def questions(lines: DataFrame) -> DataFrame:
    """doc, topic, set, question (numbers from 1; questions count through doc), stem, options, notes, case (number in doc or null), chapter.

    Only questions with two options or more. A case holds for the first question after it, for sub-stems, and for stems that
    refer to a patient; a stem that stands by itself, or any further stem after a compound case, ends it.
    """
    rows = parts(lines)
    is_ = lambda letters: F.col("part").isin(*letters)
    upto = lambda *keys: Window.partitionBy("doc", *keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda letters, *keys: F.sum(F.when(is_(letters), 1).otherwise(0)).over(upto(*keys))
    whole = lambda *keys: Window.partitionBy("doc", *keys)
    rows = rows.withColumns({"topic": count("T"), "_q": count("SU"), "_seg": count("THKC"), "_part": count("TH"), "_case": count("C")})
    heads = count("H", "topic")
    rows = rows.withColumn("_heads", heads).withColumn("set", F.col("_heads") + F.max(F.when(is_("S") & (F.col("_heads") == 0), 1).otherwise(0)).over(upto("topic")))
    name = F.rtrim(F.regexp_replace("text", NUMBER, ""), F.lit(":"))
    name = F.when(name.rlike("[A-Z]") & (name == F.upper(name)), F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, LONG)))).otherwise(name)
    name = F.when(name.rlike("[A-Za-z]{3,}"), name)
    rows = rows.withColumn("chapter", F.max(F.when(is_("K"), F.struct("n", name.alias("name")))).over(upto("_part"))["name"])
    rows = rows.withColumn("_compound", F.coalesce(F.max(F.when(is_("Cc"), F.struct("n", (F.col("kind") == "c").alias("c")))).over(whole("_seg"))["c"], F.lit(False)))
    rows = rows.withColumn("_has_case", F.max(is_("C")).over(whole("_seg"))).withColumn("_fresh", count("SU", "_seg") == 1)
    ends = is_("S") & ~F.col("_fresh") & (F.col("_compound") | F.col("text").rlike(SELF_CONTAINED))
    rows = rows.withColumn("_ended", F.max(ends).over(upto("_seg")))
    uses = F.col("_has_case") & ~F.col("_ended") & (is_("U") | F.col("_fresh") | F.col("text").rlike(DEPENDENT))
    rows = rows.withColumn("case", F.when(is_("SU") & uses, F.col("_case")))
    rows = rows.withColumn("options", F.sum(F.when(is_("o"), 1).otherwise(0)).over(whole("_q")))
    valid = F.when(is_("SU") & (F.col("options") >= 2), F.col("_q"))
    rows = rows.withColumn("_q", F.when(is_("M"), F.last_value(valid, True).over(upto("topic"))).otherwise(F.when(~is_("-"), F.col("_q"))))
    said = F.when(is_("NM"), F.trim(F.regexp_replace("text", r"(?i)^\s*notes?\s*:", ""))).otherwise(F.col("text"))
    note = (is_("NM") & ~said.isin("", ":")) | (is_("n") & ~said.isin("", ":")) | (is_("m") & ~said.isin("", ".", "-", ":"))
    stem = F.when(is_("S"), F.regexp_replace("text", NUMBER, "")).when(is_("U"), F.regexp_replace("text", r"^\s*[a-hA-H]\s*[.)]\s*", "")).when(is_("+"), F.col("text"))
    head = lambda c: F.max(F.when(is_("SU"), F.col(c))).alias(c)
    out = rows.groupBy("doc", "_q").agg(
        *map(head, ["topic", "set", "case", "chapter"]), F.sum(F.when(is_("o"), 1).otherwise(0)).alias("options"), F.sum(F.when(note, 1).otherwise(0)).alias("notes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(stem.isNotNull(), F.struct("n", stem.alias("s"))))), lambda x: x["s"]), " ").alias("stem"),
    ).where("options >= 2")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("_q")).cast("long")
    return out.select("doc", "topic", "set", number.alias("question"), "stem", "options", "notes", "case", "chapter")
