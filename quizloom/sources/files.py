"""Readers and writers of the bank's files, through Spark's own sources, so any file system that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.sources import schemas


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for a JSON file of one object (or one for each object of an array), by an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value for each entry of a JSON file that is one object with arbitrary keys."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def bank(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A bank file as one DataFrame for each member; ord keeps the file's order, which has meaning."""
    root = json_document(spark, path, schemas.BANK)
    out = {m: root.select(F.posexplode(m).alias("ord", "x")).select("ord", "x.*") for m in ("topics", "sources", "cases", "questions")}
    return out | {"types": root.select(F.posexplode("types").alias("ord", "type"))}


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """name, text (trimmed) for each file of a folder."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), F.trim("value").alias("text"))


def docx_runs(spark: SparkSession, folder: str) -> DataFrame:
    """file, p (paragraph), r (run), style, fill, bold, italic, text from the document.xml files of unzipped documents.

    Paragraphs are cut with patterns and runs read with from_xml-free expressions, so no parser is needed on the workers.
    """
    files = spark.read.option("pathGlobFilter", "document.xml").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    p = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("p", "xml"))
    style = F.regexp_extract("xml", r'<w:pStyle w:val="([^"]*)"', 1)
    runs = p.select("file", "p", style.alias("style"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<w:r[ >].*?</w:r>"), F.lit(0))).alias("r", "run"))
    text = F.array_join(F.regexp_extract_all(F.regexp_replace("run", r"<w:br */>", "<w:t>\n</w:t>"), F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), "")
    fill = F.regexp_extract("run", r'<w:shd [^>]*w:fill="([0-9A-Fa-f]{6})"', 1)
    flag = lambda tag: F.col("run").rlike(rf"<w:{tag} */>|<w:{tag} w:val=\"(1|true)\"")
    return runs.select("file", "p", "r", "style", F.lower(F.when(fill != "", fill)).alias("fill"), flag("b").alias("bold"), flag("i").alias("italic"), text.alias("text"))


def docx_numbering(spark: SparkSession, folder: str) -> DataFrame:
    """file, num, level, format: which list format a paragraph's number and level stand for (two look-ups joined)."""
    files = spark.read.option("pathGlobFilter", "numbering.xml").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    abstract = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<w:abstractNum .*?</w:abstractNum>"), F.lit(0))).alias("x"))
    levels = abstract.select("file", F.regexp_extract("x", r'w:abstractNumId="([^"]*)"', 1).alias("abstract"), F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<w:lvl .*?</w:lvl>"), F.lit(0))).alias("l"))
    levels = levels.select("file", "abstract", F.regexp_extract("l", r'w:ilvl="([^"]*)"', 1).cast("int").alias("level"), F.regexp_extract("l", r'<w:numFmt w:val="([^"]*)"', 1).alias("format"))
    nums = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<w:num .*?</w:num>"), F.lit(0))).alias("x"))
    nums = nums.select("file", F.regexp_extract("x", r'w:numId="([^"]*)"', 1).cast("int").alias("num"), F.regexp_extract("x", r'<w:abstractNumId w:val="([^"]*)"', 1).alias("abstract"))
    return nums.join(levels, ["file", "abstract"]).select("file", "num", "level", "format")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines without null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def version(df: DataFrame, order: str) -> DataFrame:
    """Twelve hexadecimal digits that change with the content: a digest over the rows' digests in order."""
    row = F.sha1(F.to_json(F.struct(*[c for c in df.columns])).cast("binary"))
    one = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("d")))).alias("_d"))
    return one.select(F.substring(F.sha1(F.array_join(F.transform("_d", lambda x: x["d"]), "").cast("binary")), 1, 12).alias("version"))


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
