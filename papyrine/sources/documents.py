"""Reading uploads, LaTeX and Typst sources, knowledge files and line-wise JSON as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may be uploaded, and up to how many bytes.
UPLOADS = ("pdf", "docx", "txt", "tex", "typ", "md")
MOST_BYTES = 10 * 1024 * 1024


def uploads(spark: SparkSession, path: str, kinds: tuple[str, ...] = UPLOADS, most: int = MOST_BYTES) -> DataFrame:
    """path, kind, content of files of allowed kinds and sizes. Sizes are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.filter((F.col("length") > 0) & (F.col("length") <= most)).withColumn("kind", kind).filter(F.col("kind").isin(*kinds)).select("path", "kind", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of whole files, without blank ones."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")).filter(F.btrim("text") != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def plain_latex(source: Column) -> Column:
    """Text without comments, commands, braces and doubled spaces; the arguments of formatting commands stay."""
    text = F.regexp_replace(source, r"(?m)(?<!\\)%.*$", "")
    text = F.regexp_replace(text, r"\\(textbf|textit|emph|underline|texttt|href\{[^}]*\}|section\*?|subsection\*?)\{([^{}]*)\}", "$2")
    text = F.regexp_replace(text, r"\\item\b", "\n- ")
    text = F.regexp_replace(text, r"\\(begin|end)\{[^}]*\}(\[[^\]]*\])?", " ")
    text = F.regexp_replace(text, r"\\([&%$#_{}])", "$1")
    text = F.regexp_replace(text, r"\\[A-Za-z]+\*?(\[[^\]]*\])?", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[{}]", ""), r"[ \t]+", " "))


def latex_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 0), heading, text of the parts that \\section commands begin."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\\section\*?\{")).alias("section", "part")).filter("section > 0")
    heading = F.regexp_extract("part", r"^([^}]*)\}", 1)
    return parts.select("doc_id", (F.col("section") - 1).cast("long").alias("section"), heading.alias("heading"), plain_latex(F.regexp_replace("part", r"^[^}]*\}", "")).alias("text"))


def typst_events(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), kind (heading, item, hidden, text), section, text of the lines of Typst sources."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).select("doc_id", (F.col("n") + 1).cast("long").alias("line"), F.btrim("raw").alias("raw")).filter("raw != ''")
    kind = F.when(F.col("raw").rlike("^=+ "), "heading").when(F.col("raw").rlike("^[-+] "), "item").when(F.col("raw").rlike(r"#(hide|place)\(|fill: ?white|size: ?[0-3](\.[0-9]+)?pt"), "hidden").otherwise("text")
    running = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("kind", kind).withColumn("text", F.regexp_replace("raw", "^(=+|[-+]) +", ""))
    return rows.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(running)).select("doc_id", "line", "kind", "section", "text")


def knowledge_chunks(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """chunk_id, collection, title, text of a JSON file with a list of objects that have id, title and a map of texts."""
    rows = spark.read.schema("id string, title string, texts map<string,string>").json(path, multiLine=True)
    text = F.concat_ws(". ", F.transform(F.array_sort(F.map_entries("texts")), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return rows.select(F.col("id").alias("chunk_id"), F.lit(collection).alias("collection"), "title", text.alias("text"))
