"""Readers that normalise raw sources to (doc_id, source, text) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stage import row_numbers
from .formats import exists


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record per line, blank ones skipped; bad lines keep their first 200 characters in ``json_error``; a missing path has no records."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("json_error", T.StringType())]))
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("json_error", F.substring("_corrupt", 1, 200)).drop("_corrupt")


def text_tree(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Every ``*.txt`` below a folder but resource-fork files, one document each."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("f"))
    return files.where(~F.col("f").startswith("._")).select(F.concat(F.lit(source + "|"), "f").alias("doc_id"), F.lit(source).alias("source"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def line_chunks(lines: DataFrame, size: int = 100) -> DataFrame:
    """(file, line_no, value) to (file, chunk, text): chunks of ``size`` lines that aren't blank, the last may be shorter."""
    kept = row_numbers(lines.where(F.trim("value") != ""), ["file"], ["line_no"])
    chunk = (F.floor((F.col("rn") - 1) / size) + 1).cast("long")
    rows = kept.groupBy("file", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    return rows.select("file", "chunk", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("text"))


def grouped_text(rows: DataFrame, keys: list[str], pos: str, text: str, title: str, separator: str = "\n") -> DataFrame:
    """One document per key: texts in order, blank ones left out; the title is the last row's."""
    t = F.when(F.trim(text) != "", F.col(text))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(t.isNotNull(), F.struct(pos, F.col(text).alias("t"))))), lambda x: x["t"]), separator).alias("text"), F.max_by(title, pos).alias("title"))


def adapt(rows: DataFrame, source: str, local_id, text, **columns) -> DataFrame:
    """Records of any shape to documents: doc_id is ``source|local id``, blank strings become null."""
    clean = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return rows.select(F.concat(F.lit(source + "|"), local_id.cast("string")).alias("doc_id"), F.lit(source).alias("source"), text.alias("text"), *[clean(c).alias(k) for k, c in columns.items()])


def html_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, lang, n_links of raw pages."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", title.alias("title"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r"<a href="), F.lit(0))).cast("long").alias("n_links"))


def book_fields(pages: DataFrame) -> DataFrame:
    """Title, author, death years (negative: BCE), original publication, release date and languages of book pages (page_id, html)."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    heading = plain(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    creators = F.transform(F.regexp_extract_all("html", F.lit(r'(?s)itemprop="creator"[^>]*>(.*?)</a>'), F.lit(1)), plain)
    died = F.transform(F.regexp_extract_all(F.array_join("creators", ";"), F.lit(r"-\s*(\d{1,4}(?:\s*BCE?)?)\??(?:;|$)"), F.lit(1)), lambda y: F.when(y.contains("BC"), -F.regexp_extract(y, r"(\d+)", 1).cast("int")).otherwise(y.cast("int")))
    row = lambda name: F.nullif(plain(F.regexp_extract("html", rf"(?s)<th>{name}</th>\s*<td[^>]*>(.*?)</td>", 1)), F.lit(""))
    langs = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<th>Language</th>\s*<td[^>]*>(.*?)</td>"), F.lit(1)), plain)
    return pages.withColumn("creators", creators).select("page_id", F.regexp_extract(heading, r"(?s)^(.*?)(?: by .*)?$", 1).alias("title"), F.nullif(F.regexp_extract(heading, r"(?s) by (.*)$", 1), F.lit("")).alias("by"), "creators", died.alias("death_years"),
                 row("Original Publication").alias("original_publication"), row("Release Date").alias("release_date"), langs.alias("languages"))
