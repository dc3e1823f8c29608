"""Exact deduplication by skew-safe combining.

Copies are merged three times, each time by (digest, whole normalised text),
so two texts count as copies only if all their characters agree: inside each
map task (partial aggregation), then in salted digest groups, then among the
winners of the salts. A group of copies of any size therefore reaches a task
as at most one row per map task and salt, and the last merge sees at most
``SALTS`` rows for it.

Defined results: null text counts as empty, and all empty or blank texts are
copies of each other; ties on length go to the smallest doc_id; repeated rows
of one doc_id each count; a null doc_id is never the one to keep and gets
a null kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("len"), normalised(F.col("text")).alias("norm"))
    base = base.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    # One number orders the rows of a group by length, then by falling doc_id, and keeps hash aggregation possible.
    wide, step = "decimal(38,0)", F.expr("18446744073709551616BD").cast("decimal(38,0)")
    rank = F.col("len").cast(wide) * step - F.col("doc_id").cast(wide)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = base.groupBy("digest", salt.alias("salt"), "norm").agg(F.max("len").alias("len"), F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("len").alias("len"), F.max("best").alias("best"), F.sum("n").alias("group_size"))
    keep = (F.col("len").cast(wide) * step - F.col("best")).cast("long")
    classes = winners.select("digest", F.xxhash64("norm").alias("check"), keep.alias("keep_id"), "group_size")
    classes = materialize(classes)
    rows = base.select("doc_id", "digest", F.xxhash64("norm").alias("check"))
    return (rows.join(classes, ["digest", "check"])
            .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))
