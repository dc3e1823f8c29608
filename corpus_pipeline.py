"""A corpus pipeline of five stages; each keeps the columns of documents, the last packs.

A stage reads what its predecessor wrote: toxic documents go, one copy of each
group of equal texts stays, one document of each near-duplicate component
stays, documents that hold a benchmark passage go, and the rest is packed.

Defined results: a null or empty text counts as empty: it is scored as the
toxicity model scores a text without tokens, all empty texts are copies of each
other, and what stays of them is no near copy, holds no passage and packs as
one id. Of rows that repeat a doc_id and (but for blanks) the text, one stays,
the longest; rows with one doc_id and different texts are judged by their texts
in the dedup of equal texts, and by their doc_id in the stages that drop. Rows
without a doc_id are kept by both dedups, as nothing tells one from another,
and judged one by one by the stages that drop. An empty table gives an empty
result at every stage; further columns, whatever their names, go through.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from tessella.llm.common import discard_paths, materialize, open_stages, table
from tessella.llm.registry import ship
from tessella.llm.sampling import fold

ORACLE_SQL = None


def _keep(docs, judged):
    """The documents judged kept, and all without a doc_id: their ``kept`` is null, as nothing tells one of them from another."""
    ids = judged.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("kept_id"), "left_semi").unionByName(docs.where("doc_id is null"))


def _drop(docs, found):
    """Without the documents that ``found`` gives the ids of; those without a doc_id are judged apart, under ids that hold for the stage only."""
    out = docs.join(found(docs.where("doc_id is not null")).select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").select(*docs.columns)
    rest = docs.where("doc_id is null")
    if not rest.head(1):
        return out
    rest = materialize(rest.withColumn("doc_id", F.monotonically_increasing_id()))
    left = rest.join(found(rest).select("doc_id").distinct(), "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return out.unionByName(left.select(*docs.columns))


def drop_toxic(spark, docs, sf_dir):
    """Drop documents whose toxicity is 0.5 or more; the model learns from all labelled input documents outside the held-out fold."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return _drop(docs, lambda rows: toxicity.score(rows, model).where("score >= 0.5"))


def drop_copies(spark, docs, sf_dir):
    """Keep the longest (then first) document of each group of equal texts."""
    ship(spark)
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again")
    if not again.head(1):
        return _keep(docs, exact_dedup.exact_duplicates(docs))
    # Rows that repeat a doc_id: one of each text, and from then on they are told apart by their text.
    again = materialize(again)
    norm = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    first = Window.partitionBy("doc_id", norm).orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), "text")
    several = docs.join(again, F.col("doc_id") == F.col("again"), "left_semi")
    several = several.select(F.struct(*docs.columns).alias("row"), F.row_number().over(first).alias("turn")).where("turn = 1").select("row.*")
    docs = materialize(docs.join(again, F.col("doc_id") == F.col("again"), "left_anti").unionByName(several))
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    return docs.join(kept, (F.col("doc_id") == F.col("kept_id")) & (norm == F.col("kept_sha")), "left_semi").unionByName(docs.where("doc_id is null"))


def drop_near_copies(spark, docs, sf_dir):
    """Keep the first document of each near-duplicate component."""
    ship(spark)
    return _keep(docs, near_dedup.near_duplicates(docs))


def drop_leaks(spark, docs, sf_dir):
    """Drop documents that hold an exact or edited copy of a benchmark item."""
    ship(spark)
    return _drop(docs, lambda rows: decontamination.contaminated(rows, table(spark, sf_dir, "benchmark")))


def pack(spark, docs, sf_dir):
    """Pack what is left into sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = open_stages()
        out = materialize(stage(spark, docs, sf_dir))
        # What the stage left behind, and its own input, are needed no more.
        discard_paths(spark, (open_stages() - before - {out._stage_path}) | ({docs._stage_path} if hasattr(docs, "_stage_path") else set()))
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
