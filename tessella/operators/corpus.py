"""Corpus operators: quality gate, owners of documents and paragraphs, pairs by shared windows, splits. Levels with source priority are in ``dedup``.

All are plain plans over ``documents``-like frames (doc_id, text, source).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def clean(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", T.collapse_blank_lines(T.strip_controls(T.normalise_newlines(T.drop_replacement(F.coalesce("text", F.lit("")))))))


def quality_cascade(docs: DataFrame, least_chars: int = 50, least_letters: float = 0.55, most_symbols: float = 0.25, script: str = "letters") -> DataFrame:
    """Adds ``reason``: the first rule a document fails, null if it is kept."""
    ratio = T.cjk_ratio(F.col("text")) if script == "cjk" else T.letter_ratio(F.col("text"))
    reason = (F.when(F.coalesce(F.length("text"), F.lit(0)) < least_chars, "too_short").when(ratio < least_letters, "low_letters")
              .when(T.symbol_ratio(F.col("text")) > most_symbols, "symbols").when(F.col("text").rlike(r"http://|www\."), "url"))
    return docs.withColumn("reason", reason)


def dedup_documents(docs: DataFrame, order: list) -> DataFrame:
    """Adds ``owner``: the first document with the same text by ``order``; null text counts as empty."""
    # The first of a group is an aggregate, so that large groups combine in the map tasks.
    sha = F.sha1(F.coalesce("text", F.lit("")))
    firsts = docs.groupBy(sha.alias("sha")).agg(F.min_by("doc_id", F.struct(*order)).alias("owner"))
    return docs.withColumn("sha", sha).join(firsts, "sha").drop("sha")


def paragraph_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "para")).withColumn("key", T.key60(F.col("para")))


def dedup_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, source, pos, para, owner: a paragraph is dropped where its owner, the first document that has it, is another one."""
    rows = paragraph_rows(docs)
    owners = rows.groupBy("key").agg(F.min("doc_id").alias("owner"))
    return rows.join(owners, "key").drop("key")


def rebuild(paras: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and final text: surviving paragraphs joined by line feeds ('' if none)."""
    kept = paras.where("owner = doc_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "para"))), lambda x: x["para"]), "\n").alias("final"))
    return docs.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("final", F.lit("")).alias("final"))


def sampled_windows(docs: DataFrame, size: int = 24, step: int = 8, digits: str = "0") -> DataFrame:
    """Distinct (doc_id, h) of the windows whose 64-bit key ends in one of ``digits`` (1/16 each)."""
    rows = docs.where(F.length("text") >= size).select("doc_id", F.explode(F.array_distinct(T.windows(F.col("text"), size, step))).alias("w"))
    return rows.select("doc_id", T.key64(F.col("w")).alias("h")).where(F.substring("h", 16, 1).isin(*digits)).distinct()


def window_pairs(docs: DataFrame, least_shared: int = 2, top: int | None = 12000) -> DataFrame:
    """Pairs a < b with the number of sampled windows they share, most first (a top-k report unless ``top`` is None)."""
    w = sampled_windows(docs)
    pairs = w.alias("x").join(w.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.doc_id") < F.col("y.doc_id"))).groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_shared)
    return pairs.orderBy(F.desc("c"), "a", "b").limit(top) if top else pairs


def pair_jaccard(docs: DataFrame, pairs: DataFrame, size: int = 24, step: int = 4) -> DataFrame:
    """a, b, similarity of their sets of windows."""
    sets = docs.select("doc_id", F.array_distinct(T.windows(F.col("text"), size, step)).alias("s"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", "c", F.round(shared / (F.size("x") + F.size("y") - shared), 6).alias("similarity"))


def window_overlap(docs: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, n windows sampled, matched: windows that ``other`` (id, text) also has."""
    mine = sampled_windows(docs, digits="0123")
    theirs = sampled_windows(other.withColumnRenamed("item_id", "doc_id"), digits="0123").select("h").distinct().withColumn("hit", F.lit(1))
    return mine.join(theirs, "h", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"))


def split_with_coverage(docs: DataFrame, work, author, category, size) -> DataFrame:
    """Hash split by work, then authors of the training side pull their other documents in, then forced coverage per category."""
    d = docs.select("doc_id", work.alias("work"), author.alias("author"), category.alias("category"), size.alias("size")).withColumn("split0", T.split_of(F.col("work")))
    train_authors = d.where("split0 = 'train'").select("author").distinct().withColumn("seen", F.lit(True))
    d = d.join(train_authors, "author", "left").withColumn("split1", F.when((F.col("split0") != "train") & F.col("seen"), "train").otherwise(F.col("split0"))).drop("seen")
    have = d.groupBy("category").agg(F.max(F.expr("split1 = 'val'")).alias("has_val"), F.max(F.expr("split1 = 'test'")).alias("has_test"))
    ranked = d.where("split1 = 'train'").withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("size"), "doc_id"))).where("rn <= 2").select("doc_id", "rn")
    d = d.join(have, "category").join(ranked, "doc_id", "left")
    forced = F.when((F.col("rn") == 1) & ~F.col("has_val"), "val").when((F.col("rn") == F.when(F.col("has_val"), 1).otherwise(2)) & ~F.col("has_test"), "test")
    return d.select("doc_id", "split0", "split1", F.coalesce(forced, F.col("split1")).alias("split"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
