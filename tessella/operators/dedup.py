"""Dedup levels with source priority, near paragraphs, and the split rules that follow from overlap.

Frames have (doc_id, source, text). A source that isn't in the priority list
comes after all that are. Firsts and owners are aggregates, so a group of
copies of any size is combined in the map tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..stage import materialize
from .corpus import sampled_windows
from .near import ids_of, texts_of


def priority(source: Column, order: list[str]) -> Column:
    out = F.lit(len(order))
    for k, s in reversed(list(enumerate(order))):
        out = F.when(source == s, k).otherwise(out)
    return out


def _owners(rows: DataFrame, key: Column, order: list[str], out: str = "owner") -> DataFrame:
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(F.struct(priority(F.col("source"), order).alias("prio"), F.col("doc_id").alias("id"))).getField("id").alias(out))
    return keyed.join(first, "_key").drop("_key")


def file_exact(files: DataFrame, order: list[str], sources: list[str]) -> DataFrame:
    """L1: adds ``dup_of`` (null for the first) and ``reason`` to the files (doc_id, source, content) of the given sources; the key is the SHA-1 of the hexadecimal bytes."""
    rows = _owners(files.where(F.col("source").isin(*sources) & F.col("content").isNotNull()), F.sha1(F.lower(F.hex("content"))), order)
    bad = files.where(F.col("source").isin(*sources) & F.col("content").isNull()).select("doc_id", "source", F.lit(None).cast(files.schema["doc_id"].dataType).alias("dup_of"), F.lit("read_error").alias("reason"))
    return rows.select("doc_id", "source", F.when(F.col("owner") != F.col("doc_id"), F.col("owner")).alias("dup_of"), F.when(F.col("owner") != F.col("doc_id"), "file_exact").alias("reason")).unionByName(bad)


def document_exact(docs: DataFrame, order: list[str]) -> DataFrame:
    """L2: adds ``owner``, the first document with the same text by source priority, then doc_id; null text counts as empty."""
    return _owners(docs, F.sha1(F.coalesce("text", F.lit(""))), order)


def paragraph_exact(docs: DataFrame, order: list[str], fold=None) -> DataFrame:
    """L3: (doc_id, source, pos, para, owner). Repeats inside the owning document stay, as they have the same owner."""
    paras = docs.select("doc_id", "source", F.posexplode(T.paragraphs(F.coalesce("text", F.lit("")))).alias("pos", "para"))
    return _owners(paras, T.key60(fold(F.col("para")) if fold else F.col("para")), order)


def audit(paras: DataFrame, level: str = "para_exact") -> DataFrame:
    """One row for each distinct dropped (doc_id, dup_of, chars, preview); genuine repeats collapse too."""
    return paras.where("owner <> doc_id").select("doc_id", "source", F.col("owner").alias("dup_of"), F.lit(level).alias("reason"), F.length("para").cast("long").alias("chars"), F.substring("para", 1, 40).alias("preview")).distinct()


def judge_pairs(scored: DataFrame, docs: DataFrame, order: list[str], cross: float = 0.8, same: float = 0.99, least: float = 0.3) -> DataFrame:
    """Pairs (a, b, c, similarity) to (loser, winner, same, action): the loser has the lower priority, or the smaller id among equals.

    ``action`` is ``drop`` from the threshold on (``cross``, or ``same`` for
    equal priorities), ``paras`` from ``least`` on.
    """
    prio = docs.select("doc_id", priority(F.col("source"), order).alias("p"))
    j = scored.join(prio.withColumnRenamed("doc_id", "a").withColumnRenamed("p", "pa"), "a").join(prio.withColumnRenamed("doc_id", "b").withColumnRenamed("p", "pb"), "b")
    equal = F.col("pa") == F.col("pb")
    loser = F.when(equal, F.least("a", "b")).when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a"))
    action = F.when(F.col("similarity") >= F.when(equal, same).otherwise(cross), "drop").when(F.col("similarity") >= least, "paras")
    return j.select(loser.alias("loser"), F.when(loser == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("winner"), "c", "similarity", equal.alias("same"), action.alias("action")).where("action is not null")


def greedy_drops(judged: DataFrame) -> DataFrame:
    """L4: the pairs that take effect, most shared windows first, skipping those that touch a document dropped before.

    The order makes each decision depend on earlier ones, but only inside a
    connected group of pairs, so each group is decided by itself.
    """
    pairs = judged.where("action = 'drop'")
    grouped = _groups(pairs)

    def run(pdf):
        gone, keep = set(), []
        pdf = pdf.sort_values(["c", "loser", "winner"], ascending=[False, True, True])
        for a, b in zip(pdf["loser"].tolist(), pdf["winner"].tolist()):
            keep.append(a not in gone and b not in gone)
            if keep[-1]:
                gone.add(a)
        return pdf[keep][["loser", "winner", "similarity"]]

    return grouped.groupBy("g").applyInPandas(run, "loser long, winner long, similarity double")


def _groups(pairs: DataFrame) -> DataFrame:
    """Adds ``g``, the least id that a pair is connected with, by passing least ids along the pairs until none changes."""
    edges = materialize(pairs)
    label = materialize(edges.select(F.col("loser").alias("id")).unionByName(edges.select(F.col("winner").alias("id"))).distinct().withColumn("g", F.col("id")))
    both = edges.select(F.col("loser").alias("u"), F.col("winner").alias("v")).unionByName(edges.select(F.col("winner").alias("u"), F.col("loser").alias("v")))
    while True:
        near = both.join(label, F.col("v") == F.col("id")).groupBy("u").agg(F.min("g").alias("n"))
        new = materialize(label.join(near, F.col("id") == F.col("u"), "left").select("id", F.least("g", F.coalesce("n", "g")).alias("g"), (F.col("n") < F.col("g")).alias("changed")))
        if not new.where("changed").head(1):
            return edges.join(label, edges.loser == label.id).drop("id")
        # Also the label of the label, which shortens long chains.
        to = new.select(F.col("id").alias("t"), F.col("g").alias("h"))
        label = materialize(new.join(to, new.g == F.col("t")).select("id", F.least("g", "h").alias("g")))


def near_paragraphs(judged: DataFrame, docs: DataFrame, least: float = 0.9, size: int = 24, step: int = 4) -> DataFrame:
    """L3n: (doc_id, winner, pos, para, n, hits, dropped) of the losers' paragraphs: dropped where the winner's windows cover ``least`` of theirs.

    Paragraphs without a window stay. Where several pairs rewrite a document,
    a paragraph stays only if all of them leave it.
    """
    pairs = materialize(judged.where("action = 'paras'").select("loser", "winner"))
    texts = texts_of(docs, ids_of(pairs, "loser", "winner")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The two texts of a pair meet, as rows for windows would be many times as large; paragraphs are cut before.
    met = pairs.join(texts.select(F.col("doc_id").alias("loser"), T.paragraphs(F.col("text")).alias("paras")), "loser").join(texts.withColumnRenamed("doc_id", "winner"), "winner").select("loser", "winner", "paras", "text")
    kinds = "doc_id long, winner long, pos int, para string, n long, hits long"

    def run(batches):
        cut = lambda t: [t[k:k + size] for k in range(0, len(t) - size + 1, step)]
        for batch in batches:
            for row in zip(*batch.columns):
                loser, winner, paras, text = (v.as_py() for v in row)
                theirs = set(cut(text))
                mine = [cut(p) for p in paras]
                cols = [loser] * len(paras), [winner] * len(paras), range(len(paras)), paras, map(len, mine), [sum(w in theirs for w in ws) for ws in mine]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "winner", "pos", "para", "n", "hits"])

    return met.mapInArrow(run, kinds).withColumn("dropped", (F.col("n") > 0) & (F.col("hits") >= least * F.col("n")))


def final_chars(docs: DataFrame, *audits: DataFrame) -> DataFrame:
    """Adds ``chars_final``: raw characters (n_chars) less those of the audit rows (doc_id, chars), not under 0."""
    gone = None
    for a in audits:
        part = a.select("doc_id", "chars")
        gone = part if gone is None else gone.unionByName(part)
    sums = gone.groupBy("doc_id").agg(F.sum("chars").alias("_gone"))
    return docs.join(sums, "doc_id", "left").withColumn("chars_final", F.greatest(F.col("n_chars") - F.coalesce("_gone", F.lit(0)), F.lit(0))).drop("_gone")


def cross_split(docs: DataFrame, least: float = 0.5, digits: str = "0") -> DataFrame:
    """L5: (doc_id, split, moved): val and test documents of whose sampled windows train holds ``least`` move to train."""
    keys = sampled_windows(docs, digits=digits).join(docs.select("doc_id", "split"), "doc_id")
    train = keys.where("split = 'train'").select("h").distinct().withColumn("hit", F.lit(1))
    share = keys.where("split <> 'train'").join(train, "h", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    moved = F.coalesce(F.col("hits") >= least * F.col("n"), F.lit(False))
    return docs.select("doc_id", "split").join(share, "doc_id", "left").select("doc_id", F.when(moved, "train").otherwise(F.col("split")).alias("split"), moved.alias("moved"))


def author_disjoint(docs: DataFrame, separator: str = "、") -> DataFrame:
    """(doc_id, split, split_note): val and test documents that share any author with the initial train move to train."""
    names = docs.select("doc_id", "split", F.explode(F.split(F.coalesce("author", F.lit("")), separator)).alias("a")).select("doc_id", "split", T.strip(F.col("a")).alias("a")).where("a <> ''")
    seen = names.where("split = 'train'").select("a").distinct()
    moved = names.where("split <> 'train'").join(seen, "a", "left_semi").select("doc_id").distinct().withColumn("m", F.lit(True))
    return docs.select("doc_id", "split").join(moved, "doc_id", "left").select("doc_id", F.when(F.col("m"), "train").otherwise(F.col("split")).alias("split"), F.when(F.col("m"), "author_seen_in_train").alias("split_note"))


def first_by_id(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each id; rows without an id all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(rows.where(F.col(key).isNull()))
