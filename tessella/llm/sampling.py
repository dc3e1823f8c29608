"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Most bytes of text in the sample of a class.
CLASS_BYTES = 8 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, class_bytes: int = CLASS_BYTES) -> tuple[pa.Array, list[int], list[int]]:
    """Texts and labels of a sample of training rows, and how many training labels each class has in all.

    Rows are chosen by the order of a hash of their id among all labelled
    rows, so the choice doesn't depend on file order: at most ``per_class`` of
    each class, of which those are taken whose texts fit, one after another,
    into ``class_bytes``. At most 2 * per_class ids are broadcast, and at most
    2 * class_bytes of text come to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
                       .withColumn("turn", F.xxhash64("doc_id", F.lit(17))).withColumn("size", F.octet_length("text").cast("long")))
    # Rows that repeat a doc_id count once each; the bounded list below has a few numbers for each sampled id.
    sizes = rows.groupBy("y", "turn", "doc_id").agg(F.sum("size").alias("size")).orderBy("y", "turn", "doc_id").collect()
    taken, held = [], {}
    for r in sizes:
        if held.get(r.y, 0) + r.size <= class_bytes:
            held[r.y] = held.get(r.y, 0) + r.size
            taken.append(r.doc_id)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(taken, pa.int64())})))
    got = rows.join(wanted, "doc_id", "left_semi").select("doc_id", "y", "text").toArrow() if taken else None
    discard(rows)
    if got is None or not got.num_rows:
        return pa.array([], pa.string()), [], [totals.get(0, 0), totals.get(1, 0)]
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return got.column("text").combine_chunks(), got.column("y").to_pylist(), [totals.get(0, 0), totals.get(1, 0)]


def class_weights(y: np.ndarray, totals: list[int]) -> np.ndarray:
    """Weights of sampled rows that give each class its share of all training labels, whatever the sample's; their mean is 1."""
    w = (np.array(totals) / np.maximum(1, np.bincount(y, minlength=2)))[y]
    return w / w.mean()
