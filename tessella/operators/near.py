"""All pairs of documents whose sets of windows are alike, without rows for the pairs that aren't.

A pair counts if it shares ``least_shared`` sampled windows and its similarity
(Jaccard of the full sets of windows) is ``least`` or more. Windows in few
documents are joined. A window in many documents gives blocks of documents
instead, and each block compares bitmaps of the full sets in memory: a bit that
one document sets and the other doesn't stands for a window that they don't
share, which bounds the similarity from above, so a pair that is left out is
below ``least`` for certain, whatever the hashes. What passes is compared by
its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import lookup, materialize
from . import corpus

#: A window in more documents than this is compared in blocks of so many documents.
OFTEN, BLOCK = 32, 4096
#: Fewest and most bits of a bitmap; in between about four for each window.
BITS = 256, 65536
#: Largest list of ids that is broadcast, in bytes.
IDS_BYTES = 8 << 20
_FACTORS = np.random.Generator(np.random.PCG64(7340117)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose doc_id is in ``ids``."""
    return lookup(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", IDS_BYTES)


def ids_of(pairs: DataFrame, *names: str) -> DataFrame:
    """The distinct ids (doc_id) in the named columns, written."""
    return materialize(pairs.select(F.explode(F.array(*names)).alias("doc_id")).distinct())


def sketches(texts: DataFrame, size: int, step: int) -> DataFrame:
    """doc_id, n (distinct windows) and bits (their bitmap: a power of two, so that a larger one folds to a smaller)."""
    factors, (fewest, most) = _FACTORS[np.arange(size) % 64] * (np.arange(size, dtype=np.uint64) // np.uint64(64) * np.uint64(2) + np.uint64(1)), BITS

    def sketch(text):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        count = max(0, (len(codes) - size) // step + 1)
        h = np.zeros(count, np.uint64)
        for k in range(size if count else 0):
            h += codes[k:k + step * (count - 1) + 1:step] * factors[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        # As many hashes as windows: all differ. Otherwise the windows themselves are counted.
        n = count if len(np.unique(h)) == count else len({text[k:k + size] for k in range(0, step * count, step)})
        m = min(max(fewest, 1 << (4 * n - 1).bit_length() if n else 0), most)
        bits = np.zeros(m, bool)
        bits[(h >> np.uint64(40)).astype(np.int64) & (m - 1)] = True
        return n, np.packbits(bits, bitorder="little").tobytes()

    def run(batches):
        for batch in batches:
            rows = [sketch(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["doc_id", "n", "bits"])

    return texts.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, bits binary")


def _compare(least: float):
    """Compares two lists of documents (ids, n, bits); gives the pairs that may reach ``least`` as two arrays of ids. The functions go to the executors by value."""
    # Similarities are rounded to 6 digits.
    least = least - 1e-6

    def classes(ids, n, bits):
        """By the width of the bitmap: ids, n (ascending) and rows of 64-bit words."""
        widths, out = np.fromiter(map(len, bits), np.int64, len(bits)), {}
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            at = at[np.argsort(n[at], kind="stable")]
            out[w] = ids[at], n[at], np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint64).reshape(len(at), w // 8)
        return out

    def fold(words, width):
        while words.shape[1] * 8 > width:
            half = words.shape[1] // 2
            words = words[:, :half] | words[:, half:]
        return words

    def compare(left, right=None):
        """Pairs across the two lists, or inside the one."""
        left = classes(*left)
        other, a, b = left if right is None else classes(*right), [], []
        for v, (lid, ln, lw) in left.items():
            for w, (rid, rn, rw) in other.items():
                if right is None and w < v or ln[-1] < least * rn[0] or rn[-1] < least * ln[0]:
                    continue
                x, y = fold(lw, min(v, w)), fold(rw, min(v, w))
                px, py = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y))
                low, high = np.searchsorted(rn, np.floor(least * ln), "left"), np.searchsorted(rn, np.ceil(ln / max(least, 1e-9)), "right")
                for k in range(len(lid)):
                    s = slice(max(low[k], k + 1) if right is None and v == w else low[k], high[k])
                    both = np.bitwise_count(x[k] & y[s]).sum(1, dtype=np.int64)
                    shared = np.minimum(ln[k] - px[k], rn[s] - py[s]) + both
                    met = rid[s][(shared * (1 + least) >= least * (ln[k] + rn[s])) & (rid[s] != lid[k])]
                    a.append(np.full(len(met), lid[k]))
                    b.append(met)
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))

    return compare


def _in_blocks(posts: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of the documents (h, of, doc_id, n, bits) that share h and may reach ``least``, in blocks of about BLOCK x BLOCK; ``of`` is the number of documents that have h."""
    compare = _compare(least)
    parts = F.ceil(F.col("of") / BLOCK).cast("int")
    dealt = posts.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "n", "bits")

    def run(table):
        part, i, j = table.column("part").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()

        def side(k):
            rows = table.filter(pa.array(part == k))
            return rows.column("doc_id").to_numpy(), rows.column("n").to_numpy(), rows.column("bits").to_pylist()

        a, b = compare(side(i)) if i == j else compare(side(i), side(j))
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return dealt.groupBy("h", "i", "j").applyInArrow(run, "a long, b long")


def _screened(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, c, na, nb, bits_a, bits_b) that may reach ``least``."""
    compare = _compare(least)

    def run(batches):
        for batch in batches:
            ones = [[np.array([0]), None, None], [np.array([1]), None, None]]
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                ones[0][1:], ones[1][1:] = (na[k:k + 1], [x]), (nb[k:k + 1], [y])
                keep.append(len(compare(*ones)[0]) > 0)
            yield batch.select(["a", "b", "c"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long, c long")


def _measured(texts: DataFrame, pairs: DataFrame, size: int, step: int) -> DataFrame:
    """The pairs (a, b, c) with their similarity: the two texts meet, as a set of windows is many times as large as its text."""
    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "c", "x", "y")

    def run(batches):
        cut = lambda t: {t[k:k + size] for k in range(0, len(t) - size + 1, step)}
        for batch in batches:
            counts = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = cut(x.as_py()), cut(y.as_py())
                counts.append((len(x & y), len(x | y)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "c")), *(pa.array([n[k] for n in counts], pa.int64()) for k in (0, 1))], ["a", "b", "c", "shared", "either"])

    return met.mapInArrow(run, "a long, b long, c long, shared long, either long").select("a", "b", "c", F.round(F.col("shared") / F.col("either"), 6).alias("similarity"))


def similar_pairs(docs: DataFrame, least: float, least_shared: int = 2, size: int = 24, step: int = 4) -> DataFrame:
    """a < b, c (sampled windows that both have, ``least_shared`` or more) and similarity (``least`` or more) of all such pairs."""
    sampled = materialize(corpus.sampled_windows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("cast(conv(h, 16, -10) as long)").alias("h")))
    often = sampled.groupBy("h").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    marks = sampled.join(often, "h").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("of", "h"))).alias("m")).where(F.size("m") >= least_shared)
    marks = materialize(marks)
    drawn = materialize(sketches(texts_of(docs, marks.select("doc_id")), size, step))
    # By the same order in all documents, the first window of a pair isn't among the last (least_shared - 1) of either.
    posts = marks.select("doc_id", F.explode(F.slice("m", F.lit(1), F.size("m") - (least_shared - 1))).alias("p")).select("doc_id", "p.*")
    few = posts.where(F.col("of") <= OFTEN).select("doc_id", "h")
    joined = few.alias("x").join(few.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    met = joined.unionByName(_in_blocks(posts.where(F.col("of") > OFTEN).join(drawn, "doc_id"), least)).distinct()
    hashes = marks.select("doc_id", F.col("m.h").alias("m"))
    side = lambda rows, end: rows.select(*[F.col(c).alias(end if c == "doc_id" else f"{c}_{end}" if c != "n" else f"n{end}") for c in rows.columns])
    counted = met.join(side(hashes, "a"), "a").join(side(hashes, "b"), "b").select("a", "b", F.size(F.array_intersect("m_a", "m_b")).cast("long").alias("c")).where(F.col("c") >= least_shared)
    likely = materialize(_screened(counted.join(side(drawn, "a"), "a").join(side(drawn, "b"), "b").select("a", "b", "c", "na", "nb", "bits_a", "bits_b"), least))
    return _measured(texts_of(docs, ids_of(likely, "a", "b")), likely, size, step).where(F.col("similarity") >= least)
