"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item that a document holds is a seed, however common it
is: an edited copy may hold no other, so none is left out for its document
frequency. The window around a document's seeds of an item is aligned with it:
Smith-Waterman over words (match 2, mismatch and gap -1). The score is the best
alignment's share of the highest possible one, so edited copies stay over
``LEAST_SCORE``. Windows are skipped only where an upper bound of the score
(``_bound``, from which words the two have in common) is under the least score
asked for, so no match is lost to that. ``n_seeds`` counts the stretches of
``STRIDE`` words of the item in which a seed begins.

The items are the side that is sent to all tasks, in shards of at most
``SHARD_BYTES``; more items mean more passes over the documents, never a larger
broadcast.

Words are runs of letters, digits and non-ASCII characters, A-Z folded.
Defined results: null texts count as empty; an item with fewer than n words
has no seeds and no matches; repeated rows are aligned one by one and reported
once per (doc_id, item_id) with the best score, rows without a doc_id as one;
empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .words import mix, words

GRAM = 3
STRIDE = 4
LEAST_SCORE = 0.5
SHARD_BYTES = 8 << 20
PAD = 12
#: Words in a block of windows that is aligned at once.
ALIGNED = 1 << 19
_SLICE = 1 << 20


def _grams(prints: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of word n-grams inside rows, and their first words."""
    if len(prints) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed, run = mix(prints), np.zeros(len(prints) - n + 1, np.uint64)
    for k in range(n):
        run = run * np.uint64(0xD6E8FEB86659FD93) + mixed[k:len(prints) - n + 1 + k]
    at = np.flatnonzero(rows[:len(run)] == rows[n - 1:])
    return mix(run[at]), at


class _Items:
    """Word fingerprints of the items of a shard and a sorted table of their n-grams."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int):
        text, offsets = text_bytes(texts)
        _, _, rows, prints = words(text, offsets, punctuation=True)
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.ids = np.array(ids, np.int64)
        self.words = [prints[bounds[i]:bounds[i + 1]] for i in range(len(ids))]
        grams, at = _grams(prints, rows, n)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item = grams[order], rows[at][order]
        self.place = (at - bounds[rows[at]])[order]
        self.low = np.zeros(1 << 20, bool)
        self.low[self.grams & np.uint64(0xFFFFF)] = True
        self.sizes = np.array([len(w) for w in self.words], np.int64)


def _align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of the item with each row of windows (0 pads)."""
    steps = np.arange(windows.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    for w in item:
        new = np.maximum(row - 1, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(windows == w, 2, -1).astype(np.int32))
        row = np.maximum.accumulate(new + steps, axis=1) - steps
        best = np.maximum(best, row.max(axis=1))
    return best


def _hits(docs: DataFrame, shared, n: int, stride: int) -> DataFrame:
    """doc_id, item (its number in the shard), seeds (stretches of the item with an n-gram found here) and the words around them."""

    def run(batches):
        items = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            text, offsets = text_bytes(batch.column("text"))
            out = []
            for first, last in slices(offsets, _SLICE):
                _, _, rows, prints = words(text[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], punctuation=True)
                bounds = np.searchsorted(rows, np.arange(last - first + 1))
                grams, at = _grams(prints, rows, n)
                some = np.flatnonzero(items.low[grams & np.uint64(0xFFFFF)])
                grams, at = grams[some], at[some]
                x, y = np.searchsorted(items.grams, grams, "left"), np.searchsorted(items.grams, grams, "right")
                count = y - x
                which = np.repeat(np.arange(len(grams)), count)
                entry = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(x, count)
                at, item, place = at[which], items.item[entry], items.place[entry]
                row = rows[at] if len(at) else at
                order = np.lexsort((at, item, row))
                at, item, place, row = at[order], item[order], place[order], row[order]
                low = np.maximum(at - place - PAD, bounds[row])
                high = np.minimum(at - place + items.sizes[item] + PAD, bounds[row + 1])
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])])) if len(at) else []
                for i, j in zip(new, [*new[1:], len(at)]):
                    a, b = int(low[i:j].min()), int(high[i:j].max())
                    out.append((ids[first + row[i]], int(item[i]), len(np.unique(place[i:j] // stride)), prints[a:b].tobytes()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "item", "seeds", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item int, seeds long, words binary")


def _bound(found: np.ndarray) -> int:
    """The highest score a local alignment can have whose words are found (at most 2 each) or not (-1 each)."""
    total = np.concatenate([[0], np.cumsum(np.where(found, 2, -1))])
    return int((total - np.minimum.accumulate(total)).max())


def matches(docs: DataFrame, benchmark: DataFrame, n: int = GRAM, stride: int = STRIDE, least: float = 0.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score (0 to 1) and n_seeds of each aligned pair with at least that score."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''").dropDuplicates()
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    shards, found = max(1, -(-int(total) // shard_bytes)), []
    for k in range(shards):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = _Items(part.column("item_id").to_pylist(), part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()), n)
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                due: dict[int, list[tuple[int, int, np.ndarray]]] = {}
                for doc, item, count, got in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item", "seeds", "words"))):
                    window, test = np.frombuffer(got, np.uint64), items.words[item]
                    if all(_bound(x) / (2 * len(test)) >= least for x in (np.isin(window, test), np.isin(test, window))):
                        due.setdefault(item, []).append((doc, count, window))
                out = []
                for item, rows in due.items():
                    rows.sort(key=lambda r: len(r[2]))
                    i = 0
                    while i < len(rows):
                        # The longest row of a block sets its width; long windows are aligned alone.
                        take = max(1, min(64, ALIGNED // max(1, len(rows[min(i + 63, len(rows) - 1)][2]))))
                        block = rows[i:i + take]
                        i += take
                        padded = np.zeros((len(block), len(block[-1][2])), np.uint64)
                        for r, (_, _, w) in enumerate(block):
                            padded[r, :len(w)] = w
                        best = _align(items.words[item], padded) / (2 * len(items.words[item]))
                        out += [(doc, int(items.ids[item]), float(s), count) for (doc, count, _), s in zip(block, best) if s >= least]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "score", "n_seeds"])

        found.append(_hits(docs, shared, n, stride).mapInArrow(run, "doc_id long, item_id long, score double, n_seeds long"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The pairs whose alignment shows a copy, exact or edited."""
    return matches(docs, benchmark, least=least)
