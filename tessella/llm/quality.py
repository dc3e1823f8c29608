"""Document quality by a linear-chain conditional random field over lines.

A line's features are its shares of character kinds, its length, the share of
words that repeat the word before, and the same of the lines before and after.
Lines take their document's label for fitting. Forward-backward marginals,
weighted by line length, give the share of good text, and a logistic function
of that share (and of the worst stretch) is the document's score.

``PER_CLASS`` rows and ``sampling.CLASS_BYTES`` bytes of each class bound the
labelled sample; the logistic function is fitted with each class weighted to its share of all training labels. All texts are scored
whole.

Defined results: null, empty or blank text has no lines and gets the share of
good documents among all training labels; without training labels of both kinds every
score is that share (1 without any labels); repeated rows are scored one by
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import slices, text_bytes
from .sampling import class_weights, labelled
from .words import words

PER_CLASS = 2000
_SLICE = 1 << 20
#: Kinds of bytes: 0 other ASCII punctuation, then the ones named.
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,", "!?", "|", "&%$#*@^~"), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 9
_KINDS = 10


def _lines(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, document rows and lengths of the lines that aren't blank."""
    n, rows = len(text), len(offsets) - 1
    new = np.zeros(n + 1, bool)
    new[offsets[:-1]] = True
    new[1:] |= np.concatenate([text == 10])[:n]
    line = np.cumsum(new[:n]) - 1
    count = int(line[-1]) + 1 if n else 0
    table = np.bincount(line * _KINDS + _KIND[text], minlength=count * _KINDS).reshape(count, _KINDS).astype(float)
    size = table.sum(axis=1)
    first = np.flatnonzero(new[:n])
    doc = np.searchsorted(offsets, first, "right") - 1
    starts, _, word_rows, prints = words(text, offsets)
    again = np.zeros(len(starts))
    if len(starts) > 1:
        again[1:] = (prints[1:] == prints[:-1]) & (word_rows[1:] == word_rows[:-1])
    at = line[starts] if len(starts) else np.zeros(0, np.int64)
    n_words = np.bincount(at, minlength=count)
    repeats = np.bincount(at, again, minlength=count) / np.maximum(1, n_words)
    own = np.column_stack([table / np.maximum(1, size)[:, None], repeats, np.log1p(size) / 8, n_words / np.maximum(1, size)])
    keep = size - table[:, 4] > 1
    own, doc, size = own[keep], doc[keep], size[keep]
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(doc) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.column_stack([np.ones(len(own)), own, before, after]), doc, size


def _summary(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(doc, size, minlength=n)
    share = np.bincount(doc, p * size, minlength=n) / np.maximum(1, total)
    low = np.ones(n)
    np.minimum.at(low, doc, p)
    return np.column_stack([share, low])


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS):
    """(scale, weights, transitions, document weights or None, share of good documents)."""
    texts, y, totals = labelled(docs, labels, "quality", train, per_class)
    y = np.array(y, int)
    prior = totals[1] / sum(totals) if sum(totals) else 1.0
    if not (y == 0).any() or not (y == 1).any():
        return None, None, None, None, prior
    text, offsets = text_bytes(texts)
    x, doc, size = _lines(text, offsets)
    scale = np.maximum(x.std(axis=0), 1e-3)
    lengths = np.bincount(doc, minlength=len(y))
    weights, trans = crf.train(x / scale, y[doc], lengths[lengths > 0])
    p = crf.Chain(lengths[lengths > 0]).marginals(x / scale @ weights, trans)
    some = lengths > 0
    return scale, weights, trans, crf.logistic(_summary(p, doc, size, len(y))[some], y[some], class_weights(y, totals)[some]), prior


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scale, weights, trans, last, prior = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, prior)
            text, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets, _SLICE) if last is not None else ():
                x, doc, size = _lines(text[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                counts = np.bincount(doc, minlength=high - low)
                p = crf.Chain(counts[counts > 0]).marginals(x / scale @ weights, trans)
                got = crf.apply_logistic(last, _summary(p, doc, size, high - low))
                out[low:high] = np.where(counts > 0, got, prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
