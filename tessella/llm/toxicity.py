"""Toxicity by a linear-chain conditional random field over tokens.

Only documents carry labels, so token labels are derived from them: a token is
labelled toxic if its document is and if the token (whole, or its first four
to seven bytes) occurs in far more toxic than clean documents of the sample.
The field's features are those log-odds for the token and its neighbours;
forward-backward marginals give each token's probability. A document's score
is a logistic function of its highest marginal and of the expected number of
toxic tokens, and runs of likely tokens are returned as spans.

``PER_CLASS`` rows and ``sampling.CLASS_BYTES`` bytes of each class bound the
labelled sample, of which near copies count once; the
logistic function is fitted with each class weighted to its share of all
training labels. All texts are scored whole.

Defined results: null or blank text has no tokens and gets the score of a
document without toxic tokens; without training labels of both kinds every
score is 0; repeated rows are scored one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import slices, text_bytes
from .sampling import class_weights, labelled
from .words import mix, prefixes, words

PER_CLASS = 2000
#: Stretches of tokens, and times a toxic document is to be covered, in fitting.
STRETCHES, COVER = 3000, 3
PREFIXES = (4, 5, 6, 7)
_LEAST_ODDS = 2.5
_SLICE = 1 << 20


def _tokens(text: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows and the fingerprints (whole, prefixes) of tokens."""
    starts, ends, rows, whole = words(text, offsets, punctuation=True)
    return starts, ends, rows, [whole, *(mix(k) for k in prefixes(text, starts, ends, PREFIXES))]


def _features(kinds: list[np.ndarray], rows: np.ndarray, tables) -> np.ndarray:
    """Log-odds of the token by whole word and prefixes, their maximum, and the neighbours' maxima."""
    own = np.zeros((len(rows), len(kinds)))
    for k, (values, (keys, odds)) in enumerate(zip(kinds, tables)):
        if len(keys):
            low = np.zeros(1 << 16, bool)
            low[keys & np.uint64(0xFFFF)] = True
            some = np.flatnonzero(low[values & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(keys, values[some]), len(keys) - 1)
            own[some, k] = np.where(keys[at] == values[some], odds[at], 0)
    top = own.max(axis=1) if len(own) else np.zeros(0)
    before, after = np.zeros(len(rows)), np.zeros(len(rows))
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        before[1:], after[:-1] = np.where(same, top[:-1], 0), np.where(same, top[1:], 0)
    return np.column_stack([np.ones(len(rows)), top, own, before, after])


def _lexicon(tokens, y: np.ndarray, totals: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, log-odds) of the tokens and prefixes that mark toxic documents.

    Of those with high log-odds, the ones that occur in a twentieth of the
    toxic documents are taken; of the others, the ones that cover most toxic documents are
    taken one after another until each document is covered ``COVER`` times or
    none covers enough; words that merely stand beside them in a few toxic
    documents add nothing and stay out.
    """
    found, rows = [], []
    for k in range(1 + len(PREFIXES)):
        each = [t[k] for t in tokens]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        sizes = [len(e) for e in each]
        label, doc = np.repeat(y, sizes), np.repeat(np.arange(len(each)), sizes)
        clean, toxic = np.bincount(at[label == 0], minlength=len(keys)), np.bincount(at[label == 1], minlength=len(keys))
        odds = np.log((toxic + 0.5) / totals[1]) - np.log((clean + 0.5) / totals[0])
        use = np.flatnonzero((odds >= _LEAST_ODDS) & (toxic >= 3))
        slot = np.full(len(keys), -1)
        slot[use] = np.arange(len(use)) + len(found)
        found += [(k, keys[i], min(odds[i], 8.0)) for i in use]
        hit = (slot[at] >= 0) & (label == 1)
        rows.append(np.column_stack([slot[at[hit]], doc[hit]]))
    hits = np.concatenate(rows)
    often = np.bincount(hits[:, 0], minlength=len(found))
    taken = [int(i) for i in np.flatnonzero(often >= 0.05 * totals[1])] if len(found) else []
    known = np.isin(hits[:, 0], taken)
    need = COVER - np.bincount(hits[known, 1], minlength=len(y))
    hits = hits[~known]
    while len(hits):
        gain = np.bincount(hits[:, 0], need[hits[:, 1]] > 0, minlength=len(found))
        best = int(np.argmax(gain + 1e-3 * np.array([f[2] for f in found])))
        if gain[best] < max(3, 0.01 * totals[1]):
            break
        taken.append(best)
        mine = hits[:, 0] == best
        need[hits[mine, 1]] -= 1
        hits = hits[~mine]
    tables = []
    for k in range(1 + len(PREFIXES)):
        own = sorted((int(found[i][1]), float(found[i][2])) for i in taken if found[i][0] == k)
        tables.append((np.array([a for a, _ in own], np.uint64), np.array([o for _, o in own])))
    return tables


def _summary(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    high = np.zeros(n)
    np.maximum.at(high, rows, p)
    return np.column_stack([high, np.log1p(np.bincount(rows, p, minlength=n))])


def _groups(offsets: np.ndarray, chosen: np.ndarray):
    """The chosen texts in groups of about ``_SLICE`` bytes."""
    sizes = np.concatenate([[0], np.cumsum(np.diff(offsets)[chosen])])
    return [chosen[low:high] for low, high in slices(sizes, _SLICE)]


def _joined(text: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [text[offsets[r]:offsets[r + 1]] for r in group]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS):
    """The model (tables, weights, transitions, document weights), or None without labels of both kinds.

    The sample's texts are gone through three times, a slice at a time: for
    the tokens each document has, for the stretches to fit on, and for the
    documents' summaries; the features of all tokens are never held at once.
    """
    texts, y, counts = labelled(docs, labels, "toxic", train, per_class)
    text, offsets = text_bytes(texts)
    chosen, kept_y, tokens, lengths, seen = [], [], [], [], set()
    for r in range(len(y)):
        part = text[offsets[r]:offsets[r + 1]]
        _, _, rows, kinds = _tokens(part, np.array([0, len(part)]))
        if len(rows) > 8:
            runs = mix(mix(mix(kinds[0][:-2]) + kinds[0][1:-1]) + kinds[0][2:])
            marks = {int((runs * s).min()) for s in np.array([3, 5, 7, 11], np.uint64)}
            if len(marks & seen) >= 3:
                continue
            seen |= marks
        chosen.append(r)
        kept_y.append(y[r])
        lengths.append(len(rows))
        tokens.append([np.unique(k) for k in kinds])
    y, chosen, lengths = np.array(kept_y, int), np.array(chosen, int), np.array(lengths, int)
    if not (y == 0).any() or not (y == 1).any():
        return None
    tables = _lexicon(tokens, y, np.array([(y == 0).sum(), (y == 1).sum()]))
    del tokens
    # Chains for fitting: stretches of at most 128 tokens of one document, evenly among all of them.
    per = -(-lengths // 128)
    some = np.unique(np.linspace(0, per.sum() - 1, min(STRETCHES, per.sum())).astype(int))
    firsts, at = np.cumsum(per) - per, 0
    x_some, y_some, sizes = [], [], []
    for group in _groups(offsets, chosen):
        _, _, rows, kinds = _tokens(*_joined(text, offsets, group))
        x = _features(kinds, rows, tables)
        begins = np.searchsorted(rows, np.arange(len(group)))
        for d in range(len(group)):
            for k in some[(some >= firsts[at + d]) & (some < firsts[at + d] + per[at + d])] - firsts[at + d]:
                low = begins[d] + 128 * k
                high = min(low + 128, begins[d] + lengths[at + d])
                x_some.append(x[low:high])
                y_some.append((x[low:high, 1] >= _LEAST_ODDS) & (y[at + d] == 1))
                sizes.append(high - low)
        at += len(group)
    weights, trans = crf.train(np.concatenate(x_some), np.concatenate(y_some), np.array(sizes), rounds=100, rate=0.2)
    del x_some, y_some
    summaries = []
    for group in _groups(offsets, chosen):
        _, _, rows, kinds = _tokens(*_joined(text, offsets, group))
        n = np.bincount(rows, minlength=len(group))
        summaries.append(_summary(crf.Chain(n[n > 0]).marginals(_features(kinds, rows, tables) @ weights, trans), rows, len(group)))
    return tables, weights, trans, crf.logistic(np.concatenate(summaries), y, class_weights(y, counts))


def score(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, and spans of tokens over the threshold (bytes, end exclusive) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            out, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            text, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets, _SLICE) if model else ():
                tables, weights, trans, last = model
                starts, ends, rows, kinds = _tokens(text[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                odds = _features(kinds, rows, tables) @ weights
                counts = np.bincount(rows, minlength=high - low)
                p = crf.Chain(counts[counts > 0]).marginals(odds, trans)
                out[low:high] = crf.apply_logistic(last, _summary(p, rows, high - low))
                for i in np.flatnonzero(p >= threshold):
                    r, base = low + rows[i], offsets[low + rows[i]] - offsets[low]
                    if spans[r] and i and p[i - 1] >= threshold and rows[i - 1] == rows[i]:
                        spans[r][-1]["end"] = int(ends[i] - base)
                    else:
                        spans[r].append({"start": int(starts[i] - base), "end": int(ends[i] - base)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(spans, spans_type)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")
