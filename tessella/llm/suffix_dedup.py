"""Removal of every byte covered by a long string that also starts elsewhere.

The method is suffix sorting by a sample of positions whose tuples get names,
followed by a merge of the remaining suffixes and a comparison of neighbours:

* sample: position p is sampled for the suffixes s in which it holds the least
  fingerprint among the first ``WINDOW`` positions (the leftmost if tied). The
  choice depends on a suffix's own first bytes, so two equal suffixes have
  their sampled position at the same distance, as a difference cover grants
  for every pair of positions, but with about one sampled position in
  ``WINDOW / 2`` bytes and one name per suffix to compare.
* names: the string from p that all suffixes of p contain (core), and the
  longest stretch around p that any of them touches (full), get 64-bit hashes
  of their bytes as names; both together, 128 bits, tell stretches apart. Names that occur once drop out.
* merge: where a full name repeats, all suffixes of p are repeated; only the
  others (at the ends of repeats), with one representative of each repeated
  full name that shares their core, are named again in blocks of ``BLOCK``
  suffixes, and what remains open after that one by one.
* neighbours: equal names are next to each other after the shuffle by name;
  they are counted there, with partial counts in the map tasks.

Names stand for equality only: order among different suffixes isn't needed to
find those that agree in ``LENGTH`` bytes. The positions are chosen by
polynomials modulo 2**64 over random byte images; a collision there changes
which position is sampled, for equal suffixes alike, and so no result.

Defined results: null text counts as empty; texts shorter than ``LENGTH`` keep
all bytes; matches never cross documents; rows are told apart by doc_id and
text, so rows with one doc_id and different texts are documents of their own,
and equal rows repeat each other and lose what any copies lose; a null doc_id
stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_bytes
from .words import mix, powers, prefix_sums

LENGTH = 400
WINDOW = 192
GRAM = 32
BLOCK = 16
_PIECE = 1 << 19
_NAMED = "doc_id long, h long, p int, low int, high int, core long, full long"
_IMAGE = np.random.Generator(np.random.PCG64(99194853)).integers(1, 2**64, 256, dtype=np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minima over ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _names(text: np.ndarray, begin: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """XXH3 of the stretches, seeded by their shape."""
    view, hashed = memoryview(text), xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(view[a:b], s) for a, b, s in zip(begin.tolist(), end.tolist(), shape.tolist())), np.uint64, len(begin))


def _pieces(text: np.ndarray, offsets: np.ndarray, length: int, window: int):
    """For stretches of suffixes: row, suffix, and sampled position of each."""
    n = len(text)
    row_of_start = np.searchsorted(offsets, np.arange(0, n, _PIECE), "right") - 1
    for k, a in enumerate(range(0, n, _PIECE)):
        b = min(a + _PIECE, n)
        low, high = max(0, a - window), min(n, b + window + length)
        buffer = text[low:high]
        if len(buffer) < length:
            continue
        sums = prefix_sums(_IMAGE[buffer])
        up, _ = powers(len(sums))
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * up[:len(sums) - GRAM])
        keyed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        least = _least(keyed, window)
        first = row_of_start[k]
        last = np.searchsorted(offsets, b, "left")
        bounds = offsets[first:last + 1]
        starts = np.maximum(bounds[:-1], a)
        counts = np.maximum(0, np.minimum(bounds[1:] - length + 1, b) - starts)
        rows = np.repeat(np.arange(first, last), counts)
        s = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        p = (least[s - low] & np.uint64(0xFFFFFF)).astype(np.int64) + low
        yield rows, s, p


def _sampled(text, offsets, length, window):
    """Arrays row, p, first and last suffix of p (all within the text), core name and full name."""
    parts = []
    for rows, s, p in _pieces(text, offsets, length, window):
        if not len(s):
            continue
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (rows[1:] != rows[:-1])])
        at = np.flatnonzero(new)
        ends = np.concatenate([at[1:], [len(s)]]) - 1
        row, p = rows[at], p[at]
        left = np.minimum(p - offsets[row], window - 1)
        right = np.minimum(offsets[row + 1] - p, length)
        core = _names(text, p, p + length - window + 1, np.zeros(len(p), np.int64))
        full = _names(text, p - left, p + right, left * 1024 + right)
        parts.append((row, p, s[at], s[ends], core, full))
    if not parts:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    row, p, low, high, core, full = (np.concatenate(c) for c in zip(*parts))
    # A sampled position whose suffixes were cut between two stretches counts once.
    keep = np.concatenate([[True], (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(keep)
    high = np.maximum.reduceat(high, at)
    return [row[at], p[at], low[at], high, core[at], full[at]]


#: Stands for a null doc_id inside the stages.
_NO_ID = -(1 << 63)
_KEY = ["doc_id", "h"]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text; both together tell rows with different texts apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sample(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, p, low, high (first and last suffix of p), core, full."""

    def run(batches):
        for batch in batches:
            ids, h = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            text, offsets = text_bytes(batch.column("text"))
            row, p, low, high, core, full = _sampled(text, offsets, length, window)
            base = offsets[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(h[row]), *(pa.array((x - base).astype(np.int32)) for x in (p, low, high)), pa.array(core.view(np.int64)), pa.array(full.view(np.int64))], ["doc_id", "h", "p", "low", "high", "core", "full"])

    return _texts(docs).mapInArrow(run, _NAMED)


def _named(docs: DataFrame, chosen: DataFrame, length: int, size: int) -> DataFrame:
    """The chosen ranges (doc_id, p, low, high) cut into blocks of ``size`` suffixes at equal distances from p, with core and full names."""
    ranges = chosen.groupBy(*_KEY).agg(F.collect_list(F.struct("p", "low", "high")).alias("ranges"))

    def run(batches):
        for batch in batches:
            ids, h = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            text, offsets = text_bytes(batch.column("text"))
            lists = batch.column("ranges")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            p, low, high = (lists.flatten().field(k).to_numpy().astype(np.int64) + offsets[row] for k in range(3))
            first, last = (p - high) // size, (p - low) // size
            count = last - first + 1
            at = np.repeat(np.arange(len(p)), count)
            j = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at]
            top = p[at] - size * j
            order = np.argsort(top, kind="stable")
            at, top = at[order], top[order]
            bottom, row = top - size + 1, row[at]
            begin, end = np.maximum(bottom, offsets[row]), np.minimum(top + length, offsets[row + 1])
            text = np.ascontiguousarray(text)
            core = _names(text, top, top + length - size + 1, np.zeros(len(at), np.int64))
            full = _names(text, begin, end, (top - begin) * 1024 + end - top)
            home = offsets[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(h[row]), *(pa.array((v - home).astype(np.int32)) for v in (p[at], np.maximum(low[at], bottom), np.minimum(high[at], top))), pa.array(core.view(np.int64)), pa.array(full.view(np.int64))],
                ["doc_id", "h", "p", "low", "high", "core", "full"])

    return _texts(docs).join(ranges, _KEY).select("doc_id", "h", "text", "ranges").mapInArrow(run, _NAMED)


def _settled(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated ranges, ranges whose suffixes must be named more finely) of named ranges."""
    classes = materialize(named.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "p", "low", "high")).alias("one")))
    whole = named.join(classes.where("n > 1").select("core", "full"), ["core", "full"], "left_semi").select("doc_id", "h", "low", "high")
    unsure = classes.groupBy("core").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select("core")
    # Written first, so that the join below has plain exchanges on both sides and a core that many classes share can be split.
    unsure = materialize(unsure)
    out = materialize(whole), materialize(classes.join(unsure, "core", "left_semi").select("one.doc_id", "one.h", "one.p", "one.low", "one.high"))
    discard(classes, unsure)
    return out


def repeated_ranges(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, h, low, high: ranges of suffixes whose first ``length`` bytes also start elsewhere."""
    sampled = materialize(sample(docs, length, window))
    # Written first, as above.
    often = materialize(sampled.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    shared = materialize(sampled.join(often, "core", "left_semi"))
    discard(sampled, often)
    found, chosen = _settled(shared)
    for size in (block, 1):
        named = materialize(_named(docs, chosen, length, size))
        whole, chosen = _settled(named)
        discard(named)
        found = found.unionByName(whole)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept (the remaining bytes) for every row."""
    found = repeated_ranges(docs, length, window).groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            text, offsets = text_bytes(batch.column("text"))
            flat = batch.column("ranges")
            out = []
            for r in range(batch.num_rows):
                data = text[offsets[r]:offsets[r + 1]]
                spans = []
                if flat[r].is_valid and len(flat[r]):
                    values = flat[r].values
                    low, high = values.field(0).to_numpy().astype(np.int64), values.field(1).to_numpy().astype(np.int64) + length
                    order = np.argsort(low, kind="stable")
                    low, high = low[order], np.maximum.accumulate(high[order])
                    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                    spans = list(zip(low[new].tolist(), high[np.concatenate([new[1:], [len(low)]]) - 1].tolist()))
                keep = np.ones(len(data), bool)
                for a, b in spans:
                    keep[a:b] = False
                kept = data[keep].tobytes()
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type, pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return _texts(docs).join(found, _KEY, "left").select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
