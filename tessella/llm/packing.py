"""Best-fit packing by patterns: non-negative least squares over the length histogram.

Documents are tokenised (the ids of the given tokenizer, then id 0) and cut
into pieces of at most ``size`` tokens; all of a document's pieces but the
first are full. Only the histogram of piece lengths, at most ``size`` numbers,
reaches the driver. There patterns of a few lengths that nearly fill a
sequence are listed, non-negative least squares fits how often each is used,
the counts are rounded so that their sums are kept, and what the histogram
holds beyond them is packed by best fit on lengths and counts (never on single
pieces). The plan
is a table of pattern slots whose size depends on ``size`` alone.

Pieces get their sequence by rank among the pieces of equal length. Ranks are
dealt in salted buckets, so a length that holds a third of all pieces is
ranked by many tasks.

Defined results: null or empty text is one piece with id 0 alone; special
strings in a text get the ids the tokenizer gives them; rows that repeat a
doc_id are packed each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SIZE = 2048
#: Longest run of blanks, or of anything else, that the quick engine gets.
USUAL_WORD = 4000
_LONG_RUN = re.compile(rf"(?<!\S)\S{{{USUAL_WORD}}}|(?<!\s)\s{{{USUAL_WORD}}}")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
#: Share of a sequence that a pattern fills at least; what only emptier ones could hold is packed by best fit.
LEAST_FILL = 0.95
_loaded: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian bytes.

    The tokenizer file's vocabulary and merges drive two engines with equal
    results: a quick one for texts whose words are of usual length, and the
    ``tokenizers`` library for the others (the quick one is square in a word's
    length) and for files that aren't plain byte-level BPE.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), _quick(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.quick is None or len(text) > USUAL_WORD and _LONG_RUN.search(text):
                slow.append(i)
            else:
                out[i] = self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else ()):
            out[i] = np.asarray(e.ids, "<u4").tobytes()
        return out


def _quick(path: str):
    """An engine over the file's ranks, or None if ids don't follow merge order or the file does more than byte-level BPE."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or model.get("dropout") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")) or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    # Byte-level BPE writes printable bytes as themselves and the others as the characters from U+0100 on.
    plainly = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plainly)]
    byte_of = {chr(b): b for b in plainly} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder_of(path: str) -> Encoder:
    """This process' encoder for a tokenizer."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, salts: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a rank bucket for each piece."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for low in range(0, len(ids), 256):
                rows = []
                got = [t or "" for t in texts.slice(low, 256).to_pylist()]
                for doc, data in zip(ids[low:low + 256], encoder.encode(got)):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    first = (n - 1) % size + 1
                    for k, start in enumerate([0, *range(first, n, size)]):
                        end = first if k == 0 else start + size
                        crc = zlib.crc32(memoryview(data)[4 * start:4 * end])
                        # By document, not content: copies share their content.
                        rows.append((doc, k, start, end - start, crc, (zlib.crc32(str(doc).encode()) + k) % salts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def _patterns(hist: np.ndarray, size: int, per_length: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that fill a sequence as far as the histogram allows."""
    have = np.flatnonzero(hist)[::-1]
    out: set[tuple[int, ...]] = set()
    for a in have:
        out.add((int(a),))
        rest = size - a
        second = have[have <= min(rest, a)][:per_length]
        for b in second:
            out.add((int(a), int(b)))
            third = have[have <= min(rest - b, b)][:2]
            out.update((int(a), int(b), int(c)) for c in third)
        # Also a middle partner that leaves room for a third of its own size.
        half = have[have <= min(rest // 2, a)][:2]
        for b in half:
            third = have[have <= min(rest - b, b)][:2]
            out.update((int(a), int(b), int(c)) for c in third)
    return sorted(out, reverse=True)


def nnls(patterns: list[tuple[int, ...]], hist: np.ndarray, size: int = SIZE, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with least |A x - hist|^2, by accelerated projected gradients.

    A row of A is a piece length, scaled so that tokens count, not pieces. One
    more row, with the target 0, holds each pattern's unused room: of equal
    fits the one that wastes least is found.
    """
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    scale = np.sqrt(np.arange(len(hist), dtype=float))
    room = (size - np.bincount(cols, rows, minlength=len(patterns))) / np.sqrt(size)
    apply = lambda x: np.append(np.bincount(rows, x[cols] * scale[rows], minlength=len(hist)), room @ x)
    back = lambda y: np.bincount(cols, y[rows] * scale[rows], minlength=len(patterns)) + room * y[-1]
    target = np.append(hist * scale, 0.0)
    x = np.zeros(len(patterns))
    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(apply(v))), 1e-9)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - target))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / nt * (new - x), new, nt
    return x


def rounded(patterns: list[tuple[int, ...]], fit: np.ndarray) -> np.ndarray:
    """Whole repeat counts: among the patterns with the same longest piece, fractions are carried on to the next, so that their sum is kept to less than 1."""
    lead = np.array([p[0] for p in patterns])
    upto = np.cumsum(fit)
    first = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
    base = np.repeat((upto - fit)[first], np.diff(np.concatenate([first, [len(lead)]])))
    whole = np.floor(upto - base + 0.5)
    begin = np.zeros(len(lead), bool)
    begin[first] = True
    return np.where(begin, whole, whole - np.concatenate([[0], whole[:-1]])).astype(np.int64)


def by_patterns(hist: np.ndarray, size: int = SIZE, rounds: int = 4) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, count) pairs that the fit asks for, as far as the histogram holds them, and the histogram of what is left.

    Where rounding asks for more of a length than there is, patterns go
    without; what they leave is fitted again.
    """
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for _ in range(rounds):
        before = int(left.sum())
        if not before:
            break
        patterns = _patterns(left, size)
        wanted = rounded(patterns, nnls(patterns, left, size))
        # The fullest first, so that what the rounding asked for too often is missing from the others.
        for i in sorted(np.flatnonzero(wanted).tolist(), key=lambda i: (size - sum(patterns[i]), -wanted[i])):
            need = np.bincount(patterns[i], minlength=len(left))
            at = np.flatnonzero(need)
            n = min(int(wanted[i]), int((left[at] // need[at]).min()))
            if n > 0 and sum(patterns[i]) >= LEAST_FILL * size:
                left[at] -= n * need[at]
                out.append((patterns[i], n))
        if before - int(left.sum()) < before // 20:
            break
    return out, left


def plan(hist: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) pairs that use up the histogram exactly."""
    if not hist.any():
        return []
    out, left = by_patterns(hist, size)
    # Residuals: best fit on lengths with counts, the longest first.
    while left.any():
        a = int(np.flatnonzero(left)[-1])
        pattern, room = [a], size - a
        left[a] -= 1
        while room > 0:
            fits = np.flatnonzero(left[:room + 1])
            if not len(fits):
                break
            b = int(fits[-1])
            pattern.append(b)
            left[b] -= 1
            room -= b
        need = np.bincount(pattern, minlength=len(left))
        at = np.flatnonzero(need)
        more = int((left[at] // need[at]).min())
        left[at] -= more * need[at]
        out.append((tuple(pattern), 1 + more))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, salts: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, tokenizer, size, salts))
    counts = made.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most size * salts rows, whatever the input's size.
    bounded = np.array([(r.length, r.salt, r.n) for r in counts.toLocalIterator()], np.int64).reshape(-1, 3)
    bounded = bounded[np.lexsort((bounded[:, 1], bounded[:, 0]))]
    hist = np.bincount(bounded[:, 0], bounded[:, 2], minlength=size + 1).astype(np.int64)
    first = np.cumsum(bounded[:, 2]) - bounded[:, 2]
    start_of = np.concatenate([[0], np.cumsum(hist)])[:-1]
    base = {(int(a), int(s)): int(f - start_of[a]) for (a, s, _), f in zip(bounded, first)}
    # Slots of each length in rank order: (first rank, sequence id of that rank, offset in the sequence).
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
    used, sequence = np.zeros(size + 1, np.int64), 0
    for pattern, n in plan(hist, size):
        offset = 0
        for length in pattern:
            slots[length].append((int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    tables = spark.sparkContext.broadcast((base, [tuple(np.array(c, np.int64) for c in zip(*s)) if s else None for s in slots]))

    def place(batches):
        base, slots = tables.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for a in np.unique(length):
                at = np.flatnonzero(length == a)
                r = rank[at] - 1 + np.array([base[int(a), int(s)] for s in salt[at]], np.int64)
                first, seq, off = slots[int(a)]
                k = np.searchsorted(first, r, "right") - 1
                sequence[at], offset[at] = seq[k] + r - first[k], off[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
