"""Near-duplicate documents by a chosen-path set similarity join.

Every document is the set of its distinct word shingles. Documents with equal
sets are one class from the start, so large groups of copies never meet. Each
class keeps a sketch of minwise tokens. A tree branches the classes by one
chosen sketch coordinate after another (the path); a node with at most
``small_node`` members is compared exhaustively, a larger one branches again,
and a node that is still larger at the last level (its members share every
chosen token) is compared with one pivot first, the member with the smallest
id, which connects most of it without listing all its pairs. What the
confirmed links leave in several components is then compared whole: members
outside a node's largest component, in blocks, with all members of other
components and like size, so no link between components of a node is left
out, and nothing is compared that couldn't change a component. ``trees``
independent trees bring a pair at the threshold (0.75) together but for a
chance of (1 - 0.75^k)^trees, k being the level at which it meets: with 24
trees 2.4e-9 at level 2, 1.9e-6 at level 3 and 1.1e-4 at level 4. Candidate pairs
whose sketches put them far below the threshold are left out by an estimate
more than five standard errors wide (a chance of 4e-8 at 0.75); all others are confirmed on their full sets.
Components come from alternating star contraction of the confirmed links.

Defined results: null or wordless text is an empty set, linked with nothing;
a text with fewer words than a shingle is one shingle; equal texts are linked;
a null doc_id is never the one to keep and gets
a null kept; rows that repeat a doc_id are classes by their own sets; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, text_bytes
from .url_filter import block_of, bloom_filter, mask_of
from .words import mix, shingles, words

#: Sketch coordinates: each tree uses LEVELS[-1] of its own.
TREES = 24
LEVELS = (2, 3, 4)
SMALL_NODE = 16
#: Upper bound of the Bloom filter of ids to confirm (rows of an int and a long).
MAX_BLOCKS = 1 << 20
_SLICE = 1 << 20
#: Members in a block of a crowded node, and members a task streams past one block.
BLOCK = 256
BLOCK_BYTES = 32 << 20
STREAM = 8192
#: Below this estimate of the similarity a pair is left out (5.7 standard errors under 0.75 with 96 coordinates: a chance of 4e-8).
_LEAST_ESTIMATE = 0.5


def _sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingle fingerprints) for each row of a batch of (doc_id, text)."""
    text, offsets = text_bytes(batch.column("text"))
    for low, high in slices(offsets, _SLICE):
        _, _, rows, prints = words(text[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        values, bounds, _ = shingles(rows, prints, high - low, width)
        for r in range(high - low):
            yield low + r, np.unique(values[bounds[r]:bounds[r + 1]])


def sketches(docs: DataFrame, width: int = 5, size: int = TREES * LEVELS[-1]) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the whole set, and its sketch of ``size`` 32-bit minwise tokens."""
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, one, two, sketch = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), [b""] * n
            group: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush():
                if not group:
                    return
                values = np.concatenate([v for _, v in group])
                starts = np.concatenate([[0], np.cumsum([len(v) for _, v in group])[:-1]])
                at = [r for r, _ in group]
                one[at] = np.add.reduceat(mix(values), starts)
                two[at] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts)
                least = np.empty((len(at), size), np.uint32)
                for k in range(size):
                    least[:, k] = np.minimum.reduceat((values * seeds[k] >> np.uint64(32)).astype(np.uint32), starts)
                for i, r in enumerate(at):
                    sketch[r] = least[i].tobytes()
                group.clear()

            for r, values in _sets(batch, width):
                counts[r] = len(values)
                if len(values):
                    group.append((r, values))
                    held += len(values)
                    if held > 1 << 16:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def _paths(classes: DataFrame, trees: int, levels: tuple[int, ...]) -> DataFrame:
    """For each class and tree its node at each level: node_0, node_1, ..."""
    deep = levels[-1]

    def run(batches):
        for batch in batches:
            ids = batch.column("rep").to_numpy()
            if not len(ids):
                continue
            raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(ids), -1).astype(np.uint64)
            for t in range(trees):
                node, out = np.full(len(ids), t + 1, np.uint64), []
                for d in range(deep):
                    node = mix(node * np.uint64(0xD6E8FEB86659FD93) + raw[:, t * deep + d])
                    if d + 1 in levels:
                        out.append(pa.array(node.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), t, np.int32)), *out], ["rep", "tree", *(f"node_{k}" for k in range(len(out)))])

    return classes.select("rep", "sketch").mapInArrow(run, "rep long, tree int, " + ", ".join(f"node_{k} long" for k in range(len(levels))))


def candidates(classes: DataFrame, trees: int = TREES, levels: tuple[int, ...] = LEVELS, small_node: int = SMALL_NODE) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of classes that meet in a small node or at a pivot, and the members (node, tree, rep) of nodes crowded at the last level."""
    rows = _paths(classes, trees, levels)
    found = []
    for k in range(len(levels)):
        node = f"node_{k}"
        sizes = rows.groupBy(node).agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
        rows = materialize(rows.join(sizes, node))
        small = rows.where(F.col("size") <= small_node)
        members = small.groupBy(node).agg(F.collect_set("rep").alias("m"))
        pairs = members.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b")
        found.append(pairs)
        rows = rows.where(F.col("size") > small_node)
        if k == len(levels) - 1:
            found.append(rows.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).where("a < b"))
            crowded = rows.select(F.col(node).alias("node"), "tree", "rep")
        rows = rows.drop("size", "pivot")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct(), crowded


def crossing(crowded: DataFrame, classes: DataFrame, found: DataFrame, docs: DataFrame, width: int, percent: int, trees: int = TREES, block: int = BLOCK, stream: int = STREAM) -> DataFrame:
    """Links (a < b) between members of one crowded node that lie in different components, found on full sets.

    Members outside the node's largest component form blocks of about
    ``block`` members and ``BLOCK_BYTES``; all members stream past them, at
    most about ``stream`` a task, so neither a node nor a block has to fit in
    one task. Pairs are compared where they meet and never become rows: a task
    returns only links that join components it still knew as apart, fewer than
    it has members. A pair that an earlier tree has brought into one node is
    left to that tree.
    """
    of = found.select(F.col("node").alias("rep"), "component")
    rows = crowded.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("node").agg(F.max(F.struct("n", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    rows = materialize(rows.join(mixed, "node").join(classes.select("rep", "n_shingles", "sketch"), "rep")
                       .withColumn("loose", F.col("component") != F.col("main")).withColumn("band", F.floor(F.log("n_shingles") / F.log(F.lit(1.34)))).drop("main"))
    sets = full_sets(rows.select(F.col("rep").alias("doc_id")).distinct(), docs, width)
    # Sizes of linked sets differ by a third at most, so by one band at most.
    near = rows.select("rep", "node", "tree", "component", "n_shingles", "sketch", "loose", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    bytes_ = F.sum(F.col("n_shingles") * 8)
    blocks = rows.where("loose").groupBy("node", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, bytes_ / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    streams = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / stream).cast("int").alias("n_streams"))
    plan = materialize(blocks.join(streams, "node"))

    def part(count, seed):
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(count)).cast("int")

    def copies(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    held = rows.where("loose").join(plan, ["node", "band"]).withColumn("block", part("n_blocks", 1)).withColumn("stream", copies("n_streams")).withColumn("passes", F.lit(False))
    moving = near.join(plan, ["node", "band"]).withColumn("stream", part("n_streams", 2)).withColumn("block", copies("n_blocks")).withColumn("passes", F.lit(True))
    key = ["node", "band", "block", "stream"]
    columns = [*key, "passes", "rep", "tree", "component", "n_shingles", "loose", "sketch", "set"]
    both = held.select(columns[:-1]).unionByName(moving.select(columns[:-1])).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    lined = both.select(columns).repartition(*key).sortWithinPartitions(*key, "passes", "rep")

    def run(batches):
        last, ids, parts, counts, tokens, whole, joined = None, [], [], [], [], [], {}

        def root(x):
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            passes, loose = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("passes", "loose"))
            rep, tree, component, n = (batch.column(c).to_numpy() for c in ("rep", "tree", "component", "n_shingles"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(rep), -1)
            some = batch.column("set")
            turn = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (passes[1:] != passes[:-1])) + 1
            a, b = [], []
            for low, high in zip([0, *turn], [*turn, len(rep)]):
                here = tuple(keys[:, low])
                if here != last:
                    last, ids, parts, counts, tokens, whole, joined = here, [], [], [], [], [], {}
                if not passes[low]:
                    ids += rep[low:high].tolist()
                    parts += component[low:high].tolist()
                    counts += n[low:high].tolist()
                    tokens += list(sketch[low:high].copy())
                    whole += [np.frombuffer(some[k].as_py(), np.uint64) for k in range(low, high)]
                    continue
                for i, who in enumerate(ids):
                    apart = (component[low:high] != parts[i]) & (~loose[low:high] | (rep[low:high] > who))
                    fits = np.flatnonzero(apart & (100 * np.minimum(n[low:high], counts[i]) >= percent * np.maximum(n[low:high], counts[i])))
                    if not len(fits):
                        continue
                    same = sketch[low:high][fits] == tokens[i]
                    ok = same.mean(axis=1) >= _LEAST_ESTIMATE
                    if tree[low]:
                        ok &= ~same.reshape(len(fits), trees, -1)[:, :tree[low]].all(axis=2).any(axis=1)
                    for k in (fits[ok] + low).tolist():
                        x, y = root(parts[i]), root(int(component[k]))
                        if x != y and _alike(whole[i], np.frombuffer(some[k].as_buffer(), np.uint64), percent):
                            joined[max(x, y)] = min(x, y)
                            a.append(min(who, int(rep[k])))
                            b.append(max(who, int(rep[k])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = materialize(lined.mapInArrow(run, "a long, b long").distinct())
    discard(rows, plan, sets)
    return out


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """percent * union <= 100 * intersection of two sorted sets."""
    at = np.searchsorted(x, y)
    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches don't rule it out."""
    side = classes.select("rep", "n_shingles", "sketch")
    both = (pairs.join(side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b")), "b")
            .join(side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a")), "a")
            .where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
            keep = (a == b).mean(axis=1) >= _LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def full_sets(needed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, set): the sorted shingle fingerprints of the documents with the ids of ``needed``."""

    def whole(batches):
        for batch in batches:
            got = [b""] * batch.num_rows
            for r, values in _sets(batch, width):
                got[r] = values.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A Bloom filter of bounded size keeps most other texts out of the shuffle; the join after it is exact.
    needed = materialize(needed)
    blocks = min(MAX_BLOCKS, 1 << max(4, (needed.count() // 4).bit_length()))
    bits = bloom_filter(needed.select(F.col("doc_id").alias("canonical")), blocks)
    texts = (texts.withColumn("block", block_of(F.col("doc_id"), blocks)).withColumn("mask", mask_of(F.col("doc_id"))).join(F.broadcast(bits), "block")
             .where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("doc_id", "text"))
    sets = texts.join(needed, "doc_id", "left_semi").mapInArrow(whole, "doc_id long, set binary")
    # Rows that repeat a doc_id: equal sets count once; of different ones the first.
    out = materialize(sets.groupBy("doc_id").agg(F.min("set").alias("set")))
    discard(needed)
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with percent * union <= 100 * intersection, on the full sets."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, width)
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a"))

    def run(batches):
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    out = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest id reachable) for every node with a link.

    Alternating large-star and small-star contraction; every round is written
    to the shared folder, and only the number of changed edges reaches the
    driver.
    """
    edges = materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(both.join(least, "u").where("v > u and v > m").select(F.col("m").alias("u"), "v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").where("u < v").distinct()
        after = materialize(small)
        discard(edges, large)
        edges = after
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    out = materialize(edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component")))
    discard(edges)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, trees: int = TREES, levels: tuple[int, ...] = LEVELS, small_node: int = SMALL_NODE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    sketched = materialize(sketches(docs, width, trees * levels[-1]))
    some = sketched.where("n_shingles > 0")
    keys = ["set_a", "set_b", "n_shingles"]
    groups = materialize(some.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")).where("rep is not null"))
    met, crowded = candidates(groups, trees, levels, small_node)
    pairs = materialize(_estimated(met, groups))
    links = _confirmed(pairs, docs, width, percent)
    found = components(links)
    more = crossing(crowded, groups, found, docs, width, percent, trees)
    discard(pairs, links)
    if more.head(1):
        # Contracted: the links found so far count as each node's link to its component.
        joined = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = components(joined.unionByName(more))
    classes = groups.drop("sketch").join(found, groups.rep == found.node, "left").select(*keys, F.coalesce("component", "rep").alias("c"))
    return (sketched.drop("sketch").join(classes, keys, "left")
            .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
