"""Token streams: shard offsets and their checks, rows packed in order or by draws, position lookup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import materialize, running_total

EOD = 2


def shard_offsets(docs: DataFrame, capacity: int) -> DataFrame:
    """(source, doc_id, tokens, shard, offset): documents in id order fill shards that none straddles; documents without tokens are left out.

    Where a shard begins depends on every earlier length, so a source's
    lengths (not its texts) stream through one task in order; a shard's worth
    of them is placed at a time, and nothing but the open shard is held.
    """

    def run(batches):
        source, shard, used = None, 0, 0
        for batch in batches:
            names, tokens = batch.column("source").to_pylist(), batch.column("tokens").to_numpy()
            shards, offsets = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int64)
            change = np.flatnonzero([a != b for a, b in zip(names[1:], names[:-1])]) + 1
            for low, high in zip([0, *change], [*change, len(names)]):
                if low == high:
                    continue
                if names[low] != source:
                    source, shard, used = names[low], 0, 0
                upto = np.concatenate([[0], np.cumsum(tokens[low:high])])
                i = low
                while i < high:
                    # As many as fit beside what the shard holds; an empty shard takes one of any length.
                    j = low + int(np.searchsorted(upto, upto[i - low] + capacity - used, "right")) - 1
                    if j == i and not used:
                        j = i + 1
                    shards[i:j], offsets[i:j] = shard, used + upto[i - low:j - low] - upto[i - low]
                    used += int(upto[j - low] - upto[i - low])
                    i = j
                    if i < high:
                        shard, used = shard + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("doc_id"), batch.column("tokens"), pa.array(shards), pa.array(offsets)], ["source", "doc_id", "tokens", "shard", "offset"])

    rows = docs.where("tokens > 0").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"))
    return rows.repartition("source").sortWithinPartitions("source", "doc_id").mapInArrow(run, "source string, doc_id long, tokens long, shard int, offset long")


def validate_shards(shards: DataFrame, capacity: int | None = None) -> DataFrame:
    """Per shard: documents, tokens, gaps, overlaps, overruns (beyond ``capacity``, but for a document alone) and whether it follows the shard before."""
    w = Window.partitionBy("source", "shard").orderBy("offset")
    d = shards.withColumn("gap", F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("tokens")).over(w), F.lit(0)))
    over = F.count_if((F.col("offset") > 0) & (F.col("offset") + F.col("tokens") > F.lit(capacity))) if capacity else F.lit(0).cast("long")
    out = d.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"), over.alias("overruns"))
    return out.withColumn("follows", F.col("shard") == F.row_number().over(Window.partitionBy("source").orderBy("shard")) - 1)


def check_coverage(records: DataFrame, info: DataFrame, vocab: int = 32768, most: int = 20) -> DataFrame:
    """(kind, shard, detail) errors of records (shard, offset, tokens, line) against shard_info (shard, tokens, max_token); at most ``most`` of the offset errors, by line."""
    w = Window.partitionBy("shard").orderBy("line")
    want = F.coalesce(F.lag(F.col("offset") + F.col("tokens")).over(w), F.lit(0))
    r = records.withColumn("want", want).join(info.select("shard", F.col("tokens").alias("size"), "max_token"), "shard", "left")
    err = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "shard", F.concat_ws(" ", *detail).alias("detail"))
    offsets = err(r.where("size is not null and offset <> want").orderBy("line").limit(most), "offset", [F.lit("line"), "line", F.lit("offset"), "offset", F.lit("expected"), "want"])
    covered = records.groupBy("shard").agg(F.max(F.col("offset") + F.col("tokens")).alias("covered"))
    out = offsets.unionByName(err(r.where("size is null"), "unknown_shard", [F.lit("line"), "line"])).unionByName(err(r.where("offset + tokens > size"), "overrun", [F.lit("line"), "line"]))
    out = out.unionByName(err(info.join(covered, "shard", "left").where("coalesce(covered, 0) <> tokens"), "coverage", [F.coalesce("covered", F.lit(0)), F.lit("of"), "tokens"]))
    return out.unionByName(err(info.where(F.col("max_token") >= vocab), "vocabulary", ["max_token"]))


def sequential_rows(docs: list[list[int]], length: int, eod: int, count: int) -> list[list[int]]:
    """Rows of length + 1 tokens over the documents in order, again and again; an end mark follows a document where the row has room."""
    if not any(docs):
        raise ValueError("no documents to pack")
    rows, doc, at = [], 0, 0
    while len(rows) < count:
        row: list[int] = []
        while len(row) <= length:
            take = docs[doc][at:at + length + 1 - len(row)]
            row += take
            at += len(take)
            if at == len(docs[doc]):
                doc, at = (doc + 1) % len(docs), 0
                if len(row) <= length:
                    row.append(eod)
        rows.append(row)
    return rows


def pack_sequential(docs: DataFrame, keys: list[str], length: int, eod: int = EOD) -> DataFrame:
    """One pass over the documents (doc_id, tokens array) of each group as rows of length + 1 tokens: keys, row, ids; the last row goes on from the group's beginning.

    Where a row ends exactly with a document the end mark is left out, so a
    row's place depends on all before it: a group streams through one task in
    id order, which holds the open row and the group's first row.
    """
    n = length + 1

    def run(batches):
        group, row, open_, head = None, 0, [], []

        def closing():
            if group is not None and open_:
                filled = open_
                while len(filled) < n:
                    filled = filled + head
                return [(*group, row, filled[:n])]
            return []

        for batch in batches:
            out = []
            cols = [batch.column(k).to_pylist() for k in keys]
            for *key, ids in zip(*cols, batch.column("tokens").to_pylist()):
                if not ids:
                    continue
                if tuple(key) != group:
                    out += closing()
                    group, row, open_, head = tuple(key), 0, [], []
                at = 0
                while at < len(ids):
                    take = ids[at:at + n - len(open_)]
                    open_, at = open_ + take, at + len(take)
                    if at == len(ids) and len(open_) < n:
                        open_ = open_ + [eod]
                    if len(head) < n:
                        head = open_ if row == 0 else head
                    if len(open_) == n:
                        out.append((*group, row, open_))
                        row, open_ = row + 1, []
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "row", "ids"], r)) for r in out], schema)
        last = closing()
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "row", "ids"], r)) for r in last], schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = [docs.schema[k].dataType.simpleString() for k in keys]
    schema = pa.schema([*[(k, kinds[t]) for k, t in zip(keys, types)], ("row", pa.int64()), ("ids", pa.list_(pa.int32()))])
    spec = ", ".join([*[f"{k} {t}" for k, t in zip(keys, types)], "row long", "ids array<int>"])
    return docs.select(*keys, "doc_id", F.col("tokens").cast("array<int>").alias("tokens")).repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, spec)


def position_lookup(cumulative: DataFrame, draws: DataFrame, width: int, keys: list[str] = []) -> DataFrame:
    """The interval [low, high) of the same keys that holds each draw's position, by an equi-join on buckets of ``width``."""
    buckets = cumulative.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    return draws.withColumn("bucket", F.floor(F.col("position") / width)).join(buckets, [*keys, "bucket"]).where("position >= low and position < high").drop("bucket")


def draw(*parts) -> F.Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", *[p if not isinstance(p, (int, str)) else F.lit(str(p)) for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixture(docs: DataFrame, wanted: dict[str, float], mode: str = "target") -> DataFrame:
    """(category, tokens, p): ``target`` shares, or token totals times weights; absent categories drop out and the rest is scaled to 1."""
    totals = docs.groupBy("category").agg(F.sum("length").cast("long").alias("tokens")).where("tokens > 0")
    want = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("category"))
    raw = totals.withColumn("raw", want * (F.col("tokens") if mode == "weights" else F.lit(1.0))).where("raw > 0")
    return raw.withColumn("p", F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).drop("raw")


def pack_sampled(docs: DataFrame, wanted: dict[str, float], rows: int, length: int, seed: int, first_row: int = 0, mode: str = "target", draws: int = 8) -> DataFrame:
    """(row, k, doc_id, start, take, eod): the stretches that fill ``rows`` rows of length + 1 tokens.

    Each stretch is a draw of a category by its share and of a token position
    in it, read to the document's or the row's end, with an end mark where
    there is room. A draw depends on (seed, row, k) alone, so the state of the
    sampler is the number of rows handed out (``first_row``). Rows that
    ``draws`` stretches don't fill get as many again, until all are full.
    """
    spark = docs.sparkSession
    mix = mixture(docs, wanted, mode)
    edges = mix.withColumn("high_p", F.sum("p").over(Window.partitionBy(F.lit(0)).orderBy("category"))).withColumn("low_p", F.col("high_p") - F.col("p"))
    shares = edges.collect()
    if not shares:
        raise ValueError("no documents to pack")
    kept = docs.where("length > 0").join(F.broadcast(mix.select("category")), "category")
    cum = materialize(running_total(kept.select("category", "doc_id", "length"), ["category"], ["doc_id"], F.col("length"), "high").withColumn("low", F.col("high") - F.col("length")))
    open_ = spark.range(first_row, first_row + rows).withColumnRenamed("id", "row").withColumn("filled", F.lit(0).cast("long"))
    out, k0 = None, 0
    width = max(1, int(np.median([r.tokens for r in shares])) // 1024)
    while True:
        d = open_.withColumn("k", F.explode(F.sequence(F.lit(k0), F.lit(k0 + draws - 1)))).withColumn("u", draw(seed, F.col("row"), F.col("k"), "c"))
        cat, total = F.lit(shares[-1].category), F.lit(shares[-1].tokens)
        for r in reversed(shares[:-1]):
            cat, total = F.when(F.col("u") < r.high_p, r.category).otherwise(cat), F.when(F.col("u") < r.high_p, r.tokens).otherwise(total)
        d = d.withColumn("category", cat).withColumn("position", F.floor(draw(seed, F.col("row"), F.col("k"), "p") * total).cast("long"))
        got = position_lookup(cum, d, width, ["category"]).withColumn("avail", F.col("high") - F.col("position"))
        w = Window.partitionBy("row").orderBy("k")
        got = got.withColumn("at", F.col("filled") + F.coalesce(F.sum(F.col("avail") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("at") <= length)
        got = materialize(got.select("row", "k", "category", "doc_id", (F.col("position") - F.col("low")).alias("start"), F.least("avail", F.lit(length + 1) - F.col("at")).alias("take"), (F.col("at") + F.col("avail") <= length).alias("eod")))
        out = got if out is None else out.unionByName(got)
        open_ = materialize(out.groupBy("row").agg(F.sum(F.col("take") + F.col("eod").cast("long")).alias("filled")).where(F.col("filled") <= length))
        if not open_.head(1):
            return out
        k0 += draws
