"""Files: JSONL and per-source output, token shards, fixed-width records and the document index, with their readers.

Executors write binary files through Hadoop's file system (``binaryFile`` reads
them back), so any shared store will do. Layouts are little-endian.
"""

from __future__ import annotations

import io
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header (magic, version, header bytes, record bytes, flags, documents, six shares, end mark, vocabulary) and record (shard, offset, length, category) of the index.
INDEX_HEADER, INDEX_RECORD = "<8sIIIIQ6dII", "<IQIB3x"


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, characters as they are; the committer makes it atomic."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_by_source(df: DataFrame, path: str, key: str = "source") -> None:
    df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").partitionBy(key).parquet(path)


def rewrite_sources(df: DataFrame, path: str, key: str = "source") -> None:
    """Replaces only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as single binary files under ``path``; each row is a file that fits in memory, such as a shard."""
    spark = files.sparkSession
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    folder = Path(path)
    folder.getFileSystem(conf).mkdirs(folder)
    for row in files.toLocalIterator():
        target = Path(f"{path}/{row.name}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytes(row.content))
        out.close()


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def identity(files: DataFrame) -> DataFrame:
    """(path, size, modified) of binary files: what a cache of them is keyed by."""
    return files.select(F.col("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def same_identity(now: DataFrame, cached: DataFrame) -> bool:
    """True if both hold the same (path, size, modified, ...) rows."""
    return not now.exceptAll(cached).head(1) and not cached.exceptAll(now).head(1)


def file_sha256(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def to_npy(rows: DataFrame, name: Column, ids: str) -> DataFrame:
    """(name, content): each row's ids as a one-dimensional uint16 NPY file; ids that don't fit raise an error."""

    def run(batches):
        for batch in batches:
            out = []
            for values in batch.column("ids").to_pylist():
                a = np.asarray(values, np.int64)
                if len(a) and not (0 <= a.min() and a.max() < 1 << 16):
                    raise ValueError("token id outside uint16")
                buffer = io.BytesIO()
                np.save(buffer, a.astype("<u2"))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    return rows.select(name.alias("name"), F.col(ids).alias("ids")).mapInArrow(run, "name string, content binary")


def from_npy(files: DataFrame) -> DataFrame:
    """(path, n, max_token, ids) of NPY shards; a wrong type, order or shape raises an error."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a = np.load(io.BytesIO(data), allow_pickle=False)
                if a.dtype != np.dtype("<u2") or a.ndim != 1:
                    raise ValueError(f"{path}: {a.dtype} of {a.ndim} dimensions, not a row of uint16")
                out.append({"path": path, "n": len(a), "max_token": int(a.max()) if len(a) else -1, "ids": a.astype(np.int32).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("n", pa.int64()), ("max_token", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return files.select("path", "content").mapInArrow(run, "path string, n long, max_token int, ids array<int>")


def records(files: DataFrame, width: int, vocab: int = 32768) -> DataFrame:
    """(path, record, ids) of files of uint16 records of ``width`` ids; a remainder or an id outside the vocabulary raises an error."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if not data or len(data) % (2 * width):
                    raise ValueError(f"{path}: {len(data)} bytes are no whole records of {width}")
                a = np.frombuffer(data, "<u2").reshape(-1, width)
                if a.max() >= vocab:
                    raise ValueError(f"{path}: token {a.max()} is outside the vocabulary")
                for low in range(0, len(a), 4096):
                    part = a[low:low + 4096].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(low, low + len(part))), pa.array(part.tolist(), pa.list_(pa.int32()))], ["path", "record", "ids"])

    return files.select("path", "content").mapInArrow(run, "path string, record long, ids array<int>")


def to_records(rows: DataFrame, name: Column, ids: str) -> DataFrame:
    """(name, content): rows of equal width as uint16 records, one file for each name, in ``row`` order."""
    packed = rows.select(name.alias("name"), "row", F.unhex(F.array_join(F.transform(ids, lambda v: F.concat(F.lpad(F.hex(v.cast("long") % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256).cast("long")), 2, "0"))), "")).alias("b"))
    return packed.groupBy("name").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.hex("b").alias("h")))), lambda x: x["h"]), "")).alias("content"))


def index_bytes(rows, shares: list[float], eod: int = 2, vocab: int = 32768, magic: bytes = b"TESSIDX1", version: int = 2) -> bytes:
    """The index file of (shard, offset, length, category) rows."""
    rows = list(rows)
    head = struct.pack(INDEX_HEADER, magic, version, struct.calcsize(INDEX_HEADER), struct.calcsize(INDEX_RECORD), 0, len(rows), *shares, eod, vocab)
    return head + b"".join(struct.pack(INDEX_RECORD, *r) for r in rows)


def index_rows(files: DataFrame, magic: bytes = b"TESSIDX1", version: int = 2) -> DataFrame:
    """(path, doc, shard, offset, length, category) of index files; a wrong mark, version or size raises an error."""

    def run(batches):
        head_size, record_size = struct.calcsize(INDEX_HEADER), struct.calcsize(INDEX_RECORD)
        kind = np.dtype([("shard", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("category", "u1"), ("pad", "V3")])
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if len(data) < head_size or data[:8] != magic:
                    raise ValueError(f"{path}: not an index")
                head = struct.unpack_from(INDEX_HEADER, data)
                if head[1] != version or len(data) != head_size + head[5] * record_size:
                    raise ValueError(f"{path}: version {head[1]} or size {len(data)} is wrong")
                a = np.frombuffer(data, kind, offset=head_size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(a)), pa.array(np.arange(len(a))), *(pa.array(a[c].astype(np.int64)) for c in ("shard", "offset", "length", "category"))], ["path", "doc", "shard", "offset", "length", "category"])

    return files.select("path", "content").mapInArrow(run, "path string, doc long, shard long, offset long, length long, category long")


def report_json(df: DataFrame, key: str) -> DataFrame:
    """One row with a small aggregate as a JSON object, its keys in order."""
    rows = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*[c for c in df.columns if c != key]).alias("v")))))
    return df.agg(F.to_json(rows).alias("report"))


def corpus_texts(lines: DataFrame) -> DataFrame:
    """JSON lines (value) to ``text``: content, else text; bad JSON or neither raises an error."""
    obj = F.from_json("value", T.StructType([T.StructField("content", T.StringType()), T.StructField("text", T.StringType())]), {"mode": "FAILFAST"})
    t = F.coalesce(obj["content"], obj["text"])
    return lines.where(F.trim("value") != "").select(F.when(t.isNotNull(), t).otherwise(F.raise_error(F.concat(F.lit("no text in "), F.substring("value", 1, 200)))).cast("string").alias("text"))


def last_json(lines: DataFrame, key: str, schema: str) -> DataFrame:
    """Per key the last line (by line_no) that is a JSON object, parsed."""
    rows = lines.withColumn("obj", F.from_json("value", schema)).where(F.ltrim("value").startswith("{") & F.col("obj").isNotNull())
    return rows.groupBy(key).agg(F.max_by("obj", "line_no").alias("obj")).select(key, "obj.*")


def json_lines(rows) -> str:
    """Rows as JSON lines, for small reports made on the driver."""
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
