"""Token ids in Arrow IPC files of fixed-size lists.

Documents are put in order by a range exchange of their texts; each task encodes its range and writes one
file: record batches of `tokens` and `mask`, both fixed-size lists of `seq_len` values, so that sequence i
is a zero-copy slice at a known place. The ids take the smallest unsigned type that holds the vocabulary.
Only the last sequence of a file is padded; its mask is false there. A small index table beside the files
says where each document stands. Every attempt of a task writes a file of its own, and the index, which Spark commits for one
attempt only, names it: what a lost or repeated task has left is read by nobody and no file is renamed or replaced.

Defined results: a null or empty text has the end id alone; null ids come first, ties are ordered by a
hash of the text, repeated rows are written as often as they occur; an empty table gives an index without
rows and no sequences; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import BATCH_BYTES, spark_arrow
from changelens.llm.pretokens import Memo, memo

SEQ_LEN = 2048
BATCH_SEQS = 64
END_ID = 1


def _open(out_dir: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(out_dir if "://" in out_dir else "file://" + out_dir)


def _file_name(shard: int, attempt: int) -> str:
    return f"shard-{shard:06d}-{attempt}.arrow"


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)


def file_schema(seq_len: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class _Writer:
    """Collects ids and writes a record batch whenever BATCH_SEQS sequences are full."""

    def __init__(self, out, seq_len: int, kind: np.dtype):
        self.kind, self.seq_len, self.parts, self.held = kind, seq_len, [], 0
        self.schema = file_schema(seq_len, kind)
        self.file = pa.ipc.new_file(out, self.schema)

    def add(self, ids: np.ndarray):
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= BATCH_SEQS * self.seq_len:
            flat = np.concatenate(self.parts)
            whole = len(flat) // (BATCH_SEQS * self.seq_len) * BATCH_SEQS * self.seq_len
            for at in range(0, whole, BATCH_SEQS * self.seq_len):
                self._write(flat[at : at + BATCH_SEQS * self.seq_len])
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray):
        n = -(-len(flat) // self.seq_len) * self.seq_len
        tokens = np.concatenate([flat, np.zeros(n - len(flat), self.kind)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (tokens, np.arange(n) < len(flat))]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self):
        if self.held:
            self._write(np.concatenate(self.parts))
        self.file.close()


def write_sequences(docs: DataFrame, out_dir: str, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, order: list[Column] | None = None) -> DataFrame:
    """Write the files and the index table under `out_dir`, which every executor must reach; returns the index.

    Index: doc_id, shard, attempt (the two name the file), at (ids before it in the file), n_tokens. `order`: sort columns, ascending; the doc_id unless given.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ids = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", ids), T.StructField("shard", T.IntegerType()), T.StructField("attempt", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])
    arrow = spark_arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt, at, writer = task.partitionId(), task.taskAttemptId(), 0, None
        store, base = _open(out_dir)
        held: Memo = memo(tokenizer)
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            if writer is None and texts:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{_file_name(shard, attempt)}")
                writer = _Writer(sink, seq_len, _kind(held.encoder.size))
            places, lens = [], []
            for i in range(0, len(texts), 64):
                for found in held.ids(texts[i : i + 64]):
                    writer.add(np.append(found, end_id))
                    places.append(at)
                    lens.append(len(found) + 1)
                    at += len(found) + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow.types[0]), pa.array([shard] * len(texts), pa.int32()), pa.array([attempt] * len(texts), pa.int64()), pa.array(places, pa.int64()), pa.array(lens, pa.int64())], schema=arrow)
        if writer:
            writer.close()
            sink.close()

    keys = {f"o{i}": c for i, c in enumerate([*(order or [F.col("doc_id")]), F.xxhash64("text")])}
    placed = docs.select("doc_id", "text", *[c.alias(k) for k, c in keys.items()])
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    placed.mapInArrow(run, out).write.parquet(f"{out_dir}/index")
    return spark.read.schema(out).parquet(f"{out_dir}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with `start`: ids of all documents before, over all files. One row per file is ranked in one task."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = shards.select(F.col("shard"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    return index.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("at")).drop("before")


class Reader:
    """Random access to the files: ids at a place, or a whole sequence with its mask. Local files are mapped, not read."""

    def __init__(self, out_dir: str):
        self.store, self.base = _open(out_dir)
        self.files: dict[tuple[int, int], list] = {}

    def _file(self, *name: int) -> list:
        if name not in self.files:
            self.files.clear()
            path = f"{self.base}/{_file_name(*name)}"
            source = pa.memory_map(path) if self.store.type_name == "local" else self.store.open_input_file(path)
            self.files[name] = [pa.ipc.open_file(source), -1, None]
        return self.files[name]

    def _batch(self, shard: int, attempt: int, i: int) -> pa.RecordBatch:
        held = self._file(shard, attempt)
        if held[1] != i:
            held[1:] = [i, held[0].get_batch(i)]
        return held[2]

    def sequence(self, shard: int, attempt: int, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i of a file: its ids (a view of the file) and its mask."""
        batch = self._batch(shard, attempt, i // BATCH_SEQS)
        n = batch.schema.field("tokens").type.list_size
        k = i % BATCH_SEQS
        return batch.column("tokens").values.to_numpy()[k * n : (k + 1) * n], batch.column("mask").values[k * n : (k + 1) * n]

    def ids(self, shard: int, attempt: int, at: int, n: int) -> np.ndarray:
        size = self._file(shard, attempt)[0].schema.field("tokens").type.list_size * BATCH_SEQS
        parts = [self._batch(shard, attempt, i).column("tokens").values.to_numpy()[max(0, at - i * size) : at + n - i * size] for i in range(at // size, -(-(at + n) // size))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(index: DataFrame, out_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, shard, start, n_tokens, ids_crc32 of the ids as 32-bit integers."""
    found = starts(index)
    out = T.StructType([*(found.schema[c] for c in ("doc_id", "shard", "start")), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    arrow = spark_arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(out_dir)
        for b in batches:
            ids = [reader.ids(*x) for x in zip(*(b.column(c).to_pylist() for c in ("shard", "attempt", "at", "n_tokens")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "shard", "start")), pa.array(map(len, ids), pa.int64()), pa.array((zlib.crc32(i.astype("<u4").tobytes()) for i in ids), pa.int64())], schema=arrow)

    def reads(batches):
        for b in run(batches):
            yield b

    return found.select("doc_id", "shard", "attempt", "start", "at", "n_tokens").mapInArrow(reads, out)


def sequences_dir(spark: SparkSession) -> str:
    from changelens.llm.common import scratch

    return scratch(spark, "sequences")
