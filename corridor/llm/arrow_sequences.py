"""Token ids as Arrow IPC files of equal-length sequences.

``write`` encodes whole texts, orders documents by id over a range of partitions and
writes one pair of Arrow IPC files a partition: the sequences (``ids`` and ``mask``, both
fixed-size lists, in record batches of ``SEQUENCES_PER_BATCH``) and the index of
documents. All but a file's last sequence are full, so any token's place is plain
arithmetic and ``SequenceFile`` reads it without copying. ``read`` goes back from files
to documents.

A task writes under a name of its own and reports it in its row of the manifest, which
is itself a table in the shared folder: a retried or lost task leaves at most an unused
file. Files are reached through ``pyarrow.fs``, so the folder can be any shared store.

Defined results: a null or empty text is one end id; rows with a null id come first;
rows with equal ids stay apart, ordered by a hash of their texts; an empty table writes
nothing and reads back no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corridor.llm import tokens
from corridor.session import materialise, shared_dir

#: Tokens of a sequence, and sequences of a record batch.
SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256


def _schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to an IPC file; holds one batch at most."""

    def __init__(self, sink: pa.NativeFile, length: int) -> None:
        self.length, self.schema = length, _schema(length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0

    def append(self, ids: bytes) -> None:
        own = np.frombuffer(ids, dtype="<u2")
        self.held.append(own)
        self.n_held += len(own)
        self.n_tokens += len(own)
        step = self.length * SEQUENCES_PER_BATCH
        if self.n_held >= step:  # all batches but the last are full, so places stay plain arithmetic
            self._flush(self.n_held // step * step)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held)
        rest = flat[n:]
        step = self.length * SEQUENCES_PER_BATCH
        for at in range(0, n, step):
            self._put(flat[at : min(at + step, n)], None)
        self.held, self.n_held = ([rest] if len(rest) else []), len(rest)

    def _put(self, flat: np.ndarray, n_real: int | None) -> None:
        mask = np.ones(len(flat), dtype=bool)
        if n_real is not None:
            mask[n_real:] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat.astype(np.uint16), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.zeros(-(-self.n_held // self.length) * self.length, dtype=np.uint16)
            flat[: self.n_held] = np.concatenate(self.held)
            self._put(flat, self.n_held)
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of a file; memory-mapped where the store is local."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            self.batch = self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            self.at = k
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view) and the mask of sequence ``i``."""
        k, j = divmod(i, SEQUENCES_PER_BATCH)
        mask = self.reader.get_batch(k).column(1)[j].values.to_numpy(zero_copy_only=False)
        return self._flat(k)[j * self.length : (j + 1) * self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; a view unless they cross a batch."""
        step = self.length * SEQUENCES_PER_BATCH
        parts = []
        while n > 0:
            k, j = divmod(start, step)
            own = self._flat(k)[j : j + n]
            if not len(own):
                raise ValueError("position beyond the file's end")
            parts.append(own)
            start, n = start + len(own), n - len(own)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, tokenizer_path: str, folder: str, length: int = SEQUENCE) -> DataFrame:
    """Write all documents; returns the manifest: ``part, ids_path, docs_path, n_docs, n_tokens``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n_parts = max(1, docs.rdd.getNumPartitions())
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(n_parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer_path).encode
        end = np.array([tokens.END_ID], dtype="<u2").tobytes()
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        writer = index = None
        n_docs = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                ids_sink, docs_sink = (fs.open_output_stream(f"{name}.{x}.arrow") for x in ("ids", "docs"))
                writer = SequenceWriter(ids_sink, length)
                kind = pa.schema([batch.schema.field("doc_id"), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(docs_sink, kind)
            starts, counts = [], []
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                for ids in encode(texts[at : at + 256].to_pylist()):
                    starts.append(writer.n_tokens)
                    writer.append(ids + end)
                    counts.append(writer.n_tokens - starts[-1])
            index.write_batch(
                pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=kind)
            )
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            ids_sink.close()
            docs_sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "ids_path": f"{name}.ids.arrow", "docs_path": f"{name}.docs.arrow", "n_docs": n_docs, "n_tokens": writer.n_tokens}]
            )

    kind = "part long, ids_path string, docs_path string, n_docs long, n_tokens long"
    return materialise(ordered.mapInArrow(run, kind), "sequences-manifest").withColumn("id_type", F.lit(id_type))


def read(manifest: DataFrame, folder: str, id_type: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    The manifest has a row a file, so summing its counts in order is small work.
    """
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n_files = max(1, manifest.count())
    placed = manifest.select("ids_path", "docs_path", base.alias("base")).repartition(n_files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                own = SequenceFile(fs, row["ids_path"])
                with fs.open_input_file(row["docs_path"]) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [zlib.crc32(own.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [docs.column(0), pa.array(starts + row["base"]), docs.column(2), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return placed.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE) -> DataFrame:
    """Write ``docs`` under the shared folder and read the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/sequences-{uuid.uuid4().hex}"
    manifest = write(docs, tokenizer_path, folder, length)
    return read(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
