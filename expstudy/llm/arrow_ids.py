"""Token ids in Arrow IPC files of fixed-size lists, for random access without copying.

Documents are range-partitioned and sorted by doc_id.  Each partition writes two files into the
shared folder: ``part-N.arrow`` holds its tokens as rows of ``ROW`` ids with a mask (true: a
token, false: padding of the file's last row), unsigned 16-bit ids where the vocabulary
allows, ``BATCH`` rows a record batch, so that row r is
row ``r mod BATCH`` of batch ``r // BATCH`` and its ids are a slice of the mapped file;
``part-N.docs.arrow`` has the documents' ids, starts (in the file) and lengths.  The files of
a partition are written under the task attempt's own name and then moved, so a lost executor or
a repeated task leaves nothing half written.  Prefix sums over the files' totals give the
global starts.

Cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids are
ordered by their texts, each a document of its own; an empty table writes no files and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.llm.common import batched, work_dir, written
from expstudy.llm.tokens import encoder, tokenizer_path

#: Tokens in a row, and rows in a record batch (2 MB of 16-bit ids).
ROW, BATCH = 2048, 512
_FILES = "part int, tokens long, docs long, path string"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _rows_schema(row: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, row)), ("mask", pa.list_(pa.bool_(), row))])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _fixed(ids: np.ndarray, row: int) -> pa.RecordBatch:
    """``ids`` as rows; the last is padded."""
    kind = pa.from_numpy_dtype(ids.dtype)
    full = -(-len(ids) // row) * row
    mask = np.arange(full) < len(ids)
    ids = np.concatenate((ids, np.zeros(full - len(ids), ids.dtype)))
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), row),
                                       pa.FixedSizeListArray.from_arrays(pa.array(mask), row)], schema=_rows_schema(row, kind))


def _writer(folder: str, path: str, row: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, (store, top) = TaskContext.get(), encoder(path), _open(folder)
        part, name = task.partitionId(), f"part-{task.partitionId():05d}"
        mine = f"{top}/_attempt-{task.taskAttemptId()}-{name}"
        store.create_dir(top, recursive=True)
        tokens = docs = 0
        small = np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        rest = np.zeros(0, small)
        rows = docs_out = None
        for b in batches:
            if rows is None:
                ids_file, docs_file = store.open_output_stream(mine + ".arrow"), store.open_output_stream(mine + ".docs.arrow")
                rows, docs_out = ipc.new_file(ids_file, _rows_schema(row, pa.from_numpy_dtype(small))), ipc.new_file(docs_file, _DOCS)
            ids, sizes = enc.encode(b.column(1))
            starts = tokens + np.cumsum(sizes) - sizes
            docs_out.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(sizes)], schema=_DOCS))
            tokens, docs, rest = tokens + int(sizes.sum()), docs + len(sizes), np.concatenate((rest, ids.astype(small)))
            whole = len(rest) // (row * BATCH) * row * BATCH
            for at in range(0, whole, row * BATCH):
                rows.write_batch(_fixed(rest[at:at + row * BATCH], row))
            rest = rest[whole:]
        if rows is None:
            return
        if len(rest):
            rows.write_batch(_fixed(rest, row))
        for out, file, end in ((rows, ids_file, ".arrow"), (docs_out, docs_file, ".docs.arrow")):
            out.close()
            file.close()
            store.move(mine + end, f"{top}/{name}{end}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens]), pa.array([docs]), pa.array([f"{folder}/{name}"])],
                                         names=["part", "tokens", "docs", "path"])
    return run


def write_ids(docs: DataFrame, folder: str | None = None, row: int = ROW, path: str | None = None) -> DataFrame:
    """Writes the files; a row for each: part, tokens, docs, path (without its ending)."""
    spark = docs.sparkSession
    batched(spark)
    folder = folder or work_dir(spark, "arrow-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text").select("doc_id", "text")
    return written(rows.mapInArrow(_writer(folder, path or tokenizer_path(), row), _FILES), "arrow-files")


class TokenFile:
    """Random access to one written file."""

    def __init__(self, path: str):
        store, at = _open(path)
        local = isinstance(store, fs.LocalFileSystem)
        opened = lambda p: ipc.open_file(pa.memory_map(p) if local else store.open_input_file(p))
        self.rows, self.docs = opened(at + ".arrow"), opened(at + ".docs.arrow")
        self.row = self.rows.schema.field("ids").type.list_size
        self._at, self._ids = -1, None

    def batch(self, i: int) -> np.ndarray:
        """The ids of record batch i, a view of the file."""
        if i != self._at:
            self._at, self._ids = i, self.rows.get_batch(i).column(0).values.to_numpy()
        return self._ids

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row r."""
        b = self.rows.get_batch(r // BATCH)
        return b.column(0)[r % BATCH].values.to_numpy(), b.column(1)[r % BATCH].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids start .. start + n, one for each record batch that they touch."""
        size = self.row * BATCH
        while n > 0:
            i, at = divmod(start, size)
            take = min(n, size - at)
            yield self.batch(i)[at:at + take]
            start, n = start + take, n - take


def _reader(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for i in range(file.docs.num_record_batches):
                    d = file.docs.get_batch(i)
                    crcs = []
                    for start, n in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True):
                        crc = 0
                        for ids in file.tokens(start, n):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [d.column(0), pa.array(d.column(1).to_numpy() + base[part]), d.column(2), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of each document, from the files."""
    made = files.select("part", "tokens").orderBy("part").collect()  # one row for each file
    base = dict(zip((r.part for r in made), accumulate((r.tokens for r in made), initial=0), strict=False))
    spread = files.select("part", "path").repartition(max(1, len(made)), "part")
    return spread.mapInArrow(_reader(base), "doc_id long, start long, n_tokens long, ids_crc32 long")
