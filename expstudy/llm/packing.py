"""Packing by concatenate-and-cut with two-pass prefix sums.

Pass 1 encodes each partition's documents in the order they come and writes the ids with
their partition and their start inside it.  The partition totals (one number for each task)
become global offsets by a prefix sum.  Pass 2 shifts every document to its global place and
cuts the one long run of ids into windows of ``SEQUENCE`` tokens; a document across a border
gives a piece on either side (a boundary record).  Texts and ids are never shuffled, and only
the last window of all is padded.

Cases: a null or empty text is the end id alone; repeated rows and equal or null doc_ids are
documents of their own; a document longer than a window is cut into as many pieces as it
spans, and one whose ids take 2 GB raises an error (a text takes less); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import batched, slices, written
from expstudy.llm.tokens import encoder, tokenizer_path

SEQUENCE = 2048
_IDS = "doc_id long, part int, start long, ids binary"
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for doc_ids, texts in (part for b in batches for part in slices(b)):
            ids, sizes = enc.encode(texts)
            ends = np.cumsum(sizes)
            offsets = np.concatenate(([0], ends)) * 4
            if offsets[-1] >= 1 << 31:
                raise OverflowError("the ids of one text take 2 GB or more")
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes),
                 pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids.tobytes())])],
                names=["doc_id", "part", "start", "ids"])
            start += int(sizes.sum())
    return run


def _cut(base: dict[int, int], sequence: int):
    """Pieces of documents of which partition ``p`` starts at the global offset ``base[p]``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, part, start, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n, done = base[part] + start, len(ids) // 4, 0
                while done < n:
                    seq, offset = divmod(at + done, sequence)
                    size = min(sequence - offset, n - done)
                    out.append((doc, done, size, zlib.crc32(ids[4 * done:4 * (done + size)]), n, seq, offset))
                    done += size
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=[x.split()[0] for x in _PIECES.split(", ")])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Pass 1: doc_id, part, start (in the partition) and ids, written once."""
    batched(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(path), _IDS), "ids")


def bases(encoded: DataFrame) -> dict[int, int]:
    """The global offset of each partition: one number for each task of pass 1."""
    totals = encoded.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")).orderBy("part").collect()
    return dict(zip((r.part for r in totals), accumulate((r.n for r in totals), initial=0), strict=False))


def pack(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """A row for each piece, see ``_PIECES``."""
    encoded = encode(docs, path or tokenizer_path())
    return encoded.mapInArrow(_cut(bases(encoded), sequence), _PIECES)


def sequences(docs: DataFrame, sequence: int = SEQUENCE, pad: int = 0, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of ``sequence`` ints), length."""
    encoded = encode(docs, path or tokenizer_path())
    base = bases(encoded)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, part, start, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n, done = base[part] + start, len(ids) // 4, 0
                while done < n:
                    seq, offset = divmod(at + done, sequence)
                    size = min(sequence - offset, n - done)
                    rows.append((seq, offset, ids[4 * done:4 * (done + size)]))
                    done += size
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                             names=["sequence_id", "offset", "ids"])

    def joined(key, table):  # without hints: Spark reads the kind of function from them
        t = table.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4").astype(np.int64)
        full = np.concatenate((ids, np.full(sequence - len(ids), pad)))
        return pa.table({"sequence_id": [key[0].as_py()], "ids": pa.array([full.tolist()], pa.list_(pa.int64())), "length": pa.array([len(ids)], pa.int64())})

    pieces = encoded.mapInArrow(windows, "sequence_id long, offset long, ids binary")
    return pieces.groupBy("sequence_id").applyInArrow(joined, "sequence_id long, ids array<long>, length long")
