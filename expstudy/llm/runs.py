"""Periodic runs in word sequences by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least ``max(LEAST, TIMES * q)`` words
that no neighbouring word extends.  Each of its words occurs at least TIMES times in it.  So a
word that occurs less often in a segment is in none of the segment's runs and splits it; the
parts are split again by their own counts until nothing changes, and parts of fewer than LEAST
words go.  All texts of an Arrow batch are split together: one sort of (segment, word) a round,
over what is left.

In the surviving segments a lag is tried only where a run can have it.  For 2**k <= q < 2**(k+1)
a run holds a multiple of 2**k whose block of 2**(k+1) words comes again q words later, and q is
the smallest such lag at that place: a smaller one would, with q, give the run a smaller period
(Fine and Wilf).  So every k compares one row of hashes, and gives at most one lag for every
2**k words.  Then the segment is scanned at that lag, word by word: its stretches of equal words
that are long enough are the runs, if no divisor of q is a period too.  Hashes only choose lags.

Cases: a null or empty text has no words and no run; a null doc_id counts as the empty string in
the hash of the change; repeated rows and equal doc_ids are documents of their own; one text may
be as long as a row can be, and texts are worked on in pieces of a batch, so memory is bounded by
the longest text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import slices

#: Fewest words of a run, and of periods that it holds.
LEAST, TIMES = 6, 4
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def split_rare(codes: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, segments from 0) of the words that survive; ``segment`` never falls."""
    place = np.arange(len(codes))
    while len(place):
        width = int(codes.max()) + 1
        _, where, n = np.unique(segment * width + codes[place], return_inverse=True, return_counts=True)
        often = n[where] >= TIMES
        left, own = place[often], segment[often]
        begins = np.ones(len(left), bool)
        begins[1:] = (np.diff(left) != 1) | (np.diff(own) != 0)
        part = np.cumsum(begins) - 1
        long = np.bincount(part, minlength=1)[part] >= LEAST
        left, part = left[long], part[long]
        new = np.ones(len(left), bool)
        new[1:] = np.diff(part) != 0
        if len(left) == len(place):  # stable
            return left, np.cumsum(new) - 1
        place, segment = left, np.cumsum(new) - 1
    return place, np.zeros(0, np.int64)


def lags(row: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) that a run of at most ``longest`` words in ``row`` can have."""
    block, size, places, found = _mix(row.astype(np.uint64) + _MIX[2]), 1, [], []
    while size * TIMES <= longest:  # size = 2 ** k; block: hashes of the next ``size`` words
        block = _mix(block[:-size] * _MIX[2] + _mix(block[size:]))
        rows = np.zeros(-(-len(block) // size) * size, np.uint64)
        rows[:len(block)] = block
        rows = rows.reshape(-1, size)
        same = rows[1:] == rows[:-1, :1]
        hit = np.flatnonzero(same.any(axis=1))
        places.append(hit * size)
        found.append(size + same[hit].argmax(axis=1))
        size *= 2
    return np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def _smallest(words: np.ndarray, q: int) -> bool:
    """Whether no divisor of q is a period of ``words``, which have period q at least twice."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = q // f
            if np.array_equal(words[:q], words[d:q + d]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def find_runs(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (place, length, period) of all runs, sorted; ``text`` is each word's text, never falling."""
    place, segment = split_rare(codes, text)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    sizes = np.bincount(segment)
    ends = np.cumsum(sizes + 1) - 1  # a word of its own after each segment
    row = np.empty(len(place) + len(sizes), np.int64)
    row[np.arange(len(place)) + segment] = codes[place]
    row[ends] = codes.max() + 1 + np.arange(len(sizes))
    at, lag = lags(row, int(sizes.max()))
    tried = np.unique(np.stack((np.searchsorted(ends, at), lag), axis=1), axis=0)
    first = place[np.cumsum(sizes) - sizes]
    out = []
    for s, q in tried.tolist():
        begin, end = int(ends[s] - sizes[s]), int(ends[s])
        if (need := max(LEAST, TIMES * q)) > end - begin:
            continue
        same = np.zeros(end - begin - q + 2, np.int8)
        same[1:-1] = row[begin:end - q] == row[begin + q:end]
        turn = np.diff(same)
        starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a + q >= need and _smallest(row[begin + a:begin + b + q], q):
                out.append((first[s] + a, b - a + q, q))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and each text's end in that list."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    ends = split.offsets.to_numpy().astype(np.int64)[1:] - split.offsets[0].as_py()
    if (empty := pc.index(words, "").as_py()) >= 0:  # before the first and after the last white space
        real = places != empty
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        places = places[real]
    return words, places, ends


def repeat_tails(codes: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The change that the query asks for: a tenth of the documents become periodic from a word on."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(codes)
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((codes[:a], codes[a + np.arange(n - a) % p]))


_RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def _found(b: pa.RecordBatch, change) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """By piece of a batch: doc_ids, runs (start in the text, length, period), the text of each run, collapsed texts."""
    for doc_ids, texts in slices(b):
        words, codes, ends = _tokens(texts)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        if change:
            for i, d in enumerate(doc_ids.to_pylist()):
                codes[begins[i]:ends[i]] = change(codes[begins[i]:ends[i]], d)
        runs = find_runs(codes, np.repeat(np.arange(len(ends)), ends - begins))
        step = np.zeros(len(codes) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(step[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], left[ends])).astype(np.int32)), words.take(pa.array(codes[kept])))
        text = np.searchsorted(ends, runs[:, 0], side="right")
        runs[:, 0] -= begins[text]
        yield doc_ids, runs, text, pc.binary_join(lists, " ")


def _listed(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, runs, text, collapsed in _found(b, change):
                ends = np.searchsorted(text, np.arange(len(doc_ids) + 1)).astype(np.int32)
                made = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends), made), collapsed],
                                                 names=["doc_id", "runs", "collapsed"])
    return run


def _digested(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for doc_ids, runs, text, collapsed in _found(b, change):
                ends = np.searchsorted(text, np.arange(len(doc_ids) + 1))
                rows = []
                for i, (d, t) in enumerate(zip(doc_ids.to_pylist(), collapsed.cast(pa.binary()), strict=True)):
                    own = runs[ends[i]:ends[i + 1]].tolist()
                    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
                    milli = None if best[0] is None else 1000 * best[1] // best[2]
                    rows.append((d, len(own), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()), sha(t.as_py())))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns)],
                                                 names=[x.split()[0] for x in _DIGEST.split(", ")])
    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the text without the words
    after each run's first period, joined by one space.  ``change`` may alter a text's word codes."""
    return _rows(docs).mapInArrow(_listed(change), _RUNS)


def run_digest(docs: DataFrame, change=None) -> DataFrame:
    """A row for each document: the number of runs, the longest, and digests of ``periodic_runs``."""
    return _rows(docs).mapInArrow(_digested(change), _DIGEST)
