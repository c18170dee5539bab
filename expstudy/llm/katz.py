"""Language-model scoring by Katz backoff with Good-Turing discounts.

The unigram model is over all words of the training texts, the end sign and one unknown word;
the bigram model is over all pairs of them that occur.  Counts r <= K are discounted by Katz's
Good-Turing ratios, and what the seen bigrams of a history leave is spread over its unseen words
in proportion to their unigram probabilities, so every distribution sums to one exactly:

    P(w | h) = d(C(h w)) C(h w) / T(h)                     where C(h w) > 0
             = alpha(h) P(w)                               otherwise
    P(w)     = d(c(w)) c(w) / N, and 1 - sum for the unknown word

T(h) is C(h), or a little more where the discounts leave nothing.  The counts are tables in the
shared folder that grow with the input.  A word is a 63-bit hash with its sign set, or a number from 1
if it is one of the ``FREQUENT`` most frequent words (0 is the end sign); ``order=1`` has (h, n) of
every word, with a check that no two words share a hash.  ``order=2`` has the pairs in buckets of
about ``PAIRS`` tokens: a row is a bucket, its pairs (x, y, n) sorted, as differences by byte
planes, compressed.  A bucket is chosen by the first word, for the ``SPREAD`` most frequent words by
both, so all pairs of any other word are together.  ``histories`` has (h, n, g, lam) with g = log10
T(h) and lam = log10 alpha(h) T(h).  Only what has a bound goes to the tasks: the frequent words with
their counts, g and lam, and at most CLASSES ** 2 of the most frequent pairs.  A text's score is

    sum of -g(h)  +  sum over seen pairs of log10 d n  +  sum over unseen pairs of lam(h) + log10 P(w)

Pairs that were not sent travel to their bucket, packed in the same way with the places of their
texts, and meet the bucket's counts there; a text gets one sum from each bucket.  Words without a
number are joined with ``histories``.  Pairs are combined before they travel, and the hot ones are
among those sent, so no bucket grows with a hot pair, and no word but the most frequent, which are
spread, can fill one.

Cases: a null or empty text is the end sign alone; a null doc_id counts as the empty string in
the split; repeated rows are counted and scored each; without training texts every word is
unknown with probability one and scores 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import batched, slices, work_dir, written

#: Side of the square that bounds the pairs sent to the tasks; numbered words; words whose pairs are spread.
CLASSES, FREQUENT, SPREAD = 1408, 1 << 20, 256
#: Tokens for each bucket of pairs.
PAIRS = 4_000_000
#: Bytes of text that a task works on at once.
PIECE = 1 << 22
#: Counts above K are not discounted (nor above a smaller K that ``discounts`` settles for).
K = 5
#: Steps of the histograms of counts: powers of 1.05.
STEPS = 500
_CHECK = "0123456789abcdef"  # key of a second hash
_CODEC = pa.Codec("zstd", compression_level=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def discounts(count_of: dict[int, int], k: int = K) -> np.ndarray:
    """Katz's ratios d[r] for r = 0 .. K, with the largest K <= k whose ratios all lie in (0, 1).

    A K of one gives no ratio above zero, so where none from two to k does (counts of counts
    that are missing or do not fall), it is absolute discounting by a half for r <= k.
    """
    n = [count_of.get(r, 0) for r in range(k + 2)]
    for most in range(k, 1, -1):
        if all(n[1:most + 2]) and (rest := (most + 1) * n[most + 1] / n[1]) < 1:
            katz = np.array([((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, most + 1)])
            if (katz > 0).all() and (katz < 1).all():
                return np.concatenate(([1.0], katz))
    return np.array([1.0] + [(r - 0.5) / r for r in range(1, k + 1)])


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= len(d) - 1, d[np.minimum(counts, len(d) - 1)], 1.0)


@dataclass
class Model:
    """The path of the tables and the bounded parts of the model."""

    path: str
    hashes: np.ndarray         # of the numbered words, rising
    numbers: np.ndarray        # their numbers
    counts: np.ndarray         # by number; 0 is the end sign
    texts: int                 # training texts, the count of the end sign
    tokens: int                # N
    types: int                 # V
    d: np.ndarray              # unigram discounts
    total: float               # denominator of the unigram probabilities
    unknown: float             # probability of the unknown word
    buckets: int = 1
    pair_d: np.ndarray | None = None  # bigram discounts
    pair_keys: np.ndarray | None = None  # the most frequent pairs of numbered words, sorted
    pair_logs: np.ndarray | None = None  # log10 of their discounted counts
    g: np.ndarray | None = None    # log10 T(h) by number
    lam: np.ndarray | None = None  # log10 alpha(h) T(h) by number

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, kept(counts, self.d) / self.total, self.unknown)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and each text's end in that list."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    ends = split.offsets.to_numpy().astype(np.int64)[1:] - split.offsets[0].as_py()
    if (empty := pc.index(words, "").as_py()) >= 0:  # before the first and after the last white space
        real = places != empty
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        places = places[real]
    return words, places, ends


def _hashes(words: pa.Array, key: str | None = None) -> np.ndarray:
    """A negative 64-bit integer for each word."""
    words = words.to_numpy(zero_copy_only=False).astype(object)
    h = pd.util.hash_array(words, categorize=False, **({"hash_key": key} if key else {})) if len(words) else np.zeros(0, np.uint64)
    return (h | np.uint64(1 << 63)).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, check and n of the words of a task, combined as far as memory allows."""
    held, size = [], 0

    def made():
        h, check, n = (np.concatenate(x) for x in zip(*held, strict=True))
        h, first, where = np.unique(h, return_index=True, return_inverse=True)
        if (check[first][where] != check).any():
            raise ArithmeticError("two words share a hash")
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(check[first]), pa.array(np.bincount(where, n).astype(np.int64))],
                                          names=["h", "c", "n"])

    for (texts,) in (part for b in batches for part in slices(b)):
        words, places, _ = _tokens(texts)
        n = np.bincount(places, minlength=len(words))
        held.append((_hashes(words)[n > 0], (_hashes(words, _CHECK) & 0xFFFF)[n > 0], n[n > 0]))
        size += len(held[-1][0])
        if size > 2_000_000:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _coded(texts: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct words with the end sign at the end, each token's place among them with the
    end sign after each text, the place of the one before, and where each text begins."""
    words, places, ends = _tokens(texts)
    h = _hashes(words)
    at = np.minimum(np.searchsorted(m.hashes, h), max(0, len(m.hashes) - 1))
    codes = np.where(m.hashes[at] == h, m.numbers[at], h) if len(m.hashes) else h
    own, begins = np.insert(places, ends, len(words)), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
    before = np.concatenate(([len(words)], own[:-1]))  # a text begins after an end sign
    return np.append(codes, 0), own, before, begins


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    spread = (x >= 0) & (x < SPREAD)
    return (_mixed(np.where(spread, x.view(np.uint64) ^ _mixed(y.view(np.uint64)), x.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _pack(x: np.ndarray, *more: np.ndarray) -> bytes:
    """Columns of 64-bit integers, the first one rising, as one compressed block."""
    columns = [np.diff(x, prepend=0), *more]
    return _CODEC.compress(b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), asbytes=True)


def _unpack(data: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(data, 8 * size * columns), np.uint8).reshape(columns, 8, size)
    out = [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw]
    return [np.cumsum(out[0]), *out[1:]]


def _blocks(buckets: int, x: np.ndarray, y: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, size, packed x, y and the rest, sorted) for each bucket with pairs."""
    b = _bucket(x, y, buckets)
    order = np.lexsort((*more[::-1][:1], y, x, b)) if len(more) > 1 else np.lexsort((y, x, b))
    b, columns = b[order], [c[order] for c in (x, y, *more)]
    edges = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        yield int(b[i]), j - i, _pack(*[c[i:j] for c in columns])


def _count_pairs(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = parts.value
        for (texts,) in (part for b in batches for part in slices(b, PIECE)):
            codes, own, before, _ = _coded(texts, m)
            seen, n = np.unique(before * len(codes) + own, return_counts=True)
            before, own = np.divmod(seen, len(codes))
            columns = list(zip(*_blocks(m.buckets, codes[before], codes[own], n), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                                             names=["bucket", "size", "pairs"])
    return run


def _merged(key, table):  # without hints: Spark reads the kind of function from them
    """The pairs of a bucket with their counts; how many have each count up to K + 1, and each step of counts."""
    parts = [_unpack(d.as_py(), s.as_py(), 3) for s, d in zip(table.column("size"), table.column("pairs"), strict=True)]
    x, y, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    first = np.flatnonzero(np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0)))
    x, y, n = x[first], y[first], np.add.reduceat(n, first)
    sent = (x >= 0) & (y >= 0)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(x)], pa.int64()),
                     "pairs": pa.array([_pack(x, y, n)], pa.binary()), "small": pa.array([np.bincount(np.minimum(n, 64), minlength=65).tolist()]),
                     "steps": pa.array([np.bincount(_step(n[sent]), minlength=STEPS).tolist()])})


_ORDER2 = "bucket int, size long, pairs binary, small array<long>, steps array<long>"


def _step(n: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS - 1, np.floor(np.log(n) / np.log(1.05))).astype(np.int64)


def _least_step(sizes: np.ndarray, most: int) -> int:
    """The lowest step from which on there are at most ``most``."""
    return STEPS - int(np.searchsorted(np.cumsum(sizes[::-1]), most, side="right"))


def _summed(df: DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r.pos] = r.n
    return out


def train(docs: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT, k: int = K) -> Model:
    """A model of the texts of ``docs``; its count tables go to the shared folder."""
    spark = docs.sparkSession
    batched(spark, 8192)
    path = work_dir(spark, "katz")
    texts = docs.select("text")
    words = texts.mapInArrow(_count_words, "h long, c long, n long").groupBy("h").agg(
        F.sum("n").alias("n"), (F.min("c") != F.max("c")).alias("shared"))
    words.write.option("compression", "zstd").parquet(f"{path}/order=1")
    table = spark.read.schema("h long, n long, shared boolean").parquet(f"{path}/order=1")
    small = [F.sum((F.col("n") == r).cast("long")).alias(f"n{r}") for r in range(1, k + 2)]
    stats = table.agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.max("shared").alias("shared"), *small).first()
    if stats.shared:
        raise ArithmeticError("two words share a hash")
    n_texts = docs.count()
    tokens, types = (stats.tokens or 0) + n_texts, stats.types + (n_texts > 0)
    count_of = {r: (stats[f"n{r}"] or 0) + (n_texts == r) for r in range(1, k + 2)}
    d = discounts(count_of, k)
    left = sum((1 - d[r]) * r * count_of[r] for r in range(1, len(d)))
    total = float(tokens) if left >= 0.5 else tokens - left + 0.5
    step = F.least(F.lit(STEPS - 1), F.floor(F.log("n") / F.lit(np.log(1.05)))).cast("int")
    sizes = np.zeros(STEPS, np.int64)
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect():
        sizes[r.step] = r.n
    top = table.where(step >= _least_step(sizes, frequent)).select("h", "n").toArrow()  # at most ``frequent`` rows
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    numbers = np.empty(len(h), np.int64)
    numbers[order] = np.arange(1, len(h) + 1)
    by_hash = np.argsort(h)
    m = Model(path, h[by_hash], numbers[by_hash], np.append(n_texts, n[order]), n_texts, tokens, types, d, total, 1 - (tokens - left) / total,
              buckets=8 + tokens // PAIRS)
    if n_texts:
        _train_pairs(texts, m, classes ** 2, k)
    return m


def _kept(n: Column, d: np.ndarray) -> Column:
    """``kept`` of a column."""
    out = n.cast("double")
    for r in range(1, len(d)):
        out = F.when(n == r, F.lit(float(r * d[r]))).otherwise(out)
    return out


def _unigram(n: Column, m: Model) -> Column:
    return F.when(n > 0, _kept(n, m.d) / F.lit(m.total)).otherwise(F.lit(m.unknown))


def _top_pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, y, n = _unpack(data.as_py(), size, 3)
                own = (x >= 0) & (y >= 0) & (_step(n) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (x, y, n)], names=["x", "y", "n"])
    return run


def _history_parts(parts, whole: bool):
    """By bucket, for each first word h: n, own (discounted) and p (of the numbered words after it); or, if
    not ``whole``, the pairs (h, w) whose w has no number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = parts.value
        p = m.unigram(m.counts)
        for b in batches:
            for size, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, y, n = _unpack(data.as_py(), size, 3)
                if whole:
                    first = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
                    add = lambda v: np.add.reduceat(v, first)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[first]), pa.array(add(n)), pa.array(add(kept(n, m.pair_d))), pa.array(add(np.where(y >= 0, p[np.maximum(y, 0)], 0.0)))],
                        names=["h", "n", "own", "p"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x[y < 0]), pa.array(y[y < 0])], names=["h", "w"])
    return run


_HISTORY = "h long, n long, g double, lam double"


def _train_pairs(texts: DataFrame, m: Model, most: int, k: int) -> None:
    """Writes order=2 and histories, and puts the bounded parts of them into ``m``."""
    spark = texts.sparkSession
    parts = spark.sparkContext.broadcast(m)
    (texts.mapInArrow(_count_pairs(parts), "bucket int, size long, pairs binary").groupBy("bucket").applyInArrow(_merged, _ORDER2)
     .write.parquet(f"{m.path}/order=2"))
    pairs = spark.read.schema(_ORDER2).parquet(f"{m.path}/order=2")
    small = _summed(pairs, "small", 65)
    m.pair_d = discounts({r: int(small[r]) for r in range(1, k + 2)}, k)
    least = _least_step(_summed(pairs, "steps", STEPS), most)
    top = pairs.select("size", "pairs").mapInArrow(_top_pairs(least), "x long, y long, n long").toArrow()  # at most ``most`` rows
    keys = top.column("x").to_numpy() * len(m.counts) + top.column("y").to_numpy()
    order = np.argsort(keys)
    m.pair_keys, m.pair_logs = keys[order], np.log10(kept(top.column("n").to_numpy()[order], m.pair_d)).astype(np.float64)
    parts = spark.sparkContext.broadcast(m)
    table = spark.read.schema("h long, n long").parquet(f"{m.path}/order=1").select(F.col("h").alias("w"), _unigram(F.col("n"), m).alias("p"))
    blocks = pairs.select("size", "pairs")
    own = blocks.mapInArrow(_history_parts(parts, True), "h long, n long, own double, p double")
    rare = blocks.mapInArrow(_history_parts(parts, False), "h long, w long").join(table, "w").select(
        "h", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("own"), "p")
    sums = own.unionAll(rare).groupBy("h").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("p").alias("p"))
    full = F.when(F.col("n") - F.col("own") >= 0.5, F.col("n")).otherwise(F.col("own") + 0.5)
    free = F.greatest(1 - F.col("p"), F.lit(m.unknown))
    (sums.select("h", "n", F.log10(full).alias("g"), (F.log10(full - F.col("own")) - F.log10(free)).alias("lam"))
     .write.option("compression", "zstd").parquet(f"{m.path}/histories"))
    some = spark.read.schema(_HISTORY).parquet(f"{m.path}/histories").where("h >= 0").toArrow()
    m.g, m.lam = np.zeros(len(m.counts)), np.zeros(len(m.counts))
    at = some.column("h").to_numpy()
    m.g[at], m.lam[at] = some.column("g").to_numpy(), some.column("lam").to_numpy()


_SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
           "bucket int, size long, pairs binary, w long, times long")
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(schema: str, n: int, **columns) -> pa.RecordBatch:
    fields = [pa.field(*((x, _TYPES[t]))) for x, t in map(str.split, schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields],
                                      schema=pa.schema(fields))


def _score(parts):
    """A row for each text with what the bounded parts give, blocks of its other pairs (x, y, place, times),
    and (w, times) for each of its words without a number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = parts.value, TaskContext.get().partitionId() << 40
        base = np.log10((m.counts + 1) / (m.tokens + m.types + 1))
        for doc_ids, held, texts in (part for b in batches for part in slices(b, PIECE)):
            codes, own, before, begins = _coded(texts, m)
            n, size, places = len(codes), np.diff(begins), np.arange(len(texts), dtype=np.int64)
            add = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: B023, E731
            numbered, number = codes >= 0, np.maximum(codes, 0)
            by_word = lambda values: np.where(numbered, values[number], 0.0)  # noqa: B023, E731
            at, times = np.unique((np.repeat(places, size) * n + before) * n + own, return_counts=True)
            at, own_u = np.divmod(at, n)
            at, before_u = np.divmod(at, n)
            x, y = codes[before_u], codes[own_u]
            key = np.where((x >= 0) & (y >= 0), x * len(m.counts) + y, -1)
            place = np.minimum(np.searchsorted(m.pair_keys, key), max(0, len(m.pair_keys) - 1))
            hit = (m.pair_keys[place] == key) if len(m.pair_keys) else np.zeros(len(key), bool)
            score = np.bincount(at[hit], times[hit] * m.pair_logs[place[hit]], len(texts)) - add(by_word(m.g)[before])
            known = numbered & (m.counts[number] > 0)
            yield _rows(_SCORED, len(texts), row=row + places, doc_id=doc_ids, held_out=held, n_tokens=size,
                        n_known=add(known[own].astype(np.int64)), base=add(by_word(base)[own]), score=score)
            if not hit.all():
                blocks = list(zip(*_blocks(m.buckets, x[~hit], y[~hit], at[~hit], times[~hit]), strict=True))
                yield _rows(_SCORED, len(blocks[0]), row=np.full(len(blocks[0]), row), bucket=blocks[0], size=blocks[1], pairs=blocks[2])
            rare = ~numbered[own]
            at, times = np.unique(np.repeat(places, size)[rare] * n + own[rare], return_counts=True)
            yield _rows(_SCORED, len(at), row=row + at // n, w=codes[at % n], times=times)
            row += len(texts)
    return run


_MET = "row long, score double, w long, lam long, p long"


def _meet(parts):
    def run(key, texts, counted):
        """The pairs of a bucket's texts against its counts: a sum for each text, and what needs the words without a number."""
        m = parts.value
        empty = [np.zeros(0, np.int64)] * 3
        cx, cy, cn = _unpack(counted.column("pairs")[0].as_py(), counted.column("size")[0].as_py(), 3) if counted.num_rows else empty
        log_p = np.log10(m.unigram(m.counts))
        ux, uy = np.unique(cx), np.unique(cy)
        keys = np.searchsorted(ux, cx) * np.int64(len(uy)) + np.searchsorted(uy, cy)  # rising
        made = []
        for row, size, data in zip(texts.column("row").to_pylist(), texts.column("size").to_pylist(), texts.column("pairs"), strict=True):
            x, y, place, times = _unpack(data.as_py(), size, 4)
            n = np.zeros(size, np.int64)
            if len(keys):
                i, j = np.minimum(np.searchsorted(ux, x), len(ux) - 1), np.minimum(np.searchsorted(uy, y), len(uy) - 1)
                own = i * np.int64(len(uy)) + j
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                n = np.where((ux[i] == x) & (uy[j] == y) & (keys[at] == own), cn[at], 0)
            new = n == 0
            value = np.log10(kept(np.maximum(n, 1), m.pair_d))
            value[new] = np.where(x[new] >= 0, m.lam[np.maximum(x[new], 0)], 0.0) + np.where(y[new] >= 0, log_p[np.maximum(y[new], 0)], 0.0)
            rows, where = np.unique(place, return_inverse=True)
            made.append(_rows(_MET, len(rows), row=row + rows, score=np.bincount(where, value * times)))
            for words, column in ((x, "lam"), (y, "p")):
                rare = new & (words < 0)
                made.append(_rows(_MET, int(rare.sum()), row=row + place[rare], w=words[rare], **{column: times[rare]}))
        return pa.Table.from_batches(made, schema=_rows(_MET, 0).schema)

    def untyped(key, texts, counted):  # without hints: Spark reads the kind of function from them
        return run(key, texts, counted)
    return untyped


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    batched(spark, 8192)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    n = F.lit(m.tokens).cast("long").alias("train_tokens")
    if not m.texts:
        size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return rows.select("doc_id", "held_out", size.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), n,
                           F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    parts = spark.sparkContext.broadcast(m)
    path = f"{m.path}/scored-{work_dir(spark, 'x')[-32:]}"
    rows.mapInArrow(_score(parts), _SCORED).write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(_SCORED).parquet(path)
    blocks = made.where("bucket IS NOT NULL").select("bucket", "row", "size", "pairs")
    counted = spark.read.schema(_ORDER2).parquet(f"{m.path}/order=2").select("bucket", "size", "pairs")
    met = written(blocks.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_meet(parts), _MET), "katz-met")
    zero, table = F.lit(0).cast("long"), spark.read.schema(_HISTORY).parquet(f"{m.path}/histories")
    words = made.where("w IS NOT NULL").select("row", "w", "times", zero.alias("lams"), zero.alias("ps")).unionAll(
        met.where("w IS NOT NULL").select("row", "w", zero, F.coalesce("lam", zero), F.coalesce("p", zero)))
    words = words.join(table.withColumnRenamed("h", "w"), "w", "left")
    c = F.coalesce("n", zero)
    more = words.select(
        "row", (F.col("lams") * F.coalesce("lam", F.lit(0.0)) + F.col("ps") * F.log10(_unigram(c, m)) - F.col("times") * F.coalesce("g", F.lit(0.0))).alias("score"),
        (F.col("times") * F.log10((c + 1) / F.lit(float(m.tokens + m.types + 1)))).alias("base"), (F.col("times") * (c > 0).cast("long")).alias("known"))
    more = more.unionAll(met.where("w IS NULL").select("row", "score", F.lit(0.0), zero))
    more = more.groupBy("row").agg(F.sum("score").alias("r_score"), F.sum("base").alias("r_base"), F.sum("known").alias("r_known"))
    return (made.where("n_tokens IS NOT NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("r_known", zero)).alias("n_known"), n,
                    (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("r_score", F.lit(0.0))).alias("score")))
