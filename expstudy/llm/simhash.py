"""SimHash near duplicates by a self-join of the binary trie of fingerprints.

A fingerprint has a bit where over half of the text's shingle hashes have it (runs of four words,
A-Z lower-cased, repeats included; XXH64 with seed 42).  Fingerprints within ``BUDGET`` differing
bits are linked, and a document's component is what links reach.

The distinct fingerprints are the leaves of a binary trie.  It is traversed in node pairs: a pair
carries the number of bits in which its two prefixes differ, goes on to its children, 0-0 and 1-1
with the same number and 0-1 and 1-0 with one more, and ends where the number passes the budget or
a side is empty.  The upper part of the traversal is a table.  Nodes hold at most ``MOST``
fingerprints (a node that holds more, wherever fingerprints are dense, is split further), and the
surviving pairs of nodes are joined with the nodes' fingerprints, so that each pair is a row that
any task can work on.  The lower part runs inside the row, over arrays of node pairs, depth first
in pieces of ``FRONT`` pairs, so memory is bounded; pairs of few leaves are compared bit by bit.
A row gives a spanning forest of its links instead of all of them: at most one edge for each of
its fingerprints, however many lie close together, and a pair of nodes whose leaves are all in one
component by then is not followed.  Components of the edges come from alternating large-star and
small-star steps.

Equal fingerprints are one leaf.  A fingerprint that holds over 1/``HOT`` of all rows (at most
``HOT`` of them) gets its component by a broadcast join, the others by a join that AQE can split;
nothing grows with a group of copies but its rows.

Cases: a null text, and one without words, has fingerprint zero and is linked like any other; a
null doc_id is in the component of its fingerprint, whose component_id is the least doc_id that is
not null (null if there is none); repeated rows and equal doc_ids are rows of their own; texts
of any length are hashed in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import slices, written
from expstudy.llm.minhash import components

SHINGLE, SEED, BITS, BUDGET = 4, 42, 64, 4
#: Most fingerprints of a trie node that is worked on in one row, and node pairs in a piece there.
MOST, FRONT = 1 << 15, 1 << 16
#: Pairs of nodes with at most so many pairs of leaves are compared leaf by leaf.
FEW = 1 << 15
#: A key of more than 1 / HOT of all rows is hot.
HOT = 1000
#: Shingles hashed at once; for each byte, its bits as bytes of a 64-bit integer.
PIECE = 1 << 18
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _shingles(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space between words, and each shingle's text, first and last byte there."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    joined = pc.binary_join(split, " ")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(joined) + 1].astype(np.int64)
    data = joined.buffers()[2].to_pybytes() if joined.buffers()[2] is not None else b""
    n_words = np.where(np.diff(offsets) > 0, np.diff(split.offsets.to_numpy()), 0)
    text = np.repeat(np.arange(len(texts)), n_words)
    begin = np.ones(len(data) + 1, bool)
    begin[1:] = np.frombuffer(data, np.uint8) == 32
    begin[offsets] = True
    first = np.flatnonzero(begin[:-1] & (np.frombuffer(data, np.uint8) != 32)) if data else np.zeros(0, np.int64)
    last = np.append(first[1:] - 1, len(data))
    last[np.append(np.diff(text) != 0, False)] += 1  # no space between texts
    size = n_words[text]
    left = np.cumsum(n_words)[text] - np.arange(len(text))
    whole = (left >= SHINGLE) | (left == size) & (size < SHINGLE)
    at = np.flatnonzero(whole)
    return data, text[at], first[at], last[at + np.minimum(size[at], SHINGLE) - 1]


def simhashes(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    data, text, first, last = _shingles(texts)
    ones, h = np.zeros((len(texts), BITS), np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(text), PIECE):
        own, part = text[at:at + PIECE], slice(at, at + PIECE)
        hashes = np.array([h(data[a:b], SEED) for a, b in zip(first[part].tolist(), last[part].tolist(), strict=True)], "<u8")
        new = np.flatnonzero(np.append(True, np.diff(own) != 0))
        place = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
        sums = np.flatnonzero(place % 255 == 0)  # a byte holds the sum of 255 bits
        lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], sums, axis=0)
        np.add.at(ones, own[sums], lanes.view(np.uint8).reshape(len(sums), BITS))
    more = 2 * ones > np.bincount(text, minlength=len(texts))[:, None]
    return np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_ids, texts in slices(b):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(simhashes(texts).view(np.int64))], names=["doc_id", "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed 64-bit integer, of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, f long")


class Forest:
    """Components of the numbers below n, each named by its least number."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.turn = self.label  # equal over a range of numbers of one component

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up, nxt := up[up]):
                up = nxt
            self.label = up[self.label]
            self.turn = np.cumsum(np.append(0, np.diff(self.label) != 0))


def _compared(leaves: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of close leaves, i in [a0, a1), j in [b0, b1), i < j, of each of the node pairs."""
    found_i, found_j = [a0[:0]], [a0[:0]]
    for s, e, t, f in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):
        close = np.bitwise_count(np.bitwise_xor.outer(leaves[s:e], leaves[t:f])) <= budget
        if close.any():
            i, j = np.nonzero(close)
            found_i.append(i + s)
            found_j.append(j + t)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return i[i < j], j[i < j]


def near(a: np.ndarray, b: np.ndarray | None = None, budget: int = BUDGET) -> Forest:
    """Links of at most ``budget`` differing bits between two sorted arrays (of one with itself):
    numbers are places in ``a``, then in ``b``."""
    one, n = b is None, len(a)
    leaves = a if one else np.concatenate((a, b))
    forest = Forest(len(leaves))
    bits = {}

    def ones(d: int) -> np.ndarray:
        """Running number of leaves with bit d."""
        if d not in bits:
            bits[d] = np.append(0, np.cumsum((leaves >> np.uint64(BITS - 1 - d)) & np.uint64(1))).astype(np.int64)
        return bits[d]

    start = [(0, n, 0, n)] if one else [(0, n, n, len(leaves))]
    stack = [(0, np.array(start, np.int64).T, np.zeros(1, np.int8))]  # depth, (begin, end) twice, differing bits
    while stack:
        d, pair, differ = stack.pop()
        settled = ((forest.turn[pair[0]] == forest.turn[pair[1] - 1]) & (forest.turn[pair[2]] == forest.turn[pair[3] - 1])
                   & (forest.label[pair[0]] == forest.label[pair[2]]))
        pair, differ = pair[:, ~settled], differ[~settled]
        few = (pair[1] - pair[0]) * (pair[3] - pair[2]) <= FEW
        if few.any() or d == BITS:
            forest.unite(*_compared(leaves, *pair[:, few], budget))
            pair, differ = pair[:, ~few], differ[~few]
        if not len(differ):
            continue
        run = ones(d)
        cut_a, cut_b = pair[1] - run[pair[1]] + run[pair[0]], pair[3] - run[pair[3]] + run[pair[2]]
        same = pair[0] == pair[2]
        sides = [(pair[0], cut_a, pair[2], cut_b, 0), (cut_a, pair[1], cut_b, pair[3], 0),
                 (pair[0], cut_a, cut_b, pair[3], 1), (cut_a, pair[1], pair[2], cut_b, 1)]
        made, bit = [], []
        for at, (a0, a1, b0, b1, more) in enumerate(sides):
            go = (a1 > a0) & (b1 > b0) & (differ + more <= budget)
            if at == 3:
                go &= ~same
            made.append(np.stack((a0[go], a1[go], b0[go], b1[go])))
            bit.append(differ[go] + np.int8(more))
        pair, differ = np.concatenate(made, axis=1), np.concatenate(bit)
        for at in reversed(range(0, len(differ), FRONT)):  # those with fewer differing bits come first
            stack.append((d + 1, pair[:, at:at + FRONT], differ[at:at + FRONT]))
    return forest


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """same, x and y (the fingerprints of two nodes); gives edges."""
    for b in batches:
        for same, x, y in zip(*b.columns, strict=True):
            parts = [np.sort(v.values.to_numpy().view(np.uint64)) for v in ((x,) if same.as_py() else (x, y))]
            leaves, label = np.concatenate(parts).view(np.int64), near(*parts).label
            own = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(leaves[label[own]]), pa.array(leaves[own])], names=["a", "b"])


def _mask(depth: int) -> int:
    """The first ``depth`` bits, as a signed 64-bit integer."""
    m = ((1 << depth) - 1) << (BITS - depth)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _trie(leaves: DataFrame, most: int) -> tuple[int, list[DataFrame], DataFrame]:
    """The depth of the highest nodes; by depth from there, the nodes (p: prefix, full: has more than
    ``most`` leaves); and depth, p, fs (the leaves) of all that are not full."""
    total = leaves.count()
    top = depth = max(0, int(np.ceil(np.log2(max(1, total) / most))))
    levels, held, rest = [], None, leaves
    while True:
        at = rest.select("f", F.col("f").bitwiseAND(F.lit(_mask(depth))).alias("p"))
        nodes = written(at.groupBy("p").agg((F.count("*") > most).alias("full")), "trie")
        levels.append(nodes)
        own = at.join(nodes.where("NOT full").select("p"), "p").groupBy("p").agg(F.collect_list("f").alias("fs"))
        own = own.select(F.lit(depth).alias("depth"), "p", "fs")
        held = own if held is None else held.unionAll(own)
        full = nodes.where("full").select("p")
        if full.isEmpty():
            return top, levels, written(held, "trie-leaves")
        rest = written(at.join(full, "p", "left_semi").select("f"), "trie-rest")
        depth += 1


def _differing(a: str, b: str) -> F.Column:
    """Bits in which two prefixes differ as far as both go."""
    depth = F.least(F.col(a + "_depth"), F.col(b + "_depth"))
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(BITS) - depth)  # depth 0: both prefixes are zero
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(mask))


def _node_pairs(top: int, levels: list[DataFrame], budget: int) -> DataFrame:
    """a, a_depth, b, b_depth of the pairs of nodes that are not full and differ in few enough bits; a = b or a < b."""
    flips = [0]
    for _ in range(budget):
        flips = sorted({m ^ (1 << (BITS - 1 - d)) for m in flips for d in range(top)} | set(flips))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in flips]
    nodes = levels[0].select("p")
    pairs = (nodes.select(F.col("p").alias("a"), F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("m"))
             .select("a", F.col("a").bitwiseXOR(F.col("m")).alias("b")).where("a <= b").join(nodes.select(F.col("p").alias("b")), "b"))
    pairs = pairs.select("a", F.lit(top).alias("a_depth"), "b", F.lit(top).alias("b_depth"))
    for depth, (above, level) in enumerate(zip(levels, levels[1:], strict=False), top):
        kids = (level.select("p", F.col("p").bitwiseAND(F.lit(_mask(depth))).alias("parent"))
                .join(above.where("full").select(F.col("p").alias("parent")), "parent"))
        pairs = pairs.withColumn("same", F.col("a") == F.col("b"))
        for side in ("a", "b"):
            k = kids.select(F.col("parent").alias(side), F.lit(depth).alias(side + "_depth"), F.col("p").alias("kid"))
            pairs = (pairs.join(k, [side, side + "_depth"], "left")
                     .withColumn(side + "_depth", F.when(F.col("kid").isNotNull(), depth + 1).otherwise(F.col(side + "_depth")))
                     .withColumn(side, F.coalesce("kid", side)).drop("kid"))
        pairs = written(pairs.where((~F.col("same") | (F.col("a") <= F.col("b"))) & (_differing("a", "b") <= budget))
                        .select("a", "a_depth", "b", "b_depth"), "node-pairs")
    return pairs


def links(leaves: DataFrame, most: int = MOST, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints f of ``leaves``: components of the edges are those of all links."""
    top, levels, held = _trie(leaves, most)
    pairs = written(_node_pairs(top, levels, budget), "node-pairs")
    side = lambda s, fs: held.select(F.col("depth").alias(s + "_depth"), F.col("p").alias(s), F.col("fs").alias(fs))
    rows = pairs.join(side("a", "x"), ["a", "a_depth"]).join(side("b", "y"), ["b", "b_depth"])
    rows = rows.select((F.col("a") == F.col("b")).alias("same"), "x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y"))
    tasks = max(1, min(pairs.count(), 8 * leaves.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks).mapInArrow(_edges, "a long, b long")


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` with the columns of ``right`` (unique keys, ``n``: rows of ``left`` with that key); hot keys are not shuffled."""
    hot = right.where(F.col("n") * HOT > total).drop("n").withColumn("__hot", F.lit(True))
    met = left.join(F.broadcast(hot), key, "left")  # at most HOT rows
    names = [c for c in met.columns if c != "__hot"]
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") * HOT <= total).drop("n"), key)
    return met.where("__hot").select(*names).unionAll(rest.select(*names))


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of each document."""
    rows = written(fingerprints(docs), "fingerprints")
    leaves = written(rows.groupBy("f").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "leaves")
    labels = components(written(links(leaves.select("f"), most), "links"))
    own = written(leaves.join(labels.select(F.col("node").alias("f"), "label"), "f", "left")
                  .select("f", "n", "least", F.coalesce("label", "f").alias("label")), "labels")
    first = written(own.groupBy("label").agg(F.count("*").alias("n"), F.min("least").alias("component_id")), "first")
    ids = spread_join(own.select("f", "label", F.col("n").alias("rows")), first, "label", own.count())
    ids = written(ids.select("f", F.col("rows").alias("n"), "component_id"), "component-ids")
    return spread_join(rows, ids, "f", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("f"), BITS // 4, "0")).alias("fingerprint"), "component_id")
