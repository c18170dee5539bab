"""Near duplicates by ProbMinHash over weighted word shingles, banding, and verification.

A document's shingles are its runs of five words (A-Z lower-cased; one run of all words in
shorter texts), weighted ``1 + ln(count)``.  ProbMinHash lets every shingle arrive as a Poisson
process of its weight's rate, each arrival at a random register; a register keeps the shingle
that arrives first, and a shingle's process ends early once it is later than every register.
Two registers agree with the probability Jaccard similarity of the weighted sets.  BANDS bands
of ROWS registers give the buckets, and a pair is linked if the Jaccard similarity of the
shingle sets, counted exactly from the whole texts, is at least 0.8.  Where one copy repeats a
passage the weighted sets can be far less alike than the sets, so a text with repeated shingles
gets the bands of equal weights, the same arrivals at rate 1, besides; without repeats the two
are the same.  So at a set similarity of 0.8 a pair shares no bucket with a probability of 7e-6,
whatever its repeats.

Equal texts are one node from the start.  Buckets never emit all pairs.  First every member is
compared with the bucket's hub, the member with most company in all its buckets (of near copies
of one text it is the text itself, or the copy nearest to it), and components are formed.
Members that then are in another component than their hub are strays.  For strays an exact
prefix filter takes over: among the members of the strays' buckets, of two sets with similarity of
at least 0.8 the larger has among the fifth of its shingles that are rarest there one that is among
the rarest ninth of the smaller, so strays are compared with the members of other components that
they meet in this way.  Pages of one template that are not similar have more than a ninth of their
shingles for themselves, so what the template repeats is never looked up.  So every two members
of a bucket either end in one component, have been compared, or cannot be similar; no bucket is
cut.  Components come from alternating large-star and small-star steps.  Degrees, hubs, counts
and least labels are aggregates with map-side partials, and the joins are shuffle joins that AQE
splits at hot buckets and hubs; nothing is collected.

Cases: a null text, or one without words, is a class of its own, whatever its repeats; equal
texts share a class even under equal or null doc_ids; the class id is the least doc_id of the
class (null only if all are null); an empty table gives an empty result; other columns are
ignored by ``near_duplicates`` and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expstudy.llm.common import batched, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 5
#: Most row numbers that are broadcast to pick texts out (16 bytes each); beyond, a shuffle join.
MOST_KEYS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), one for each distinct shingle of each text, sorted."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    places = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if len(words):
        real = (words != "")[places]  # white space at an end of a text
        places, text = places[real], text[real]
    h, n = hashed[places], len(text)
    size = np.bincount(text, minlength=len(texts))
    end = np.cumsum(size)
    left = end[text] - np.arange(n)  # words from here to the text's end
    run = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, n)):
        has = (left > j)[:n - j]
        run[:n - j] += np.where(has, _mix(h[j:] + _ODD[j]) * _ODD[j], np.uint64(0))
    begins = (left >= SHINGLE) | (np.arange(n) == (end - size)[text]) & (size[text] < SHINGLE)
    text, run = text[begins], _mix(run[begins])
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (text[1:] != text[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    return text[first], run[first], np.diff(np.append(first, len(run)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each text and register the shingle that arrives there first."""
    best = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, np.uint64)
    rate, at, turn = 1.0 / weight, np.zeros(len(shingle)), 0
    while len(shingle):
        turn += 1
        draw = _mix(shingle + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) * rate
        register = text * m + (_mix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, register, at)
        first = at == best[register]
        winner[register[first]] = shingle[first]
        live = at < best.reshape(texts, m).max(axis=1)[text]
        text, shingle, rate, at = text[live], shingle[live], rate[live], at[live]
    return winner.reshape(texts, m)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """For each text the BANDS bucket keys of its signature."""
    sign = sign.reshape(len(sign), BANDS, ROWS)
    keys = np.zeros(sign.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * _ODD[0] + sign[:, :, r])
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc (a struct with a field ``text``) and same; adds row, size and bands."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        text, shingle, count = shingles(b.column(0).field("text"))
        size = np.bincount(text, minlength=n)
        keys = band_keys(signatures(text, shingle, 1 + np.log(count), n))
        repeats = np.bincount(text[count > 1], minlength=n) > 0
        own, place = repeats[text], np.cumsum(repeats) - 1
        plain = keys.copy()
        if repeats.any():
            plain[repeats] = band_keys(signatures(place[text[own]], shingle[own], np.ones(own.sum()), int(repeats.sum())))
        both = np.concatenate((keys, plain), axis=1)
        new = np.concatenate((np.ones(keys.shape, bool), plain != keys), axis=1)
        ends = np.concatenate(([0], np.cumsum(new.sum(axis=1)))).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(both[new].view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(row + np.arange(n)), pa.array(size), bands],
                                         names=["doc", "same", "row", "size", "bands"])
        row += n


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        (ta, sa, _), (tb, sb, _) = shingles(b.column(2)), shingles(b.column(3))
        text, run = np.concatenate((ta, tb)), np.concatenate((sa, sb))
        order = np.lexsort((run, text))
        text, run = text[order], run[order]
        both = np.bincount(text[1:][(text[1:] == text[:-1]) & (run[1:] == run[:-1])], minlength=b.num_rows)
        every = np.bincount(text, minlength=b.num_rows) - both
        yield b.select([0, 1]).filter(pa.array(both >= SIMILAR * every))


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets are similar enough; ``rows`` has row and doc.text."""
    batched(pairs.sparkSession, 512)
    pairs = written(pairs, "pairs")
    keys = written(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct(), "pair-rows")
    few = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
    texts = written(rows.select("row", F.col("doc")["text"].alias("text")).join(few, "row", "left_semi"), "pair-texts")
    side = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias("text_" + c))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b), a <> b: the least node of each component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small")
        if edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():  # only stars are left
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def classes(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows: doc - a struct of ``columns`` -, same, row, size, bands), (node of each text: same, node, label)."""
    spark = docs.sparkSession
    batched(spark, 1024)
    base = docs.select(F.struct(*[F.col(c) for c in columns]).alias("doc"), F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    made = T.StructType([*base.schema.fields, T.StructField("row", T.LongType()), T.StructField("size", T.LongType()),
                         T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = written(base.mapInArrow(_sign, made), "signed")
    nodes = written(rows.where("size > 0").groupBy("same").agg(F.min("row").alias("node")), "nodes")
    own = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    bands = own.select(F.col("row").alias("node"), "size", F.explode("bands").alias("key"))
    shared = written(bands.join(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(shared.join(company, "node"), "members")
    most = F.struct("company", (-F.col("node")).alias("less"), "size")  # most company, then the least row
    hubs = members.groupBy("key").agg(F.max(most).alias("hub")).select(
        "key", (-F.col("hub")["less"]).alias("hub"), F.col("hub")["size"].alias("hub_size"))
    met = written(members.join(hubs, "key").groupBy("node", "size", "hub", "hub_size").agg(F.max("n").alias("n")), "met")
    pairs = met.where((F.col("node") != F.col("hub")) & (F.col("size") * SIMILAR <= F.col("hub_size") + 1e-9)
                      & (F.col("hub_size") * SIMILAR <= F.col("size") + 1e-9)).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = written(linked(pairs, rows), "links")
    labels = written(components(links), "labels")
    new = written(stray_links(met.where("n > 2"), labels, rows), "stray-links")
    if not new.isEmpty():  # joined to the stars of the components so far
        stars = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = written(components(stars.unionAll(new)), "labels")
    return rows, nodes.join(labels, "node", "left").select("same", "node", F.coalesce("label", "node").alias("label"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct shingle of each text."""
    for b in batches:
        if b.num_rows:
            text, run, _ = shingles(b.column(4))
            place = pa.array(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(place) for i in range(4)), pa.array(run.view(np.int64))],
                                             names=["node", "size", "label", "stray", "shingle"])


def prefixes(sets: DataFrame) -> DataFrame:
    """The rarest shingles of each set with their places: those that a set is looked up by among sets
    that are no larger, and of them (``index``) those that larger sets find it by."""
    rare = sets.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    text = Window.partitionBy("node")  # the shingles of one text; those of no other set come first
    place = F.col("size") - F.count("*").over(text) + F.row_number().over(text.orderBy("n", "shingle"))
    last = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    return (sets.join(rare, "shingle").withColumn("place", place).where(F.col("place") <= last(SIMILAR))
            .select("node", "size", "label", "stray", "shingle", "place", (F.col("place") <= last(2 * SIMILAR / (1 + SIMILAR))).alias("index")))


def met_by_prefix(front: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components, one of them stray, that can be similar.

    With the shingles of every set in one order, rarest first, the first shingle that two sets
    share is at places i and j with at most 1 + min(n - i, m - j) shared in all; similarity s asks
    for s / (1 + s) * (n + m) shared.
    """
    x, y = F.col("x.size"), F.col("y.size")
    asked = SIMILAR / (1 + SIMILAR) * (x + y) - 1e-9
    most = 1 + F.least(x - F.col("x.place"), y - F.col("y.place"))
    on = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & (y <= x) & (y >= SIMILAR * x - 1e-9)
          & (most >= asked))
    found, index = front.where("stray"), front.where("index")
    pairs = found.alias("x").join(index.alias("y"), on).select("x.node", F.col("y.node").alias("other")).unionAll(
        front.where("NOT stray").alias("x").join(index.where("stray").alias("y"), on).select("x.node", F.col("y.node").alias("other")))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def stray_links(met: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between members of one hub's buckets that are in different components."""
    home = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    at = (met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
          .join(home, "hub", "left").withColumn("stray", F.col("label") != F.coalesce("hub_label", "hub")))
    at = written(at.select("node", "size", "label", "hub", "stray"), "at")
    unsettled = at.where("stray").select("hub").distinct()
    among = written(at.join(unsettled, "hub", "left_semi").groupBy("node", "size", "label").agg(F.max("stray").alias("stray")), "among")
    few = F.broadcast(among) if among.count() <= MOST_KEYS else among
    texts = rows.select(F.col("row").alias("node"), F.col("doc")["text"].alias("text")).join(few, "node")
    sets = written(texts.select("node", "size", "label", "stray", "text").mapInArrow(
        _sets, "node long, size long, label long, stray boolean, shingle long"), "sets")
    return linked(met_by_prefix(written(prefixes(sets), "front")), rows)


def _classed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc, class_id and whether the row is the one of its class to keep."""
    rows, nodes = classes(docs, columns)
    doc_id = F.col("doc")["doc_id"]
    own = rows.where("size > 0").groupBy("same").agg(F.min(F.struct(doc_id.alias("id"), F.col("row"))).alias("first"))
    nodes = nodes.join(own, "same")
    first = nodes.groupBy("label").agg(F.min("first").alias("first"))
    nodes = written(nodes.select("same", "label").join(first, "label").select("same", "first"), "first")
    alone = F.col("size") == 0
    return (rows.select("doc", "row", "size", "same").join(nodes, "same", "left")
            .select("doc", F.when(alone, doc_id).otherwise(F.col("first.id")).alias("class_id"),
                    (alone | (F.col("first.row") == F.col("row"))).alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and kept (one row of each class)."""
    return _classed(docs, ["doc_id", "text"]).select(F.col("doc")["doc_id"].alias("doc_id"), "class_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their class, all columns as they came."""
    return _classed(docs, docs.columns).where("kept").select("doc.*")
