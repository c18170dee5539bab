"""Benchmark decontamination by a broadcast set of test n-grams (DataFrame functions only).

Windows are 13 consecutive words of a benchmark item; a shorter item is one window.  Training
texts are scanned in two steps that lose nothing:

1. Anchors.  Any 13 consecutive words contain a run of ``ANCHOR`` = 7 words that starts at a
   multiple of 7.  So only those runs of a document are hashed, and looked up in the broadcast
   hash set of all 7-word runs of the items.  Items of k < 13 words use runs of
   ``(k + 1) // 2`` words at multiples of the same number, by the same argument.
2. Verification.  Documents with an anchor hit get all their windows compared with the items'
   windows, as whole strings, and the words covered by matches are counted.

The set is broadcast only while the benchmark has at most ``MOST_RUNS`` runs (it is counted
first); beyond that the same joins run as shuffle joins, which AQE splits where a key is hot.

Cases: null or empty texts and items have no words and hit nothing; repeated rows and items
with equal texts are all reported; a null item_id takes part in hits but not in the digest; an
empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expstudy.llm.common import lower_ascii, written

WINDOW = 13
#: Largest benchmark, in runs of words, whose hash set is broadcast (about 100 bytes each).
MOST_RUNS = 2_000_000


def norm_words(text: Column) -> Column:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    t = lower_ascii(F.coalesce(text, F.lit("")))
    return F.filter(F.split(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def run_length(k: int) -> int:
    """Length, and step in documents, of the anchor runs for windows of k words."""
    return (k + 1) // 2


def _runs(w: Column, length: int, step: int, last: Column) -> Column:
    """Hashes of the runs of ``length`` words that start at 0, step, 2 step, ... up to ``last``."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)),
                                         lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)])))


def _windows(w: Column, k: int) -> Column:
    """(start, words joined by spaces) of every window of k words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(
        i.alias("start"), F.lit(k).alias("k"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("gram"))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, k, start, gram of every window of every item; and the item's words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), norm_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(WINDOW))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice(F.col("w"), i + 1, k), " "))
    return items.select("item_id", "w", k.alias("k"), F.explode(grams).alias("gram"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` rows (columns ``__row`` and ``__text``) with a match: __row, n_hit, n_items, items."""
    spark = docs.sparkSession
    split = norm_words(F.col("__text")).alias("w")
    windows = written(item_windows(benchmark).select("item_id", "k", "gram").distinct(), "windows")
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # at most 13 numbers
    found = None
    for k in lengths:
        g = run_length(k)
        runs = (windows.where(F.col("k") == k).select("gram").distinct().select(F.split("gram", " ").alias("w"))
                .select(F.explode(_runs(F.col("w"), g, 1, F.size("w") - g)).alias("run")).distinct())
        small = runs.limit(MOST_RUNS + 1).count() <= MOST_RUNS
        seen = docs.select("__row", split).select("__row", F.explode(_runs(F.col("w"), g, g, F.size("w") - g)).alias("run"))
        seen = seen.join(F.broadcast(runs) if small else runs, "run", "left_semi").select("__row", F.lit(k).alias("k"))
        found = seen if found is None else found.unionAll(seen)
    if found is None:
        return spark.createDataFrame([], "__row long, n_hit long, items array<string>, n_items long")
    few = written(found.distinct(), "anchors")
    grams = None
    for k in lengths:
        own = docs.join(few.where(F.col("k") == k).select("__row"), "__row", "left_semi").select("__row", split)
        own = own.select("__row", F.explode(_windows(F.col("w"), k)).alias("x")).select("__row", "x.*")
        grams = own if grams is None else grams.unionAll(own)
    small = windows.limit(MOST_RUNS + 1).count() <= MOST_RUNS
    matched = written(grams.join(F.broadcast(windows) if small else windows, ["k", "gram"]).select("__row", "start", "k", "item_id"), "hits")
    spans = matched.groupBy("__row", "start").agg(F.max("k").alias("k"))
    spans = spans.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "k"))).alias("spans"))
    # the spans are sorted by start, so the words they cover add up while the furthest end is kept
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["start"] + x["k"] - F.greatest(s["end"], x["start"]))).alias("n"),
        F.greatest(s["end"], x["start"] + x["k"]).alias("end"))
    covered = spans.select("__row", F.aggregate("spans", first, step)["n"].cast("long").alias("n_hit"))
    items = matched.groupBy("__row").agg(F.collect_set("item_id").alias("items"), F.count_distinct(
        F.coalesce("item_id", F.lit("\x00null"))).alias("n_items"))
    return covered.join(items, "__row")


def flagged(docs: DataFrame, benchmark: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` columns with n_words, n_hit, n_items, items and contaminated for every document."""
    rows = written(docs.select(*carry, F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__row"),
                               F.size(norm_words(F.col("text"))).cast("long").alias("__n_words")), "decon-docs")
    names = [c for c in rows.columns if c not in ("__text", "__row", "__n_words")]
    found = hits(rows.select("__row", "__text"), benchmark)
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.select(*names, "__row", F.col("__n_words").alias("n_words"))
            .join(found, "__row", "left")
            .select(*names, "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ","), 256).alias("items_sha256"),
                    ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return flagged(docs, benchmark, [F.col("doc_id")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns as they came."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__doc")
    return flagged(docs, benchmark, [whole]).where(~F.col("contaminated")).select("__doc.*")
