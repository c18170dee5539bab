"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document's measures are taken once, over the whole text, and written as narrow rows.
Then every (lang, source) gets a mergeable quantile sketch of each rule's measure: counts of
logarithmic bins with ``GAMMA`` relative width (partial counts add up in any order, so a hot
source is combined on the map side; a sketch has at most a few hundred bins).  The sketch gives
the quartiles, and a rule's threshold is a fence outside them, ``q3 * (q3 / q1) ** REACH``: as a
group's usual spread, on the logarithmic scale, so it adapts to the language and source instead
of a fixed cut.  Groups of fewer than ``LEAST`` documents use their language's sketch, and
languages of fewer the sketch of everything.  A document is kept if it passes the base rules
and lies inside all fences of its group.

Cases: null text has no words and fails the base rules; a null language or source is a group
of its own; repeated rows get the same verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from expstudy.llm.common import SPACES, let, words, written

WINDOW = 5
#: Bins of the sketch: [GAMMA ** i, GAMMA ** (i + 1)); fences reach REACH inter-quartile ranges out.
GAMMA, REACH, LEAST = 1.02, 3.0, 100
#: Least inter-quartile range in bins (20 % of the value): groups of almost equal values keep some room.
MIN_SPREAD = 10
#: Most groups whose fences are broadcast (under 200 bytes each); beyond, a join that AQE splits.
MOST_GROUPS = 100_000
#: Rules of the method: (name, measure over the base columns, is there a lower fence, is there an upper one).
RULES = (
    ("word_length", "(word_chars + 0.0) / n_words", True, True),
    ("symbols", "(n_symbols + 1.0) / (n_words + 20)", False, True),
    ("dup_lines", "(n_dup_lines + 1.0) / (n_lines + 5)", False, True),
    ("repeats", "(n_repeat_words + 1.0) / (n_words + 20)", False, True),
)


def repeat_words(w: Column) -> Column:
    """Words inside any window of five words that occurs twice or more in the text."""
    windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                                                      lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))

    def covered(s: Column) -> Column:  # s: (hash, place), sorted: equal windows are neighbours
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(k - 1, k) | same(k + 1, k))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    return F.coalesce(let(windows, lambda h: F.when(h.isNotNull(), count(h))), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the measures of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                        let(lines, lambda x: F.array(F.size(x), F.size(F.array_distinct(x)))).alias("lines"),
                        repeat_words(w).cast("long").alias("n_repeat_words"))

    return let(words(text), of)


def measured(docs: DataFrame, carry: list[Column]) -> DataFrame:
    m = docs.select(*carry, measures(F.col("text")).alias("m"))
    names = [n for c in carry for n in docs.select(c).columns]
    return m.select(*names, "m.n_words", "m.word_chars", "m.n_symbols",
                    (F.col("m.lines")[0] - F.col("m.lines")[1]).cast("long").alias("n_dup_lines"), "m.n_repeat_words",
                    F.col("m.lines")[0].cast("long").alias("n_lines"))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def fences(rows: DataFrame) -> DataFrame:
    """One row for each group: lang, source and, by rule, ``<rule>_low`` and ``<rule>_high``."""
    sound = rows.where(~F.expr(BASE_FAILED))
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.floor(F.ln(F.expr(e)) / F.ln(F.lit(GAMMA))).cast("int").alias("bin"))
                                 for n, e, _, _ in RULES])).alias("v")
    cells = sound.select("lang", "source", values).groupBy("lang", "source", "v.rule", "v.bin").agg(F.count("*").alias("n"))
    lang = cells.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    every = lang.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    levels = (cells.select(F.lit(0).alias("level"), "lang", "source", "rule", "bin", "n")
              .unionAll(lang.select(F.lit(1), "lang", none, "rule", "bin", "n"))
              .unionAll(every.select(F.lit(2), none, none, "rule", "bin", "n")))
    group = ["level", "lang", "source", "rule"]
    w = Window.partitionBy(*group)
    run = levels.withColumn("run", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    bin_at = lambda q: F.min(F.when(F.col("run") >= F.col("total") * q, F.col("bin")))
    q = run.groupBy(*group).agg(F.max("total").alias("total"), bin_at(0.25).alias("q1"), bin_at(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_SPREAD))
    q = q.select(*group, "total", (F.col("q1") - spread * REACH).alias("low"), (F.col("q3") + spread * REACH).alias("high"))
    cols = [F.max(F.when(F.col("rule") == n, F.col(side))).alias(f"{n}_{side}") for n, *_ in RULES for side in ("low", "high")]
    return q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *cols)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with ``base_failed`` and ``kept``; needs lang and source."""
    f = fences(rows)
    ends = [f"{n}_{side}" for n, *_ in RULES for side in ("low", "high")]
    own = f.where("level = 0").select("lang", "source", F.col("total").alias("t0"), *[F.col(c).alias("a_" + c) for c in ends])
    lang = f.where("level = 1").select(F.col("lang").alias("l1"), F.col("total").alias("t1"), *[F.col(c).alias("b_" + c) for c in ends])
    every = f.where("level = 2").select(F.lit(True).alias("l2"), *[F.col(c).alias("c_" + c) for c in ends])
    names = rows.select("lang", "source").distinct()
    pick = lambda c: F.when(F.col("t0") >= LEAST, F.col("a_" + c)).when(F.col("t1") >= LEAST, F.col("b_" + c)).otherwise(F.col("c_" + c))
    limits = (names.alias("g").join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
              .select("g.lang", "g.source", "t0", *["a_" + c for c in ends])
              .join(lang, F.col("lang").eqNullSafe(F.col("l1")), "left").withColumn("one", F.lit(True))
              .join(every, F.col("one") == F.col("l2"), "left")
              .select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[pick(c).alias(c) for c in ends]))
    limits = written(limits, "limits")
    limits = F.broadcast(limits) if limits.count() <= MOST_GROUPS else limits
    inside = F.lit(True)
    for n, e, low, high in RULES:
        value = F.floor(F.ln(F.expr(e)) / F.ln(F.lit(GAMMA)))
        if low:
            inside = inside & (value >= F.coalesce(F.col(n + "_low"), value))
        if high:
            inside = inside & (value <= F.coalesce(F.col(n + "_high"), value))
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = F.expr(BASE_FAILED)
    return rows.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(F.coalesce(inside, F.lit(True)))).drop("__lang", "__source", *ends)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept, a row for each document."""
    rows = written(measured(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]), "quality")
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they came."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__doc")
    rows = written(measured(docs, [whole, F.col("lang"), F.col("source")]), "quality-docs")
    return judged(rows).where("kept").select("__doc.*")
