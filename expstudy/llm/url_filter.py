"""URL filter: host/path rules, then a character language-model ratio (DataFrame functions only).

Two smoothed variable-order Markov models over URL characters are counted, one on the URLs
that the rules accept and one on those they reject.  A character's probability mixes the
orders by Witten-Bell weights (an unseen context leaves the shorter one's value), and a URL's
score is the mean of ``ln P_accepted - ln P_rejected`` over its characters.  The cut is
calibrated on rule-labelled URLs held out of the counts (``crc32(url) mod 5 = 0``): the score
bin that separates the two best.  URLs without a rule are allowed from the cut upwards.

The models' alphabet has 41 signs (a-z, one for digits, eleven marks, one for all else, start,
end), so the table of n-grams has at most 41^4 = 2.8 million rows whatever the input; that
bound is what allows its broadcast.

Cases: a null url, or one without ``://``, has an empty host and path; a null url is scored as
an empty text.  Repeated rows are scored alike, each on its own row.  Without rule-labelled
URLs both models are uniform, all scores are 0 and everything is allowed.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from expstudy.llm.common import LOWER, UPPER, lower_ascii, written

#: (host, path, verdict); a rule fits its host and its subdomains where the path starts so.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 4
MARKS = "./:?=&_%#-+"
ALPHABET = 26 + 1 + len(MARKS) + 3
#: Width of a calibration bin, and the largest score it tells apart.
BIN, MOST = 0.05, 10.0


def split_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(u, at, 1)), F.regexp_extract(u, at, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null where none fits."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return text, verdict


def signs(url: Column) -> Column:
    """The model's view of a URL: known signs only, start signs in front, one end sign."""
    u = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "000000000")
    u = F.regexp_replace(u, "[^a-z0" + MARKS.replace("-", r"\-") + "]", "~")
    return F.concat(F.lit("^" * (ORDER - 1)), u, F.lit("$"))


def _probability(grams: DataFrame, n: str) -> DataFrame:
    """Witten-Bell mixture over all orders for the counts in column ``n``; adds ``p_<n>``."""
    out = grams.withColumn("p_" + n, F.lit(1.0 / ALPHABET))
    for k in range(1, ORDER + 1):
        gram = F.substring("gram", ORDER - k + 1, k)
        counts = grams.groupBy(gram.alias("k_gram")).agg(F.sum(n).alias("c"))
        w = Window.partitionBy(F.substring("k_gram", 1, k - 1))
        seen = counts.select("k_gram", "c", F.sum("c").over(w).alias("total"),
                             F.sum((F.col("c") > 0).cast("long")).over(w).alias("kinds"))
        p = F.when(F.col("total") > 0, (F.col("c") + F.col("kinds") * F.col("p_" + n))
                   / (F.col("total") + F.col("kinds"))).otherwise(F.col("p_" + n))
        out = out.join(seen, gram == F.col("k_gram")).withColumn("p_" + n, p).drop("k_gram", "c", "total", "kinds")
    return out


def cut_of(scored: DataFrame) -> float:
    """The lower edge of the score bin that best separates held-out allowed and blocked URLs."""
    near = F.least(F.greatest(F.col("score"), F.lit(-MOST)), F.lit(MOST))
    bins = (scored.where(F.col("held") & F.col("ruled").isNotNull())
            .groupBy(F.floor(near / BIN).alias("bin"))
            .agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("a"),
                 F.sum((F.col("ruled") == "block").cast("long")).alias("b")).collect())  # <= 401 rows
    a, b = sum(r.a for r in bins), sum(r.b for r in bins)
    if not a or not b:
        return 0.0
    best, cut, below_a, below_b = -1.0, 0.0, 0, 0
    for r in sorted(bins, key=lambda r: r.bin):
        if (gain := (a - below_a) * b + below_b * a) > best:
            best, cut = gain, r.bin * BIN
        below_a, below_b = below_a + r.a, below_b + r.b
    return cut


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict and score of every row."""
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), signs(F.col(url)).alias("signs"),
                        (F.crc32(F.coalesce(F.col(url), F.lit("")).cast("binary")) % 5 == 0).alias("held"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", text.alias("rule"), verdict.alias("ruled"))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("signs") - ORDER + 1),
                                 lambda i: F.substring(F.col("signs"), i, F.lit(ORDER)))).alias("gram")
    use = lambda v: F.sum(((F.col("ruled") == v) & ~F.col("held")).cast("long"))
    grams = written(base.select(gram, "ruled", "held").groupBy("gram")
                    .agg(F.coalesce(use("allow"), F.lit(0)).alias("a"), F.coalesce(use("block"), F.lit(0)).alias("b")), "url-grams")
    ratio = _probability(_probability(grams, "a"), "b").select("gram", F.log(F.col("p_a") / F.col("p_b")).alias("ratio"))
    row = ["__row", "page_id", "host", "path", "rule", "ruled", "held"]
    scored = written(base.withColumn("__row", F.monotonically_increasing_id()).select(*row, gram)
                     .join(F.broadcast(ratio), "gram").groupBy(*row).agg(F.avg("ratio").alias("score")), "url-scores")
    by_score = F.when(F.col("score") >= cut_of(scored), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")
