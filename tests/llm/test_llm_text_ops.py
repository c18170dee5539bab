"""Operators on document texts against plain-Python versions and on awkward rows."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute
from conftest import SF001, SF01

from expstudy.llm import arrow_ids, common, decontaminate, katz, minhash, packing, quality, registry, sharding, tokens

LONG = "lorem ipsum dolor sit amet " * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, row string, label int, kept string, part int"
AWKWARD = [
    (3, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en", "s", 1, "x", 1, "y", 7),
    (3, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en", "s", 1, "x", 1, "y", 7),
    (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", None, None, None, None, None, None, None),
    (5, None, "en", "s", 1, "x", 1, "y", 7),
    (6, "", "en", None, 1, "x", 1, "y", 7),
    (None, "only one", None, "s", 1, "x", 1, "y", 7),
    (8, " \n\t leading and trailing \n\n", "de", "s", 1, "x", 1, "y", 7),
    (9, LONG, "en", "s", 1, "x", 1, "y", 7),
    (10, "été naïve ßtraße — “quoted” ½ 漢字 <|endoftext|> don't STOP.", "fr", "t", 1, "x", 1, "y", 7),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF01, "documents").select("doc_id", "text").collect()]


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, texts):
    """Every document is in gapless pieces, every sequence is filled without gaps."""
    want = sorted((len(x), zlib.crc32(x.tobytes()), x.tobytes()) for x in encoded(texts))
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert [r.offset for r in rows if r.sequence_id == 0][0] == 0
    at = 0
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, packing.SEQUENCE) and r.offset + r.length <= packing.SEQUENCE
        at += r.length
    docs, i = [], 0
    while i < len(rows):  # the pieces of a document follow each other
        n, crcs, total = 0, [], rows[i].doc_tokens
        while n < total:
            assert (rows[i].start, rows[i].doc_tokens) == (n, total)
            n += rows[i].length
            crcs.append((rows[i].start, rows[i].length, rows[i].ids_crc32))
            i += 1
        docs.append((total, crcs))
    assert sorted(n for n, _ in docs) == [n for n, _, _ in want]
    by_size = {}
    for n, _, b in want:
        by_size.setdefault(n, []).append(b)
    for n, crcs in docs:
        match = [b for b in by_size[n] if all(zlib.crc32(b[4 * s:4 * (s + k)]) == c for s, k, c in crcs)]
        assert match
        by_size[n].remove(match[0])


def test_scoring_matches_counts(spark, documents):
    rows = registry.op1_katz_backoff(spark, SF01).collect()
    want = brute.scoring(documents)
    assert len(rows) == len(documents)
    for r in rows:
        e = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert math.isclose(r.base_score, e[4], rel_tol=1e-9) and r.score <= 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scoring_awkward_rows(spark, awkward, nothing):
    m = katz.train(awkward.where("doc_id <> 10"), classes=8, frequent=4)
    rows = katz.score(awkward, m).collect()
    assert len(rows) == len(AWKWARD) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5].n_tokens == by[6].n_tokens == 1 and by[5].score == by[6].score
    assert by[10].n_known == 1  # the end sign
    assert katz.score(nothing, m).count() == 0
    empty = katz.train(nothing)
    assert {(r.score, r.n_known, r.train_tokens) for r in katz.score(awkward, empty).collect()} == {(0.0, 0, 0)}


@pytest.mark.parametrize("classes, frequent, pairs", [(1, 3, 500), (30, 400, 4_000_000), (1408, 1 << 20, 100)])
def test_scores_are_those_of_a_plain_model(spark, documents, monkeypatch, classes, frequent, pairs):
    """Whatever part of the words and pairs is sent to the tasks, and however many buckets there are."""
    monkeypatch.setattr(katz, "PAIRS", pairs)
    texts = [t for _, t in documents[:60]] + [None, "", "never met words never met"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = brute.Katz(texts[:50])
    m = katz.train(rows.where("doc_id < 50"), classes=classes, frequent=frequent)
    got = katz.score(rows, m).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, plain.score(texts[r.doc_id]), rel_tol=1e-9)
        assert r.n_known == sum(w in plain.c for w in brute.words((texts[r.doc_id] or "").translate(brute.ASCII_LOWER))) + 1


def test_query_scores_are_those_of_a_plain_model(spark, documents):
    plain = brute.Katz([t for d, t in documents if zlib.crc32(str(d).encode()) % 7 != 2])
    for r in registry.op1_katz_backoff(spark, SF01).collect():
        assert math.isclose(r.score, plain.score(dict(documents)[r.doc_id]), rel_tol=1e-9)


def test_plain_model_sums_to_one():
    plain = brute.Katz(["a b a c", "a b b", "", "c c c c a b", "d e a b a"])
    for h in [*plain.pairs, "unmet"]:
        assert math.isclose(sum(plain.prob(h, w) for w in plain.c) + plain.prob(h, "unmet"), 1, rel_tol=1e-12)


def test_unigram_model_sums_to_one(spark, awkward):
    m = katz.train(awkward, classes=8)
    counts = [r.n for r in spark.read.parquet(f"{m.path}/order=1").collect()] + [m.texts]
    assert math.isclose(m.unigram(np.array(counts)).sum() + m.unknown, 1, rel_tol=1e-12)
    assert m.tokens == sum(counts) and m.types == len(counts)


def test_good_turing_discounts_are_katz_ratios():
    n = {1: 100, 2: 40, 3: 22, 4: 14, 5: 10, 6: 7}
    rest = 6 * 7 / 100
    assert math.isclose(katz.discounts(n)[1], (2 * 40 / 100 - rest) / (1 - rest))
    assert katz.discounts({1: 3})[2] == 0.75  # counts of counts are missing: absolute discounting


def test_good_turing_is_in_force_on_the_tables(spark):
    for sf in (SF001, SF01, SF01.replace("sf0.01", "sf0.1")):
        docs = common.table(spark, sf, "documents").where(~katz.held_out(F.col("doc_id"))).select("text").toPandas()["text"]
        tokens = [[*brute.words((t or "").translate(brute.ASCII_LOWER)), ""] for t in docs]
        for counts in (Counter(w for x in tokens for w in x), Counter(p for x in tokens for p in zip(["", *x], x))):  # noqa: B905
            n = Counter(counts.values())
            d = katz.discounts(n)
            most = len(d) - 1
            rest = (most + 1) * n[most + 1] / n[1]
            assert most >= 2 and ((d[1:] > 0) & (d[1:] < 1)).all()
            for r in range(1, most + 1):
                assert math.isclose(d[r], ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest))


def test_shards(spark, documents):
    rows = registry.op2_weighted_hash_tree(spark, SF01).collect()
    text = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    for s in range(40):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 0 < moved < 3 * len(rows) / 41


def test_shard_weights_and_confined_movement(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    root = sharding.plan(40)
    region = root.children[1]
    heavier = replace(region.children[0].children[2], own_weight=4.0)
    rack = replace(region.children[0], children=region.children[0].children[:2] + (heavier,) + region.children[0].children[3:])
    grown = replace(root, children=(root.children[0], replace(region, children=(rack, region.children[1])), *root.children[2:]))
    key = F.col("id").cast("string")
    rows = spark.range(30000).select(sharding.shard_of(key, root).alias("a"), sharding.shard_of(key, grown).alias("b")).collect()
    assert abs(sum(r.a == 12 for r in rows) / 30000 - 1 / 40) < 0.005
    assert abs(sum(r.b == 12 for r in rows) / 30000 - 4 / 43) < 0.008
    for r in rows:  # only rows that enter region 1 move between regions, and nothing leaves it
        if r.a // 10 != r.b // 10:
            assert r.b // 10 == 1
        if r.a // 10 == 1:
            assert r.b // 10 == 1


def test_shards_awkward_rows(awkward, nothing):
    rows = sharding.shard(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.size for r in rows if r.doc_id in (5, 6)} == {16}
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1 and len({r.slot for r in rows if r.doc_id == 3}) == 2
    assert sharding.shard(nothing).count() == 0


def test_packing(spark, documents):
    check_pieces(registry.op3_concat_and_cut(spark, SF01).collect(), [t for _, t in documents])


def test_packing_awkward_rows_and_sequences(awkward, nothing):
    rows = packing.pack(awkward).collect()
    check_pieces(rows, [r[1] for r in AWKWARD])
    assert packing.pack(nothing).count() == 0
    whole = {r.sequence_id: r for r in packing.sequences(awkward).collect()}
    total = sum(r.length for r in rows)
    assert sum(r.length for r in whole.values()) == total and all(len(r.ids) == packing.SEQUENCE for r in whole.values())
    for r in rows:
        ids = np.array(whole[r.sequence_id].ids[r.offset:r.offset + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_words_that_end_in_a_combining_mark_once_normalised():
    import pyarrow as pa

    words = ["AL\u0130.", "\u0924\u0930\u095e,", "\u05d0\ufb1d,", "\ufb1d!?", "Stra\u00dfe;", "\u00e9t\u00e9...", "End."]
    texts = [*words, " ".join(words)]
    ids, sizes = tokens.encoder(tokens.tokenizer_path()).encode(pa.array(texts))
    want = encoded(texts)
    assert sizes.tolist() == [len(x) for x in want] and (ids == np.concatenate(want)).all()


def test_arrow_files(spark, documents):
    rows = {r.doc_id: r for r in registry.op5_arrow_fixed_lists(spark, SF01).collect()}
    docs, start = sorted(documents), 0
    for (d, _), ids in zip(docs, encoded([t for _, t in docs]), strict=True):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_arrow_files_awkward_rows_and_random_access(awkward, nothing):
    files = arrow_ids.write_ids(awkward, row=64)
    rows = arrow_ids.read_ids(files).collect()
    assert len(rows) == len(AWKWARD)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3, 3, 4, 5, 6, 8, 9, 10]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    want = sorted(zlib.crc32(x.tobytes()) for x in encoded([r[1] for r in AWKWARD]))
    assert sorted(r.ids_crc32 for r in rows) == want
    one = files.orderBy("part").first()
    f = arrow_ids.TokenFile(one.path)
    all_ids = np.concatenate(list(f.tokens(0, one.tokens)))
    for r in range(-(-one.tokens // 64)):
        ids, mask = f.sequence(r)
        assert len(ids) == 64 and mask.sum() == min(64, one.tokens - 64 * r)
        assert (ids[mask] == all_ids[64 * r:64 * (r + 1)]).all()
    assert arrow_ids.read_ids(arrow_ids.write_ids(nothing)).count() == 0


def test_near_duplicates(spark, documents):
    docs = sorted(documents)
    want = brute_classes(docs)
    rows = registry.op6_probminhash(spark, SF01).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(want.values()))


def brute_classes(docs):
    """As brute.similar_classes, for many texts: only those that share a shingle are compared."""
    import collections

    sets, where = [], collections.defaultdict(list)
    for i, (_, t) in enumerate(docs):
        w = brute.words((t or "").translate(brute.ASCII_LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for g in sets[-1]:
            where[g].append(i)
    both = collections.Counter((a, b) for places in where.values() for k, b in enumerate(places) for a in places[:k])
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: docs[root(i)][0] for i, (d, _) in enumerate(docs)}


def test_near_duplicates_awkward_rows(awkward, nothing):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.class_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert sum(r.kept for r in rows) == len(AWKWARD) - 2  # texts without words stay
    one = minhash.keep_one(awkward)
    assert one.columns == awkward.columns and one.count() == len(AWKWARD) - 2
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_hub_that_is_not_alike(spark):
    """A bucket's first member is unlike others that are alike: they still meet."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for c in range(60):  # copies of one text, each with an edit of its own, far apart in pairs
        w = list(base)
        for k in range(4):
            w[(c * 3 + k * 50) % 200] = f"x{c}_{k}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute.similar_classes(texts)))


def test_near_duplicates_with_unequal_repeats(spark):
    """Equal shingle sets, a tenth of them many times in one text: the weighted sets are far less alike."""
    texts = []
    for c in range(200):
        cycle, rest = " ".join(f"c{c}_{i}" for i in range(10)), " ".join(f"r{c}_{i}" for i in range(86))
        texts += [f"{cycle} {cycle} {rest}", f"{cycle} " * 500 + rest]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i - i % 2 for i in range(len(texts))}


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    n, weights = 60, {}
    for side in "ab":
        some = rng.random(n) < 0.8
        weights[side] = np.where(some, rng.integers(1, 6, n), 0).astype(float)
    a, b = weights["a"], weights["b"]
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(n) if a[i] and b[i])
    ids = rng.integers(1, 2**63, n).astype(np.uint64)
    sign = {}
    for side, w in weights.items():
        sign[side] = minhash.signatures(np.zeros((w > 0).sum(), np.int64), ids[w > 0], w[w > 0], 1, 4096)[0]
    assert abs((sign["a"] == sign["b"]).mean() - exact) < 0.04


def test_quality_measures(spark, documents):
    rows = {r.doc_id: r for r in registry.op8_adaptive_quantiles(spark, SF01).collect()}
    for d, t in documents:
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_documents(spark):
    rows = registry.op8_adaptive_quantiles(spark, SF01).where("NOT base_failed")
    labels = common.table(spark, SF01, "labels").join(rows, "doc_id")
    good = labels.where("quality = 1").agg({"*": "count"}).first()[0]
    assert labels.where("quality = 1 AND kept").count() >= 0.99 * good
    assert labels.where("quality = 0 AND kept").count() <= 0.3 * labels.where("quality = 0").count()


def test_quality_awkward_rows(awkward, nothing):
    rows = quality.quality_rules(awkward).collect()
    assert len(rows) == len(AWKWARD)
    want = {(r[0], *brute.quality(r[1])) for r in AWKWARD}
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_rules(nothing).count() == 0


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in common.table(spark, SF01, "benchmark").collect()]
    rows = {r.doc_id: r for r in registry.op10_ngram_set(spark, SF01).collect()}
    for e in brute.contamination(documents, items):
        r = rows[e[0]]
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == e


def test_decontamination_awkward_rows(spark, awkward, nothing):
    items = [(1, "Beta gamma, DELTA!"), (2, "beta gamma delta"), (3, None), (4, ""), (None, "theta iota"), (5, "amet lorem"), (6, "½"),
             (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron"), (7, "dolor"),
             (8, "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(awkward, benchmark).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, rows), key=order) == sorted(brute.contamination([r[:2] for r in AWKWARD], items), key=order)
    clean = decontaminate.drop_contaminated(awkward, benchmark)
    assert clean.columns == awkward.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    none = decontaminate.decontaminate(awkward, benchmark.where("false")).collect()
    assert len(none) == len(AWKWARD) and not any(r.n_hit or r.contaminated for r in none)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF001, "documents")
    kept, texts = docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF001)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = common.written(out, name)
            assert 0 < out.count() <= kept.count()
            kept, texts = out, [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
            if name == "near_dedup":
                assert set(brute_classes(sorted(texts)).values()) == {d for d, _ in texts}
            if name == "decontaminate":
                items = [(r.item_id, r.text) for r in common.table(spark, SF001, "benchmark").collect()]
                assert not any(e[-1] for e in brute.contamination(texts, items))
    check_pieces(out.collect(), [t for _, t in texts])
    assert corpus_pipeline.run(spark, SF001).count() == out.count()


def test_template_pages_do_not_meet(spark):
    """Pages that share 85 % of their words are strays of each other's buckets, and no two are compared."""
    import random

    rng = random.Random(7)
    shared = [f"t{i}" for i in range(170)]
    texts = [" ".join([*shared, *(f"w{rng.randrange(10 ** 9)}" for _ in range(30))]) for _ in range(1500)]
    near = texts[5].replace("t100 ", "changed ")  # a real link among them
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, near])], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("node"), "text")
    sizes = 196
    sets = rows.select("node", F.lit(sizes).cast("long").alias("size"), F.col("node").alias("label"), F.lit(True).alias("stray"), "text").mapInArrow(
        minhash._sets, "node long, size long, label long, stray boolean, shingle long")
    front = minhash.prefixes(sets).cache()
    assert [tuple(r) for r in minhash.met_by_prefix(front).collect()] == [(5, 1500)]
    looked_up = front.where("index").join(front.select("shingle", F.col("node").alias("other")), "shingle")
    assert looked_up.where("node <> other").count() < 100  # all of the real link
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert classes == {**{i: i for i in range(1500)}, 1500: 5}


def test_every_letter_before_a_mark():
    """Words are cut before their marks only where the tokenizer cuts them too."""
    import random

    import pyarrow as pa

    e = tokens.Encoder(tokens.tokenizer_path())
    ids = lambda xs: [x.ids for x in e.tokenizer.encode_batch(xs, add_special_tokens=False)]
    cut = [chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000 and tokens._cuts(chr(i))]
    assert len(cut) > 80_000 and not any(map(tokens._cuts, "\u0130\u095e\ufb1d\u0301\u1885"))
    assert [a + ids(["),"])[0] for a in ids(["a" + c for c in cut])] == ids(["a" + c + ")," for c in cut])
    rng, pool = random.Random(5), "ŸŽžŠÆæŒœĲĳǄǅǆŉſẞÀÖ×÷µaZéßİıΣςσ中ひकखफ़ड़ְׁ́̈שיִא०1٣'’\"<|>endoftext한ᄀ각Ⅷ½²ªfiǅあ゙ạ̈"
    words = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) + "".join(rng.choice(tokens.MARKS) for _ in range(rng.randint(0, 3)))
             for _ in range(5000)]
    got, sizes = e.encode(pa.array(words))
    ends = np.cumsum(sizes)
    assert [got[j - n:j - 1].tolist() for j, n in zip(ends, sizes, strict=True)] == ids(words)


def test_scratch_folders_go(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    with common.scratch(spark):
        kept = common.work_dir(spark, "probe")
        minhash.near_duplicates(docs).write.parquet(str(tmp_path / "out"))
        docs.write.parquet(kept)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert not os.path.exists(kept.removeprefix("file:"))
    outside = common.written(docs, "probe")
    assert outside.count() == 2
