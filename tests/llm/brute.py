"""Plain-Python versions of what the training-data queries must return."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re
import zlib

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def scoring(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    tokens = {d: [*words((t or "").translate(ASCII_LOWER)), ""] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for d, ws in tokens.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] in the order of ``docs``"""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j:j + k])].add(i)
    sizes, out = {len(x) for x in windows}, []
    for d, t in docs:
        w, covered, found = bench_words(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if hit := windows.get(tuple(w[j:j + k])):
                    covered.update(range(j, j + k))
                    found |= hit
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(covered), len(found), sha(",".join(names)), bool(covered) and 20 * len(covered) >= len(w)))
    return out


def similar_classes(texts, least=0.8):
    """The least index of each text's class: components of shingle-set Jaccard >= ``least``."""
    sets = []
    for t in texts:
        w = words((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def article(page):
    """The text of a generated page's one <article> element."""
    if not page or "<article>" not in page:
        return ""
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    if inner.rfind("<") > inner.rfind(">"):
        inner = inner[:inner.rfind("<")]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h1)|br)>", " ", inner))).split())


def good_turing(counts, k=5):
    """{r: discounted r} for r up to the largest K <= k whose ratios all lie in (0, 1), else r - 1/2 up to k."""
    n = collections.Counter(counts)
    for most in range(k, 1, -1):
        if all(n[r] for r in range(1, most + 2)):
            rest = (most + 1) * n[most + 1] / n[1]
            ratio = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, most + 1)} if rest != 1 else {1: 2}
            if rest < 1 and all(0 < x < 1 for x in ratio.values()):
                return {r: r * x for r, x in ratio.items()}
    return {r: r - 0.5 for r in range(1, k + 1)}


class Katz:
    """Katz backoff over dictionaries of words and pairs; the end sign is the empty word."""

    def __init__(self, texts):
        tokens = [[*words((t or "").translate(ASCII_LOWER)), ""] for t in texts]
        self.c = collections.Counter(w for x in tokens for w in x)
        self.pairs = collections.defaultdict(collections.Counter)
        for x in tokens:
            for h, w in zip(["", *x], x):  # noqa: B905
                self.pairs[h][w] += 1
        one = good_turing(self.c.values())
        two = good_turing([n for p in self.pairs.values() for n in p.values()])
        size = sum(self.c.values())
        own = {w: one.get(n, n) for w, n in self.c.items()}
        left = size - math.fsum(own.values())
        total = size if left >= 0.5 else size - left + 0.5
        self.p = {w: x / total for w, x in own.items()}
        self.unknown = 1 - math.fsum(own.values()) / total
        self.seen, self.alpha = {}, {}
        for h, p in self.pairs.items():
            kept = {w: two.get(n, n) for w, n in p.items()}
            all_of, kept_of = sum(p.values()), math.fsum(kept.values())
            full = all_of if all_of - kept_of >= 0.5 else kept_of + 0.5
            self.seen[h] = {w: x / full for w, x in kept.items()}
            self.alpha[h] = (1 - kept_of / full) / max(self.unknown, 1 - math.fsum(self.p[w] for w in p))

    def prob(self, h, w):
        if w in self.seen.get(h, ()):
            return self.seen[h][w]
        return self.alpha.get(h, 1.0) * self.p.get(w, self.unknown)

    def score(self, text):
        x = [*words((text or "").translate(ASCII_LOWER)), ""]
        return math.fsum(math.log10(self.prob(h, w)) for h, w in zip(["", *x], x))  # noqa: B905
