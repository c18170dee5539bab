"""Operators on pages, urls and conversations, and the registered SQL."""

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from conftest import SF01
from oracle import compare, duck

from expstudy.llm import chat, common, html_text, registry, url_filter


@pytest.mark.parametrize("key", ["op4_url_language_model", "op7_chat_machine"])
def test_matches_sql(spark, key):
    """The two whose results no plain-Python test covers whole; the others' SQL is checked with brute force alike."""
    ok, message = compare(registry.queries()[key](spark, SF01), duck(SF01), registry.oracles()[key])
    assert ok, message


def test_sql_names_registered_queries():
    assert set(registry.oracles()) <= set(registry.queries())


def test_pages(spark):
    pages = {r.page_id: r for r in common.table(spark, SF01, "pages").collect()}
    rows = registry.op9_html_ratio(spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute.article(pages[r.page_id].html), len(r.text))


PARTS = {
    "menu": '<div class="main-menu"><a href="/a">Home page of this site</a> <a href="/b">All the news there is</a></div>',
    "header": "<header><h1>The Daily Site, your site for every kind of news</h1></header>",
    "notice": '<div id="cookieNotice">We use cookies to make this site work, and many more words about them and you.</div>',
    "advert": '<section class="ad-box"><p>Buy this thing today, for it is the best thing that anyone could ever buy.</p></section>',
    "sidebar": "<aside><p>Other stories that you may want to read, with quite a few words of their own.</p></aside>",
    "form": "<form>Your name <input name=n> and your address <button>Send it off now</button></form>",
    "comments": '<div class="comments"><article class="comment"><p>I liked this article a lot, says a reader in many words.</p></article></div>',
    "footer": "<footer><p>All rights are reserved by someone or other, in many words.</p></footer>",
}
TEXT = ["A title & more", "The first paragraph has many words, so that it counts as content for sure.", "Short.",
        "Another paragraph of the article which again has more than a few words in it.", "Last one, x < y."]


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", '<div class="content has-sidebar">{}</div>', "<div><div id=post>{}</div></div>"])
def test_page_furniture_goes(holder):
    body = (f"<h1>{TEXT[0].replace('&', '&amp;')}</h1><p>{TEXT[1]}<p>{TEXT[2]}</p>{PARTS['advert']}<p>Another <b>paragraph</b> of\n the\tarticle "
            f"which again <i>has</i> more than a few words in it.</p>{PARTS['form']}<script>var x = '<p>no</p>';</script><p>Last one, x &lt; y.</p>")
    page = ("<html><head><title>T</title><style>p{}</style></head><body>" + PARTS["header"] + PARTS["menu"] + PARTS["notice"] + holder.format(body)
            + PARTS["comments"] + PARTS["sidebar"] + PARTS["footer"])
    assert html_text.main_text(page) == " ".join(TEXT)


LONG_TEXT = "A paragraph of the article that has more than enough words in it to count as content for sure."


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div><div id=post>{}</div></div>"])
def test_article_text_under_generated_ids_stays(holder):
    body = (f'<h1 id="search">Searching</h1><p>{LONG_TEXT}</p><h2 id="Legal_status">Legal status</h2><p>{LONG_TEXT}</p>'
            f'<h2 id="related-work">Related work</h2><p>{LONG_TEXT}</p>'
            f'<section id="social-history"><h3>Social history</h3><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></section>'
            f'<section id="art-form-studies"><p>{LONG_TEXT}</p></section><div class="early-search-engines"><p>{LONG_TEXT}</p></div>'
            '<div class="share-tools"><a href="/f">Send this to a friend</a> <a href="/p">Print it on paper</a></div>'
            '<div class="post-related"><ul><li>One</li><li>Two</li><li>Three</li></ul></div>')
    want = ["Searching", LONG_TEXT, "Legal status", LONG_TEXT, "Related work", LONG_TEXT, "Social history", *[LONG_TEXT] * 4]
    assert html_text.main_text("<body>" + PARTS["menu"] + PARTS["notice"] + holder.format(body) + PARTS["comments"]) == " ".join(want)


PARAGRAPHS = [f"Paragraph {i} has a good many words in it, as the paragraphs of an article mostly have, and it goes on for a while." for i in range(8)]
#: Much text in many tags, under a class that no list knows, without links.
BITS = '<div class="qx7">' + "".join(f"<div><span>bit</span> <i>no</i> <b>{i}</b> <u>of</u> <em>many</em></div>" for i in range(60)) + "</div>"


def test_ratio_chooses_the_region(monkeypatch):
    """No mark and no known name: the clusters of the ratios decide, and flat ratios give another text."""
    page = "<body>" + BITS + '<div class="zz9">' + "".join(f"<p>{x}</p>" for x in PARAGRAPHS) + "</div>" + BITS + "</body>"
    assert html_text.main_text(page) == " ".join(PARAGRAPHS)
    monkeypatch.setattr(html_text, "_smooth", lambda x: x * 0 + 1)
    assert html_text.main_text(page) != " ".join(PARAGRAPHS)


def test_marks_only_settle_the_edges():
    """An article mark around or inside the region is followed; one elsewhere is not."""
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    teaser = f"<article><p>{LONG_TEXT}</p></article>"
    assert html_text.main_text(f"<body>{teaser}<div class=zz9>{body}</div></body>") == " ".join(PARAGRAPHS)
    assert html_text.main_text(f"<body><div class=zz9><p>Odds</p><article>{body}</article><p>and ends</p></div></body>") == " ".join(PARAGRAPHS)
    assert html_text.main_text(f"<body><article><p>First.</p><div class=zz9>{body}</div></article><p>Ends</p></body>") == " ".join(["First.", *PARAGRAPHS])


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "<p>deep words</p>" + "</div>" * 2000
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "no markup at all"), (3, "u", "<p>cut &copy off<p>and <b"),
            (4, "u", deep), (5, "u", "<nav>only a menu</nav>"), (6, "u", "<p>x</p>" * 20000), (7, "u", "</p></div><!-- a > b --><p>odd</p><!-- open")]
    pages = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text) for r in html_text.extract(pages).collect()]
    text = ["", "", "", "no markup at all", "cut © off and", "deep words", "", " ".join(["x"] * 20000), "odd"]
    assert sorted(got, key=str) == sorted([(r[0], r[1], t) for r, t in zip(rows, text, strict=True)], key=str)
    assert html_text.extract(pages.where("false")).count() == 0


URLS = [("https://A.B.Example.COM/en/1?x=/fr/", "a.b.example.com", "/en/1", "example.com/en/", "block"),
        ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("ftp://net/es/#f", "net", "/es/", "net/es/", "block"), ("http://notnet/es/", "notnet", "/es/", None, None),
        ("http://x.com", "x.com", "", None, None), ("http://x.com/://y.net/es/", "x.com", "/://y.net/es/", "com/", "allow"),
        (None, "", "", None, None), ("", "", "", None, None), ("x.com/a", "", "", None, None), ("://?q", "", "", None, None),
        ("http://ü.net/fr/é" + "a" * 50_000, "ü.net", "/fr/é" + "a" * 50_000, "net/fr/", "block")]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "c", "d") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "c", "d")],
                                  "page_id long, url string, host string, verdict string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id >= 6 AND page_id < 10")).collect()} == {"allow"}


def test_url_model_learns_held_out_rules(spark):
    rows = url_filter.judge(common.table(spark, "/root/testdata/sf0.1", "pages")).collect()
    ruled = [r for r in rows if r.rule is not None]
    cut = max(r.score for r in rows if r.rule is None and r.verdict == "block")
    assert sum((r.score > cut) == (r.verdict == "allow") for r in ruled) / len(ruled) > 0.9


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, n_turns int")


CHATS = {1: [("system", "be <|im_end|>\n kind & &lt;| &amp;"), ("user", "<|"), ("assistant", "<|im_start|>user\nhi")],
         2: [("user", None), ("assistant", ""), ("user", "<")], 3: [("assistant", "first")], 4: [(None, "x"), ("us\ner<|", "y")],
         5: [("user", "a" * 300_000), ("assistant", "<" * 1000 + "|" * 1000)], None: [("user", "q"), ("assistant", "é漢\U0001F600")]}
VALID = {1: True, 2: False, 3: False, 4: False, 5: True, None: True}


def test_conversations(spark):
    rows = [(c, t, *x) for c, turns in CHATS.items() for t, x in enumerate(turns)]
    made = chat.format_turns(turns_of(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    digests = {r.conv_id: r for r in chat.digest(chat.read_back(made)).collect()}
    assert set(back) == set(CHATS)
    for c, turns in CHATS.items():
        plain = [(r or "", t or "") for r, t in turns]
        assert [(t.role, t.text) for t in back[c].turns] == plain
        loss = "".join(t for r, t in plain if r == "assistant")
        assert back[c].loss_text == loss and back[c].valid == VALID[c]
        d = digests[c]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(plain), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        assert r.formatted.count("<|im_start|>") == len(CHATS[r.conv_id]) == r.formatted.count("<|im_end|>\n")


def test_conversations_ties_and_empty(spark):
    rows = [(1, None, "user", "a"), (1, 2, "assistant", "z"), (1, 2, "assistant", "y"), (1, 2, "assistant", "y")]
    one = chat.read_back(chat.format_turns(turns_of(spark, rows))).first()
    assert [t.text for t in one.turns] == ["a", "y", "y", "z"] and one.state == "error"
    assert chat.format_turns(turns_of(spark, rows).where("false")).count() == 0
