"""Main text of made pages, with known articles."""

import random
from html import escape

from ledgerleaf.llm import html_text

NOISE = [
    '<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News & more</a></li></ul></nav>', '<header><p>The Daily Site, since 1900</p></header>',
    '<aside><p>Read this too: a very long teaser that goes on and on about nothing at all.</p></aside>', '<div class="ad">Buy now, cheap and good!</div>',
    '<form action="/q"><label>Your name</label><input type="text"><textarea>say</textarea></form>', '<div id="cookie-notice">We use cookies.</div>',
    '<script>var t="</p>"; if (a<b) document.write("<p>no</p>");</script>', '<style>p{margin:0}</style>', '<!-- <p>hidden</p> -->',
    '<section class="comments"><article class="comment"><p>First! A reader says a lot of things in this comment.</p></article></section>',
    '<footer>&copy; site &middot; all of it</footer>', '<noscript><img src="x">No script</noscript>',
]


def page(rng, wrap=True):
    blocks = [" ".join(rng.choice(["wörter", "the", "a<b", "&", "naïve", "x", "end."]) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
    body = ""
    for k, b in enumerate(blocks):
        text = escape(b).replace(" ", rng.choice([" ", "\n  ", "&nbsp;"]))
        body += f"<h1>{text}</h1>" if k == 0 else rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><b>{text}</b></p>", f"<div><p>{text}</p></div>"])
        if rng.random() < 0.3:
            body += rng.choice(NOISE)
    noise = lambda: "".join(rng.sample(NOISE, rng.randint(0, 5)))
    article = f"<article>{body}</article>" if wrap else f"<div>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>T & title</title></head><body>{noise()}{article}{noise()}</body></html>", "\n".join(blocks)


def test_articles():
    rng = random.Random(6)
    for _ in range(400):
        html, text = page(rng)
        assert html_text.main_text(html) == text, html


def test_without_article_element():
    long = [" ".join(["sentence"] * 30 + [str(k)]) for k in range(4)]
    html = "<body>" + NOISE[0] + "".join(f"<p>{t}</p>" for t in long) + "<ul>" + "<li><a href='/a'>link text here</a></li>" * 9 + "</ul>" + NOISE[-2] + "<p>short"
    assert html_text.main_text(html) == "\n".join(long)


def test_rows(spark):
    rng = random.Random(8)
    made = [page(rng) for _ in range(30)]
    rows = [(i, "u", h, "t") for i, (h, _) in enumerate(made)] + [(90, None, None, "t"), (91, "u", "", "t"), (92, "u", "<p", "t"), (None, "u", made[0][0], "t"), (93, "u", "<article><p>cut &am", "t"), (0, "u", made[0][0], "t")]
    rows.append((94, "u", "<article>" + "<p>x y" * 50_000, "t"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        want = made[r.page_id or 0][1] if r.page_id is None or r.page_id < 90 else {93: "cut &am", 94: "\n".join(["x y"] * 50_000)}.get(r.page_id, "")
        assert (r.text, r.n_chars) == (want, len(want))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_header_of_an_article():
    html = "<body><header><h1>Site</h1></header><article><header><div><h1>Title</h1></div><p>by me</p></header><p>Text.</p><div class='ad'><h2>Buy</h2></div></article></body>"
    assert html_text.main_text(html) == "Title\nText."


def test_articles_without_the_element():
    rng = random.Random(6)
    for _ in range(400):
        html, text = page(rng, wrap=False)
        assert html_text.main_text(html) == text, html


def test_lead_before_an_advert():
    long = [" ".join(["sentence"] * 30 + [str(k)]) for k in range(3)]
    for around in ("{}", "<div>{}</div>", "<div><h1>Head</h1></div><section>{}</section>"):
        inside = "<h1>Title</h1><p>A short lead.</p><div class='ad'><p>Buy</p></div>" + "".join(f"<p>{t}</p>" for t in long) + "<aside>Teaser</aside><p>The end."
        html = "<body>" + NOISE[0] + around.format(inside) + NOISE[-2]
        want = ["Title", "A short lead.", *long, "The end."]
        assert html_text.main_text(html) == "\n".join(["Head"] * ("Head" in around) + want)


def test_plain_elements():
    text = ["A title here", "The first paragraph of the text says something, at some length, as texts do.", "short", "The second one goes on. And on, for a while at least, before it ends."]
    menu, closing = ["Home", "About us", "Contact"], ["Copyright 2024 Example Inc.", "Privacy policy and terms"]
    html = "<body>" + "".join(f"<div>{t}</div>" for t in [*menu, *text[1:], *closing]) + "</body>"
    assert html_text.main_text(html) == "\n".join(text[1:])
    html = "<body><div>" + "".join(f"<div>{t}</div>" for t in menu) + "</div>" + f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:]) + "".join(f"<span>{t}</span><br>" for t in closing)
    got = html_text.main_text(html).split("\n")
    assert got[:4] == text
    assert html_text.main_text("<div>only this</div>") == "only this"  # nothing is dense: nothing is cut


def test_words_of_names_lose_no_article_text():
    for names in ("search results", "social history", "login-free note", "tags of war"):
        html = f"<article><p>Before.</p><div class='{names}'><p>Inside of it.</p></div><p>After.</p></article>"
        assert html_text.main_text(html) == "Before.\nInside of it.\nAfter.", names
    html = "<article><p>Before.</p><div class='ad banner'>Buy this.</div><div class='share-buttons'>Share</div><div id='newsletter'>Subscribe now</div><p>After.</p></article>"
    assert html_text.main_text(html) == "Before.\nAfter."


def test_words_kept_and_lost():
    """Recall and precision by words over made pages in plain elements."""
    rng = random.Random(15)
    kept = given = shown = 0
    for _ in range(200):
        text = [" ".join(rng.choice(["stone", "river", "over", "the", "hill"]) for _ in range(rng.randint(6, 60))) + "." for _ in range(rng.randint(2, 9))]
        menu = rng.sample(["Start", "Our team", "Jobs", "Shop", "Log in", "Help"], rng.randint(1, 6))
        closing = rng.sample(["Imprint", "Terms of use", "Privacy", "\u00a9 2024 The Site", "Sitemap"], rng.randint(1, 5))
        html = "<html><body>" + "".join(f"<div>{t}</div>" for t in [*menu, *text, *closing]) + "</body></html>"
        got, want = html_text.main_text(html).split(), " ".join(text).split()
        kept, given, shown = kept + len([w for w in got if w in want]), given + len(want), shown + len(got)
    assert kept == given and kept >= 0.99 * shown
