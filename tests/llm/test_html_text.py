"""Page extraction: pages without an article tag, whose text only length, links, function words and neighbours show."""

import random
import time

import pytest

from tidemark.llm import html_text

GOOD = "This is a sentence of the text that is long enough to count as good, with the words that the language has and that we look for in it, and it goes on for a while so that there is no doubt about it at all, is there."
POLISH = "Wczoraj rano mieszkańcy miasteczka zebrali się przed ratuszem, żeby posłuchać przemówienia burmistrza, który zapowiedział budowę nowego mostu nad rzeką oraz remont starej szkoły podstawowej w centrum."
FINNISH = "Kaupungin asukkaat kokoontuivat eilen aamulla torille kuuntelemaan pormestarin puhetta, jossa luvattiin rakentaa uusi silta joen yli ja korjata vanha koulurakennus keskustassa ennen kevättä."
JAPANESE = "昨日の朝、町の住民は市役所の前に集まり、新しい橋の建設と古い小学校の改修を発表した市長の演説を聞きました。" * 3
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; Example</footer>"

CASES = {
    "polish": (f"{NAV}<div><h1>Tytuł</h1><p>{POLISH}</p><p>{POLISH}</p></div>{FOOT}", ["Tytuł", POLISH, POLISH]),
    "language without a list": (f"{NAV}<div><h1>Otsikko</h1><p>{FINNISH}</p><p>{FINNISH}</p></div>{FOOT}", ["Otsikko", FINNISH, FINNISH]),
    "no spaces": (f"{NAV}<div><h1>題</h1><p>{JAPANESE}</p></div>{FOOT}", ["題", JAPANESE]),
    "blog classes": (f'{NAV}<div class="post tag-python category-news"><h2>T</h2><p>{GOOD}</p><p>Short.</p></div>{FOOT}', ["T", GOOD, "Short."]),
    "layout classes": (f'{NAV}<div class="content has-search related-2"><p>{GOOD}</p></div>{FOOT}', [GOOD]),
    "a recipe for cookies": (f'{NAV}<div class="recipe cookies"><p>{GOOD}</p></div>{FOOT}', [GOOD]),
    "cookies, by the title": (f'{NAV}<div class="cookies"><h1>Cookies</h1><p>{GOOD}</p><p>{GOOD}</p></div>{FOOT}', ["Cookies", GOOD, GOOD]),
    "one form around all": (f"<form>{NAV}<div><h1>T</h1><p>{GOOD}</p><p>{GOOD}</p></div>{FOOT}</form>", ["T", GOOD, GOOD]),
    "a form of its own": (f"{NAV}<div><h1>T</h1><p>{GOOD}</p></div><form>{GOOD}</form>{FOOT}", ["T", GOOD]),
    "nav never closed": (f"<nav><ul><li><a href=x>Home</a></li></ul><div><h1>T</h1><p>{GOOD}</p><p>{GOOD}</p></div>{FOOT}", ["T", GOOD, GOOD]),
    "a teaser is the article": (f'<article><h3><a href=x>Other</a></h3><p>Read it.</p></article><div id="content"><h1>T</h1><p>{GOOD}</p><p>Short.</p></div>', ["T", GOOD, "Short."]),
    "title before the article": (f"{NAV}<h1>T</h1><article><p>{GOOD}</p></article>{FOOT}", ["T", GOOD]),
    "only a notice": (f'{NAV}<div class="cookie-notice">{GOOD}</div>{FOOT}', []),
    "comments as articles": (f'{NAV}<div><h1>T</h1><p>{GOOD}</p></div><div id="comments"><h3>3 thoughts</h3><article class="comment-body"><header>Bob</header><p>{GOOD}</p></article><p>{GOOD}</p></div>', ["T", GOOD]),
    "adverts by many names": ("".join(f'<div class="{c}"><p>{GOOD}</p></div>' for c in ("ad", "ad-slot", "advert_box", "sponsoredPost", "cookie-law-info-bar", "sidebar-left")) + f"<div><h1>T</h1><p>{GOOD}</p><p>{GOOD}</p></div>", ["T", GOOD, GOOD]),
    "short page": (f"{NAV}<div><p>Only a short one.</p></div>{FOOT}", ["Only a short one."]),
    "unseen in a line": (f'<p>{GOOD} <span class="sr-only hidden">unseen</span>end</p>', [f"{GOOD} end"]),
    "parts of an article": (f"<article><header><h1>T</h1></header><p>{GOOD}</p><aside>{GOOD}</aside><footer>Tags: x</footer></article>", ["T", GOOD]),
}


@pytest.mark.parametrize("case", CASES)
def test_page_shapes(case):
    page, want = CASES[case]
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == (want or [""])


def words(r, n, stop):
    content = ["market", "river", "engine", "season", "letter", "garden", "winter", "window", "island", "bridge", "doctor", "planet"]
    stops = ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with"]
    return (" ".join(r.choice(stops) if r.random() < stop else r.choice(content) for _ in range(n)) + ".").capitalize()


def page(seed):
    """A page of nested divs without any telling name, and its text: titles, long and short paragraphs; around them menus
    (links), keyword boxes (long, no function words) and labels (short, beside menus)."""
    r = random.Random(seed)
    menu = lambda: "<div>" + "".join(f"<div><a href=/{k}>{words(r, 2, 0)}</a></div>" for k in range(r.randint(3, 8))) + f"<div>{words(r, 5, 0.6)}</div></div>"
    keywords = lambda: f"<div><div>{words(r, 30, 0)}</div><div><a href=/x>{words(r, 3, 0)}</a></div></div>"
    text, body = [words(r, 5, 0.2)], []
    body.append(f"<h1>{text[0]}</h1>")
    for _ in range(r.randint(2, 6)):
        for n in [r.randint(45, 90)] + [r.randint(2, 6)] * r.randint(0, 2):
            text.append(words(r, n, 0.45))
            body.append(f"<{'p' if seed % 2 else 'div'}>{text[-1]}</{'p' if seed % 2 else 'div'}>")
    around = [menu(), keywords(), menu()]
    r.shuffle(around)
    inner = "<div>" * (seed % 3) + "".join(body) + "</div>" * (seed % 3)
    return f"<html><body>{menu()}<div>{inner}</div>{''.join(around)}</body></html>", "\n".join(text)


PAGES = [page(seed) for seed in range(36)]


def test_pages_without_article():
    for html, text in PAGES:
        assert html_text.main_text(html) == text


@pytest.mark.parametrize("part", ["function words", "links", "length", "second pass"])
def test_every_rule_decides(monkeypatch, part):
    """Without any one of the rules most pages come out otherwise."""
    if part == "function words":
        monkeypatch.setattr(html_text, "stops", lambda text: (1, 1))
    elif part == "links":
        monkeypatch.setattr(html_text, "LINKS_HIGH", 2.0)
    elif part == "length":
        monkeypatch.setattr(html_text, "length", lambda text: 1000)
    else:
        monkeypatch.setattr(html_text, "second_pass", lambda found, labels: [x in ("good", "near") for x in labels])
    assert sum(html_text.main_text(html) != text for html, text in PAGES) > len(PAGES) // 2


def test_time_is_linear():
    def seconds(n):
        began = time.perf_counter()
        for p in ("<div><b>" * n + "</i>" * n, "<nav>" * n + "<p>x" * n, "<h2><a>x</a></h2>" * n):
            html_text.main_text(p)
        return time.perf_counter() - began

    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


def test_rows_and_tables(spark):
    rows = [(1, "u", f"<p>{GOOD}</p>"), (1, "u", f"<p>{GOOD}</p>"), (None, None, None), (2, "u", "")]
    d = spark.createDataFrame([(*x, "own") for x in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((x["page_id"] or 0, x["text"], x["n_chars"]) for x in got.collect()) == [(0, "", 0), (1, GOOD, len(GOOD)), (1, GOOD, len(GOOD)), (2, "", 0)]
    assert html_text.extract(d.where("false")).count() == 0
