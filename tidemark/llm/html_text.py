"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most frequent function words of eight languages, lower case.
STOP_WORDS = frozenset(
    """a about all and are as at be but by can for from had has have he his in is it not of on or she that the their they this to was we were what which who will with would you
    au avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous
    aber als am an auch auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nach nicht sich sie sind und von war wie wir zu zum
    con como del el ella es esta la las lo los más muy no para pero por se sin su sus una uno y ya
    che di il gli nel non per sono alla della delle anche e da os as do dos das não uma com em na no ao
    het een van dat op te zijn voor niet met i w z na się nie jest że do jak przez dla po ale""".split()
)
# Elements by what they do to text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("nav header footer aside".split())
CHROME = PARTS | frozenset("form button select option label fieldset dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Parts of class, id and role that name adverts, notices and comments (SURE), other furniture (LIKELY), words that
# name it only where they are not beside words of another kind (ALONE), the article itself (TEXT), and layout (PLAIN).
SURE = frozenset("ad ads advert adverts advertisement advertising adsense adbox adslot adbanner adsbygoogle sponsor sponsored cookie cookies consent gdpr comment comments commentlist respond replies disqus newsletter popup modal subscribe hidden".split())
LIKELY = frozenset("sidebar sidebars widget widgets nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar contentinfo complementary signup toolbar copyright disclaimer skiplink".split())
ALONE = frozenset("alert banner dialog discussion legal login menu menus notice notices overlay popular promo reactions recommended related reply search share sharing social tag tags toc trending".split())
TEXT = frozenset("article articles blog body content entry hentry main news page post posts prose recipe story stories text".split())
PLAIN = frozenset("a area bar block bottom box btn button buttons col column container fixed form global group holder icon icons inner item items js left link links list more outer panel primary right row secondary section site slot the top unit wrap wrapper".split())
STATES = frozenset("has with no without is not overflow".split())
NAMED = SURE | LIKELY | ALONE

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")
DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿가-힯]")  # scripts with a word in a character or two
CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_HIGH = 70, 200, 0.12, 0.2, 0.2
LISTED = 0.06  # least share of listed function words in a page's long blocks for the lists to say anything about it


@dataclass(slots=True)
class Block:
    text: str
    linked: float  # share of its characters that are links
    mark: int  # innermost marked element around it; 0: none
    article: int  # outermost article or main around it; 0: none
    heading: int  # 1 to 6; 0: none
    depth: int  # elements around it, inline ones left out
    low: int  # the least depth since the block before


@dataclass(slots=True)
class Mark:
    """An element that looks like furniture: ``kind`` is tag, sure, likely or unseen; ``outer``: the marked element around it."""

    outer: int
    kind: str
    part: bool = False


@lru_cache(maxsize=20_000)
def named(value: str, outside: bool) -> str:
    """What class, id and role call an element: sure or likely furniture, or "". A word for text beside it leaves that to its blocks."""
    found, text = "", False
    for token in value.split():
        pieces = [p.lower() for p in PIECE.findall(token)]
        if not pieces or pieces[0] in STATES:
            continue
        rest = [p for p in pieces if p not in PLAIN and not p.isdigit()]
        whole = "".join(pieces)
        if whole in NAMED:
            rest = [whole]
        if outside and rest and rest[-1] in ("header", "headers"):
            found = found or "likely"
        if not rest:
            continue
        ends = {rest[0], rest[-1]}
        if ends & SURE:
            found = "sure"
        elif ends & LIKELY or any(p in ALONE for p in rest) and all(p in NAMED or p in TEXT for p in rest):
            found = found or "likely"
        elif all(p in TEXT for p in rest):
            text = True
    return "" if text else found


def _kind(name: str, tag: str, inside: bool) -> str:
    """How an element is marked; ``inside``: it stands in an article, where a header holds the title."""
    if name in ("html", "body"):
        return ""
    kind = "tag" if name in CHROME and not (name == "header" and inside) else ""
    names = []
    for key, *values in ATTRIBUTE.findall(tag):
        value, key = values[0] or values[1] or values[2], key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            return "unseen"
        if key in ("class", "id", "role"):
            names.append(value)
    if kind or not names or name in ("article", "main") and not inside:
        return kind
    return named(" ".join(names), not inside)


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's text blocks in order, and the marked elements around them (the first stands for none)."""
    out: list[Block] = []
    marks = [Mark(0, "")]
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, mark, is it a mark inside of a line
    open_names: dict[str, int] = {}
    count = article = articles = links = heading = depth = mute = 0
    low, mark = 0, 0

    def flush() -> None:
        nonlocal low
        if parts:
            text = " ".join("".join([t for t, _ in parts]).split())
            if text:
                linked = sum(len("".join(t.split())) for t, link in parts if link) / len(text.replace(" ", "")) if any(link for _, link in parts) else 0.0
                out.append(Block(text, linked, mark, article if articles else 0, heading, depth, min(low, depth)))
                low = depth
            parts.clear()

    def leave() -> None:
        nonlocal articles, links, heading, depth, mark, mute, low
        name, own, inline = stack.pop()
        open_names[name] -= 1
        if own:
            mark = marks[own].outer
        mute -= inline
        articles -= name in ("article", "main")
        links -= name == "a"
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = 0
        if name not in INLINE:
            depth -= 1
            low = min(low, depth)

    at = breaks = 0  # breaks: the parts up to the last <br> of this block
    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not mute:
            text = page[at:end]
            parts.append((html.unescape(text) if "&" in text else text, links > 0))
        if not m:
            break
        at, tag = m.end(), m[0]
        of = NAME.match(tag)
        if tag.startswith("<![CDATA["):
            parts.append((tag[9:].removesuffix("]]>"), links > 0))
            continue
        if not of:
            continue
        name, closing = of[1].lower(), tag[1] == "/"
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                close = CLOSE[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if name == "br":
            if breaks and not "".join([t for t, _ in parts[breaks:]]).strip():
                flush()
            parts.append(("\n", False))
            breaks = len(parts)
            continue
        if name not in INLINE:
            flush()
            breaks = 0
        if name in VOID:
            continue
        if closing:
            if open_names.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
            continue
        if name in P_CLOSERS and open_names.get("p") and any(n == "p" for n, _, _ in stack[-4:]):
            while any(n == "p" for n, _, _ in stack[-4:]):
                leave()
        if tag.endswith("/>"):
            continue
        count += 1
        kind, own, inline = _kind(name, tag, articles > 0), 0, False
        if kind and name in INLINE:  # inside of a line: its text goes, the line stays
            inline = kind in ("sure", "unseen")
            mute += inline
        elif kind:
            marks.append(Mark(mark, kind, name in PARTS))
            own = mark = len(marks) - 1
        stack.append((name, own, inline))
        open_names[name] = open_names.get(name, 0) + 1
        if name in ("article", "main"):
            article = article if articles else count
            articles += 1
        links += name == "a"
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = int(name[1])
        depth += name not in INLINE
    flush()
    return out, marks


def length(text: str) -> int:
    """Characters, those of scripts that write a word in one or two counted three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(DENSE.findall(text))


def stops(text: str) -> tuple[int, int]:
    """(function words, words)."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def listed(found: list[Block]) -> bool:
    """Do the lists know the page's language? Yes, unless its long blocks hardly hold a listed word."""
    few = words = 0
    for b in found:
        if b.linked <= LINKS_HIGH and length(b.text) >= LENGTH_LOW:
            s, n = stops(b.text)
            few, words = few + s, words + n
    return not words or few >= LISTED * words


def first_pass(block: Block, known: bool) -> str:
    """good, near (fairly good), bad or short (undecided), by length, link density and stop-word density.

    In an article less of each will do. Where the lists don't know the language (``known`` is false), length and links decide.
    A long block without function words is undecided.
    """
    n, links = length(block.text), block.linked
    if block.heading and n < LENGTH_HIGH:
        return "bad" if links > LINKS_HIGH else "short"
    if n < LENGTH_LOW:
        return "bad" if links > (0.5 if block.article else LINKS_HIGH) else "short"
    few, words = stops(block.text)
    share = few / words if words and known else 0.0 if known else STOP_HIGH
    if links > LINKS_HIGH:
        prose = share >= STOP_LOW if block.article else share >= STOP_HIGH and n > LENGTH_HIGH and links < 0.5
        return "near" if prose and known else "bad" if links > 0.5 or not block.article else "short"
    if share >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH or block.article and known else "near"
    if share >= STOP_LOW:
        return "good" if block.article else "near"
    return "short"


def _titles(found: list[Block], labels: list[str]) -> int | None:
    """Place of the page's title: its first h1, else its first heading. A linked heading is undecided, not bad, if it is
    the only h1 or good text follows in its element before the next heading."""
    tops = [i for i, b in enumerate(found) if b.heading == 1]
    heads = [i for i, b in enumerate(found) if b.heading]
    for k, i in enumerate(heads):
        if labels[i] == "bad":
            end, low = heads[k + 1] if k + 1 < len(heads) else len(found), found[i].depth
            for j in range(i + 1, end):
                low = min(low, found[j].low)
                if low < found[i].depth - 1:
                    break
                if labels[j] == "good":
                    labels[i] = "short"
                    break
            if tops == [i]:
                labels[i] = "short"
    return (tops or heads or [None])[0]


def judged(found: list[Block], marks: list[Mark]) -> list[str]:
    """Labels of the first pass; blocks in marked elements are bad.

    A marked element is page layout, and its mark void, if it holds over half of the good text, and the title
    or, unless its name is sure, a good article or other parts of a page; a tag also if two good blocks or more and no other are in it.
    """
    known = listed(found)
    labels = [first_pass(b, known) for b in found]
    title = _titles(found, labels)
    if len(marks) == 1:
        return labels
    n = len(marks)
    size, good, whole, parts = [0] * n, [0] * n, [False] * n, [False] * n
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label in ("good", "near") and marks[b.mark].kind != "unseen":
            size[b.mark] += len(b.text)
            good[b.mark] += label == "good"
            whole[b.mark] |= b.article > 0 and label == "good"
    titled = [False] * n
    if title is not None:
        titled[found[title].mark] = True
    for k in range(n - 1, 0, -1):
        up = marks[k].outer
        if marks[k].kind == "unseen":
            continue
        size[up], good[up] = size[up] + size[k], good[up] + good[k]
        whole[up], titled[up] = whole[up] or whole[k], titled[up] or titled[k]
        parts[up] = parts[up] or parts[k] or marks[k].part
    gone = [False] * n
    for k in range(1, n):
        m = marks[k]
        holds = titled[k] or m.kind != "sure" and (whole[k] or parts[k]) or m.kind == "tag" and good[k] > 1 and size[k] == size[0]
        gone[k] = gone[m.outer] or not (m.kind != "unseen" and 2 * size[k] > size[0] and holds)
    labels = ["bad" if gone[b.mark] else label for b, label in zip(found, labels, strict=True)]
    if "good" not in labels:  # a short page: what is fairly good is the best there is
        labels = ["good" if label == "near" else label for label in labels]
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones.

    The nearest is the one fewest elements away, then fewest blocks; of two at one distance a heading follows the one after it,
    others the good one. A fairly good block needs one good neighbour. Blocks of another article count as bad, but for the
    page's title before one. The page's title, its first h1, stays if the next decided block is good, however near the menu before it is.
    On a page without good text all undecided blocks stay.
    """
    n = len(labels)
    title = next((i for i, b in enumerate(found) if b.heading == 1), None)
    if "good" not in labels:
        return [label != "bad" for label in labels]
    sides: list[list[tuple[int, int, bool] | None]] = [[None, None] for _ in range(n)]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last, low = None, 0
        for i in order:
            b = found[i]
            if last is not None:
                low = min(low, b.low if side == 0 else found[i + 1].low)
                far = found[last].depth + b.depth - 2 * low
                same = b.article == found[last].article or side == 1 and b.heading == 1 and not b.article
                sides[i][side] = (far, abs(last - i), labels[last] == "good" and same)
            if labels[i] in ("good", "bad"):
                last, low = i, b.depth
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        before, after = sides[i]
        near = [s for s in (before, after) if s]
        if i == title and after and after[2]:
            out.append(True)
        elif label == "near":
            out.append(any(good for _, _, good in near))
        elif found[i].heading and before and after and before[0] == after[0]:
            out.append(after[2])
        else:
            out.append(min(near, key=lambda s: (s[0], s[1], not s[2]))[2])
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by a line break; "" for a null, empty or textless page."""
    found, marks = blocks(page or "")
    keep = second_pass(found, judged(found, marks))
    return "\n".join(b.text for b, good in zip(found, keep, strict=True) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html, in time linear in its length.

    Null and empty html give "" and 0. Null ids and urls stay null; repeated rows and ids give a row each; very long pages are
    read whole; an empty table gives no rows. Other columns are left out, whatever their names.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
