"""Main text of web pages by two-pass block rules.

First pass: each block of text is good, bad or ambiguous by its place, length,
share of linked characters and share of stop words. Second pass: ambiguous
blocks, first the long and then the short ones, take the label of the nearest
decided neighbours.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

LENGTH_LOW, LENGTH_HIGH = 70, 200  # characters
LINKS_BODY, LINKS_ARTICLE = 0.2, 0.5  # share of characters inside links
# Frequent words of four languages, and the shares of words that make a block near good and good: shorter lists reach less.
LANGUAGES = (
    (
        """the of and to in a is that it for was on are as with be at by this have from or an they which you were
        there has more not but all one can had their what will when who if no so he she we my his her its""",
        0.30, 0.32,
    ),
    ("le la les de des du un une et est en que qui dans pour pas sur au aux par avec il elle ce se ne plus son sa", 0.20, 0.22),
    ("der die das den dem des ein eine einer und ist in zu von mit auf für nicht sich als auch es an im werden", 0.18, 0.20),
    ("el los las una uno y que del al es por con para su no se lo como más o pero sus de la en un a", 0.20, 0.22),
)
STOP_LISTS = tuple((frozenset(words.split()), low, high) for words, low, high in LANGUAGES)
STOP_WORDS = frozenset().union(*(words for words, _, _ in STOP_LISTS))
STOP_LISTED = 0.08  # with a lower share on the whole page its language is taken to have no list
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr""".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())  # hold text, no blocks of their own
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside form select button menu dialog svg canvas object audio video head option datalist".split())
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus
    reply replies respond share sharing social related newsletter subscribe subscription signup login popup modal
    overlay widget pagination pager toolbar masthead skip""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
PART = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    bad: bool  # in a menu, footer, advert or the like
    article: int  # number of the article or main element around it, 0 outside
    home: int  # number of the container around it


def _place(tag: str, attributes: str, article: int) -> bool:
    """Whether an element is page furniture by its name, class, id, role or style."""
    if tag in DROP or (tag == "header" and not article):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            parts = {p.lower() for p in PART.findall(value)}
            if parts & BOILERPLATE or ("header" in parts and not article):
                return True
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, furniture, article and container number
    text: list[str] = []
    linked, link, articles, homes, at = 0, 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, bad, article, home = stack[-1] if stack else ("", False, 0, 0)
                out.append(Block(joined, min(linked, len(joined)), bad, article, home))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if link:
                linked += len(" ".join(piece.split()))

    def pop(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        if tag in INLINE or tag == "br":
            if tag != "a" and not closing and tag not in VOID and attributes and _place(tag, attributes, 1):
                close()
                stack.append((tag, True, *(stack[-1][2:] if stack else (0, 0))))
            elif closing and stack and stack[-1][0] == tag:
                close()
                stack.pop()
            continue
        close()
        if tag in VOID or attributes.endswith("/") and tag == "svg":
            continue
        if closing:
            pop((tag,), ())
            link = 0
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            pop((tag,) if tag not in ("dt", "dd") else ("dt", "dd"), ("ul", "ol", "table", "dl", "div", "section", "article", "main"))
        if stack and stack[-1][0] == "p":
            stack.pop()
        _, bad, article, home = stack[-1] if stack else ("", False, 0, 0)
        if tag not in LEAF:
            homes += 1
            home = homes
        if not article and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)):
            articles += 1
            article = articles
        stack.append((tag, bad or _place(tag, attributes, article), article, home))
        link = 0
    close()
    return out


def words_of(text: str) -> list[str]:
    return [w.strip(".,;:!?()\"'") for w in text.lower().split()]


def stop_level(words: list[str]) -> int:
    """2 for many stop words of some language, 1 for nearly as many, else 0."""
    best = 0
    for stops, low, high in STOP_LISTS:
        share = sum(w in stops for w in words) / len(words)
        best = max(best, 2 if share >= high else int(share >= low))
    return best


def first_pass(blocks: list[Block]) -> list[str]:
    """good, bad, near (ambiguous, long) or short (ambiguous) for each block.

    Length, links and stop words decide inside and outside articles; place
    shifts the limits. Few stop words alone make no block bad, and on a page in
    a language without a list they say nothing.
    """
    words = [[] if b.bad or len(b.text) < LENGTH_LOW or b.linked > LINKS_BODY * len(b.text) else words_of(b.text) for b in blocks]
    total = sum(map(len, words))
    listed = sum(w in STOP_WORDS for ws in words for w in ws) >= STOP_LISTED * total
    inside = sum(len(w) for w, b in zip(words, blocks, strict=True) if b.article)
    elsewhere = inside > 0 and 2 * inside >= total  # articles hold most of the text: what is outside is less likely
    labels = []
    for b, ws in zip(blocks, words, strict=True):
        n, density = len(b.text), b.linked / len(b.text)
        if b.bad or density > (LINKS_ARTICLE if b.article else LINKS_BODY):
            labels.append("bad")
        elif n < LENGTH_LOW:
            labels.append("bad" if density > 0 and not b.article else "short")
        else:
            level = stop_level(ws or words_of(b.text)) if listed else 0 if elsewhere and not b.article else 2
            if b.article:
                labels.append("good" if level else "near")
            else:
                labels.append("good" if n > LENGTH_HIGH and level == 2 or n > LENGTH_HIGH and level and not elsewhere else "near")
    return labels


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks are main text. Ambiguous ones look left and right inside their article (or outside of all).

    Furniture around an article decides nothing inside it, and furniture
    nothing about a long block. Of equally near neighbours that differ, one in
    the same container decides; otherwise a long block is good and a short one
    bad. With no decided neighbour a block of an article is good, and one of a
    page without any good block too; so is a long block where nothing else is
    good, unless articles hold most of the text and it is outside.
    """
    labels = list(labels)
    has_article = any(b.article and not b.bad for b in blocks)
    weight = [len(b.text) if x in ("good", "near") else 0 for b, x in zip(blocks, labels, strict=True)]
    inside = sum(w for w, b in zip(weight, blocks, strict=True) if b.article)
    elsewhere = inside > 0 and 2 * inside >= sum(weight)

    def sides(i: int) -> set[str]:
        b, found = blocks[i], []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(blocks) and (not b.article or blocks[j].article == b.article):
                mine = not has_article or blocks[j].article == b.article
                furniture = blocks[j].bad and (b.article or labels[i] == "near")
                if labels[j] in ("good", "bad") and mine and not furniture:
                    found.append((abs(j - i), labels[j], blocks[j].home == b.home))
                    break
                j += step
        near = min((f[0] for f in found), default=0)
        got = {f[1] for f in found if f[0] == near}
        if len(got) == 2:
            got = {f[1] for f in found if f[2]} or got
        return got

    for kind in ("near", "short"):
        any_good = "good" in labels
        good_in = {b.article for b, x in zip(blocks, labels, strict=True) if x == "good"}
        new = {}
        for i, b in enumerate(blocks):
            if labels[i] != kind:
                continue
            got = sides(i)
            if kind == "near":
                alone = b.article not in good_in and (b.article or not elsewhere)
                keep = "good" in got or bool(alone) or (not got and bool(b.article))
            elif not got:
                keep = bool(b.article) or not any_good
            else:
                keep = got == {"good"} or (not any_good and not b.article)
            new[i] = "good" if keep else "bad"
        for i, x in new.items():
            labels[i] = x
    return [x == "good" for x in labels]


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and text-free pages."""
    blocks = blocks_of(page or "")
    keep = second_pass(blocks, first_pass(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """Columns of ``pages`` without the page source, and ``text`` and ``n_chars`` (code points).

    Null, empty and text-free pages give an empty text; broken and cut pages are
    read as far as they go. Columns that had the result's names are replaced.
    Pages are independent: repeated rows repeat, empty input gives no rows.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html_col]
    schema = pages.select(*kept).schema

    def run(batches):
        for b in batches:
            text = [main_text(v) for v in b.column(len(kept)).to_pylist()]
            cols = [*b.columns[: len(kept)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "text", "n_chars"])

    ddl = schema.add("text", "string").add("n_chars", "long")
    return pages.select(*kept, pages[html_col]).mapInArrow(run, ddl)
