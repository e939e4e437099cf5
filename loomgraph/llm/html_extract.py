"""Main text of web pages by two-pass block rules.

Pass one cuts a page into blocks and weighs each: stop-word density and length, link
density (its own and its list's), and as further evidence the elements and names around
it. Blocks of clear weight are good or bad; short and ambiguous ones stay undecided.
Pass two gives every undecided block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and a to in is it that for was on are as with be by at this from or an have not they which were but has had his her we you he she all their there been if more when who will would no so "
        "le la les de des du un une et en est que qui dans pour sur au aux pas par plus ne ce se avec il elle ils sont mais ou son sa ses nous vous leur cette "
        "der die das und in zu den dem von mit ist nicht ein eine einen einer auf für im sich des auch als an es werden aus er hat dass sie nach wird bei noch wie über so zum war "
        "el los las y que del se por con no una su para es al lo como o pero sus le ha me si sin sobre este ya entre cuando muy desde nos"
    ).split()
)
SHORT = 70  # characters: shorter blocks say little about themselves
DENSE, SPARSE = 0.30, 0.10  # stop words among words: prose, and what isn't
LINKED = 0.5  # share of a block's characters within links
FEW_LINKS = 0.2  # the same, of prose in any language
#: What each kind of evidence weighs. A block is good from +2 on, bad from -2 on, else undecided.
WEIGHTS = {
    "dense": 2,  # long, with many stop words
    "prose": 2,  # long and in sentences, in a language or field without the listed stop words
    "sparse": -2,  # long for a label, short for prose, and hardly a stop word
    "linked": -3,  # mostly links, alone or with its list
    "rights": -2,  # a copyright line
    "article": 1,  # within the page's article
    "outside": -4,  # outside it, where there is one
    "boiler": -5,  # within an element or name of menus, adverts, comments and the like
}
CLEAR = 2
_SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*(?:\s|$)|[。！？．…؟۔।॥።։]|[,;，、；،].*[,;，、；،]", re.S)
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")  # scripts that say as much in half as many characters

_RAW = "script|style|title|noscript|template|textarea|iframe"  # up to their end tag, as browsers read them
_LEFT_OUT = "select|svg|math|object|canvas|audio|video|button|datalist|label|legend"  # ordinary elements whose text is no reader's
_BLOCK = "body|nav|header|footer|aside|form|article|main|div|section|ul|ol|li|dl|dt|dd|table|tr|td|th|thead|tbody|tfoot|blockquote|figure|figcaption|details|dialog|fieldset|center|menu|address|pre|p|hr|h[1-6]"
_INSIDE = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+"  # quotes count after an equals sign only, as browsers read tags
_ALONE = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>/]|/(?!>))*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|(?P<alone><(?:{_LEFT_OUT}|title|noscript|template|textarea|iframe)(?![\w:-]){_ALONE}/>)"
    rf"|<(?P<raw>{_RAW})(?![\w:-]){_INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    # closed: its end comes before another of its name and before an article; else it ends at the next block
    rf"|<(?P<out>{_LEFT_OUT})(?![\w:-]){_INSIDE}>(?:[^<]*+(?:<(?!/?(?:(?P=out)|article|main|section|body)(?![\w:-]))[^<]*+)*+</(?P=out)\s*>|[^<]*+(?:<(?!/?(?:(?P=out)|{_BLOCK})(?![\w:-]))[^<]*+)*+)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_INSIDE})>|<[/!?a-zA-Z][^>]*>?",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr acronym".split())
_CONTAINERS = frozenset("head body nav header footer aside form article main div section ul ol dl table tr td th thead tbody tfoot blockquote figure details dialog fieldset center menu address pre figcaption p li dt dd h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table".split())
_ITEMS = frozenset("li dt dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILER_TAGS = frozenset("head nav footer aside form dialog fieldset menu".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted comment comments commentlist discussion discussions reply replies respond disqus sidebar side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "cookie cookies cookiebar cookiebanner consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar masthead banner copyright disclaimer skip hidden form search".split()
)
_HEADER_NAMES = frozenset("header topbar".split())
#: Words that a boilerplate name may have before and after it within one class or id, as in site-footer or share-buttons.
_BEFORE = frozenset("site main top bottom page primary secondary global post article entry blog single web google mobile desktop sticky fixed floating js wp user left right email mail the in".split())
_AFTER = frozenset("content list item items box container wrapper wrap inner outer links link posts post articles stories block section area slot unit bar buttons button icons icon group panel body text title top bottom left right column col primary secondary thread count toggle msg message".split())
#: Elements of these names hold articles of their own, which aren't the page's.
_HOLDERS = frozenset("comment comments commentlist reply replies respond disqus sidebar side rail widget widgets related recommended recommendations sponsor sponsored promo promotion ad ads".split())
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    listed: bool
    boiler: bool
    article: int  # number of the enclosing article or main element, 0 if none
    list: int = 0  # number of the enclosing list or table, 0 if none
    label: str = ""
    stop: float = field(default=0.0)


_OPEN, _NAMED, _HOLDER, _FIRM = range(4)  # no boilerplate; by a name, which an article within overrules; by a name that holds articles; by what it is


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}


def _boiler_words(token: str, names: frozenset[str]) -> list[str]:
    """The boilerplate names of one class or id that is such a name, or made of such names and words usual beside them."""
    words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w and not w.isdigit()]
    held = [i for i, w in enumerate(words) if w in names]
    if not held or not all(w in names or w in _BEFORE for w in words[: held[0]]) or not all(w in names or w in _AFTER for w in words[held[0] :]):
        return []
    return [words[i] for i in held]


def _boiler(tag: str, attrs: str, in_article: bool) -> int:
    if tag in _BOILER_TAGS and tag != "form" or tag == "header" and not in_article:
        return _FIRM
    if tag in ("body", "main") or not attrs and tag != "form":
        return _OPEN
    found = _attributes(attrs)
    style = found.get("style", "").replace(" ", "").lower()
    if found.get("role", "").lower() in _BOILER_ROLES or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden") == "true" or "hidden" in found:
        return _FIRM
    names = _BOILER_NAMES if in_article else _BOILER_NAMES | _HEADER_NAMES
    words = [w for token in f"{found.get('class', '')} {found.get('id', '')}".split() for w in _boiler_words(token, names)]
    if "hidden" in words:
        return _FIRM
    return _HOLDER if not _HOLDERS.isdisjoint(words) else _NAMED if words or tag == "form" else _OPEN


def blocks_of(page: str, lift: bool = False) -> list[Block]:
    """The page's blocks of text in order; what holds no text of a reader's (scripts, comments) is left out.

    A form or a boilerplate name around a main or article element doesn't make that
    one boilerplate, save articles within comments, sidebars and the like; ``lift`` lets no name decide on articles.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, int, int, int, int]] = []  # tag, level of boilerplate, article, list, place of the item that an item of the same list ends
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = link = articles = lists = 0
    boiler, article, inside = _OPEN, 0, 0
    passed, depth = "", 0  # an inline element whose text isn't read, and how many of its name are open

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append(Block(text, linked, any(opened[h] for h in _HEADINGS), inside > 0, boiler > _OPEN, article, inside))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not passed:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.strip())

    def close(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            if m["alone"] or m["out"] or m["raw"] and m["raw"].lower() not in ("script", "style"):
                parts.append(" ")
            continue
        tag, closing = m["tag"].lower(), bool(m["end"])
        if tag == "a":
            link = 0 if closing else 1
        if tag in _INLINE:
            if passed:
                depth += (tag == passed) * (-1 if closing else 1)
                passed = passed if depth else ""
            elif not closing and m["attrs"] and _boiler(tag, m["attrs"], True) > _OPEN:
                passed, depth = tag, 1
            continue
        if tag in ("br", "hr", "img", "input"):
            parts.append(" ")
            continue
        flush()
        passed = ""
        if tag not in _CONTAINERS:
            continue
        link = 0
        if closing:
            if opened[tag]:
                size = len(stack)
                while stack[size - 1][0] != tag:
                    size -= 1
                close(size - 1)
        else:
            if tag == "body" and opened["head"]:
                close(0)
            if stack and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS and tag in _HEADINGS):
                close(len(stack) - 1)  # paragraphs hold no other block
            if tag in _ITEMS and stack and stack[-1][4] >= 0:
                close(stack[-1][4])
            outer = stack[-1] if stack else ("", _OPEN, 0, 0, -1)
            level, inner, own = outer[1], outer[2], _boiler(tag, m["attrs"], bool(outer[2]))
            if tag in ("article", "main") and not inner:
                level = _OPEN if level <= (_HOLDER if tag == "main" or lift else _NAMED) else level
                own = _OPEN if lift and own < _FIRM else own
            level = max(level, own)
            if tag in ("article", "main") and not level and not inner:
                articles += 1
                inner = articles
            lists += tag in _LISTS
            if not m["attrs"].endswith("/"):
                item = len(stack) if tag in _ITEMS else -1 if tag in _LISTS else outer[4]
                stack.append((tag, level, inner, lists if tag in _LISTS else outer[3], item))
                opened[tag] += 1
        _, boiler, article, inside, _ = stack[-1] if stack else ("", _OPEN, 0, 0, -1)
    add(page[at:])
    flush()
    return blocks


def _is_prose(b: Block, has_article: bool) -> bool:
    """Prose in whatever language: long, hardly linked, in sentences or very long, and not boilerplate."""
    if b.boiler or has_article and not b.article or len(b.text) < SHORT // 2 or b.linked > FEW_LINKS * len(b.text) or b.text.startswith(("©", "(c) ")) and not b.article:
        return False
    long = len(b.text) + len(_WIDE.findall(b.text))
    return long >= 3 * SHORT or long >= SHORT and _SENTENCE.search(b.text) is not None


def weight(b: Block, has_article: bool, listed_links: float) -> int:
    """The block's evidence, added up; ``listed_links`` is the link density of its list."""
    long, links = len(b.text) >= SHORT, b.linked / len(b.text)
    found = {
        "dense": long and b.stop >= DENSE,
        "sparse": long and b.stop < SPARSE and not b.article and len(b.text) < 3 * SHORT,
        "linked": links > LINKED and (listed_links > LINKED if b.listed else not long or not b.article),
        "rights": b.text.startswith(("©", "(c) ")) and not b.article,
        "article": bool(b.article),
        "outside": has_article and not b.article,
        "boiler": b.boiler,
    }
    return sum(WEIGHTS[k] for k, holds in found.items() if holds)


def _label(evidence: int) -> str:
    return "good" if evidence >= CLEAR else "bad" if evidence <= -CLEAR else ""


def classify(blocks: list[Block]) -> None:
    """Pass one: good, bad, or undecided (empty).

    Where stop words find less than half of what reads as prose (other languages,
    technical texts), sentences count in their place.
    """
    has_article = any(b.article and not b.boiler for b in blocks)
    in_list: dict[int, list[int]] = {}
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        b.stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        sums = in_list.setdefault(b.list, [0, 0])
        sums[0] += b.linked
        sums[1] += len(b.text)
    evidence = [weight(b, has_article, in_list[b.list][0] / in_list[b.list][1]) for b in blocks]
    for b, e in zip(blocks, evidence, strict=True):
        b.label = _label(e)
    prose = [i for i, b in enumerate(blocks) if _is_prose(b, has_article)]
    if 2 * sum(len(blocks[i].text) for i in prose if blocks[i].label == "good") < sum(len(blocks[i].text) for i in prose):
        for i in prose:
            b = blocks[i]
            dense = len(b.text) >= SHORT and b.stop >= DENSE
            sparse = len(b.text) >= SHORT and b.stop < SPARSE and not b.article and len(b.text) < 3 * SHORT
            b.label = _label(evidence[i] + (0 if dense else WEIGHTS["prose"]) - (WEIGHTS["sparse"] if sparse else 0))


def resolve(blocks: list[Block]) -> None:
    """Pass two: undecided blocks take the label of the nearest decided neighbours.

    Where no block of the page is good, short ones have no neighbour to follow: those of
    them that are hardly links are the text. Within an article only the article's own blocks are neighbours (an advert in its
    midst is none), and where none of them is decided its blocks are good. Elsewhere the page's ends are bad. Of two
    neighbours as near, a heading follows the next, other blocks the good one if
    they hold a stop word.
    """
    if not any(b.label == "good" for b in blocks):
        for b in blocks:
            b.label = b.label or ("good" if b.article or b.linked <= FEW_LINKS * len(b.text) else "bad")
        return
    n = len(blocks)
    before: list[tuple[int, str]] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.article, (-1, "") if b.article else (-1, "bad")))
        if b.label and not (b.boiler and b.article):
            last[b.article] = (i, b.label)
    after: list[tuple[int, str]] = []
    last = {}
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        after.append(last.get(b.article, (n, "") if b.article else (n, "bad")))
        if b.label and not (b.boiler and b.article):
            last[b.article] = (i, b.label)
    after.reverse()
    for i, b in enumerate(blocks):
        if b.label:
            continue
        (p, left), (q, right) = before[i], after[i]
        if not left or not right or left == right:
            b.label = left or right or "good"
        elif i - p != q - i:
            b.label = left if i - p < q - i else right
        elif b.heading:
            b.label = right
        else:
            b.label = "good" if b.stop > 0 or b.article else "bad"


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by one space; nothing of it is cut."""
    text = ""
    for lift in (False, True):  # once more where names left nothing
        blocks = blocks_of(page or "", lift)
        classify(blocks)
        resolve(blocks)
        text = " ".join(b.text for b in blocks if b.label == "good")
        if text or not any(b.boiler for b in blocks):
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null and empty pages give an empty text.

    Pages are independent: no shuffle, one batch of pages in memory at a time. Other
    columns of ``pages`` are left out, repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
