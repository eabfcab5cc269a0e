"""Main text of web pages.

A page becomes a flat list of text blocks. A decision tree, trained on the blocks of small labelled pages,
tells main text from the rest by the number of words and the link density of a block and of its
neighbours, and by one mark: what the elements around the block say of it, if they say anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read_table
from .html_samples import PAGES, articles

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
COPYRIGHT = re.compile(r"\s*(©|\(c\)|copyright\b)", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Elements that stand inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark math mfrac mi mn mo mrow ms msub msup msqrt mtext nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split())
#: Elements whose content is no text of the page, and those of them that hold no markup, so that a missing end takes the rest of the page. They do not end a line.
SKIPPED = frozenset("script style noscript template iframe object svg head title select textarea button audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
#: Elements whose nesting is followed; ends of others that are not open are passed over.
CONTAINERS = frozenset("html body nav header footer aside form article main section div ul ol dl table tbody thead tfoot tr td th li blockquote figure menu dialog details fieldset center".split())

# What is not the article, by element, role, and words of class and id. In the closed ones nothing counts as main, not even an article.
CLOSED = frozenset("nav footer aside menu dialog".split())
CLOSED_ROLES = frozenset("navigation complementary contentinfo dialog alertdialog menu menubar toolbar".split())
OTHER = frozenset("form fieldset".split())
OTHER_ROLES = frozenset("banner search alert form".split())
CLOSED_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter sidebar aside related recommended recommendations comment comments commentlist "
    "reply replies respond disqus teaser nav navbar navigation menu breadcrumb breadcrumbs toc".split()
)
OTHER_HINTS = frozenset(
    "notice notification alert popup modal overlay subscribe subscription signup footer header masthead share sharing social login search pagination pager copyright legal disclaimer toolbar tags banner topbar topnav bottombar skip".split()
)
MAIN_HINTS = frozenset("article content post entry story main text maincontent".split())
#: Inside an article a name counts as a whole: it tells something only if all its words are among these or the hints. Of the hints, a header is the article's own there, and the weak ones hold for few words or many links.
FILLERS = frozenset(
    "box list bar section area container wrapper wrap widget block links link form left right top bottom site page inner outer item items title heading buttons button posts articles stories body slot unit label thread count "
    "reader readers user users global primary secondary latest recent google inline mobile desktop wide small large first last row col column group panel card view zone holder feed letter policy message info icon icons".split()
)
OWN_HINTS = frozenset("header masthead".split())
WEAK_HINTS = frozenset("legal disclaimer copyright search share sharing social tags pagination pager footer toolbar".split())
WEAK, WEAK_WORDS, WEAK_LINKS = -0.5, 12, 0.3
#: Words after these in a name tell what stands beside the element, as in main-with-sidebar.
BESIDE = frozenset("with without has no".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark")


@dataclass
class Block:
    """`mark`: 1 inside what the page marks as main, -1 inside what it marks as something else, 0 without a mark. `named`: by an article or main element. `weak`: the number of the element whose name weighs little."""

    text: str
    words: int
    linked: int
    mark: float
    named: bool
    label: int | None
    weak: int = 0


@dataclass(frozen=True)
class Place:
    """An open container, with what it and those around it say."""

    name: str
    mark: float = 0
    closed: bool = False
    named: bool = False
    label: int | None = None
    weak: int = 0


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


def hint(name: str, named: bool) -> tuple[float, bool]:
    """What one name of a class or id says: mark, and whether it closes.

    The last telling word decides, but a word of the closed ones always counts. Inside an article (`named`)
    a name with a word of any other kind says nothing, as related-work or ad-free-reading.
    """
    words = [w for w in re.split(r"[^a-z]+", CAMEL.sub("-", name).lower()) if w]
    beside = next((i for i, w in enumerate(words) if w in BESIDE), len(words))
    words = words[:beside]
    if named:
        if not all(w in CLOSED_HINTS or w in OTHER_HINTS or w in MAIN_HINTS or w in FILLERS or len(w) == 1 for w in words):
            return 0, False
        words = [w for w in words if w not in OWN_HINTS]
    mark: float = 0
    for w in words:
        if w in CLOSED_HINTS:
            return -1, True
        mark = (WEAK if named and w in WEAK_HINTS else -1) if w in OTHER_HINTS else 1 if w in MAIN_HINTS else mark
    return mark, False


def hints(found: dict[str, str], named: bool) -> tuple[float, bool]:
    """What class and id say together; what is not main outweighs what is."""
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    said = [hint(n, named) for n in names]
    return (min((m for m, _ in said if m), default=0), any(c for _, c in said)) if said else (0, False)


def within(place: Place, tag: str, found: dict[str, str], number: int) -> Place:
    """The place inside an element, the page's `number`th, that opens in another."""
    label = 1 if "data-main" in found else 0 if "data-other" in found else place.label
    if place.closed:
        return Place(tag, -1, True, False, label)
    role = found.get("role", "").lower()
    if tag in ("article", "main") or role in ("main", "article"):
        return Place(tag, 1, False, True, label)
    if tag in CLOSED or role in CLOSED_ROLES:
        return Place(tag, -1, True, False, label)
    if tag in OTHER or role in OTHER_ROLES or (tag == "header" and not place.named):
        return Place(tag, -1, False, False, label)
    mark, closed = (0, False) if tag in ("html", "body") else hints(found, place.named)
    if mark == WEAK:
        return Place(tag, place.mark, False, True, label, place.weak or number)
    return Place(tag, mark or place.mark, closed, place.named and mark >= 0, label, place.weak)


def weighed(found: list[Block]) -> list[Block]:
    """Blocks of elements whose names weigh little: these are something else only with few words, or with many in links."""
    words: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for b in found:
        words[b.weak] += b.words
        linked[b.weak] += b.linked
    small = {n for n in words if n and (words[n] < WEAK_WORDS or linked[n] > WEAK_LINKS * words[n])}
    return [replace(b, mark=-1, named=False) if b.weak in small else b for b in found] if small else found


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order. Comments, scripts, styles and what is cut off inside a tag give none. Time grows with the page's length, whatever its markup."""
    page = page or ""
    out: list[Block] = []
    stack = [Place("")]
    open_names: Counter[str] = Counter()
    unended: set[str] = set()
    parts: list[str] = []
    linked, in_link = 0, False
    # what an element that is no container, such as a paragraph, says of its own block
    own: tuple[float, bool] = (0, False)
    number = 0

    def close() -> None:
        nonlocal parts, linked, own
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                place, words = stack[-1], text.count(" ") + 1
                mark = own[0] if own[0] == -1 or not place.mark else place.mark
                weak = place.weak or (number if own[0] == WEAK else 0)
                if mark == 0 and COPYRIGHT.match(text):
                    mark = -1
                out.append(Block(text, words, min(linked, words), -1 if place.closed else mark, place.named and mark > 0, place.label, weak))
        parts, linked, own = [], 0, (0, False)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else end]
        if text:
            text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.split())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        found = TAG.match(page, lt)
        if not found:
            if lt + 1 < end and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                stop = page.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                parts.append("<")
                at = lt + 1
            continue
        at = found.end()
        closing, name, rest = found[1] == "/", found[2].lower(), found[3]
        if name in SKIPPED:
            if not closing and not rest.endswith("/") and name not in unended:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = end
                else:
                    unended.add(name)
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        close()
        in_link = False
        if closing:
            if open_names[name]:
                while True:
                    gone = stack.pop().name
                    open_names[gone] -= 1
                    if gone == name:
                        break
            continue
        attrs = attributes(rest)
        number += 1
        if name in CONTAINERS:
            if rest.endswith("/"):
                continue
            if name == "li" and stack[-1].name == "li":
                open_names[stack.pop().name] -= 1
            stack.append(within(stack[-1], name, attrs, number))
            open_names[name] += 1
        else:
            own = hints(attrs, stack[-1].named)
            if "data-main" in attrs or "data-other" in attrs:
                # a labelled element that is no container labels what follows in its parent
                stack[-1] = replace(stack[-1], label=int("data-main" in attrs))
    close()
    return weighed(out)


def table(found: list[Block], length: float = 1.0) -> np.ndarray:
    """The features of a page's blocks, `length` times as long. Where an article or main element holds text, blocks without a mark are outside it."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.log1p([b.words * length for b in found])
    links = np.array([b.linked / b.words for b in found])
    before, after = (lambda x: np.concatenate([[0.0], x[:-1]])), (lambda x: np.concatenate([x[1:], [0.0]]))
    marks = np.array([b.mark for b in found], dtype=np.float64)
    if any(b.named for b in found):
        marks[marks == 0] = -1
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), marks])


@dataclass(frozen=True)
class Node:
    """A split (feature, value, branches) or, without branches, the share of main blocks."""

    share: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 3) -> Node:
    """A tree by Gini impurity; of equally good splits the first feature's lowest value."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            n = int(low.sum())
            if min(n, len(y) - n) >= least:
                p, q = y[low].mean(), y[~low].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(at), low)
    if best is None:
        return Node(share)
    _, f, at, low = best
    return Node(share, f, at, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def shares(node: Node, x: np.ndarray) -> np.ndarray:
    """The share of main blocks in the leaf of each row."""
    if node.low is None or node.high is None:
        return np.full(len(x), node.share)
    low = x[:, node.feature] <= node.at
    out = np.empty(len(x))
    out[low], out[~low] = shares(node.low, x[low]), shares(node.high, x[~low])
    return out


#: Every labelled page counts as it is, and with blocks of so many times the words.
LENGTHS = (1.0, 0.9, 0.95, 1.05, 1.1)


@cache
def tree() -> Node:
    """The tree trained on the labelled pages and on articles of all neighbourhoods. A leaf holds three blocks at least."""
    found = [blocks(p) for p in (*PAGES, *articles())]
    x = np.concatenate([table(b, n) for n in LENGTHS for b in found])
    y = np.array([-1 if b.label is None else b.label for _ in LENGTHS for page in found for b in page])
    return grow(x[y >= 0], y[y >= 0].astype(np.float64))


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page: its main blocks, joined by line feeds."""
    found = [blocks(p) for p in pages]
    x = np.concatenate([table(b) for b in found]) if found else np.zeros((0, len(FEATURES)))
    chosen, at, out = shares(tree(), x) >= 0.5, 0, []
    for page in found:
        out.append("\n".join(b.text for b, keep in zip(page, chosen[at : at + len(page)], strict=True) if keep))
        at += len(page)
    return out


@F.pandas_udf(StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        texts: list[str] = []
        held = batch.tolist()
        for start in range(0, len(held), 200):
            texts += main_texts(held[start : start + 200])
        yield pd.Series(texts, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html counts as empty; a page without main text has an empty one. Long pages are read whole.
    Repeated rows are extracted each; other columns, whatever their names, are not looked at. No rows give none.
    """
    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
