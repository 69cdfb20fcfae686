"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at its block-level tags. A block has its word count and link
density, those of the blocks before and after it, whether it is a heading or a list item and ends
like a sentence, in which of HTML's own sections it stands (an article, or a navigation, aside,
form, header or footer), and what names its containers have. A decision tree, grown here on the
labelled blocks of ``labelled_pages``, says which blocks are main text. Those pages are put together
by a rule from the written parts below: some with HTML's sections, some with telling class names,
some with neither and some with misleading names, so that counts and densities of a block and its
neighbours have to decide where the rest says nothing.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, narrowed, slices

TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)(?:>|[^>]*>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Attributes of elements that aren't shown.
UNSEEN = re.compile(r"(?<![-\w])hidden(?![-\w])(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.I)
#: HTML's elements whose text isn't running text (the first two are raw: they end at their
#: end tag or with the page), block-level elements, containers and sections.
RAW = frozenset("script style".split())
HIDDEN = RAW | frozenset("noscript template svg iframe object canvas audio video textarea select button title".split())
NESTED = frozenset("template svg object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption head".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header li main menu nav ol search section table ul td".split())
ASIDES = frozenset("nav aside footer form menu dialog search fieldset".split())
#: Words in names of containers: those of furniture and comments, and those of articles. A name with both says nothing.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup social share sharing related recommended trending popular breadcrumb breadcrumbs toolbar widget login search form pagination paywall comment comments commentlist replies respond disqus".split()
)
ARTICLE_WORDS = frozenset("article post entry content story main articlebody".split())
ENDS = tuple(".!?…:;。！？")
CLOSERS = "\"'”’»)]*"
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "paragraph", "sentence", "section", "named")
MOST_WORDS = 80


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    heading: int = 0  #: 6 for h1 to 1 for h6
    item: bool = False
    paragraph: bool = False
    section: int = 0  #: 1 in an article or main part, -1 in another section, 0 in none
    named: int = 0  #: 1 if the nearest telling name is an article's, -1 if it is another's
    unseen: bool = False
    text: str = ""
    words: int = 0
    density: float = 0.0


@dataclass
class Around:
    """An open container."""

    name: str = ""
    section: int = 0
    named: int = 0
    unseen: bool = False


def said(attributes: str) -> int:
    """What an element's names say: 1 an article, -1 something else, 0 nothing or both."""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        words.update(re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()))
    return bool(words & ARTICLE_WORDS) - bool(words & ASIDE_WORDS)


def section_of(name: str, around: int) -> int:
    """In which kind of section the text of an element stands."""
    if name in ("article", "main"):
        return 1 if around >= 0 else -1
    if name in ASIDES or name == "header" and around < 1:
        return -1
    return around


class Ends:
    """Where hidden elements end. What it looks up stays, so that a page is searched a few times at most."""

    def __init__(self, page: str):
        self.page, self.last = page, {}

    def after(self, name: str, at: int) -> int | None:
        """The place behind the element's end tag; None if there is none."""
        tag = re.compile(rf"<(/?){name}(?![^\s/>])[^>]*>?", re.I)
        if name not in self.last:
            self.last[name] = max((m.end() for m in tag.finditer(self.page) if m[1]), default=-1)
        if at >= self.last[name]:
            return None
        depth = 1
        for m in tag.finditer(self.page, at):
            if not m[1] and name not in NESTED:
                if name in RAW:
                    continue
                return None  # another one begins before this one ends
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if depth == 0:
                return m.end()
        return self.last[name]


def blocks_of(page: str | None) -> list[Block]:
    """The page's flat text blocks in order, without empty and unseen ones."""
    page = page or ""
    out: list[Block] = []
    stack = [Around()]
    opened: Counter = Counter()
    ends = Ends(page)
    now, link, at, n = Block(), False, 0, len(page)
    skipping = False  # in a hidden element without an end tag: until the next block

    def add(text: str) -> None:
        if text and not skipping:
            text = html.unescape(text) if "&" in text else text
            now.parts.append(text)
            if link:
                now.linked.append(text)

    def close() -> Block:
        text = " ".join("".join(now.parts).split())
        if text and not now.unseen:
            now.text, now.words = text, max(text.count(" ") + 1, len(text) // 10)
            now.density = len("".join("".join(now.linked).split())) / len(text.replace(" ", ""))
            out.append(now)
        top = stack[-1]
        return Block(section=top.section, named=top.named, unseen=top.unseen, item=any(x.name == "li" for x in stack[-2:]))

    def push(name: str, attributes: str) -> None:
        top = stack[-1]
        stack.append(Around(name, section_of(name, top.section), (said(attributes) if attributes else 0) or top.named, top.unseen or bool(attributes and UNSEEN.search(attributes))))
        opened[name] += 1

    def pop() -> str:
        opened[stack[-1].name] -= 1
        return stack.pop().name

    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        skipping &= name not in BLOCKS and name not in CONTAINERS
        if m["end"]:
            if name == "a":
                link = False
            elif name in CONTAINERS:
                if opened[name]:
                    now.item |= name == "li"
                    while pop() != name:
                        pass
                    link = False
                now = close()
            elif name in BLOCKS:
                now = close()
            elif name in ("td", "th"):
                add(" ")
        elif name in HIDDEN:
            if name == "svg" and m[0].endswith("/>"):
                continue
            end = ends.after(name, at)
            if end is not None:
                at = end
            elif name in RAW:
                at = n
            else:
                skipping = True
        elif name == "a":
            link = True
        elif name in ("br", "td", "th"):
            add(" ")
        elif name in BLOCKS or name in CONTAINERS:
            if name == "li" and stack[-1].name == "li":
                pop()  # its end tag may be left out
            if name in CONTAINERS:
                push(name, m["attributes"])
                link = False
            now = close()
            now.heading = 7 - int(name[1]) if name[0] == "h" and name[1:].isdigit() else 0
            now.paragraph = name in ("p", "pre", "blockquote")
            if name not in CONTAINERS and m["attributes"]:
                now.named = said(m["attributes"]) or now.named
                now.unseen |= bool(UNSEEN.search(m["attributes"]))
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, in the order of NAMES. Before the first and after the last block there are
    0 words and no links. On a page that has articles, what stands in no section is outside of them."""
    words = np.array([0, *(min(b.words, MOST_WORDS) for b in blocks), 0], float)
    links = np.array([0, *(b.density for b in blocks), 0], float)
    outside = -1 if any(b.section > 0 for b in blocks) else 0
    flags = [(b.heading, b.item, b.paragraph, b.text.rstrip(CLOSERS).endswith(ENDS), b.section or outside, b.named) for b in blocks]
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], np.array(flags, float).reshape(-1, 6)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 4) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most, above) or a leaf's share of 1.

    Cuts lie between neighbours of at most 64 quantiles of a feature.
    """
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, 65), method="nearest")) for v in x.T]
    cuts = [(c[:-1] + c[1:]) / 2 for c in cuts]
    bins = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])

    def node(rows: np.ndarray, depth: int) -> tuple | float:
        n, ones = len(rows), y[rows].sum()
        if depth == 0 or ones in (0, n) or n < 2 * least:
            return float(ones / n)
        best = (1e-9, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            left = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
            hits = np.cumsum(np.bincount(bins[rows, f], y[rows], minlength=len(c) + 1))[:-1]
            ok = (left >= least) & (n - left >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = hits**2 / left + (ones - hits) ** 2 / (n - left) - ones**2 / n
            gain = np.where(ok, gain, 0) / n
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            return float(ones / n)
        f, k = best[1]
        low = bins[rows, f] <= k
        return f, float(cuts[f][k]), node(rows[low], depth - 1), node(rows[~low], depth - 1)

    return node(np.arange(len(y)), depth)


def is_main(tree: tuple | float, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


#: Words that sentences of the labelled pages are made of.
WORDS = (
    "the river a stood so high that no ferryman would cross it though he was offered twice his fare and dry coat for trouble council will vote on plan in March after public hearing they had bread little cheese "
    "two apples left still one day's walk to next village mill burnt down 1841 built again of stone by miller's sons prices rose within week we have waited long enough she said closed book who knows why"
).split()
LINES = ("Take water", "Bread and a good map", "Two eggs", "The north gate", "A pound of flour", "Warm clothes for the night")
HEADS = ("River closed", "A long walk", "Bread at home", "Minutes of the council", "What the miller's sons built", "The way back")
#: Short furniture without links, links, and longer furniture.
SHORT = (
    "Posted on Tuesday", "By a reader", "3 min read", "Share", "Advertisement", "Sponsored", "Print", "12 comments", "Sign in to reply", "Was this helpful", "Yes", "Save for later", "Accept", "Reject all",
    "All rights reserved", "Version 2.1", "Updated 4 May", "Tags", "Photo: the archive", "Page 1 of 3", "Newsletter", "Your name", "Message", "Vote", "Conditions apply", "Follow us", "Loading", "Most read",
)
LINKS = ("Home", "News", "Sport", "Contact", "Imprint", "Help", "Privacy", "Older minutes of the council and its committees", "The best ten walks in the hills, with maps", "Read more", "Next", "Shop", "Log in", "Why bread is dear this year")
REMARKS = ("Nice one, thanks.", "First!", "Same here.", "I was there!")
#: Lengths of sentences in words, and of paragraphs in sentences.
SENTENCE_WORDS, PARAGRAPH_SENTENCES = (1, 2, 3, 4, 6, 8, 10, 12, 14, 17, 20, 25), (1, 1, 1, 1, 2, 2, 3, 5, 8)
STYLES = ("sections", "names", "both", "neither", "misleading")


def labelled_page(r: random.Random, style: str) -> str:
    """A page whose main blocks begin with *."""
    named = lambda tag, words: f"<div class='{r.choice(words.split())}'>" if style in ("names", "both") else f"<{tag}>" if style == "sections" else "<div>"
    ended = lambda tag: f"</{tag}>" if style == "sections" else "</div>"
    link = lambda: f"<a href=/x>{r.choice([r.choice(LINKS), r.choice(LINKS), sentence(), r.choice(WORDS)])}</a>"
    small = lambda: f"<{(t := 'p' if r.random() < 0.1 and style not in ('sections', 'both') else 'div')}>{r.choice([r.choice(SHORT), r.choice(SHORT), link(), r.choice(SHORT) + ' ' + link()])}</{t}>"
    mark = lambda: r.choice([".", ".", ".", ".", "?", ".”"])
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.choice(SENTENCE_WORDS))).capitalize() + mark()
    prose = lambda: " ".join(sentence() for _ in range(r.choice(PARAGRAPH_SENTENCES)))
    head = lambda: r.choice([r.choice(HEADS), sentence(), sentence().rstrip(".”?")])
    note = lambda: r.choice(["", "© 2020 ", "We use cookies. ", "Buy two, get one free. "]) + " ".join(r.choice(WORDS) for _ in range(r.choice([3, 4, 5, 6, 7, 9, 12]))).capitalize() + mark()

    def furniture(tag: str, words: str, inner: str) -> str:
        return named(tag, words) + inner + ended(tag)

    def menu() -> str:
        some = [link() for _ in range(r.randrange(2, 7))]
        shape = r.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>" if shape == 0 else f"<p>{' | '.join(some)}</p>" if shape == 1 else "".join(f"<div>{x}</div>" for x in some)

    def article() -> str:
        out = [f"<h1>*{head()}</h1>"] if r.random() < 0.55 else []
        out += [small() for _ in range(r.choice([0, 0, 1, 2]))]
        for _ in range(r.randrange(2, 12)):
            kind = r.random()
            if kind < 0.72:
                text = prose()
                if r.random() < 0.15:
                    text = f"See <a href=/q>the list</a> for more. {text}"
                if r.random() < 0.15:  # a row of a table, or a cut line
                    text = r.choice([" | ".join(text.split()) + r.choice(["", " |"]), text.rstrip(".”?"), text.rstrip(".”?"), text + r.choice(["##", "%%", " *"])])
                out.append(f"<p>*{text}</p>" if r.random() < 0.8 else f"<div>*{text}</div>")
            elif kind < 0.8:
                out.append(f"<h2>*{head()}</h2><p>*{prose()}</p>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>*{r.choice([r.choice(LINES), r.choice(LINES) + '.', sentence()])}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
            elif style in ("names", "both") and r.random() < 0.7:
                tag, own = r.choice(["p", "div", "h2", "h3"]), r.choice(["cookie-notice", "ad-1", "share", "newsletter signup", "related", "comments-title"])
                out.append(f"<{tag} class='{own}'>{r.choice([note(), sentence(), r.choice(SHORT), link()])}</{tag}>")
            else:
                out.append(small())
        if style in ("names", "both") and r.random() < 0.2:
            out.append("<div id=comments><article>" + "".join(f"<p>{prose()}</p>" for _ in range(r.randrange(1, 4))) + "</article></div>")
        return "".join(out + [small() for _ in range(r.choice([0, 0, 1, 2]))])

    body = article()
    if style in ("sections", "both"):
        body = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(body)
    elif style == "names":
        body = f"<div class='{r.choice(['post', 'entry-content', 'article-body', 'story'])}'>{body}</div>"
    elif style == "misleading":
        body = f"<div class='{r.choice(['content alert', 'post-related-content', 'sidebar-page', 'ad-free menu', 'c-12 widget'])}'>{body}</div>"
    else:
        body = f"<div>{body}</div>" if r.random() < 0.7 else body
    before = ([furniture("nav", "menu navbar", menu())] if r.random() < 0.75 else []) + ([furniture("header", "site-header", r.choice([note(), " ".join(r.choice(WORDS) for _ in range(r.choice([2, 3, 4, 5, 6, 7]))), r.choice(SHORT)]))] if r.random() < 0.25 else []) + ([furniture("aside", "ad banner cookie-notice", f"<p>{note()}</p>" if r.random() < 0.5 else note())] if r.random() < 0.4 else [])
    after = []
    if r.random() < 0.5:
        after.append(furniture("aside", "related popular", f"<h3>{r.choice(SHORT)}</h3>" + menu()))
    if r.random() < 0.3:
        after.append(furniture("aside", "sidebar widget", f"<h3>{r.choice(SHORT)}</h3><p>{note()}</p>"))
    if r.random() < 0.35:
        who = lambda: f"<div>{r.choice(['Anna', 'Old Tom', 'B. Reader'])}, {r.randrange(1, 28)} May</div>"
        remarks = "".join(f"{who()}<div>{r.choice([r.choice(REMARKS), sentence(), sentence() + chr(32) + sentence()])}</div><div><a href=/r>Reply</a></div>" for _ in range(r.randrange(1, 4)))
        after.append(("<section class='comments'>" if style in ("names", "both", "sections") else "<div>") + remarks + ("</section>" if style in ("names", "both", "sections") else "</div>"))
    if r.random() < 0.65:
        after.append(furniture("footer", "footer page-footer post-footer", r.choice([f"<p>{note()}</p>", menu(), r.choice(SHORT), f"{r.choice(SHORT)} {link()}"])))
    r.shuffle(after)
    return "<html><body>" + "".join(before) + body + "".join(after) + "</body></html>"


PAGES_OF_A_STYLE = 300


def labelled_pages(seed: int = 1) -> list[str]:
    """The same pages at every time and place."""
    r = random.Random(seed)
    return [labelled_page(r, style) for _ in range(PAGES_OF_A_STYLE) for style in STYLES]


def labelled_table(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main) of the pages' blocks."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        y += [b.text.startswith("*") for b in blocks]
        x.append(features(blocks))
    return np.concatenate(x), np.array(y, float)


_TREE: list = []


def the_tree() -> tuple | float:
    """The tree, grown once on the driver: the table is small and fixed."""
    if not _TREE:
        _TREE.append(grow(*labelled_table(labelled_pages())))
    return _TREE[0]


def main_text(page: str | None, tree: tuple | float | None = None) -> str:
    """The text of the page's main blocks, one on each line; empty if there are none."""
    blocks = blocks_of(page)
    tree = the_tree() if tree is None else tree
    return "\n".join(b.text for b, row in zip(blocks, features(blocks)) if is_main(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty html gives an empty text; pages of any length are read whole, in time that grows
    with their length. Repeated rows and ids stay repeated, null ids and urls stay null, an empty table
    stays empty, other columns are ignored.
    """
    pages = narrowed(pages, "page_id", "url", "html")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    tree = the_tree()  # a hundred nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h.as_py(), tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages, run, f"{kinds}, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
