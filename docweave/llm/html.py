"""Main text of web pages: flat text blocks, judged by a decision tree over their words, links and neighbours."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no text, elements that end a block, elements without an end tag.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that close an open one of their own kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
# Elements and names that tell a page's frame or its readers' words from its article.
FRAME_TAGS = frozenset("nav header footer aside form fieldset button menu dialog label".split())
FRAME_NAMES = re.compile(
    r"ads?|advert(s|isements?|ising|orial)?|banners?|sponsor(s|ed|ship)?|promos?|promotions?|nav|navbar|navigation|menu(s|bar)?|breadcrumbs?"
    r"|header|masthead|footer|side(bar)?|widgets?|cookies?|consent|notices?|alerts?|popups?|modal|subscribe|subscription|newsletters?"
    r"|signup|login|search|share|sharing|social|related|recommend(ed|ations?)?|comments?|respond|responses?|replies|disqus|copyright"
    r"|legal|toolbar|pagination|pager|tags?"
)
# Words that may stand beside those in a name of the frame; with any other word a name is no name of the frame.
NEUTRAL_NAMES = re.compile(
    r"\d*|area|bar|block|box|btn|buttons?|container|content|cta|fixed|form|group|holder|icons?|inner|items?|left|links?|list|main|media|mobile"
    r"|outer|page|panel|primary|right|row|secondary|section|site|slot|small|sticky|sub|text|thread|top|bottom|unit|wrap(per)?|global|local"
)
BODY_NAMES = re.compile(r"(^|[-_ ])(article\w*|content|entry\w*|post\w*|story\w*|main\w*|body\w*)([-_ ]|$)")
WHOLE = frozenset(("html", "body", "main", "article"))
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

# Controls that are part of the sentence where they stand inside one of these, and a block elsewhere.
CONTROLS = frozenset(("button", "label"))
SENTENCES = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())

# Quotes hold a value behind an equals sign only.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<empty>svg|math)(?=[\s/])(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+(?<=/)>"
    r"|<(?P<hidden>" + "|".join(HIDDEN) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.S | re.I,
)
# One attribute with its value; names are only looked for after the attribute before has ended.
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

FEATURES = ("in_frame", "in_article", "in_body", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")


def names_frame(name: str) -> bool:
    """Whether every word of a class or id is one of the frame's or says nothing, and at least one is the frame's."""
    words = re.split("[-_ ]+", name)
    frame = [bool(FRAME_NAMES.fullmatch(w)) for w in words]
    return any(frame) and all(f or NEUTRAL_NAMES.fullmatch(w) for f, w in zip(frame, words, strict=True))


def _marks(tag: str, rest: str) -> tuple[bool, bool, bool, bool]:
    """(frame, article, body, hidden) of an element by its name, class, id and role."""
    frame, article, body, hidden = tag in FRAME_TAGS, tag in ("article", "main"), False, False
    if "=" in rest or "hidden" in rest.lower():
        for name, value in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names = value.split() if name == "class" else [value]
                # Names of a whole page tell what it holds somewhere, not what it is.
                frame = frame or tag not in WHOLE and any(map(names_frame, names))
                body = body or any(BODY_NAMES.search(x) for x in names)
            elif name == "role":
                frame = frame or value in FRAME_ROLES
                article = article or value in ("article", "main")
            elif name in ("hidden", "aria-hidden"):
                hidden = hidden or (name == "hidden" and value != "false") or value == "true"
    return frame, article, body, hidden


def blocks_of(page: str) -> list[dict]:
    """The flat text blocks of a page in order, with what their place tells: text, words in it and in its links.

    Tags that don't end a block part nothing, but for <br>, which is white space.  Comments, scripts and other content
    without text go.  Unclosed and stray tags are borne: an end tag closes what is open inside its element.  Buttons and
    labels inside a sentence belong to it.
    """
    blocks: list[dict] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, tuple]] = []
    opened: Counter[str] = Counter()
    sentences = 0
    marks = (False, False, False, False)
    heading, links, at = False, 0, 0

    def flush():
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if text and not marks[3]:
            linked = " ".join(entities.unescape("".join(p for p, is_link in parts if is_link)).split())
            words = len(text.split())
            blocks.append(
                {"text": text, "in_frame": marks[0], "in_article": marks[1], "in_body": marks[2], "heading": heading,
                 "words": words, "links": min(1.0, len(linked.split()) / words)}
            )
        parts.clear()

    def add(text):
        if text:
            parts.append((text, links > 0))

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["hidden"] or m["empty"]:
                add(" ") if (m["hidden"] or m["empty"]).lower() not in ("script", "style", "title") else None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CONTROLS and sentences:
            continue
        if tag in BLOCKS:
            flush()
        if m["close"]:
            if opened[tag]:
                while True:
                    t, marks = stack.pop()
                    opened[t] -= 1
                    links -= t == "a"
                    sentences -= t in SENTENCES
                    if t == tag:
                        break
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                marks = stack.pop()[1]
                opened[tag] -= 1
                sentences -= tag in SENTENCES
            own = _marks(tag, m["rest"])
            stack.append((tag, marks))
            opened[tag] += 1
            sentences += tag in SENTENCES
            # An article inside the frame belongs to it, and so does a frame inside an article.
            marks = tuple(a or b for a, b in zip(marks, own, strict=True))
            links += tag == "a"
        heading = bool(re.fullmatch("h[1-6]", stack[-1][0])) if stack else False
    add(page[at:])
    flush()
    return blocks


def features(blocks: list[dict]) -> np.ndarray:
    """A row for each block: its place, its word count and link density, and those of the blocks before and after it."""
    rows = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        rows[i, :6] = b["in_frame"], b["in_article"], b["in_body"], b["heading"], b["words"], b["links"]
        if i:
            rows[i, 6:8] = blocks[i - 1]["words"], blocks[i - 1]["links"]
        if i + 1 < len(blocks):
            rows[i, 8:] = blocks[i + 1]["words"], blocks[i + 1]["links"]
    return rows


class DecisionTree:
    """A binary tree that splits rows at a threshold of one feature, grown by Gini impurity."""

    def __init__(self, depth: int = 8, least: int = 1):
        self.depth, self.least, self.nodes = depth, least, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.nodes = []
        self._grow(x, y.astype(float), 0)
        return self

    def _grow(self, x, y, depth) -> int:
        number = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.mean()) >= 0.5))
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return number
        best = (1e-9, None)
        whole = len(y) * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                right = x[:, f] > cut
                a, b = y[~right], y[right]
                if min(len(a), len(b)) >= self.least:
                    gain = whole - len(a) * a.mean() * (1 - a.mean()) - len(b) * b.mean() * (1 - b.mean())
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, float(cut)))
        if best[1]:
            f, cut = best[1]
            right = x[:, f] > cut
            low, high = self._grow(x[~right], y[~right], depth + 1), self._grow(x[right], y[right], depth + 1)
            self.nodes[number] = (f, cut, low, high, self.nodes[number][4])
        return number

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for i, row in enumerate(x):
            node = self.nodes[0]
            while node[0] >= 0:
                node = self.nodes[node[3] if row[node[0]] > node[1] else node[2]]
            out[i] = node[4]
        return out


_S = "A short line."
_L = "One sentence follows another here, and the paragraph goes on for quite a while so that it reads as running text."
_N = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
# Labelled pages: each block of text stands after a mark, + for main text and - for the rest.
LABELLED = (
    f"<title>T</title><nav>{_N}</nav><div class='ad'>-{_S}</div><article><h1>+{_S}</h1><p>+{_L}</p><p>+{_S}</p><p>+{_L}</p></article><footer>-{_S}</footer>",
    f"<nav>{_N}</nav><div class='ad'>-{_L}</div><article><h1>+{_S}</h1><p>+Of.</p><p>+{_S}</p></article><footer>-{_L}</footer>",
    f"<header><h1>-{_S}</h1>{_N}</header><main><h1>+{_S}</h1><p>+{_L}</p><p>+<a href='/x'>{_S}</a></p><ul><li>+{_S}</li><li>+{_L}</li></ul></main><aside><h2>-{_S}</h2><p>-{_L}</p></aside><footer><p>-{_L}</p></footer>",
    f"<header>-{_S}</header><main><article><h2>+{_S}</h2><p>+{_L}</p><blockquote>+{_L}</blockquote><form><p>-{_S}</p><p>-{_L}</p></form></article><div class='comments'><h3>-{_S}</h3><p>-{_L}</p><p>-{_S}</p></div></main><footer>-{_S}</footer>",
    f"<div id='menu'>{_N}</div><div class='content'><h1>+{_S}</h1><p>+{_L}</p><p>+{_L}</p><p>+{_S}</p></div><div id='sidebar'><h3>-{_S}</h3><p>-{_L}</p></div><div id='footer'>-{_S}</div>",
    f"<div class='cookie-notice'>-{_L}</div><div id='nav'>{_N}</div><div class='post-body'><p>+{_S}</p><p>+{_L}</p></div><section class='comment-list'><p>-{_L}</p></section><div class='related'>{_N}</div>",
    f"<div>{_N}</div><div><h1>+{_S}</h1><p>+{_L}</p><p>+{_L}</p><p>+{_L}</p></div><div>{_N}</div><div><p>-{_S}</p></div>",
    f"<p><a href='/'>-Home</a> | <a href='/n'>News</a></p><h1>+{_S}</h1><p>+{_L}</p><p>+{_L}</p><p><a href='/i'>-Imprint</a></p>",
    f"<table><tr><td>-<a href='/a'>One</a></td><td>-<a href='/b'>Two</a></td></tr></table><div><p>+{_L}</p><p>+{_L}</p></div><div class='newsletter'><p>-{_L}</p></div>",
    f"<article><p>+{_L}</p><div class='share'>-{_S}</div><p>+{_S}</p><div class='advert'>-{_L}</div><p>+{_L}</p><section id='comments'><article><p>-{_L}</p></article></section></article>",
    f"<nav>{_N}</nav><article><h1>+{_S}</h1><p>+{_L}</p><p>+Of.</p></article>",
    f"<div class='ad'>-{_S}</div><article><p>+{_S}</p></article>",
    f"<nav>{_N}</nav><main><p>+{_L}</p><p>+{_S}</p></main>",
    f"<p>+{_L}</p>",
    f"<div><h1>+{_S}</h1><p>+{_L}</p><p>+{_L}</p></div>",
    f"<p><a href='/'>-Start</a> | <a href='/n'>News</a></p><h2>+{_S}</h2><p>+{_L}</p><p>+{_L}</p><p><a href='/i'>-Imprint</a></p>",
    f"<article><p>+{_S} <a href='/x'>A title of another page</a></p><p>+{_L}</p></article>",
    f"<main><p>+<a href='/x'>The long title of another page of this site</a></p><p>+{_L}</p><p>+{_S}</p></main>",
    f"<main><p>+{_L}</p><p>+Or <a href='/x'>A title of another page</a></p><p>+{_S}</p><p>+<a href='/x'>Another title</a></p><p>+{_L}</p></main>",
    f"<article><h1>+<a href='/x'>{_S}</a></h1><p>+<a href='/x'>{_L}</a> {_L}</p><p>+{_L} {_L}</p><p>+{_S} <a href='/y'>{_S}</a></p></article>",
    "<nav>-Home</nav><article><p>+<a href='/x'>Read</a></p><p>+<a href='/x'>Two words</a></p><p>+<a href='/x'>Of.</a></p></article>",
    "<main><ul><li>+<a href='/x'>One</a></li><li>+<a href='/x'>Two</a></li><li>+<a href='/y'>Three more words</a></li></ul></main>",
    "<div><a href='/x'>-Home</a></div><p><a href='/x'>-Three more words</a></p><p><a href='/x'>-A list of all pages</a></p><p>-Of.</p>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; a block of links only is no main text."""
    x, y = [], []
    for page in LABELLED:
        blocks = blocks_of(page)
        for b in blocks:
            y.append(b["text"].startswith("+"))
            b["text"] = b["text"].lstrip("+-")
        x.append(features(blocks))
    return np.concatenate(x), np.array(y)


def train_tree() -> DecisionTree:
    return DecisionTree().fit(*labelled_blocks())


def main_text(page: str, tree: DecisionTree) -> str:
    """The blocks of the page that the tree takes for main text, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(b["text"] for b, keep in zip(blocks, tree.predict(features(blocks)), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null page is empty, and so is the text of a page without blocks.

    Pages are read whole, however long.  Repeated rows give repeated rows, an empty table gives none, a null id or url stays
    null, and other columns are not read.
    """
    tree = train_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
