"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks, the runs of text between block tags. Each block has features from its ancestors' tags, classes and ids and from its text.
The field has two states, main text and other, with weights for features in each state and for pairs of successive states; it is trained on labelled
pages and decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import columns
from postmill.llm.textbatch import slices

FEATURES = 1 << 14
#: Tags that end a block where they begin or end.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is inside these is never text of the page.
SILENT = frozenset("script style noscript template svg math object canvas iframe head title textarea select button datalist".split())
#: Elements in which a tag with a slash at its end is one without content.
FOREIGN = ("svg", "math")
#: An open tag that a new one of the second kind ends.
ENDED_BY = {
    "p": BLOCK - {"br", "body", "html", "head"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"},
}
#: By a new tag, the open ones that it ends.
ENDS = {tag: [held for held, by in ENDED_BY.items() if tag in by] for tag in frozenset().union(*ENDED_BY.values())}
#: Open tags over which a new tag ends nothing, but for body.
WALLS = frozenset("table ul ol dl div section article main aside nav form body".split())
#: What may stand in a head. Any other tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_LANDMARK = frozenset("article main nav aside header footer form".split())
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    ancestors: tuple[tuple[str, str], ...]  # (tag, class and id), outermost first
    linked: int = 0  # characters inside links


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.walls: list[int] = []  # places of the open WALLS
        self.silent = self.links = self.linked = 0
        self.parts: list[str] = []
        self.blocks: list[Block] = []

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, tuple(x for x in self.open if x[0] not in ("html", "body")), self.linked))
        self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        self.places[tag].pop()
        if tag in WALLS:
            self.walls.pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"

    def _close(self, place: int) -> None:
        """End the element of that place and all within it. Every element is ended once, so this costs no more than the tags that opened them."""
        while len(self.open) > place:
            self._pop()

    def _end_head(self) -> None:
        """End a head that has no other open element within it."""
        if self.open and self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_block()
        if tag not in IN_HEAD:
            self._end_head()
        ended = max((self.places[held][-1] for held in ENDS.get(tag, ()) if self.places.get(held)), default=-1)
        if ended >= 0 and (tag == "body" or not self.walls or ended > self.walls[-1]):
            self._close(ended)
        if tag in VOID:
            return
        found = dict(attrs)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in WALLS:
            self.walls.append(len(self.open))
        self.open.append((tag, " ".join(str(found[k]) for k in ("class", "id", "role") if found.get(k)).lower()))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in FOREIGN or any(self.places.get(x) for x in FOREIGN):
            return
        # In HTML the slash means nothing.
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_block()
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def handle_data(self, data):
        if self.silent and data.strip(" \t\n\f\r"):
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space folded, without scripts, styles, comments and markup."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_block()
    return reader.blocks


def _bin(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % FEATURES


def block_features(found: list[Block]) -> list[list[int]]:
    """Feature bins of each block of a page."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for i, block in enumerate(found):
        bins = seen.get(block.ancestors)
        if bins is None:
            names = {"any"}
            for depth, (tag, marks) in enumerate(reversed(block.ancestors)):
                names.add(f"in {tag}")
                if depth < 2:
                    names.add(f"up{depth} {tag}")
                for part in _PART.findall(marks):
                    names.update((f"mark {part}", f"{tag} mark {part}"))
            near = next(((tag, marks) for tag, marks in reversed(block.ancestors) if marks or tag in _LANDMARK), ("none", ""))
            names.add(f"near {near[0]}")
            names.update(f"near mark {part}" for part in _PART.findall(near[1]))
            bins = seen[block.ancestors] = sorted(map(_bin, names))
        n = len(block.text)
        share = block.linked / n
        words = block.text.count(" ") + 1
        text = (
            f"words {min(words.bit_length(), 8)}", "linked " + ("none" if share == 0 else "some" if share < 0.5 else "most"),
            f"stop {block.text[-1] in '.!?:;…'}", f"copyright {'©' in block.text}", f"place {'first' if i == 0 else 'last' if i == len(found) - 1 else 'inner'}",
        )
        out.append(bins + [_bin("text " + t) for t in text])
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features by state (1: main text), of pairs of successive states, and of the first state."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, features: list[list[int]]) -> np.ndarray:
        """The most probable states of a page's blocks."""
        if not features:
            return np.zeros(0, bool)
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        scores = np.add.reduceat(self.emit[np.concatenate([np.array(f) for f in features])], np.cumsum(sizes) - sizes, axis=0).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        state, out = b > a, []
        for step in reversed(back):
            out.append(state)
            state = step[int(state)]
        return np.array([*out, state][::-1], bool)


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = 120, penalty: float = 2e-4) -> Field:
    """Maximum likelihood weights for labelled pages (features and labels of their blocks), by Adam over gradients of the forward-backward algorithm."""
    pages = [p for p in pages if p[1]]
    emit, move, start = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    if not pages:
        return Field(emit, move, start)
    n, longest = len(pages), max(len(y) for _, y in pages)
    bins = np.array([b for f, _ in pages for own in f for b in own])
    sizes = np.array([len(own) for f, _ in pages for own in f])
    firsts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    page = np.repeat(np.arange(n), [len(y) for _, y in pages])
    place = np.concatenate([np.arange(len(y)) for _, y in pages])
    label = np.array([y for _, ys in pages for y in ys])
    lengths = np.bincount(page, minlength=n)
    true_move, true_start = np.zeros((2, 2)), np.zeros(2)
    inner = place > 0
    np.add.at(true_move, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    np.add.at(true_start, label[place == 0], 1)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move, start)]
    weights = [emit, move, start]
    for step in range(1, steps + 1):
        emit, move, start = weights
        scores = np.zeros((n, longest, 2))
        scores[page, place] = np.add.reduceat(emit[bins], firsts, axis=0)
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        forward[0] = start + scores[:, 0]
        for t in range(1, longest):
            forward[t] = scores[:, t] + np.logaddexp(forward[t - 1][:, 0:1] + move[0], forward[t - 1][:, 1:2] + move[1])
        for t in range(longest - 2, -1, -1):
            after = scores[:, t + 1] + backward[t + 1]
            own = np.logaddexp(move[:, 0] + after[:, 0:1], move[:, 1] + after[:, 1:2])
            backward[t] = np.where((t + 1 < lengths)[:, None], own, 0)
        log_z = np.logaddexp(*forward[lengths - 1, np.arange(n)].T)
        marginal = np.exp(forward[place, page] + backward[place, page] - log_z[page][:, None])
        gap = marginal.copy()
        gap[np.arange(len(label)), label] -= 1
        slope_emit = np.stack([np.bincount(bins, weights=gap[owner, s], minlength=FEATURES) for s in (0, 1)], axis=1) / len(label)
        p, t = page[inner], place[inner]
        joint = np.exp(forward[t - 1, p][:, :, None] + move + (scores[p, t] + backward[t, p])[:, None, :] - log_z[p][:, None, None])
        slope_move = (joint.sum(axis=0) - true_move) / len(label)
        slope_start = (marginal[place == 0].sum(axis=0) - true_start) / len(label)
        for k, slope in enumerate((slope_emit, slope_move, slope_start)):
            slope = slope + penalty * weights[k]
            mean, square = state[k]
            mean[:] = 0.9 * mean + 0.1 * slope
            square[:] = 0.999 * square + 0.001 * slope**2
            weights[k] = weights[k] - 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(*weights)


# Labelled pages: layouts below are filled with blocks of the given pages, so every label is known from how the page was made.

#: Wrappers of main text and of everything else: tags with class or id, outermost first. Fixed values.
_MAIN = [
    "article", "main>article", "main", "main#content", "div.content", "div#main>div.post", "div.article-body", "div.entry-content", "section.story", "div.page>article.post>div.body", "div#content>section",
    "div.wrapper>main>div.text", "article>section", "article>div.content", "div.container>div.row>article",
]
_OTHER = [
    "nav>ul", "nav", "header", "header>div.top", "header>nav", "footer", "footer>div", "div.footer", "div#footer", "aside", "aside.sidebar", "div.sidebar", "div#sidebar>ul", "div.ad", "div.ads", "div.advert",
    "div.advertisement", "div.banner", "div.promo", "div.sponsored", "div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert", "div.consent", "form", "form.search", "form.newsletter", "div.subscribe>form",
    "div.comments", "section.comments", "section#comments>div.comment", "ol.comment-list", "div.comment", "div#disqus_thread", "div.menu", "ul.menu", "div.breadcrumb", "ul.breadcrumbs", "div.related", "div.share", "ul.social",
    "div.pagination", "div.tags", "div.login", "div.popup", "div.modal", "section.reviews", "div.nav", "div.header", "div#header",
]
#: These also stand within the main wrapper on some pages.
_INNER = ["aside", "div.ad", "nav", "section.comments", "div.comments", "div.related", "div.share", "footer", "form", "div.notice", "header>nav", "div.advert", "aside.sidebar", "div.comment"]
_MAIN_LEAF = ["p", "p", "p", "p", "h1", "h2", "h3", "li", "blockquote", "pre", "div", "td"]
_OTHER_LEAF = ["p", "li", "div", "span", "a", "h2", "h3", "label", "button-text", "small"]


def _path(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((m[1], m[3] or "") for m in (re.match(r"(\w+)([.#]?)([\w-]*)", part) for part in text.split(">")))


def labelled_page(texts: list[str], seed: str) -> tuple[list[Block], list[int]]:
    """A page made of given texts in random wrappers, with a label for each block. Text is dealt to either kind alike, so it is mostly the place in the
    page that tells them apart, as on pages whose advert is a sentence."""
    rng = Random(seed)
    found: list[tuple[Block, int]] = []

    def add(path: tuple, leaf: str, text: str, label: int) -> None:
        linked = len(text) if leaf == "a" or (not label and rng.random() < 0.3) else 0
        wrap = {"a": (("a", ""),), "td": (("table", ""), ("tr", ""), ("td", "")), "li": (("ul", ""), ("li", "")), "button-text": (("span", ""),)}.get(leaf, ((leaf, ""),))
        found.append((Block(text, path + wrap, linked), label))

    def other(within: tuple = ()) -> None:
        path = within + _path(rng.choice(_INNER + _OTHER if within else _OTHER))
        short = rng.random() < 0.6
        for _ in range(rng.choice((1, 1, 2, 3)) if within else rng.randint(1, 5)):
            text = rng.choice(texts)
            add(path, rng.choice(_OTHER_LEAF), " ".join(text.split(" ")[: rng.randint(1, 4)]) if short else text, 0)

    for _ in range(rng.randint(0, 3)):
        other()
    main = _path(rng.choice(_MAIN))
    if rng.random() < 0.2:
        add(main + _path("header"), "h1", rng.choice(texts), 1)
    for i in range(rng.randint(1, 12)):
        leaf = "h1" if i == 0 and rng.random() < 0.6 else rng.choice(_MAIN_LEAF)
        for _ in range(rng.randint(1, 5) if leaf in ("li", "td") else 1):
            text = rng.choice(texts)
            add(main, leaf, " ".join(text.split(" ")[: rng.randint(1, 4)]) if rng.random() < (0.4 if leaf in ("li", "td", "h2", "h3") else 0.1) else text, 1)
        if rng.random() < 0.2:
            other(main)
    if rng.random() < 0.3:
        other(main)
    for _ in range(rng.randint(0, 3)):
        other()
    return [b for b, _ in found], [y for _, y in found]


def train(pages: DataFrame, rows: int = 300, layouts: int = 6, most_blocks: int = 2_000) -> Field:
    """A field fitted on labelled pages: at most ``rows`` of the given pages (those whose ids have the least hashes) as they are, where the elements
    nav, header, footer, aside, form and article label the blocks, and ``layouts`` made pages from the texts of each. Of pages of one id that with the least
    hash of its HTML stands for all; null is an id. Pages are whole: one of over ``most_blocks`` blocks teaches nothing. The bounds are parameters; the driver
    receives feature bins of at most rows * (1 + layouts) pages. Without any page the field is trained on made pages of fixed text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(html)
                out += _examples(found, str(page_id), layouts) if len(found) <= most_blocks else []
            yield pa.record_batch([pa.array([f for f, _ in out], pa.list_(pa.list_(pa.int32()))), pa.array([y for _, y in out], pa.list_(pa.int32()))], ["features", "labels"])

    chosen = columns(pages, "page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows).select(F.col("page_id").alias("_chosen"))
    rows_ = columns(pages, "page_id", "html")
    sample = rows_.join(F.broadcast(chosen), rows_["page_id"].eqNullSafe(chosen["_chosen"])).select("page_id", "html")
    # Tasks keep one page an id before the shuffle.
    sample = sample.groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    found = sample.mapInArrow(run, "features array<array<int>>, labels array<int>").collect()
    pages_ = sorted(([list(f) for f in r["features"]], list(r["labels"])) for r in found)
    fixed = [t for k in range(40) for t in _examples([Block(t, ()) for t in ("One line of text.", "Words without an end", "A longer line of text that has some more words in it.")], f"fixed {k}", layouts)]
    return fit(pages_ + fixed)


def _examples(found: list[Block], seed: str, layouts: int) -> list[tuple[list[list[int]], list[int]]]:
    if not found:
        return []
    texts = [b.text for b in found]
    pages = [labelled_page(texts, f"{seed} {k}") for k in range(layouts)]
    tags = [{tag for tag, _ in b.ancestors} for b in found]
    if any("article" in t for t in tags):
        other = ({"nav", "header", "footer", "aside", "form"}, re.compile(r"\b(ad|ads|comment|comments|notice|sidebar)\b"))
        pages.append((found, [int("article" in t and not t & other[0] and not any(other[1].search(m) for _, m in b.ancestors)) for t, b in zip(tags, found)]))
    return [(block_features(b), y) for b, y in pages if b]


def main_text(html: str | None, field: Field) -> str:
    found = blocks(html)
    return " ".join(b.text for b, own in zip(found, field.decode(block_features(found))) if own)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``; n_chars counts code points.

    Whole pages are read. A null or empty page, and one without a block of main text, has an empty text. Repeated rows and null ids and urls come
    back as they are; extra columns are left out; an empty table gives no rows.
    """
    rows = columns(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, field) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
