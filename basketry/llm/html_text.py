"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, runs of text between block elements. Each block has features of its ancestors (tags,
words of their class, id and role) and of its text. A two-state chain, main text or not, is trained on labelled pages
by the gradient of its log-likelihood; Viterbi decoding then labels the blocks of each page together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import whole
from basketry.llm.html_training import labelled_pages

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_UNSEEN = re.compile(
    r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.IGNORECASE
)
_WORDS = re.compile(r"[A-Za-z]+(?:(?<=[a-z])(?=[A-Z]))?")

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title textarea select option iframe object svg canvas audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends an open element of these kinds, unless one of the others lies between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# Words that tell notices, adverts, menus, comments and forms from articles.
CUES = frozenset(
    "advert advertisement sponsored promoted cookie cookies consent privacy terms copyright rights reserved subscribe "
    "newsletter signup login register sign share tweet follow comment comments reply replies menu home about contact "
    "search related recommended popular trending download app click here email password username submit accept "
    "policy settings previous next page skip read more tags categories archive posted sponsor".split()
)

#: A cue holds for a block that has it once in so many of all its words; up to this length once is enough.
CUE_WORDS = 60


# Elements that divide a page; the nearest one around a block says more than those farther out.
SECTIONS = frozenset("article section aside nav header footer main form figure table ul ol dl blockquote li".split())
_PLAIN = frozenset("html body div span".split())


class Element:
    """An open element. ``added``: the features it adds to those of its ancestors, which lie with these alone."""

    __slots__ = ("tag", "names", "parent", "added", "near", "section", "at")

    def __init__(self, tag: str, names: frozenset[str], parent: Element | None, held: Counter, at: int) -> None:
        self.tag, self.names, self.parent, self.at = tag, names, parent, at
        added = [f"name {n}" for n in names]
        if tag not in _PLAIN:
            added.append(f"in {tag}")
        if tag == "article" and held["in article"]:
            added.append("article in article")
        self.added = [f for f in sorted(added) if not held[f]]
        self.near = names or (parent.near if parent else frozenset())
        self.section = tag if tag in SECTIONS else parent.section if parent else ""


@dataclass(frozen=True)
class Block:
    text: str
    element: Element | None
    link_chars: int

    @property
    def tags(self) -> tuple[str, ...]:
        """The tags around the block, the outermost first."""
        found, element = [], self.element
        while element:
            found.append(element.tag)
            element = element.parent
        return tuple(reversed(found))


def _names(attributes: str) -> frozenset[str]:
    found = " ".join("".join(groups) for groups in _NAMES.findall(attributes))
    names = {w.lower() for w in _WORDS.findall(found)} if found else set()
    if "idden" in attributes or "none" in attributes or "IDDEN" in attributes or "NONE" in attributes:
        if _UNSEEN.search(attributes):
            names.add("unseen")
    return frozenset(names)


class _Open:
    """The open elements. What it holds is found, added and removed without a walk through the ancestors."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.held: Counter = Counter()
        self.count = 0

    def push(self, tag: str, names: frozenset[str]) -> None:
        element = Element(tag, names, self.stack[-1] if self.stack else None, self.held, self.count)
        self.count += 1
        self.held.update(element.added)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(element)

    def close(self, kinds: Iterable[str], fence: Iterable[str] = ()) -> None:
        """Close the nearest open element of these kinds, and all in it, unless a fence lies between."""
        nearest = max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)
        if nearest < 0 or any(self.places[f][-1] > nearest for f in fence if self.places.get(f)):
            return
        while len(self.stack) > nearest:
            element = self.stack.pop()
            self.held.subtract(element.added)
            self.places[element.tag].pop()


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order: references decoded, white space made single spaces, none empty."""
    blocks: list[Block] = []
    opened = _Open()
    pieces: list[tuple[str, bool]] = []

    def flush() -> None:
        if not pieces:
            return
        text = "".join(p for p, _ in pieces)
        text = " ".join((unescape(text) if "&" in text else text).split())
        if text:
            linked = sum(len(p) for p, link in pieces if link)
            blocks.append(Block(text, opened.stack[-1] if opened.stack else None, linked))
        pieces.clear()

    links, at, end = 0, 0, len(html)
    while at < end:
        match = _TAG.search(html, at)
        piece = html[at : match.start()] if match else html[at:]
        if piece:
            pieces.append((piece, links > 0))
        if not match:
            break
        at = match.end()
        slash, name, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                links = 0
            if name in BLOCKS:
                flush()
            opened.close((name,))
        elif name == "br":
            pieces.append((" ", False))
        elif name in HIDDEN:
            # A slash closes foreign elements alone; on others it means nothing.
            if name != "svg" or not attributes.endswith("/"):
                ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = ends.end() if ends else end
            pieces.append((" ", False))
        else:
            if name in BLOCKS:
                flush()
                if name in IMPLIED_ENDS:
                    opened.close(*IMPLIED_ENDS[name])
                elif name not in ("html", "head", "body"):
                    opened.close(("p",), ("table", "button"))
                if name in ("body", "article", "main"):
                    links = 0
            if name == "a":
                links = 1
            if name not in VOID:
                names = _names(attributes)
                if name in BLOCKS or names:
                    opened.push(name, names)
    flush()
    return blocks


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


def own_features(blocks: list[Block]) -> list[list[str]]:
    """The names of the features of each block besides those that its elements add."""
    found = []
    for at, block in enumerate(blocks):
        words = block.text.split()
        counts = Counter(w for w in (x.strip(".,:;!?()©&").lower() for x in words) if w in CUES)
        cues = {w for w, n in counts.items() if n * CUE_WORDS >= len(words)}
        element = block.element
        found.append(
            [
                f"leaf {element.tag if element else ''}",
                f"section {element.section if element else ''}",
                *(f"near {n}" for n in sorted(element.near if element else ())),
                *(f"cue {c}" for c in sorted(cues)),
                f"words {_step(len(words), (2, 4, 8, 15, 30, 60))}",
                f"links {_step(block.link_chars / max(len(block.text), 1), (0.05, 0.3, 0.7))}",
                f"stop {block.text[-1] in '.!?…。”»'}",
                f"says {block.text[-1] == ':' and len(words) < 6}",
                f"commas {_step(block.text.count(','), (1, 3))}",
                f"cues {_step(len(cues), (1, 2, 4))}",
                f"mark {'©' in block.text}",
                f"first {at == 0}",
                f"last {at == len(blocks) - 1}",
            ]
        )
    return found


def block_features(blocks: list[Block]) -> list[list[str]]:
    """The names of the features that hold for each block."""
    found = own_features(blocks)
    for names, block in zip(found, blocks, strict=True):
        element = block.element
        while element:
            names += element.added
            element = element.parent
    return found


@dataclass(frozen=True)
class Chain:
    """Weights for the state main text (the other state has none), and scores of ``moves[from][to]``, 1 being main."""

    weights: dict[str, float]
    moves: list[list[float]]

    def decode(self, features: list[list[str]]) -> list[bool]:
        """Viterbi: which blocks are main text on the most likely path."""
        return self._best([sum(self.weights.get(n, 0.0) for n in names) for names in features])

    def label(self, blocks: list[Block]) -> list[bool]:
        """:meth:`decode` of the blocks' features; what elements add is summed once for each of them."""
        weights, sums = self.weights, {}

        def around(element: Element | None) -> float:
            path = []
            while element and element.at not in sums:
                path.append(element)
                element = element.parent
            total = sums[element.at] if element else 0.0
            for inner in reversed(path):
                total = sums[inner.at] = total + sum(weights.get(f, 0.0) for f in inner.added)
            return total

        own = own_features(blocks)
        return self._best([around(b.element) + sum(weights.get(n, 0.0) for n in names) for b, names in zip(blocks, own, strict=True)])

    def _best(self, scores: list[float]) -> list[bool]:
        moves = self.moves
        other = main = 0.0
        back: list[tuple[bool, bool]] = []
        for at, emitted in enumerate(scores):
            if at:
                to_other, to_main = main + moves[1][0] > other + moves[0][0], main + moves[1][1] > other + moves[0][1]
                back.append((to_other, to_main))
                other, main = (
                    (main + moves[1][0]) if to_other else (other + moves[0][0]),
                    ((main + moves[1][1]) if to_main else (other + moves[0][1])) + emitted,
                )
            else:
                main = emitted
        if not scores:
            return []
        path = [main > other]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train_chain(pages: list[tuple[list[list[str]], list[bool]]], steps: int = 250, rate: float = 0.1, decay: float = 0.3) -> Chain:
    """Maximise the penalised conditional log-likelihood of labelled pages by Adam on its exact gradient.

    All pages run forward and backward together, padded to the longest.
    """
    names = sorted({n for features, _ in pages for block in features for n in block})
    at = {n: i for i, n in enumerate(names)}
    count, longest = len(pages), max((len(labels) for _, labels in pages), default=0)
    page, position, feature = (
        np.array(x, dtype=np.int64)
        for x in zip(*((p, t, at[n]) for p, (fs, _) in enumerate(pages) for t, block in enumerate(fs) for n in block), strict=True)
    )
    cell = page * longest + position
    there, truth = np.zeros((count, longest), bool), np.zeros((count, longest), int)
    for p, (_, labels) in enumerate(pages):
        there[p, : len(labels)], truth[p, : len(labels)] = True, labels
    observed = np.zeros((2, 2))
    both = there[:, 1:]
    np.add.at(observed, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    weights = np.zeros(len(names) + 4)
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        emitted = np.zeros((count, longest, 2))
        emitted[:, :, 1] = np.bincount(cell, weights[feature], count * longest).reshape(count, longest)
        moves = weights[-4:].reshape(2, 2)
        ahead, behind = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        ahead[:, 0] = emitted[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + emitted[:, t]
        for t in range(longest - 2, -1, -1):
            after = (behind[:, t + 1] + emitted[:, t + 1])[:, None, :] + moves
            behind[:, t] = np.where(there[:, t + 1, None], np.logaddexp(after[:, :, 0], after[:, :, 1]), 0)
        total = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)[:, None, None]
        chance = np.exp(ahead + behind - total)[:, :, 1] * there
        pair = ahead[:, :-1, :, None] + moves + (behind + emitted)[:, 1:, None, :] - total[..., None]
        expected = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum((0, 1))
        slope = -decay * weights
        slope[:-4] += np.bincount(feature, (truth - chance).ravel()[cell], len(names))
        slope[-4:] += (observed - expected).ravel()
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Chain({n: float(w) for n, w in zip(names, weights, strict=False)}, weights[-4:].reshape(2, 2).tolist())


@cache
def default_chain() -> Chain:
    """The chain trained, once in a process, on the labelled pages of ``html_training``, a fixed number of them."""
    pages = []
    for html, labels in labelled_pages():
        blocks = leaf_blocks(html)
        pages.append((block_features(blocks), [labels[b.text] for b in blocks]))
    return train_chain(pages)


def main_text(html: str, chain: Chain) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, main in zip(blocks, chain.label(blocks), strict=True) if main)


def extract_text(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars``.

    The text is that of the main blocks, in page order, one to a line. A null or empty page, or one without main
    text, has the empty text. Null ids and urls, repeated rows and empty tables pass through; other columns are not
    read. Pages are independent and read whole, where they lie.
    """
    chain = chain or default_chain()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(html, chain) for html in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
