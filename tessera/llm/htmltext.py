"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words. Each word of a run scores the log-odds that text in its place is main text; each tag scores negative. One
linear scan finds the contiguous region with the highest sum. The region is the text, less what is closed up in it, cut into blocks at block elements.

All weights are learned from labelled pages (layouts.py: 240 whole pages made by a seeded generator, some 1,100,000 characters; other pages may be
given). The log-odds of a run come from a logistic regression over features of its place: the elements, class words, ids and roles that it lies in (apart for those
inside an article or main element), whether it is a link, how long its block is, how much of that is links, how it ends, and for short blocks outside of such elements their words.
There is no list of boilerplate names: a name counts as far as labelled pages use it on one side. The score of a tag is the log-odds of its
kind to stand inside the main text, -0.05 at the most.

The scan is nested: an element (but for inline ones) in which no stretch has a positive sum is closed up. It scores like one tag, however long it is, so that an aside or a
menu does not part the text around it. Of all else the region holds everything between its two ends, and what stands beyond other elements is not part of it unless it
outweighs the tags between.

References are decoded, white space inside a block becomes one space, blocks are joined by two line feeds.

Defined cases: null html is empty text; a page without a positive run is empty text; repeated rows are extracted each; ties go to the earliest region, and there to
the longest; an empty table gives an empty result; broken markup is read as far as it goes (unclosed comments and scripts run to the end; quotes count only where they
open an attribute's value); pages of any length are read whole (one page is in memory); other columns, of any name, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import layouts
from .common import spread

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|title)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: HTML elements that start and end a block, and those without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SECTION = frozenset("article main section body html".split())
_IMPLIED_END = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Inline elements, which are never closed up.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
_SHORT, _LEAST, _MOST, _PENALTY = 30, -6.0, -0.05, 0.1  # words of a short block; bounds of a tag's score; of the regression


class Run:
    """A tag (words 0) or a run of words with its place in the page; score: of the tag, or of one word."""

    __slots__ = ("kind", "at", "words", "text", "place", "features", "block", "inside", "score", "closed")

    def __init__(self, kind: str, at: int, text: str = "", words: int = 0, place: float = 0.0, features: frozenset = frozenset(), block: int = 0, inside: bool = False):
        self.kind, self.at, self.text, self.words, self.place, self.features, self.block, self.score = kind, at, text, words, place, features, block, 0.0
        self.inside, self.closed = inside, False


class Weights:
    """What labelled pages teach: log-odds by feature, score by kind of tag."""

    def __init__(self, features: dict[str, float], tags: dict[str, float], bias: float):
        self.features, self.tags, self.bias = features, tags, bias


def _names(name: str, attrs: str) -> list[str]:
    """Features of an element: its name, class words, id, role, whether it is hidden."""
    found = [name]
    if attrs and name not in ("body", "html"):
        for m in _ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden":
                found += ["hidden"] if key == "hidden" or value == "true" else []
            else:
                found += [f".{x}" for x in value.split()]
    return found


def runs(page: str, weights: Weights | None = None) -> list[Run]:
    """The page as tags and runs of words. With weights the place of each run is their sum over its elements; without, its features are kept."""
    out: list[Run] = []
    stack: list[tuple[str, list[str]]] = []
    active: Counter[str] = Counter()
    known = weights.features if weights else {}
    place, inside, block, at, bare = 0.0, 0, 0, 0, frozenset({"bare"})

    def text(start: int, end: int) -> None:
        if start < end:
            decoded = html.unescape(page[start:end])
            out.append(Run("", start, decoded, len(decoded.split()), place if stack else known.get("bare", 0.0), frozenset() if weights else frozenset(active) if stack else bare, block, inside > 0))

    def leave(count: int) -> None:
        nonlocal place, inside
        for _ in range(count):
            name, features = stack.pop()
            inside -= name in ("article", "main")
            for f in features:
                active[f] -= 1
                if not active[f]:
                    del active[f]
                    place -= known.get(f, 0.0)

    end, swallowed = page.rfind(">") + 1, False  # no tag ends later: none is looked for there
    for m in _TOKEN.finditer(page, 0, end):
        text(at, m.start())
        at = m.end()
        if at == end:
            swallowed = m[0].startswith("<!--") and not m[0].endswith("-->") or bool(m["raw"]) and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)
        if m["raw"]:
            out.append(Run("<" + m["raw"].lower(), m.start()))
            continue
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        block += name in BLOCKS
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(len(stack) - depth)
                    break
                if stack[depth][0] in _SECTION and name not in BLOCKS:
                    break
            out.append(Run("</" + name, m.start()))
            continue
        while stack and stack[-1][0] in _IMPLIED_END and name in _IMPLIED_END[stack[-1][0]]:
            leave(1)
        if name in BLOCKS:  # an open paragraph ends even under inline elements that were never closed
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    leave(len(stack) - depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        out.append(Run("<" + name, m.start()))
        if name not in VOID and not attrs.endswith("/"):
            features = [f"in {f}" if inside else f for f in _names(name, attrs)]
            for f in features:
                active[f] += 1
                if active[f] == 1:
                    place += known.get(f, 0.0)
            stack.append((name, features))
            inside += name in ("article", "main")
    if not swallowed:
        comment = page.find("<!--", at)
        text(at, comment if comment >= 0 else len(page))
    return out


def _of_block(block: list[Run]) -> list[str]:
    """Features of a block: length, share of links, end, words of short blocks."""
    said = " ".join(r.text for r in block)
    words = said.lower().split()
    linked, n = sum(r.words for r in block if r.block < 0), len(words)
    found = [f"n {min(5, n.bit_length())}", *[f"links {k}" for k in range(1, 5) if 4 * linked >= k * n], f"stop {said.rstrip()[-1:] in '.!?:;'}"]
    if n <= _SHORT and not block[0].inside:
        found += {f"w {w.strip('.,:;!?()')}" for w in words}
    return found


def blocks_of(sequence: list[Run]) -> Iterator[list[Run]]:
    """The runs of each block; a run in a link has a negative block number."""
    linked, last, block = 0, None, []
    for r in sequence:
        if r.kind == "<a":
            linked += 1
        elif r.kind == "</a":
            linked = max(0, linked - 1)
        elif not r.kind and r.words:
            if r.block != last and block:
                yield block
                block = []
            last = r.block
            if linked:
                r.block = -1
            block.append(r)
    if block:
        yield block


def learn(pages) -> Weights:
    """Weights from labelled pages: each a list of (markup, whether it is main text) in page order."""
    inside, outside = Counter(), Counter()
    examples: list[tuple[list[str], bool]] = []
    seen: Counter[str] = Counter()
    for page in pages:
        ends, labels = np.cumsum([len(m) for m, _ in page]), [main for _, main in page]
        sequence = runs("".join(m for m, _ in page))

        def main(r: Run) -> bool:
            return labels[min(int(np.searchsorted(ends, r.at, side="right")), len(labels) - 1)]

        met = set()
        for r in sequence:
            if r.kind:
                (inside if main(r) else outside)[r.kind] += 1
        for block in blocks_of(sequence):
            own = _of_block(block)
            for r in block:
                features = [*own, *r.features]
                examples.append((features, main(r)))
                met.update(features)
        seen.update(met)
    names = sorted(f for f, n in seen.items() if n >= (8 if f.startswith("w ") else 4))
    at = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(examples), len(names) + 1)), np.array([m for _, m in examples], float)
    x[:, -1] = 1
    for row, (features, _) in zip(x, examples, strict=True):
        row[[at[f] for f in features if f in at]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(8):  # Newton's method with a quadratic penalty
        q = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + _PENALTY * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - q) - _PENALTY * w)
    tags = {}
    for kind in inside.keys() | outside.keys():
        tags[kind] = min(_MOST, max(_LEAST, math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))))
    return Weights(dict(zip(names, w.tolist(), strict=False)), tags, float(w[-1]))


@cache
def default_weights() -> Weights:
    return learn(layouts.labelled_pages())


def scored(page: str, weights: Weights) -> list[Run]:
    """The page's runs with their scores; elements without a positive run are closed up to one tag."""
    sequence = runs(page, weights)
    for block in blocks_of(sequence):
        own = weights.bias + sum(weights.features.get(f, 0.0) for f in _of_block(block))
        for r in block:
            r.score = max(-6.0, min(6.0, own + r.place))
    good = np.cumsum([0, *[not r.kind and r.words > 0 and r.score > 0 for r in sequence]])
    for r in sequence:
        if r.kind:
            r.score = weights.tags.get(r.kind, -0.5)
    stack: list[int] = []
    closed = np.zeros(len(sequence) + 1, np.int64)
    for i, r in enumerate(sequence):
        if r.kind.startswith("</"):
            for depth in range(len(stack) - 1, -1, -1):
                if sequence[stack[depth]].kind[1:] == r.kind[2:]:
                    start = stack[depth]
                    del stack[depth:]
                    if r.kind[2:] not in INLINE and good[start] == good[i + 1]:
                        closed[start + 1] += 1
                        closed[i + 1] -= 1
                    break
        elif r.kind and r.kind[1:] not in VOID:
            stack.append(i)
    for r, inner in zip(sequence, np.cumsum(closed[:-1]).tolist(), strict=True):
        if inner:
            r.closed, r.score = True, 0.0
    return sequence


def region(sequence: list[Run]) -> tuple[int, int]:
    """Start and end of the contiguous runs with the highest sum of scores; the earliest longest one; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, r in enumerate(sequence):
        total += r.score * r.words if not r.kind else r.score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: Weights | None = None, scan=region) -> str:
    if not page:
        return ""
    sequence = scored(page, weights or default_weights())
    start, end = scan(sequence)
    blocks: list[str] = []
    run: list[str] = []
    for r in sequence[start:end]:
        if not r.kind:
            run.append(" " if r.closed else r.text)
        elif r.kind.lstrip("</") in BLOCKS:
            blocks.append(" ".join("".join(run).split()))
            run = []
        elif r.kind == "<br":
            run.append(" ")
    blocks.append(" ".join("".join(run).split()))
    return "\n\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, training=None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    weights = learn(training) if training else default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string"))
    return spread(plain).mapInArrow(run, "page_id long, url string, text string, n_chars long")
