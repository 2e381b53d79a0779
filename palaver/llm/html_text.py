"""Main text of web pages by a tree-structured graphical model.

A page is read into its tree of elements. Every element has a hidden label, main text or not. What is seen at the
element scores its label; potentials between parent and child, by the kind of the child, tie labels together. One pass
of sum-product messages up the tree and one down give each element's marginal, exactly. The weights are those of a
conditional random field trained by gradient ascent on labelled pages; the expected counts in the gradient come from
the same passes. Text is kept where its element's marginal is at least one half.

Passes run over all pages of a batch together, one depth at a time.

Defined cases: a null, empty or markup-only page has the empty text. Tags that do not nest are closed as browsers close
them, roughly; an unfinished tag is text. Repeated rows get equal texts. Nothing is cut off, however long or deep.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, utf8
from palaver.llm.labelled_pages import labelled_pages

FEATURES = 1 << 12
TRAINING_PAGES = 400
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>"
    r"|<(/?)([A-Za-z][^\s/<>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-main|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")

# Element kinds of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(f"</{name}[^a-zA-Z]", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
NEVER = frozenset("title textarea select option button datalist template svg canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article aside body div footer form header html main nav section td".split())
# A start tag of the first kind closes an open element of the second, up to a boundary of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "body": (("head",), ()), "tbody": (("thead", "tbody", "tfoot"), ("table",)),
}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "option", "optgroup", "legend", "summary"}


class Page:
    """Elements in document order, and the text pieces and block breaks between them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.attributes = ["#root"], [-1], [0], [""]
        self.pieces: list[tuple[int, str]] = []  # (element, text); element -1 breaks the block
        self._read(source)

    def _read(self, source: str) -> None:
        stack, open_tags, place = [0], {}, 0
        tags, parents, depths, attributes, pieces = self.tags, self.parents, self.depths, self.attributes, self.pieces

        def close(depth: int) -> None:
            while len(stack) > depth:
                name = tags[stack.pop()]
                open_tags[name] -= 1
                if name in BLOCK:
                    pieces.append((-1, ""))

        def up_to(names: tuple[str, ...], fence: tuple[str, ...]) -> None:
            if not any(open_tags.get(name) for name in names):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = tags[stack[depth]]
                if tag in names:
                    close(depth)
                    if len(names) == 1:
                        return
                elif tag in fence:
                    return

        while True:
            found = TOKEN.search(source, place)
            if found is None:
                break
            if found.start() > place:
                pieces.append((stack[-1], source[place:found.start()]))
            place = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name = name.lower()
            if found[1] or found[4]:
                if open_tags.get(name):
                    depth = len(stack) - 1
                    while tags[stack[depth]] != name:
                        depth -= 1
                    close(depth)
                elif name in BLOCK:
                    pieces.append((-1, ""))
                continue
            if name == "br":
                pieces.append((stack[-1], " "))
                continue
            if name in RAW and name not in ("textarea", "title"):
                end = RAW[name].search(source, place)
                place = end.start() if end else len(source)
                continue
            if name in CLOSES_P:
                up_to(("p",), ("td", "th", "button", "table", "object"))
            if name in CLOSES:
                up_to(*CLOSES[name])
            if name in BLOCK:
                pieces.append((-1, ""))
            if name in VOID:
                continue
            tags.append(name)
            parents.append(stack[-1])
            depths.append(len(stack))
            attributes.append(found[3] or found[6] or "")
            stack.append(len(tags) - 1)
            open_tags[name] = open_tags.get(name, 0) + 1
            if name in RAW:
                end = RAW[name].search(source, place)
                stop = end.start() if end else len(source)
                pieces.append((stack[-1], source[place:stop]))
                place = stop
        if place < len(source):
            pieces.append((stack[-1], source[place:]))

    def features(self) -> list[list[int]]:
        """Feature numbers of each element."""
        count = len(self.tags)
        own, whole, linked, stops = [0] * count, [0] * count, [0] * count, [0] * count
        for element, text in self.pieces:
            if element >= 0:
                own[element] += len(text.strip())
                stops[element] += text.count(".") + text.count(",")
        for number in range(count - 1, -1, -1):
            whole[number] += own[number]
            if self.tags[number] == "a":
                linked[number] = whole[number]
            if number:
                whole[self.parents[number]] += whole[number]
                linked[self.parents[number]] += linked[number]
        found = []
        for number, tag in enumerate(self.tags):
            words = named(self.attributes[number]) if self.attributes[number] else ()
            density = 4 * linked[number] // whole[number] if whole[number] else 5
            size = (own[number] > 0) + (own[number] > 25) + (own[number] > 100) + (own[number] > 300)
            found.append([*words, *shape_features(tag, size, density, min(stops[number], 3), bool(words))])
        return found

    def text(self, kept: list[bool]) -> str:
        """Blocks of the kept elements' texts, one line each."""
        blocks, block = [], []
        for element, text in self.pieces:
            if element < 0:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif kept[element]:
                block.append(text)
        blocks.append("".join(block))
        lines = (" ".join((references.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(line for line in lines if line)


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


@lru_cache(65_536)
def named(attributes: str) -> tuple[int, ...]:
    """Features of an element's classes, id and role, word by word."""
    words = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() != "data-main":
            value = "".join(values) or name
            words.update(part.lower() for part in NAME_PART.findall(value))
    return tuple(sorted(bucket("name " + word) for word in words))


@lru_cache(65_536)
def shape_features(tag: str, size: int, density: int, stops: int, has_name: bool) -> tuple[int, ...]:
    tag = tag if tag in BLOCK or tag in ("a", "b", "i", "em", "strong", "span", "#root") else "other"
    names = [f"tag {tag}", f"size {size}", f"links {density}", f"stops {stops}", f"{tag} links {density}", f"{tag} named {has_name}"]
    return tuple(bucket(name) for name in names)


def kind(tag: str) -> int:
    """Kind of a child for the potentials: inline, heading, section, or other block."""
    return 1 if tag in HEADING else 2 if tag in SECTION else 3 if tag in BLOCK else 0


class Forest:
    """All elements of some pages, with what the passes need."""

    def __init__(self, pages: list[Page]):
        self.starts = np.cumsum([0] + [len(page.tags) for page in pages])
        features = [own for page in pages for own in page.features()]
        self.element = np.repeat(np.arange(len(features)), [len(own) for own in features])
        self.feature = np.array([number for own in features for number in own], np.int64)
        shift = np.repeat(self.starts[:-1], np.diff(self.starts))
        self.parent = np.array([parent for page in pages for parent in page.parents], np.int64) + shift
        depth = np.array([depth for page in pages for depth in page.depths], np.int64)
        self.kind = np.array([kind(tag) for page in pages for tag in page.tags], np.int64)
        self.never = np.array([tag in NEVER for page in pages for tag in page.tags])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def marginals(self, unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of label 1 for each element, and of each (parent, child) pair of labels for each child."""
        score = np.zeros((len(self.parent), 2))
        score[:, 1] = np.bincount(self.element, unary[self.feature], len(self.parent))
        score[self.never, 1] = -30.0
        below, sent, belief = np.zeros_like(score), np.zeros_like(score), np.zeros_like(score)
        for level in self.levels[:0:-1]:
            inside, tie = score[level] + below[level], pairs[self.kind[level]]
            sent[level] = np.logaddexp(tie[:, :, 0] + inside[:, :1], tie[:, :, 1] + inside[:, 1:])
            np.add.at(below, self.parent[level], sent[level])
        belief[self.levels[0]] = score[self.levels[0]] + below[self.levels[0]]
        joint = np.zeros((len(score), 2, 2))
        for level in self.levels[1:]:
            inside, tie = score[level] + below[level], pairs[self.kind[level]]
            above = belief[self.parent[level]] - sent[level]
            joint[level] = above[:, :, None] + tie + inside[:, None, :]
            down = np.logaddexp(above[:, :1] + tie[:, 0], above[:, 1:] + tie[:, 1])
            belief[level] = inside + down
            belief[level] -= belief[level].max(1, keepdims=True)
        chance = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        children = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.array([], np.int64)
        shifted = np.exp(joint[children] - joint[children].max((1, 2), keepdims=True))
        joint[children] = shifted / shifted.sum((1, 2), keepdims=True)
        return chance, joint


def truth(page: Page) -> list[int]:
    """Labels of a labelled page, from the marks."""
    labels: list[int] = []
    for number, attributes in enumerate(page.attributes):
        mark = re.search('data-main="([01])"', attributes)
        labels.append(int(mark[1]) if mark else labels[page.parents[number]] if number else 0)
    return labels


@lru_cache(2)
def train(count: int = TRAINING_PAGES, steps: int = 160, ridge: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Weights and potentials fitted to labelled pages."""
    pages = [Page(source) for source in labelled_pages(count)]
    forest = Forest(pages)
    labels = np.array([label for page in pages for label in truth(page)])
    children = np.concatenate(forest.levels[1:])
    unary, pairs = np.zeros(FEATURES), np.zeros((4, 2, 2))
    seen_pairs = np.zeros_like(pairs)
    np.add.at(seen_pairs, (forest.kind[children], labels[forest.parent[children]], labels[children]), 1)
    seen = np.bincount(forest.feature, labels[forest.element] * 1.0, FEATURES)
    moments = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pairs), np.zeros_like(pairs)]
    for step in range(1, steps + 1):
        chance, joint = forest.marginals(unary, pairs)
        expected_pairs = np.zeros_like(pairs)
        np.add.at(expected_pairs, forest.kind[children], joint[children])
        expected = np.bincount(forest.feature, chance[forest.element], FEATURES)
        gradients = [(seen - expected) / count - ridge * unary, (seen_pairs - expected_pairs) / count - ridge * pairs]
        for number, (weights, gradient) in enumerate(zip((unary, pairs), gradients)):
            first, second = moments[2 * number], moments[2 * number + 1]
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            weights += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return unary, pairs


def main_texts(sources: list[str], unary: np.ndarray, pairs: np.ndarray) -> list[str]:
    pages = [Page(source) for source in sources]
    if not pages:
        return []
    forest = Forest(pages)
    kept = (forest.marginals(unary, pairs)[0] >= 0.5).tolist()
    return [page.text(kept[start:start + len(page.tags)]) for page, start in zip(pages, forest.starts.tolist())]


def extract(html: Column) -> Column:
    """The main text of a column of whole pages."""
    unary, pairs = train()

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            sources = [value.decode("utf-8", "replace") if value else "" for value in utf8(batch)]
            for start in range(0, len(sources), 256):
                found += main_texts(sources[start:start + 256], unary, pairs)
            yield pa.array(found, pa.string())

    return extracted(html)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns with ``text`` and ``n_chars`` appended."""
    found = add_struct(pages, F.struct(extract(F.col(html)).alias("text")), ["text"])
    return add_struct(found, F.struct(F.length("text").cast("long").alias("n_chars")), ["n_chars"])
