"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text between block elements, with the open elements above them. Each block has
features of its ancestors (tags, words of class and id) and of its text (length, link share, signs). The field has two labels,
boilerplate and main; it is trained by maximum likelihood (forward-backward, Adam) on the labelled pages of
`labelled_pages` and decoded by Viterbi.

Null html is an empty page; a page without main blocks gives an empty text. Unclosed elements are closed where HTML
closes them, a tag cut off by the end of the page is dropped, references are decoded, comments and the content
of script, style, svg and similar elements are no text. What HTML does not parse (RAW) runs to its end tag or, as in HTML, to the
end of the page. A hidden element ends at its own end tag or with the element around it, svg also at the next block; one
that is never closed hides nothing. The head needs no rule: all its elements are raw or empty.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed values of HTML: elements whose content is not parsed, elements whose content is not shown as text, elements that form
#: blocks, elements without content.
RAW = "script style title textarea iframe".split()
HIDDEN = "noscript template select svg audio video canvas".split()
BLOCKS = ("html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
          "td th caption form fieldset blockquote pre figure figcaption address details summary dialog menu hr button label "
          "option center legend").split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(RAW) + r")(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^<>]*\Z|<", re.S | re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TAGS = "nav header footer aside form article main section ul ol li table p h1 h2 h3 blockquote pre figure button label address dialog".split()
#: Word beginnings in class, id and role, by kind of element.
KINDS = {
    "advert": "ad ads advert sponsor promo banner commercial".split(), "comment": "comment reply disqus discussion respond".split(),
    "menu": "menu nav breadcrumb pagination pager toolbar tabs sitemap skip".split(), "side": "sidebar side aside widget related recommend popular trending".split(),
    "head": "header masthead topbar logo branding".split(), "foot": "footer foot copyright legal colophon".split(),
    "notice": "cookie consent notice alert popup modal overlay gdpr privacy newsletter subscribe signup login".split(),
    "share": "share social follow tags meta byline".split(), "content": "content article post entry main body story text".split()}


@dataclass
class Block:
    """Text of a leaf block with the tags and names of its open elements and the characters inside links."""

    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order, white space inside each turned into one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(t for t, _ in text)).split())
        if joined:
            linked = sum(len(t.strip()) for t, inside in text if inside)
            out.append(Block(joined, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), linked))
        text.clear()

    at, page = 0, page or ""
    hidden = False
    last: dict[str, int] = {}
    for token in TOKEN.finditer(page):
        if token.start() > at and not hidden:
            text.append((page[at:token.start()], links > 0))
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            if token[0] == "<" and not hidden:
                text.append(("&lt;", links > 0))
            continue
        if name in _HIDDEN:
            if token[2]:
                _nest(stack, name, True, "")
            elif not (name == "svg" and token[4].endswith("/")):
                if name not in last:
                    last[name] = max((m.start() for m in re.finditer(f"</{name}(?=[\\s>/])", page, re.I)), default=-1)
                if last[name] > at:
                    stack.append((name, ()))
            hidden = any(t in _HIDDEN for t, _ in stack)
        elif hidden:
            if name in _BLOCKS:
                inner, opened = _hidden_nest(stack, name, bool(token[2]), token[4])
                hidden = any(t in _HIDDEN for t, _ in inner)
                if not hidden:
                    stack[:] = opened
                    flush()
                    links = 0
                stack[:] = inner
        elif name == "br":
            text.append((" ", False))
        elif name == "a":
            links = 0 if token[2] else 1
        elif name in _BLOCKS:
            flush()
            links = 0
            _nest(stack, name, bool(token[2]), token[4])
    if at < len(page) and not hidden:
        text.append((page[at:], links > 0))
    flush()
    return out


_BLOCKS, _HIDDEN = frozenset(BLOCKS), frozenset(HIDDEN)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _nest(stack: list, name: str, closing: bool, attributes: str) -> None:
    """Opens or closes a block element; what HTML closes by itself goes first."""
    if closing:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                break
        return
    if stack and stack[-1][0] == "p":
        stack.pop()
    ends = _CLOSES.get(name, ())
    if ends and stack and stack[-1][0] in ends:
        stack.pop()
    if name not in VOID:
        found = " ".join(next(g for g in m.groups() if g is not None) for m in NAMED.finditer(attributes)) if "=" in attributes else ""
        stack.append((name, tuple(found.lower().split())))


def _hidden_nest(stack: list, name: str, closing: bool, attributes: str) -> tuple[list, list]:
    """The stack after a block tag inside a hidden element, and the open elements around that one."""
    first = next(i for i, (t, _) in enumerate(stack) if t in _HIDDEN)
    inner = list(stack)
    if not closing and inner[-1][0] == "svg":  # a block ends svg
        while inner[-1:] and inner[-1][0] == "svg":
            inner.pop()
    _nest(inner, name, closing, attributes)
    return inner, stack[:first]


def _kinds(names: tuple[str, ...]) -> set[str]:
    words = [w for n in names for w in re.split(r"[^a-z]+", n) if w]
    return {kind for kind, starts in KINDS.items() for s in starts
            if any(w == s or w == s + "s" or (len(s) > 3 and w.startswith(s)) for w in words)}


def features(block: Block, place: int, count: int) -> list[str]:
    tags, text = set(block.tags), block.text
    words = text.count(" ") + 1
    share = block.linked / max(len(text), 1)
    out = ["bias", *("in " + t for t in TAGS if t in tags), *("kind " + k for k in sorted(_kinds(block.names)))]
    out.append("parent " + (block.tags[-1] if block.tags else "none"))
    out.append(f"words {min(int(np.log2(words)), 6)}")
    out.append(f"links {'none' if share == 0 else 'some' if share < 0.5 else 'most'}")
    out.append("ends " + ("stop" if text[-1] in ".!?:;”\"" else "open"))
    if any(c in text for c in "©®") or "rights reserved" in text.lower():
        out.append("copyright")
    if not tags & {"article", "main"}:
        out.append("outside")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features per label (boilerplate, main) and of label changes."""

    weights: dict[str, tuple[float, float]]
    change: tuple[tuple[float, float], tuple[float, float]]

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, block in enumerate(page):
            for f in features(block, i, len(page)):
                w = self.weights.get(f)
                if w:
                    out[i] += w
        return out

    def viterbi(self, page: list[Block]) -> list[int]:
        """The most likely labels."""
        if not page:
            return []
        s, t = self.scores(page), np.array(self.change)
        best, back = s[0], []
        for row in s[1:]:
            total = best[:, None] + t
            back.append(total.argmax(0))
            best = total.max(0) + row
        label = int(best.argmax())
        labels = [label]
        for b in reversed(back):
            label = int(b[label])
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        parts = blocks(page)
        return "\n".join(b.text for b, label in zip(parts, self.viterbi(parts), strict=True) if label)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 300, rate: float = 0.1, decay: float = 0.01) -> Field:
    """Maximum likelihood weights: gradients by forward-backward, steps by Adam."""
    rows = [[features(b, i, len(p)) for i, b in enumerate(p)] for p, _ in pages]
    names = {f: i for i, f in enumerate(sorted({f for p in rows for r in p for f in r}))}
    longest = max(map(len, rows))
    x, y, real = np.zeros((len(rows), longest, len(names))), np.zeros((len(rows), longest, 2)), np.zeros((len(rows), longest), bool)
    for k, (p, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        for i, r in enumerate(p):
            x[k, i, [names[f] for f in r]] = 1
        y[k, :len(p)] = np.eye(2)[labels]
        real[k, :len(p)] = True
    size = len(names) * 2
    theta, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    flat = x.reshape(-1, len(names))
    seen_pairs = np.einsum("kia,kib->ab", y[:, :-1], y[:, 1:])
    for n in range(1, rounds + 1):
        w, t = theta[:size].reshape(-1, 2), theta[size:].reshape(2, 2)
        marginal, pairs = _expected((flat @ w).reshape(y.shape), t, real)
        gw = flat.T @ (y - marginal).reshape(-1, 2)
        gradient = np.concatenate([gw.ravel(), (seen_pairs - pairs).ravel()]) - decay * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-8)
    w, t = theta[:size].reshape(-1, 2), theta[size:].reshape(2, 2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tuple(map(tuple, t.tolist())))


def _expected(s: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every label and expected counts of label pairs, for pages padded to one length."""
    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis)
        return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))

    n = s.shape[1]
    ahead, behind = np.zeros_like(s), np.zeros_like(s)
    ahead[:, 0] = s[:, 0]
    for i in range(1, n):
        ahead[:, i] = np.where(real[:, i, None], s[:, i] + total(ahead[:, i - 1, :, None] + t, 1), ahead[:, i - 1])
    for i in range(n - 2, -1, -1):
        behind[:, i] = np.where(real[:, i + 1, None], total(t + (s[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0.0)
    whole = total(ahead[:, -1], 1)
    inner = ahead[:, :-1, :, None] + t + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    pairs = np.where(real[:, 1:, None, None], np.exp(np.minimum(inner, 0)), 0.0).sum(axis=(0, 1))
    return np.where(real[:, :, None], np.exp(ahead + behind - whole[:, None, None]), 0.0), pairs


def fitted() -> Field:
    """The field trained on the labelled pages."""
    from lutrin.llm.labelled_pages import pages

    return train([(blocks(html), labels) for html, labels in pages()])


def main_text(html: Column, field: Field) -> Column:
    """The main text of every page."""

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([field.main_text(p) for p in pages], dtype=object)

    return extracted(html)


