"""Block trees of web pages, and features of their nodes.

Nodes are block elements, inline elements that bear attribute tokens, and runs of text that lie between blocks. Tags
that the markup leaves out are implied: a block ends an open paragraph, an item the item before it, and the end of an element
all that is open in it. Parents come before children and nodes in page order. Every step is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: Kinds of nodes; each name is one of the tags that the kind holds. `text` is a run between blocks, `inline` an inline element with tokens.
KINDS = {
    "text": "",
    "inline": "",
    "body": "html body",
    "p": "p",
    "h1": "h1",
    "h2": "h2 h3 h4 h5 h6 hgroup",
    "ul": "ul ol dl menu dir",
    "li": "li dt dd",
    "div": "div center",
    "section": "section",
    "article": "article",
    "main": "main",
    "nav": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset search",
    "table": "table thead tbody tfoot tr td th caption",
    "blockquote": "blockquote",
    "pre": "pre listing xmp",
    "figure": "figure figcaption",
    "button": "button label legend summary option",
    "details": "details dialog",
    "address": "address",
}
_KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
NAMES = list(KINDS)
TEXT, INLINE, BODY, ARTICLE, LIST, FORM, BUTTON = (NAMES.index(x) for x in ("text", "inline", "body", "article", "ul", "form", "button"))
#: Elements whose content is no text of the page.
SKIPPED = "script style noscript template title textarea select iframe svg object noembed noframes"
_SKIPPED = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED.split()}
_BREAKS = {"br", "hr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An item ends the open one of the same list.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role, and `hidden` for what is not shown."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    out = []
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, text = name.lower(), "".join(value)
        if name in ("class", "id", "role"):
            out += [t.lower() for t in _TOKEN.findall(text)]
        elif name == "hidden" or name == "aria-hidden" and text.lower() == "true" or name == "style" and _HIDING.search(text):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


class Page:
    """kind, parent (-1 at the top), depth and tokens by node; parts in page order: (node, text, in a link), or (-1, " ", False) between blocks."""

    def __init__(self, html: str):
        self.kind, self.parent, self.depth, self.tokens = [BODY], [-1], [0], [()]
        self.parts: list[tuple[int, str, bool]] = []
        # open elements: node and tag; where the text of each goes (None: to a new run)
        self._stack: list[tuple[int, str]] = [(0, "body")]
        self._open = {"body": 1}
        self._run: list[int | None] = [None]
        self._held: dict[int, list[int]] = {}
        self._link = 0
        # elements that make no node, inside one of the same tag that does
        self._plain: dict[str, int] = {}
        self._read(html)
        del self._stack, self._open, self._run, self._held, self._plain

    def _node(self, kind: int, tokens: tuple[str, ...] = ()) -> int:
        up = self._stack[-1][0]
        self.kind.append(kind)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.tokens.append(tokens)
        self._run.append(None)
        return len(self.kind) - 1

    def _text(self, text: str) -> None:
        v = self._stack[-1][0]
        if text.isspace():
            # white space belongs to no node
            self.parts.append((-1, " ", False))
            return
        if self._run[v] is None:
            # the first text of an element without children is its own
            self._run[v] = self._node(TEXT) if v in self._held or self.kind[v] == BODY else v
            self._held.setdefault(v, [])
        self._held[v].append(len(self.parts))
        self.parts.append((self._run[v], text, self._link > 0))

    def _push(self, kind: int, tag: str, tokens: tuple[str, ...]) -> None:
        v = self._stack[-1][0]
        if self._run[v] == v:
            # text that came before the first child becomes a run of its own
            run = self._node(TEXT)
            for k in self._held[v]:
                self.parts[k] = (run, *self.parts[k][1:])
        self._held[v] = []
        self._run[v] = None
        self._stack.append((self._node(kind, tokens), tag))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> None:
        v, tag = self._stack.pop()
        self._open[tag] -= 1
        if self.kind[v] != INLINE:
            self.parts.append((-1, " ", False))
        if self._link > len(self._stack):
            self._link = 0

    def _close(self, tag: str) -> None:
        if tag != "body" and self._open.get(tag):
            while self._stack[-1][1] != tag:
                self._pop()
            self._pop()

    def _close_paragraph(self) -> None:
        k = len(self._stack) - 1
        while self.kind[self._stack[k][0]] == INLINE:
            k -= 1
        if self._stack[k][1] == "p":
            while len(self._stack) > k:
                self._pop()

    def _begin(self, tag: str, attributes: str) -> None:
        kind = _KIND.get(tag)
        if tag in _BREAKS:
            self.parts.append((-1, " ", False))
        if tag in _VOID:
            return
        if tag == "a":
            self._link = len(self._stack)
        if kind is None:
            if tokens := attribute_tokens(attributes):
                self._push(INLINE, tag, tokens)
            elif self._open.get(tag):
                self._plain[tag] = self._plain.get(tag, 0) + 1
            return
        tokens = attribute_tokens(attributes)
        if kind == BODY:
            # the page has one root, whatever is written
            self.tokens[0] = tuple(dict.fromkeys(self.tokens[0] + tokens))
            return
        if kind != BUTTON:
            self._close_paragraph()
        if tag in _ENDS and any(self._open.get(t) for t in _ENDS[tag][0]):
            ends, stops = _ENDS[tag]
            k = len(self._stack) - 1
            last = None
            while k > 0 and self._stack[k][1] not in stops:
                if self._stack[k][1] in ends:
                    last = k
                elif self.kind[self._stack[k][0]] not in (INLINE, _KIND["p"]) and self._stack[k][1] not in ("td", "th"):
                    break
                k -= 1
            if last is not None:
                while len(self._stack) > last:
                    self._pop()
        self.parts.append((-1, " ", False))
        self._push(kind, tag, tokens)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = 0
        if self._plain.get(tag):
            self._plain[tag] -= 1
        else:
            self._close(tag)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        text: list[str] = []

        def flush() -> None:
            if text:
                self._text(unescape("".join(text)))
                text.clear()

        while at < n:
            next_ = html.find("<", at)
            if next_ < 0:
                text.append(html[at:])
                break
            if next_ > at:
                text.append(html[at:next_])
            at = next_
            found = _TAG.match(html, at)
            if not found:
                if html.startswith("<!--", at):
                    stop = html.find("-->", at + 4)
                    if stop < 0:
                        break
                    at = stop + 3
                    continue
                after = html[at + 1 : at + 2]
                if after in ("!", "?", "/") and not html[at + 2 : at + 3].isalpha() or after in ("!", "?"):
                    stop = html.find(">", at)
                    if stop < 0:
                        break
                    at = stop + 1
                    continue
                if not (after.isascii() and after.isalpha() or after == "/"):
                    text.append("<")
                    at += 1
                    continue
                # a quote that is not closed
                found = _LOOSE.match(html, at)
                if not found:
                    break
            flush()
            slash, tag, attributes = found.groups()
            tag, at = tag.lower(), found.end()
            if slash:
                self._end(tag)
            elif tag in _SKIPPED:
                if not attributes.endswith("/"):
                    stop = _SKIPPED[tag].search(html, at)
                    if not stop:
                        break
                    at = stop.start()
            else:
                self._begin(tag, attributes)
        flush()


#: What is counted of a text: characters, characters in links, marks, words.
_MARKS = ".,;:!?"


def counts(text: str, link: bool) -> tuple[int, int, int, int]:
    n = len(text)
    return n, n if link else 0, sum(map(text.count, _MARKS)), text.count(" ") + 1


class Forest:
    """The nodes of several pages, put end to end, and their features."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.kind) for p in pages], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        shift = np.repeat(self.starts[:-1], sizes)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.kind = np.array([k for p in pages for k in p.kind], np.int64)
        self.depth = np.array([d for p in pages for d in p.depth], np.int64)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(len(parent)), parent + shift)
        self.tokens = [t for p in pages for t in p.tokens]
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, (self.depth.max() if len(order) else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        own = np.zeros((len(parent), 4))
        at, stat = [], []
        for first, p in zip(self.starts.tolist(), pages):
            for node, text, link in p.parts:
                if node >= 0:
                    at.append(first + node)
                    stat.append(counts(text, link))
        if at:
            np.add.at(own, np.array(at), np.array(stat, float))
        self.own = own

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(float).copy()
        for level in reversed(self.levels):
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray, join) -> np.ndarray:
        """What the ancestors' values join to; the values themselves at the top."""
        out = values.copy()
        for level in self.levels:
            up = self.parent[level]
            out[level] = join(out[up], values[up])
        return out

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """A row a node. odds: how much attribute tokens speak for content."""
        n = len(self.kind)
        chars, link, marks, words = (self.own[:, k] for k in range(4))
        leaf = (chars > 0).astype(float)
        total = self.up(np.column_stack([chars, link, marks, words, leaf, np.ones(n)]))
        t_chars, t_link, t_marks, t_words, t_leaves, t_nodes = total.T
        safe = np.maximum(t_chars, 1)
        page_chars = np.maximum(t_chars[self.starts[:-1]], 1)[self.page]
        before = np.cumsum(chars) - chars
        before -= before[self.starts[:-1]][self.page]
        inner = ~self.root
        siblings = np.bincount(self.parent[inner], minlength=n)
        same = np.zeros(n)
        if inner.any():
            _, group, size = np.unique(self.parent[inner] * len(NAMES) + self.kind[inner], return_inverse=True, return_counts=True)
            same[inner] = size[group]
        order = np.arange(n) - self.parent
        among = np.maximum(siblings[self.parent], 1)
        up_chars = np.maximum(t_chars[self.parent], 1)
        own_low, own_high = np.zeros(n), np.zeros(n)
        for k, tokens in enumerate(self.tokens):
            if tokens:
                said = [odds.get(t, 0.0) for t in tokens]
                own_low[k], own_high[k] = min(said), max(said)
        low, high = self.down(np.where(self.root, 0, own_low), np.minimum), self.down(np.where(self.root, 0, own_high), np.maximum)
        beneath = np.minimum(0, -self.up(np.where(own_low < -1, t_chars, 0)) / safe)
        bits = self.down(np.where(self.root, 0, 1 << self.kind), np.bitwise_or)
        holds = self.up(np.eye(len(NAMES))[self.kind][:, [ARTICLE, NAMES.index("main"), NAMES.index("p"), NAMES.index("h1"), FORM, LIST]])
        columns = [
            np.log1p(chars),
            np.log1p(t_chars),
            t_link / safe,
            t_marks / safe,
            t_words / np.maximum(t_leaves, 1),
            t_chars / np.maximum(t_nodes, 1),
            np.log1p(t_nodes),
            t_chars / page_chars,
            before / page_chars,
            (page_chars - before - t_chars) / page_chars,
            np.log1p(page_chars),
            self.depth,
            order,
            siblings,
            among,
            same / among,
            t_chars / up_chars,
            t_link[self.parent] / up_chars,
            (up_chars - t_chars) / np.maximum(among - 1, 1),
            own_low,
            own_high,
            low,
            high,
            beneath,
            *[np.minimum(holds[:, k], 20) for k in range(holds.shape[1])],
            *[holds[self.starts[:-1], k][self.page] for k in (0, 1)],
            *[self.kind == k for k in range(len(NAMES))],
            *[(bits >> k) & 1 for k in range(len(NAMES))],
            *[self.kind[self.parent] == k for k in (BODY, NAMES.index("div"), NAMES.index("section"), ARTICLE)],
        ]
        return np.column_stack(columns).astype(np.float32)
