"""A small tree of the block elements of an HTML page, with the text of each block."""

import html
import re
from collections import Counter

# Elements by how they are read.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = RAW | {"head", "template", "svg", "canvas", "audio", "video", "select", "button",
                "datalist", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr", "frame", "keygen"}
BLOCKS = {"html", "head", "body", "main", "article", "section", "nav", "aside", "header", "footer",
          "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
          "table", "thead", "tbody", "tfoot", "caption", "tr", "td", "th", "blockquote", "pre",
          "figure", "figcaption", "form", "fieldset", "legend", "address", "center", "details",
          "summary", "hgroup", "menu", "search", "dir", "dialog"} | HIDDEN
#: An element that a start tag ends, if it is open inside the element named second.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
KEEPS_PARAGRAPH_OPEN = HIDDEN - {"head"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Page:
    """Nodes in page order; a parent stands before its children. Node 0 is the page itself.

    ``pieces`` holds (node, text, letters of it in links) of each run of text that no block
    element interrupts, white space collapsed, and none that is blank.
    """

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.names: list[str] = [""]
        self.parents: list[int] = [-1]
        self.pieces: list[tuple[int, str, int]] = []
        self._open = [0]
        self._names_open: Counter = Counter()
        self._hidden = 0
        self._links = 0
        self._text: list[tuple[str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at and not self._hidden:
                self._text.append((source[at:end], self._links))
            if not m:
                break
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag or (m[5] and not source.endswith(">", 0, at)):
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in VOID:
                if not self._hidden:
                    self._text.append((" ", 0))
            else:
                at = self._start(tag, attributes, source, at)
        self._flush()

    def _start(self, tag: str, attributes: str, source: str, at: int) -> int:
        if tag not in BLOCKS:
            self._links += tag == "a"
            return at
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            return end.end() if end else len(source)
        if tag not in KEEPS_PARAGRAPH_OPEN:
            self._flush()
            if self.tags[self._open[-1]] == "p":
                self._pop()
            ended, inside = ENDED_BY.get(tag, (set(), set()))
            some = any(self._names_open[name] for name in ended)
            for depth in range(len(self._open) - 1, 0, -1) if some else ():
                name = self.tags[self._open[depth]]
                if name in inside:
                    break
                if name in ended:
                    while len(self._open) > depth:
                        self._pop()
        self._links = 0 if tag not in KEEPS_PARAGRAPH_OPEN else self._links
        found = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes))
        self.tags.append(tag)
        self.names.append(" ".join(found))
        self.parents.append(self._open[-1])
        self._open.append(len(self.tags) - 1)
        self._names_open[tag] += 1
        self._hidden += tag in HIDDEN
        return at

    def _close(self, tag: str) -> None:
        if tag not in BLOCKS:
            self._links = max(0, self._links - 1) if tag == "a" else self._links
            return
        for depth in range(len(self._open) - 1, 0, -1) if self._names_open[tag] else ():
            if self.tags[self._open[depth]] == tag:
                if tag not in KEEPS_PARAGRAPH_OPEN:
                    self._flush()
                while len(self._open) > depth:
                    self._pop()
                return

    def _pop(self) -> None:
        self._flush_if_block()
        tag = self.tags[self._open.pop()]
        self._names_open[tag] -= 1
        self._hidden -= tag in HIDDEN

    def _flush_if_block(self) -> None:
        if self.tags[self._open[-1]] not in KEEPS_PARAGRAPH_OPEN:
            self._flush()

    def _flush(self) -> None:
        if not self._text:
            return
        # A reference does not go on behind markup, so each run is decoded by itself.
        text = _SPACE.sub(" ", "".join(html.unescape(t) for t, _ in self._text)).strip()
        if text:
            linked = sum(len(t) for t, links in self._text if links)
            self.pieces.append((self._open[-1], text, min(linked, len(text))))
        self._text.clear()
