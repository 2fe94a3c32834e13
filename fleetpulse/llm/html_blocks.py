"""Leaf blocks of a web page: text between block-level tags, with the path of open elements.

A small helper of the HTML extraction, on the standard library's parser.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Element names by role.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split())
FALLBACK = frozenset("audio canvas iframe noscript object video".split())    # what they hold is text of its own
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title template datalist annotation".split())        # their text is not of the page
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table select".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[tuple, str, int]] = []
        self.parts: list[str] = []
        self.path: tuple | None = None
        self.linked = self.links = self.unseen = 0

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.path, text, self.linked))
            self.parts, self.linked = [], 0
        self.path = None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in FALLBACK:
            self.end_block()
        if self.unseen and (tag == "body" or tag in BLOCK):  # a head or title that was never closed
            self._close({"title"}, ())
            self._close({"head"}, ())
        if tag in BLOCK:
            self.end_block()
            self._close({"p"}, ())
            if tag in CLOSES:
                self._close(CLOSES[tag], HOLDERS)
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        names = []
        for key, value in attrs:
            if key in ("class", "id", "role"):
                names += [n.lower() for n in _NAME.findall(value or "")]
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (
                    key == "style" and _HIDDEN.search(value or "")):
                names.append("hidden")
        self.open.append((tag, tuple(names)))
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tags, fence) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self._pop(k)
                return
            if self.open[k][0] in fence:
                return

    def _pop(self, k: int) -> None:
        self.links -= sum(tag == "a" for tag, _ in self.open[k:])
        self.unseen -= sum(tag in UNSEEN for tag, _ in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in FALLBACK:
            self.end_block()
        self._close({tag}, ())

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._close({"head"}, ())                        # text ends a head that was never closed
        if self.unseen or (self.open and self.open[-1][0] in ("script", "style")):
            return
        if self.path is None and not data.isspace():
            self.path = tuple(self.open)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def unknown_decl(self, data):                            # <![CDATA[ and the like are markup
        pass


def leaf_blocks(html: str | None) -> list[tuple[tuple, str, int]]:
    """``(path, text, linked characters)`` of each block in page order; the path is a tuple of (tag, names)
    from the root down.  White space is collapsed.

    Scripts, styles, comments, the head, titles, templates, choices of an input (datalist) and the annotation of a
    formula give no blocks.  Other elements do, whatever they are: formulas and drawings stand in their block, the text
    of noscript, object, iframe, canvas, audio and video is a block of its own.  An unclosed element ends with its
    parent; an unclosed head or title at the next block."""
    reader = _Reader()
    reader.feed((html or "").replace("\x00", ""))
    reader.close()
    reader.end_block()
    return reader.blocks
