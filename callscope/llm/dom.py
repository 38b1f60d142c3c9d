"""A forgiving HTML reader: elements as flat lists, and the text blocks between block elements."""

from __future__ import annotations

import html
import re

#: Element names by behaviour, fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw or invisible content, pictures and lists of choices of forms: skipped whole.
RAW = frozenset("script style noscript noembed noframes template iframe textarea title svg select annotation annotation-xml".split())
#: Of these, the ones that can hold elements of their own name.
NESTED = frozenset("template svg annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag of the key ends, up to the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.DOTALL)
#: One step behind a tag's name: its end, or an attribute up to the quote that opens its value.
_STEP = re.compile(r"[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:([\"'])|[^\s\"'>][^\s>]*+)?+)?+)")
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9-])[^>]*>?", re.IGNORECASE) for tag in RAW}
_SAME = {tag: re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])", re.IGNORECASE | re.DOTALL) for tag in NESTED}
_ATTRIBUTE = re.compile(r"(?i)\b(?:id|class|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")


class Page:
    """Elements in page order.

    tags, parents, words (of the naming attributes), depth; ends[i] is one past the last element
    inside i. blocks: (element, text) with white space in order; an element's texts are separate
    blocks where a block element stands between them.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.words, self.depth, self.ends = ["#root"], [-1], [()], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[int] = []  # letters inside links, for each block
        self._stack, self._text, self._linked, self._in_link = [0], [], 0, 0
        self._paragraphs = 0  # open p elements
        self._last_quote = {quote: source.rfind(quote) for quote in "\"'"}
        self._last_end = source.rfind(">")
        self._endless: set[int] = set()  # places behind which a tag has no end
        self._unclosed: set[str] = set()  # names without an end tag in the rest of the page
        self._read(source)
        self._flush()
        while self._stack:
            self._pop()

    def _pop(self) -> None:
        node = self._stack.pop()
        self.ends[node] = len(self.tags)
        tag = self.tags[node]
        if tag == "a":
            self._in_link -= 1
        elif tag in BLOCK:
            self._paragraphs -= tag == "p"
            self._flush(node)

    def _flush(self, node: int | None = None) -> None:
        """End the current block; it belongs to the innermost open block element."""
        if self._text:
            text = "".join(self._text)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                if node is None:
                    node = next((x for x in reversed(self._stack) if self.tags[x] in BLOCK), 0)
                self.blocks.append((node, text))
                self.links.append(self._linked)
            self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> int:
        if tag in BLOCK:
            if self._paragraphs:
                self._close("p", frozenset(("td", "th", "table", "div", "section", "article", "li", "blockquote")))
            names, holders = ENDS.get(tag, ((), ()))
            for k in range(len(self._stack) - 1, 0, -1):
                if self.tags[self._stack[k]] in holders:
                    break
                if self.tags[self._stack[k]] in names:
                    while len(self._stack) > k:
                        self._pop()
            self._flush()
        found = " ".join("".join(x) for x in _ATTRIBUTE.findall(attributes)) if attributes else ""
        found = re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower() if found else ""
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.depth.append(self.depth[self._stack[-1]] + 1)
        self.words.append(tuple(_WORD.findall(found)) if found else ())
        self.ends.append(len(self.tags))
        node = len(self.tags) - 1
        self._stack.append(node)
        self._in_link += tag == "a"
        self._paragraphs += tag == "p"
        return node

    def _close(self, tag: str, stops: frozenset[str] = frozenset()) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tags[self._stack[k]]
            if name == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if name in stops:
                return

    def _tag_end(self, source: str, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1.

        A quote opens a value only behind ``=``, and only if it is closed anywhere behind; values
        have no limit. Places without an end are remembered, so that a page is read in linear time.
        """
        seen = []
        while at <= self._last_end and at not in self._endless:
            seen.append(at)
            step = _STEP.match(source, at)
            if not step:
                break
            at = step.end()
            if step[1]:
                return at - 1
            if step[2] and at <= self._last_quote[step[2]]:
                at = source.find(step[2], at) + 1
        self._endless.update(seen)
        return -1

    def _raw_end(self, source: str, tag: str, at: int) -> int:
        """The place behind the end tag of a raw element whose content starts at ``at``, or -1.

        Inner elements of the same name are counted; where they do not come out even, the first
        end tag counts.
        """
        end = None if tag in self._unclosed else _RAW_END[tag].search(source, at)
        if not end:
            self._unclosed.add(tag)
            return -1
        if tag in NESTED:
            depth, place = 1, at
            while same := _SAME[tag].search(source, place):
                place = same.end()
                if same[1] is None or (stop := self._tag_end(source, place)) < 0:
                    continue
                place = stop + 1
                depth += -1 if same[1] else source[stop - 1] != "/" or tag == "template"
                if not depth:
                    return place
        return end.end()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            match, end = _TAG.search(source, at), -1
            while match and match[2] and (end := self._tag_end(source, match.end())) < 0:
                match = _TAG.search(source, match.start() + 1)
            stop = match.start() if match else n
            if stop > at:
                text = source[at:stop]
                self._text.append(text)
                if self._in_link:
                    self._linked += len(text.strip())
            if not match:
                return
            if not match[2]:
                at = match.end()
                continue
            at = end + 1
            tag = match[2].lower()
            if match[1]:
                self._close(tag)
            elif tag in VOID:
                if tag in ("br", "img", "input", "hr", "wbr"):
                    if tag == "hr":
                        self._flush()
                    elif tag != "wbr":
                        self._text.append(" ")
            else:
                self._open(tag, source[match.end() : end])
                if tag in RAW:
                    empty = source[end - 1] == "/" and tag in ("svg", "annotation", "annotation-xml")
                    after = at if empty else self._raw_end(source, tag, at)
                    if after >= 0:
                        at = after
                    elif tag != "title":
                        at = n if tag in ("script", "style", "textarea") else at
                    self._pop()
