"""YAML block structure by indentation, with flow collections over several lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice, takewhile

from .lines import Line, lines_of
from .tree import Tree

MAX_DEPTH = 900
_BLANKS = re.compile(r"[ \t]*")
_SPACES = re.compile(r" *")
#: Signs of a stretch of a line: quoted text where a scalar can begin, a comment sign, separators and brackets.
_SIGN = re.compile(
    r"""(?<![^ \t,\[{:])(?:'(?:''|[^'])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\\?\Z))|(?<![^ \t])\#|[:,\[\]{}]""",
    re.DOTALL,
)
_NESTING = {"[": 1, "{": 1, "]": -1, "}": -1}
_TRIVIA = re.compile(r"[ \t]*(?:(?<![^ \t\r\n])#.*)?", re.DOTALL)
_PROPERTIES = re.compile(r"(?:[&!][^ \t,\[\]{}]*[ \t]*)*")
_BLOCK_SCALAR = re.compile(r"[|>][-+0-9]*\Z")
_PLAIN_REST = re.compile(r"((?:[^ \t#'\"\[\]{}&!|>]++(?:[ \t]++(?=[^ \t]))?)*+)[ \t]*\Z")
_PLAIN_KEY = re.compile(r"[^:#'\"\[\]{}]*:")
_MARKER = re.compile(r"(---|\.\.\.)(?:[ \t]|\Z)")


class _Yaml:
    """``i`` is the current line, ``at`` a position on it; bodies are lines without terminators."""

    def __init__(self, text: str) -> None:
        self.tree, self.text = Tree(text), text
        self.lines = lines_of(text)
        self.i = 0
        self.blank, self.trivial, self.indents, self.markers = [], [], [], []
        for start, stop, end in self.lines:
            first = _BLANKS.match(text, start, stop).end()
            self.blank.append(first == stop)
            self.trivial.append(first == stop or text[first] == "#")
            self.indents.append(_SPACES.match(text, start, end).end() - start)
            self.markers.append(m[1] if text[start] in "-." and (m := _MARKER.match(text[start:stop])) else "")

    # --- scanning -----------------------------------------------------------

    @property
    def line(self) -> Line:
        return self.lines[self.i]

    def signs(self, since: int, stop: int) -> Iterator[tuple[int, str]]:
        """Signs outside quotes between two positions of a line, which is read as if it began at the first."""
        part = self.text[since:stop]
        return ((since + m.start(), m[0]) for m in _SIGN.finditer(part) if m[0][0] not in "'\"")

    def comment_at(self, since: int, stop: int) -> int:
        if self.text.find("#", since, stop) < 0:
            return stop
        return next((at for at, c in self.signs(since, stop) if c == "#"), stop)

    def key_colon(self, since: int, stop: int) -> int:
        """The colon that makes a key of what stands before it, or -1: outside brackets, and a blank or the end follows."""
        plain = _PLAIN_KEY.match(self.text, since, stop)
        if plain and (plain.end() == stop or self.text[plain.end()] in " \t"):
            return plain.end() - 1  # no quote, bracket or comment sign before it
        if self.text.find(":", since, stop) < 0:
            return -1
        found = list(takewhile(lambda sign: sign[1] != "#", self.signs(since, stop)))
        depths = accumulate(found, lambda depth, sign: max(0, depth + _NESTING.get(sign[1], 0)), initial=0)
        separating = (at for (at, c), depth in zip(found, depths, strict=False) if c == ":" and not depth and self.text[at + 1 : min(at + 2, stop)] in ("", " ", "\t"))
        return next(separating, -1)

    def scalar_end(self, since: int, stop: int) -> int:
        """End of a scalar inside a flow collection, without blanks at its end."""

        def ends(at: int, c: str) -> bool:
            if c == "#":
                return at > since
            if c == ":":
                return self.text[at + 1 : min(at + 2, stop)] in ("", " ", "\t", ",", "]", "}") or (at > since and self.text[at - 1] in "'\"")
            return True

        end = next((at for at, c in self.signs(since, stop) if ends(at, c)), stop)
        return since + len(self.text[since:end].rstrip(" \t"))

    def beyond(self, at: int, line: Line) -> int:
        """Where content goes on after blanks and a comment on the same line."""
        return _TRIVIA.match(self.text, at, line.stop).end()

    def following(self, at: int) -> str:
        """The next character of content from ``at`` on, whichever line it is on."""
        places = ((self.beyond(max(at, line.start), line), line.stop) for line in islice(self.lines, self.i, None))
        return next((self.text[to] for to, stop in places if to < stop), "")

    def element_is_key(self, at: int) -> bool:
        """Whether a colon ends the element, whose scalar may go on over lines."""
        ends = ((self.beyond(self.scalar_end(max(at, line.start), line.stop), line), line.stop) for line in islice(self.lines, self.i, None))
        return next((self.text[to] == ":" for to, stop in ends if to < stop), False)

    # --- leaves -------------------------------------------------------------

    def leaf(self, tag: str, a: int, b: int) -> None:
        if b > a:
            self.tree.leaf(tag, a, b)

    def blanks(self, at: int) -> int:
        to = _BLANKS.match(self.text, at, self.line.stop).end()
        self.leaf("ws", at, to)
        return to

    def end_line(self) -> None:
        self.leaf("nl", self.line.stop, self.line.end)

    def properties(self, at: int) -> int:
        """Anchors and tags before a node; where the node begins."""
        to = _PROPERTIES.match(self.text, at, self.line.stop).end()
        if to == at:
            return at
        core = at + len(self.text[at:to].rstrip(" \t"))
        self.leaf("value", at, core)
        return self.blanks(core)

    # --- flow collections ---------------------------------------------------

    def flow_trivia(self, at: int) -> int:
        """Emit blanks, comments and line ends up to the next content of the collection."""
        while True:
            past = self.beyond(at, self.line)
            self.leaf("comment", self.blanks(at), past)
            if past < self.line.stop or self.i + 1 == len(self.lines):
                return past
            self.end_line()
            self.i += 1
            at = self.line.start

    def flow(self, at: int, depth: int) -> int:
        opener = self.text[at]
        self.tree.open("flow", at)
        self.leaf("open", at, at + 1)
        at += 1
        while True:
            at = self.flow_trivia(at)
            if at >= self.line.stop:
                break
            c = self.text[at]
            if c in "]},":
                self.leaf("comma" if c == "," else "close", at, at + 1)
                at += 1
                if c == ",":
                    continue
                break
            before = at
            at = self.element(at, opener == "[", depth)
            if at == before:
                self.leaf("value", at, at + 1)
                at += 1
        self.tree.close()
        return at

    def nested(self, at: int, depth: int) -> int:
        """A collection inside another; beyond MAX_DEPTH its opener is plain text."""
        if depth < MAX_DEPTH:
            return self.flow(at, depth + 1)
        self.leaf("value", at, at + 1)
        return at + 1

    def element(self, at: int, in_sequence: bool, depth: int) -> int:
        if in_sequence:
            self.tree.open("item", at)
        at = self.properties(at)
        if at < self.line.stop and self.text[at] in "[{":
            at = self.nested(at, depth)
        else:
            key = not in_sequence or self.element_is_key(at)
            if key:
                self.tree.open("entry", at)
            at = self.scalar("key" if key else "value", at)
            if key:
                at = self.pair_value(at, depth)
                self.tree.close()
        if in_sequence:
            self.tree.close()
        return at

    def scalar(self, tag: str, at: int) -> int:
        """The text of an element, which may go on over lines until a separator."""
        while True:
            stop = self.scalar_end(at, self.line.stop)
            self.leaf(tag, at, stop)
            at = stop
            if self.beyond(at, self.line) < self.line.stop or self.following(at) in (",", "]", "}", ""):
                return at
            before = at
            at = self.flow_trivia(at)
            if at == before or at >= self.line.stop or self.text[at] == ":":
                return at

    def pair_value(self, at: int, depth: int) -> int:
        if self.following(at) == ":":
            at = self.flow_trivia(at)
        colon = _BLANKS.match(self.text, at, self.line.stop).end()
        if colon >= self.line.stop or self.text[colon] != ":":
            return at
        self.blanks(at)
        self.leaf("colon", colon, colon + 1)
        at = self.flow_trivia(colon + 1)
        if at >= self.line.stop or self.text[at] in ",]}":
            return at
        if self.text[at] not in "[{":
            at = self.properties(at)
        if at < self.line.stop and self.text[at] in "[{":
            return self.nested(at, depth)
        stop = self.scalar_end(at, self.line.stop)
        self.leaf("value", at, stop)
        return stop

    # --- block structure ----------------------------------------------------

    def rest(self, at: int) -> bool:
        """The value at the end of a line; whether it announces a block scalar."""
        text, line = self.text, self.line
        plain = _PLAIN_REST.match(text, at, line.stop)
        if plain:  # nothing in it opens, quotes or comments
            core = plain.end(1)
            self.leaf("value", at, core)
            self.leaf("ws", core, line.stop)
            self.end_line()
            return False
        past = _PROPERTIES.match(text, at, line.stop).end()
        collection = past < line.stop and text[past] in "[{"
        if collection:
            at = self.blanks(self.flow(self.properties(at), 0))
        stop = self.line.stop
        comment = self.comment_at(at, stop)
        core = comment if collection else at + len(text[at:comment].rstrip(" \t"))
        self.leaf("value", at, core)
        self.leaf("ws", core, comment)
        self.leaf("comment", comment, stop)
        self.end_line()
        return not collection and bool(_BLOCK_SCALAR.match(text[at:core]))

    def head(self, at: int) -> tuple[str, int]:
        """What kind of node begins at a place of a line, and where an entry's colon is."""
        stop = self.line.stop
        if self.text[at] == "-" and (at + 1 == stop or self.text[at + 1] in " \t"):
            return "item", -1
        colon = self.key_colon(at, stop)
        return ("entry" if colon >= 0 else "line"), colon

    def inner(self, at: int, head: tuple[str, int] | None = None) -> bool:
        """A line's content: items inside items, then an entry or a plain line.  ``head``: that of the first one, whose node is open."""
        opened = 0
        while True:
            tag, colon = head or self.head(at)
            if head is None:
                self.tree.open(tag, at)
                opened += 1
            head = None
            if tag == "item":
                self.leaf("marker", at, at + 1)
                at = self.blanks(at + 1)
                if at < self.line.stop:
                    continue
                self.end_line()
                scalar = False
            elif tag == "entry":
                self.leaf("key", at, colon)
                self.leaf("colon", colon, colon + 1)
                scalar = self.rest(self.blanks(colon + 1))
            else:
                scalar = self.rest(at)
            for _ in range(opened):
                self.tree.close()
            return scalar

    def trivia(self) -> None:
        line = self.line
        if self.blank[self.i]:
            self.leaf("blank", line.start, line.end)
        else:
            self.leaf("comment", self.blanks(line.start), line.stop)
            self.end_line()
        self.i += 1

    def block_scalar(self, indent: int) -> None:
        self.tree.open("scalar", self.line.start if self.i < len(self.lines) else len(self.text))
        while self.i < len(self.lines) and (self.blank[self.i] or self.indents[self.i] > indent):
            self.leaf("blank" if self.blank[self.i] else "text", self.line.start, self.line.end)
            self.i += 1
        self.tree.close()

    def nodes(self) -> None:
        """Nodes of a document up to its end; open blocks are a stack of least indents."""
        least = [0]

        def leave() -> None:
            least.pop()
            self.tree.close()  # the block
            self.tree.close()  # the node it is of

        while self.i < len(self.lines):
            if self.trivial[self.i]:
                while len(least) > 1 and not self.blank[self.i] and self.indents[self.i] < least[-1]:
                    leave()
                self.trivia()
                continue
            if self.markers[self.i]:
                break
            indent = self.indents[self.i]
            while indent < least[-1]:
                leave()
            at = self.blanks(self.line.start)
            head = self.head(at)
            self.tree.open(head[0], at)
            scalar = self.inner(at, head)
            self.i += 1
            if scalar:
                self.block_scalar(indent)
            else:
                j = self.i
                while j < len(self.lines) and self.trivial[j]:
                    j += 1
                if j < len(self.lines) and not self.markers[j] and self.indents[j] > indent:
                    self.tree.open("block", self.line.start)
                    while self.i < j:
                        self.trivia()
                    least.append(indent + 1)
                    continue
            self.tree.close()
        while len(least) > 1:
            leave()

    def marker_line(self) -> None:
        start = self.line.start
        self.leaf("marker", start, start + 3)
        at = self.blanks(start + 3)
        if at < self.line.stop:
            self.inner(at)
        else:
            self.end_line()
        self.i += 1

    def parse(self) -> Tree:
        tree, doc = self.tree, False
        tree.open("stream", 0)
        while self.i < len(self.lines):
            start = self.line.start
            directive = self.text[start] == "%"
            if self.trivial[self.i]:
                self.trivia()
            elif self.markers[self.i] == "---" or directive:
                if doc:
                    tree.close()
                doc = not directive
                tree.open("directive" if directive else "doc", start)
                if directive:
                    self.rest(start)
                    self.i += 1
                    tree.close()
                else:
                    self.marker_line()
            elif self.markers[self.i] == "...":
                self.marker_line()
                if doc:
                    tree.close()
                doc = False
            else:
                if not doc:
                    tree.open("doc", start)
                doc = True
                self.nodes()
        if doc:
            tree.close()
        tree.close()
        return tree


def parse(text: str) -> Tree:
    import sys

    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 8 * MAX_DEPTH))
        return _Yaml(text).parse()
    finally:
        sys.setrecursionlimit(limit)
