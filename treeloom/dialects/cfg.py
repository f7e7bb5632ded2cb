"""INI-style configuration: sections, entries, switches and conditions."""

from __future__ import annotations

import re

from .lines import lines_of
from .tree import Tree

_UNQUOTED = r'(?:"[^"]*(?:"|$)|[^"{stops}])*'
_TO_COMMENT = re.compile(_UNQUOTED.replace("{stops}", "#;"))
_TO_ASSIGN = re.compile(_UNQUOTED.replace("{stops}", "=:"))
_SECTION = re.compile(r"[ \t]*\[([^\]]*)\]")
_SWITCH = re.compile(r"--(?=[^ ])|-(?=[^ -])")
_BLANKS = re.compile(r"[ \t]*")


class _Line:
    """Leaves of one line; empty ones are left out."""

    def __init__(self, tree: Tree, start: int, stop: int, end: int) -> None:
        self.tree, self.start, self.stop, self.end = tree, start, stop, end

    def leaf(self, tag: str, a: int, b: int) -> None:
        if b > a:
            self.tree.leaf(tag, a, b)

    def blanks(self, at: int) -> int:
        to = _BLANKS.match(self.tree.text, at, self.stop).end()
        self.leaf("ws", at, to)
        return to

    def comment_at(self, at: int) -> int:
        return _TO_COMMENT.match(self.tree.text, at, self.stop).end()

    def trimmed(self, tag: str, a: int, b: int) -> int:
        """The text up to ``b`` without the blanks before it; where it ends."""
        to = a + len(self.tree.text[a:b].rstrip(" \t"))
        self.leaf(tag, a, to)
        return to

    def tail(self, at: int) -> None:
        self.leaf("comment", self.blanks(at), self.stop)
        self.leaf("nl", self.stop, self.end)

    def value(self, at: int) -> None:
        self.tail(self.trimmed("value", at, self.comment_at(at)))

    def keyed(self, at: int) -> None:
        stop = self.comment_at(self.start + len(_BLANKS.match(self.tree.text, self.start, self.stop)[0]))
        stop = max(stop, at)
        sign = _TO_ASSIGN.match(self.tree.text, at, stop).end()
        if sign >= stop:
            self.tail(self.trimmed("key", at, stop))
            return
        self.blanks(self.trimmed("key", at, sign))
        self.leaf("op", sign, sign + 1)
        self.value(self.blanks(sign + 1))


def parse(text: str) -> Tree:
    tree = Tree(text)
    tree.open("config", 0)
    in_section = False
    for start, stop, end in lines_of(text):
        line = _Line(tree, start, stop, end)
        first = _BLANKS.match(text, start, stop).end()
        if first == stop:
            tree.leaf("blank", start, end)
            continue
        if text[first] in "#;":
            line.blanks(start)
            line.leaf("comment", first, stop)
            line.leaf("nl", stop, end)
            continue
        if section := _SECTION.match(text, start, stop):
            if in_section:
                tree.close()
            in_section = True
            tree.open("section", start)
            line.blanks(start)
            line.leaf("open", first, first + 1)
            line.leaf("name", *section.span(1))
            line.leaf("close", section.end() - 1, section.end())
            line.tail(section.end())
            continue
        switch = _SWITCH.match(text, first, stop)
        if text[first] == "@":
            tag, marker = "cond", first + 1
        elif switch:
            tag, marker = "switch", switch.end()
        elif _TO_ASSIGN.match(text, first, line.comment_at(first)).end() < line.comment_at(first):
            tag, marker = "entry", first
        else:
            tag, marker = "line", first
        tree.open(tag, start)
        line.blanks(start)
        line.leaf("marker", first, marker)
        if tag == "line":
            line.value(first)
        else:
            line.keyed(marker)
        tree.close()
    if in_section:
        tree.close()
    tree.close()
    return tree
