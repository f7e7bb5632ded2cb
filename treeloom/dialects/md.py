"""Markdown blocks: headings, fences, lists, quotes and paragraphs."""

from __future__ import annotations

import re

from .lines import lines_of
from .tree import Tree

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_FENCE_HEAD = re.compile(r" *[`~]*")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:(?= )|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r" *(?:[-*+]|[0-9]+[.)])(?: |$)")
_INDENT = re.compile(r"[ \t]*")


def classify(body: str) -> tuple[str, int]:
    """Kind of a line without its terminator, and the length of its marker."""
    if not body.strip(" \t"):
        return "blank", 0
    if m := _FENCE.match(body):
        return "fence", len(m[1])
    if m := _HEADING.match(body):
        return "heading", m.end(1)
    if m := _QUOTE.match(body):
        return "quote", m.end()
    if m := _ITEM.match(body):
        return "list", m.end()
    return "text", 0


def _continues(body: str) -> bool:
    """Whether a text line is indented by two columns or more, a tab as four."""
    return sum(4 if c == "\t" else 1 for c in _INDENT.match(body)[0]) >= 2


def parse(text: str) -> Tree:
    tree, lines = Tree(text), lines_of(text)
    bodies = [text[x.start : x.stop] for x in lines]
    kinds = [classify(b) for b in bodies]

    def emit(i: int, marker: int) -> None:
        line = lines[i]
        for tag, a, b in (("marker", line.start, line.start + marker), ("text", line.start + marker, line.stop), ("nl", line.stop, line.end)):
            if b > a:
                tree.leaf(tag, a, b)

    tree.open("doc", 0)
    i, n = 0, len(lines)
    while i < n:
        kind, size = kinds[i]
        line = lines[i]
        if kind == "blank":
            tree.leaf("blank", line.start, line.end)
            i += 1
        elif kind == "fence":
            i = _fence(tree, lines, bodies, kinds, i)
        elif kind == "heading":
            tree.open("heading", line.start)
            emit(i, size)
            tree.close()
            i += 1
        elif kind == "list":
            tree.open("list", line.start)
            while i < n and kinds[i][0] == "list":
                tree.open("item", lines[i].start)
                emit(i, kinds[i][1])
                i += 1
                while i < n and kinds[i][0] == "text" and _continues(bodies[i]):
                    emit(i, 0)
                    i += 1
                tree.close()
            tree.close()
        else:
            tree.open("quote" if kind == "quote" else "para", line.start)
            while i < n and kinds[i][0] == kind:
                emit(i, kinds[i][1])
                i += 1
            tree.close()
    tree.close()
    return tree


def _fence(tree: Tree, lines: list, bodies: list[str], kinds: list[tuple[str, int]], i: int) -> int:
    """A fence keeps its lines until a run at least as long as the one that opened it."""
    line, opened = lines[i], kinds[i][1]
    head = line.start + _FENCE_HEAD.match(bodies[i]).end()
    tree.open("fence", line.start)
    for tag, a, b in (("marker", line.start, head), ("info", head, line.stop), ("nl", line.stop, line.end)):
        if b > a:
            tree.leaf(tag, a, b)
    for j in range(i + 1, len(lines)):
        line = lines[j]
        if kinds[j][0] == "fence" and kinds[j][1] >= opened:
            tree.leaf("marker", line.start, line.stop)
            if line.end > line.stop:
                tree.leaf("nl", line.stop, line.end)
            tree.close()
            return j + 1
        tree.leaf("text", line.start, line.end)
    tree.error("unclosed-fence", "code fence is never closed", -1, severity="warning")
    tree.close()
    return len(lines)
