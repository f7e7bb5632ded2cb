"""What a parser's map can say of a node from what stands around it, so that no query has to join a node table with itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from .tree import Tree

#: Of a tree, a function of a node's number.
Context = Callable[[Tree], Callable[[int], str | int | None]]
_WHITE = re.compile("[ \t\n\r\f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def children(tree: Tree, node: int) -> Iterator[int]:
    child = node + 1
    while child < tree.ends[node]:
        yield child
        child = tree.ends[child]


def innermost(tree: Tree, node: int, tags: tuple[str, ...]) -> int:
    """The node itself if it has one of ``tags``, else the innermost such node around it, or -1."""
    while node >= 0 and tree.tags[node] not in tags:
        node = tree.parents[node]
    return node


def _utf8(tree: Tree, node: int) -> str:
    span = tree.spans[node]
    raw = tree.made.get(node, "") if span is None else tree.text[span[0] : span[1]]
    return raw.encode("latin-1").decode("utf-8", "replace")


def parent_tag(tree: Tree) -> Callable[[int], str | None]:
    return lambda node: tree.tags[tree.parents[node]] if tree.parents[node] >= 0 else None


def around(*tags: str) -> Context:
    """Number of the innermost node of ``tags`` around a node, itself included."""

    def of(tree: Tree) -> Callable[[int], int | None]:
        return lambda node: None if (at := innermost(tree, node, tags)) < 0 else at

    return of


def first_child(tag: str, *path: str, lower: bool = False, trim: bool = False) -> Context:
    """Text of the first leaf that ``path`` of tags leads to from the innermost ``tag`` around a node; null without one."""

    def of(tree: Tree) -> Callable[[int], str | None]:
        def text(node: int) -> str | None:
            at = innermost(tree, node, (tag,))
            for step in path:
                if at < 0:
                    return None
                at = next((c for c in children(tree, at) if tree.tags[c] == step), -1)
            if at < 0:
                return None
            found = _utf8(tree, at)
            return found.translate(_LOWER) if lower else found.strip(" ") if trim else found

        return text

    return of


def joined(tag: str, part: str) -> Context:
    """Text of the first ``part`` of the innermost ``tag`` around a node, without comments, white space as single spaces; empty without one."""

    def of(tree: Tree) -> Callable[[int], str]:
        def text(node: int) -> str:
            at = innermost(tree, node, (tag,))
            at = next((c for c in children(tree, at) if tree.tags[c] == part), -1) if at >= 0 else -1
            if at < 0:
                return ""
            spans = ((tree.spans[i], tree.tags[i]) for i in range(at, tree.ends[at]))
            raw = "".join(tree.text[s[0] : s[1]] for s, kind in spans if s is not None and kind != "comment")
            return _WHITE.sub(" ", raw.encode("latin-1").decode("utf-8", "replace")).strip(" ")

        return text

    return of


def after_start_tag(tree: Tree) -> Callable[[int], str | None]:
    """Name of the start tag that comes right before a text, of tags and texts."""

    def name(node: int) -> str | None:
        before = next((i for i in range(node - 1, -1, -1) if tree.tags[i] in ("stag", "etag", "text")), -1)
        return _STAG_NAME(tree)(before) if before >= 0 and tree.tags[before] == "stag" else None

    return name


_STAG_NAME = first_child("stag", "name", lower=True)
ELEMENT = first_child("elem", "stag", "name", lower=True)
TAG_NAME = _STAG_NAME
