"""JSON text, permissively: every byte is kept, junk included."""

from __future__ import annotations

import re

from .tree import Tree

MAX_DEPTH = 300
_TOKEN = re.compile(
    r'(?P<ws>[ \t\r\n\f]+)|(?P<str>"(?:\\.|[^"\\])*(?:"|\\?\Z))|(?P<num>(?:[+-]|(?=[0-9]))[0-9]*(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?)'
    r"|(?P<lit>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)|(?P<lbrace>\{)|(?P<rbrace>\})|(?P<lbracket>\[)|(?P<rbracket>\])|(?P<colon>:)|(?P<comma>,)|(?P<raw>.)",
    re.DOTALL,
)
_MARKS = frozenset("lbrace rbrace lbracket rbracket colon comma".split())


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]


def parse(text: str) -> Tree:
    tree, toks = Tree(text), tokens(text)
    tree.open("doc", 0)

    def emit(i: int) -> None:
        kind, start, stop = toks[i]
        if kind in _MARKS:
            tree.mark(kind, start)
        else:
            tree.leaf(kind, start, stop)

    # What is open: "object", "array" and, between key and value, "member".
    stack: list[str] = []
    nested = 0  # objects and arrays
    i = 0
    while True:
        kind = toks[i][0] if i < len(toks) else "eof"
        top = stack[-1] if stack else ""
        if kind == "eof":
            if not stack:
                break
            if top != "member":
                tree.error("unclosed-" + top, "'{' is never closed" if top == "object" else "'[' is never closed", len(text))
                nested -= 1
            stack.pop()
            tree.close()
            continue
        if top == "object":
            if kind in ("rbrace", "ws", "comma"):
                emit(i)
                i += 1
                if kind == "rbrace":
                    stack.pop()
                    nested -= 1
                    tree.close()
                    _leave_member(tree, stack)
                continue
            tree.open("member", toks[i][1])
            emit(i)
            i += 1
            while i < len(toks) and toks[i][0] == "ws":
                emit(i)
                i += 1
            if i < len(toks) and toks[i][0] == "colon":
                emit(i)
                i += 1
            else:
                tree.error("expected-colon", "expected ':' after object key", toks[i][1] if i < len(toks) else len(text))
            stack.append("member")
            continue
        if top == "array" and kind in ("rbracket", "comma"):
            emit(i)
            i += 1
            if kind == "rbracket":
                stack.pop()
                nested -= 1
                tree.close()
                _leave_member(tree, stack)
            continue
        if kind == "ws":
            emit(i)
            i += 1
            continue
        if kind in ("lbrace", "lbracket") and nested < MAX_DEPTH:
            stack.append("object" if kind == "lbrace" else "array")
            nested += 1
            tree.open(stack[-1], toks[i][1])
            emit(i)
            i += 1
            continue
        emit(i)
        i += 1
        _leave_member(tree, stack)
    tree.close()
    return tree


def _leave_member(tree: Tree, stack: list[str]) -> None:
    """A value has ended, and with it the member that it is of."""
    if stack and stack[-1] == "member":
        stack.pop()
        tree.close()
