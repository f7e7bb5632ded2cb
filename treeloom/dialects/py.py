"""Python as logical lines and indented blocks."""

from __future__ import annotations

import re

from .tree import Tree

# Keywords and operators of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield match case".split()
)
OPERATORS = "**= //= >>= <<= ... != >= <= == -> := ** // >> << += -= *= /= %= &= |= ^= @= ~= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()

_STRING = (
    r'(?:"""(?:\\.|(?!""").)*(?:"""|\\?\Z)|' r"'''(?:\\.|(?!''').)*(?:'''|\\?\Z)|" r'"(?:\\.|[^"\\\n])*(?:"|\\?\Z|(?=\n))|' r"'(?:\\.|[^'\\\n])*(?:'|\\?\Z|(?=\n)))"
)
_TOKEN = re.compile(
    r"(?P<cont>\\\r?\n)|(?P<nl>\r\n|\r|\n)|(?P<ws>[ \t\f]+)|(?P<comment>\#[^\r\n]*)"
    rf"|(?P<str>(?:[rR][bBfF]?|[bB][rRfF]?|[fF][rRbB]?|[uU])?{_STRING})|(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"
    r"|(?P<num>0[xXoObB][0-9A-Fa-f_]*|(?=\.?[0-9])[0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9][0-9_]*)?[jJ]?)"
    rf"|(?P<op>{'|'.join(map(re.escape, OPERATORS))}|.)",
    re.DOTALL,
)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Line ends inside brackets are white space."""
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "op":
            if m[0] in "([{":
                depth += 1
            elif m[0] in ")]}":
                depth = max(0, depth - 1)
        elif kind == "nl" and depth:
            kind = "ws"
        elif kind == "name" and m[0] in KEYWORDS:
            kind = "kw"
        out.append((kind, m.start(), m.end()))
    return out


def indent_width(raw: str) -> int:
    """Columns of leading white space; a tab goes on to the next multiple of 8."""
    width = 0
    for c in raw:
        if c == "\t":
            width += 8 - width % 8
        elif c == " ":
            width += 1
    return width


def logical_lines(text: str) -> list[tuple[list[tuple[str, int, int]], int | None]]:
    """Tokens of each logical line, and its indent; None for one without a statement."""
    out, line = [], []
    for token in tokens(text):
        line.append(token)
        if token[0] == "nl":
            out.append(line)
            line = []
    if line:
        out.append(line)
    found = []
    for line in out:
        first = line[0][0] == "ws"
        width = indent_width(text[line[0][1] : line[0][2]]) if first else 0
        rest = line[1][0] if first and len(line) > 1 else "nl" if first else line[0][0]
        found.append((line, None if rest in ("nl", "comment") else width))
    return found


def parse(text: str) -> Tree:
    tree = Tree(text)
    tree.open("module", 0)
    lines = logical_lines(text)
    following: list[int | None] = [None] * len(lines)  # indent of the next statement
    ahead = None
    for i in range(len(lines) - 1, -1, -1):
        following[i] = ahead
        if lines[i][1] is not None:
            ahead = lines[i][1]
    levels = [0]
    for (line, indent), after in zip(lines, following, strict=True):
        if indent is None:
            for token in line:
                tree.leaf(*token)
            continue
        while indent < levels[-1]:
            levels.pop()
            tree.close()  # block
            tree.close()  # its statement
        if indent > levels[-1]:
            tree.error("unexpected-indent", "unexpected indentation", line[0][1])
        tree.open("stmt", line[0][1])
        for token in line:
            tree.leaf(*token)
        if after is not None and after > levels[-1]:
            tree.open("block", line[-1][2])
            levels.append(after)
        else:
            tree.close()
    while len(levels) > 1:
        levels.pop()
        tree.close()
        tree.close()
    tree.close()
    return tree
