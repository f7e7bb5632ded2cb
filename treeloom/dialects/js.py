"""JavaScript as bracket groups; a slash is a division or a regular expression by what stands before it."""

from __future__ import annotations

import re

from .tree import Tree

MAX_DEPTH = 200
# Keywords and operators of the language.
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if "
    "import in instanceof let new null return static super switch this throw true try typeof var void while with yield async get set of".split()
)
VALUES = frozenset("this super true false null".split())
OPERATORS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> "
    "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . # @"
).split()

_STRING = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_TOKEN = re.compile(
    r"(?P<nl>\r\n|\r|\n)|(?P<ws>[ \t\f]+)|(?P<comment>//[^\r\n]*|/\*.*?(?:\*/|\Z))"
    rf"|(?P<str>{_STRING})|(?P<kw_or_name>[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*)"
    r"|(?P<num>0[xXoObB][0-9A-Fa-f_]*n?|(?=\.?[0-9])[0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?n?)"
    rf"|(?P<op>{'|'.join(map(re.escape, OPERATORS))}|.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*(?:\]|(?=\n)|\\?\Z)|[^/\\\n\[])*(?:/[A-Za-z0-9_\x80-\xff]*)?", re.DOTALL)
_IN_TEMPLATE = re.compile(rf"\\.|\$\{{|[{{}}`]|{_STRING}", re.DOTALL)
PAIRS = {"(": ")", "[": "]", "{": "}"}


def _template(text: str, at: int) -> int:
    """End of the template literal at ``at``, those nested in it included."""
    depths, i = [0], at + 1
    while i < len(text):
        m = _IN_TEMPLATE.search(text, i)
        if not m:
            return len(text)
        found, i = m[0], m.end()
        if found[0] in "\"'":
            if not depths[-1]:  # quotes are ordinary outside ${}
                i = m.start() + 1
        elif found == "`":
            if depths[-1]:
                depths.append(0)
            else:
                depths.pop()
                if not depths:
                    return i
        elif found == "${" or (found == "{" and depths[-1]):
            depths[-1] += 1
        elif found == "}" and depths[-1]:
            depths[-1] -= 1
    return len(text)


def tokens(text: str) -> list[tuple[str, int, int]]:
    out, at, value = [], 0, False  # value: the last significant token ends a value
    while at < len(text):
        c = text[at]
        if c == "`":
            kind, stop = "template", _template(text, at)
        elif c == "/" and not value and text[at + 1 : at + 2] not in ("/", "*"):
            kind, stop = "regex", _REGEX.match(text, at).end()
        else:
            m = _TOKEN.match(text, at)
            kind, stop = m.lastgroup, m.end()
            if kind == "kw_or_name":
                kind = "kw" if m[0] in KEYWORDS else "name"
        if kind not in ("nl", "ws", "comment"):
            raw = text[at:stop]
            value = raw in VALUES if kind == "kw" else raw in (")", "]") if kind == "op" else True
        out.append((kind, at, stop))
        at = stop
    return out


def parse(text: str) -> Tree:
    tree = Tree(text)
    tree.open("program", 0)
    wanted: list[tuple[str, str]] = []  # opener and closer of the open groups
    for kind, start, stop in tokens(text):
        raw = text[start:stop] if kind == "op" else ""
        if raw in PAIRS and len(wanted) <= MAX_DEPTH:
            tree.open("group", start)
            wanted.append((raw, PAIRS[raw]))
        elif raw in (")", "]", "}"):
            while wanted and wanted[-1][1] != raw:
                tree.error("mismatched-close", f"expected '{wanted[-1][1]}' but found '{raw}'", start)
                wanted.pop()
                tree.close()
            if wanted:
                wanted.pop()
                tree.leaf("op", start, stop)
                tree.close()
                continue
            tree.error("unmatched-close", f"'{raw}' closes nothing", start)
        tree.leaf(kind, start, stop)
    while wanted:
        tree.error("unclosed-group", f"'{wanted.pop()[0]}' is never closed", len(text))
        tree.close()
    tree.close()
    return tree
