"""The CSS value-definition syntax: alternatives, any-order and all-of groups, juxtaposition, multipliers."""

from __future__ import annotations

import re

from .tree import Tree

MAX_DEPTH = 200
_WORD = r"[A-Za-z0-9_\x80-\xff]"
_TOKEN = re.compile(
    rf"(?P<ws>[ \t\r\n\f]+)|(?P<angle><)|(?P<str>\"[^\"]*\"?|'[^']*'?)|(?P<any>\|\|)|(?P<alt>\|)|(?P<all>&&)"
    r"|(?P<lbracket>\[)|(?P<rbracket>\])|(?P<lparen>\()|(?P<rparen>\))|(?P<range>\{(?=[ ,]*[0-9])[0-9, ]*\})|(?P<lbrace>\{)|(?P<rbrace>\})"
    rf"|(?P<mult>[?\#!])|(?P<sign>[+*])|(?P<num>[0-9][0-9.]*)|(?P<kw>[A-Za-z_\x80-\xff\-@.:](?:{_WORD}|[-.:])*)|(?P<lit>.)",
    re.DOTALL,
)
_ANGLE_PART = re.compile(r"[\[\]>]")
_OPEN = {"lbracket": ("group", "rbracket"), "lparen": ("paren", "rparen"), "lbrace": ("block", "rbrace"), "fname": ("fn", "rparen")}
_CLOSE = frozenset(("rbracket", "rparen", "rbrace"))
#: After these a ``+`` or ``*`` multiplies.
_ENDS = frozenset(("type", "propref", "kw", "str", "num", "rbracket", "rparen", "rbrace", "mult", "range"))
_LEVELS = (("alt", "alt"), ("any", "any"), ("all", "all"))
_LEAF = {"any": "op", "alt": "op", "all": "op", **dict.fromkeys(("lbracket", "rbracket", "lparen", "rparen", "lbrace", "rbrace"), "lit")}


def _angle(text: str, at: int) -> int:
    depth, i = 0, at + 1
    while m := _ANGLE_PART.search(text, i):
        i = m.end()
        if m[0] == "[":
            depth += 1
        elif m[0] == "]":
            depth = max(0, depth - 1)
        elif not depth:
            return i
    return len(text)


def tokens(text: str) -> list[tuple[str, int, int]]:
    out, at, ended = [], 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, stop = m.lastgroup, m.end()
        if kind == "angle":
            kind, stop = "propref" if text.startswith("'", at + 1) else "type", _angle(text, at)
        elif kind == "sign":
            kind = "mult" if ended else "lit"
        elif kind == "kw" and text.startswith("(", stop):
            kind, stop = "fname", stop + 1
        if kind != "ws":
            ended = kind in _ENDS
        out.append((kind, at, stop))
        at = stop
    return out


class _Vds:
    def __init__(self, text: str) -> None:
        self.tree, self.toks = Tree(text), tokens(text)
        # One stack pass pairs brackets: any closer closes the innermost opener.
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for i, (kind, _, _) in enumerate(self.toks):
            if kind in _OPEN:
                opened.append(i)
            elif kind in _CLOSE and opened:
                self.partner[opened.pop()] = i

    def close_of(self, i: int, hi: int) -> int:
        return min(self.partner.get(i, hi), hi)

    def atom_end(self, i: int, hi: int) -> int:
        return min(self.close_of(i, hi) + 1, hi) if self.toks[i][0] in _OPEN else i + 1

    def component_end(self, i: int, hi: int) -> int:
        i = self.atom_end(i, hi)
        while i < hi and self.toks[i][0] in ("mult", "range"):
            i += 1
        return i

    def cuts(self, lo: int, hi: int, op: str) -> list[int]:
        """Places of an operator outside brackets."""
        out, i = [], lo
        while i < hi:
            if self.toks[i][0] == op:
                out.append(i)
            i = self.atom_end(i, hi)
        return out

    def level(self, lo: int, hi: int, depth: int, rank: int = 0) -> None:
        """A run of tokens at one binding strength, split by its operator if it has any."""
        if rank == 0 and lo >= hi:
            return
        if rank == len(_LEVELS):
            self.juxtaposed(lo, hi, depth)
            return
        op, tag = _LEVELS[rank]
        cuts = self.cuts(lo, hi, op)
        if not cuts:
            self.level(lo, hi, depth, rank + 1)
            return
        self.tree.open(tag, self.toks[lo][1] if lo < hi else self.toks[cuts[0]][1])
        for cut in cuts:
            self.level(lo, cut, depth, rank + 1)
            self.tree.leaf("op", *self.toks[cut][1:])
            lo = cut + 1
        self.level(lo, hi, depth, rank + 1)
        self.tree.close()

    def juxtaposed(self, lo: int, hi: int, depth: int) -> None:
        parts, i = [], lo
        while i < hi:
            stray = self.toks[i][0] == "ws" or self.toks[i][0] in _CLOSE or self.toks[i][0] in ("mult", "range")
            end = i + 1 if stray else max(i + 1, self.component_end(i, hi))
            parts.append((i, end, stray))
            i = end
        wrap = sum(not stray for _, _, stray in parts) > 1
        if wrap:
            self.tree.open("juxta", self.toks[lo][1])
        for i, _, stray in parts:
            if stray:
                self.flat(i, i + 1)
            else:
                self.component(i, hi, depth)
        if wrap:
            self.tree.close()

    def flat(self, lo: int, hi: int) -> None:
        for kind, start, stop in self.toks[lo:hi]:
            self.tree.leaf(_LEAF.get(kind, kind), start, stop)

    def component(self, i: int, hi: int, depth: int) -> None:
        tree, (kind, start, _) = self.tree, self.toks[i]
        atom, end = self.atom_end(i, hi), self.component_end(i, hi)
        if end > atom:
            tree.open("comp", start)
        if kind in _OPEN:
            close = self.close_of(i, hi)
            tree.open(_OPEN[kind][0], start)
            if kind == "fname":
                tree.leaf("fname", *self.toks[i][1:])
            else:
                tree.mark(kind, start)
            if depth < MAX_DEPTH:
                self.level(i + 1, close, depth + 1)
            else:
                self.flat(i + 1, close)
            if close < hi:
                tree.mark(self.toks[close][0], self.toks[close][1])
            else:
                tree.error("unclosed-group", "group is never closed", start)
            tree.close()
        else:
            self.flat(i, i + 1)
        self.flat(atom, end)
        if end > atom:
            tree.close()


def parse(text: str) -> Tree:
    import sys

    vds = _Vds(text)
    vds.tree.open("vds", 0)
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 8000))  # MAX_DEPTH levels take six calls each
        vds.level(0, len(vds.toks), 0)
    finally:
        sys.setrecursionlimit(limit)
    vds.tree.close()
    return vds.tree
