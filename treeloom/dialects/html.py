"""HTML pages: tags, attributes, raw-text elements and an open-element stack."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

from .tree import SPACE, Diagnostic, Tree

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title".split())
OPTIONAL_END = frozenset("p li dt dd td th tr tbody thead tfoot option optgroup caption colgroup html head body rt rp".split())

_IN_TAG = re.compile(
    r"""(?P<ws>[ \t\r\n\f]+)|(?P<gt>>)|(?P<selfclose>/(?=>))|(?P<eq>=)|(?P<quoted>"[^"]*"?|'[^']*'?)|(?P<word>(?:(?!/>)[^ \t\r\n\f>="'])+)""",
    re.DOTALL,
)
_CONTENT = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<cdata><!\[CDATA\[.*?(?:\]\]>|\Z))|(?P<doctype><![^>]*>?)|(?P<pi><\?[^>]*>?)|(?P<end></)|(?P<start><(?=[A-Za-z\x80-\xff]))|(?P<text><?[^<]*)",
    re.DOTALL,
)


def lower(name: str) -> str:
    """ASCII letters in lower case."""
    return name.lower() if name.isascii() else name.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


@lru_cache(256)
def _raw_end(name: str) -> re.Pattern:
    """Where the text of a raw-text element ends."""
    return re.compile(f"</{re.escape(name)}(?=[> \\t\\r\\n\\f/\\0]|\\Z)", re.IGNORECASE | re.ASCII)


def tokens(text: str, at: int = 0, size: int | None = None, raw_until: str = "", raw: dict[int, str] | None = None, in_tag: bool = False, sought: int = 0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all tokens; they cover the text without gaps.

    The text may be read up to ``size``, as if it ended there, and from a place
    ``at`` outside tags on, where the raw-text element ``raw_until`` is open, or
    from a place ``in_tag`` behind the tag's name.  The end of raw text is
    ``sought`` from a place on.  ``raw`` gets places and raw-text elements.
    """
    out: list[tuple[str, int, int]] = []
    size = len(text) if size is None else size
    starting, named, closed, pending = False, True, False, ""
    while at < size:
        if raw_until:
            m = _raw_end(raw_until).search(text, max(at, sought), size)
            stop = m.start() if m else size
            if stop > at:
                out.append(("text", at, stop))
            at, raw_until = stop, ""
            if m:
                out.append(("ltslash", at, at + 2))
                at += 2
                in_tag, starting, named, closed, pending = True, False, False, False, ""
            continue
        if in_tag:
            m = _IN_TAG.match(text, at, size)
            kind = m.lastgroup if m else "word"
            stop = m.end() if m else at + 1
            if kind == "word" and not named:
                kind, named = "name", True
                if starting and lower(text[at:stop]) in RAW_TEXT:
                    pending = text[at:stop]
            elif kind in ("ws", "eq", "quoted"):
                named = True
            elif kind == "selfclose":
                closed = True
            elif kind == "gt":
                in_tag = False
                if pending and not closed:
                    raw_until = pending
                    if raw is not None:
                        raw[stop] = pending
                pending = ""
            out.append((kind, at, stop))
        else:
            m = _CONTENT.match(text, at, size)
            kind, stop = m.lastgroup, m.end()
            if kind in ("start", "end"):
                starting = kind == "start"
                stop = at + 1 + (not starting)
                in_tag, named, closed, pending = True, False, False, ""
                kind = "lt" if starting else "ltslash"
            out.append((kind, at, stop))
        at = stop
    return out


class _Stack:
    """Open elements: names, as written and in lower case, and offsets."""

    def __init__(self, rows: Iterable[tuple[str, str, int]] = ()) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.count: dict[str, int] = {}  # of each name, so that none is sought that is not open
        for row in rows:
            self.push(row)

    def push(self, row: tuple[str, str, int]) -> None:
        self.rows.append(row)
        self.count[row[1]] = self.count.get(row[1], 0) + 1

    def above(self, wanted: str) -> int:
        """How many elements end with the innermost one of a name, itself included."""
        if not self.count.get(wanted):
            return 0
        return next(n for n, row in enumerate(reversed(self.rows), 1) if row[1] == wanted)

    def pop(self) -> tuple[str, str, int]:
        row = self.rows.pop()
        self.count[row[1]] -= 1
        return row


def parse(text: str) -> Tree:
    tree, toks, stack = Tree(text), tokens(text), _Stack()
    tree.open("doc", 0)
    _items(tree, toks, 0, len(toks), stack, len(text))
    _finish(tree, stack, len(text))
    return tree


#: No token is decided by more than so many characters behind its end.
AHEAD = 2


def prefixes(text: str, sizes: Iterable[int]) -> Iterator[tuple[Tree, int]]:
    """The trees that :func:`parse` makes of ``text[:size]``, for ascending sizes.

    What all prefixes from some size on begin with, whole tags and what stands
    between them, is read and parsed once; behind it each prefix is read and
    parsed to its own end.  The number is that of the first node that is not
    kept.  The tree is the same object each time, over the whole text, and
    holds a prefix until the next is asked for.
    """
    tree, stack, raw = Tree(text), _Stack(), {}
    toks = tokens(text, raw=raw)
    tree.open("doc", 0)
    i = until = at = 0
    after, stop = _item(toks, 0, False)
    kept = tree.state()
    for size in sizes:
        size = min(size, len(text))
        while stop + AHEAD <= size:
            until, at = after, stop
            after, stop = _item(toks, until, at in raw)
        if i < until:
            _items(tree, toks, i, until, stack, len(text))
            i, kept = until, tree.state()
        opened = _Stack(stack.rows)
        rest = tokens(text, at, size, raw.get(at, ""))
        _items(tree, rest, 0, len(rest), opened, size)
        _finish(tree, opened, size)
        yield tree, kept[0]
        tree.back(kept)


def _item(toks: list, i: int, raw: bool) -> tuple[int, int]:
    """The token behind a whole tag, or what stands between tags, and its place; raw text goes with the end tag that ends it."""
    if i >= len(toks):
        return i, toks[-1][2] if toks else 0
    if raw and toks[i][0] == "text" and i + 1 < len(toks):
        i += 1
    if toks[i][0] in ("lt", "ltslash"):
        while i + 1 < len(toks) and toks[i][0] != "gt":
            i += 1
    return i + 1, toks[i][2]


#: Tokens that grow with the prefix that ends in them, from so many characters on by nothing but their end; those of ENDED are different again with their last character.
GROWING = {"text": 1, "ws": 1, "name": 1, "word": 1, "quoted": 1, "doctype": 2, "pi": 2, "comment": 4, "cdata": 9}
ENDED = frozenset(["quoted", "doctype", "pi", "comment", "cdata"])


def _runs(text: str, toks: list, raw: dict[int, str]) -> Iterator[tuple[int, int]]:
    """The first and the last of sizes between which a prefix grows by the end of its last token alone; every size is in one run."""
    yield 0, 0
    ending = ""
    for kind, start, stop in toks:
        ending = raw.get(start, ending)
        if kind == "text" and start in raw:  # a prefix that ends with what may be the end tag is read as if it were
            cuts = [m.end() for m in re.compile(f"</{re.escape(ending)}", re.IGNORECASE | re.ASCII).finditer(text, start, stop)]
            least = start + 1
            for cut in cuts:
                if least < cut:
                    yield least, cut - 1
                yield cut, cut
                least = cut + 1
            if least <= stop:
                yield least, stop
            continue
        if stop == start + 1:
            yield stop, stop
            continue
        grows = GROWING.get(kind, stop - start)
        if kind == "name" and ending:
            grows, ending = len(ending) + 1, ""
        least = min(start + grows, stop)
        for size in range(start + 1, least):
            yield size, size
        if kind in ENDED and least < stop:
            yield least, stop - 1
            least = stop
        yield least, stop


def growing(text: str) -> Iterator[tuple[Tree, int, int, int]]:
    """The nodes of the prefixes of every size: (tree, kept, first, last).

    The tree has the nodes, with their tags and spans, of ``text[:last]``; those
    of prefixes from ``first`` on are the same, but that the last leaf ends with
    the prefix.  The number ``kept`` is that of the first node that is not kept
    for what follows.  Open elements are not closed at the end of a prefix, which
    adds no nodes.  A prefix is read and parsed from the tag, the part of a tag or
    the text on that it ends in, so the time does not grow with the square of the
    text, of a tag or of the depth.
    """
    tree, stack, raw = Tree(text), _Stack(), {}
    toks = tokens(text, raw=raw)
    tree.open("doc", 0)
    i = at = 0
    tag: _Tag | None = None
    after, until, ready = _unit(toks, 0, tag, raw)
    for first, last in _runs(text, toks, raw):
        while ready <= last:
            while i < after:
                i, tag = _step(tree, toks, i, stack, tag, len(text))
            at = toks[i - 1][2]
            after, until, ready = _unit(toks, i, tag, raw)
        if at == last:
            yield tree, len(tree.ends), first, last
            continue
        here = None if last == until else tree.here()  # what is whole stays
        ending, nodes, elements = raw.get(at), (), ()
        # What is left has no ">" of a tag, so no elements are closed but by the head of an end tag.
        if tag is None and not ending and (m := _CONTENT.match(text, at, last)).end() == last and m.lastgroup in LEAVES:
            tree.leaf(m.lastgroup, at, last)
            tail = None
        else:
            sought = min(toks[i][2], last - len(ending) - 2) if ending and toks[i][0] == "text" else at
            rest = tokens(text, at, last, ending or "", in_tag=tag is not None, sought=sought)
            closed = 0 if here is None or tag is not None or len(rest) == 1 else _closed(text, rest, stack)
            if closed:
                nodes, elements = tree.innermost(closed), stack.rows[-closed:]
            j, tail, many = 0, tag, len(rest)
            while j < many:
                j, tail = _step(tree, rest, j, stack, tail, last)
        if here is None:
            i, at, tag = after, last, tail
            after, until, ready = _unit(toks, i, tag, raw)
            yield tree, len(tree.ends), first, last
            continue
        yield tree, here[0], first, last
        tree.cut(here, nodes)
        for row in elements:
            stack.push(row)


#: A tag that is open.  Of a start tag: that it is one, whether it closes itself, the element's name and place; of an end tag: that it is none, whether it ends an element.
_Tag = tuple[bool, bool, str, int]


def _step(tree: Tree, toks: list, i: int, stack: _Stack, tag: _Tag | None, size: int) -> tuple[int, _Tag | None]:
    """Parse the head of a tag, a part of one, or what stands between tags."""
    what, start, stop = toks[i]
    if tag is None:
        if what == "lt":
            tree.open("elem", start)
            i, name = _start_head(tree, toks, i)
            return i, (True, False, name, start)
        if what == "ltslash":
            i, ends = _end_head(tree, toks, i, stack)
            return i, (False, ends, "", start)
        tree.leaf(what if what in LEAVES else "op", start, stop)
        return i + 1, None
    starts, whole, name, at = tag
    if what != "gt":
        if starts:
            return _start_part(tree, toks, i, size), (True, True, name, at) if what == "selfclose" else tag
        tree.leaf("ws" if what == "ws" else "op", start, stop)
        return i + 1, tag
    tree.mark("gt", start)
    tree.close()
    if starts:
        _started(tree, stack, name, whole, at)
    elif whole:
        tree.close()
        stack.pop()
    return i + 1, None


def _unit(toks: list, i: int, tag: _Tag | None, raw: dict[int, str]) -> tuple[int, float, float]:
    """What :func:`_step` parses at once, raw text with the head of the end tag that ends it.

    The token behind it, the size of the prefix that ends with it, if longer ones
    have the same tokens, and the size from which on they have.
    """
    if i >= len(toks):
        return i, inf, inf
    kind, start, stop = toks[i]
    if tag is None:
        if kind == "text" and start in raw and i + 1 < len(toks):
            i += 1
        after = i + 2 if toks[i][0] in HEADS and i + 1 < len(toks) and toks[i + 1][0] == "name" else i + 1
    elif kind == "gt":
        return i + 1, stop, stop
    else:
        after = _attribute_end(toks, i) if tag[0] and kind in ("word", "quoted") else i + 1
    stop = toks[after - 1][2]
    if after < len(toks) and toks[after][0] == "selfclose":
        return after, inf, stop + AHEAD  # a slash that a prefix ends with is of the token before
    return after, stop, stop + 1


def _attribute_end(toks: list, i: int) -> int:
    """The token behind an attribute."""
    j = i + 1
    if j < len(toks) and toks[j][0] == "ws":
        j += 1
    if j >= len(toks) or toks[j][0] != "eq":
        return i + 1
    j += 1
    if j < len(toks) and toks[j][0] == "ws":
        j += 1
    return j + 1 if j < len(toks) and toks[j][0] in ("word", "quoted") else j


def _closed(text: str, toks: list, stack: _Stack) -> int:
    """How many open elements the head of an end tag closes, if there is one among a few tokens; the element that it ends is still open."""
    for i in range(len(toks) - 1):
        if toks[i][0] == "ltslash" and toks[i + 1][0] == "name":
            return max(0, stack.above(lower(text[toks[i + 1][1] : toks[i + 1][2]])) - 1)
    return 0


#: Tokens that begin tags.
HEADS = frozenset(["lt", "ltslash"])
#: Tokens between tags that are nodes of the same name.
LEAVES = frozenset(["text", "comment", "doctype", "cdata", "pi"])


def _items(tree: Tree, toks: list, i: int, until: int, stack: _Stack, size: int) -> None:
    """Parse tags and what stands between them."""
    while i < until:
        what, start, stop = toks[i]
        if what == "lt":
            tree.open("elem", start)
            i, name, alone = _start_tag(tree, toks, i, size)
            _started(tree, stack, name, alone, start)
        elif what == "ltslash":
            i, ends = _end_head(tree, toks, i, stack)
            i = _end_rest(tree, toks, i)
            if ends:
                tree.close()
                stack.pop()
        else:
            tree.leaf(what if what in LEAVES else "op", start, stop)
            i += 1


def _started(tree: Tree, stack: _Stack, name: str, alone: bool, start: int) -> None:
    """An element is open behind its start tag, or is whole."""
    wanted = lower(name)
    if alone or not name or wanted in VOID:
        tree.close()
    else:
        stack.push((name, wanted, start))


def _unclosed(tree: Tree, left: Iterable[tuple[str, str, int]], now: int) -> None:
    """Elements, from the innermost on, end without end tags of their own."""
    for name, wanted, opened in left:
        if wanted not in OPTIONAL_END:
            tree.diagnostics.append(Diagnostic("unclosed-element", f"<{name}> is never closed", opened, "error", len(name) + 1, f"insert </{name}>", "still open here", now))


def _finish(tree: Tree, stack: _Stack, size: int) -> None:
    _unclosed(tree, reversed(stack.rows), size)
    tree.close_all()


def _start_tag(tree: Tree, toks: list, i: int, size: int) -> tuple[int, str, bool]:
    """Parse from ``<`` on; the next token, the element's name, and whether it closes itself."""
    alone = False
    i, name = _start_head(tree, toks, i)
    while True:
        if i >= len(toks):
            tree.error("unclosed-tag", "start tag is not closed before end of input", size)
            break
        what, start, _ = toks[i]
        if what == "gt":
            tree.mark("gt", start)
            i += 1
            break
        alone = alone or what == "selfclose"
        i = _start_part(tree, toks, i, size)
    tree.close()
    return i, name, alone


def _start_head(tree: Tree, toks: list, i: int) -> tuple[int, str]:
    """Open a start tag; the token behind its name, and the name."""
    name = ""
    tree.open("stag", toks[i][1])
    tree.mark("lt", toks[i][1])
    i += 1
    if i < len(toks) and toks[i][0] == "name":
        name = tree.text[toks[i][1] : toks[i][2]]
        tree.leaf("name", *toks[i][1:])
        i += 1
    return i, name


def _start_part(tree: Tree, toks: list, i: int, size: int) -> int:
    """An attribute or what else stands in a start tag before its end."""
    what, start, stop = toks[i]
    if what in ("word", "quoted"):
        return _attribute(tree, toks, i, size)
    if what == "selfclose":
        tree.mark("selfclose", start)
    else:
        tree.leaf("ws" if what == "ws" else "op", start, stop)
    return i + 1


def _attribute(tree: Tree, toks: list, i: int, size: int) -> int:
    tree.open("attr", toks[i][1])
    tree.leaf("aname", *toks[i][1:])
    i += 1
    j = i
    while j < len(toks) and toks[j][0] == "ws":
        j += 1
    if j < len(toks) and toks[j][0] == "eq":
        for k in range(i, j):
            tree.leaf("ws", *toks[k][1:])
        tree.mark("eq", toks[j][1])
        i = j + 1
        while i < len(toks) and toks[i][0] == "ws":
            tree.leaf("ws", *toks[i][1:])
            i += 1
        if i < len(toks) and toks[i][0] in ("word", "quoted"):
            tree.leaf("aval", *toks[i][1:])
            i += 1
        else:
            tree.error("missing-attr-value", "'=' with no attribute value", toks[i][1] if i < len(toks) else size)
    tree.close()
    return i


def _end_head(tree: Tree, toks: list, i: int, stack: _Stack) -> tuple[int, bool]:
    """Open an end tag, when what is open in its element is closed; the token behind its name, and whether it has an element."""
    start, name = toks[i][1], tree.text[toks[i + 1][1] : toks[i + 1][2]] if i + 1 < len(toks) and toks[i + 1][0] == "name" else ""
    above = stack.above(lower(name))
    if not above:
        tree.error("stray-end-tag", f"end tag </{name}> matches no open element", start)
    for _ in range(above - 1):
        _unclosed(tree, [stack.pop()], start)
        tree.close()
    tree.open("etag", start)
    tree.mark("ltslash", start)
    i += 1
    if i < len(toks) and toks[i][0] == "name":
        tree.leaf("name", *toks[i][1:])
        i += 1
    return i, above > 0


def _end_rest(tree: Tree, toks: list, i: int) -> int:
    while i < len(toks):
        what, start, stop = toks[i]
        i += 1
        if what == "gt":
            tree.mark("gt", start)
            break
        tree.leaf("ws" if what == "ws" else "op", start, stop)
    tree.close()
    return i


__all__ = ["OPTIONAL_END", "RAW_TEXT", "SPACE", "VOID", "growing", "lower", "parse", "prefixes", "tokens"]
