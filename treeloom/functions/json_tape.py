"""A strict RFC 8259 reader: a document becomes a flat tape of values in document order.

Keys are entries of their own.  A container's ``next`` is one past its last
descendant, so a subtree is a range and a sibling is one step away.  Strings
and numbers keep their spelling; they are decoded where they are asked for.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 512
_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:(\.)([0-9]+)?)?(?:([eE][+-]?)([0-9]+)?)?")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_PLAIN_KEY = re.compile(r'[ \t\r\n]*"([^"\\\x00-\x1f]*)"[ \t\r\n]*:')
_VALUE = re.compile(r'[ \t\r\n]*(?:"(?P<plain>[^"\\\x00-\x1f]*)"|(?P<whole>-?(?:0|[1-9][0-9]*))|(?P<word>true|false|null)|(?P<open>[\[{]))')
_AFTER = re.compile(r"[ \t\r\n]*([,\]}])")
_CLOSE = {"object": "}", "array": "]"}
_EMPTY = {kind: re.compile(rf"[ \t\r\n]*\{close}") for kind, close in _CLOSE.items()}
#: After the digits of an integer these make it another number, or a fault.
_GOES_ON = (".", "e", "E")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = re.compile(rb"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", re.DOTALL)


class JsonError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.message, self.at = message, at


class Entry(NamedTuple):
    kind: str  # object, array, string, int, float, true, false, null
    escaped: bool
    start: int
    size: int  # bytes of a scalar, pairs of an object, elements of an array
    next: int
    parent: int
    depth: int
    ordinal: int  # among the pairs or elements of its parent; -1 for the document's value
    is_key: bool
    key: int  # entry of the key, -1 without one


def _string(text: str, at: int) -> tuple[int, bool]:
    """End of the string that opens at ``at``, and whether it has escapes."""
    i, escaped = at + 1, False
    while True:
        i = _PLAIN.match(text, i).end()
        if i >= len(text):
            break
        c = text[i]
        if c == '"':
            return i + 1, escaped
        if c != "\\":
            raise JsonError("control character in string", i)
        escaped = True
        if i + 1 >= len(text):
            break
        if text[i + 1] == "u":
            if i + 5 >= len(text):
                raise JsonError("truncated \\u escape", i)
            if not all(h in "0123456789abcdefABCDEF" for h in text[i + 2 : i + 6]):
                raise JsonError("invalid \\u escape", i)
            i += 6
        elif text[i + 1] in '"\\/bfnrt':
            i += 2
        else:
            raise JsonError("invalid escape", i)
    raise JsonError("unterminated string", at)


def _number(text: str, at: int) -> tuple[int, str]:
    m = _NUMBER.match(text, at)
    if not m:
        raise JsonError("invalid number", at)
    if m[1] and not m[2]:
        raise JsonError("digit expected after '.'", m.end(1))
    if m[3] and not m[4]:
        raise JsonError("digit expected in exponent", m.end(3))
    return m.end(), "float" if m[1] or m[3] else "int"


def _key(text: str, at: int) -> tuple[int, int, bool, int]:
    """Start, end and escapes of a key, and where its value may begin; or the fault, where there is no key and colon."""
    at = _SPACE.match(text, at).end()
    found = text[at : at + 1]
    if found != '"':
        raise JsonError({"": "unexpected end of input", "}": "trailing comma"}.get(found, "a key string expected"), at)
    end, escaped = _string(text, at)
    colon = _SPACE.match(text, end).end()
    if text[colon : colon + 1] != ":":
        raise JsonError("':' expected" if colon < len(text) else "unexpected end of input", colon)
    return at + 1, end - 1, escaped, colon + 1


def _unusual(text: str, at: int) -> tuple[str, int, int, bool, int]:
    """Kind, start, end, escapes and what follows of a value that is not plain; or its fault."""
    at = _SPACE.match(text, at).end()
    if text.startswith('"', at):
        end, escaped = _string(text, at)
        return "string", at + 1, end - 1, escaped, end
    if at >= len(text):
        raise JsonError("unexpected end of input", at)
    if text[at] in "-0123456789":
        end, kind = _number(text, at)
        return kind, at, end, False, end
    raise JsonError("invalid literal" if text[at] in "tfn" else "a value expected", at)


def parse(text: str) -> list[Entry]:
    """The tape of a document given one character a byte; raises :class:`JsonError` at the first fault.

    A pattern takes a whole key with its colon, or a whole value; what follows a
    value closes containers until a comma asks for the next one.
    """
    rows: list[list] = []
    open_at: list[int] = []
    at = _SPACE.match(text).end()
    if at == len(text):
        raise JsonError("empty document", 0)
    holder: list | None = None  # the innermost open container
    while True:
        key, parent, depth = -1, open_at[-1] if open_at else -1, len(open_at)
        if holder is not None and holder[0] == "object":
            m = _PLAIN_KEY.match(text, at)
            start, end, escaped, at = (*m.span(1), False, m.end()) if m else _key(text, at)
            key = len(rows)
            rows.append(["string", escaped, start, end - start, key + 1, parent, depth, holder[3], True, -1])
        ordinal = -1
        if holder is not None:
            ordinal = holder[3]
        m = _VALUE.match(text, at)
        which = m.lastgroup if m else ""
        if which == "open":
            if depth >= MAX_DEPTH:
                raise JsonError(f"nesting deeper than {MAX_DEPTH}", m.start("open"))
            row = ["object" if m["open"] == "{" else "array", False, m.start("open"), 0, 0, parent, depth, ordinal, False, key]
            at = m.end()
            open_at.append(len(rows))
        else:
            if which == "plain":
                kind, (start, end), escaped, at = "string", m.span("plain"), False, m.end()
            elif which == "word":
                kind, (start, end), escaped, at = m["word"], m.span("word"), False, m.end()
            elif which == "whole" and text[m.end() : m.end() + 1] not in _GOES_ON:
                kind, (start, end), escaped, at = "int", m.span("whole"), False, m.end()
            else:
                kind, start, end, escaped, at = _unusual(text, at)
            row = [kind, escaped, start, end - start, len(rows) + 1, parent, depth, ordinal, False, key]
        if holder is not None:
            holder[3] += 1
        rows.append(row)
        if which == "open":
            holder = row
            if not _EMPTY[row[0]].match(text, at):
                continue
        while open_at:
            m = _AFTER.match(text, at)
            if not m:
                at = _SPACE.match(text, at).end()
                raise JsonError("',' or a close expected" if at < len(text) else "unexpected end of input", at)
            at = m.end()
            if m[1] == ",":
                break
            if m[1] != _CLOSE[holder[0]]:
                raise JsonError("mismatched close", at - 1)
            rows[open_at.pop()][4] = len(rows)
            holder = rows[open_at[-1]] if open_at else None
        else:
            at = _SPACE.match(text, at).end()
            if at < len(text):
                raise JsonError("trailing content after the document", at)
            return list(map(Entry._make, rows))


def _unescape(m: re.Match) -> bytes:
    raw = m[0]
    if raw[1:2] != b"u":
        return _ESCAPES.get(c := raw[1:].decode("latin-1"), c).encode("latin-1")
    first = int(raw[2:6], 16)
    if len(raw) == 12:
        return chr(0x10000 + ((first - 0xD800) << 10) + int(raw[8:12], 16) - 0xDC00).encode()
    return (chr(first) if not 0xD800 <= first < 0xE000 else "�").encode()


def lexeme(text: str, entry: Entry) -> bytes:
    """The spelling of a scalar: a string without its quotes and as escaped as it was."""
    return text[entry.start : entry.start + entry.size].encode("latin-1")


def decoded(text: str, entry: Entry) -> bytes:
    """The value of a string in UTF-8; a lone surrogate is U+FFFD.  No bytes for what is no string."""
    if entry.kind != "string":
        return b""
    raw = lexeme(text, entry)
    return _ESCAPE.sub(_unescape, raw) if entry.escaped else raw


_STEP = re.compile(r"\[([^\]]*)(\]?)|([^.\[]+)|\.")


def path_steps(path: str) -> list[str | int]:
    """Keys and indexes of ``a.b[2].c``; empty parts are passed over.  ValueError for a malformed index."""
    steps: list[str | int] = []
    for m in _STEP.finditer(path):
        if m[3] is not None:
            steps.append(m[3])
        elif m[1] is not None:
            if not m[2] or not m[1].isascii() or not m[1].isdigit():
                raise ValueError(f"malformed index in path {path!r}")
            steps.append(int(m[1]))
    return steps


def find(text: str, tape: list[Entry], steps: list[str | int]) -> int:
    """Entry that the steps lead to, the first of equal keys; -1 where there is none."""
    at = 0
    for step in steps:
        here = tape[at]
        if here.kind != ("array" if isinstance(step, int) else "object"):
            return -1
        i, seen, wanted = at + 1, 0, step if isinstance(step, int) else step.encode()
        while i < here.next:
            if here.kind == "array":
                if seen == wanted:
                    break
                seen += 1
                i = tape[i].next
            else:
                if decoded(text, tape[i]) == wanted:
                    i += 1
                    break
                i = tape[i + 1].next
        if i >= here.next:
            return -1
        at = i
    return at


def shown(text: str, entry: Entry) -> bytes:
    """How a query prints a value: strings decoded, scalars as spelt, containers by their size."""
    if entry.kind == "array":
        return f"[{entry.size} elements]".encode()
    if entry.kind == "object":
        return f"{{{entry.size} members}}".encode()
    return decoded(text, entry) if entry.kind == "string" else lexeme(text, entry)
