"""Nodes in document order, with the nested-set numbers that make subtree tests cheap."""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np

_BREAK = re.compile(r"\r\n|\r|\n")
SPACE = " \t\r\n\f"


class Diagnostic(NamedTuple):
    code: str
    message: str
    at: int
    severity: str = "error"
    width: int = 0
    fix: str = ""
    related: str = ""
    related_at: int = -1


class Positions:
    """Line (from 1) and column (from 0, in bytes) of offsets; ``\\n``, ``\\r`` and ``\\r\\n`` end a line."""

    def __init__(self, text: str) -> None:
        self.starts = np.array([0, *(m.end() for m in _BREAK.finditer(text))])

    def of(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.searchsorted(self.starts, offsets, "right")
        return line, offsets - self.starts[line - 1]


class Tree:
    """A tree under construction; a node's number is its place in document order.

    Nodes are kept as rows while they are added, and read as columns.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.diagnostics: list[Diagnostic] = []
        self.made: dict[int, str] = {}  # text of leaves that is not of the document
        self.ends: list[int] = []
        self._rows: list[tuple[str, int, tuple[int, int] | None, int, int]] = []
        self._open: list[int] = []
        self._top = -1
        self._columns: tuple[tuple, ...] = ((),) * 5
        self._read = 0

    def open(self, tag: str, at: int) -> int:
        rows, opened = self._rows, self._open
        number = len(rows)
        rows.append((tag, at, None, self._top, len(opened)))
        self.ends.append(number + 1)
        opened.append(number)
        self._top = number
        return number

    def close(self) -> None:
        opened = self._open
        self.ends[opened.pop()] = len(self._rows)
        self._top = opened[-1] if opened else -1

    def close_all(self) -> None:
        number = len(self._rows)
        for opened in self._open:
            self.ends[opened] = number
        self._open.clear()
        self._top = -1

    def leaf(self, tag: str, start: int, end: int) -> None:
        rows = self._rows
        rows.append((tag, start, (start, end), self._top, len(self._open)))
        self.ends.append(len(rows))

    def mark(self, tag: str, at: int) -> None:
        """A node that stands for fixed text."""
        rows = self._rows
        rows.append((tag, at, None, self._top, len(self._open)))
        self.ends.append(len(rows))

    def _column(self, number: int) -> tuple:
        if self._read != len(self._rows):
            self._columns, self._read = tuple(zip(*self._rows, strict=True)), len(self._rows)
        return self._columns[number]

    @property
    def tags(self) -> tuple[str, ...]:
        return self._column(0)

    @property
    def offsets(self) -> tuple[int, ...]:
        return self._column(1)

    @property
    def spans(self) -> tuple[tuple[int, int] | None, ...]:
        """Of the text, for leaves that have one."""
        return self._column(2)

    @property
    def parents(self) -> tuple[int, ...]:
        return self._column(3)

    @property
    def depths(self) -> tuple[int, ...]:
        return self._column(4)

    def error(self, code: str, message: str, at: int, **more: object) -> None:
        self.diagnostics.append(Diagnostic(code, message, at, **more))  # type: ignore[arg-type]

    def flawed(self, code: str, start: int, end: int) -> None:
        """An ``err`` node that keeps the bytes it could not place."""
        self.open("err", start)
        self.made[len(self._rows)] = code
        self.mark("code", start)
        self.leaf("raw", start, end)
        self.close()

    def state(self) -> tuple[int, list[int], int, int]:
        """What :meth:`back` needs to take back all that is added, and closed, from now on."""
        return len(self._rows), self._open.copy(), self._top, len(self.diagnostics)

    def back(self, state: tuple[int, list[int], int, int]) -> None:
        """As it was; an open node's end is not known before it is closed."""
        number, opened, self._top, said = state
        del self._rows[number:], self.ends[number:], self.diagnostics[said:]
        self._open = opened.copy()
        self._read = -1
        if self.made:
            self.made = {n: text for n, text in self.made.items() if n < number}

    def here(self) -> tuple[int, int, int, int]:
        """What :meth:`cut` needs to take back all that is added from now on."""
        return len(self._rows), len(self._open), self._top, len(self.diagnostics)

    def innermost(self, count: int) -> list[int]:
        """The open nodes that stand deepest, of which there are so many at least."""
        return self._open[-count:]

    def cut(self, here: tuple[int, int, int, int], closed: Sequence[int] = ()) -> None:
        """As it was, when of the nodes that were open these, the deepest ones, and no others were closed."""
        number, level, self._top, said = here
        del self._rows[number:], self.ends[number:], self.diagnostics[said:]
        self._open[level - len(closed) :] = closed
        self._read = -1
        if self.made:
            self.made = {n: text for n, text in self.made.items() if n < number}

    @property
    def level(self) -> int:
        return len(self._open)

    def rendered(self, literals: Mapping[str, str], opaque: Container[str] = (), start: int = 0, stop: int | None = None) -> str:
        """The text of the nodes from ``start`` on, in their order; a node without text of its own stands for its tag's literal."""
        text, rows, made = self.text, self._rows[start:stop], self.made
        if made:
            return "".join([made[n] if n in made else text[span[0] : span[1]] if span is not None else literals.get(tag, "") for n, (tag, _, span, _, _) in enumerate(rows, start) if tag not in opaque])
        return "".join([text[span[0] : span[1]] if span is not None else literals.get(tag, "") for tag, _, span, _, _ in rows if tag not in opaque])

    def raws(self, numbers: Iterable[int] | None = None) -> list[bytes | None]:
        """Texts of all nodes, or of some; none where a node has no text of its own."""
        text, made = self.text, self.made
        spans = self.spans if numbers is None else [self.spans[i] for i in numbers]
        out: list[bytes | None] = [None if s is None else text[s[0] : s[1]].encode("latin-1") for s in spans]
        if made:
            for place, number in enumerate(range(len(self.spans)) if numbers is None else numbers):
                if number in made:
                    out[place] = made[number].encode("latin-1")
        return out
