"""Lines with their terminators, for the dialects that are read line by line."""

from __future__ import annotations

import re
from typing import NamedTuple

_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")


class Line(NamedTuple):
    start: int
    stop: int  # of the body
    end: int  # with the terminator


def lines_of(text: str) -> list[Line]:
    return [Line(m.start(), m.end(1), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
