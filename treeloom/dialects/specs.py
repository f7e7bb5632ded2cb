"""Which nodes each dialect has, and which dialect reads which files."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from . import cfg, css, html, js, json, md, py, vds, yaml
from .tree import Tree


class Dialect(NamedTuple):
    name: str
    command: str
    extensions: tuple[str, ...]
    summary: str
    parse: Callable[[str], Tree]
    tokens: Callable[[str], list[tuple[str, int, int]]] | None


# The vocabulary of each dialect.
STRUCT = {
    "css": "stylesheet rule sel block decl val atrule prelude err",
    "html": "doc elem stag etag attr err",
    "py": "module stmt block err",
    "js": "program group err",
    "json": "doc object array member err",
    "vds": "vds alt any all juxta comp group fn paren block err",
    "md": "doc heading fence list item quote para table err",
    "yaml": "stream doc block entry item line scalar flow directive",
    "cfg": "config section entry switch cond line",
}
TEXT = {
    "css": "ws comment ident num dim pct str hash fn url op prop name raw",
    "html": "text comment doctype cdata pi name ws aname aval op raw",
    "py": "ws nl comment name kw num str op cont raw",
    "js": "ws nl comment name kw num str template regex op raw",
    "json": "ws str num lit raw",
    "vds": "ws type propref kw str num lit op mult range fname raw",
    "md": "marker info text ws nl blank raw",
    "yaml": "open close comma marker key colon value comment text ws nl blank",
    "cfg": "open close name marker key op value comment ws nl blank",
}
PUNCT = {
    "css": {"lbrace": "{", "rbrace": "}", "colon": ":", "semi": ";"},
    "html": {"lt": "<", "ltslash": "</", "gt": ">", "eq": "=", "selfclose": "/"},
    "json": {"lbrace": "{", "rbrace": "}", "lbracket": "[", "rbracket": "]", "colon": ":", "comma": ","},
    "vds": {"lbracket": "[", "rbracket": "]", "lparen": "(", "rparen": ")", "lbrace": "{", "rbrace": "}"},
}
OPAQUE = {"css": "code", "html": "code"}

# Names, commands, extensions and summaries of the dialects.
DIALECTS = (
    Dialect("css-parsed", "css", (".css",), "CSS Syntax Level 3, trivia-preserving", css.parse, css.tokens),
    Dialect("html-parsed", "html", (".html", ".htm", ".xhtml"), "HTML with raw-text elements (script/style/textarea/title)", html.parse, html.tokens),
    Dialect("py-parsed", "py", (".py", ".pyi"), "Python: indentation tree, implicit/explicit line joining", py.parse, py.tokens),
    Dialect("js-parsed", "js", (".js", ".mjs", ".cjs"), "JavaScript: regex-vs-division, templates, bracket groups", js.parse, js.tokens),
    Dialect("json-parsed", "json", (".json",), "JSON preserving key order, duplicates and number spelling", json.parse, json.tokens),
    Dialect("vds-parsed", "vds", (".vds",), "MDN value-definition syntax (the language CSS specs use)", vds.parse, vds.tokens),
    Dialect("md-parsed", "md", (".md", ".markdown"), "Markdown block structure; fenced code is not markup", md.parse, None),
    Dialect("yaml-parsed", "yaml", (".yaml", ".yml"), "YAML block structure; a block scalar's content is not YAML", yaml.parse, None),
    Dialect("cfg-parsed", "cfg", (".cfg", ".ini"), "ini/nim.cfg: sections, assignments, switches, @if conditionals", cfg.parse, None),
)
NIM_EXTENSIONS = (".nim", ".nims", ".nimble")
BY_COMMAND = {d.command: d for d in DIALECTS}
BY_NAME = {d.name: d for d in DIALECTS}


def dialect(name: str) -> Dialect:
    """A dialect by command or full name."""
    found = BY_COMMAND.get(name) or BY_NAME.get(name)
    if found is None:
        raise ValueError(f"unknown dialect {name!r}; there are {', '.join(BY_COMMAND)}")
    return found


def node_spec_rows() -> list[tuple[str, str, str, str | None]]:
    """(dialect, tag, kind, literal) of every declared node."""
    rows: list[tuple[str, str, str, str | None]] = []
    for d in DIALECTS:
        c = d.command
        rows += [(d.name, t, "struct", None) for t in STRUCT[c].split()]
        rows += [(d.name, t, "punct", lit) for t, lit in PUNCT.get(c, {}).items()]
        rows += [(d.name, t, "text", None) for t in TEXT[c].split()]
        rows += [(d.name, t, "opaque", None) for t in OPAQUE.get(c, "").split()]
    return rows


def dialect_rows() -> list[tuple[str, str, list[str], str]]:
    return [(d.name, d.command, list(d.extensions), d.summary) for d in DIALECTS]
