"""Single files from the command line, without Spark; many files are a job for the table functions.

python -m treeloom css|html|py|js|json|vds|md|yaml|cfg FILE [OUT]   write a document's tree
python -m treeloom auto FILE [OUT]                                   the same, by extension
python -m treeloom parse FILE [OUT]                                  the decoded tree of Nim source
python -m treeloom render TREE [OUT]                                 the document of a tree
python -m treeloom check FILE                                        diagnostics; exit code 1 with an error
python -m treeloom complete FILE                                     complete (0), incomplete (2) or invalid (1)
python -m treeloom dialects                                          what there is
python -m treeloom jsonq FILE PATH | jsonlint FILE                   strict JSON
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

import numpy as np

from .dialects import nim, nim_checks, nim_tree
from .dialects.specs import BY_COMMAND, BY_NAME, DIALECTS, NIM_EXTENSIONS, OPAQUE, PUNCT, STRUCT, TEXT
from .dialects.tree import Diagnostic, Positions, Tree
from .functions import json_tape as jt

VENDOR = "treeloom"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=[*BY_COMMAND, "auto", "p", "parse", "render", "check", "complete", "dialects", "jsonq", "jsonlint"])
    p.add_argument("file", nargs="?", default="-")
    p.add_argument("rest", nargs="?")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--stdout", action="store_true")
    p.add_argument("--filename", default="")
    p.add_argument("--diagnostics", choices=["text", "json"], default="text")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--curly", action="store_true")
    p.add_argument("--lint", action="append", default=[], choices=sorted(nim_checks.LINTS))
    p.add_argument("--tabs", choices=["spaces", "tabs", "both"], default="spaces")
    p.add_argument("--tab-width", type=int, default=8)
    p.add_argument("--tab-stops", choices=["hard", "round"], default="hard")
    p.add_argument("--indent-width", type=int, default=0)
    p.add_argument("--indent-consistency", action="store_true")
    p.add_argument("--final-newline", action="store_true")
    p.add_argument("--newline", choices=["any", "lf", "crlf"], default="any")
    p.add_argument("--trailing-whitespace", action="store_true")
    p.add_argument("--bom", choices=["default", "strip", "reject"], default="default")
    p.add_argument("--no-doc-comments", action="store_true")
    p.add_argument("--max-depth", type=int, default=0, help="fail where nodes stand in each other deeper than so many levels; 0 for any depth")
    p.add_argument("--portable-paths", choices=["on", "off"], default="on", help="show paths from the working directory on, with forward slashes")
    return p


def _options(a: argparse.Namespace) -> nim.Options:
    return nim.Options(a.tabs, a.tab_width, a.tab_stops, a.indent_width, a.indent_consistency, a.final_newline, a.newline, a.trailing_whitespace, a.bom, not a.no_doc_comments)


def portable(path: str) -> str:
    """A path from the working directory on, where it is below it, with forward slashes."""
    below = os.path.relpath(path)
    return (path if below.startswith("..") else below).replace(os.sep, "/")


def too_deep(tree: Tree, limit: int) -> int | None:
    """Line of the first node that is deeper than ``limit`` levels below the root; None without one or without a limit."""
    at = next((offset for offset, depth in zip(tree.offsets, tree.depths, strict=True) if depth > limit), None) if limit > 0 else None
    return None if at is None else int(Positions(tree.text).of(np.array([at]))[0][0])


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


def dialect_by_extension(path: str) -> str:
    """A command, ``nim``, or nothing."""
    e = extension(path)
    return "nim" if e in NIM_EXTENSIONS else next((d.command for d in DIALECTS if e in d.extensions), "")


def nim_diagnostics(text: str, options: nim.Options = nim.Options(), lints: tuple[str, ...] = (), curly: bool = False) -> list[Diagnostic]:
    """Lexical, bracket, grammar and parser diagnostics; none for a source that a filter handles."""
    if text.lstrip(" \t\r\n").startswith("#?"):
        return []
    tokens, found = nim.tokenize(text, options)
    coped = nim_tree.parse(text).diagnostics[len(nim.tokenize(text)[1]) :]
    return found + nim.check_brackets(tokens) + nim_checks.check(tokens, lints, curly) + coped


def in_order(text: str, found: list[Diagnostic]) -> list[tuple[Diagnostic, int, int, int, int]]:
    """Diagnostics by place, with line and column of themselves and of what they relate to."""
    places = Positions(text)
    rows = []
    for d in found:
        line, col = places.of(np.array([max(0, d.at), max(0, d.related_at)]))
        rows.append((d, int(line[0]) if d.at >= 0 else 0, int(col[0]) if d.at >= 0 else 0, int(line[1]), int(col[1])))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def shown(text: str, found: list[Diagnostic], path: str, form: str) -> str:
    rows = in_order(text, found)
    if form == "json":
        out = []
        for d, line, col, to_line, to_col in rows:
            one = {"severity": d.severity, "code": d.code, "message": d.message, "line": line, "col": col, "endCol": col + d.width}
            if d.fix:
                one["fix"] = d.fix
            if d.related and d.related_at != d.at:
                one["related"] = {"message": d.related, "line": to_line, "col": to_col}
            out.append(one)
        return json.dumps(out) + "\n"
    lines = []
    for d, line, col, to_line, to_col in rows:
        lines.append(f"{path}:{line}:{col + 1}: {d.severity}[{d.code}]: {d.message}")
        if d.related and d.related_at != d.at:
            lines.append(f"  note: {path}:{to_line}:{to_col + 1}: {d.related}")
        if d.fix:
            lines.append(f"  help: {d.fix}")
    return "".join(x + "\n" for x in lines)


def artifact(tree: Tree, name: str) -> bytes:
    from .sources.artifact import write_tree

    line, col = Positions(tree.text).of(np.array(tree.offsets))
    return write_tree(name, VENDOR, zip(tree.ends, tree.tags, tree.raws(), line.tolist(), col.tolist(), strict=True))


def render_artifact(content: bytes) -> bytes:
    """The document of an artifact: texts and punctuation in order, nothing below an opaque node."""
    from .sources.artifact import read_events

    text = content.decode("latin-1")
    name, out = "", []
    stack: list[str] = []
    done: list[bool] = []
    for kind, value in read_events(text):
        if kind == "open":
            command = BY_NAME[name].command if name in BY_NAME else ""
            hidden = any(t in OPAQUE.get(command, "").split() for t in stack)
            if command and not hidden and value in PUNCT.get(command, {}):
                out.append(PUNCT[command][value])
            stack.append(value)
            done.append(False)
        elif kind == "close" and stack:
            stack.pop()
            done.pop()
        elif kind == "text" and stack and not done[-1]:
            done[-1] = True
            if stack[-1] == ".dialect":
                name = value
                if name not in BY_NAME:
                    raise ValueError(f"unknown dialect {name!r}")
            elif name and stack[-1] in TEXT[BY_NAME[name].command].split() and not any(t in OPAQUE.get(BY_NAME[name].command, "").split() for t in stack):
                out.append(value)
    if not name:
        raise ValueError("no dialect is named")
    return "".join(out).encode("latin-1")


def listing() -> str:
    lines = []
    for d in DIALECTS:
        c = d.command
        counts = {"struct": len(STRUCT[c].split()), "text": len(TEXT[c].split()), "punct": len(PUNCT.get(c, {}))}
        total = sum(counts.values()) + len(OPAQUE.get(c, "").split())
        lines.append(f"{c:5} {d.name:12} {' '.join(d.extensions):20} {total} nodes ({', '.join(f'{n} {k}' for k, n in counts.items())}): {d.summary}")
    return "\n".join(lines) + "\n"


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.verb == "dialects":
        sys.stdout.write(listing())
        return 0
    piped = a.stdin or a.file == "-"
    try:
        content = sys.stdin.buffer.read() if piped else Path(a.file).read_bytes()
    except OSError as e:
        sys.stderr.write(f"{a.file}: {e.strerror}\n")
        return 1
    named = a.file if a.portable_paths == "off" else portable(a.file)
    path, text = a.filename or ("stdin" if piped else named), content.decode("latin-1")
    if a.verb == "jsonlint":
        try:
            jt.parse(text)
            return 0
        except jt.JsonError as e:
            line, col = Positions(text).of(np.array([e.at]))
            sys.stdout.write(f"{path}:{line[0]}:{col[0] + 1}: error: {e.message} (byte {e.at})\n")
            return 1
    if a.verb == "jsonq":
        return _query(text, a.rest, path)
    if a.verb == "complete":
        verdict, reason, _ = nim.completeness(text)
        sys.stdout.write(f"{verdict} {reason}".strip() + "\n")
        return {"complete": 0, "incomplete": 2, "invalid": 1}[verdict]
    if a.verb == "render":
        try:
            return _write(render_artifact(content), a.rest, a.stdout or not a.rest)
        except ValueError as e:
            sys.stderr.write(f"{path}: {e}\n")
            return 1
    command = a.verb
    if command in ("auto", "check"):
        command = dialect_by_extension(path) or ("nim" if command == "check" and piped else "")
        if not command:
            sys.stderr.write(f"{path}: no dialect reads '{extension(path)}'; known are {' '.join([*NIM_EXTENSIONS, *(e for d in DIALECTS for e in d.extensions)])}\n")
            return 1
    is_nim = command in ("nim", "p", "parse")
    tree = nim_tree.parse(text) if is_nim else BY_COMMAND[command].parse(text)
    deep = too_deep(tree, a.max_depth)
    if deep is not None:
        sys.stderr.write(f"{path}: nesting is deeper than --max-depth {a.max_depth} at line {deep}\n")
        return 1
    found = nim_diagnostics(text, _options(a), tuple(a.lint), a.curly) if is_nim else tree.diagnostics
    failed = any(d.severity == "error" for d in found)
    if a.verb == "check":
        sys.stdout.write(shown(text, found, path, a.diagnostics))
        return int(failed)
    sys.stderr.write(shown(text, found, path, a.diagnostics) if found or a.diagnostics == "json" else "")
    out = a.rest or ("" if piped else f"{a.file}.{'p' if is_nim else command}.aif")
    code = _write(artifact(tree, "nim-parsed" if is_nim else BY_COMMAND[command].name), out, a.stdout or not out)
    return code or int(a.strict and failed)


def _write(content: bytes, path: str | None, to_stdout: bool) -> int:
    if to_stdout or path == "-":
        sys.stdout.buffer.write(content)
        sys.stdout.flush()
    else:
        Path(path).write_bytes(content)
    return 0


def _query(text: str, path: str | None, name: str) -> int:
    if path is None:
        sys.stderr.write("jsonq needs a path\n")
        return 2
    try:
        steps = jt.path_steps(path)
    except ValueError as e:
        sys.stderr.write(f"{e}\n")
        return 2
    try:
        tape = jt.parse(text)
    except jt.JsonError as e:
        sys.stderr.write(f"{name}: {e.message} at offset {e.at}\n")
        return 1
    at = jt.find(text, tape, steps)
    if at < 0:
        return 1
    sys.stdout.buffer.write(jt.shown(text, tape[at]) + b"\n")
    sys.stdout.flush()
    return 0
