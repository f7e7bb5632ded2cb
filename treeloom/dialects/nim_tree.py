"""Nim source as a decoded tree: precedence climbing over tokens, blocks by indentation.

The tree is one-way: it has the meaning of a source, not its bytes.  Nothing
raises on bad input; what cannot be placed is skipped with a diagnostic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .nim import CLOSERS, Token, tokenize
from .tree import Diagnostic, Tree

MAX_DEPTH = 120
# Statement and routine keywords, and the tags they become.
ROUTINES = frozenset("proc func method converter iterator macro template".split())
JUMPS = {"return": "ret", "discard": "discard", "raise": "raise", "yield": "yld", "break": "break", "continue": "continue"}
LISTS = frozenset("import include export mixin bind".split())
TYPE_WORDS = {"ref": "ref", "ptr": "ptr", "var": "mut", "out": "out", "distinct": "distinct"}
WORD_OPERATORS = frozenset("and or xor div mod shl shr in notin is isnot of as".split())
COMPARE, LITERAL = frozenset("in notin is isnot of as".split()), {"int": "int", "float": "float", "str": "str", "rstr": "str", "triplestr": "str", "char": "char"}


@dataclass
class Node:
    tag: str
    at: int
    kids: list[Node] = field(default_factory=list)
    raw: str | None = None


def empty(at: int) -> Node:
    return Node("empty", at)


def precedence(op: str) -> int:
    """0 for arrows, 1 for assignments, up to 10; word operators by what they stand for."""
    if op in ("div", "mod", "shl", "shr"):
        return 9
    if op in COMPARE:
        return 5
    if op == "and":
        return 4
    if op in ("or", "xor"):
        return 3
    if op.endswith(("->", "~>", "=>")) and len(op) > 1:
        return 0
    first = op[0]
    if op.endswith("=") and first not in "<>!=~?" and op != "==":
        return 1
    for level, starts in ((10, "$^"), (9, "*%/\\"), (8, "+-~|"), (7, "&"), (6, "."), (5, "=<>!"), (2, "@:?")):
        if first in starts:
            return level
    return 1


class Parser:
    def __init__(self, source: str) -> None:
        self.tokens, self.diagnostics = tokenize(source)
        self.i, self.depth, self.brackets = 0, 0, 0
        self.in_type = False  # pragmas behind a type are not the type's
        self.indent = 0  # of the block whose statement is being parsed

    # --- the token stream

    @property
    def tok(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.tok
        if t.kind != "eof":
            self.i += 1
        return t

    def word(self, *texts: str) -> bool:
        return self.tok.kind == "keyword" and self.tok.text in texts

    def sign(self, *texts: str) -> bool:
        return self.tok.kind in ("operator", "bracket", "comma", "semicolon", "colon", "dot") and self.tok.text in texts

    def fresh(self) -> bool:
        """Whether the current token starts a line that ends what came before, outside brackets."""
        return self.tok.kind == "eof" or (self.tok.indent >= 0 and not self.brackets)

    def error(self, code: str, message: str, t: Token | None = None, fix: str = "") -> None:
        t = t or self.tok
        self.diagnostics.append(Diagnostic(code, message, t.start, width=t.stop - t.start, fix=fix))

    def take(self, text: str) -> bool:
        if self.sign(text) and not self.fresh():
            self.next()
            return True
        return False

    def close(self, text: str) -> None:
        """Step over a closing bracket, and over what stands before it where it is late."""
        self.brackets -= 1
        depth = 0
        at = self.i
        while self.tok.kind != "eof":
            if self.tok.kind == "bracket":
                if self.tok.text in CLOSERS:
                    depth += 1
                elif depth:
                    depth -= 1
                else:
                    if self.tok.text == text:
                        self.next()
                    return
            self.next()
        self.i = max(at, min(self.i, len(self.tokens) - 1))

    # --- blocks

    def module(self) -> Node:
        root = Node("stmts", 0)
        while self.tok.kind != "eof":
            before = self.i
            self.indent = max(0, self.tok.indent)
            root.kids += self.statements(self.indent)
            if self.i == before:
                self.next()
        return root

    def statements(self, indent: int) -> list[Node]:
        """Statements whose lines start at ``indent``; deeper strays are kept as statements too."""
        out: list[Node] = []
        outer, self.indent = self.indent, indent
        while self.tok.kind != "eof" and (self.tok.indent < 0 or self.tok.indent >= indent):
            before = self.i
            out += self.statement()
            while self.sign(";") and not (self.tok.indent >= 0):
                self.next()
            if self.i == before:
                self.next()
        self.indent = outer
        return out

    def body(self, opened: Token) -> Node:
        """What follows a colon or equals sign: statements on the same line, or an indented block."""
        at = self.tok.start
        if self.tok.kind == "eof" or (self.tok.indent >= 0 and self.tok.indent <= self.indent):
            self.error("expected-indented-body", f"an indented body is expected after '{opened.text}'", opened)
            return Node("stmts", at, [empty(at)])
        brackets, self.brackets = self.brackets, 0
        if self.tok.indent >= 0:
            out = self.statements(self.tok.indent)
        else:
            out = []
            while not self.fresh() and not self.sign(")", "]", "}", ",") and not self.word("else", "elif", "of", "except", "finally"):
                before = self.i
                out += self.statement()
                if not self.take(";") or self.i == before:
                    break
        self.brackets = brackets
        return Node("stmts", at, out)

    def colon_body(self, head: Token) -> Node:
        if self.sign(":"):
            return self.body(self.next())
        self.error("expected-colon", f"expected ':' after '{head.text}'", fix="insert ':'")
        if self.tok.indent > self.indent:
            return self.body(head)
        while not self.fresh():
            self.next()
        return Node("stmts", self.tok.start, [empty(self.tok.start)])

    # --- statements

    def statement(self) -> list[Node]:
        t = self.tok
        if t.kind == "comment":
            self.next()
            return [Node("comment", t.start)]
        if t.kind == "keyword":
            w = t.text
            if w in ("if", "when"):
                return [self.branches(w)]
            if w in ROUTINES and not (self.peek().text == "(" and self.peek().kind == "bracket"):
                return [self.routine()]
            if w in ("var", "let", "const", "using"):
                return self.section(w)
            if w == "type" and not (self.peek().text == "(" and self.peek().start == t.stop):
                return self.section("type")
            if w in ("return", "discard", "raise", "yield", "break", "continue"):
                self.next()
                return [Node(JUMPS[w], t.start, [empty(t.stop) if self.fresh() or self.sign(";", ")") else self.expression()])]
            if w in LISTS or w == "from":
                return [self.imports()]
            simple = {"while": self.loop, "case": self.case, "for": self.for_loop, "try": self.attempt, "block": self.block}
            if w in simple:
                return [simple[w]()]
            if w in ("defer", "static"):
                self.next()
                return [Node("defer" if w == "defer" else "staticstmt", t.start, [self.colon_body(t)])]
            if w == "asm":
                self.next()
                return [Node("asm", t.start, [self.primary()])]
        if self.pragma_here():
            return [self.pragmas()]
        return [self.expression_statement()]

    def expression_statement(self) -> Node:
        t = self.tok
        left = self.expression(command=True)
        if self.sign("=") and not self.fresh():
            self.next()
            return Node("asgn", t.start, [left, self.expression(command=True)])
        if self.sign(":") and not self.fresh():
            left = self.attach(left, [self.body(self.next())])
        return self.trailing_blocks(left)

    def attach(self, call: Node, blocks: list[Node]) -> Node:
        """A block becomes the last argument of a call."""
        if call.tag not in ("call", "cmd"):
            call = Node("call", call.at, [call])
        call.kids += blocks
        return call

    def trailing_blocks(self, left: Node) -> Node:
        while self.word("do") and (self.tok.indent < 0 or self.tok.indent == self.indent):
            t = self.next()
            params, ret = empty(t.stop), empty(t.stop)
            if self.sign("(") and not self.fresh():
                params = self.parameters()
                if self.sign("->") and not self.fresh():
                    self.next()
                    ret = self.type_expression()
                left = self.attach(left, [Node("do", t.start, [params, ret, self.colon_body(t)])])
            else:
                left = self.attach(left, [self.colon_body(t)])
        return left

    def branches(self, tag: str) -> Node:
        """if or when: elif branches, the first among them, and an else."""
        node, column = Node(tag, self.tok.start), self.tok.indent
        first = True
        while first or (self.word("elif") and self.mine(column)):
            t = self.next()
            node.kids.append(Node("elif", t.start, [self.expression(), self.colon_body(t)]))
            first = False
        if self.word("else") and self.mine(column):
            t = self.next()
            node.kids.append(Node("else", t.start, [self.colon_body(t)]))
        return node

    def mine(self, column: int) -> bool:
        """Whether a branch keyword belongs to the construct that began at ``column`` (-1: inside a line)."""
        return self.tok.indent < 0 or column < 0 or self.tok.indent == column or bool(self.brackets)

    def loop(self) -> Node:
        t = self.next()
        return Node("while", t.start, [self.expression(), self.colon_body(t)])

    def case(self) -> Node:
        column = self.tok.indent
        t = self.next()
        node = Node("case", t.start, [self.expression()])
        self.take(":")
        while self.word("of", "elif", "else"):
            if self.tok.indent >= 0 and self.tok.indent < max(column, 0) and not self.brackets:
                break
            b = self.next()
            if b.text == "of":
                values = Node("ranges", b.start)
                if self.sign(":"):
                    self.error("of-without-value", "an 'of' branch needs a value", b)
                while not self.sign(":") and self.tok.kind != "eof":
                    before = self.i
                    values.kids.append(self.expression())
                    if not self.sign(",") or self.i == before:
                        break
                    self.next()
                node.kids.append(Node("of", b.start, [values, self.colon_body(b)]))
            elif b.text == "elif":
                node.kids.append(Node("elif", b.start, [self.expression(), self.colon_body(b)]))
            else:
                node.kids.append(Node("else", b.start, [self.colon_body(b)]))
                break
        return node

    def for_loop(self) -> Node:
        t = self.next()
        names: list[Node] = []
        grouped = False
        while not self.word("in") and not self.fresh():
            if self.sign("("):
                grouped = True
                self.next()
                continue
            if self.sign(")", ","):
                self.next()
                continue
            if self.tok.kind != "ident":
                break
            names.append(self.binder("let", self.next()))
        if self.word("in"):
            self.next()
        else:
            self.error("expected-in", "expected 'in' in a for loop")
        over = self.expression()
        return Node("for", t.start, [over, Node("unpacktup" if grouped else "unpackflat", t.stop, names), self.colon_body(t)])

    def attempt(self) -> Node:
        column = self.tok.indent
        t = self.next()
        node = Node("try", t.start, [self.colon_body(t)])
        while self.word("except", "finally") and self.mine(column):
            b = self.next()
            if b.text == "finally":
                node.kids.append(Node("fin", b.start, [self.colon_body(b)]))
                break
            kinds: list[Node] = []
            while not self.sign(":") and not self.fresh():
                kinds.append(self.expression())
                if not self.take(","):
                    break
            node.kids.append(Node("except", b.start, [*(kinds or [empty(b.stop)]), self.colon_body(b)]))
        return node

    def block(self) -> Node:
        t = self.next()
        label = empty(t.stop) if self.sign(":") else self.expression()
        return Node("block", t.start, [label, self.colon_body(t)])

    def imports(self) -> Node:
        t = self.next()
        if t.text == "from":
            node = Node("fromimport", t.start, [self.expression()])
            if self.word("import"):
                self.next()
        else:
            node = Node(t.text, t.start)
        while not self.fresh() or (self.tok.indent > self.indent and self.tok.kind != "eof"):
            if self.word("except"):
                self.next()
                node.tag = t.text + "except"
                continue
            before, held = self.i, self.tok.indent
            if held >= 0:
                self.brackets += 1
            node.kids.append(self.expression())
            if held >= 0:
                self.brackets -= 1
            while self.sign(",") and self.tok.indent < 0:
                self.next()
            if self.i == before:
                self.next()
        return node

    # --- declarations

    def binder(self, tag: str, name: Token, export: Node | None = None, pragmas: Node | None = None, kind: Node | None = None, value: Node | None = None) -> Node:
        gap = lambda n: n or empty(name.stop)
        return Node(tag, name.start, [self.named(name), gap(export), gap(pragmas), gap(kind), gap(value)])

    def named(self, t: Token) -> Node:
        if t.quoted:
            return Node("quoted", t.start, [Node("ident", t.start, raw=p) for p in t.parts])
        return Node("ident", t.start, raw=t.text)

    def exported(self) -> Node | None:
        if self.sign("*") and not self.fresh():
            return Node("ident", self.next().start, raw="x")
        return None

    def pragma_here(self) -> bool:
        return self.sign("{") and self.peek().kind in ("dot", "operator") and self.peek().text == "." and self.peek().start == self.tok.stop

    def pragmas(self) -> Node:
        t = self.next()
        self.next()
        node = Node("pragmas", t.start)
        self.brackets += 1
        while self.tok.kind != "eof" and not self.sign("}") and not (self.sign(".") and self.peek().text == "}") and not (self.tok.kind == "operator" and self.tok.text.startswith(".")):
            before = self.i
            node.kids.append(self.argument())
            if self.sign(",", ";"):
                self.next()
            elif self.i == before:
                self.next()
        if self.sign(".") or self.tok.kind == "operator":
            self.next()
        self.close("}")
        return node

    def section(self, tag: str) -> list[Node]:
        """One node a name; a section's lines stand deeper than its keyword."""
        head = self.next()
        if self.tok.kind == "eof" or (self.tok.indent >= 0 and self.tok.indent <= self.indent):
            return []
        define = self.type_definition if tag == "type" else lambda: self.definition(tag)
        if self.tok.indent < 0:
            return define()
        out: list[Node] = []
        column, outer = self.tok.indent, self.indent
        self.indent = column
        while self.tok.kind != "eof" and self.tok.indent == column:
            before = self.i
            if self.tok.kind == "comment":
                out.append(Node("comment", self.next().start))
            else:
                out += define()
            if self.i == before:
                self.next()
            while not self.fresh():
                self.next()
        self.indent = outer
        return out or [empty(head.stop)]

    def names(self) -> list[tuple[Token, Node | None, Node | None]]:
        """Names with their export marks and pragmas, up to a colon or an equals sign."""
        out = []
        while self.tok.kind in ("ident", "keyword") and self.tok.kind == "ident":
            name = self.next()
            mark = self.exported()
            out.append((name, mark, self.pragmas() if self.pragma_here() else None))
            if not (self.sign(",") and (not self.fresh())):
                break
            self.next()
        return out

    def definition(self, tag: str) -> list[Node]:
        t = self.tok
        if self.sign("("):
            self.next()
            self.brackets += 1
            parts = [Node(tag, n.start, [self.named(n), *(empty(n.stop) for _ in range(4))]) for n, _, _ in self.names()]
            self.close(")")
            value = self.value_after("=")
            return [Node("unpackdecl", t.start, [value or empty(t.stop), Node("unpacktup", t.start, parts)])]
        found = self.names()
        if not found:
            self.error("identifier-expected", f"a name is expected in this '{tag}'")
            while not self.fresh():
                self.next()
            return []
        kind = self.type_after()
        value = self.value_after("=")
        if value is not None and self.sign(":") and not self.fresh():
            value = self.attach(value, [self.body(self.next())])
        return [self.binder(tag, n, mark, pragma, kind, value) for n, mark, pragma in found]

    def type_after(self) -> Node | None:
        if self.sign(":") and not self.fresh():
            self.next()
            return self.type_expression()
        return None

    def value_after(self, text: str) -> Node | None:
        if self.sign(text) and not self.fresh():
            self.next()
            if self.tok.indent > self.indent and not self.brackets:
                body = self.body(self.tok)
                return body.kids[0] if len(body.kids) == 1 else body
            return self.expression(command=True)
        return None

    def type_definition(self) -> list[Node]:
        if self.tok.kind != "ident":
            self.error("identifier-expected", "a type name is expected")
            return []
        name = self.next()
        mark = self.exported()
        generics = self.generics() if self.sign("[") else empty(name.stop)
        pragma = self.pragmas() if self.pragma_here() else empty(name.stop)
        right = empty(name.stop)
        if self.sign("=") and not self.fresh():
            self.next()
            right = self.type_expression(body=True)
        elif not self.fresh():
            self.error("missing-type-equals", "'=' is expected in a type definition", fix="insert '='")
        return [Node("type", name.start, [self.named(name), mark or empty(name.stop), generics, pragma, right])]

    def generics(self) -> Node:
        t = self.next()
        node = Node("typevars", t.start)
        self.brackets += 1
        while not self.sign("]") and self.tok.kind != "eof":
            before, found = self.i, self.names()
            kind, value = self.type_after(), self.value_after("=")
            for n, _, _ in found:
                node.kids.append(Node("typevar", n.start, [self.named(n), empty(n.stop), empty(n.stop), kind or empty(n.stop), value or empty(n.stop)]))
            if self.sign(",", ";"):
                self.next()
            elif self.i == before:
                self.next()
        self.close("]")
        return node

    def parameters(self) -> Node:
        t = self.next()
        node = Node("params", t.start)
        self.brackets += 1
        while not self.sign(")") and self.tok.kind != "eof":
            before, found = self.i, self.names()
            kind, value = self.type_after(), self.value_after("=")
            node.kids += [self.binder("param", n, mark, pragma, kind, value) for n, mark, pragma in found]
            if self.sign(",", ";"):
                self.next()
            elif self.i == before:
                self.next()
        self.close(")")
        return node

    def routine(self) -> Node:
        head = self.next()
        at = head.stop
        name = self.named(self.next()) if self.tok.kind == "ident" and not self.fresh() else empty(at)
        mark = self.exported() or empty(at)
        pattern = empty(at)
        if self.sign("{") and not self.pragma_here():
            self.next()
            self.brackets += 1
            pattern = self.expression()
            self.close("}")
        generics = self.generics() if self.sign("[") and not self.fresh() else empty(at)
        params = self.parameters() if self.sign("(") and not self.fresh() else empty(at)
        result = self.type_after() or empty(at)
        pragma = self.pragmas() if self.pragma_here() else empty(at)
        body = empty(at)
        if self.sign("=") and (not self.fresh() or self.tok.indent > self.indent):
            body = self.body(self.next())
        elif self.sign(":") and not self.fresh():
            self.error("missing-routine-equals", "a routine's body follows '='", fix="insert '='")
            body = self.body(self.next())
        elif self.tok.kind != "eof" and self.tok.indent > self.indent and not self.brackets and name.tag != "empty":
            self.error("missing-routine-equals", "a routine's body follows '='", fix="insert '='")
            body = self.body(head)
        return Node(head.text, head.start, [name, mark, pattern, generics, params, result, pragma, empty(at), body])

    # --- types

    def type_expression(self, body: bool = False) -> Node:
        """A type; ``body`` allows objects, enums and tuples with indented fields."""
        t = self.tok
        if t.kind == "keyword":
            if t.text in TYPE_WORDS:
                self.next()
                if self.fresh() or self.sign(",", ")", "]", "=", ";"):
                    return Node(TYPE_WORDS[t.text], t.start)
                return Node(TYPE_WORDS[t.text], t.start, [self.type_expression(body)])
            if t.text == "tuple":
                return self.tuple_type()
            if t.text in ("proc", "iterator", "func"):
                return self.routine_type()
            if t.text == "object" and body:
                return self.object_type()
            if t.text == "enum" and body:
                return self.enum_type()
            if t.text == "concept" and body:
                self.next()
                head = [] if self.fresh() else [self.expression()]
                while self.take(","):
                    head.append(self.expression())
                params = Node("stmts", t.stop, head) if head else empty(t.stop)
                inner = self.body(t) if self.tok.indent > self.indent else empty(t.stop)
                return Node("concept", t.start, [params, empty(t.stop), empty(t.stop), inner])
        outer, self.in_type = self.in_type, True
        out = self.expression(lowest=2)
        self.in_type = outer
        return out

    def tuple_type(self) -> Node:
        t = self.next()
        node = Node("tuple", t.start)
        if self.sign("[") and not self.fresh():
            self.next()
            self.brackets += 1
            while not self.sign("]") and self.tok.kind != "eof":
                before, found = self.i, self.names()
                kind = self.type_after() or empty(t.stop)
                node.kids += [Node("kv", n.start, [self.named(n), kind]) for n, _, _ in found]
                if self.sign(",", ";"):
                    self.next()
                elif self.i == before:
                    self.next()
            self.close("]")
        elif self.tok.indent > self.indent and not self.brackets:
            for f in self.fields():
                node.kids.append(Node("kv", f.at, [f.kids[0], f.kids[3]]) if f.tag == "fld" else f)
        return node

    def routine_type(self) -> Node:
        t = self.next()
        node = Node("itertype" if t.text == "iterator" else "proctype", t.start)
        if self.sign("(") and not self.fresh() or self.pragma_here():
            params = self.parameters() if self.sign("(") else empty(t.stop)
            result = self.type_after() or empty(t.stop)
            pragma = self.pragmas() if self.pragma_here() else empty(t.stop)
            node.kids = [*(empty(t.stop) for _ in range(4)), params, result, pragma, empty(t.stop), empty(t.stop)]
        return node

    def object_type(self) -> Node:
        t = self.next()
        if self.pragma_here():
            self.error("func-in-type-description", "pragmas stand before '=' in a type")
            self.pragmas()
        parent = empty(t.stop)
        if self.word("of") and not self.fresh():
            self.next()
            parent = self.type_expression()
        node = Node("object", t.start, [parent])
        if self.tok.kind != "eof" and self.tok.indent > self.indent:
            node.kids += self.fields()
        return node

    def fields(self) -> list[Node]:
        """Field lines at the indent of the current token."""
        column, out, outer = self.tok.indent, [], self.indent
        self.indent = column
        while self.tok.kind != "eof" and (self.tok.indent == column or (self.tok.indent < 0 and not out)):
            before = self.i
            out += self.field_line()
            if self.i == before:
                self.next()
            while not self.fresh():
                self.next()
        self.indent = outer
        return out

    def field_line(self) -> list[Node]:
        t = self.tok
        if t.kind == "comment":
            return [Node("comment", self.next().start)]
        if self.word("discard", "nil"):
            self.next()
            return []
        if self.word("case"):
            return [self.variant()]
        if self.word("when"):
            self.next()
            node, first, column = Node("when", t.start), True, t.indent
            while first or (self.word("elif", "else") and self.mine(column)):
                b = t if first else self.next()
                condition = [] if b.text == "else" else [self.expression()]
                node.kids.append(Node("else" if b.text == "else" else "elif", b.start, [*condition, self.variant_body(b)]))
                first = False
            return [node]
        found = self.names()
        kind = self.type_after()
        value = self.value_after("=")
        return [self.binder("fld", n, mark, pragma, kind, value) for n, mark, pragma in found]

    def variant(self) -> Node:
        t, column = self.tok, self.tok.indent
        self.next()
        found = self.names()
        kind = self.type_after()
        heads = [self.binder("fld", n, mark, pragma, kind) for n, mark, pragma in found[:1]]
        node = Node("case", t.start, heads or [Node("fld", t.start, [empty(t.stop) for _ in range(5)])])
        self.take(":")
        while self.word("of", "elif", "else") and self.tok.indent >= column:
            b = self.next()
            if b.text == "of":
                values = Node("ranges", b.start)
                if self.sign(":"):
                    self.error("of-without-value", "an 'of' branch needs a value", b)
                while not self.sign(":") and not self.fresh():
                    values.kids.append(self.expression())
                    if not self.take(","):
                        break
                node.kids.append(Node("of", b.start, [values, self.variant_body(b)]))
            else:
                condition = [self.expression()] if b.text == "elif" else []
                node.kids.append(Node(b.text, b.start, [*condition, self.variant_body(b)]))
        return node

    def variant_body(self, head: Token) -> Node:
        if not self.take(":"):
            self.error("expected-colon", f"expected ':' after '{head.text}'", fix="insert ':'")
        at = self.tok.start
        if self.tok.kind == "eof" or 0 <= self.tok.indent <= self.indent:
            self.error("empty-variant-branch", "a branch needs fields, or 'discard'", head)
            return Node("stmts", at, [empty(at)])
        fields = self.fields() if self.tok.indent >= 0 else self.field_line()
        return Node("stmts", at, fields or [Node("nil", at)])

    def enum_type(self) -> Node:
        t = self.next()
        node = Node("enum", t.start, [empty(t.stop)])
        while self.tok.kind != "eof" and (self.tok.indent < 0 or self.tok.indent > self.indent):
            if self.sign(","):
                self.next()
                continue
            if self.tok.kind == "comment":
                self.next()
                continue
            if self.tok.kind != "ident":
                self.error("enum-member-not-identifier", f"an enum member is a name, not '{self.tok.text}'")
                self.next()
                continue
            name = self.next()
            pragma = self.pragmas() if self.pragma_here() else empty(name.stop)
            value = self.value_after("=") or empty(name.stop)
            node.kids.append(Node("efld", name.start, [self.named(name), empty(name.stop), pragma, empty(name.stop), value]))
        return node

    # --- expressions

    def expression(self, lowest: int = 0, command: bool = False) -> Node:
        """An expression whose operators bind at least as tightly as ``lowest``; ``command`` allows ``f a, b``."""
        self.depth += 1
        try:
            if self.depth > MAX_DEPTH:
                return self.too_deep()
            left = self.unary(command)
            while self.infix_here():
                op = self.tok
                level = precedence(op.text)
                if level < lowest or (op.text == "=" and op.kind == "operator"):
                    break
                self.next()
                right = self.expression(level if op.text.startswith("^") or level == 0 else level + 1)
                left = Node("infix", left.at, [Node("ident", op.start, raw=op.text), left, right])
            return left
        finally:
            self.depth -= 1

    def too_deep(self) -> Node:
        at, depth = self.tok.start, 0
        self.error("max-depth", f"nesting deeper than {MAX_DEPTH}")
        while self.tok.kind != "eof" and not self.fresh():
            if self.tok.kind == "bracket":
                if self.tok.text not in CLOSERS and not depth:
                    break
                depth += 1 if self.tok.text in CLOSERS else -1
            self.next()
        return Node("err", at)

    def infix_here(self) -> bool:
        """Whether an operator joins what stands before it with what comes; a line may go on with one if it is deeper."""
        t = self.tok
        if not (t.kind == "operator" or (t.kind == "keyword" and t.text in WORD_OPERATORS)):
            return False
        if t.indent >= 0 and not self.brackets and t.indent <= self.indent:
            return False
        before = self.tokens[self.i - 1]
        spaced = before.stop < t.start
        return not (t.kind == "operator" and spaced and self.peek().start == t.stop and t.text not in ("=",) and self.peek().kind != "eof" and before.kind in ("ident",) and t.indent < 0 and self.prefixable(t))

    @staticmethod
    def prefixable(t: Token) -> bool:
        """Operators that, after a space and before none, are prefixes of an argument."""
        return t.text in ("-", "+", "@", "$", "&", "!", "~", "^", "%", "*", "?")

    def unary(self, command: bool) -> Node:
        t = self.tok
        if t.kind == "operator" and t.text != "=":
            self.next()
            if t.text == "-" and self.tok.kind in ("int", "float") and self.tok.start == t.stop:
                number = self.next()
                return self.suffixed(self.literal(number, "-"), command=False)
            operand = self.unary(False)
            return Node("prefix", t.start, [Node("ident", t.start, raw=t.text), operand])
        if t.kind == "keyword" and t.text in ("not", "static"):
            self.next()
            return Node("prefix", t.start, [Node("ident", t.start, raw=t.text), self.expression(6)])
        return self.suffixed(self.primary(), command)

    def literal(self, t: Token, sign: str = "") -> Node:
        text = t.text
        if t.kind == "int" and t.int_value is not None:
            text = str(t.int_value)
        elif t.kind == "float":
            v = t.float_value
            if v is None or v != v or v in (float("inf"), float("-inf")):
                return Node("nan" if v is None or v != v else "inf" if v > 0 else "neginf", t.start)
            text = repr(v)
        elif t.kind == "char":
            text = str(t.int_value)
        node = Node(LITERAL[t.kind], t.start, raw=sign + text)
        if t.kind in ("rstr", "triplestr"):
            return Node("suf", t.start, [node, Node("str", t.start, raw="R" if t.kind == "rstr" else "T")])
        if t.suffix and t.int_value is None and t.kind == "int":
            return Node("dot", t.start, [Node("suf", t.start, [node, Node("str", t.start, raw="R")]), Node("ident", t.start, raw="'" + t.suffix)])
        return Node("suf", t.start, [node, Node("str", t.start, raw=t.suffix)]) if t.suffix else node

    def primary(self) -> Node:
        t = self.tok
        if t.kind in LITERAL:
            return self.literal(self.next())
        if t.kind == "ident":
            return self.named(self.next())
        if t.kind == "keyword":
            forms = {"if": lambda: self.branches("if"), "when": lambda: self.branches("when"), "case": self.case, "try": self.attempt, "block": self.block, "for": self.for_loop}
            if t.text in forms:
                return Node("expr", t.start, [forms[t.text]()])
            if t.text in ("proc", "func", "iterator"):
                return self.routine()
            if t.text in TYPE_WORDS or t.text == "tuple":
                return self.type_expression()
            if t.text == "cast":
                self.next()
                kind = empty(t.stop)
                if self.sign("["):
                    self.next()
                    self.brackets += 1
                    kind = self.type_expression()
                    self.close("]")
                return Node("cast", t.start, [kind, *self.group("(", ")")])
            if t.text == "nil":
                self.next()
                return Node("nil", t.start)
            self.next()
            return Node("ident", t.start, raw=t.text)
        if self.sign("("):
            return self.parenthesis()
        if self.sign("["):
            return Node("bracket", t.start, self.group("[", "]"))
        if self.sign("{"):
            kids = self.group("{", "}")
            return Node("tabconstr" if kids and all(k.tag == "kv" for k in kids) else "curly", t.start, kids)
        self.error("expression-expected", f"expression expected, but got '{t.text or t.kind}'")
        if not self.fresh() and not self.sign(")", "]", "}", ",", ":", ";"):
            self.next()
        return empty(t.start)

    def parenthesis(self) -> Node:
        t = self.next()
        self.brackets += 1
        kids: list[Node] = []
        tuple_like = False
        while not self.sign(")") and self.tok.kind != "eof":
            before = self.i
            if self.word("let", "var", "const", "discard"):
                kids += self.statement()
            else:
                item = self.argument()
                if self.sign("=") and item.tag != "vv":
                    self.next()
                    item = Node("asgn", item.at, [item, self.expression()])
                kids.append(item)
                tuple_like = tuple_like or item.tag in ("kv", "vv")
            if self.sign(","):
                tuple_like = True
                self.next()
            elif self.sign(";"):
                self.next()
            elif self.i == before:
                self.next()
        self.close(")")
        return Node("tup" if tuple_like or not kids else "par", t.start, kids)

    def group(self, opener: str, closer: str) -> list[Node]:
        """Arguments between brackets."""
        if not self.sign(opener):
            return [empty(self.tok.start)]
        self.next()
        self.brackets += 1
        kids: list[Node] = []
        while not self.sign(closer) and self.tok.kind != "eof":
            before = self.i
            kids.append(self.argument())
            if self.sign(",", ";"):
                self.next()
            elif self.i == before:
                self.next()
        self.close(closer)
        return kids

    def argument(self) -> Node:
        """A value, ``key: value`` or ``key = value``."""
        at = self.tok.start
        left = self.expression(command=True)
        if self.sign(":"):
            self.next()
            return Node("kv", at, [left, self.expression(command=True)])
        if self.sign("="):
            self.next()
            return Node("vv", at, [left, self.expression(command=True)])
        return left

    def suffixed(self, node: Node, command: bool) -> Node:
        """Fields, calls, indexes and pragmas behind an operand; then, if allowed, the arguments of a command."""
        callee = node.tag in ("ident", "quoted", "dot", "at", "call", "par", "cast", "expr", "bracket")
        while True:
            t, before = self.tok, self.tokens[self.i - 1]
            glued = t.start == before.stop
            if t.kind == "dot" and not (self.peek().text == "}" and self.peek().start == t.stop) and (t.indent < 0 or self.brackets or t.indent > self.indent):
                self.next()
                node = Node("dot", node.at, [node, self.primary() if self.tok.kind in ("ident", "keyword") and not self.sign("(") else empty(t.stop)])
                callee = True
            elif self.sign("(") and glued and callee:
                kids = self.group("(", ")")
                node = Node("oconstr" if kids and all(k.tag == "kv" for k in kids) else "call", node.at, [node, *kids])
            elif self.sign("[") and glued:
                node = Node("at", node.at, [node, *self.group("[", "]")])
                callee = True
            elif self.sign("{") and glued and not self.pragma_here() and callee:
                node = Node("curlyat", node.at, [node, *self.group("{", "}")])
            elif t.kind in ("rstr", "triplestr") and glued and node.tag in ("ident", "dot"):
                node = Node("callstrlit", node.at, [node, self.literal(self.next())])
            elif self.pragma_here() and not self.fresh() and not self.in_type:
                node = Node("pragmax", node.at, [node, self.pragmas()])
            else:
                break
        if command and node.tag in ("ident", "quoted", "dot") and self.starts_argument():
            kids = [node, self.argument_of_command()]
            while self.sign(",") and not self.brackets and not self.fresh():
                self.next()
                kids.append(self.argument_of_command())
            node = Node("cmd", node.at, kids)
        return node

    def argument_of_command(self) -> Node:
        at = self.tok.start
        left = self.expression(command=True)
        if self.sign("=") and not self.fresh() and self.tokens[self.i - 1].kind == "ident" and left.tag == "ident":
            self.next()
            return Node("vv", at, [left, self.expression()])
        return left

    def starts_argument(self) -> bool:
        """Whether the current token, after a space, begins the first argument of a command."""
        t, before = self.tok, self.tokens[self.i - 1]
        if self.fresh() or t.start == before.stop or t.indent >= 0:
            return False
        if t.kind in LITERAL or t.kind == "ident":
            return True
        if t.kind == "keyword":
            return t.text in ("nil", "not", "cast", "addr", "proc", "func", "iterator", "if", "when", "case", "try", "block", "ref", "ptr", "var", "tuple", "type")
        if t.kind == "bracket":
            return t.text in "([{" and not self.pragma_here()
        return t.kind == "operator" and self.peek().start == t.stop and self.prefixable(t)


def parse(source: str) -> Tree:
    """The tree of a source, with its diagnostics; leaves hold decoded text."""
    import sys

    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 60 * MAX_DEPTH))
        parser = Parser(source)
        root = parser.module()
    finally:
        sys.setrecursionlimit(limit)
    tree = Tree(source)
    stack: list[Node | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            tree.close()
            continue
        number = tree.open(node.tag, node.at)
        if node.raw is not None:
            tree.made[number] = node.raw
        stack.append(None)
        stack.extend(reversed(node.kids))
    tree.diagnostics = parser.diagnostics
    return tree
