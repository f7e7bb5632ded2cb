"""Grammar checks on Nim tokens: habits from other languages, and advisory lints that are asked for by name.

A rule is a generator over the significant tokens that yields what it objects
to; none changes the tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .nim import CLOSERS, PAIRS, Token
from .tree import Diagnostic

# Routine keywords, and keywords and clauses of other languages.
ROUTINES = frozenset("proc func method iterator converter template macro".split())
FOREIGN_ROUTINES = frozenset("fn function fun".split())
FOREIGN_BLOCKS = frozenset("class struct interface impl trait namespace module".split())
FOREIGN_CASES = frozenset("switch match".split())
CLAUSES = {
    "throws": "declare the effect with a pragma: {.raises: [IOError].}",
    "where": "put the constraint in the brackets: proc f[T: Constraint]()",
    "override": "Nim needs no 'override'; use 'method' for dynamic dispatch",
    "noexcept": "declare no exceptions with a pragma: {.raises: [].}",
}
WORD_OPERATORS = frozenset("and or xor div mod shl shr in notin is isnot not of".split())
LITERALS = frozenset("int float str rstr triplestr char".split())
CONDITIONS = frozenset("if elif while when".split())

Found = Iterator[Diagnostic]
Rule = Callable[["Tokens", int], Found]
ALWAYS: list[Rule] = []
LINTS: dict[str, list[Rule]] = {}


def always(rule: Rule) -> Rule:
    ALWAYS.append(rule)
    return rule


def lint(name: str) -> Callable[[Rule], Rule]:
    def add(rule: Rule) -> Rule:
        LINTS.setdefault(name, []).append(rule)
        return rule

    return add


class Tokens(list):
    """Significant tokens; past the ends there are empty ones."""

    NONE = Token("none", "", -1, -1, -1, -1, -1, -1)

    def at(self, i: int) -> Token:
        return self[i] if 0 <= i < len(self) else self.NONE

    def word(self, i: int, *texts: str) -> bool:
        """Whether a keyword of these stands at ``i``."""
        t = self.at(i)
        return t.kind == "keyword" and t.text in texts

    def op(self, i: int, *texts: str) -> bool:
        t = self.at(i)
        return t.kind == "operator" and t.text in texts

    def name(self, i: int, *texts: str) -> bool:
        t = self.at(i)
        return t.kind == "ident" and (not texts or t.text in texts)

    def leads(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return self.at(i - 1).line != self.at(i).line

    def truth(self, i: int) -> bool:
        return self.name(i, "true", "false")

    def close_of(self, i: int) -> int:
        """Place of the bracket that closes the one at ``i``, or -1."""
        depth = 0
        for j in range(i, len(self)):
            if self[j].kind == "bracket":
                depth += 1 if self[j].text in CLOSERS else -1
                if not depth:
                    return j
        return -1

    def flat(self, i: int, one_line: bool = True) -> Iterator[int]:
        """Places after ``i`` outside brackets, closers of outer brackets included, up to the end of its line."""
        depth = 0
        for j in range(i + 1, len(self)):
            t = self[j]
            if t.kind == "eof" or (one_line and t.line != self[i].line):
                return
            if t.kind == "bracket" and t.text in CLOSERS:
                if not depth:
                    yield j
                depth += 1
            elif t.kind == "bracket":
                depth -= 1
                if depth <= 0:
                    yield j
                depth = max(0, depth)
            elif not depth:
                yield j


def said(code: str, message: str, at: Token, to: Token | None = None, fix: str = "", severity: str = "error") -> Diagnostic:
    return Diagnostic(code, message, at.start, severity, (to or at).stop - at.start, fix)


def hint(code: str, message: str, at: Token, fix: str, to: Token | None = None) -> Diagnostic:
    return said(code, message, at, to, fix, "hint")


def binding(ts: Tokens, i: int) -> bool:
    """A let, const or var that introduces names; var inside a line is a type modifier."""
    return ts.word(i, "let", "const") or (ts.word(i, "var") and ts.leads(i))


# --- always on


@always
def names_a_binding(ts: Tokens, i: int) -> Found:
    if ts.word(i, "let", "const"):
        nxt = ts.at(i + 1)
        if nxt.kind == "eof":
            yield said("identifier-expected", f"identifier expected after '{ts[i].text}'", ts[i])
        elif nxt.kind != "ident" and nxt.text != "(":
            yield said("identifier-expected", f"identifier expected after '{ts[i].text}', but got '{nxt.text or nxt.kind}'", nxt)


@always
def has_a_condition(ts: Tokens, i: int) -> Found:
    if not ts.word(i, *CONDITIONS):
        return
    word = ts[i].text
    if ts.at(i + 1).kind == "colon":
        yield said("expected-condition", f"'{word}' requires a condition before ':'", ts[i], fix=f"add a condition, e.g. '{word} cond:'")
        return
    for j in ts.flat(i):
        if ts[j].kind == "colon" or ts[j].text in PAIRS and ts[j].kind == "bracket" and ts.close_of(j) < 0 and not _closes_inside(ts, i, j):
            return
        if ts.op(j, "="):
            yield said("assignment-in-condition", f"'=' assigns; this '{word}' condition needs a comparison", ts[j], fix="did you mean '=='?")
            return


def _closes_inside(ts: Tokens, i: int, j: int) -> bool:
    """Whether the closer at ``j`` closes a bracket that opened after ``i``."""
    return any(ts[k].kind == "bracket" and ts[k].text in CLOSERS and ts.close_of(k) == j for k in range(i + 1, j))


@always
def binds_with_equals(ts: Tokens, i: int) -> Found:
    if not binding(ts, i):
        return
    for j in ts.flat(i):
        if ts.op(j, "="):
            return
        if ts.op(j, "=="):
            yield said("comparison-in-binding", f"'==' compares; a '{ts[i].text}' binding needs '='", ts[j], fix="did you mean '='?")
            return
        if ts.op(j, ":="):
            yield said("walrus-in-binding", f"':=' belongs to other languages; a '{ts[i].text}' binding uses '='", ts[j], fix="did you mean '='?")
            return


@always
def qualifies_with_a_dot(ts: Tokens, i: int) -> Found:
    if ts.op(i, "::"):
        yield said("double-colon", "'::' is not valid Nim; qualify with '.' or annotate with ':'", ts[i], fix="use '.' or ':'")
    if ts.op(i, "/*"):
        yield said("c-block-comment", "block comments are '#[ ... ]#'", ts[i], fix="use '#[ ... ]#'")


@always
def types_a_binding(ts: Tokens, i: int) -> Found:
    if not binding(ts, i) or not ts.name(i + 1) or ts[i + 1].line != ts[i].line:
        return
    if ts.name(i + 1, "mut") and ts.name(i + 2):
        yield said("mut-not-a-keyword", "Nim has no 'mut'; a mutable binding is 'var'", ts[i], ts[i + 1], "use 'var' and drop 'mut'")
    n = i + 3 if ts.op(i + 2, "*") else i + 2
    if ts.name(n) and ts[n].line == ts[i].line:
        yield said("go-var-notype", f"a typed binding needs a ':': '{ts[i + 1].text}: {ts[n].text}'", ts[n], fix="insert ':' after the name")


@always
def ends_by_indentation(ts: Tokens, i: int) -> Found:
    if ts.word(i, "end") and ts.leads(i):
        yield said("stray-end", "'end' is not a statement; indentation ends a block", ts[i], fix="remove the 'end'")


@always
def heads_a_routine(ts: Tokens, i: int) -> Found:
    """Generics in angle brackets, braces for a body, arrows and clauses in a routine's head."""
    if not ts.word(i, *ROUTINES):
        return
    if ts.name(i + 1) and ts[i + 1].line == ts[i].line:
        n = i + 3 if ts.op(i + 2, "*") else i + 2
        if ts.op(n, "<") and ts[n].line == ts[i].line:
            yield said("angle-bracket-generics", "generics use '[T]', not '<T>'", ts[n], fix="write proc f[T](...)")
    parameters = typed = False
    for j in ts.flat(i):
        t = ts[j]
        if ts.op(j, "="):
            return
        if t.text == ")" and t.kind == "bracket":
            parameters = True
        elif t.text == "{" and t.kind == "bracket" and parameters and ts.at(j + 1).kind != "dot" and not ts.op(j + 1, "."):
            if not ts.curly:
                yield said("c-brace-body", "'{' is not a block; indent the body after '='", t, fix="replace the braces with '=' and an indented body")
                return
        elif typed:
            continue
        elif t.kind == "colon":
            typed = True
        elif ts.op(j, "->"):
            yield said("arrow-return-type", "'->' is not a return type; write it after ':'", t, fix="write proc f(): T")
            typed = True
        elif parameters and t.kind == "ident" and t.text in CLAUSES:
            yield said("foreign-routine-clause", f"'{t.text}' is not a routine clause: {CLAUSES[t.text]}", t, fix=CLAUSES[t.text])
            typed = True


def _brace(ts: Tokens, i: int) -> int:
    """The first ``{`` outside brackets on the line of ``i`` before any ``=``, or -1; one that opens a pragma does not count."""
    for j in ts.flat(i):
        if ts.op(j, "="):
            return -1
        if ts[j].kind == "bracket" and ts[j].text == "{":
            return -1 if ts.at(j + 1).kind == "dot" else j
    return -1


@always
def speaks_another_language(ts: Tokens, i: int) -> Found:
    word = ts[i].text
    if ts[i].kind not in ("ident", "keyword") or not ts.leads(i):
        return
    if word in FOREIGN_ROUTINES and ts[i].kind == "ident" and ts.name(i + 1) and ts[i + 1].line == ts[i].line:
        j = _brace(ts, i)
        if j >= 0 and any(ts[k].text == ")" for k in range(i, j)):
            yield said("foreign-function-keyword", f"'{word}' is not a Nim keyword; define a routine with 'proc'", ts[i], fix=f"use 'proc {ts[i + 1].text}() = ...'")
    if word in FOREIGN_BLOCKS or (word in FOREIGN_CASES and ts[i].kind == "ident"):
        j = _brace(ts, i)
        if j < 0 or ts.at(j + 1).line == ts[i].line and ts.at(j + 1).kind != "eof":
            return
        if word in FOREIGN_CASES:
            yield said("foreign-case-block", f"'{word}' is not a Nim keyword; use 'case <expr>:' with 'of' branches", ts[i], fix="use 'case' and 'of'")
        else:
            name = ts[i + 1].text if ts.name(i + 1) else "Name"
            advice = "a module is a file; import it" if word in ("namespace", "module") else f"declare a type with 'type {name} = object'"
            yield said("foreign-block-keyword", f"'{word}' is not a Nim keyword: {advice}", ts[i], fix=advice)


@always
def does_blocks(ts: Tokens, i: int) -> Found:
    nxt = ts.at(i + 1)
    if ts.word(i, "do") and nxt.line == ts[i].line:
        if nxt.text == "{" and ts.at(i + 2).kind != "dot":
            yield said("do-while-loop", "Nim has no 'do { }' loop; use 'while <cond>:'", ts[i], fix="use 'while <cond>:'")
        elif ts.op(i + 1, "|"):
            yield said("ruby-block-params", "block parameters are 'do (x):'", ts[i], fix="write 'do (x): <body>'")


@always
def inherits_with_of(ts: Tokens, i: int) -> Found:
    if ts.word(i, "type") and ts.name(i + 1) and ts[i + 1].line == ts[i].line:
        for j in ts.flat(i + 1):
            if ts.op(j, "="):
                return
            if ts.name(j, "extends"):
                yield said("extends-inheritance", f"'extends' is not Nim; inherit with 'type {ts[i + 1].text} = object of Base'", ts[j], fix="inherit with 'object of Base'")
                return


@always
def joins_words(ts: Tokens, i: int) -> Found:
    """Two words in a row that Nim writes otherwise."""
    nxt = ts.at(i + 1)
    if nxt.line != ts[i].line:
        return
    if ts.word(i, "yield") and ts.word(i + 1, "from"):
        yield said("yield-from", "Nim has no 'yield from'; iterate and yield", ts[i], nxt, "for x in xs: yield x")
    if ts.name(i, "async") and ts.word(i + 1, *ROUTINES) and ts.name(i + 2) and ts[i + 2].line == ts[i].line:
        yield said("async-routine-prefix", "'async' is not a keyword; mark a routine with '{.async.}'", ts[i], fix=f"write 'proc {ts[i + 2].text}() {{.async.}} = ...'")
    if ts.word(i, "else") and ts.word(i + 1, "if"):
        yield said("else-if-not-elif", "'else if' is not Nim; use 'elif'", ts[i], nxt, "replace 'else if' with 'elif'")


@always
def has_expressions(ts: Tokens, i: int) -> Found:
    t = ts[i]
    if t.kind == "comma" and (ts.at(i - 1).kind == "comma" or (ts.at(i - 1).kind == "bracket" and ts.at(i - 1).text in "([")):
        yield said("expression-expected", "expression expected before ','", t)
    if t.kind != "eof" and ts.at(i + 1).kind in ("eof", "none"):
        if t.kind in ("comma", "dot") or (t.kind == "operator" and t.text != "=") or (t.kind == "keyword" and t.text in WORD_OPERATORS):
            yield said("expression-expected", f"expression expected after '{t.text}'", t)


# --- asked for by name


@lint("c-operators")
def c_operators(ts: Tokens, i: int) -> Found:
    if ts.op(i, "&&", "||"):
        word = "and" if ts[i].text == "&&" else "or"
        yield said("c-style-operator", f"'{ts[i].text}' is not a boolean operator; use '{word}'", ts[i], fix=f"use '{word}' (mind operator precedence)", severity="warning")


@lint("semicolons")
def semicolons(ts: Tokens, i: int) -> Found:
    if ts[i].kind == "semicolon" and not ts.depths[i] and (ts.at(i + 1).kind == "eof" or ts.at(i + 1).line != ts[i].line):
        yield said("redundant-semicolon", "redundant ';' at the end of a line", ts[i], fix="remove the ';'", severity="warning")


@lint("idioms")
def bool_literals(ts: Tokens, i: int) -> Found:
    if ts.op(i, "==", "!="):
        literal = next((ts[j].text for j in (i + 1, i - 1) if ts.truth(j)), "")
        if literal:
            same = (ts[i].text == "==") == (literal == "true")
            yield hint("redundant-bool-literal", f"comparing to '{literal}' is redundant", ts[i], "use the expression itself" if same else "rewrite as 'not <expr>'")


@lint("idioms")
def negations(ts: Tokens, i: int) -> Found:
    if not ts.word(i, "not"):
        return
    if ts.word(i + 1, "not"):
        yield hint("double-negation", "'not not' is a double negation", ts[i], "remove both", ts[i + 1])
    elif ts.name(i + 1):
        k = i + 1  # last token of the operand: a name with fields, indexes and calls
        while True:
            if ts.at(k + 1).kind == "dot" and ts.name(k + 2):
                k += 2
            elif ts.at(k + 1).kind == "bracket" and ts.at(k + 1).text in "([" and ts.close_of(k + 1) > 0:
                k = ts.close_of(k + 1)
            else:
                break
        name = ts[i + 1].text
        if ts.word(k + 1, "in"):
            yield hint("not-in-precedence", f"'not {name} in ...' means '(not {name}) in ...'", ts[i], "use 'x notin y'", ts[k + 1])
        elif ts.op(k + 1, "==", "!="):
            want = "!=" if ts[k + 1].text == "==" else "=="
            yield hint("not-compare-precedence", f"'not {name} {ts[k + 1].text} ...' means '(not {name}) {ts[k + 1].text} ...'", ts[i], f"use '{want}'", ts[k + 1])


def _answer(ts: Tokens, i: int) -> tuple[str, str, int]:
    """The branch ``return <bool>`` or ``result = <bool>`` at ``i``: its kind, its value, and what follows."""
    if ts.word(i, "return") and ts.truth(i + 1):
        return "return", ts[i + 1].text, i + 2
    if ts.name(i, "result") and ts.op(i + 1, "=") and ts.truth(i + 2):
        return "result", ts[i + 2].text, i + 3
    return "", "", i


@lint("idioms")
def boolean_returns(ts: Tokens, i: int) -> Found:
    if not ts.word(i, "if") or ts[i].indent < 0:
        return
    colon = next((j for j in ts.flat(i, one_line=False) if ts[j].kind == "colon"), -1)
    if colon <= i + 1:
        return
    kind, value, j = _answer(ts, colon + 1)
    if not kind or not ts.word(j, "else") or ts[j].indent != ts[i].indent or ts.at(j + 1).kind != "colon":
        return
    other, opposite, end = _answer(ts, j + 2)
    after = ts.at(end)
    if other == kind and opposite != value and (after.kind in ("eof", "none") or 0 <= after.indent <= ts[i].indent):
        lead = "result = " if kind == "result" else "return "
        yield hint("simplify-boolean-return", f"this 'if' only tells its condition; {lead}it directly", ts[i], f"replace it with '{lead}{'<condition>' if value == 'true' else 'not (<condition>)'}'")


@lint("float-equality")
def float_equality(ts: Tokens, i: int) -> Found:
    if ts.op(i, "==", "!=") and "float" in (ts.at(i + 1).kind, ts.at(i - 1).kind) and not (ts.truth(i + 1) or ts.truth(i - 1)):
        yield hint("float-equality", f"'{ts[i].text}' on a float literal is unreliable", ts[i], "compare with a tolerance")


@lint("nil-comparison")
def nil_comparison(ts: Tokens, i: int) -> Found:
    if ts.op(i, "==", "!=") and (ts.word(i + 1, "nil") or ts.word(i - 1, "nil")):
        yield hint("nil-comparison", f"'{ts[i].text} nil': prefer 'isNil'", ts[i], "use 'x.isNil'" if ts[i].text == "==" else "use 'not x.isNil'")


@lint("yoda")
def yoda(ts: Tokens, i: int) -> Found:
    if ts.op(i, "==", "!=") and ts.at(i - 1).kind in LITERALS:
        right = ts.at(i + 1)
        if right.kind not in LITERALS and right.kind != "none" and not ts.truth(i + 1) and not ts.word(i + 1, "nil"):
            yield hint("yoda-condition", f"a literal on the left of '{ts[i].text}'", ts[i], "put the value first")


@lint("redundant-parens")
def redundant_parens(ts: Tokens, i: int) -> Found:
    if ts.word(i, *CONDITIONS) and ts.at(i + 1).text == "(" and ts.at(i + 1).kind == "bracket":
        end = ts.close_of(i + 1)
        inside = [ts[j] for j in ts.flat(i + 1, one_line=False) if j < end]
        bears = any(t.kind in ("semicolon", "comma") or (t.kind == "keyword" and t.text in ("let", "var", "const")) for t in inside)
        if end > 0 and not bears and ts.at(end + 1).kind == "colon":
            yield hint("redundant-parens-condition", f"'{ts[i].text}' needs no parentheses around its condition", ts[i + 1], "drop the outer parentheses")


@lint("empty-string")
def empty_string(ts: Tokens, i: int) -> Found:
    if ts.op(i, "&") and any(ts.at(j).kind == "str" and not ts[j].text for j in (i + 1, i - 1)):
        yield hint("empty-string-concat", 'concatenating "" changes nothing', ts[i], 'drop the ""')


@lint("debug-echo")
def debug_echo(ts: Tokens, i: int) -> Found:
    if ts.name(i, "echo") and ts[i].indent >= 0:
        yield hint("debug-echo", "'echo' statement: a debug print", ts[i], "remove it or use a logger")


@lint("range-index")
def range_index(ts: Tokens, i: int) -> Found:
    if not ts.op(i, ".."):
        return
    depth, last = 0, i
    for j in range(i + 1, len(ts)):
        t = ts[j]
        if t.kind == "eof" or (not depth and ((last > i and t.line != ts[i].line) or t.kind in ("colon", "comma") or (t.kind == "bracket" and t.text in PAIRS))):
            break
        if t.kind == "bracket":
            depth += 1 if t.text in CLOSERS else -1
        last = j
    if last > i + 1 and ts[last].kind == "int" and ts[last].text == "1" and ts.op(last - 1, "-"):
        yield hint("manual-range-index", "'.. n - 1': a half-open '..< n' says the same", ts[i], "use '..<' and drop the '- 1'")


@lint("broad-exception")
def broad_exception(ts: Tokens, i: int) -> Found:
    if ts.word(i, "except") and ts.name(i + 1, "Exception"):
        yield hint("broad-exception", "'except Exception' also catches Defects", ts[i + 1], "catch 'CatchableError' or a specific type")
    elif ts.name(i, "newException") and ts.at(i + 1).text == "(" and ts.name(i + 2, "Exception"):
        yield hint("broad-exception", "raising the base 'Exception' is too broad", ts[i + 2], "raise a specific type")


@lint("bare-except")
def bare_except(ts: Tokens, i: int) -> Found:
    if ts.word(i, "except") and ts.at(i + 1).kind == "colon":
        yield hint("bare-except", "a bare 'except:' catches Defects too", ts[i], "name what is handled")


@lint("cast")
def cast_used(ts: Tokens, i: int) -> Found:
    if ts.word(i, "cast") and ts.at(i + 1).text == "[":
        yield hint("cast-used", "'cast' reinterprets memory unchecked", ts[i], "prefer a checked conversion")


@lint("converter")
def converter_defined(ts: Tokens, i: int) -> Found:
    if ts.word(i, "converter"):
        yield hint("converter-defined", "a 'converter' converts implicitly", ts[i], "prefer an explicit proc")


@lint("addr")
def addr_of(ts: Tokens, i: int) -> Found:
    if ts.word(i, "addr") or ts.name(i, "unsafeAddr"):
        yield hint("addr-of", f"'{ts[i].text}' takes a raw address", ts[i], "keep the value by ref or var")


@lint("asm")
def asm_block(ts: Tokens, i: int) -> Found:
    if ts.word(i, "asm"):
        yield hint("asm-block", "inline 'asm' is not portable", ts[i], "prefer Nim or a foreign function")


def check(tokens: list[Token], lints: tuple[str, ...] = (), curly: bool = False) -> list[Diagnostic]:
    """What the always-on rules and the named lints object to; ``curly`` allows braces as bodies."""
    unknown = set(lints) - set(LINTS)
    if unknown:
        raise ValueError(f"unknown lints {sorted(unknown)}; there are {sorted(LINTS)}")
    ts = Tokens(t for t in tokens if t.kind != "comment")
    ts.curly, ts.depths, depth = curly, [], 0
    for t in ts:
        if t.kind == "bracket":
            depth = depth + 1 if t.text in CLOSERS else max(0, depth - 1)
        ts.depths.append(depth)
    rules = [r for name in lints for r in LINTS[name]] + ALWAYS
    return [d for rule in rules for i in range(len(ts)) for d in rule(ts, i)]
