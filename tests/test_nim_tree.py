"""Shapes of the decoded Nim tree."""

import random

import pytest

from treeloom.dialects import nim_tree


def shown(source):
    tree = nim_tree.parse(source)
    kids = [[] for _ in tree.tags]
    for number, parent in enumerate(tree.parents):
        if parent >= 0:
            kids[parent].append(number)

    def one(i):
        raw, tag = tree.made.get(i), tree.tags[i]
        if tag == "empty":
            return "."
        if raw is not None:
            return raw if tag == "ident" else f"{tag}:{raw}"
        return "(" + " ".join([tag, *(one(k) for k in kids[i])]) + ")"

    return " ".join(one(k) for k in kids[0])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a + b * c ^ d", "(infix + a (infix * b (infix ^ c d)))"),
        ("a - b - c", "(infix - (infix - a b) c)"),
        ("not a == b", "(infix == (prefix not a) b)"),
        ("a and b or c", "(infix or (infix and a b) c)"),
        ("-1", "int:-1"),
        ("f a, -1", "(cmd f a int:-1)"),
        ("a -b", "(cmd a (prefix - b))"),
        ("a - b", "(infix - a b)"),
        ("x.y[1](2)", "(call (at (dot x y) int:1) int:2)"),
        ("A(x: 1)", "(oconstr A (kv x int:1))"),
        ("f(k = 2)", "(call f (vv k int:2))"),
        ("(1, 2)", "(tup int:1 int:2)"),
        ("(a)", "(par a)"),
        ("{1: 2}", "(tabconstr (kv int:1 int:2))"),
        ("0xFF'u8", "(suf int:255 str:u8)"),
        ('r"a"', "(suf str:a str:R)"),
        ("x = y", "(asgn x y)"),
        ("let a*, b: int = 1", "(let a x . int int:1) (let b . . int int:1)"),
        ("let (a, b) = t", "(unpackdecl t (unpacktup (let a . . . .) (let b . . . .)))"),
        ("proc f*[T: int](x: T): int {.inline.} =\n  x", "(proc f x . (typevars (typevar T . . int .)) (params (param x . . T .)) int (pragmas inline) . (stmts x))"),
        ("if a: b\nelif c: d\nelse: e", "(if (elif a (stmts b)) (elif c (stmts d)) (else (stmts e)))"),
        ("if a:\n  if b:\n    c\nelse:\n  d", "(if (elif a (stmts (if (elif b (stmts c))))) (else (stmts d)))"),
        ("case x\nof 1, 2: a\nelse: b", "(case x (of (ranges int:1 int:2) (stmts a)) (else (stmts b)))"),
        ("for i, j in x: y", "(for x (unpackflat (let i . . . .) (let j . . . .)) (stmts y))"),
        ("while a:\n  break", "(while a (stmts (break .)))"),
        ("try:\n  a\nexcept E:\n  b\nfinally:\n  c", "(try (stmts a) (except E (stmts b)) (fin (stmts c)))"),
        ("import a, b/c", "(import a (infix / b c))"),
        ("from a import b", "(fromimport a b)"),
        ("import a except b", "(importexcept a b)"),
        ("type A = ref object of B\n  x*: int", "(type A . . . (ref (object B (fld x x . int .))))"),
        ("type E = enum a = 1, b", "(type E . . . (enum . (efld a . . . int:1) (efld b . . . .)))"),
        ("type T = tuple[a: int]", "(type T . . . (tuple (kv a int)))"),
        ("var x = if a: 1 else: 2", "(var x . . . (expr (if (elif a (stmts int:1)) (else (stmts int:2)))))"),
        ("f(x):\n  y", "(call f x (stmts y))"),
        ("return\ndiscard x", "(ret .) (discard x)"),
        ("## doc\nx", "(comment) x"),
        ("`+ =`(a)", "(call (quoted + =) a)"),
    ],
)
def test_shape(source, want):
    assert shown(source) == want


@pytest.mark.parametrize(
    ("source", "code"),
    [("if a\n  b", "expected-colon"), ("for i x: y", "expected-in"), ("if a:\nb", "expected-indented-body"), ("case x\nof: a", "of-without-value"), ("type A object", "missing-type-equals"), ("proc f()\n  x", "missing-routine-equals"), ("type E = enum\n  a, 1", "enum-member-not-identifier"), ("type A = object\n  case k: K\n  of a:\n", "empty-variant-branch")],
)
def test_diagnostics(source, code):
    assert code in [d.code for d in nim_tree.parse(source).diagnostics]


def test_nothing_raises():
    rng = random.Random(2)
    pieces = [*"if else elif for in while case of type proc let var object enum try except ( ) [ ] { } {. .} : = , ; . + - == a b 1 1.5 \"s\" 'c' do not import from return ref tuple cast concept".split(), "\n", "\n  ", "\n    "]
    for _ in range(3000):
        tree = nim_tree.parse(" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))))
        assert tree.level == 0
    for source in ("(" * 5000, "a(" * 3000, "if a:\n" * 2000, "- " * 3000, "x = " * 2000, "not " * 3000, "a.b" * 3000, "".join(" " * i + "if x:\n" for i in range(400))):
        assert nim_tree.parse(source).level == 0
