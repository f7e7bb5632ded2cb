"""Each rule fires on what it is for and stays silent on near misses."""

import pytest

from treeloom.dialects import nim, nim_checks


def codes(source, *lints, curly=False):
    return [d.code for d in nim_checks.check(nim.tokenize(source)[0], lints, curly)]


@pytest.mark.parametrize(
    ("code", "bad", "good"),
    [
        ("identifier-expected", "let 1 = 2", "let (a, b) = c"),
        ("expected-condition", "if: x", "if x: y"),
        ("assignment-in-condition", "if a = b: c", "if a == b: c = d"),
        ("assignment-in-condition", "while x = 1:", "if f(a = 1): c"),
        ("comparison-in-binding", "let x == 1", "let x = a == 1"),
        ("walrus-in-binding", "var x := 1", "let x = f(y)"),
        ("double-colon", "a::b", "a.b"),
        ("mut-not-a-keyword", "let mut x = 1", "let mut = 1"),
        ("go-var-notype", "var x int", "var x: int"),
        ("stray-end", "if a:\n  b\nend", "let x = y"),
        ("angle-bracket-generics", "proc f<T>(x: T) = discard", "proc f[T](x: T) = discard"),
        ("c-brace-body", "proc f() {\n", "proc f() {.inline.} = discard"),
        ("foreign-function-keyword", "fn f() {\n", "let fn = 1"),
        ("foreign-block-keyword", "class A {\n", "class = 1"),
        ("foreign-block-keyword", "interface A {\n", "struct(a)"),
        ("foreign-case-block", "switch x {\n", "match(x)"),
        ("do-while-loop", "do {\n", "f do (x):\n  y"),
        ("ruby-block-params", "each do |x|\n", "each do (x):\n  y"),
        ("c-block-comment", "/* x */", "a / b"),
        ("extends-inheritance", "type A extends B", "type A = object of B"),
        ("yield-from", "yield from x", "yield x"),
        ("async-routine-prefix", "async proc f() = x", "proc f() {.async.} = x"),
        ("arrow-return-type", "proc f() -> int = 1", "proc f(): int = 1"),
        ("foreign-routine-clause", "proc f() throws = 1", "proc f(where: int) = 1"),
        ("else-if-not-elif", "else if x:", "else:\n  if x: y"),
        ("expression-expected", "f(, a)", "f(a, b)"),
        ("expression-expected", "x +", "x + y"),
    ],
)
def test_always_on(code, bad, good):
    assert code in codes(bad)
    assert code not in codes(good)


@pytest.mark.parametrize(
    ("name", "code", "bad", "good"),
    [
        ("c-operators", "c-style-operator", "a && b", "a and b"),
        ("semicolons", "redundant-semicolon", "a = 1;\nb", "a; b"),
        ("semicolons", "redundant-semicolon", "a = 1;", "proc f(a: int;\n  b: int) = x"),
        ("idioms", "redundant-bool-literal", "x == true", "x == y"),
        ("idioms", "double-negation", "not not x", "not x"),
        ("idioms", "not-in-precedence", "not a.b[1] in c", "not (a in b)"),
        ("idioms", "not-compare-precedence", "not a == b", "not (a == b)"),
        ("idioms", "simplify-boolean-return", "if a:\n  return true\nelse:\n  return false", "if a:\n  return true\nelse:\n  return true"),
        ("float-equality", "float-equality", "x == 1.5", "x < 1.5"),
        ("nil-comparison", "nil-comparison", "x != nil", "x.isNil"),
        ("yoda", "yoda-condition", "1 == x", "1 == 2"),
        ("redundant-parens", "redundant-parens-condition", "if (a): b", "if (a) and (b): c"),
        ("redundant-parens", "redundant-parens-condition", "while (a):", "if (let x = f(); x): b"),
        ("empty-string", "empty-string-concat", 'a & ""', 'a & "b"'),
        ("debug-echo", "debug-echo", "echo x", "let y = echo"),
        ("range-index", "manual-range-index", "for i in 0 .. n - 1:", "for i in 0 .. n:"),
        ("broad-exception", "broad-exception", "except Exception:", "except ValueError:"),
        ("broad-exception", "broad-exception", "newException(Exception, x)", "newException(ValueError, x)"),
        ("bare-except", "bare-except", "except:", "except ValueError:"),
        ("cast", "cast-used", "cast[int](x)", "int(x)"),
        ("converter", "converter-defined", "converter f(x: int): A = y", "proc f(x: int): A = y"),
        ("addr", "addr-of", "addr x", "x"),
        ("asm", "asm-block", 'asm "nop"', "x"),
    ],
)
def test_lints(name, code, bad, good):
    assert code in codes(bad, name)
    assert code not in codes(good, name)
    assert code not in codes(bad)


def test_options():
    assert codes("proc f() {\n", curly=True) == []
    with pytest.raises(ValueError):
        codes("x", "nope")
