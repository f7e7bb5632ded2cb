"""Parsers without Spark: bytes survive, and trees have the shape that the text has."""

import io
import json as stdlib_json
import random
import tokenize as stdlib_tokenize

import pytest

from treeloom.dialects import cfg, css, html, js, json, md, nim, py, vds, yaml
from treeloom.dialects.specs import DIALECTS, OPAQUE, PUNCT, STRUCT, TEXT, dialect
from treeloom.functions import json_tape as jt
from treeloom.operators import gates

MODULES = {"css": css, "html": html, "js": js, "json": json, "md": md, "py": py, "vds": vds, "yaml": yaml, "cfg": cfg}
PIECES = {
    "html": ["<p>", "</p>", "<", ">", "/", "=", '"', "'", "a", "<br/>", "<script>", "</script>", "<!--", "-->", "<!", "<?", " x", "<li", "=y", "<![CDATA[", "]]>", "\n", "é"],
    "css": ["a{", "}", "b:c", ";", "@m ", "(", ")", "url(", '"x', '"', "'", "/*", "*/", "1px", "50%", "#h", "\\", " ", "\n", "--x:", "!", "[", "]", ",", ".5e3", "ß"],
    "json": ["{", "}", "[", "]", ",", ":", '"a"', '"', "1", "-", "true", "x", " ", "\\", "\n", "+.e"],
    "js": ["(", ")", "{", "}", "[", "]", "/", "a", "=", "`", "${", '"', "'", "\\", "//", "/*", "*/", "\n", "return ", "1.5e3n", ".", "x"],
    "py": ["def f():", "\n", "    ", "\t", "x", "(", ")", "[", '"', "'", '"""', "'''", "#c", "\\", "return 1", "if x:", 'r"', ":", "0x1"],
    "md": ["# h\n", "- a\n", "```\n", "~~~", "> q\n", "\n", "  x", "text\n", "1. ", "\r\n", "\r", "\t", "####### ", " -"],
    "cfg": ["[a]\n", "k=v", "#c", "\n", '"', ";", "--x:", "-y", "@if ", "=", ":", " ", "\t", "\r\n", "]", "["],
    "vds": ["<a>", " | ", " || ", " && ", "[", "]", "{1,2}", "*", "+", "?", "foo(", ")", "(", "{", "}", '"', "'", "12", "/", ",", "<'p'>", "<[", " "],
    "yaml": ["- ", "a: ", "b\n", "{", "}", "[", "]", ", ", "#c", "\n", "  ", "---\n", "...", "%Y\n", "|\n", '"', "'", ":", "&x ", "!t ", "\t", "\\", "\r\n", ">-\n"],
}


def latin(text):
    return text.encode().decode("latin-1")


def parsed(name, text):
    return dialect(name).parse(latin(text))


def rendered(name, tree):
    literals = PUNCT.get(name, {})
    return b"".join(raw if raw is not None else literals.get(tag, "").encode() for tag, raw in zip(tree.tags, tree.raws(), strict=True) if tag != "code")


def count(name, text, tag):
    return parsed(name, text).tags.count(tag)


def nesting(name, text, tag):
    tree = parsed(name, text)
    depth = []
    for number, parent in enumerate(tree.parents):
        depth.append((depth[parent] if parent >= 0 else 0) + (tree.tags[number] == tag))
    return max(depth)


def codes(name, text):
    return [d.code for d in parsed(name, text).diagnostics]


@pytest.mark.parametrize("name", PIECES)
def test_any_text_survives(name):
    rng = random.Random(name)
    declared = {t for group in (STRUCT, TEXT) for t in group[name].split()} | set(PUNCT.get(name, {})) | set(OPAQUE.get(name, "").split())
    for _ in range(2500):
        text = "".join(rng.choice(PIECES[name]) for _ in range(rng.randint(0, 14)))
        tree = parsed(name, text)
        assert rendered(name, tree) == text.encode(), text
        assert tree.level == 0 and set(tree.tags) <= declared
        for number, (parent, end) in enumerate(zip(tree.parents, tree.ends, strict=True)):
            assert parent < number < end and (parent < 0 or end <= tree.ends[parent])
        tokens = dialect(name).tokens
        if tokens:
            found = tokens(latin(text))
            assert all(a < b for _, a, b in found) and "".join(latin(text)[a:b] for _, a, b in found) == latin(text)


def same_trees(text, sizes):
    for size, (tree, _) in zip(sizes, html.prefixes(text, sizes), strict=True):
        want = html.parse(text[:size])
        for part in ("tags", "offsets", "spans", "parents", "depths", "ends", "diagnostics"):
            assert getattr(tree, part) == getattr(want, part), (text, size, part)


def test_prefixes_have_the_trees_that_they_have_alone():
    rng = random.Random("prefixes")
    pieces = [*PIECES["html"], "</SCRIPT", "</scriptx>", "<title a='>'>", "</title >", "<TITLE/>", "<style\0>", "</style\0>", "-", "!", "[", "</", "<textarea", "ſ"]
    for _ in range(1500):
        text = latin("".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))))
        same_trees(text, range(len(text) + 1))
        same_trees(text, sorted(rng.choices(range(len(text) + 2), k=4)))


def test_prefixes_do_not_parse_again_what_they_share(monkeypatch):
    """129 prefixes used to parse 65 times as many tags as the page has."""
    text, parsed_tags, start_tag = "<p>a</p><br>" * 2000, [], html._start_tag
    monkeypatch.setattr(html, "_start_tag", lambda *a: parsed_tags.append(1) or start_tag(*a))
    cuts = range(0, len(text) + 1, len(text) // gates.SAMPLES)
    assert gates.failed_from(html.prefixes(text, cuts), text, cuts, gates._rendered("html")) == 0
    assert len(parsed_tags) <= 4000 + 2 * len(cuts)


def test_truncations_that_lose_bytes_are_counted(monkeypatch):
    """As many as when each prefix is parsed alone: of a parser that loses bytes at the end of its input, of one that always does, and when rendering."""
    text, start_tag, rendering = "<ul id=a><li class='b' c>x<br/></li></ul><!-- d --><style>e{}</style>", html._start_tag, gates._rendered("html")
    cuts = range(len(text) + 1)

    def both(rendered):
        found = gates.failed_from(html.prefixes(text, cuts), text, cuts, rendered)
        assert found == sum(rendered(html.parse(text[:n])) != text[:n] for n in cuts)
        return found

    def at_end(tree, toks, i, size):
        found = start_tag(tree, toks, i, size)
        if found[0] == len(toks) and toks[-1][0] != "gt":
            tree._rows.pop(), tree.ends.pop()
        return found

    assert both(rendering) == 0
    assert both(lambda tree, *some: tree.rendered({"lt": "<", "ltslash": "</", "gt": ">", "eq": "="}, (), *some)) == len(text) - text.index(">", text.index("/>"))
    assert both(lambda tree, *some: rendering(tree, *some).replace("x", "xx")) == len(text) - text.index("x")
    monkeypatch.setattr(html, "_start_tag", at_end)
    assert 0 < both(rendering) < len(cuts)


def same_nodes(text):
    """Those of every prefix, as those of the prefix alone."""
    sizes = []
    for tree, kept, first, last in html.growing(text):
        assert kept <= len(tree.tags)
        for size in range(first, last + 1):
            want = html.parse(text[:size])
            spans = tree.spans if size == last else (*tree.spans[:-1], (tree.spans[-1][0], size))
            assert (tree.tags, tree.offsets, spans) == (want.tags, want.offsets, want.spans), (text, size)
        want = html.parse(text[:last])
        assert (tree.parents, tree.depths) == (want.parents, want.depths), (text, last)
        sizes += range(first, last + 1)
    assert sizes == list(range(len(text) + 1))


def test_all_prefixes_have_the_nodes_that_they_have_alone():
    rng = random.Random("growing")
    pieces = [*PIECES["html"], "</SCRIPT", "</scriptx>", "</script/ab", "<title a='>'>", "</title >", "<TITLE/>", "<style\0>", "</style\0>", "-", "!", "[", "</", "/", "/>", "<textarea", "ſ", "a = 'bc'", "x=y/z", "  ", "<!-- x -->", "<![CDATA[", "<?xml abc?>", "<p>", "</p>", "</div>"]
    for text in ["", "<", "<a b/>", "<a/", "<br/>x", "</>", "<//>x", "<a b = />", "<script>x</script/>y", "<script></script >", "<style></styl</style", "<i><b></i></b>"]:
        same_nodes(text)
    for _ in range(1200):
        same_nodes(latin("".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))))


def test_all_truncations_that_lose_bytes_are_counted(monkeypatch):
    """As many of all prefixes as when each is parsed alone, and also those that no sample of a long text has."""
    rendering, start_part = gates._rendered("html"), html._start_part

    def both(text, rendered):
        found = gates.failed_growing(html.growing(text), text, lambda prefix: rendered(html.parse(prefix)) == prefix, rendered)
        assert found == sum(rendered(html.parse(text[:n])) != text[:n] for n in range(len(text) + 1))
        return found

    def at_end(tree, toks, i, size):
        found = start_part(tree, toks, i, size)
        if found == len(toks) and toks[-1][0] == "eq":
            tree._rows.pop(), tree.ends.pop()
        return found

    text = "<ul id=a><li class='b' c>x<br/></li></ul><!-- d --><style>e{}</style>"
    assert both(text, rendering) == 0
    assert both(text, lambda tree, *some: tree.rendered({"lt": "<", "ltslash": "</", "gt": ">", "eq": "="}, (), *some)) == len(text) - text.index(">", text.index("/>"))
    assert both(text, lambda tree, *some: rendering(tree, *some).replace("x", "xx")) == len(text) - text.index("x")
    monkeypatch.setattr(html, "_start_part", at_end)
    assert both(text, rendering) == 2
    text = "a" * 1001 + "<p b=c>" + "d" * 992
    cuts = range(0, len(text) + 1, len(text) // gates.SAMPLES)
    assert gates.failed_from(html.prefixes(text, cuts), text, cuts, rendering) == 0
    assert both(text, rendering) == 1


def test_all_prefixes_take_a_time_in_proportion():
    """Long tags, deep elements, stray ends and raw text with what looks like its end are not parsed again from their start for each prefix."""
    for text in ["<a" + " b='c'" * 9000, "<div>" * 9000 + "</div>" * 9000, "<p>" * 9000 + "</div>" * 9000, "<script>" + "</scriptx>" * 4000, "<!--" + "x" * 300_000, "</a" + " b c" * 9000]:
        assert gates.failed_growing(html.growing(text), text, lambda prefix: False, gates._rendered("html")) == 0


@pytest.mark.parametrize("name", PIECES)
@pytest.mark.parametrize("text", ["(" * 3000, "[" * 3000, "{" * 3000, "<" * 2000, "a{" * 1500, "- " * 800, "<div>" * 2000, "if x:\n" + "".join(" " * i + "if x:\n" for i in range(300))])
def test_deep_text_survives(name, text):
    assert rendered(name, parsed(name, text)) == text.encode()


@pytest.mark.parametrize(
    ("name", "text", "tag", "want"),
    [
        ("html", '<script>var t="</p>";</script><p>x</p>', "elem", 2),
        ("html", "<br><br/>a", "elem", 2),
        ("html", "<title>a<b></title>", "elem", 1),
        ("html", '<a href="x" y=z w>', "attr", 3),
        ("html", "a < b <c>", "elem", 1),
        ("css", "a{b:c;d:e}@media x{p{q:r}}", "decl", 3),
        ("css", "a{&:hover{b:c}}", "rule", 2),
        ("css", "@import 'x';", "atrule", 1),
        ("json", '{"a":{"b":[1,2]},"a":3}', "member", 3),
        ("js", "a / b / c; x = /re[/]/g", "regex", 1),
        ("js", "`a${`b${c}`}d`", "template", 1),
        ("js", "f([1,{a:2}])", "group", 3),
        ("py", "def f():\n\n  # c\n    return 1\nx = (1,\n  2)\n", "stmt", 3),
        ("py", "if a:\n  if b:\n    c\n", "block", 2),
        ("md", "# a\n```\n# b\n```\n- x\n  y\n- z\n", "heading", 1),
        ("md", "- x\n  y\n- z\n", "item", 2),
        ("md", "````\n```\n````\n", "fence", 1),
        ("yaml", "a: 1\nb:\n  - c: 2\n    d: 3\n", "entry", 4),
        ("yaml", "a: |\n  - x\n  k: v\nb: 1\n", "entry", 2),
        ("yaml", "--- a\n---\nb\n...\n", "doc", 2),
        ("yaml", "...\n", "doc", 0),
        ("yaml", "a: {b: [1, 2], c}\n", "item", 2),
        ("yaml", 'a: "x # y" # z\n', "comment", 1),
        ("cfg", '[s]\na = "x#1" # c\n--opt:v\n@if x\n', "entry", 1),
        ("cfg", '[s]\na = "x#1" # c\n--opt:v\n@if x\n', "comment", 1),
        ("cfg", "- x\n", "line", 1),
        ("vds", "<a> | <b> && <c>{1,4}", "all", 1),
        ("vds", "[ a || b ]# c+", "comp", 2),
        ("vds", "'+' + a", "mult", 1),
    ],
)
def test_shape(name, text, tag, want):
    assert count(name, text, tag) == want


@pytest.mark.parametrize(
    ("name", "text", "tag", "want"),
    [("html", "<ul><li>a<li>b</ul>", "elem", 3), ("html", "<p>a</p><p>b</p>", "elem", 1), ("json", "[[[]],[]]", "array", 3), ("js", "(a[b{c}])", "group", 3), ("css", "@media x{@media y{a{b:c}}}", "atrule", 2)],
)
def test_nesting(name, text, tag, want):
    assert nesting(name, text, tag) == want


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("html", "<div><p>x</div>", []),
        ("html", "<div><b>x</div>", ["unclosed-element"]),
        ("html", "</b>", ["stray-end-tag"]),
        ("html", "<a b=>", ["missing-attr-value", "unclosed-element"]),
        ("html", "<a ", ["unclosed-tag", "unclosed-element"]),
        ("css", "a{b}", ["expected-colon"]),
        ("css", "a{b:c", ["unclosed-block"]),
        ("css", "}", ["unmatched-close"]),
        ("css", "a", ["expected-block"]),
        ("css", "@x", ["unterminated-atrule"]),
        ("css", 'a{b:"c\n}', ["unterminated-string"]),
        ("css", "a{1}", ["unexpected-token"]),
        ("json", '{"a" 1', ["expected-colon", "unclosed-object"]),
        ("json", "[1", ["unclosed-array"]),
        ("js", "(]", ["mismatched-close", "unmatched-close", ]),
        ("js", "(", ["unclosed-group"]),
        ("py", "x\n", []),
        ("py", "  x\n", ["unexpected-indent"]),
        ("vds", "[ a", ["unclosed-group"]),
        ("md", "```\nx\n", ["unclosed-fence"]),
    ],
)
def test_diagnostics(name, text, want):
    assert codes(name, text) == want


def test_python_tokens_agree_with_the_standard_library():
    source = "def f(a, *b):\n    '''doc'''\n    x = a[1:2] ** 0x1F + 1_0.5e3j  # note\n    return (x,\n            rb'y')\n\nclass C: pass\n"
    want = [t for t in stdlib_tokenize.generate_tokens(io.StringIO(source).readline)]
    got = py.tokens(source)
    texts = lambda kinds: [source[a:b] for k, a, b in got if k in kinds]
    for kind, kinds in ((stdlib_tokenize.NAME, ("name", "kw")), (stdlib_tokenize.NUMBER, ("num",)), (stdlib_tokenize.STRING, ("str",)), (stdlib_tokenize.OP, ("op",)), (stdlib_tokenize.COMMENT, ("comment",))):
        assert texts(kinds) == [t.string for t in want if t.type == kind]


ACCEPTED = ["{}", "[]", "0", "-0.5e+3", ' "a\\u00e9\\n" ', '[1,[2,{"a":null}]]', '{"a":1,"a":2}', "true", "[ ]", "{ }", "\t1\n"]
REJECTED = {
    "": "empty document", "[1,]": "a value expected", '{"a":1,}': "trailing comma", "01": "trailing content after the document", "+1": "a value expected", ".5": "a value expected",
    "1.": "digit expected after '.'", "1e": "digit expected in exponent", "-": "invalid number", "nul": "invalid literal", "NaN": "a value expected", "{} {}": "trailing content after the document",
    '{"a" 1}': "':' expected", "[1": "unexpected end of input", "[1}": "mismatched close", '"\\x"': "invalid escape", '"\\u12"': "truncated \\u escape", '"a\nb"': "control character in string",
    '"a': "unterminated string", "{1:2}": "a key string expected", "[" * 600: "nesting deeper than 512", "]": "a value expected", "{'a':1}": "a key string expected", "[1 2]": "',' or a close expected",
}


def test_strict_json():
    for text in ACCEPTED:
        assert jt.parse(text)[0].next == len(jt.parse(text))
    for text, message in REJECTED.items():
        with pytest.raises(jt.JsonError) as e:
            jt.parse(text)
        assert e.value.message == message, text


def test_strict_json_agrees_with_the_standard_library():
    rng = random.Random(3)

    def value(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.3:
            return rng.choice([1, -2.5, 'aé"\\\n😀', True, None, 1e20, ""])
        if r < 0.6:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {str(rng.randint(0, 5)): value(depth + 1) for _ in range(rng.randint(0, 4))}

    for _ in range(1500):
        text = latin(stdlib_json.dumps(value(), ensure_ascii=rng.random() < 0.5))
        jt.parse(text)
        cut = text[: rng.randint(0, len(text))]
        try:
            stdlib_json.loads(cut.encode("latin-1"))
            valid = True
        except ValueError:
            valid = False
        try:
            jt.parse(cut)
            assert valid
        except jt.JsonError:
            assert not valid


def test_json_paths():
    text = '{"a":[1,{"b":"x\\ud83d\\ude00"}],"a":3,"n":1.5e3,"s":"\\ud800"}'
    tape = jt.parse(text)
    shown = lambda path: (lambda i: None if i < 0 else jt.shown(text, tape[i]).decode())(jt.find(text, tape, jt.path_steps(path)))
    assert [shown(p) for p in ("a[1].b", "a", "n", "", "a[5]", "n.x", "s", "..a[0]")] == ["x😀", "[2 elements]", "1.5e3", "{4 members}", None, None, "�", "1"]
    with pytest.raises(ValueError):
        jt.path_steps("a[x]")


@pytest.mark.parametrize(
    ("source", "want"),
    [("x + 1", "complete"), ("if x > 1:", "incomplete"), ("foo(", "incomplete"), ("foo)", "invalid"), ('"abc', "incomplete"), ('"""abc', "incomplete"), ("#[ x", "incomplete"), ("(]", "invalid"), ("return", "complete"), ("type", "incomplete"), ("", "complete"), ("x =", "incomplete"), ("a,", "incomplete"), ("let x = 'a'", "complete"), ("`foo", "incomplete"), ("nil", "complete"), ("x # c", "complete"), ("## d", "complete")],
)
def test_completeness(source, want):
    assert nim.completeness(source)[0] == want


def test_nim_tokens():
    tokens, found = nim.tokenize("var v*: int = 0xFF'i8 + 1_000.5e3\n  echo fmt\"x{y}\" & \"\\x41\"  # c\n## doc\n## more\n'a' 100L 0O7 a__b 1e 300'u8")
    by = {t.text: t for t in tokens}
    assert by["FF"].int_value == -1 and by["1000.5e3"].float_value == 1000500.0
    assert by["echo"].indent == 2 and by["x{y}"].kind == "rstr" and by["A"].kind == "str"
    assert [t.kind for t in tokens].count("comment") == 1
    assert [d.code for d in found] == ["invalid-number", "invalid-int-literal", "invalid-number", "invalid-identifier", "invalid-number", "number-out-of-range"]
    assert [d.code for d in nim.tokenize("\tx \r\n", nim.Options(trailing_whitespace=True, newline="lf"))[1]] == ["tabs-not-allowed", "line-ending", "trailing-whitespace"]
    assert [d.code for d in nim.check_brackets(nim.tokenize("(]{")[0])] == ["mismatched-bracket", "unclosed-bracket"]


def test_registry_is_well_formed():
    assert len({d.name for d in DIALECTS}) == len({d.command for d in DIALECTS}) == 9
    assert len({e for d in DIALECTS for e in d.extensions}) == sum(len(d.extensions) for d in DIALECTS)
    with pytest.raises(ValueError):
        dialect("nope")
