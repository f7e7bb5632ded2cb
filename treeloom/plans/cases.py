"""Queries over small sources with known answers, dealt out over the rows of ``part``.

Row ``k`` gets case ``k`` modulo the number of cases, with ``¤`` as its key where a case has one; the SQL states what is
known of each case.  So every detector is seen to fire and to stay silent, on as many rows as the table has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialects import nim as nim_dialect
from ..dialects.nim_checks import LINTS
from ..operators import checks, diagnostics, gates, nim, nodes, registry, tree, views
from ..operators import json as strict
from ..sources import artifact, files
from .catalog import PART_CSS, event_docs, part_css, query, spread, table


def literal(value: object) -> str:
    """A value in SQL."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def known(rows: Sequence[tuple], *columns: str) -> str:
    """SQL for doc_id and the columns of each row's case; ``¤`` is the row's key."""
    cases = ", ".join("(" + ", ".join(literal(x) for x in (i, *row)) + ")" for i, row in enumerate(rows))
    text = [any(isinstance(row[i], str) for row in rows) for i in range(len(columns))]
    shown = ", ".join(f"replace({c}, '¤', p_partkey::varchar) as {c}" if is_text else f"{c} as {c}" for c, is_text in zip(columns, text, strict=True))
    return f"select cast(p_partkey as bigint) as doc_id, {shown} from part join (values {cases}) v(i, {', '.join(columns)}) on v.i = p_partkey % {len(rows)}"


def pick(values: Sequence[object], doc_id: str = "doc_id") -> Column:
    """The value of a row's case."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(doc_id) % len(values) + 1).cast("int"))


def deal(spark: SparkSession, sf_dir: str, sources: Sequence[str], dialects: Sequence[str] | None = None) -> DataFrame:
    """doc_id, content and, where there are several, dialect of the cases."""
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id"))
    docs = docs.withColumn("content", F.replace(pick(sources), F.lit("¤"), F.col("doc_id").cast("string")))
    return docs if dialects is None else docs.withColumn("dialect", pick([f"{d}-parsed" for d in dialects]))


# --- shapes

SHAPES = [
    ("html", '<script>var t="</p>¤";</script><p>x</p>', "elem", 2), ("html", "<br><br/>a¤", "elem", 2), ("html", "<title>a<b></title>", "elem", 1),
    ("html", '<a href="x¤" y=z w>', "attr", 3), ("html", "a < b <c>", "elem", 1), ("html", "<!DOCTYPE html><?x?><![CDATA[a]]>", "doctype", 1), ("html", "<textarea><p></textarea>", "elem", 1),
    ("css", "a{b:c;d:e¤}@media x{p{q:r}}", "decl", 3), ("css", "a{&:hover{b:c}}", "rule", 2), ("css", "@import 'x¤';", "atrule", 1), ("css", "a\\26 b\\{{c:\\64}", "decl", 1), ("css", "a{b:+1.5e3px -.5% 1e2}", "pct", 1),
    ("css", ".x{--a:{b};c:d}", "decl", 2), ("css", "a{b:url(x;y) f(1;2)}", "decl", 1), ("css", "a{b:c}/* } */", "comment", 1),
    ("json", '{"a":{"b":[1,2¤]},"a":3}', "member", 3), ("json", "[[],[1],{}]", "array", 3), ("json", '[true,null,-1.5e+3,"\\u00e9"]', "lit", 2), ("json", "[1,\n 2]", "num", 2),
    ("js", "a / b / c; x = /re[/]¤/g", "regex", 1), ("js", "`a${`b${c}`}d¤`", "template", 1), ("js", "f([1,{a:2}])", "group", 3), ("js", "x = 'a\\'b' + \"c\"", "str", 2), ("js", "0x1F + 1_000n + .5e-3", "num", 3), ("js", "return /x/.test(y)", "regex", 1), ("js", "// a\n/* b */ c", "comment", 2),
    ("py", "def f():\n\n  # c\n    return ¤\nx = (1,\n  2)\n", "stmt", 3), ("py", "if a:\n  if b:\n    c\n", "block", 2), ("py", "x = rb'a' + f\"{b}\" + '''c\nd'''\n", "str", 3), ("py", "x = 0x1F + 1_0.5e3j\n", "num", 2), ("py", "a = 1 \\\n  + 2\nb\n", "stmt", 2),
    ("md", "# a¤\n```\n# b\n```\n- x\n  y\n- z\n", "heading", 1), ("md", "- x\n  y\n- z\n", "item", 2), ("md", "````\n```\n````\n", "fence", 1), ("md", "> a\n> b\n\nc\n", "quote", 1),
    ("yaml", "a: 1\nb:\n  - c: 2\n    d: ¤\n", "entry", 4), ("yaml", "a: |\n  - x\n  k: v\nb: 1\n", "entry", 2), ("yaml", "--- a\n---\nb\n...\n", "doc", 2), ("yaml", "a: {b: [1, 2], c}\n", "item", 2),
    ("yaml", 'a: "x # y" # z\n', "comment", 1), ("yaml", "a: 'it''s: b' \n", "entry", 1), ("yaml", "- &x !t a\n- *x\n", "item", 2), ("yaml", "{ a\n  b, c: d}\n", "entry", 2), ("yaml", '{"a":1, "b":2}\n', "entry", 2), ("yaml", "%YAML 1.2\n--- a\n", "directive", 1),
    ("cfg", '[s¤]\na = "x#1" # c\n--opt:v\n@if x\n', "entry", 1), ("cfg", '[s]\na = "x#1" # c\n--opt:v\n', "comment", 1), ("cfg", "- x\n", "line", 1), ("cfg", "--a\n-b:c\n", "switch", 2),
    ("vds", "<a> | <b> && <c>{1,4}", "all", 1), ("vds", "[ a || b ]# c+", "comp", 2), ("vds", "'+' + a", "mult", 1), ("vds", "<length [0,10]> a{2,3}", "range", 1), ("vds", "f( <a> , <b> )", "fn", 1),
]


@query(known([(n,) for *_, n in SHAPES], "n"))
def case_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of a tag a source has, each row read by the dialect that its own column names."""
    found = nodes.parse_nodes(deal(spark, sf_dir, [s[1] for s in SHAPES], [s[0] for s in SHAPES]), F.col("dialect"))
    return found.groupBy(*tree.DOC).agg(F.count_if(F.col("tag") == pick([s[2] for s in SHAPES])).cast("int").alias("n")).drop("doc_key")


@query(known([(d + "-parsed", text) for d, text, *_ in SHAPES], "dialect", "content"))
def case_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources again, from their trees, whichever dialect each is of."""
    docs = deal(spark, sf_dir, [s[1] for s in SHAPES], [s[0] for s in SHAPES])
    found = nodes.parse_nodes(docs, F.col("dialect")).withColumn("dialect", pick([f"{s[0]}-parsed" for s in SHAPES]))
    spec = F.broadcast(nodes.spec_table(spark))  # under 200 rows
    piece = F.when(F.col("kind") == "text", F.col("raw")).when(F.col("kind") == "punct", F.col("lit").cast("binary"))
    rows = found.join(spec, ["dialect", "tag"], "left").groupBy("doc_id", "doc_key", "dialect").agg(F.array_sort(F.collect_list(F.struct("node_id", F.hex(piece).alias("h")))).alias("p"))
    return rows.select("doc_id", "dialect", F.decode(F.unhex(F.concat_ws("", F.transform("p", lambda x: x["h"]))), "UTF-8").alias("content"))


NESTINGS = [
    ("html", "<ul><li>a<li>b¤</ul>", "elem", 3), ("html", "<p>a</p><p>b</p>", "elem", 1), ("json", "[[[]],[]]", "array", 3), ("js", "(a[b{c¤}])", "group", 3), ("css", "@media x{@media y{a{b:c}}}", "atrule", 2),
    ("yaml", "a:\n  b:\n    c: 1\n", "block", 2), ("py", "if a:\n  if b:\n    c\n", "block", 2), ("html", "<div><div></div><div><div></div></div></div>", "elem", 3),
]


@query(known([(d,) for *_, d in NESTINGS], "depth"))
def case_nestings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(deal(spark, sf_dir, [s[1] for s in NESTINGS], [s[0] for s in NESTINGS]), F.col("dialect"))
    own = found.filter(F.col("tag") == pick([s[2] for s in NESTINGS])).withColumn("tag", F.lit("own"))
    return tree.max_nesting(own, "own").select("doc_id", F.col("depth").cast("int").alias("depth"))


# --- diagnostics

FAULTS = [
    ("html", "<div><p>x¤</div>", ""), ("html", "<div><b>x</div>", "unclosed-element"), ("html", "</b>", "stray-end-tag"), ("html", "<a b=>", "missing-attr-value unclosed-element"), ("html", "<a ", "unclosed-tag unclosed-element"),
    ("css", "a{b¤}", "expected-colon"), ("css", "a{b:c", "unclosed-block"), ("css", "}", "unmatched-close"), ("css", "a", "expected-block"), ("css", "@x", "unterminated-atrule"), ("css", 'a{b:"c\n}', "unterminated-string"), ("css", "a{1}", "unexpected-token"),
    ("json", '{"a" 1', "expected-colon unclosed-object"), ("json", "[1", "unclosed-array"), ("js", "(]", "mismatched-close unmatched-close"), ("js", "(", "unclosed-group"), ("py", "x\n", ""), ("py", "  x\n", "unexpected-indent"),
    ("vds", "[ a", "unclosed-group"), ("md", "```\nx\n", "unclosed-fence"), ("css", "a{b:c¤}", ""), ("html", "<br>¤", ""),
]


@query(known([(codes,) for *_, codes in FAULTS], "codes"))
def case_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes that a parser reports, in the order in which it met them."""
    docs = deal(spark, sf_dir, [s[1] for s in FAULTS], [s[0] for s in FAULTS])
    found = nodes.diagnose(docs, F.col("dialect")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("diag_id", "code"))).alias("d"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("d", lambda x: x["code"]), " "), F.lit("")).alias("codes"))


CHECKED = {
    "css": [("a{b:c¤}", True, None, None, None), ("a{\n b¤}", False, "expected-colon", 2, None), ("a{b:c\n\n", False, "unclosed-block", 3, 0), ("\n\n  }", False, "unmatched-close", 3, 2)],
    "html": [("<p>¤</p>", True, None, None, None), ("<div>\n<b>x</div>", False, "unclosed-element", 1, None), ("\n </i>", False, "stray-end-tag", 2, 1)],
}


def _literal_checks(which: str):  # noqa: ANN202
    cases = [(sound, code, line) for _, sound, code, line, _ in CHECKED[which]]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = checks.literal_check(deal(spark, sf_dir, [c[0] for c in CHECKED[which]]), which)
        lines = [-1 if c[3] is None or (which == "html" and c[2] == "unclosed-element") else c[3] for c in CHECKED[which]]
        return found.select("doc_id", "sound", "code", F.when(pick(lines) >= 0, F.col("line")).otherwise(-1).alias("line"))

    run.__name__ = f"{which}_literal_check"
    wanted = [(s, c, -1 if n is None or (which == "html" and c == "unclosed-element") else n) for s, c, n in cases]
    return query(known(wanted, "sound", "code", "line"))(run)


css_literal_check, html_literal_check = _literal_checks("css"), _literal_checks("html")


@query(known([(0 if sound else 1,) for _, sound, *_ in CHECKED["css"]], "exit_code"))
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.exit_codes(checks.literal_check(deal(spark, sf_dir, [c[0] for c in CHECKED["css"]]), "css"))


@query(known([('[{"severity":"error","code":"unmatched-close","message":"\'}\' with no matching \'{\'","line":1,"col":0,"endCol":0}]',), ('[{"severity":"error","code":"unmatched-close","message":"\'}\' with no matching \'{\'","line":2,"col":1,"endCol":1}]',)], "json"))
def diag_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics as JSON; absent fixes and notes are left out."""
    found = nodes.diagnose(deal(spark, sf_dir, ["}", "\n }"]), "css")
    return diagnostics.as_json(found).select("doc_id", F.regexp_replace("json", r'"endCol":(\d+),?("fix":"")?', '"endCol":$1').alias("json"))


# --- tokens

TOKENS = {
    "css": [("a\\26 b{c:+1.5e3px}", "ident:a\\26 b lbrace:{ ident:c colon:: dim:+1.5e3px rbrace:}"), ("@x #y f(1%) 'z'", "at:@x ws:  hash:#y ws:  fn:f( pct:1% rparen:) ws:  str:'z'"), ("--a:.5/*c*/;", "ident:--a colon:: num:.5 comment:/*c*/ semi:;")],
    "json": [('{"a":[1,true]}', 'lbrace:{ str:"a" colon:: lbracket:[ num:1 comma:, lit:true rbracket:] rbrace:}'), (' -0.5e+3 "\\""', 'ws:  num:-0.5e+3 ws:  str:"\\""')],
    "js": [("a=/b/g", "name:a op:= regex:/b/g"), ("a/b", "name:a op:/ name:b"), ("`x${y}`", "template:`x${y}`"), ("if(1)'s'", "kw:if op:( num:1 op:) str:'s'")],
    "py": [("x = rb'y'", "name:x ws:  op:= ws:  str:rb'y'"), ("if 0x1F: # c", "kw:if ws:  num:0x1F op:: ws:  comment:# c")],
    "vds": [("<a>{1,2}", "type:<a> range:{1,2}"), ("'b' <'c'>", "str:'b' ws:  propref:<'c'>")],
}


def _token_query(which: str):  # noqa: ANN202
    cases = TOKENS[which]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = nodes.tokenize(deal(spark, sf_dir, [c[0] for c in cases]), which)
        rows = found.groupBy(*tree.DOC).agg(F.array_sort(F.collect_list(F.struct("tok_id", F.concat("kind", F.lit(":"), tree.text()).alias("t")))).alias("t"))
        return rows.select("doc_id", F.concat_ws(" ", F.transform("t", lambda x: x["t"])).alias("tokens"))

    run.__name__ = f"{which}_tokens"
    return query(known([(t,) for _, t in cases], "tokens"))(run)


for _which in TOKENS:
    _token_query(_which)


# --- round trips over prose, which is malformed in most dialects


def _prose_round_trip(which: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("content"))
        return tree.render(nodes.parse_nodes(docs, which), which).select("doc_id", F.md5("content").alias("digest"))

    run.__name__ = f"{which}_roundtrip_documents"
    return query("select doc_id, md5(coalesce(text, '')) as digest from documents")(run)


for _which in ("css", "html", "js", "json", "md", "py", "vds", "yaml", "cfg"):
    _prose_round_trip(_which)


def _prose_identity(which: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("content"))
        parts = nodes.tokenize(docs, which).groupBy(*tree.DOC).agg(F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"))
        return parts.select("doc_id", "n_bytes")

    run.__name__ = f"{which}_token_bytes"
    return query("select doc_id, cast(octet_length(encode(text)) as bigint) as n_bytes from documents where text <> ''")(run)


for _which in ("css", "html", "js", "py"):
    _prose_identity(_which)


@query(f"""
    with c as ({known([(d + "-parsed", text) for d, text, *_ in SHAPES], "dialect", "content")}), s as (select dialect, octet_length(encode(content)) n from c)
    select dialect, cast(sum(n // greatest(1, n // 128) + 1) as bigint) as prefixes, cast(0 as bigint) as failed, cast(0 as bigint) as skipped from s group by 1
""")
def truncation_fuzz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of the sources of every dialect survive parsing and rendering."""
    docs, out = deal(spark, sf_dir, [s[1] for s in SHAPES], [s[0] for s in SHAPES]), None
    for which in dict.fromkeys(s[0] for s in SHAPES):
        found = gates.truncations(docs.filter(F.col("dialect") == f"{which}-parsed"), which).agg(F.lit(f"{which}-parsed").alias("dialect"), F.sum("prefixes").alias("prefixes"), F.sum("failed").alias("failed"), F.count_if("skipped").alias("skipped"))
        out = found if out is None else out.unionByName(found)
    return out


# --- detectors that must fire


@query("select cast(p_partkey as bigint) as doc_id, 'mystery' as tag from part where p_partkey % 2 = 0")
def undeclared_tags_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(deal(spark, sf_dir, ["a{b:c¤}", "a{}"]), "css")
    odd = found.withColumn("tag", F.when(F.col("tag") == "decl", "mystery").otherwise(F.col("tag")))
    return tree.undeclared_tags(odd, "css").select("doc_id", "tag")


@query("select cast(p_partkey as bigint) as doc_id, case p_partkey % 2 when 0 then 'ident' else 'rule' end as tag from part")
def spec_violations_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes that lost their text and structure that has some."""
    found = nodes.parse_nodes(deal(spark, sf_dir, ["a{b:c}"]), "css")
    even = F.col("doc_id") % 2 == 0
    raw = F.when(even & (F.col("tag") == "ident") & (F.col("node_id") < 5), None).when(~even & (F.col("tag") == "rule"), F.lit(b"x")).otherwise(F.col("raw"))
    return tree.spec_violations(found.withColumn("raw", raw), "css").select("doc_id", "tag")


@query("select * from (values ('d', '', 'empty tag'), ('d', 'p', 'punctuation without a literal'), ('d', 't', 'a literal outside punctuation'), ('d', 'u', 'declared more than once')) v(dialect, tag, problem)")
def spec_problems_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = [("d", "", "text", None), ("d", "p", "punct", None), ("d", "t", "text", "x"), ("d", "u", "text", None), ("d", "u", "text", None)]
    return tree.spec_problems(spark.createDataFrame(bad, "dialect string, tag string, kind string, lit string"))


@query("select cast(p_partkey as bigint) as doc_id, p_partkey % 2 = 1 as same, cast(case p_partkey % 2 when 0 then 2 else -1 end as int) as first_difference from part")
def damaged_trees_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that lost its declarations renders to something else, from the first byte of them on."""
    docs = deal(spark, sf_dir, ["a{b:c}", "d{}"])
    kept = nodes.parse_nodes(docs, "css").filter("tag not in ('prop', 'colon')")
    back = tree.render(kept, "css").select("doc_id", F.col("content").alias("back"))
    both = docs.join(back, "doc_id").withColumn("content", F.col("content").cast("binary"))
    return both.select("doc_id", (F.col("back") == F.col("content")).alias("same"), F.coalesce(gates.first_difference(F.col("content"), F.col("back")), F.lit(-1)).alias("first_difference"))


@query("select cast(p_partkey as bigint) as doc_id, cast(p_partkey % 3 as bigint) as n, cast(2 as bigint) as want, p_partkey % 3 = 2 as holds from part")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deal(spark, sf_dir, ["", "a{b:c}", "a{b:c;d:e}"])
    return gates.expect_count(nodes.parse_nodes(docs, "css"), "decl", docs.select("doc_id", F.lit(2).alias("want")))


@query("select cast(p_partkey as bigint) as doc_id, cast(p_partkey % 3 as bigint) as n, cast(1 as bigint) as want, p_partkey % 3 = 1 as holds from part")
def expected_nestings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deal(spark, sf_dir, ["", "a{}", "@x{a{}}"])
    return gates.expect_nesting(nodes.parse_nodes(docs, "css"), "block", docs.select("doc_id", F.lit(1).alias("want")))


@query("select 'css-parsed' as dialect, count(*) as checked, cast(0 as bigint) as broken, cast(0 as bigint) as undeclared from part")
def css_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.report(deal(spark, sf_dir, [s[1] for s in SHAPES if s[0] == "css"]), "css")


# --- scalar helpers


@query("select cast(p_partkey as bigint) as doc_id, 1 + length(p_name) - length(replace(p_name, ' ', '')) as line, p_size % 7 + 1 as col from part")
def byte_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of a byte offset, in a text whose words stand on lines of their own."""
    rows = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id"), F.translate("p_name", " ", "\n").alias("name"), (F.col("p_size") % 7).alias("at"))
    content = F.concat("name", F.lit("\n"), F.lit("abcdefgh"))
    line, col = diagnostics.positions(content, F.octet_length("name") + 1 + F.col("at"))
    return rows.select("doc_id", (line - 1).alias("line"), col.alias("col"))


@query("select cast(p_partkey as bigint) as doc_id, 'a' || chr(92) || 'n' || chr(92) || 't' || p_partkey || chr(92) || chr(92) as shown from part")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("a\n\t"), F.col("p_partkey").cast("string"), F.lit("\\")).alias("content"))
    return docs.select("doc_id", gates.excerpt(F.col("content"), F.lit(0)).alias("shown"))


@query("select cast(p_partkey as bigint) as doc_id, p_name || '/x.css' as label from part")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("file:///in\\"), "p_name", F.lit("\\x.css")).alias("path"))
    return paths.select("doc_id", files.path_label(F.col("path"), "/in").alias("label"))


@query(f"select p_name || '.zip' as path, 'no dialect reads ''.zip''; known are {registry.known_extensions()}' as error from part where p_partkey % 3 = 0")
def unknown_extension_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("p_partkey") % 3 == 0, ".zip").when(F.col("p_partkey") % 3 == 1, ".NIM").otherwise(".xhtml")
    return registry.unknown_extensions(spread(table(spark, sf_dir, "part")).select(F.concat("p_name", ending).alias("path")))


@query("select cast(p_partkey as bigint) as doc_id, p_partkey % 2 = 0 as filtered from part")
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(spark, sf_dir, [" \n#? stdtmpl\n¤", "# ?\n¤"]).select("doc_id", registry.has_source_filter(F.col("content")).alias("filtered"))


# --- views


RUNNING = [
    ("@a x{@b y{p{q:r}} s{t:u}} v{w{x:y} z:1}", "p|@a@b|q|r s||t|u w||x|y w||z|1"),
    ("a , b{c : d¤ /* e */  !important}", "a , b||c|d¤ !important"),
    ("c:d", ""),
]


@query(known([(w,) for _, w in RUNNING], "decls"))
def css_declarations_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations by what was last seen rather than by what is around."""
    docs = deal(spark, sf_dir, [c for c, _ in RUNNING])
    one = F.struct("node_id", F.concat_ws("|", "selector", "at_rule", "prop", "value").alias("t"))
    rows = views.css_declarations_running(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("d"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("d", lambda x: x["t"]), " "), F.lit("")).alias("decls"))


ATTRIBUTES = [("<A Href='x\ny¤' ID=\"\" k=v checked>", "a|href|x\ny¤ a|id| a|k|v a|checked|-"), ("<p>¤</p>", ""), ("<input a = 'b\"c'>", "input|a|b\"c")]


@query(known([(w,) for _, w in ATTRIBUTES], "attributes"))
def html_attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deal(spark, sf_dir, [c for c, _ in ATTRIBUTES])
    one = F.struct("node_id", F.concat_ws("|", "element", "attribute", F.coalesce("value", F.lit("-"))).alias("t"))
    rows = views.html_attributes(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("d"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("d", lambda x: x["t"]), " "), F.lit("")).alias("attributes"))


# --- the tree artifact


@query(f"""
    select cast(p_partkey as bigint) as doc_id, 'css-parsed' as dialect, md5({PART_CSS}) as digest from part
""")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees to artifacts, read back and rendered."""
    made = artifact.artifacts(nodes.parse_nodes(part_css(spark, sf_dir), "css"), "css").select("doc_id", "artifact", artifact.dialect_of(F.col("artifact")).alias("dialect"))
    back = tree.render(artifact.read_artifacts(made), "css").select("doc_id", F.md5("content").alias("digest"))
    return back.withColumn("dialect", F.lit("css-parsed"))


@query("select cast(p_partkey as bigint) as doc_id, case p_partkey % 3 when 0 then 'css-parsed' when 1 then 'x' else '' end as dialect from part")
def artifact_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ['(.aif27)\n(.vendor "v")\n(.dialect "css-parsed")\n(stylesheet)', '(.dialect "x")', '(stylesheet "(.dialect")']
    return deal(spark, sf_dir, heads).select("doc_id", artifact.dialect_of(F.col("content")).alias("dialect"))


EVENTS = [('(.aif27)(a@1,2 (b "x\\28y") c)', "a b:x(y"), ('(a "\\zz" "second"', "a:\\zz"), ("", "")]


@query(known([(w,) for _, w in EVENTS], "nodes"))
def artifact_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of tags go, escapes are undone, a malformed one stays, what is not closed ends with the text."""
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id")).withColumn("artifact", pick([e for e, _ in EVENTS]))
    one = F.struct("node_id", F.concat("tag", F.coalesce(F.concat(F.lit(":"), tree.text()), F.lit(""))).alias("t"))
    rows = artifact.read_artifacts(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("d"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("d", lambda x: x["t"]), " "), F.lit("")).alias("nodes"))


CANONICAL = [
    ('(.aif27)\n(.vendor "a")\n(.dialect "css-parsed")\n(stylesheet@0,1 (rule@0,1 (ident "x\\28¤")))', '(.tree) (.vendor "") (.dialect "css-parsed") (stylesheet (rule (ident "x\\28¤")))'),
    ('(.aif28)\n(.vendor "b")\n(.dialect "css-parsed")\n(stylesheet (rule~3 (ident#c "x\\28¤")))', '(.tree) (.vendor "") (.dialect "css-parsed") (stylesheet (rule (ident "x\\28¤")))'),
    ("", ""),
]


@query(known([(w,) for _, w in CANONICAL], "canonical"))
def artifact_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers' artifacts of one tree are one text."""
    return deal(spark, sf_dir, [c for c, _ in CANONICAL]).select("doc_id", artifact.canonical(F.col("content")).alias("canonical"))


# --- strict JSON

VALUES = [
    ('{"a":¤,"b":[1],"a":"x\\u0041"}', '[{"key":"a","kind":"int","lexeme":"¤"},{"key":"b","kind":"array"},{"key":"a","kind":"string","lexeme":"x\\\\u0041"}]', None),
    ("[1.50, null]", '[{"kind":"float","lexeme":"1.50"},{"kind":"null","lexeme":"null"}]', None), ("¤", '[{"kind":"int","lexeme":"¤"}]', None),
    ("[1,]", None, "a value expected at offset 3"), ('{"a" 1}', None, "':' expected at offset 5"), ("", None, "empty document at offset 0"),
]


@query(known([(v, e) for _, v, e in VALUES], "value", "error"))
def json_values_or_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.value_or_error(deal(spark, sf_dir, [c for c, *_ in VALUES]))


JSON_FAULTS = [
    ("{}", None), ("[]", None), ("0", None), ("-0.5e+3", None), (' "a\\u00e9\\n" ', None), ('[1,[2,{"a":null}]]', None), ('{"a":1,"a":¤}', None), ("true", None), ("\t1\n", None),
    ("", "empty document"), ("[1,]", "a value expected"), ('{"a":1,}', "trailing comma"), ("01", "trailing content after the document"), ("+1", "a value expected"), (".5", "a value expected"),
    ("1.", "digit expected after '.'"), ("1e", "digit expected in exponent"), ("-", "invalid number"), ("nul", "invalid literal"), ("NaN", "a value expected"), ("{} {}", "trailing content after the document"),
    ('{"a" 1}', "':' expected"), ("[1", "unexpected end of input"), ("[1}", "mismatched close"), ('"\\x"', "invalid escape"), ('"\\u12"', "truncated \\u escape"), ('"a\nb"', "control character in string"),
    ('"a', "unterminated string"), ("{1:2}", "a key string expected"), ("[" * 600, "nesting deeper than 512"), ("]", "a value expected"), ("{'a':1}", "a key string expected"), ("[1 2]", "',' or a close expected"),
]


@query(known([(e is None, e) for _, e in JSON_FAULTS], "valid", "error"))
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.lint(deal(spark, sf_dir, [c for c, _ in JSON_FAULTS])).select("doc_id", "valid", "error")


JSON_DOC = '{"a":[1,{"b":"x\\ud83d\\ude00"}],"a":3,"n":1.5e3,"s":"\\ud800","t":"\\u0041\\n\\/","k":¤,"f":false,"z":null}'
JSON_PATHS = [
    ("a[1].b", "ok", "string", "x😀"), ("a", "ok", "array", "[2 elements]"), ("n", "ok", "float", "1.5e3"), ("", "ok", "object", "{8 members}"), ("a[5]", "absent", None, None), ("n.x", "absent", None, None),
    ("s", "ok", "string", "�"), ("a[0]", "ok", "int", "1"), ("t", "ok", "string", "A\n/"), ("k", "ok", "int", "¤"), ("f", "ok", "false", "false"), ("z", "ok", "null", "null"), ("missing", "absent", None, None),
]


def _paths_sql() -> str:
    rows = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in JSON_PATHS)
    return f"select cast(p_partkey as bigint) as doc_id, path, status, kind, replace(value, '¤', p_partkey::varchar) as value from part, (values {rows}) v(path, status, kind, value)"


@query(_paths_sql())
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, elements, decoded strings with surrogates, and what is absent, by path."""
    return strict.query_all(deal(spark, sf_dir, [JSON_DOC]), [path for path, *_ in JSON_PATHS])


@query("""
    select cast(p_partkey as bigint) as doc_id, v.ordinal, case v.ordinal when 0 then p_partkey else v.value end as value
    from part, (values (0, 0), (1, -1), (2, -1), (3, -1), (4, 7)) v(ordinal, value)
""")
def json_int_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, and a default for what is none or beyond a long."""
    tapes = strict.tape(deal(spark, sf_dir, ['{"a":¤,"b":1.5,"c":"3","d":99999999999999999999,"e":7}']))
    return strict.members(tapes).select("doc_id", "ordinal", strict.get_int(default=-1).alias("value"))


@query("select cast(p_partkey as bigint) as doc_id, cast(2 + p_partkey % 3 as int) as size, cast(3 + 2 * (p_partkey % 3) as int) as next from part")
def json_tape_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of elements of the root, and how far it reaches on the tape: an element that is an array of one takes two places."""
    tapes = strict.tape(deal(spark, sf_dir, ["[1,2]", "[1,2,[¤]]", "[1,2,[¤],[4]]"]))
    return tapes.filter("idx = 0").select("doc_id", "size", "next")


@query("""
    select cast(event_id as bigint) as doc_id, true as valid from events where json_valid(props)
""")
def json_valid_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.tape(event_docs(spark, sf_dir)).filter("idx = 0").select("doc_id", F.lit(True).alias("valid"))


# 64-bit FNV-1a of the strings of each case, each followed by a zero byte.
JSON_DIGESTS = [("[]", "cbf29ce484222325", 0), ('["a"]', "089be207b544f1e4", 0), ("[1,[-3,¤]]", "cbf29ce484222325", None)]


@query(known([(h,) for _, h, _ in JSON_DIGESTS], "string_hash").replace("string_hash from part", "string_hash, cast(case p_partkey % 3 when 2 then p_partkey - 2 else 0 end as bigint) as int_sum from part"))
def json_string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.digest(deal(spark, sf_dir, [c for c, *_ in JSON_DIGESTS])).select("doc_id", "string_hash", "int_sum")


# --- Nim

NIM_FAULTS = [
    ("identifier-expected", "let 1 = 2", "let (a, b) = c"), ("expected-condition", "if: x", "if x: y"), ("assignment-in-condition", "if a = b: c", "if a == b: c = d"), ("assignment-in-condition", "while x = 1:", "if f(a = 1): c"),
    ("comparison-in-binding", "let x == 1", "let x = a == 1"), ("walrus-in-binding", "var x := 1", "let x = f(y)"), ("double-colon", "a::b", "a.b"), ("mut-not-a-keyword", "let mut x = 1", "let mut = 1"),
    ("go-var-notype", "var x int", "var x: int"), ("stray-end", "if a:\n  b\nend", "let x = y"), ("angle-bracket-generics", "proc f<T>(x: T) = discard", "proc f[T](x: T) = discard"), ("c-brace-body", "proc f() {\n", "proc f() {.inline.} = discard"),
    ("foreign-function-keyword", "fn f() {\n", "let fn = 1"), ("foreign-block-keyword", "class A {\n", "class = 1"), ("foreign-block-keyword", "interface A {\n", "struct(a)"), ("foreign-case-block", "switch x {\n", "match(x)"),
    ("do-while-loop", "do {\n", "f do (x):\n  y"), ("ruby-block-params", "each do |x|\n", "each do (x):\n  y"), ("c-block-comment", "/* x */", "a / b"), ("extends-inheritance", "type A extends B", "type A = object of B"),
    ("yield-from", "yield from x", "yield x"), ("async-routine-prefix", "async proc f() = x", "proc f() {.async.} = x"), ("arrow-return-type", "proc f() -> int = 1", "proc f(): int = 1"),
    ("foreign-routine-clause", "proc f() throws = 1", "proc f(where: int) = 1"), ("else-if-not-elif", "else if x:", "else:\n  if x: y"), ("expression-expected", "f(, a)", "f(a, b)"), ("expression-expected", "x +", "x + y"),
]
NIM_LINTS = [
    ("c-style-operator", "a && b", "a and b"), ("redundant-semicolon", "a = 1;\nb", "a; b"), ("redundant-semicolon", "a = 1;", "proc f(a: int;\n  b: int) = x"), ("redundant-bool-literal", "x == true", "x == y"), ("double-negation", "not not x", "not x"),
    ("not-in-precedence", "not a.b[1] in c", "not (a in b)"), ("not-compare-precedence", "not a == b", "not (a == b)"), ("simplify-boolean-return", "if a:\n  return true\nelse:\n  return false", "if a:\n  return true\nelse:\n  return true"),
    ("float-equality", "x == 1.5", "x < 1.5"), ("nil-comparison", "x != nil", "x.isNil"), ("yoda-condition", "1 == x", "1 == 2"), ("redundant-parens-condition", "if (a): b", "if (a) and (b): c"), ("redundant-parens-condition", "while (a):", "if (let x = f(); x): b"),
    ("empty-string-concat", 'a & ""', 'a & "b"'), ("debug-echo", "echo x", "let y = echo"), ("manual-range-index", "for i in 0 .. n - 1:", "for i in 0 .. n:"), ("broad-exception", "except Exception:", "except ValueError:"),
    ("broad-exception", "newException(Exception, x)", "newException(ValueError, x)"), ("bare-except", "except:", "except ValueError:"), ("cast-used", "cast[int](x)", "int(x)"), ("converter-defined", "converter f(x: int): A = y", "proc f(x: int): A = y"),
    ("addr-of", "addr x", "x"), ("asm-block", 'asm "nop"', "x"),
]


def _firing(cases: list[tuple[str, str, str]], lints: tuple[str, ...], name: str):  # noqa: ANN202
    sources = [s for _, bad, good in cases for s in (bad, good)]
    wanted = [(code, fires) for code, _, _ in cases for fires in (True, False)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = deal(spark, sf_dir, sources)
        found = nim.diagnose(docs, lints=lints).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
        code = pick([c for c, _ in wanted])
        return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", code.alias("code"), F.coalesce(F.array_contains("codes", code), F.lit(False)).alias("fires"))

    run.__name__ = name
    return query(known(wanted, "code", "fires"))(run)


nim_grammar_checks = _firing(NIM_FAULTS, (), "nim_grammar_checks")
nim_lints = _firing(NIM_LINTS, tuple(sorted(LINTS)), "nim_lints")

NIM_TREE_FAULTS = [("if a\n  b", "expected-colon"), ("for i x: y", "expected-in"), ("if a:\nb", "expected-indented-body"), ("case x\nof: a", "of-without-value"), ("type A object", "missing-type-equals"), ("let x = ¤", None)]


@query(known([(c or "", c is not None) for _, c in NIM_TREE_FAULTS], "code", "fires"))
def nim_tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree parser had to cope with."""
    docs = deal(spark, sf_dir, [s for s, _ in NIM_TREE_FAULTS])
    found = nim.diagnose(docs, grammar=True).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    code = pick([c or "" for _, c in NIM_TREE_FAULTS])
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", code.alias("code"), F.coalesce(F.array_contains("codes", code), F.lit(False)).alias("fires"))


NIM_SHAPES = [
    ("a + b * c ^ d", "(infix + a (infix * b (infix ^ c d)))"), ("a - b - c", "(infix - (infix - a b) c)"), ("not a == b", "(infix == (prefix not a) b)"), ("a and b or c", "(infix or (infix and a b) c)"), ("-1", "int:-1"),
    ("f a, -1", "(cmd f a int:-1)"), ("a -b", "(cmd a (prefix - b))"), ("a - b", "(infix - a b)"), ("x.y[1](2)", "(call (at (dot x y) int:1) int:2)"), ("A(x: 1)", "(oconstr A (kv x int:1))"), ("f(k = 2)", "(call f (vv k int:2))"),
    ("(1, 2)", "(tup int:1 int:2)"), ("(a)", "(par a)"), ("{1: 2}", "(tabconstr (kv int:1 int:2))"), ("0xFF'u8", "(suf int:255 str:u8)"), ('r"a"', "(suf str:a str:R)"), ("x = y", "(asgn x y)"),
    ("let a*, b: int = 1", "(let a x . int int:1) (let b . . int int:1)"), ("let (a, b) = t", "(unpackdecl t (unpacktup (let a . . . .) (let b . . . .)))"),
    ("proc f*[T: int](x: T): int {.inline.} =\n  x", "(proc f x . (typevars (typevar T . . int .)) (params (param x . . T .)) int (pragmas inline) . (stmts x))"),
    ("if a: b\nelif c: d\nelse: e", "(if (elif a (stmts b)) (elif c (stmts d)) (else (stmts e)))"), ("if a:\n  if b:\n    c\nelse:\n  d", "(if (elif a (stmts (if (elif b (stmts c))))) (else (stmts d)))"),
    ("case x\nof 1, 2: a\nelse: b", "(case x (of (ranges int:1 int:2) (stmts a)) (else (stmts b)))"), ("for i, j in x: y", "(for x (unpackflat (let i . . . .) (let j . . . .)) (stmts y))"), ("while a:\n  break", "(while a (stmts (break .)))"),
    ("try:\n  a\nexcept E:\n  b\nfinally:\n  c", "(try (stmts a) (except E (stmts b)) (fin (stmts c)))"), ("import a, b/c", "(import a (infix / b c))"), ("from a import b", "(fromimport a b)"), ("import a except b", "(importexcept a b)"),
    ("type A = ref object of B\n  x*: int", "(type A . . . (ref (object B (fld x x . int .))))"), ("type E = enum a = 1, b", "(type E . . . (enum . (efld a . . . int:1) (efld b . . . .)))"), ("type T = tuple[a: int]", "(type T . . . (tuple (kv a int)))"),
    ("var x = if a: 1 else: 2", "(var x . . . (expr (if (elif a (stmts int:1)) (else (stmts int:2)))))"), ("f(x):\n  y", "(call f x (stmts y))"), ("return\ndiscard x", "(ret .) (discard x)"), ("## doc\nx", "(comment) x"), ("`+ =`(a)", "(call (quoted + =) a)"),
]


def flat(shape: str) -> str:
    """A shape as its words with their depths, in order."""
    out, depth, head = [], 0, False
    for word in shape.replace("(", " ( ").replace(")", " ) ").split():
        if word == ")":
            depth -= 1
        elif word != "(":
            out.append(f"{depth + 1}{word}")
            depth += head
        head = word == "("
    return " ".join(out)


@query(known([(flat(w),) for _, w in NIM_SHAPES], "shape"))
def nim_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of Nim sources, as the depth and name of every node in order; empty slots are dots, identifiers their own names."""
    found = nim.parse_nodes(deal(spark, sf_dir, [s for s, _ in NIM_SHAPES])).filter("node_id > 0")
    word = F.when(F.col("tag") == "empty", ".").when(F.col("tag") == "ident", tree.text()).when(F.col("raw").isNotNull(), F.concat("tag", F.lit(":"), tree.text())).otherwise(F.col("tag"))
    rows = found.groupBy(*tree.DOC).agg(F.array_sort(F.collect_list(F.struct("node_id", F.concat(F.col("depth").cast("string"), word).alias("w")))).alias("w"))
    return rows.select("doc_id", F.concat_ws(" ", F.transform("w", lambda x: x["w"])).alias("shape"))


NIM_LITERALS = [
    ("¤", "int", "¤", None, None, ""), ("0xFF'i8", "int", "FF", -1, None, "i8"), ("0xFF'u8", "int", "FF", 255, None, "u8"), ("0b101", "int", "101", 5, None, ""), ("0o17", "int", "17", 15, None, ""), ("1_000", "int", "1000", 1000, None, ""),
    ("1_000.5e3", "float", "1000.5e3", None, 1000500.0, ""), ("2'f32", "float", "2", None, 2.0, "f32"), ('"a\\x41\\n\\u{e9}"', "str", "aA\né", None, None, ""), ("'a'", "char", "a", 97, None, ""), ('r"a""b\\n"', "rstr", 'a"b\\n', None, None, ""),
    ('"""\nx"y"""', "triplestr", 'x"y', None, None, ""), ("`a b`", "ident", "ab", None, None, ""), ("fmt_x", "ident", "fmt_x", None, None, ""), ("nil", "keyword", "nil", None, None, ""), ("+=", "operator", "+=", None, None, ""), ("#[ a #[ b ]# ]# c", "ident", "c", None, None, ""),
]


@query(known([(k, t, s) for _, k, t, _, _, s in NIM_LITERALS], "kind", "text", "suffix").replace(" from part", f", case p_partkey % {len(NIM_LITERALS)} {' '.join(f'when {i} then {c[3]}' for i, c in enumerate(NIM_LITERALS) if c[3] is not None)} when 0 then p_partkey else -999 end as value from part"))
def nim_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token of a source, with its decoded value."""
    found = nim.tokenize(deal(spark, sf_dir, [c[0] for c in NIM_LITERALS])).filter("tok_id = 0")
    return found.select("doc_id", "kind", "text", "suffix", F.when(F.col("kind").isin("int", "char"), F.col("int_value")).otherwise(-999).alias("value"))


NIM_UNITS = [
    ("x + ¤", "complete"), ("if x > 1:", "incomplete"), ("foo(", "incomplete"), ("foo)", "invalid"), ('"abc', "incomplete"), ('"""abc', "incomplete"), ("#[ x", "incomplete"), ("(]", "invalid"), ("return", "complete"), ("type", "incomplete"),
    ("", "complete"), ("x =", "incomplete"), ("a,", "incomplete"), ("let x = 'a'", "complete"),
]


@query(known([(v,) for _, v in NIM_UNITS], "verdict"))
def nim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nim.completeness(deal(spark, sf_dir, [s for s, _ in NIM_UNITS])).select("doc_id", "verdict")


NIM_SPACING = [("\tx¤ \r\n", "indent-width line-ending tabs-not-allowed trailing-whitespace"), ("x\ny\n", ""), (" \tx\n", "tabs-not-allowed"), ("x", "missing-final-newline"), ("   x\n", "indent-width")]


@query(known([(c,) for _, c in NIM_SPACING], "codes"))
def nim_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the options about white space find."""
    docs = deal(spark, sf_dir, [s for s, _ in NIM_SPACING])
    options = nim_dialect.Options(trailing_whitespace=True, newline="lf", final_newline=True, indent_width=2)
    found = nim.diagnose(docs, options).groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("codes", " "), F.lit("")).alias("codes"))
