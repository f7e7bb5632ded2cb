"""Table functions and queries on Spark, against DuckDB where it can answer."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from treeloom.operators import checks, diagnostics, gates, nim, nodes, registry, tree, views
from treeloom.operators import json as strict
from treeloom.plans import cases, catalog  # noqa: F401  cases adds its queries to the catalogue
from treeloom.sources import artifact, files
from treeloom.streaming import parse as streaming

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(frame, columns):
    rows = frame[columns].astype(object)
    return sorted(map(str, rows.where(rows.notna(), None).itertuples(index=False, name=None)))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


#: Queries that read documents with more than one parser, or one parser's output with another.
PARSERS = {"css_decls_from_pages": 2, "css_selectors_from_pages": 2, "web_check_generated": 2, "artifact_round_trip": 3, "truncation_fuzz": 9}


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_a_query_parses_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") <= PARSERS.get(name, 1) and "Cartesian" not in plan


def docs(spark, *texts):
    return spark.createDataFrame([(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, content binary")


def test_nulls_and_empty_tables(spark):
    frame = docs(spark, None, "", "<p>é")
    found = nodes.parse_nodes(frame, "html")
    assert {r["doc_id"]: r["n"] for r in tree.count_tag(found, "elem").collect()} == {0: 0, 1: 0, 2: 1}
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in tree.render(found, "html").collect()} == {0: "", 1: "", 2: "<p>é"}
    none = frame.limit(0)
    assert nodes.parse_nodes(none, "css").count() == 0 and nodes.diagnose(none, "css").count() == 0 and strict.tape(none).count() == 0
    assert [r["error"] for r in strict.lint(frame).orderBy("doc_id").collect()] == ["empty document", "empty document", "a value expected"]


def test_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(1, "a{b:c}"), (1, "d{e:f;g:h}"), (None, "i{}"), (None, "i{}"), (2, None)], "doc_id long, content string").repartition(3)
    found = nodes.parse_nodes(frame, "css")
    back = sorted((str(r["doc_id"]), bytes(r["content"]).decode()) for r in tree.render(found, "css").collect())
    assert back == [("1", "a{b:c}"), ("1", "d{e:f;g:h}"), ("2", ""), ("None", "i{}"), ("None", "i{}")]
    trip = gates.round_trip(frame, "css").collect()
    assert len(trip) == 5 and all(r["same"] for r in trip) and sum(r["doc_id"] is None for r in trip) == 2
    assert sorted((str(r["doc_id"]), r["n"]) for r in tree.count_tag(found, "decl").collect()) == [("1", 1), ("1", 2), ("2", 0), ("None", 0), ("None", 0)]
    assert sorted((r["selector"], r["prop"]) for r in views.css_declarations(frame).collect()) == [("a", "b"), ("d", "e"), ("d", "g")]
    assert checks.literal_check(frame, "css").count() == 5 and gates.identity(frame, "css").count() == 5 and checks.web_check(frame).count() == 5
    made = artifact.artifacts(found, "css")
    assert made.count() == 5 and artifact.read_artifacts(made).count() == found.count()
    tapes = strict.tape(spark.createDataFrame([(1, '{"a":1,"a":2}'), (1, '{"a":3}'), (None, "[]")], "doc_id long, content string"))
    assert [r["n"] for r in strict.duplicate_keys(tapes).collect()] == [2] and strict.first_member(tapes, "a").count() == 2


def test_attribute_values_lose_their_quotes(spark):
    got = views.html_attributes(docs(spark, "<A Href='x\ny' ID=\"\" k=v checked>")).orderBy("node_id").collect()
    assert [(r["element"], r["attribute"], r["value"]) for r in got] == [("a", "href", "x\ny"), ("a", "id", ""), ("a", "k", "v"), ("a", "checked", None)]


def test_descendants(spark):
    found = nodes.parse_nodes(docs(spark, "a{b:c}@m{d{e:f}}", "x{}"), "css")
    pairs = tree.descendants(found, F.col("tag") == "atrule", F.col("tag") == "decl").collect()
    assert [(r["doc_id"], r["up"]["tag"], r["down"]["tag"]) for r in pairs] == [(0, "atrule", "decl")]


def test_dialect_of_each_row(spark):
    frame = registry.with_dialect(spark.createDataFrame([(1, "a/x.CSS", "a{}"), (2, "b.htm", "<p>"), (3, "c.zip", "?"), (4, "noext", "")], "doc_id long, path string, content string"))
    found = nodes.parse_nodes(frame, F.col("dialect")).filter("parent_id = -1")
    assert {(r["doc_id"], r["tag"]) for r in found.collect()} == {(1, "stylesheet"), (2, "doc")}
    assert registry.unknown_extensions(frame).count() == 2


def test_positions_are_in_bytes(spark):
    frame = docs(spark, "é\r\n<p>\r<b>\n<i>")
    got = nodes.parse_nodes(frame, "html").filter("tag = 'elem'").select("line", "col").collect()
    assert [tuple(r) for r in got] == [(2, 0), (3, 0), (4, 0)]


def test_truncations_of_pages(spark):
    texts = [None, "", "<p", "<p>é<!-- x", "<script>var a = '</p>'</script>" * 40, "<li a='" * 90 + "x" * 300, "<" * 262_145]
    found = {r["doc_id"]: tuple(r)[1:] for r in gates.truncations(docs(spark, *texts), "html").collect()}
    sizes = [len((t or "").encode()) for t in texts]
    assert found == {i: (n // max(1, n // 128) + 1, 0, False) if n <= 262_144 else (0, 0, True) for i, n in enumerate(sizes)}


def test_truncations_of_every_size(spark):
    """Neither a cap on documents nor a sample of prefixes when both are asked for."""
    texts = [None, "", "<p>é<!-- x", "<li a='" * 90 + "x" * 300, "<" * 262_145]
    for which, some in (("html", texts), ("css", texts[:3])):
        found = {r["doc_id"]: tuple(r)[1:] for r in gates.truncations(docs(spark, *some), which, samples=None, largest=None).collect()}
        assert found == {i: (len((t or "").encode()) + 1, 0, False) for i, t in enumerate(some)}


def test_no_page_is_too_large_for_the_truncation_query(spark, tmp_path):
    """Pages above 262144 bytes were skipped."""
    pages = [(1, "<p>x</p>"), (2, "<div a='b'>é</div>" * 20_000), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.asDict() for r in catalog.html_truncation_fuzz(spark, str(tmp_path)).collect()] == [{"failed": 0, "documents": 3, "skipped": 0}]


def test_gates(spark):
    frame = docs(spark, "a{b:c}", "a{", "}", "")
    assert all(r["same"] and r["first_difference"] is None for r in gates.round_trip(frame, "css").collect())
    assert all(r["same"] for r in gates.identity(frame, "css").collect())
    assert gates.truncations(frame, "css").agg(F.sum("failed")).first()[0] == 0
    want = spark.createDataFrame([(0, 1), (1, 0), (3, 0)], "doc_id long, want int")
    assert all(r["holds"] for r in gates.expect_count(nodes.parse_nodes(frame, "css"), "decl", want).collect())
    nest = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, want int")
    assert all(r["holds"] for r in gates.expect_nesting(nodes.parse_nodes(frame, "css"), "block", nest).collect())
    pairs = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"abd")), (bytearray(b"ab"), bytearray(b"abd")), (bytearray(b"x"), bytearray(b"x"))], "a binary, b binary")
    assert [r[0] for r in pairs.select(gates.first_difference(F.col("a"), F.col("b"))).collect()] == [2, 2, None]
    assert gates.fnv1a(b"") == 0xCBF29CE484222325 and gates.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_spec_checks(spark):
    found = nodes.parse_nodes(docs(spark, "a{b:c}}"), "css")
    assert tree.undeclared_tags(found, "css").count() == 0 and tree.spec_violations(found, "css").count() == 0
    odd = found.withColumn("tag", F.when(F.col("tag") == "decl", "mystery").otherwise(F.col("tag")))
    assert [r["tag"] for r in tree.undeclared_tags(odd, "css").collect()] == ["mystery"]
    bad = spark.createDataFrame([("d", "", "text", None), ("d", "p", "punct", None), ("d", "t", "text", "x"), ("d", "u", "text", None), ("d", "u", "text", None)], "dialect string, tag string, kind string, lit string")
    assert tree.spec_problems(bad).count() == 4


def test_views(spark):
    frame = docs(spark, "a , b{c : d /* e */  !important;--x:1} @media q { i{j:k} l:m }")
    got = views.css_declarations(frame).orderBy("node_id").collect()
    assert [(r["selector"], r["at_rule"], r["prop"], r["value"]) for r in got] == [("a , b", "", "c", "d !important"), ("a , b", "", "--x", "1"), ("i", "@media", "j", "k"), ("", "@media", "l", "m")]
    nested = docs(spark, "@a x{@b y{p{q:r}} s{t:u}} v{w{x:y} z:1}")
    rows = views.css_declarations_running(nested).orderBy("node_id").collect()
    assert [(r["selector"], r["at_rule"], r["prop"]) for r in rows] == [("p", "@a@b", "q"), ("s", "", "t"), ("w", "", "x"), ("w", "", "z")]
    assert [r["selector"] for r in views.css_declarations(nested).orderBy("node_id").collect()] == ["p", "s", "w", "v"]
    page = docs(spark, "<STYLE>a</STYLE><!-- x --><style></style><style><!-- b --></style><title>t</title>")
    assert [r["content"] for r in views.raw_text_of(page, "style").orderBy("node_id").collect()] == ["a", "<!-- b -->"]
    config = docs(spark, 'top = 1\n[s]\na.b = "x"\nc : y # z\n')
    rows = views.cfg_entries(config).orderBy("node_id")
    assert [(r["section"], r["key"], r["value"]) for r in rows.collect()] == [(None, "top", "1"), ("s", "a.b", "x"), ("s", "c", "y")]
    assert views.identifier_entries(rows).count() == 2


def test_diagnostics_output(spark):
    frame = docs(spark, "<div>\n<b>x</div></i>", "<p>")
    found = nodes.diagnose(frame, "html")
    text = [r["text"] for r in diagnostics.as_text(diagnostics.in_order(found), F.lit("a.html")).collect()]
    assert text[0].startswith("a.html:2:1: error[unclosed-element]: <b> is never closed\n  note: a.html:2:5: still open here\n  help: insert </b>")
    shown = json.loads(diagnostics.as_json(found).first()["json"])
    assert [d["code"] for d in shown] == ["unclosed-element", "stray-end-tag"] and "fix" not in shown[1]
    assert diagnostics.first_error(found).first()["code"] == "unclosed-element"
    assert {r["doc_id"]: r["exit_code"] for r in diagnostics.exit_codes(checks.literal_check(frame, "html")).collect()} == {0: 1, 1: 0}
    line, col = diagnostics.positions(F.lit("ab\ncd"), F.lit(4))
    assert tuple(spark.range(1).select(line, col).first()) == (2, 2)


def test_artifacts_round_trip(spark):
    frame = docs(spark, "a{b:'(c)\\\n'}", "@x (y);é", "")
    found = nodes.parse_nodes(frame, "css")
    made = artifact.artifacts(found, "css")
    assert {r[0] for r in made.select(artifact.dialect_of(F.col("artifact"))).collect()} == {"css-parsed"}
    back = artifact.read_artifacts(made)
    columns = ["doc_id", "node_id", "parent_id", "end_id", "depth", "tag", "raw"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, found.select(columns).collect()))


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.css").write_text("a{b:c}")
    (tmp_path / "in" / "b.json").write_text("[1")
    (tmp_path / "in" / "c.bin").write_text("?")
    frame = files.read_documents(spark, str(tmp_path / "in"))
    assert {r["dialect"] for r in frame.collect()} == {"css-parsed", "json-parsed", None}
    batch = nodes.parse_nodes(frame, F.col("dialect"))
    q = streaming.write_stream(streaming.stream_nodes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("doc_key").collect())) == sorted(map(str, batch.drop("doc_key").collect()))
    label = files.path_label(F.lit("file:///x/y/z.css"), "/x")
    assert spark.range(1).select(label).first()[0] == "y/z.css"
    assert files.inline_document(spark, "{}", "x.json").first()["dialect"] == "json-parsed"


def test_json_operators(spark):
    frame = docs(spark, '{"a":1,"a":"é","n":1.50e1,"big":99999999999999999999}', "[1,{}]", "{")
    tape = strict.tape(frame)
    assert [(r["key"], r["lexeme"]) for r in strict.members(tape).filter("doc_id = 0").orderBy("ordinal").collect()] == [("a", "1"), ("a", "é"), ("n", "1.50e1"), ("big", "99999999999999999999")]
    assert strict.first_member(tape, "a").first()["lexeme"] == "1"
    some = strict.tape(frame, columns=("idx", "key", "lexeme"), depth=1, values=True)
    assert some.columns == ["doc_id", "doc_key", "idx", "key", "lexeme"]
    assert sorted(map(str, some.collect())) == sorted(map(str, tape.filter("depth = 1 and not is_key").select(some.columns).collect()))
    assert [tuple(r) for r in strict.duplicate_keys(tape).drop("doc_key").collect()] == [(0, 0, "a", 2)]
    ints = strict.members(tape).filter("doc_id = 0").orderBy("ordinal").select(strict.get_int(default=-1).alias("v")).collect()
    assert [r["v"] for r in ints] == [1, -1, -1, -1]
    assert [r["status"] for r in strict.query(frame, "a").orderBy("doc_id").collect()] == ["ok", "absent", "invalid"]
    rows = strict.digest(frame).orderBy("doc_id").collect()
    assert [(r["n_object"], r["n_string"], r["n_int"], r["n_float"]) for r in rows] == [(1, 5, 2, 1), (1, 0, 1, 0)]
    assert rows[0]["string_hash"] == f"{gates.fnv1a('a\0a\0é\0n\0big\0'.encode()):016x}" and rows[1]["int_sum"] == 1
    assert rows[0]["int_sum"] == (10**20 + (1 << 63)) % (1 << 64) - (1 << 63)
    assert json.loads(strict.pairs_json(tape).filter("doc_id = 0").first()["pairs"])[1] == {"key": "a", "kind": "string", "lexeme": "é"}


def test_nim_tables(spark):
    frame = docs(spark, "let x = (1]\n", "#? stdtmpl\n(", None)
    found = nim.diagnose(frame).collect()
    assert [(r["doc_id"], r["code"], r["related"]["col"]) for r in found] == [(0, "mismatched-bracket", 8)]
    assert nim.tokenize(frame).filter("kind = 'eof'").count() == 3
    assert [r["verdict"] for r in nim.completeness(frame).orderBy("doc_id").collect()] == ["invalid", "incomplete", "complete"]


def test_entry_needs_no_llm(tmp_path):
    """The entry module works where the llm subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "treeloom", tmp_path / "treeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
