"""The query catalogue over the test tables, each with DuckDB SQL for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dialects import context
from ..operators import checks, diagnostics, gates, nim, nodes, registry, tree, views
from ..operators import json as strict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Deal out a table that is read in fewer parts than ``least``, the number of cores; parsing is the work, not moving.

    A large table has parts enough and stays where it is.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and html as a document table."""
    return spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")))


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.parse_nodes(pages(spark, sf_dir), "html")


def style_docs(spark: SparkSession, sf_dir: str, name: str = "style") -> DataFrame:
    """Every style text of every page, a row each."""
    return views.raw_text_of(pages(spark, sf_dir), name)


# What is left of a page without comments and the insides of raw-text elements.
_BARE = """
    select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
        '(<script[^>]*>).*?(</script>)', '\\1\\2', 'gs'), '(<style[^>]*>).*?(</style>)', '\\1\\2', 'gs'),
        '(<title[^>]*>).*?(</title>)', '\\1\\2', 'gs') h
    from pages
"""


_VOID = "name in ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')"


@query(f"""
    with s as ({_BARE})
    select lower(t) as tag, count(*) as n
    from (select unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) t from s) group by 1
""")
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = nodes.parse_nodes(pages(spark, sf_dir), "html", tags=("stag",), carry={"name": ("string", context.TAG_NAME)})
    return starts.groupBy(F.col("name").alias("tag")).agg(F.count("*").alias("n"))


@query("select page_id as doc_id, md5(html) as digest from pages")
def html_roundtrip_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.render(page_nodes(spark, sf_dir), "html").select("doc_id", F.md5("content").alias("digest"))


@query(f"""
    with s as ({_BARE}), t as (select unnest(regexp_extract_all(h, '<[a-zA-Z][^>]*>')) tag from s)
    select lower(a) as attribute, count(*) as n
    from (select unnest(regexp_extract_all(tag, '\\s([a-zA-Z-]+)=', 1)) a from t) group by 1
""")
def html_attr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.html_attributes(pages(spark, sf_dir)).groupBy("attribute").agg(F.count("*").alias("n"))


@query(f"""
    with s as ({_BARE}), t as (select page_id, unnest(regexp_extract_all(h, '<a [^>]*>')) tag from s)
    select page_id as doc_id, regexp_extract(tag, 'href="([^"]*)"', 1) as target, count(*) as n from t group by 1, 2
""")
def html_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.html_attributes(pages(spark, sf_dir)).filter("element = 'a' and attribute = 'href'")
    return found.groupBy("doc_id", F.col("value").alias("target")).agg(F.count("*").alias("n"))


@query(f"""
    with s as ({_BARE}), t as (select page_id, len(regexp_extract_all(h, '>[^<]+')) n from s)
    select t.page_id as doc_id, cast(n + (select count(*) from (values ('script'), ('style'), ('title')) v(e), pages q
        where q.page_id = t.page_id and regexp_extract(q.html, '(?s)<' || e || '[^>]*>(.*?)</' || e || '>', 1) <> '') as bigint) as n
    from t
""")
def html_text_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text leaves of each page, the insides of raw-text elements among them; a comment between two texts parts them."""
    every = nodes.parse_nodes(pages(spark, sf_dir), "html", tags=("doc", "text", "comment"))
    order = Window.partitionBy(*tree.DOC).orderBy("node_id")
    back = lambda n: (F.lag("tag", n).over(order), F.lag("node_id", n).over(order) == F.col("node_id") - n)
    (one, next_to), (two, next_but_one) = back(1), back(2)
    apart = every.withColumn("follows", (one == "comment") & next_to & (two == "text") & next_but_one)
    return apart.groupBy(*tree.DOC).agg(F.count_if((F.col("tag") == "text") & ~F.coalesce("follows", F.lit(False))).alias("n")).drop("doc_key")


@query("select page_id as doc_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) as content from pages")
def html_raw_text_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_text_of(pages(spark, sf_dir), "style").select("doc_id", "content")


@query("select page_id as doc_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) as content from pages")
def html_raw_text_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_text_of(pages(spark, sf_dir), "script").select("doc_id", "content")


@query("""select page_id as doc_id, cast(len(regexp_extract_all(html, '(?s)<!--.*?-->')) as bigint) as n from pages""")
def html_comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.count_tag(nodes.parse_nodes(pages(spark, sf_dir), "html", tags=("doc", "comment")), "comment").drop("doc_key")


@query("select cast(0 as bigint) as failed, count(*) as documents, cast(0 as bigint) as skipped from pages")
def html_truncation_fuzz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of every page, whatever its size, survives parsing and rendering."""
    found = gates.truncations(pages(spark, sf_dir), "html", samples=None, largest=None)
    return found.agg(F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed"), F.count("*").alias("documents"), F.count_if("skipped").alias("skipped"))


@query("select 'html-parsed' as dialect, count(*) as checked, cast(0 as bigint) as broken, cast(0 as bigint) as undeclared from pages")
def html_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.report(pages(spark, sf_dir), "html")


@query("select cast(null as bigint) as doc_id, cast(null as varchar) as tag, cast(null as integer) as first_node where false")
def html_undeclared_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.undeclared_tags(page_nodes(spark, sf_dir), "html").drop("doc_key")


@query(f"""
    with s as ({_BARE}), t as (select unnest(regexp_extract_all(h, '</?[a-zA-Z][a-zA-Z0-9]*')) t from s),
    n as (select lower(regexp_replace(t, '^</?', '')) name, t like '</%' closes from t)
    select 'unclosed-element' as code, count(*) filter (not closes) - count(*) filter (closes) as n from n
    where name not in ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr',
        'p', 'li', 'dt', 'dd', 'td', 'th', 'tr', 'tbody', 'thead', 'tfoot', 'option', 'optgroup', 'caption', 'colgroup', 'html', 'head', 'body', 'rt', 'rp')
""")
def html_unclosed_diags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.diagnose(pages(spark, sf_dir), "html").groupBy("code").agg(F.count("*").alias("n"))


@query(f"""
    with recursive s as ({_BARE}), t as (
        select page_id, unnest(toks) tok, generate_subscripts(toks, 1) i from (select page_id, regexp_extract_all(h, '</?[a-zA-Z][^>]*>') toks from s)),
    n as (select page_id, i, tok like '</%' closes, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) name, tok like '%/>' as done from t),
    r as (
        select page_id, cast(0 as bigint) i, cast([] as varchar[]) stack, 0 depth from s
        union all
        select r.page_id, n.i,
            case when closes then case when list_contains(stack, name) then stack[1:len(stack) - list_position(list_reverse(stack), name)] else stack end
                when done or {_VOID} then stack else list_append(stack, name) end,
            greatest(depth, len(stack) + case when closes then 0 else 1 end)
        from r join n on n.page_id = r.page_id and n.i = r.i + 1)
    select page_id as doc_id, cast(max(depth) as bigint) as depth from r group by 1
""")
def html_max_nesting_elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.max_nesting(nodes.parse_nodes(pages(spark, sf_dir), "html", tags=("elem",)), "elem").drop("doc_key")


_STYLES = "select page_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) s from pages"


@query(f"""
    select page_id as doc_id, regexp_extract(s, '([a-z]+)\\{{', 1) as selector, regexp_extract(s, '\\{{([a-z]+):', 1) as prop, regexp_extract(s, ':([^}}]*)\\}}', 1) as value
    from ({_STYLES})
""")
def css_decls_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parsers in a chain: pages to style texts to declarations."""
    return views.css_declarations(style_docs(spark, sf_dir)).select("doc_id", "selector", "prop", "value")


@query(f"select page_id as doc_id, regexp_extract(s, '([a-z]+)\\{{', 1) as selector from ({_STYLES})")
def css_selectors_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.css_selectors(style_docs(spark, sf_dir)).select("doc_id", "selector")


PART_CSS = "repeat('i{}', cast(p_partkey % 3 as int)) || '.p' || p_partkey || '{width:' || p_size || 'px;color:red /* c */ !important}@media x{' || repeat('a{b:c}', cast(p_partkey % 4 as int)) || '}'"


def part_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = (F.repeat(F.lit("i{}"), (k % 3).cast("int")), F.lit(".p"), k, F.lit("{width:"), "p_size", F.lit("px;color:red /* c */ !important}@media x{"), F.repeat(F.lit("a{b:c}"), (k % 4).cast("int")), F.lit("}"))
    return spread(table(spark, sf_dir, "part")).select(k.alias("doc_id"), F.concat(*parts).alias("content"))


@query(f"select p_partkey as doc_id, md5({PART_CSS}) as digest from part")
def css_roundtrip_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.render(nodes.parse_nodes(part_css(spark, sf_dir), "css"), "css").select("doc_id", F.md5("content").alias("digest"))


@query("""
    select p_partkey as doc_id, '.p' || p_partkey as selector, '' as at_rule, 'width' as prop, p_size || 'px' as value from part
    union all select p_partkey, '.p' || p_partkey, '', 'color', 'red !important' from part
    union all select p_partkey, 'a', '@media', 'b', 'c' from part, range(3) r(i) where i < p_partkey % 4
""")
def css_declarations_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.css_declarations(part_css(spark, sf_dir)).select("doc_id", "selector", "at_rule", "prop", "value")


def part_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division and a regular expression for each row, and one bracket in another for up to four levels."""
    n, deep = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 5).cast("int")
    parts = (F.lit("var x = "), n, F.lit(" / 2; var r = /a{"), n, F.lit("}/g; "), F.repeat(F.lit("f(["), deep), n, F.repeat(F.lit("])"), deep), F.lit(";"))
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.concat(*parts).alias("content"))


@query("""
    select kind, cast(a * count(*) + b * sum(p_partkey % 5) as bigint) as n
    from part, (values ('kw', 2, 0), ('name', 2, 1), ('num', 3, 0), ('regex', 1, 0), ('op', 6, 4), ('ws', 10, 0)) v(kind, a, b) group by kind, a, b
""")
def js_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.tokenize(part_js(spark, sf_dir), "js").groupBy("kind").agg(F.count("*").alias("n"))


@query("select p_partkey as doc_id, cast(2 * (p_partkey % 5) as bigint) as n, cast(2 * (p_partkey % 5) as bigint) as depth from part where p_partkey % 5 > 0")
def js_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nesting(nodes.parse_nodes(part_js(spark, sf_dir), "js", tags=("group",)), "group").drop("doc_key")


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("content")))


@query("select json_valid(props) as valid, count(*) as n from events group by 1")
def json_lint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.lint(event_docs(spark, sf_dir)).groupBy("valid").agg(F.count("*").alias("n"))


@query("select event_id as doc_id, 'ok' as status, json_extract_string(props, '$.k') as value from events")
def json_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.query(event_docs(spark, sf_dir), "k").select("doc_id", "status", "value")


@query("""
    select kind, cast(n * (select count(*) from events) as bigint) as n from (values ('object', 1), ('string', 1), ('int', 1)) v(kind, n)
""")
def json_tape_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.kind_counts(strict.tape(event_docs(spark, sf_dir), columns=("kind",)))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order as JSON with a repeated key, a number spelt as an exponent, its status nested, and arrays of up to five levels."""
    k, deep = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 5).cast("int")
    parts = (F.lit('{"o":'), k, F.lit(',"p":1.50e'), deep.cast("string"), F.lit(',"p":'), k, F.lit(',"s":{"v":"'), "o_orderstatus", F.lit('"},"l":[1'), F.repeat(F.lit(",[2"), deep), F.repeat(F.lit("]"), deep), F.lit("]}"))
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.concat(*parts).alias("content"))


@query("""
    select o_orderkey as doc_id, v.ordinal, v.key, v.kind, case v.ordinal when 0 then cast(o_orderkey as varchar) when 1 then '1.50e' || o_orderkey % 5 when 2 then cast(o_orderkey as varchar) end as lexeme
    from orders, (values (0, 'o', 'int'), (1, 'p', 'float'), (2, 'p', 'int'), (3, 's', 'object'), (4, 'l', 'array')) v(ordinal, key, kind)
""")
def json_members_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.members(strict.tape(order_docs(spark, sf_dir), depth=1, values=True)).select("doc_id", "ordinal", "key", "kind", "lexeme")


@query("select cast(o_orderkey as bigint) as doc_id, 'p' as key, cast(2 as bigint) as n from orders")
def json_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.duplicate_keys(strict.tape(order_docs(spark, sf_dir), columns=("key", "is_key", "parent"), values=True)).select("doc_id", "key", "n")


@query("select o_orderkey as doc_id, cast(2 + o_orderkey % 5 as bigint) as depth from orders")
def json_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.tape(order_docs(spark, sf_dir), columns=("depth",)).groupBy("doc_id").agg(F.max(F.col("depth")).cast("long").alias("depth"))


@query("select o_orderkey as doc_id, '1.50e' || o_orderkey % 5 as lexeme from orders")
def json_number_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.first_member(strict.tape(order_docs(spark, sf_dir)), "p").select("doc_id", "lexeme")


@query("select o_orderkey as doc_id, o_orderstatus as value from orders")
def json_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.query(order_docs(spark, sf_dir), "s.v").select("doc_id", "value")


@query("select l_orderkey as doc_id, cast(l_linenumber as int) as line, cast(l_quantity as double) as quantity from lineitem")
def json_elems_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by key in so many parts as there are cores: the grouping needs no other exchange, and parsing is spread.
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition(spark.sparkContext.defaultParallelism, "l_orderkey")
    rows = dealt.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"))
    docs = rows.select("doc_id", F.to_json(F.transform("l", lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_quantity"].alias("q")))).alias("content"))
    tape = strict.tape(docs, columns=("parent", "key", "lexeme"), depth=2, values=True)
    return tape.groupBy(*tree.DOC, "parent").agg(F.max(F.when(F.col("key") == "n", F.col("lexeme"))).cast("int").alias("line"), F.max(F.when(F.col("key") == "q", F.col("lexeme"))).cast("double").alias("quantity")).drop("parent", "doc_key")


@query("""
    select v.doc_id, v.valid, v.error from (values (0, false, 'a value expected'), (1, false, 'a value expected'), (2, false, 'trailing content after the document'),
        (3, false, 'a key string expected'), (4, false, 'control character in string'), (5, true, null)) v(doc_id, valid, error)
""")
def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["[1,]", "NaN", "{} {}", "{'a':1}", '"a\tb"', '{"a":[1.5e3,"\\u00e9"]}']
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, content string")
    return strict.lint(docs).select(F.col("doc_id").cast("int").alias("doc_id"), "valid", "error")


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents)
    select doc_id, cast(count(*) filter (trim(line, ' ' || chr(9) || chr(13)) <> '') as bigint) as n from l group by 1
""")
def md_text_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text leaves of the documents read as Markdown: one for each line that is not blank, but for markers without text."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("content"))
    leaves = nodes.parse_nodes(docs, "md", tags=("doc", "text", "marker", "info"))
    lines = F.collect_set(F.when(F.col("tag") != "doc", F.col("line")))
    return leaves.groupBy(*tree.DOC).agg(F.size(lines).cast("long").alias("n")).drop("doc_key")


def nation_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "n_name", F.lit("\n\n- a\n- b\n  more\n"), F.repeat(F.lit("- c\n"), (F.col("n_nationkey") % 4).cast("int")), F.lit("\n```\n# fake\n- fake\n```\ntext\ntext\n> q\n")).alias("content"))


@query("""
    select v.tag, cast(v.a * count(*) + v.b * sum(n_nationkey % 4) as bigint) as n
    from nation, (values ('heading', 1, 0), ('list', 1, 0), ('item', 2, 1), ('fence', 1, 0), ('para', 1, 0), ('quote', 1, 0)) v(tag, a, b) group by v.tag, v.a, v.b
""")
def md_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tag_counts(nodes.parse_nodes(nation_md(spark, sf_dir), "md").filter("raw is null and tag <> 'doc'"))


@query("select cast(n_nationkey as bigint) as doc_id, '# fake' || chr(10) || '- fake' || chr(10) as body from nation")
def md_fence_swallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(nation_md(spark, sf_dir), "md", tags=("text",), carry={"fence_id": ("int", context.around("fence"))}).filter("fence_id is not null")
    rows = found.groupBy(*tree.DOC).agg(F.array_sort(F.collect_list(F.struct("node_id", tree.text().alias("t")))).alias("t"))
    return rows.select("doc_id", F.concat_ws("", F.transform("t", lambda x: x["t"])).alias("body"))


def order_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as YAML, with up to three flow collections and a block scalar that looks like entries."""
    k = F.col("o_orderkey").cast("string")
    flows = F.repeat(F.lit("  - {a: 1, b: [2, 3]}\n"), (F.col("o_orderkey") % 4).cast("int"))
    parts = (F.lit("---\norders:\n  - key: "), k, F.lit("\n    status: "), "o_orderstatus", F.lit("\n    note: |\n      - not an item\n      k: v\n"), flows, F.lit("...\n"))
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.concat(*parts).alias("content"))


@query("""
    select o_orderkey as doc_id, v.tag, cast(v.a + v.b * (o_orderkey % 4) as bigint) as n
    from orders, (values ('doc', 1, 0), ('item', 1, 3), ('entry', 4, 2), ('scalar', 1, 0), ('flow', 0, 2)) v(tag, a, b) where v.a + v.b * (o_orderkey % 4) > 0
""")
def yaml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(order_yaml(spark, sf_dir), "yaml", tags=("doc", "item", "entry", "scalar", "flow"))
    return found.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("select o_orderkey as doc_id, o_orderstatus as status from orders")
def yaml_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    carry = {"key": ("string", context.first_child("entry", "key")), "status": ("string", context.first_child("entry", "value"))}
    return nodes.parse_nodes(order_yaml(spark, sf_dir), "yaml", tags=("entry",), carry=carry).filter("key = 'status'").select("doc_id", "status")


@query("select o_orderkey as doc_id, true as same from orders")
def yaml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.round_trip(order_yaml(spark, sf_dir), "yaml").select("doc_id", "same")


def region_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(' = "'), "n_nationkey", F.lit('"\n')))), "").alias("entries"))
    regions = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return regions.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("["), "r_name", F.lit("]\n"), F.coalesce("entries", F.lit("")), F.lit('--path:"x=#1"\n; end\n')).alias("content"))


@query("""
    select cast(n_regionkey as bigint) as doc_id, r_name as section, n_name as key, cast(n_nationkey as varchar) as value
    from nation join region on r_regionkey = n_regionkey
""")
def cfg_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cfg_entries(region_cfg(spark, sf_dir)).select("doc_id", "section", "key", "value")


@query("""
    select cast(r_regionkey as bigint) as doc_id, cast(1 as bigint) as sections, (select count(*) from nation where n_regionkey = r_regionkey) as entries,
        cast(1 as bigint) as switches, cast(1 as bigint) as comments from region
""")
def cfg_entries_vs_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("section", "sections"), ("entry", "entries"), ("switch", "switches"), ("comment", "comments"))
    found = nodes.parse_nodes(region_cfg(spark, sf_dir), "cfg", tags=("config", *(tag for tag, _ in kinds)))
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("tag") == tag).alias(name) for tag, name in kinds))


def part_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = (F.lit("def f():\n\n    if x:\n        return "), k, F.lit("\n"), F.repeat(F.lit("    y = (1,\n  2)\n"), (k % 4).cast("int")))
    return spread(table(spark, sf_dir, "part")).select(k.alias("doc_id"), F.concat(*parts).alias("content"))


@query("select p_partkey as doc_id, cast(3 + p_partkey % 4 as bigint) as stmts, cast(2 as bigint) as blocks from part")
def py_stmt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(part_py(spark, sf_dir), "py", tags=("stmt", "block"))
    return found.groupBy("doc_id").agg(F.count_if(F.col("tag") == "stmt").alias("stmts"), F.count_if(F.col("tag") == "block").alias("blocks"))


def part_vds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<a> | <b> && <c>{1,"), n, F.lit("} || [ x y ]#"), F.repeat(F.lit(" || [ z w ]"), (F.col("p_partkey") % 3).cast("int"))).alias("content"))


@query("""
    select p_partkey as doc_id, v.tag, cast(v.a + v.b * (p_partkey % 3) as bigint) as n from part, (values ('alt', 1, 0), ('any', 1, 0), ('all', 1, 0), ('comp', 2, 0), ('group', 1, 1), ('juxta', 1, 1)) v(tag, a, b)
""")
def vds_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.parse_nodes(part_vds(spark, sf_dir), "vds", tags=("alt", "any", "all", "juxta", "comp", "group"))
    return found.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("""
    select p_name || case p_partkey % 4 when 0 then '.CSS' when 1 then '.htm' when 2 then '.Yml' else '.x' end as path,
        case p_partkey % 4 when 0 then 'css-parsed' when 1 then 'html-parsed' when 2 then 'yaml-parsed' end as dialect from part
""")
def dialect_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    ending = F.when(k == 0, ".CSS").when(k == 1, ".htm").when(k == 2, ".Yml").otherwise(".x")
    return registry.with_dialect(spread(table(spark, sf_dir, "part")).select(F.concat("p_name", ending).alias("path")))


@query("""
    select * from (values ('css-parsed', 'css', '.css', 14, 4, 9, 28), ('html-parsed', 'html', '.html .htm .xhtml', 11, 5, 6, 23), ('py-parsed', 'py', '.py .pyi', 10, 0, 4, 14),
        ('js-parsed', 'js', '.js .mjs .cjs', 11, 0, 3, 14), ('json-parsed', 'json', '.json', 5, 6, 5, 16), ('vds-parsed', 'vds', '.vds', 12, 6, 11, 29),
        ('md-parsed', 'md', '.md .markdown', 7, 0, 9, 16), ('yaml-parsed', 'yaml', '.yaml .yml', 12, 0, 9, 21), ('cfg-parsed', 'cfg', '.cfg .ini', 11, 0, 6, 17)) v(name, command, exts, text, punct, struct, total)
""")
def dialect_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listing(spark).drop("summary").select("name", "command", "exts", *(F.col(c).cast("int").alias(c) for c in ("text", "punct", "struct", "total")))


@query("select cast(null as varchar) as dialect, cast(null as varchar) as tag, cast(null as varchar) as problem where false")
def node_spec_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.spec_problems(nodes.spec_table(spark))


def part_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part")).select(k.alias("doc_id"), F.concat(F.repeat(F.lit("("), (k % 5).cast("int")), F.repeat(F.lit(")"), (k % 3).cast("int"))).alias("content"))


@query("""
    select p_partkey as doc_id, cast(greatest(p_partkey % 5 - p_partkey % 3, 0) as bigint) as unclosed, cast(greatest(p_partkey % 3 - p_partkey % 5, 0) as bigint) as unmatched from part
""")
def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_brackets(spark, sf_dir)
    found = nodes.diagnose(docs, "js").groupBy("doc_id").agg(F.count_if(F.col("code") == "unclosed-group").alias("unclosed"), F.count_if(F.col("code") == "unmatched-close").alias("unmatched"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("unclosed", "unmatched")))


@query("""
    select p_partkey as doc_id, 'f.css:1:' || (length('.p' || p_partkey) + 9) || ': error[expected-colon]: expected '':'' after property name' as text from part
""")
def diag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(".p"), "p_partkey", F.lit("{ color }}")).alias("content"))
    found = nodes.diagnose(docs, "css").filter("code = 'expected-colon'")
    return diagnostics.as_text(diagnostics.in_order(found), F.lit("f.css")).select("doc_id", "text")


@query("""
    select p_partkey as doc_id, v.code, v.n from part, (values ('expected-colon', cast(1 as bigint)), ('unmatched-close', cast(1 as bigint))) v(code, n)
""")
def diag_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(".p"), "p_partkey", F.lit("{ color }}")).alias("content"))
    return nodes.diagnose(docs, "css").groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query("""select page_id as doc_id, cast(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) as bigint) as links from pages where html like '%<nav>%</nav>%'""")
def tree_ancestor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside the navigation of each page: an element is below another if its number is within the other's range."""
    name, node = F.col("element"), F.struct("node_id", "end_id")
    found = views.html_elements(pages(spark, sf_dir)).groupBy(*tree.DOC).agg(F.collect_list(F.when(name == "nav", node)).alias("navs"), F.collect_list(F.when(name == "a", F.col("node_id"))).alias("links"))
    inside = F.filter("links", lambda link: F.exists("navs", lambda nav: (link > nav["node_id"]) & (link < nav["end_id"])))
    return found.filter(F.size("navs") > 0).select("doc_id", F.size(inside).cast("long").alias("links"))


def part_nim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, ")").when(k % 4 == 1, " +").when(k % 4 == 2, "))").otherwise("")
    return spread(table(spark, sf_dir, "part")).select(k.alias("doc_id"), F.concat(F.lit("let x = f("), k.cast("string"), ending, F.lit("\n")).alias("content"))


@query("""
    select p_partkey as doc_id, case p_partkey % 4 when 0 then 'complete' when 2 then 'invalid' else 'incomplete' end as verdict,
        case p_partkey % 4 when 0 then '' when 2 then 'unmatched-close' else 'unclosed-bracket' end as reason from part
""")
def completeness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nim.completeness(part_nim(spark, sf_dir)).select("doc_id", "verdict", "reason")


@query("select p_partkey as doc_id, cast(p_partkey as bigint) as value from part")
def nim_int_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nim.tokenize(part_nim(spark, sf_dir)).filter("kind = 'int'").select("doc_id", F.col("int_value").alias("value"))


@query("""
    select p_partkey as doc_id, case p_partkey % 4 when 2 then 'unmatched-close' else 'unclosed-bracket' end as code, cast(case p_partkey % 4 when 2 then 11 + length(p_partkey::varchar) else 9 end as int) as col
    from part where p_partkey % 4 <> 0
""")
def nim_bracket_diags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nim.diagnose(part_nim(spark, sf_dir)).filter("code in ('unclosed-bracket', 'unmatched-close', 'mismatched-bracket')").select("doc_id", "code", "col")


@query("""
    select p_partkey as doc_id, v.tag, cast(v.a + v.b * (p_partkey % 3) as bigint) as n from part, (values ('proc', 1, 0), ('param', 2, 0), ('if', 1, 0), ('infix', 2, 0), ('call', 1, 1), ('ret', 1, 0)) v(tag, a, b)
""")
def nim_tree_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    source = F.concat(F.lit("proc f(a: int, b = "), key.cast("string"), F.lit("): int =\n  if a > b:\n    return g(a - 1, b)\n"), F.repeat(F.lit("  h(a)\n"), (key % 3).cast("int")))
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), source.alias("content"))
    wanted = nim.parse_nodes(docs).filter("tag in ('proc', 'param', 'if', 'infix', 'call', 'ret')")
    return wanted.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("""
    select p_partkey as doc_id, p_partkey % 3 = 0 as sound, case p_partkey % 3 when 1 then 'html' when 2 then 'css' end as part,
        case p_partkey % 3 when 1 then 'unclosed-element' when 2 then 'unclosed-block' end as code from part
""")
def web_check_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    page = F.concat(F.lit("<div><style>p{a:b"), F.when(k == 2, "").otherwise("}"), F.lit("</style>"), F.when(k == 1, "").otherwise("</div>"))
    return checks.web_check(spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), page.alias("content")))


@query("select cast(n_regionkey as bigint) as doc_id, n_name as key, cast(n_nationkey as varchar) as value from nation where regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*')")
def cfg_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.constants(region_cfg(spark, sf_dir))


@query("select event_id as doc_id, true as same from events")
def json_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.identity(event_docs(spark, sf_dir), "json").select("doc_id", "same")


@query("""
    select o_orderkey as doc_id, '[{"key":"o","kind":"int","lexeme":"' || o_orderkey || '"},{"key":"p","kind":"float","lexeme":"1.50e' || o_orderkey % 5 || '"},{"key":"p","kind":"int","lexeme":"' || o_orderkey
        || '"},{"key":"s","kind":"object"},{"key":"l","kind":"array"}]' as pairs from orders
""")
def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.pairs_json(strict.tape(order_docs(spark, sf_dir))).select("doc_id", "pairs")


@query("""
    select event_id as doc_id, cast(1 as bigint) as n_object, cast(1 as bigint) as n_string, cast(1 as bigint) as n_int, cast(json_extract_string(props, '$.k') as bigint) as int_sum from events
""")
def json_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.digest(event_docs(spark, sf_dir)).select("doc_id", "n_object", "n_string", "n_int", "int_sum")
