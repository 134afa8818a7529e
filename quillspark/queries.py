"""Queries over the driver's tables, one or more for every operator, with DuckDB twins.

No table holds rich text, so most queries write their rows as rich text first and then read it with the operator under test.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import dictionary, fields, lookups, mtef, ole, state, tables, tokens
from .plans import options, render
from .registry import ORACLE as ORACLE
from .registry import QUERIES as QUERIES
from .registry import query
from .registry import table as _table

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", fx.rtf_encode(F.coalesce("text", F.lit(""))).alias("rtf"))


_ENCODED = r"""'{\rtf1\ansi ' || replace(replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\par '), chr(9), '\tab ') || '}'"""
_TOKENS = rf"""(SELECT doc_id, unnest(regexp_extract_all({_ENCODED}, '\\[a-zA-Z]+-?[0-9]* ?|[¡-ÿ]|\\[^a-zA-Z]|[{{}}]|[^\\{{}}¡-ÿ]+|\\')) AS tok FROM documents)"""


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def rtf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, tokenize and decode every document."""
    back = tokens.document_text(_documents(spark, sf_dir))
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(rf"""SELECT doc_id, CASE WHEN tok IN ('{{', '}}') THEN 1 WHEN tok[1] = '\' OR regexp_matches(tok, '^[¡-ÿ]$') THEN 3 ELSE 2 END AS cls, count(*) AS n FROM {_TOKENS} GROUP BY ALL""")
def token_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(_documents(spark, sf_dir)).groupBy("doc_id", "cls").agg(F.count("*").alias("n"))


@query(rf"""SELECT regexp_extract(tok, '^\\([a-zA-Z]+)', 1) AS word, count(*) AS n FROM {_TOKENS} WHERE regexp_matches(tok, '^\\[a-zA-Z]') GROUP BY ALL""")
def control_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tokens.classify(tokens.tokenize(_documents(spark, sf_dir)), dictionary.common_words(spark))
    return known.filter(F.col("word").rlike("^[a-zA-Z]+$")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT role AS word, count(*) AS n FROM conversations GROUP BY ALL")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("{\\rtf1\\b\\"), "role", F.lit(" x}")).alias("rtf"))
    return tokens.unknown(tokens.tokenize(rows), dictionary.common_words(spark)).groupBy("word").agg(F.count("*").alias("n"))


_TAGS = r"regexp_replace(regexp_replace(replace(replace(html, '{', ''), '}', ''), '</[^>]*>', '}', 'g'), '<[^>!/][^>]*>', '{', 'g')"


@query(rf"""WITH b AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS t FROM (SELECT page_id, regexp_extract_all({_TAGS}, '[{{}}]') AS x FROM pages)),
d AS (SELECT page_id, sum(CASE t WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth, CASE t WHEN '{{' THEN 1 ELSE -1 END AS step FROM b)
SELECT page_id, max(depth)::INT AS max_depth, sum(step)::INT AS end_depth FROM d GROUP BY page_id""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brace nesting, with the tags of pages written as braces."""
    bare = F.replace(F.replace(F.col("html"), F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))
    braces = F.regexp_replace(F.regexp_replace(bare, "</[^>]*>", "}"), "<[^>!/][^>]*>", "{")
    only = F.regexp_replace(braces, r"\\", "/")
    rows = _table(spark, sf_dir, "pages").select("page_id", only.alias("rtf"))
    t = tokens.tokenize(rows, "page_id").filter("cls = 1")
    return tokens.balance(t, "page_id").select("page_id", "max_depth", "end_depth")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtf = F.concat(F.lit("{\\rtf1{\\b "), "o_orderstatus", F.lit("}{\\*\\i "), "o_orderpriority", F.lit("}}"))
    return tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey")


@query("SELECT o_orderkey, open_pos::INT AS open_pos, close_pos::INT AS close_pos, level::INT AS level, destination, optional FROM orders, (VALUES (0, 11, 1, 'rtf', false), (2, 5, 2, 'b', false), (6, 10, 2, 'i', true)) AS v(open_pos, close_pos, level, destination, optional)")
def group_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.groups(_orders(spark, sf_dir), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus AS text FROM orders")
def skip_optional_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    kept = tokens.skip_groups(t, tokens.groups(t, "o_orderkey").filter("optional"), "o_orderkey")
    return tokens.plain_text(kept, "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority AS text FROM orders")
def text_within_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    inside = tokens.within_groups(t, tokens.groups(t, "o_orderkey").filter("optional"), "o_orderkey")
    return inside.filter("cls = 2").select("o_orderkey", F.col("tok").alias("text"))


@query("SELECT o_orderkey, '{' AS prev_tok, o_orderstatus AS tok, '}' AS next_tok FROM orders UNION ALL SELECT o_orderkey, '\\i ', o_orderpriority, '}' FROM orders")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tokens between their neighbours."""
    rtf = F.concat(F.lit("{\\rtf1{"), "o_orderstatus", F.lit("}{\\*\\i "), "o_orderpriority", F.lit("}}"))
    t = tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey")
    return tokens.peek(t, "o_orderkey").filter("cls = 2").select("o_orderkey", "prev_tok", "tok", "next_tok")


@query("SELECT o_orderkey, (1 + 2 * (o_orderkey % 4 > 0)::INT)::BIGINT AS n_runs, greatest(2, o_orderkey % 4)::BIGINT AS longest FROM orders")
def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tokens of one class: braces, as many control words as the key says, braces."""
    k = (F.col("o_orderkey") % 4).cast("int")
    rtf = F.concat(F.lit("{{"), F.repeat(F.lit("\\b"), k), F.lit("}}"))
    t = tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey")
    runs = tokens.runs(t, "cls", "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))
    return runs.select("o_orderkey", "n_runs", F.when(F.col("n_runs") == 1, 2).otherwise(F.col("longest")).cast("long").alias("longest"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS ok FROM orders")
def rich_text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtf = F.when(F.col("o_orderkey") % 3 == 0, F.lit("{\\foobar x}")).otherwise(F.lit("{\\rtf1 x}"))
    return tokens.is_rich_text(tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey"), "o_orderkey")


_CP1252 = "8364 0 8218 402 8222 8230 8224 8225 710 8240 352 8249 338 0 381 0 0 8216 8217 8220 8221 8226 8211 8212 732 8482 353 8250 339 0 382 376".split()


@query(f"""SELECT b::INT AS byte, chr(b::INT) AS char FROM (SELECT unnest(range(32, 128)) AS b UNION ALL SELECT unnest(range(160, 256)) AS b)
UNION ALL SELECT (127 + i)::INT, CASE c WHEN 0 THEN '' ELSE chr(c::INT) END FROM (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS c FROM (SELECT [{", ".join(_CP1252)}] AS x))""")
def charset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(32, 256).select(F.lit("cp1252").alias("charset"), F.col("id").cast("int").alias("byte"))
    return lookups.map_bytes(every, lookups.charset_table(spark, "cp1252")).select("byte", F.coalesce("char", F.lit("")).alias("char"))


def _escape_sql(column: str) -> str:
    out = column
    for k, (plain, _) in enumerate(fx.LATEX_SPECIALS):
        out = f"replace({out}, '{plain}', chr({0xE000 + k}))"
    for k, (_, written) in enumerate(fx.LATEX_SPECIALS):
        out = f"replace({out}, chr({0xE000 + k}), '{written}')"
    return out


@query(f"SELECT doc_id, md5({_escape_sql('text')}) AS latex_md5 FROM documents")
def latex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(fx.latex_escape(F.col("text")), "UTF-8")).alias("latex_md5"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '\\section*{' || p_name || '}' WHEN 1 THEN '\\subsection*{' || p_name || '}' ELSE p_name END AS latex FROM part".replace("\\\\", "\\"))
def heading_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("p_size") % 3 == 0, "Heading 1").when(F.col("p_size") % 3 == 1, "heading 2").otherwise("Body")
    return _table(spark, sf_dir, "part").select("p_partkey", lookups.heading(style, F.col("p_name")).alias("latex"))


@query("""WITH RECURSIVE s AS (SELECT d AS doc_id, n_nationkey AS num, CASE WHEN n_nationkey > 0 AND d = 0 THEN n_nationkey // 2 WHEN d = 1 THEN (n_nationkey + 1) % 5 END AS based_on FROM nation, range(3) AS r(d)),
c AS (SELECT doc_id, num, num AS ancestor, based_on, 0 AS depth, [num] AS seen FROM s
UNION ALL SELECT c.doc_id, c.num, s.num, s.based_on, c.depth + 1, list_append(c.seen, s.num) FROM c JOIN s ON c.doc_id = s.doc_id AND c.based_on = s.num WHERE NOT list_contains(c.seen, s.num))
SELECT doc_id, num, ancestor, depth FROM c""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains within three documents: a tree, a cycle of five with tails, and no bases."""
    n, d = F.col("n_nationkey"), F.col("doc_id")
    based = F.when((n > 0) & (d == 0), F.floor(n / 2).cast("int")).when(d == 1, (n + 1) % 5)
    styles = _table(spark, sf_dir, "nation").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("doc_id"), n.alias("num")).withColumn("n_nationkey", F.col("num"))
    return lookups.style_chain(styles.select("doc_id", "num", based.alias("based_on")))


@query(r"SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' & ' ORDER BY l_linenumber, l_partkey) || ' \\' AS latex FROM lineitem GROUP BY l_orderkey")
def table_rows_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").cast("string").alias("t"))
    return tables.latex_rows(cells, ["l_orderkey"], "at", "t")


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS "row", 1000 * l_linenumber AS "right" FROM lineitem UNION SELECT l_orderkey, l_linenumber, 20000 FROM lineitem),
b AS (SELECT table_id, "right", row_number() OVER (PARTITION BY table_id ORDER BY "right") - 1 AS boundary FROM (SELECT DISTINCT table_id, "right" FROM c))
SELECT table_id, "row", "right", (boundary - coalesce(lag(boundary) OVER (PARTITION BY table_id, "row" ORDER BY "right"), -1))::INT AS col_span FROM c JOIN b USING (table_id, "right")""")
def cell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (1000 * F.col("l_linenumber")).alias("right"))
    cells = cells.union(li.select("l_orderkey", "l_linenumber", F.lit(20000))).distinct()
    return tables.spans(cells).select("table_id", "row", "right", "col_span")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, count(DISTINCT l_linenumber)::INT AS "rows", (SELECT 1)::INT * max(c)::INT AS cols, sum(c)::BIGINT AS cells
FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM n GROUP BY ALL) GROUP BY l_orderkey""")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tables.table_shape(tables.number_cells(li, "l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    head = F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Times;}{\\f1 "), "c_mktsegment", F.lit(";}}{\\colortbl;\\red"), (key % 256).cast("string"), F.lit("\\green128\\blue"), (key % 7).cast("string"))
    tail = F.lit(";}{\\stylesheet{\\s0 Normal;}{\\s1\\sbasedon0 heading 1;}}{\\f1\\cf1\\s1 ")
    return _table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.concat(head, tail, "c_name", F.lit("}{\\f0\\cf0 x}}")).alias("rtf"))


@query("SELECT c_custkey AS doc_id, c_name AS text, (c_custkey % 256)::INT AS r, 128::INT AS g, (c_custkey % 7)::INT AS b FROM customer UNION ALL SELECT c_custkey, 'x', -1, -1, -1 FROM customer")
def color_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_customers(spark, sf_dir), resolve=True).select("doc_id", "text", *[F.coalesce(c, F.lit(-1)).alias(c) for c in "rgb"])


@query("SELECT c_custkey AS doc_id, c_name AS text, c_mktsegment AS font_name, 'heading 1' AS style_name FROM customer UNION ALL SELECT c_custkey, 'x', 'Times', 'Normal' FROM customer")
def font_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_customers(spark, sf_dir), resolve=True).select("doc_id", "text", "font_name", "style_name")


@query("SELECT c_custkey AS doc_id, num::INT AS num, name, coalesce(based_on, -1)::INT AS based_on FROM customer, (VALUES (0, 'Normal', NULL), (1, 'heading 1', 0)) AS v(num, name, based_on)")
def style_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.document_tables(_customers(spark, sf_dir)).filter("kind = 'style'").select("doc_id", "num", "name", F.coalesce("based_on", F.lit(-1)).alias("based_on"))


def _suppliers(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit(before), "s_name", F.lit(after)).alias("rtf"))


@query("SELECT s_suppkey AS doc_id, par::INT AS par, CASE par WHEN 0 THEN s_name ELSE t END AS text, align FROM supplier, (VALUES (0, '', 'center'), (1, 'b', 'right'), (2, 'c', 'left')) AS v(par, t, align)")
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_suppliers(spark, sf_dir, "{\\rtf1\\qc ", "\\par\\qr b\\par\\pard c}")).select("doc_id", "par", "text", "align")


@query("SELECT s_suppkey AS doc_id, run::INT AS run, CASE run WHEN 2 THEN s_name ELSE t END AS text, bold, italic FROM supplier, (VALUES (0, 'p ', false, false), (1, 'b ', true, false), (2, '', true, true), (3, ' b', true, false), (4, ' p', false, false)) AS v(run, t, bold, italic)")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_suppliers(spark, sf_dir, "{\\rtf1 p {\\b b {\\i ", "} b} p}")).select("doc_id", "run", "text", "bold", "italic")


@query("SELECT s_suppkey AS doc_id, CASE run WHEN 0 THEN 'body' ELSE 'footnote' END AS kind, CASE run WHEN 0 THEN 'a' ELSE s_name END AS text FROM supplier, range(2) AS r(run)")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_suppliers(spark, sf_dir, "{\\rtf1 a{\\footnote ", "}}")).select("doc_id", "kind", "text")


@query("SELECT s_suppkey AS doc_id, ['a group is not closed', 'no version word', 'text before the first group', 'text after the last group', ''][1 + s_suppkey % 5] AS error FROM supplier")
def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ("{\\rtf1 {%}", "{\\rtf2 %}", "%{\\rtf1 a}", "{\\rtf1 a}%", "{\\rtf1 %}")])
    rtf = F.replace(F.element_at(forms, (1 + F.col("s_suppkey") % 5).cast("int")), F.lit("%"), F.col("s_name"))
    return state.formatted_runs(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), rtf.alias("rtf"))).select("doc_id", F.coalesce("error", F.lit("")).alias("error")).distinct()


@query("SELECT s_suppkey AS doc_id, 'é' || s_name || 'Я' AS text FROM supplier")
def unicode_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _suppliers(spark, sf_dir, "{\\rtf1\\uc1 \\u233?", "\\u1071\\'df}")
    return state.formatted_runs(docs).groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "").alias("text"))


@query("SELECT s_suppkey AS doc_id, s_name AS text, 'http://x/' || s_suppkey AS target FROM supplier")
def link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtf = F.concat(F.lit('{\\rtf1{\\field{\\*\\fldinst HYPERLINK "http://x/'), "s_suppkey", F.lit('"}{\\fldrslt '), "s_name", F.lit("}}}"))
    return state.formatted_runs(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), rtf.alias("rtf"))).select("doc_id", "text", "target")


@query("SELECT p_partkey, (p_size & 1) <> 0 AS size, (p_size & 2) <> 0 AS color, (p_size & 32) <> 0 AS align FROM part")
def option_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", options.has(m, "text", "size").alias("size"), options.has(m, "text", "color").alias("color"), options.has(m, "paragraph", "align").alias("align"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 - 1 >= 0 THEN p_size % 5 - 1 WHEN p_size % 3 - 1 >= 0 THEN p_size % 3 - 1 ELSE 33 END::INT AS mask FROM part")
def preference_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", options.layered(F.col("p_size") % 5 - 1, F.col("p_size") % 3 - 1, F.lit(33)).alias("mask"))


@query("SELECT p_partkey, (p_size * 180)::INT AS twips FROM part")
def twips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", fx.inches_to_twips(F.col("p_size") / 8).alias("twips"))


@query(r"SELECT p_partkey, len(regexp_extract_all(p_name, '[^ \t]+'))::INT AS n_fields, regexp_extract(p_name, '[^ \t]+') AS first_field FROM part")
def field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.scan_fields(F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(f).alias("n_fields"), F.element_at(f, 1).alias("first_field"))


@query("SELECT page_id, url AS target, 'p' || page_id AS bookmark, page_id::INT AS code FROM pages")
def field_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    link, ref, sym = F.concat(F.lit('HYPERLINK "'), "url", F.lit('"')), F.concat(F.lit(" PAGEREF p"), "page_id", F.lit(" \\h")), F.concat(F.lit("symbol "), "page_id", F.lit(" \\f Symbol"))
    return _table(spark, sf_dir, "pages").select("page_id", fields.hyperlink(link).alias("target"), fields.page_reference(ref).alias("bookmark"), fields.symbol(sym).alias("code"))


@query(r"""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '\frac{' || replace(n_name, '_', '\_') || '}{' || n_regionkey || '}' WHEN 1 THEN '\sqrt[3]{' || replace(n_name, '_', '\_') || '}+^{2}' WHEN 2 THEN '\left[ \frac{a}{\sqrt{' || n_regionkey || '}}\right]'
WHEN 3 THEN '\sum_{i}^{n}' || replace(n_name, '_', '\_') ELSE '' END AS latex FROM nation""")
def equation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("EQ \\f(#,%)", "EQ \\r(3,#)+\\s\\up8(2)", "eq \\b\\bc\\[(\\f(a;\\r(%)))", "EQ \\i\\su(i,n,#)", "EQ \\f(#,%")
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), 1 + F.col("n_nationkey") % 5)
    given = F.replace(F.replace(form, F.lit("#"), F.col("n_name")), F.lit("%"), F.col("n_regionkey").cast("string"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(fields.equation(given), F.lit("")).alias("latex"))


@query(r"""SELECT page_id, string_split(url, '/')[-1] AS name, CASE page_id % 3 WHEN 0 THEN 'rtf' WHEN 1 THEN 'rtfd' ELSE 'unknown' END AS kind,
CASE page_id % 3 WHEN 0 THEN '/a/d' || page_id || '.tex' WHEN 1 THEN '/a/d' || page_id || '-latex/d' || page_id || '.tex' ELSE '/a/d' || page_id || '.tex' END AS out_path FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/a/d"), "page_id", F.when(F.col("page_id") % 3 == 0, ".RTF").when(F.col("page_id") % 3 == 1, ".rtfd").otherwise(".txt"))
    return _table(spark, sf_dir, "pages").select("page_id", fx.basename(F.col("url")).alias("name"), fx.file_kind(path).alias("kind"), fx.output_name(path).alias("out_path"))


@query("SELECT p_partkey, (p_size % 2 = 0 AND 130 + p_size IN (163, 179)) OR (p_size % 2 = 1 AND 50 + p_size IN (60, 62, 102, 112)) AS relation FROM part")
def relation_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    return _table(spark, sf_dir, "part").select("p_partkey", fields.is_relation(F.when(even, 134).otherwise(139), F.when(even, 130 + F.col("p_size")).otherwise(50 + F.col("p_size"))).alias("relation"))


@query("SELECT event_id, md5(['GIF87a', '%PDF-1', 'x'][1 + event_id % 3] || props) AS content_md5, ['gif', 'pdf', 'unknown'][1 + event_id % 3] AS kind FROM events")
def hex_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("GIF87a"), F.lit("%PDF-1"), F.lit("x")), (1 + F.col("event_id") % 3).cast("int"))
    written = F.regexp_replace(F.lower(F.hex(F.encode(F.concat(head, "props"), "UTF-8"))), "(.{64})", "$1\n")
    data = fields.picture_bytes(written)
    return _table(spark, sf_dir, "events").select("event_id", F.md5(data).alias("content_md5"), fields.picture_type(data).alias("kind"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def duplicate_keys_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.last_wins(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT user_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def duplicate_keys_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.first_wins(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT n_nationkey AS obj_id, '/Equation Native' AS path, 1::INT AS level, n_name AS content FROM nation")
def compound_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ole.write_compound({"Equation Native": n.encode().ljust(4096)}) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.binary())], ["obj_id", "data"])

    objects = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name").mapInArrow(build, "obj_id long, data binary")
    return ole.open_stream(ole.entries(objects), "/Equation Native").select(F.col("obj_id").cast("int").alias("obj_id"), "path", "level", F.rtrim(F.decode("content", "UTF-8")).alias("content"))


@query(r"SELECT n_nationkey AS eqn_id, '\[' AS latex_start, '\frac{' || n_name[1] || '}{\alpha }' AS latex, '\]' AS latex_end FROM nation")
def binary_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda code: F.concat(F.lit("0100020083"), code, F.lit("00"))
    letter = F.concat(F.hex(F.ascii("n_name")), F.lit("00"))
    data = F.concat(F.lit("0501000500" + "414200" + "00" + "0100" + "03000B0000"), line(letter), line(F.lit("B103")), F.lit("0000"))
    return mtef.equations(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("eqn_id"), F.unhex(data).alias("data"))).select(F.col("eqn_id").cast("int").alias("eqn_id"), "latex_start", "latex", "latex_end")


_LATEX_HEAD = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{hyperref}\n\\begin{document}\n".replace("\n", "' || chr(10) || '")


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
p AS (SELECT doc_id, i, CASE t WHEN '' THEN '' ELSE {_escape_sql('t')} || chr(10) || chr(10) END AS t FROM l)
SELECT doc_id, md5('{_LATEX_HEAD}' || string_agg(t, '' ORDER BY i) || '\\end{{document}}' || chr(10)) AS latex_md5 FROM p GROUP BY doc_id""")
def document_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: encoded, parsed by the state machine, rendered."""
    return render.to_latex(_documents(spark, sf_dir)).select("doc_id", F.md5(F.encode("latex", "UTF-8")).alias("latex_md5"))


from . import queries_documents, queries_equations, queries_files  # noqa: E402, F401  (they register themselves)
