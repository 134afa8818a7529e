"""Queries over documents made from the driver's tables: Unicode, groups, tables, pictures, fields, rendering, table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import text as fx
from .operators import dictionary, lookups, maps, state, tokens
from .plans import render
from .plans.options import Options
from .registry import literal, query
from .registry import table as _table


def _fill(form: str, **columns: Column | str) -> Column:
    """A form whose ``<name>`` places are filled by columns."""
    out = F.lit(form)
    for name, c in columns.items():
        out = F.replace(out, F.lit(f"<{name}>"), (F.col(c) if isinstance(c, str) else c).cast("string"))
    return out


def _suppliers(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("doc_id"), _fill(form, name="s_name", key="s_suppkey", four=F.col("s_suppkey") % 4).alias("rtf"))


#: Characters beyond Latin-1, and beyond 16 bits.
_WIDE = "漢字 👍🏽 “q” Ω\U00020000 é"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(_WIDE), F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   "), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_WIDE_SQL = f"SELECT doc_id, md5({literal(_WIDE)} || translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   ') || doc_id) AS text_md5 FROM documents"


@query(_WIDE_SQL)
def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with characters of every width, encoded, tokenized and decoded."""
    rtf = _wide(spark, sf_dir).select("doc_id", fx.rtf_encode(F.col("text")).alias("rtf"))
    return tokens.document_text(rtf).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(_WIDE_SQL)
def unicode_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the state machine, from documents kept as text that hold such characters as they are."""
    text = F.regexp_replace("text", r"([\\{}])", r"\\$1")
    rtf = _wide(spark, sf_dir).select("doc_id", F.concat(F.lit("{\\rtf1\\ansi\\ansicpg28591 "), text, F.lit("}")).alias("rtf"))
    runs = state.formatted_runs(rtf)
    return runs.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("SELECT s_suppkey AS doc_id, 'é' || s_name || '�' || chr(128077) AS by_tokens, 'é' || s_name || '�' || chr(128077) AS by_machine FROM supplier")
def unicode_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins as many as the document says, a lone half, a pair without stand-ins."""
    body = F.concat(F.lit("{\\rtf1\\uc"), (F.col("s_suppkey") % 4).cast("string"), F.lit(" \\u233 "), F.repeat(F.lit("?"), (F.col("s_suppkey") % 4).cast("int")), "s_name", F.lit("\\uc0\\u-10179 \\u-10179 \\u-9139 }"))
    docs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("rtf"))
    flat = tokens.plain_text(tokens.tokenize(docs)).select("doc_id", F.col("text").alias("by_tokens"))
    return flat.join(state.formatted_runs(docs).select("doc_id", F.col("text").alias("by_machine")), "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || o_orderpriority ELSE o_orderstatus END AS text FROM orders")
def skip_unknown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional groups go if their word is unknown, and stay if it is known."""
    word = F.when(F.col("o_orderkey") % 2 == 0, "bkmkstart").otherwise("nosuchword")
    rtf = F.concat(F.lit("{\\rtf1{\\b "), "o_orderstatus", F.lit("}{\\*\\"), word, F.lit(" "), "o_orderpriority", F.lit("}}"))
    t = tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey")
    gone = tokens.unknown_groups(tokens.groups(t, "o_orderkey"), dictionary.common_words(spark))
    return tokens.plain_text(tokens.skip_groups(t, gone.select("o_orderkey", "open_pos", "close_pos"), "o_orderkey"), "o_orderkey")


@query("""WITH m AS (SELECT o_orderkey, (o_orderkey % 5)::INT AS m FROM orders)
SELECT o_orderkey, 0::INT AS open_pos, (2 + 4 * m)::INT AS close_pos, 1::INT AS level FROM m UNION ALL SELECT o_orderkey, (2 + 3 * (j - 1))::INT, (2 + 3 * m + m - j)::INT, (j + 1)::INT FROM m, range(1, 5) AS r(j) WHERE j <= m""")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("o_orderkey") % 5).cast("int")
    rtf = F.concat(F.lit("{\\rtf1"), F.repeat(F.lit("{\\b x"), m), F.repeat(F.lit("}"), m), F.lit("}"))
    t = tokens.tokenize(_table(spark, sf_dir, "orders").select("o_orderkey", rtf.alias("rtf")), "o_orderkey")
    return tokens.groups(t, "o_orderkey").select("o_orderkey", "open_pos", "close_pos", "level")


@query("SELECT s_suppkey AS doc_id, 'c}d}' AS from_level, '\\tab d}' AS from_token, s_name AS next_text FROM supplier".replace("\\tab d", "\\tab d"))
def skip_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipping to a level and to a token, and the next text that is not blank."""
    t = tokens.tokenize(_suppliers(spark, sf_dir, "{\\rtf1{a{b{ } <name>}}c}d}"))
    u = tokens.tokenize(_suppliers(spark, sf_dir, "{\\rtf1{a{b}c}\\tab d}"))
    joined = lambda d, name: d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "").alias(name))
    level = joined(tokens.skip_to_level(t, 4, 1).filter("tok <> '}' or pos > 12"), "from_level")
    word = tokens.next_word(t).filter("pos = 7").select("doc_id", "next_text")
    return level.join(joined(tokens.skip_to_token(u, 2, "\\tab "), "from_token"), "doc_id").join(word, "doc_id")


@query("""SELECT s_suppkey AS doc_id, branch, n::BIGINT AS n FROM supplier, (VALUES ('made', 2), ('braces', 4), ('words', 2), ('other', 2)) AS v(branch, n)""")
def made_and_routed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens put in after every ``\\b``, every one handed to a hook, and all routed to named branches."""
    t = tokens.tokenize(_suppliers(spark, sf_dir, "{\\rtf1{\\b <name>}x}"))
    more = tokens.insert(t, F.col("word") == "b", ["\\emdash ", "\\emdash "])
    hooked = tokens.with_hook(more, lambda d: d.withColumn("loud", F.upper("tok")))
    branches = {"made": F.col("loud") == "\\EMDASH ", "braces": F.col("cls") == tokens.GROUP, "words": F.col("cls") == tokens.CONTROL}
    return tokens.route(hooked, branches).groupBy("doc_id", "branch").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, '漢字' || n_name AS cp932, '汉字' || n_name AS cp936, 'Я' || n_name AS cp1251, 'é' || n_name AS mac FROM nation")
def character_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.encode("n_name", "UTF-8")
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", *[F.concat(F.unhex(F.lit(h)), name).alias(f"b_{c}") for c, h in (("cp932", "8ABF8E9A"), ("cp936", "BABAD7D6"), ("cp1251", "DF"), ("mac", "8E"))])
    for c in ("cp932", "cp936", "cp1251", "mac"):
        rows = lookups.decode_bytes(rows, f"b_{c}", c, c)
    return rows.select("n_nationkey", "cp932", "cp936", "cp1251", "mac")


@query("SELECT s_suppkey AS doc_id, num::INT AS num, ancestor::INT AS ancestor, depth::INT AS depth FROM supplier, (VALUES (0, 0, 0), (1, 1, 0), (1, 0, 1), (2, 2, 0), (2, 1, 1), (2, 0, 2)) AS v(num, ancestor, depth) WHERE s_suppkey % 4 <> 0 OR num < 2 OR depth = 0")
def document_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles that one document in four bases on a number it lacks."""
    base = F.when(F.col("s_suppkey") % 4 == 0, "9").otherwise("1")
    form = _fill("{\\rtf1{\\stylesheet{\\s0 Normal;}{\\s1\\sbasedon0 A;}{\\s2\\sbasedon<base> B;}}x}", base=base)
    return state.style_ancestors(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), form.alias("rtf")))


def _line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a document with a table: a row a line; even lines have two cells, the second over two columns."""
    right = F.when(F.col("l_linenumber") % 2 == 0, "\\cellx1000\\cellx3000").otherwise("\\cellx1000\\cellx2000\\cellx3000")
    third = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.col("l_linestatus"), F.lit("\\cell ")))
    row = F.concat(F.lit("\\trowd"), right, F.lit("\\pard\\intbl "), F.col("l_partkey").cast("string"), F.lit("\\cell{\\b "), "l_returnflag", F.lit("}\\cell "), third, F.lit("\\row"))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", row.alias("t")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("{\\rtf1 a\\par "), joined, F.lit("\\pard b}")).alias("rtf"))


_ROWS = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS r, l_linenumber % 2 = 0 AS two, l_partkey, l_returnflag, l_linestatus FROM lineitem"


@query(f"""WITH l AS ({_ROWS}), w AS (SELECT *, bool_or(NOT two) OVER (PARTITION BY doc_id) AS three FROM l)
SELECT doc_id, r::INT AS tab_row, 0::INT AS tab_cell, 1::INT AS col_span, l_partkey::VARCHAR AS text FROM w
UNION ALL SELECT doc_id, r::INT, 1::INT, CASE WHEN two AND three THEN 2 ELSE 1 END::INT, l_returnflag FROM w UNION ALL SELECT doc_id, r::INT, 2::INT, 1::INT, l_linestatus FROM w WHERE NOT two""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.document_cells(_line_tables(spark, sf_dir)).select("doc_id", "tab_row", "tab_cell", "col_span", "text")


@query(rf"""WITH l AS ({_ROWS}), w AS (SELECT *, bool_or(NOT two) OVER (PARTITION BY doc_id) AS three FROM l),
t AS (SELECT doc_id, max(CASE WHEN three THEN 'lll' ELSE 'll' END) AS cols, string_agg(l_partkey || ' & ' || CASE WHEN two AND three THEN '\multicolumn{{2}}{{l}}{{\textbf{{' || l_returnflag || '}}}}' ELSE '\textbf{{' || l_returnflag || '}}' END
|| CASE WHEN two THEN '' ELSE ' & ' || l_linestatus END || ' \\' || chr(10), '' ORDER BY r) AS body FROM w GROUP BY doc_id)
SELECT doc_id, md5('a' || chr(10) || chr(10) || '\begin{{tabular}}{{' || cols || '}}' || chr(10) || body || '\end{{tabular}}' || chr(10) || chr(10) || 'b' || chr(10) || chr(10)) AS latex_md5 FROM t""")
def table_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = render.to_latex(_line_tables(spark, sf_dir), Options(fragment=True, table=1))
    return done.select("doc_id", F.md5(F.encode("latex", "UTF-8")).alias("latex_md5"))


@query(r"""SELECT s_suppkey AS doc_id, '\begin{tabular}{|l|l|}' || chr(10) || '\hline' || chr(10) || '\multicolumn{1}{|c|}{' || replace(s_name, '#', '\#') || '} & x \\' || chr(10) || '\hline' || chr(10) || ' & y\footnote{n} \\' || chr(10) || '\hline' || chr(10) || '\end{tabular}' || chr(10) || chr(10) AS latex FROM supplier""")
def table_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders and alignment by mask, a cell that goes on from above, a note in a cell."""
    form = "{\\rtf1\\trowd\\clvmgf\\cellx500\\cellx900\\pard\\intbl\\qc <name>\\cell\\pard\\intbl x\\cell\\row\\trowd\\clvmrg\\cellx500\\cellx900\\intbl hidden\\cell y{\\footnote n}\\cell\\row}"
    return render.to_latex(_suppliers(spark, sf_dir, form), Options(fragment=True, table=7)).select("doc_id", "latex")


@query("""SELECT event_id AS doc_id, num::INT AS num, CASE num WHEN 0 THEN 'png' ELSE 'jpeg' END AS kind, CASE num WHEN 0 THEN event_id % 1000 ELSE -1 END::INT AS width, md5(CASE num WHEN 0 THEN props ELSE '{}}' || event_type END) AS content_md5
FROM events, range(2) AS r(num)""")
def document_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pictures a document, one in hex digits, one as a raw run with braces in it; the stand-in for old readers is none."""
    raw = F.concat(F.lit("{}}"), "event_type")
    rtf = F.concat(F.lit("{\\rtf1 a{\\*\\shppict{\\pict\\pngblip\\picw"), (F.col("event_id") % 1000).cast("string"), F.lit(" "), F.regexp_replace(F.hex(F.encode("props", "UTF-8")), "(.{32})", "$1\n"), F.lit("}}{\\nonshppict{\\pict\\wmetafile8 00}}b{\\pict\\jpegblip\\bin"), F.length(raw).cast("string"), F.lit(" "), raw, F.lit("}c}"))
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), rtf.alias("rtf"))
    return state.pictures(docs).select("doc_id", "num", "kind", F.coalesce("width", F.lit(-1)).alias("width"), F.md5("content").alias("content_md5"))


_FEATURES = (
    "{\\rtf1{\\colortbl;\\red255\\green0\\blue9;\\red0\\green0\\blue0;}{\\stylesheet{\\s0 Normal;}{\\s3 Heading 2;}}{\\header top <name>}\\s3 <name>\\par\\pard\\s0{\\cf1 c}{\\cf2 d}{\\fs40 e}"
    "{\\scaps f}{\\caps g}{\\super h}{\\sub i}{\\uldb j}\\tab k{\\*\\bkmkstart m<key>}{\\*\\bkmkend m<key>}\\par\\qr see {\\field{\\*\\fldinst PAGEREF m<key> \\\\h}{\\fldrslt 7}}, {\\field{\\*\\fldinst SYMBOL 97 \\\\f Symbol}{\\fldrslt ?}}"
    "{\\field{\\*\\fldinst EQ \\\\f(<key>,\\\\r(x))}{\\fldrslt }}\\par\\pard{\\field{\\*\\fldinst HYPERLINK \"u<key>\"}{\\fldrslt l}}{\\pict\\pngblip 00}}"
)
_FEATURES_LATEX = (
    "\\subsection*{<name>}\n\n\\textcolor[RGB]{255,0,9}{c}d{\\LARGE e}\\textsc{f}\\MakeUppercase{g}\\textsuperscript{h}\\textsubscript{i}\\underline{j}\\quad{}k\\label{m<key>}\n\n"
    "\\begin{flushright}\nsee \\pageref{m<key>}, α$\\frac{<key>}{\\sqrt{x}}$\n\\end{flushright}\n\n\\href{u<key>}{l}\\includegraphics{picture-0.png}\n\n"
)


def _filled_sql(form: str) -> str:
    return f"replace(replace({literal(form)}, '<name>', replace(s_name, '#', '\\#')), '<key>', s_suppkey::VARCHAR)"


@query(f"SELECT s_suppkey AS doc_id, {_filled_sql(_FEATURES_LATEX)} AS latex FROM supplier")
def latex_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, colours, sizes, forms, bookmarks, references, symbols, equations, links, pictures in one document."""
    return render.to_latex(_suppliers(spark, sf_dir, _FEATURES), Options(fragment=True)).select("doc_id", "latex")


@query(f"""SELECT s_suppkey AS doc_id, {_filled_sql("<name>" + chr(10) * 2 + "cdefghij k" + chr(92) + "label{m<key>}" + chr(10) * 2 + "see " + chr(92) + "pageref{m<key>}, α" + chr(10) * 2 + "l" + chr(10) * 2)} AS latex FROM supplier""")
def latex_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every mask off."""
    plain = Options(fragment=True, paragraph=0, text=8, equation=0, table=0, pictures=False, links=False)
    return render.to_latex(_suppliers(spark, sf_dir, _FEATURES), plain).select("doc_id", "latex")


@query(r"""SELECT s_suppkey AS doc_id, '\vspace{6pt}' || chr(10) || '{\leftskip=36pt\parindent=-18pt ' || replace(s_name, '#', '\#') || '\par}' || chr(10) || '\vspace{3pt}' || chr(10) || chr(10) AS latex FROM supplier""")
def latex_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "{\\rtf1\\pard\\li720\\fi-360\\sb120\\sa60 <name>}"
    return render.to_latex(_suppliers(spark, sf_dir, form), Options(fragment=True, paragraph=6)).select("doc_id", "latex")


@query("""SELECT s_suppkey AS doc_id, '%first' || chr(10) || '\\documentclass{book}' || chr(10) || '\\usepackage[utf8]{inputenc}' || chr(10) || '\\usepackage{hyperref}' || chr(10) || '\\def\\x{}' || chr(10) || '\\begin{document}' || chr(10) || '\\end{document}' || chr(10) AS latex FROM supplier""".replace("\\\\", "\\"))
def header_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with nothing but a header is still a document; the preamble's own texts are shown."""
    options = Options(first_text="%first", document_class="book", definitions="\\def\\x{}")
    return render.to_latex(_suppliers(spark, sf_dir, "{\\rtf1{\\header <name>}{\\footer f}}"), options).select("doc_id", "latex")


@query("SELECT s_suppkey AS doc_id, kind, CASE kind WHEN 'header' THEN s_name WHEN 'footer' THEN 'f' ELSE 'b' END AS text FROM supplier, (VALUES ('header'), ('footer'), ('body')) AS v(kind)")
def headers_and_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.formatted_runs(_suppliers(spark, sf_dir, "{\\rtf1{\\headerl <name>}{\\footerf f}b}")).select("doc_id", "kind", "text")


@query("SELECT s_suppkey AS doc_id, s_name || chr(10) || 'b' AS by_tokens, 2::BIGINT AS paragraphs FROM supplier")
def escaped_line_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backslash before a line feed ends a paragraph."""
    docs = _suppliers(spark, sf_dir, "{\\rtf1 <name>\\\nb}")
    flat = tokens.plain_text(tokens.tokenize(docs)).select("doc_id", F.col("text").alias("by_tokens"))
    return flat.join(state.formatted_runs(docs).groupBy("doc_id").agg(F.countDistinct("par").alias("paragraphs")), "doc_id")


@query("SELECT s_suppkey AS doc_id, 'a' || s_name AS text, 'Equation.3' AS class, md5(s_name) AS data_md5 FROM supplier")
def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded bytes of every document; what an object shows instead stays in the text."""
    rows = _table(spark, sf_dir, "supplier")
    rtf = F.concat(F.lit("{\\rtf1 a{\\object\\objemb{\\*\\objclass Equation.3}{\\*\\objdata "), F.hex(F.encode("s_name", "UTF-8")), F.lit("}{\\result "), "s_name", F.lit("}}}"))
    docs = rows.select(F.col("s_suppkey").alias("doc_id"), rtf.alias("rtf"))
    text = state.formatted_runs(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "").alias("text"))
    return text.join(state.embedded_objects(docs).select("doc_id", "class", F.md5("data").alias("data_md5")), "doc_id")


@query("SELECT s_suppkey AS doc_id, pos::INT AS pos, CASE pos WHEN 2 THEN s_name ELSE t END AS tok, cls::INT AS cls FROM supplier, (VALUES (0, '{', 1), (1, '\\rtf1 ', 3), (2, '', 2), (3, '}', 1)) AS v(pos, t, cls)".replace("\\\\", "\\"))
def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by a table function of ``spark.sql``."""
    sql.register(spark)
    docs = _suppliers(spark, sf_dir, "{\\rtf1 <name>}")
    return spark.sql("SELECT d.doc_id, t.pos, t.tok, t.cls FROM {docs} d, LATERAL rtf_tokens(d.rtf) t", docs=docs)


@query("SELECT s_suppkey AS doc_id, s_name AS cell, 'png' AS kind, 'b' AS bold FROM supplier")
def sql_document_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, pictures and runs by table functions of ``spark.sql``."""
    sql.register(spark)
    docs = _suppliers(spark, sf_dir, "{\\rtf1 漢{\\b b}{\\pict\\pngblip 00}\\trowd\\cellx9\\pard\\intbl <name>\\cell\\row}")
    return spark.sql(
        "SELECT d.doc_id, c.text AS cell, p.kind, r.text AS bold FROM {docs} d, LATERAL rtf_cells(d.rtf) c, LATERAL rtf_pictures(d.rtf) p, LATERAL rtf_runs(d.rtf) r WHERE r.bold", docs=docs
    )


@query(f"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'German' WHEN 1 THEN 'USEnglish' WHEN 2 THEN 'Urdu' ELSE '' END AS language, CASE p_size % 4 WHEN 0 THEN 'Text' WHEN 1 THEN 'Twips' WHEN 2 THEN 'Anisotropic' ELSE '' END AS mode,
CASE p_size % 4 WHEN 1 THEN 'Pels' WHEN 2 THEN 'Lometric' ELSE '' END AS other_mode, {len(maps.LANGUAGES)}::INT AS n FROM part""")
def named_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    pick = lambda *codes: F.element_at(F.array(*[F.lit(c) for c in codes]), k + 1)
    shown = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    modes = shown(maps.metafile_mode(F.lit("wmetafile"), pick(1, 6, 8, 9)), "mode"), shown(maps.metafile_mode(F.lit("pmmetafile"), pick(1, 8, 12, 2)), "other_mode")
    return _table(spark, sf_dir, "part").select("p_partkey", shown(maps.language(pick(0x407, 0x409, 0x420, 1)), "language"), *modes, F.lit(len(maps.LANGUAGES)).alias("n"))
