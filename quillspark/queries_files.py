"""Queries over customisation files, preferences, options, scanners and small functions, with lines made from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import maps
from .plans import options
from .registry import query
from .registry import table as _table


def _lines(rows: DataFrame, order: str, *forms: str) -> DataFrame:
    """Lines ``value`` numbered ``n``: for every row each form, an SQL expression."""
    each = rows.select(F.col(order).alias("k"), F.posexplode(F.array(*[F.expr(f) for f in forms])).alias("i", "value"))
    return each.select((F.col("k") * len(forms) + F.col("i")).alias("n"), "value")


@query("""SELECT (65 + n_nationkey)::INT AS byte, CASE WHEN n_nationkey % 2 = 0 THEN 'late' || n_name ELSE n_name END AS name FROM nation
UNION ALL SELECT 200, 'decimal' UNION ALL SELECT 233, 'accent'""")
def charset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as characters, in hex and in decimal; comments and blanks; the last line of a byte wins."""
    form = "CASE WHEN n_nationkey % 2 = 0 THEN concat('late', n_name, ' 0x', hex(65 + n_nationkey)) ELSE concat('# ', n_name) END"
    lines = _lines(_table(spark, sf_dir, "nation"), "n_nationkey", "concat(n_name, '\t\"', chr(65 + n_nationkey), '\"')", form, "''", "'decimal 200'", "'accent é'")
    return maps.charset_map(lines)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '{\\' || n_name || '}' WHEN n_nationkey % 3 = 1 THEN 'À' ELSE '?' END AS sequence FROM nation""".replace("\\\\", "\\"))
def output_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte to name to output: written sequences, characters by code, and names that the output file lacks."""
    nation = _table(spark, sf_dir, "nation")
    charset = maps.charset_map(_lines(nation, "n_nationkey", "concat('c', n_nationkey, ' 0x', hex(100 + n_nationkey))"))
    form = "CASE n_nationkey % 3 WHEN 0 THEN concat('c', n_nationkey, ' \"{\\\\', n_name, '}\"') WHEN 1 THEN concat('c', n_nationkey, ' 0xC0') ELSE '# none' END"
    output = maps.output_map(_lines(nation, "n_nationkey", "CASE WHEN n_nationkey % 3 = 2 THEN concat('c', n_nationkey + 1, ' early') ELSE '# no' END", "'%preamble line'", form))
    rows = nation.select("n_nationkey", (F.col("n_nationkey") + 100).alias("byte"))
    return maps.to_output(rows, charset, output, "?").select("n_nationkey", "sequence")


@query("SELECT (2 * n_nationkey)::BIGINT AS n, '\\' || n_name || ' # x' AS value FROM nation UNION ALL SELECT 3 * n_nationkey, ' ' || n_name FROM nation".replace("\\\\", "\\"))
def preamble_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of a user's preamble, and those of an output file."""
    nation = _table(spark, sf_dir, "nation")
    user = maps.user_preamble(_lines(nation, "n_nationkey", "concat('\\\\', n_name, ' # x')", "'# comment'"))
    output = maps.output_preamble(_lines(nation, "n_nationkey", "concat('% ', n_name)", "'name x'", "'# c'"))
    return user.unionByName(output).select(F.col("n").cast("long").alias("n"), "value")


@query("SELECT lower(n_name) AS name, '\\' || n_nationkey || '{' AS begin, '}' AS \"end\" FROM nation WHERE n_nationkey % 4 > 0".replace("\\\\", "\\"))
def style_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "CASE WHEN n_nationkey % 4 > 0 THEN concat('\"', n_name, '\" \\\\', n_nationkey, '{ }') ELSE concat('\"', n_name, '\" incomplete') END"
    return maps.style_map(_lines(_table(spark, sf_dir, "nation"), "n_nationkey", "'# c'", form))


@query("""WITH w AS (SELECT DISTINCT p_type AS word FROM part) SELECT word, 7::INT AS major, (length(word) % 5)::INT AS minor FROM w""")
def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written as a file and read back; its size is checked."""
    words = _table(spark, sf_dir, "part").select(F.col("p_type").alias("word"), F.lit(7).alias("major"), (F.length("p_type") % 5).alias("minor")).distinct()
    return maps.parse_dictionary(maps.dictionary_lines(words))


@query("""WITH w AS (SELECT DISTINCT p_brand AS word FROM part), o AS (SELECT word, row_number() OVER (ORDER BY word) AS n FROM w)
SELECT n::INT AS n, '1 2 "' || word || '"' AS value FROM o UNION ALL SELECT 0, count(*) || ' ' || sum(length(word) + 1) FROM w""")
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator: a head with the sizes, then the words in order."""
    words = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.lit(1).alias("major"), F.lit(2).alias("minor")).distinct()
    return maps.dictionary_lines(words)


@query("""SELECT p_partkey, ['pageWidth', 'convertPict', 'preambleDocClass', 'noSuchName', ''][1 + p_size % 5] AS name, CASE p_size % 5 WHEN 2 THEN p_name ELSE '' END AS text,
CASE p_size % 5 WHEN 0 THEN (p_size * 1440 / 2)::INT WHEN 1 THEN (p_size % 2)::INT WHEN 3 THEN 0 ELSE -1 END::INT AS number, CASE p_size % 5 WHEN 3 THEN 'no' WHEN 4 THEN '' ELSE 'yes' END AS known FROM part""")
def preference_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in twips, switches, quoted texts, unknown names, comments."""
    size = F.col("p_size")
    forms = [F.concat(F.lit("pageWidth  "), size / 2), F.concat(F.lit("convertPict "), F.when(size % 2 == 1, "TRUE").otherwise("yes")), F.concat(F.lit("preambleDocClass '"), "p_name", F.lit("'")), F.lit("noSuchName 1"), F.concat(F.lit("# "), "p_name")]
    line = F.element_at(F.array(*[f.cast("string") for f in forms]), 1 + size % 5)
    name, text, number, known = options.preferences(line)
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(name, F.lit("")).alias("name"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(number, F.lit(-1)).alias("number"), F.when(name.isNull(), "").when(known, "yes").otherwise("no").alias("known")
    )


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size ELSE 63 END::INT AS paragraph, CASE p_size % 3 WHEN 1 THEN 12 ELSE 7 END::INT AS text_mask, CASE p_size % 3 WHEN 1 THEN 0 WHEN 2 THEN p_size ELSE 3 END::INT AS table_mask,
p_size % 3 = 2 AS fragment, CASE p_size % 3 WHEN 1 THEN '-x' ELSE p_brand END AS rest FROM part""")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered flags, attached and separate values, presets, ``--``."""
    forms = [F.concat(F.lit("-p"), "p_size", F.lit(" "), "p_brand"), F.concat(F.lit("-b -n -p 63 -- -x")), F.concat(F.lit("-fT "), "p_size", F.lit(" -bT"), "p_size", F.lit(" "), "p_brand")]
    line = F.element_at(F.array(*forms), 1 + F.col("p_size") % 3)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line_ in batch.column(1).to_pylist():
                given, rest = options.parse_arguments(line_.split(" "))
                o = options.Options().preset("best")
                out.append((given.get("paragraph", o.paragraph), given.get("text", o.text), given.get("table", o.table), given.get("fragment", False), " ".join(rest)))
            cols = [pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["p_partkey", "paragraph", "text_mask", "table_mask", "fragment", "rest"])

    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), line.alias("line")).mapInArrow(read, "p_partkey long, paragraph int, text_mask int, table_mask int, fragment boolean, rest string")


@query("SELECT p_partkey, preset, CASE preset WHEN 'best' THEN 63 ELSE 33 END::INT AS paragraph, CASE preset WHEN 'best' THEN 7 ELSE 12 END::INT AS text_mask FROM part, (VALUES ('best'), ('natural')) AS v(preset)")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(p) for p in options.PRESETS])).alias("preset"))
    bits = lambda kind: F.element_at(F.create_map(*[F.lit(x) for p, v in options.PRESETS.items() for x in (p, v[kind])]), F.col("preset"))
    return rows.select("p_partkey", "preset", bits("paragraph").alias("paragraph"), bits("text").alias("text_mask"))


@query("""SELECT p_partkey, p_name AS quoted, 'a b' AS escaped, 4::INT AS n_all, p_brand || '=1' AS third, p_name || '''s' AS mixed FROM part""")
def scanner_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that hold a field together, an escape character, empty fields, other delimiters."""
    plain = fx.scan(F.concat(F.lit("x \""), "p_name", F.lit("\"\ty")))
    escaped = fx.scan(F.lit("a\\ b c"), escape="\\")
    every = fx.scan(F.concat(F.lit("a;;"), "p_brand", F.lit("=1;")), delimiters=";", quotes="", collapse=False)
    mixed = fx.scan(F.concat(F.lit("\""), "p_name", F.lit("'s\" z")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.element_at(plain, 2).alias("quoted"), F.element_at(escaped, 1).alias("escaped"), F.size(every).alias("n_all"), F.element_at(every, 3).alias("third"), F.element_at(mixed, 1).alias("mixed"))


@query(r"""SELECT p_partkey, (p_size // 16)::INT AS high, (p_size % 16)::INT AS low, 'a' || chr(10) || p_brand || '\' AS unescaped, 'd/' || p_brand AS path, p_brand AS joined, 4::INT AS n_fields, upper(printf('%02x', p_size)) AS hexed FROM part""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    line = F.concat(F.lit("a  "), "p_brand", F.lit("\t"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", fx.high_nibble(size).cast("int").alias("high"), fx.low_nibble(size).cast("int").alias("low"), fx.unescape(F.concat(F.lit("\\a\\n"), "p_brand", F.lit("\\\\"))).alias("unescaped"),
        fx.join_path(F.lit("d"), F.col("p_brand")).alias("path"), fx.join_strings(F.lit(None).cast("string"), F.col("p_brand")).alias("joined"), F.size(fx.scan_all_fields(line)).alias("n_fields"), F.lpad(F.hex(size), 2, "0").alias("hexed"),
    )


@query("SELECT n_nationkey, ['7', 'A', 'A', '€', '�'][1 + n_nationkey % 5] AS char, [55, 65, 65, 128, 233][1 + n_nationkey % 5]::INT AS byte FROM nation")
def code_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a character set's lines, and characters of signed codes."""
    k = 1 + F.col("n_nationkey") % 5
    given, codes = F.element_at(F.array(*[F.lit(x) for x in ("7", "A", "0x41", "128", "é")]), k), F.element_at(F.array(*[F.lit(x) for x in (55, 65, 65, 0x20AC, -9139)]), k)
    return _table(spark, sf_dir, "nation").select("n_nationkey", fx.from_code(codes).alias("char"), maps.code_of(given).alias("byte"))
