"""Loaders of customisation files: character sets, output sequences, styles, preamble lines, control words.

Each works on a DataFrame of lines (``value``, and ``n``, their number) and comes with a function that reads a file so.  Lines that begin
with ``#`` and blank lines are skipped everywhere.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import from_code, scan_fields, unescape
from ..joins import small

STYLES_AT_MOST = 255


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``n`` of one small text file; the order is that of the file."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))


def find_resource(name: str, folders: list[str], given: str | None = None) -> str:
    """Path of a resource: in ``given`` if it is set, then in the folders of ``QUILLSPARK_PATH``, then in ``folders``; an error if none has it."""
    places = ([given] if given else []) + [f for f in os.environ.get("QUILLSPARK_PATH", "").split(os.pathsep) if f] + folders
    for folder in places:
        if os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    raise FileNotFoundError(f"{name} is in none of {places}")


def _content(lines: DataFrame, comment: str = "#") -> DataFrame:
    """Lines with their fields ``f``, without comments and blank ones."""
    kept = lines.filter(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    return kept.withColumn("f", scan_fields(F.col("value")))


def code_of(value: Column) -> Column:
    """A byte given as one character, in decimal, or as ``0x`` and hex digits."""
    hexed = F.conv(F.substring(value, 3, 8), 16, 10).cast("int")
    number = value.rlike(r"^[0-9]{2,3}$")
    return F.when(value.rlike("^0[xX][0-9a-fA-F]+$"), hexed).when(number, value.try_cast("int")).otherwise(F.ascii(value))


def charset_map(lines: DataFrame) -> DataFrame:
    """``byte``, ``name`` of a character-set file (name and value a line); the last line of a byte wins.  A line without a value fails."""
    rows = _content(lines)
    value = F.when(F.size("f") > 1, F.element_at("f", 2)).otherwise(F.raise_error(F.concat(F.lit("no value for "), F.element_at("f", 1))))
    return rows.select(code_of(value).alias("byte"), F.element_at("f", 1).alias("name"), "n").groupBy("byte").agg(F.max_by("name", "n").alias("name"))


def output_map(lines: DataFrame) -> DataFrame:
    """``name``, ``sequence`` of an output file; the last line of a name wins.  A sequence ``0x…`` is the character of that code."""
    rows = _content(lines.filter(~F.col("value").startswith("%"))).filter(F.size("f") > 1)
    text = F.element_at("f", 2)
    code = F.conv(F.substring(text, 3, 8), 16, 10).cast("int")
    shown = F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), from_code(code)).otherwise(text)
    return rows.select(F.element_at("f", 1).alias("name"), shown.alias("sequence"), "n").groupBy("name").agg(F.max_by("sequence", "n").alias("sequence"))


def output_preamble(lines: DataFrame) -> DataFrame:
    """``n``, ``value``: lines of an output file that go to the preamble, without their ``%``."""
    return lines.filter(F.col("value").startswith("%")).select("n", F.expr("substring(value, 2)").alias("value"))


def user_preamble(lines: DataFrame) -> DataFrame:
    """``n``, ``value``: lines of a preamble file, whole, without comments."""
    return lines.filter(~F.col("value").startswith("#")).select("n", "value")


def style_map(lines: DataFrame) -> DataFrame:
    """``name``, ``begin``, ``end`` of a style file; lines with fewer fields are skipped, names are compared in lower case, the last wins."""
    rows = _content(lines).filter(F.size("f") > 2).orderBy("n").limit(STYLES_AT_MOST)
    named = rows.select(F.lower(F.element_at("f", 1)).alias("name"), F.struct(F.element_at("f", 2).alias("begin"), F.element_at("f", 3).alias("end")).alias("x"), "n")
    return named.groupBy("name").agg(F.max_by("x", "n").alias("x")).select("name", "x.begin", "x.end")


def to_output(bytes_: DataFrame, charset: DataFrame, output: DataFrame, missing: str = "") -> DataFrame:
    """Rows with ``byte``, and ``name`` and ``sequence``: byte to standard name to output, two lookups of a few hundred rows each."""
    named = bytes_.join(small(charset), "byte", "left").join(small(output), "name", "left")
    return named.withColumn("sequence", F.coalesce("sequence", F.lit(missing)))


def dictionary_lines(words: DataFrame) -> DataFrame:
    """``n``, ``value``: a dictionary file of ``word``, ``major``, ``minor``: its size, then the words in order of their bytes."""
    written = F.replace(F.replace(F.replace(F.col("word"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    rows = words.select("word", F.concat_ws(" ", F.col("major").cast("string"), F.col("minor").cast("string"), F.concat(F.lit('"'), written, F.lit('"'))).alias("value"))
    # a dictionary has hundreds of words: one array holds them
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("x"), F.count("*").alias("size"), F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0)).alias("bytes"))
    all_ = F.concat(F.array(F.concat_ws(" ", F.col("size").cast("string"), F.col("bytes").cast("string"))), F.transform("x", lambda e: e["value"]))
    return listed.select(F.posexplode(all_).alias("n", "value"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """``word``, ``major``, ``minor`` of the lines of a dictionary file; an error if its first line declares another number of words."""
    rows = _content(lines).withColumn("quoted", F.regexp_extract("value", r'"(.*)"\s*$', 1))
    words = rows.filter(F.size("f") > 2).select(F.element_at("f", 1).cast("int").alias("major"), F.element_at("f", 2).cast("int").alias("minor"), unescape(F.col("quoted")).alias("word"))
    long = F.size("f") > 2
    have, told = rows.agg(F.count(F.when(long, 1)), F.min_by(F.when(~long, F.element_at("f", 1)), F.when(~long, F.col("n")))).first()
    if told is not None and int(told) != have:
        raise ValueError(f"a dictionary declares {told} words and has {have}")
    return words


#: Language ids.
LANGUAGES = {
    0x0400: "NoLang", 0x041C: "Albanian", 0x0401: "Arabic", 0x0421: "Bahasa", 0x0813: "BelgianDutch", 0x080C: "BelgianFrench", 0x0416: "BrazilianPortuguese", 0x0402: "Bulgarian",
    0x0403: "Catalan", 0x041A: "LatinCroatoSerbian", 0x0405: "Czech", 0x0406: "Danish", 0x0413: "Dutch", 0x0C09: "AustralianEnglish", 0x0809: "UKEnglish", 0x0409: "USEnglish",
    0x040B: "Finnish", 0x040C: "French", 0x0C0C: "CanadianFrench", 0x0407: "German", 0x0408: "Greek", 0x040D: "Hebrew", 0x040E: "Hungarian", 0x040F: "Icelandic", 0x0410: "Italian",
    0x0411: "Japanese", 0x0412: "Korean", 0x0414: "BokmalNorwegian", 0x0814: "NynorskNorwegian", 0x0415: "Polish", 0x0816: "Portuguese", 0x0417: "RhaetoRomanic", 0x0418: "Romanian",
    0x0419: "Russian", 0x081A: "CyrillicSerboCroatian", 0x0804: "SimplifiedChinese", 0x041B: "Slovak", 0x040A: "CastilianSpanish", 0x080A: "MexicanSpanish", 0x041D: "Swedish",
    0x100C: "SwissFrench", 0x0807: "SwissGerman", 0x0810: "SwissItalian", 0x041E: "Thai", 0x0404: "TraditionalChinese", 0x041F: "Turkish", 0x0420: "Urdu",
}
#: Mapping modes of metafiles, by the two words that carry them.
METAFILE_MODES = {
    "wmetafile": {1: "Text", 2: "Lometric", 3: "Himetric", 4: "Loenglish", 5: "Hienglish", 6: "Twips", 7: "Isotropic", 8: "Anisotropic"},
    "pmmetafile": {4: "Arbitrary", 8: "Pels", 12: "Lometric", 16: "Himetric", 20: "Loenglish", 24: "Hienglish", 28: "Twips"},
}


def language(code: Column) -> Column:
    """Name of a language id, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), code.cast("int"))


def metafile_mode(word: Column, code: Column) -> Column:
    """Name of a metafile's mapping mode, or null."""
    named = F.create_map(*[F.lit(x) for w, modes in METAFILE_MODES.items() for k, name in modes.items() for x in (f"{w} {k}", name)])
    return F.element_at(named, F.concat_ws(" ", word, code.cast("string")))
