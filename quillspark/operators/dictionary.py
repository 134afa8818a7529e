"""The control-word dictionary: which word belongs to which class.  A complete one is read from a file; this is the common part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .maps import parse_dictionary, read_lines

#: Fixed values from the public RTF specification, by class of word.
COMMON = {
    "version": "rtf",
    "default_font": "deff",
    "charset": "ansi mac pc pca",
    "destination": "fonttbl colortbl stylesheet info pict footnote header headerl headerr headerf footer footerl footerr footerf field fldinst fldrslt object objdata bkmkstart bkmkend nonshppict shppict upr ud",
    "font_family": "fnil froman fswiss fmodern fscript fdecor ftech fbidi",
    "font_attribute": "fcharset fprq",
    "color": "red green blue",
    "document": "deftab paperw paperh margl margr margt margb",
    "section": "sect sectd cols",
    "paragraph": "pard s ql qr qj qc fi li ri sb sa sl slmult intbl keep keepn pagebb",
    "table": "trowd row cell cellx clmgf clmrg clvmgf clvmrg clbrdrl clbrdrr clbrdrt clbrdrb trgaph trleft",
    "character": "plain b i ul ulnone uldb caps scaps shad strike sub super nosupersub fs f cf cb v up dn lang uc u",
    "special": "par line page tab emdash endash lquote rquote ldblquote rdblquote bullet bin emspace enspace",
    "picture": "emfblip pngblip jpegblip wmetafile macpict picw pich picwgoal pichgoal picscalex picscaley",
}


def common_words(spark: SparkSession) -> DataFrame:
    """``word``, ``major``, ``minor`` of the common part; a few hundred rows."""
    rows = [(w, major, minor) for major, words in COMMON.items() for minor, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "word string, major string, minor int")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file: a line with the number of words, then major, minor and word a line; a wrong number is an error."""
    return parse_dictionary(read_lines(spark, path))
