"""Lookups: characters, fonts, colours, styles, headings, and duplicate keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import small

#: Style names that become LaTeX headings.
HEADINGS = (("heading 1", "\\section*{", "}"), ("heading 2", "\\subsection*{", "}"), ("heading 3", "\\subsubsection*{", "}"))
MAX_STYLE_DEPTH = 256


def decode_bytes(rows: DataFrame, content: str, charset: str, out: str = "text") -> DataFrame:
    """Rows with ``out``, the text of a binary column in a named character set, double-byte sets included."""
    codec = {"mac": "mac_roman", "cp936": "gbk"}.get(charset, charset)

    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode(codec, "replace"))

    return rows.withColumn(out, decoded(F.col(content)))


def charset_table(spark: SparkSession, charset: str) -> DataFrame:
    """``charset``, ``byte``, ``char`` of one single-byte set, from Python's codec of it; 256 rows at most."""
    codec = {"mac": "mac_roman"}.get(charset, charset)
    rows = []
    for b in range(32, 256):
        try:
            rows.append((charset, b, bytes([b]).decode(codec)))
        except UnicodeDecodeError:
            continue
    return spark.createDataFrame(rows, "charset string, byte int, char string")


def map_bytes(bytes_: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``charset`` and ``byte`` and their ``char``, by a lookup of at most 256 rows a set."""
    return bytes_.join(small(table), ["charset", "byte"], "left")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def heading(style_name: Column, text: Column) -> Column:
    """The text as a LaTeX heading where the style is one, in any case; otherwise the text."""
    out = text
    for name, begin, end in HEADINGS:
        out = F.when(F.lower(style_name) == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def style_chain(styles: DataFrame, key: str = "doc_id", depth: int = MAX_STYLE_DEPTH) -> DataFrame:
    """``key``, ``num``, ``ancestor``, ``depth`` of every style and the styles of its document that it is based on.

    ``styles`` has ``key``, ``num`` and ``based_on``.  The styles of a document, at most a few hundred, are gathered to a map and every chain is
    followed there, so nothing is joined; a cycle ends at its first repeat, a chain of more than ``depth`` steps is an error."""
    at = F.map_from_entries(F.array_sort(F.collect_list(F.struct("num", "based_on"))))
    documents = styles.filter(F.col("num").isNotNull()).groupBy(key, "num").agg(F.max("based_on").alias("based_on")).groupBy(key).agg(at.alias("_parents"))

    def follow(chain: Column, _: Column) -> Column:
        up = F.element_at(F.col("_parents"), F.element_at(chain, -1))
        known = F.map_contains_key(F.col("_parents"), F.element_at(chain, -1))
        go = known & up.isNotNull() & F.map_contains_key(F.col("_parents"), F.coalesce(up, F.lit(-1))) & ~F.array_contains(chain, F.coalesce(up, F.lit(-1)))
        return F.when(go, F.concat(chain, F.array(up))).otherwise(chain)

    chains = documents.select(key, F.explode(F.map_keys("_parents")).alias("num"), "_parents")
    chain = F.aggregate(F.sequence(F.lit(1), F.least(F.size("_parents"), F.lit(depth + 1))), F.array("num"), follow)
    whole = F.when(F.size(chain) > depth + 1, F.raise_error(F.lit(f"a style chain has more than {depth} steps"))).otherwise(chain)
    return chains.select(key, "num", F.posexplode(whole).alias("depth", "ancestor")).select(key, "num", "ancestor", "depth")
