"""Queries over binary equations and compound files made from the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mtef, ole, state
from .registry import literal, query
from .registry import table as _table


class Maker:
    """Writes records of an equation of one version."""

    def __init__(self, version: int):
        self.five, self.version = version == 5, version

    def head(self) -> bytes:
        return {1: bytes([1]), 5: bytes([5, 1, 0, 5, 0, 65, 0, 0])}.get(self.version, bytes([self.version, 1, 1, 3, 0]))

    def tag(self, kind: int, bits: int = 0) -> bytes:
        return bytes([kind, bits]) if self.five else bytes([kind | bits << 4])

    def char(self, c: str | int, face: int = 131, *marks: int) -> bytes:
        code = ord(c) if isinstance(c, str) else c
        body = bytes([face, code & 255]) + (bytes([code >> 8]) if self.version != 1 else b"")
        return self.tag(2, (1 if self.five else 2) if marks else 0) + body + (b"".join(self.tag(6) + bytes([m]) for m in marks) + b"\0" if marks else b"")

    def line(self, *parts: bytes) -> bytes:
        return self.tag(1) + b"".join(parts) + b"\0"

    def empty(self) -> bytes:
        return self.tag(1, 1)

    def template(self, selector: int, variation: int, *slots: bytes) -> bytes:
        return self.tag(3) + bytes([selector, variation, 0]) + b"".join(slots) + b"\0"

    def pile(self, align: int, *lines: bytes) -> bytes:
        return self.tag(4) + bytes([align, 0]) + b"".join(lines) + b"\0"

    def matrix(self, rows: int, cols: int, *cells: bytes, across: int = 2, upright: int = 1) -> bytes:
        return self.tag(5) + bytes([upright, across, 0, rows, cols]) + b"\0" * ((rows + 4) // 4 + (cols + 4) // 4) + b"".join(cells) + b"\0"

    def whole(self, *parts: bytes) -> bytes:
        return self.head() + self.line(*parts) + b"\0"


def _equations(spark: SparkSession, sf_dir: str, make: Callable[[str, int], list[tuple[int, bytes]]], raw: bool = False, characters: dict | None = None) -> DataFrame:
    """Equations ``make(first letter, key)`` of every nation, as (form, bytes), and their LaTeX."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(100 * k + form, data) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for form, data in make(n[0], k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.binary())], ["eqn_id", "data"])

    made = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name").mapInArrow(build, "eqn_id long, data binary")
    done = mtef.equations(made, raw=raw, characters=characters)
    return done.select(F.floor(F.col("eqn_id") / 100).cast("int").alias("n_nationkey"), (F.col("eqn_id") % 100).cast("int").alias("form"), F.coalesce("mtef_version", F.lit(-1)).alias("mtef_version"), F.coalesce("latex", F.lit("")).alias("latex"), F.coalesce("error", F.lit("")).alias("error"))


def _expected(forms: list[str], version: int | str) -> str:
    """The SQL twin: each form with the first letter of the name at ``@``."""
    listed = ", ".join(f"({k}, {literal(f)})" for k, f in enumerate(forms))
    return f"SELECT n_nationkey::INT AS n_nationkey, form::INT AS form, {version}::INT AS mtef_version, replace(latex, '@', n_name[1]) AS latex, '' AS error FROM nation, (VALUES {listed}) AS v(form, latex)"


#: (selector, variation, slots, LaTeX) before version 5; slots are the letter, y and z.
_OLD = [
    (0, 0, 1, "\\left\\langle @\\right\\rangle"), (1, 1, 1, "\\left( @\\right."), (2, 2, 1, "\\left. @\\right\\}"), (5, 0, 1, "\\left\\| @\\right\\|"), (6, 0, 1, "\\left\\lfloor @\\right\\rfloor"),
    (7, 0, 1, "\\left\\lceil @\\right\\rceil"), (9, 0, 1, "\\left] @\\right]"), (12, 0, 1, "\\left( @\\right]"), (13, 0, 1, "\\sqrt{@}"), (13, 1, 2, "\\sqrt[y]{@}"), (14, 0, 2, "\\frac{@}{y}"),
    (15, 0, 1, "^{@}"), (15, 1, 1, "_{@}"), (15, 2, 2, "_{@}^{y}"), (16, 0, 1, "\\underline{@}"), (17, 1, 1, "\\overline{\\overline{@}}"), (18, 0, 1, "\\stackrel{@}{\\longleftarrow}"),
    (20, 1, 1, "\\stackunder{@}{\\longleftrightarrow}"), (21, 0, 1, "\\int @"), (21, 2, 3, "\\int\\nolimits_{y}^{z}@"), (21, 4, 2, "\\oint\\nolimits_{y}@"), (22, 1, 2, "\\iint\\nolimits_{y}@"),
    (23, 2, 1, "\\iiint @"), (24, 0, 3, "\\int\\limits_{y}^{z}@"), (26, 1, 2, "\\iiint\\limits_{y}@"), (27, 0, 2, "\\stackrel{y}{\\overbrace{@}}"), (28, 0, 2, "\\stackunder{y}{\\underbrace{@}}"),
    (29, 1, 3, "\\sum\\limits_{y}^{z}@"), (30, 0, 2, "\\sum\\nolimits_{y}@"), (31, 2, 1, "\\dprod @"), (34, 1, 3, "\\dcoprod\\nolimits_{y}^{z}@"), (35, 0, 2, "\\dbigcup\\limits_{y}@"),
    (38, 0, 2, "\\dbigcap\\nolimits_{y}@"), (39, 1, 2, "@ _{y}"), (39, 2, 3, "@ _{y}^{z}"), (41, 1, 2, "@/y"), (45, 1, 1, "\\left\\langle @\\right|"), (46, 2, 1, "\\underleftrightarrow{@}"), (47, 1, 1, "\\overrightarrow{@}"),
]
#: The same from version 5 on.
_NEW = [
    (0, 3, 1, "\\left\\langle @\\right\\rangle"), (1, 1, 1, "\\left( @\\right."), (2, 2, 1, "\\left. @\\right\\}"), (6, 1, 1, "\\left\\lfloor @\\right."), (7, 3, 1, "\\left\\lceil @\\right\\rceil"),
    (8, 0, 1, "\\left[ @\\right["), (9, 18, 1, "\\left[ @\\right)"), (9, 49, 1, "\\left) @\\right]"), (10, 0, 1, "\\sqrt{@}"), (10, 1, 2, "\\sqrt[y]{@}"), (11, 0, 2, "\\frac{@}{y}"), (11, 2, 2, "{@}/{y}"),
    (12, 1, 1, "\\underline{\\underline{@}}"), (13, 0, 1, "\\overline{@}"), (14, 0, 1, "\\stackrel{@}{\\longleftarrow}"), (15, 0, 1, "\\int @"), (15, 2, 3, "\\iint\\nolimits_{y}^{z}@"), (15, 8, 1, "\\oint @"),
    (16, 0, 3, "\\sum\\limits_{y}^{z}@"), (18, 0, 3, "\\dcoprod\\limits_{y}^{z}@"), (20, 0, 2, "\\dbigcap\\limits_{y}@"), (21, 0, 3, "\\int_{y}^{z}@"), (22, 0, 3, "\\sum_{y}^{z}@"), (23, 0, 3, "@ _{y}^{z}"),
    (24, 1, 2, "\\stackrel{y}{\\overbrace{@}}"), (25, 0, 2, "\\stackunder{y}{\\underbrace{@}}"), (27, 0, 1, "_{@}"), (28, 0, 2, "^{y}"), (29, 0, 2, "_{@}^{y}"),
]


def _families(version: int, rows: list[tuple]) -> Callable[[str, int], list[tuple[int, bytes]]]:
    m = Maker(version)
    slots = lambda letter, n: [m.line(m.char(c)) for c in (letter, "y", "z")[:n]]
    return lambda letter, _: [(k, m.whole(m.template(s, v, *slots(letter, n)))) for k, (s, v, n, _) in enumerate(rows)]


@query(_expected([r[3] for r in _OLD], 3))
def old_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of every family as versions before 5 number them."""
    return _equations(spark, sf_dir, _families(3, _OLD))


@query(_expected([r[3] for r in _NEW], 5))
def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equations(spark, sf_dir, _families(5, _NEW))


@query(_expected(["\\alpha @\\vartheta", "\\leq \\infty \\Omega", "\\dot{@}'", "\\overrightarrow{@}", "\\mathbf{@}", "\\lim \\mathop{\\rm mod} @", "\\mathrm{foo}", "\\text{if }@", "\\lbrack @\\copyright"], 5))
def equation_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greek and symbols by place and by code, embellishments, typefaces, function names, words, and a table given by the caller."""
    m = Maker(5)

    def make(letter: str, _: int) -> list[tuple[int, bytes]]:
        word = lambda w, face: b"".join(m.char(c, face) for c in w)
        forms = [
            [m.char("a", 132), m.char(letter), m.char("ϑ", 132)], [m.char(163, 134), m.char("∞", 134), m.char("W", 133)], [m.char(letter, 131, 2, 5)], [m.char(letter, 131, 14)], [m.char(letter, 135)],
            [word("lim", 130), m.char(0x2009, 152)[:0], m.tag(4)[:0], m.char(" ", 152), word("mod", 130), m.char(letter)], [word("foo", 130)], [word("if ", 129), m.char(letter)], [m.char(91, 139), m.char(letter), m.char("©", 139)],
        ]
        return [(k, m.whole(*parts)) for k, parts in enumerate(forms)]

    table = mtef.read_characters(["139.91=\\lbrack ", "139.91=second", "139.169m=\\copyright ", "152.32=", "junk"])
    return _equations(spark, sf_dir, make, characters=table)


@query(_expected(["\\begin{array}{cc}\n@ & b \\\\\nc & d\n\\end{array}", "\\begin{array}[t]{r}\n@ \\\\\nb\n\\end{array}", "\\begin{array}{l}\n@ \\\\\nb\n\\end{array}", "@ & = & b \\\\\nc & &", "\\frac{\\begin{array}{l}@ \\\\b\\end{array}}{y}", "^{@ \\ b}"], 3))
def equation_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices, piles, lines aligned at their relations, and piles in slots."""
    m = Maker(3)

    def make(letter: str, _: int) -> list[tuple[int, bytes]]:
        a, b, c, d, y = (m.line(m.char(x)) for x in (letter, "b", "c", "d", "y"))
        aligned = m.pile(4, m.line(m.char(letter), m.char("="), m.char("b")), m.line(m.char("c")))
        forms = [
            m.matrix(2, 2, a, b, c, d), m.matrix(2, 1, a, b, across=3, upright=0), m.pile(1, a, m.empty(), b), aligned, m.template(14, 0, m.pile(1, a, b), y), m.template(15, 0, m.pile(1, a, b)),
        ]
        return [(k, m.whole(f)) if k != 3 else (k, m.head() + f + b"\0") for k, f in enumerate(forms)]

    return _equations(spark, sf_dir, make)


@query("SELECT n_nationkey::INT AS n_nationkey, form::INT AS form, [1, 2, 3, 4, 5][form + 1]::INT AS mtef_version, n_name[1] || 'x' AS latex, '' AS error FROM nation, range(5) AS r(form) UNION ALL SELECT n_nationkey, 9, -1, '', 'version 9 is not known' FROM nation")
def equation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all versions, one that is not known, and records that give no output."""

    def make(letter: str, _: int) -> list[tuple[int, bytes]]:
        out = []
        for k, version in enumerate((1, 2, 3, 4, 5)):
            m = Maker(version)
            skipped = m.tag(8)[:1] + bytes([1, 0, 65, 0]) + m.tag(9)[:1] + bytes([101, 12, 0])
            nudged = m.tag(2, 8) + bytes([128, 128, 1, 2, 3, 4, 131, ord("x")]) + (b"\0" if version > 1 else b"")
            ruled = m.tag(7)[:1] + bytes([1, 0, 1, 2])
            out.append((k, m.whole(skipped, m.char(letter), ruled, nudged)))
        return [*out, (9, b"\x09")]

    return _equations(spark, sf_dir, make)


@query("SELECT n_nationkey::INT AS n_nationkey, 0::INT AS form, 5::INT AS mtef_version, '\\frac{' || n_name[1] || '}{y}' AS latex, '' AS error FROM nation".replace("\\\\", "\\"))
def raw_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations without a header: four bytes, then records of version 5; a record of a later version is skipped by its length."""
    m = Maker(5)
    future = bytes([100, 3, 0, 1, 2, 3])
    make = lambda letter, _: [(0, b"\1\2\3\4" + future + m.line(m.template(11, 0, m.line(m.char(letter)), m.line(m.char("y")))) + b"\0")]
    return _equations(spark, sf_dir, make, raw=True)


def _compound(spark: SparkSession, sf_dir: str, make: Callable[[str], bytes]) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(n) for n in batch.column(1).to_pylist()], type=pa.binary())], ["obj_id", "data"])

    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name").mapInArrow(build, "obj_id long, data binary")


@query("SELECT n_nationkey::BIGINT AS doc_id, '\\sqrt{' || n_name[1] || '}' AS latex, '' AS error FROM nation".replace("\\\\", "\\"))
def document_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: a document's embedded object, its compound file with small sectors, the stream's header, the equation."""
    m = Maker(3)

    def make(name: str) -> bytes:
        records = m.whole(m.template(13, 0, m.line(m.char(name[0]))))
        return ole.write_compound({"Equation Native": struct.pack("<H", 28) + b"\0" * 26 + records, "other": b"x"}, small=True)

    objects = _compound(spark, sf_dir, make)
    rtf = F.concat(F.lit("{\\rtf1 a{\\object\\objemb{\\*\\objclass Equation.3}{\\*\\objdata 01050000"), F.hex("data"), F.lit("}{\\result x}}}"))
    found = state.embedded_objects(objects.select(F.col("obj_id").alias("doc_id"), rtf.alias("rtf")))
    return mtef.embedded_equations(found, "doc_id").select(F.col("eqn_id").alias("doc_id"), "latex", F.coalesce("error", F.lit("")).alias("error"))


@query("""SELECT n_nationkey::BIGINT AS obj_id, ord::INT AS ord, CASE ord WHEN 0 THEN 'Root Entry/' WHEN 1 THEN '  big (5000)' ELSE '  small (' || length(n_name) || ')' END AS line, CASE ord WHEN 0 THEN 'folder /' WHEN 1 THEN 'file big' ELSE 'file small' END AS visited,
CASE ord WHEN 1 THEN 'xxx' WHEN 2 THEN n_name[2:4] ELSE '' END AS part, CASE ord WHEN 1 THEN 'yy' WHEN 2 THEN n_name[-2:] ELSE '' END AS tail FROM nation, range(3) AS r(ord)""")
def compound_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams in small and in big sectors: the printed tree, a visitor, reads from the start and from the end."""
    objects = _compound(spark, sf_dir, lambda name: ole.write_compound({"big": b"x" * 4998 + b"yy", "small": name.encode()}, small=True))
    rows = ole.visit(ole.entries(objects), F.concat(F.lit("folder "), F.col("path")), F.concat(F.lit("file "), F.col("name")))
    text = lambda c: F.coalesce(F.decode(c, "UTF-8"), F.lit(""))
    ord_ = F.when(F.col("type") == "root", 0).when(F.col("name") == "big", 1).otherwise(2)
    return rows.select("obj_id", ord_.alias("ord"), ole.tree_line(F.col("name"), F.col("type"), F.col("level"), F.col("size")).alias("line"), "visited",
                       text(ole.read_at(F.col("content"), F.lit(1), F.lit(3))).alias("part"), text(ole.read_at(F.col("content"), F.lit(2), F.lit(9), "end")).alias("tail"))


@query("SELECT n_nationkey::BIGINT AS obj_id, ['magic', 'header', 'sector'][1 + n_nationkey % 3] AS code FROM nation")
def compound_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged files give a code: no magic, a cut header, sectors beyond the end."""
    whole = _compound(spark, sf_dir, lambda name: ole.write_compound({"a": name.encode()}))
    k = F.col("obj_id") % 3
    cut = F.when(k == 0, F.encode(F.lit("no such file"), "UTF-8")).when(k == 1, F.substring("data", 1, 100)).otherwise(F.substring("data", 1, 600))
    return ole.entries(whole.select("obj_id", cut.alias("data"))).select("obj_id", ole.error_code(F.col("error")).alias("code"))


@query("SELECT n_nationkey::BIGINT AS obj_id, '/a' AS path, n_name AS content, n_name[1] || 'y' AS latex FROM nation")
def sql_binary_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and equations by table functions of ``spark.sql``."""
    from . import sql

    sql.register(spark)
    m = Maker(3)
    objects = _compound(spark, sf_dir, lambda name: ole.write_compound({"a": name.encode(), "b": m.whole(m.char(name[0]), m.char("y"))}, small=True))
    return spark.sql("SELECT o.obj_id, e.path, decode(e.content, 'UTF-8') AS content, q.latex FROM {o} o, LATERAL ole_entries(o.data) e, LATERAL ole_entries(o.data) f, LATERAL mtef_equation(f.content) q WHERE e.name = 'a' AND f.name = 'b'", o=objects)
