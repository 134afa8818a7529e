"""Table functions for ``spark.sql``: one row of input to rows of tokens, runs, entries, equations, cells or pictures.

``register(spark)`` makes them known; use them as ``SELECT … FROM t, LATERAL rtf_tokens(t.rtf)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions.text import bytes_of
from .operators import mtef, ole, state, tokens

_TOKEN = re.compile(tokens.PATTERN, re.S)


class RtfTokens:
    def eval(self, rtf: str) -> Iterator[tuple]:
        for k, m in enumerate(_TOKEN.finditer(rtf or "")):
            t = m[0]
            yield k, t, tokens.GROUP if t in "{}" else tokens.CONTROL if t.startswith("\\") else tokens.TEXT


class RtfRuns:
    def eval(self, rtf: str) -> Iterator[tuple]:
        m = state.Machine(bytes_of(rtf)).run()
        for k, r in enumerate(m.rows):
            yield k, r["par"], r["kind"], r["text"], r["bold"], r["italic"], r["underline"], r["align"], r["target"], m.error


class RtfCells:
    def eval(self, rtf: str) -> Iterator[tuple]:
        for c in state.Machine(bytes_of(rtf)).run().tables():
            yield c["tab"], c["tab_row"], c["tab_cell"], c["col_span"], c["text"]


class RtfPictures:
    def eval(self, rtf: str) -> Iterator[tuple]:
        for k, p in enumerate(state.Machine(bytes_of(rtf)).run().pictures):
            yield k, p["kind"], state.hex_bytes(p["hex"])


class OleEntries:
    def eval(self, data: bytes) -> Iterator[tuple]:
        for e in ole.list_entries(bytes(data or b"")):
            yield e["path"], e["name"], e["type"], e["level"], e["size"], e["content"], e["error"]


class MtefEquation:
    def eval(self, data: bytes) -> Iterator[tuple]:
        e = mtef.to_latex(bytes(data or b""))
        yield e["mtef_version"], e["latex_start"], e["latex"], e["latex_end"], e["error"]


FUNCTIONS = {
    "rtf_tokens": (RtfTokens, "pos int, tok string, cls int"),
    "rtf_runs": (RtfRuns, "run int, par int, kind string, text string, bold boolean, italic boolean, underline boolean, align string, target string, error string"),
    "rtf_cells": (RtfCells, "tab int, tab_row int, tab_cell int, col_span int, text string"),
    "rtf_pictures": (RtfPictures, "num int, kind string, content binary"),
    "ole_entries": (OleEntries, "path string, name string, type string, level int, size long, content binary, error string"),
    "mtef_equation": (MtefEquation, "mtef_version int, latex_start string, latex string, latex_end string, error string"),
}


def register(spark: SparkSession) -> None:
    """Make all table functions known to ``spark.sql``."""
    for name, (cls, kinds) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=kinds))
