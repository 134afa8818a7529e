"""Fields: links, page references, symbols and equation fields; hexadecimal pictures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LATEX_SPECIALS
from .mtef import RELATION_CODES

LATEX = dict(LATEX_SPECIALS)

#: First bytes of picture formats.
MAGIC = (("89504E47", "png"), ("FFD8FF", "jpeg"), ("D7CDC69A", "wmf"), ("01000000", "emf"), ("25504446", "pdf"), ("47494638", "gif"))


def hyperlink(instruction: Column) -> Column:
    """Target of a HYPERLINK field, or null."""
    return F.nullif(F.regexp_extract(instruction, r'(?i)HYPERLINK\s+(?:\\l\s+)?"?([^"\s]+)', 1), F.lit(""))


def page_reference(instruction: Column) -> Column:
    """Bookmark of a PAGEREF field, or null."""
    return F.nullif(F.regexp_extract(instruction, r"(?i)PAGEREF\s+([A-Za-z0-9_]+)", 1), F.lit(""))


def symbol(instruction: Column) -> Column:
    """Character code of a SYMBOL field, or null."""
    return F.nullif(F.regexp_extract(instruction, r"(?i)SYMBOL\s+(\d+)", 1), F.lit("")).cast("int")


#: Fences that an EQ bracket names by one character.
_FENCE = {"(": ("(", ")"), "[": ("[", "]"), "{": ("\\{", "\\}"), "<": ("\\langle", "\\rangle"), "|": ("|", "|")}


class _Equation:
    """Cursor over an EQ instruction: switches ``\\f(a,b)``, ``\\r``, ``\\s\\up``, ``\\s\\do``, ``\\b``, ``\\a``, ``\\l``, ``\\x``, ``\\i``, nested as they come."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def parts(self) -> list[str]:
        """Arguments in parentheses, parted by commas or semicolons."""
        out, now = [], []
        if not self.text.startswith("(", self.at):
            return [""]
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == ")":
                self.at += 1
                return [*out, "".join(now).strip()]
            if c in ",;":
                out.append("".join(now).strip())
                now = []
                self.at += 1
            elif c == "(":
                now.append("(" + ",".join(self.parts()) + ")")
            else:
                now.append(self.one())
        raise ValueError("a parenthesis is not closed")

    def one(self) -> str:
        """The next character or switch."""
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return LATEX.get(c, c)
        m = re.compile(r"([A-Za-z]+)(-?\d*)").match(self.text, self.at)
        if not m:
            c = self.text[self.at : self.at + 1]
            self.at += 1
            return LATEX.get(c, c)
        self.at = m.end()
        return self.switch(m[1].lower())

    def options(self) -> list[str]:
        """Switches before the arguments, as ``lc(`` or ``up``."""
        found = []
        while m := re.compile(r"\s*\\(bc|lc|rc)\\(.)|\s*\\([A-Za-z]+)-?\d*").match(self.text, self.at):
            found.append(m[1] + m[2] if m[1] else m[3].lower())
            self.at = m.end()
        return found

    def switch(self, name: str) -> str:
        given = self.options()
        p = [*self.parts(), "", "", ""]
        if name == "f":
            return f"\\frac{{{p[0]}}}{{{p[1]}}}"
        if name == "r":
            return f"\\sqrt[{p[0]}]{{{p[1]}}}" if p[1] else f"\\sqrt{{{p[0]}}}"
        if name == "s":
            return f"_{{{p[0]}}}" if "do" in given else f"^{{{p[0]}}}"
        if name == "b":
            both = next((g[2:] for g in given if g.startswith("bc")), None)
            sides = {g[:2]: g[2:] for g in given if g[:2] in ("lc", "rc")}
            if both is None and not sides:
                both = "("
            left = _FENCE.get(both or sides.get("lc", ""), (both or sides.get("lc", "."),) * 2)[0]
            right = _FENCE[both][1] if both in _FENCE else both or {">": "\\rangle", "}": "\\}"}.get(sides.get("rc", "."), sides.get("rc", "."))
            return f"\\left{left} {p[0]}\\right{right}"
        if name == "a":
            return "\\begin{array}{c}" + " \\\\ ".join(x for x in p if x) + "\\end{array}"
        if name == "i":
            sign = "\\sum" if "su" in given else "\\prod" if "pr" in given else "\\int"
            return f"{sign}_{{{p[0]}}}^{{{p[1]}}}{p[2]}"
        if name == "x":
            return f"\\fbox{{${p[0]}$}}"
        if name == "o":
            return "\\not " + p[0] if p[1] == "/" else p[0] + p[1]
        return ",".join(x for x in p if x)


def equation_latex(instruction: str | None) -> str | None:
    """LaTeX (within mathematics) of an EQ field; null for other fields and broken ones."""
    m = re.match(r"\s*EQ\b\s*(.*)", instruction or "", re.I | re.S)
    if not m:
        return None
    e, out = _Equation(m[1].strip()), []
    try:
        while e.at < len(e.text):
            out.append(e.one())
    except (ValueError, IndexError, RecursionError):
        return None
    return "".join(out).strip()


def equation(instruction: Column) -> Column:
    """LaTeX of an EQ field, nested and combined switches included; null for other fields and broken ones."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(equation_latex)

    return read(instruction)


def picture_bytes(hexadecimal: Column) -> Column:
    """Bytes of a picture written in hex digits and white space."""
    return F.unhex(F.regexp_replace(hexadecimal, r"\s", ""))


def picture_type(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 4))
    out = F.lit("unknown")
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def is_relation(typeface: Column, code: Column) -> Column:
    """Whether an equation character is a relation at which lines are aligned ."""
    out = F.lit(False)
    for face, codes in RELATION_CODES.items():
        out = out | ((typeface == face) & code.isin(*codes))
    return out
