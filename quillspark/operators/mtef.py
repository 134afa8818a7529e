"""Binary equations to LaTeX: a bounded cursor over the record stream, a small tree, and a renderer by rules.

Versions 1 to 5 are read.  Records that cannot be read give an ``error``; unknown templates render their parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_schema
from .ole import list_entries

SCHEMA = "eqn_id long, mtef_version int, latex_start string, latex string, latex_end string, error string"
LINE, CHAR, TMPL, PILE, MATRIX, EMBELL, RULER, FONT, SIZE = range(1, 10)
MAX_DEPTH = 64
#: Fixed values of the format and its LaTeX forms.
FENCES = (("\\langle", "\\rangle"), ("(", ")"), ("\\{", "\\}"), ("[", "]"), ("|", "|"), ("\\|", "\\|"), ("\\lfloor", "\\rfloor"), ("\\lceil", "\\rceil"))
BIG = ("\\sum", "\\dprod", "\\dcoprod", "\\dbigcup", "\\dbigcap")
INTEGRALS = ("\\int", "\\iint", "\\iiint")
ARROWS = ("left", "right", "leftright")
#: Embellishments by code, in mathematics and in text.
EMBELLS = {
    2: ("\\dot{%}", "\\.%"), 3: ("\\ddot{%}", '\\"%'), 4: ("\\dddot{%}", "%"), 5: ("%'", "%"), 6: ("%''", "%"), 7: ("\\backprime %", "%"), 8: ("\\tilde{%}", "\\~%"),
    9: ("\\hat{%}", "\\^%"), 10: ("\\not %", "\\NEG %"), 11: ("\\vec{%}", "%"), 12: ("\\overleftarrow{%}", "%"), 13: ("\\overleftrightarrow{%}", "%"),
    14: ("\\overrightarrow{%}", "%"), 15: ("\\overleftarrow{%}", "%"), 16: ("\\underline{%}", "%"), 17: ("\\bar{%}", "\\=%"), 18: ("%'''", "%"), 19: ("\\widehat{%}", "%"),
    20: ("\\breve{%}", "%"), 25: ("\\d{%}", "\\d{%}"),
}
#: Codes without a form of their own keep the character.
EMBELLS |= {k: ("{%}", "%") for k in range(2, 37) if k not in EMBELLS}
FUNCTIONS = {w: f"\\{w} " for w in "Pr arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lim liminf limsup ln log max min sec sin sinh sup tan tanh".split()}
FUNCTIONS |= {w: f"\\mathop{{\\rm {w}}} " for w in "mod glb lub int Im Re var cov".split()}
#: What a pile in a slot becomes, by the slot's target: begin, line end, end.
PILES = {"math": ("\\begin{array}{l}", " \\\\", "\\end{array}"), "text": ("\\begin{tabular}{l}", " \\\\", "\\end{tabular}"), "line": ("", " \\ ", "")}
#: Typefaces as (mode: 1 mathematics, 2 text, 3 both; looked up in the character table; shown by their code).
TYPEFACES = {k: (1, True, False) for k in range(137, 154)} | {
    129: (2, False, True), 130: (1, True, True), 131: (1, False, True), 132: (1, True, False), 133: (1, True, False), 134: (1, True, True), 135: (1, False, True), 136: (1, False, True),
    139: (1, True, True), 152: (3, True, False),
}
OTHER_TYPEFACE = (1, False, True)
#: Characters at which lines are aligned, by typeface.
RELATION_CODES = {134: (60, 61, 62, 64, 163, 179, 181, 185, 186, 187), 139: (60, 62, 102, 112)}


def fence(left: str, right: str) -> str:
    return f"\\left{left} <1>\\right{right} "


def templates() -> dict[tuple[bool, int, int], str]:
    """Templates by (version 5 or later, selector, variation).  ``<1>`` is a slot, ``<_2>`` and ``<^3>`` are slots shown as sub- and
    superscripts unless they are empty."""
    out: dict[tuple[bool, int, int], str] = {}

    def put(five: bool, selector: int, *forms: str, first: int = 0) -> None:
        out.update({(five, selector, first + k): f for k, f in enumerate(forms)})

    for k, (left, right) in enumerate(FENCES):
        both, one, two = fence(left, right), fence(left, "."), fence(".", right)
        put(False, k, *((both, one, two) if k < 6 else (both,)))
        put(True, k, one, two, both, first=1)
    for k, (left, right) in enumerate(("[[", "]]", "][", "[)", "(]")):
        put(False, 8 + k, fence(left, right))
    put(True, 8, fence("[", "["))
    for v in range(64):  # interval: two bits for each side
        if v & 12 == 0:
            put(True, 9, fence("()[]"[v & 3], "()[]"[v >> 4]), first=v)
    root, fraction, slash = ("\\sqrt{<1>} ", "\\sqrt[<2>]{<1>} "), "\\frac{<1>}{<2>} ", "{<1>}/{<2>} "
    under, over = (tuple(f"\\{w}line{{<1>}} " if n == 1 else f"\\{w}line{{\\{w}line{{<1>}}}} " for n in (1, 2)) for w in ("under", "over"))
    for five, base in ((False, 13), (True, 10)):
        put(five, base, *root)
    put(False, 14, fraction, fraction)
    put(True, 11, fraction, fraction, slash, slash, slash, fraction, slash, slash)
    put(False, 15, "<^1> ", "<_1> ", "<_1><^2> ")
    for v in (0, 1):
        put(True, 27, "<_1> ", first=v)
        put(True, 28, "<^2> ", first=v)
    put(True, 29, "<_1><^2> ")
    put(False, 16, *under)
    put(False, 17, *over)
    put(True, 12, *under)
    put(True, 13, *over)
    for k, arrow in enumerate(ARROWS):
        put(False, 18 + k, *(f"\\{w}{{<1>}}{{\\long{arrow}arrow}} " for w in ("stackrel", "stackunder")))
        for selector, w in ((46, "under"), (47, "over")):
            put(False, selector, f"\\{w}{arrow}arrow{{<1>}} ", first=k)
    put(True, 14, *(f"\\{w}{{<1>}}{{\\longleftarrow}} " for w in ("stackrel", "stackunder")))
    low, both = "<_2><1> ", "<_2><^3><1> "
    put(False, 21, "\\int <1> ", f"\\int\\nolimits{low}", f"\\int\\nolimits{both}", "\\oint <1> ", f"\\oint\\nolimits{low}")
    for selector, w in ((22, "\\iint"), (23, "\\iiint")):
        put(False, selector, *(f"{w} <1> ", f"{w}\\nolimits{low}") * 2)
        put(False, selector + 3, *(f"{w}\\limits{low}",) * 2)
    put(False, 24, f"\\int\\limits{both}", f"\\int\\limits{low}", f"\\oint\\limits{low}")
    put(True, 15, "\\int <1> ", *(f"{w}\\nolimits{both}" for w in INTEGRALS))
    for v in (4, 8, 12):
        put(True, 15, "\\oint <1> ", first=v)
    for k, w in enumerate(BIG):
        put(False, 29 + 2 * k, f"{w}\\limits{low}", f"{w}\\limits{both}", f"{w} <1> ")
        put(False, 30 + 2 * k, f"{w}\\nolimits{low}", f"{w}\\nolimits{both}")
        put(True, 16 + k, f"{w}\\limits{both}")
    put(True, 21, f"\\int{both}")
    put(True, 22, f"\\sum{both}")
    put(False, 39, "<1> <^2> ", "<1> <_2> ", "<1> <_2><^3> ")
    put(True, 23, "<1> <_2><^3> ")
    above, below = "\\stackrel{<2>}{\\overbrace{<1>}} ", "\\stackunder{<2>}{\\underbrace{<1>}} "
    put(False, 27, above)
    put(False, 28, below)
    put(True, 24, below, above)
    put(True, 25, below, above)
    put(False, 41, fraction, "<1>/<2> ", fraction)
    put(False, 45, "\\left\\langle <1>\\right.\\left| <2>\\right\\rangle ", "\\left\\langle <1>\\right| ", "\\left| <1>\\right\\rangle ")
    return out


TEMPLATES = templates()
SLOT = re.compile(r"<([_^]?)(\d)>")
SYMBOLS = {
    "±": "\\pm", "×": "\\times", "÷": "\\div", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "∞": "\\infty", "∂": "\\partial", "∇": "\\nabla",
    "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset", "∪": "\\cup", "∩": "\\cap", "→": "\\rightarrow", "←": "\\leftarrow", "↔": "\\leftrightarrow", "⇒": "\\Rightarrow",
    "⇔": "\\Leftrightarrow", "∀": "\\forall", "∃": "\\exists", "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "√": "\\surd", "⋅": "\\cdot", "∗": "*", "−": "-", "…": "\\ldots", "∝": "\\propto",
    "∼": "\\sim", "≅": "\\cong", "⊥": "\\perp", "∧": "\\wedge", "∨": "\\vee", "¬": "\\neg", "∅": "\\emptyset", "ℜ": "\\Re", "ℑ": "\\Im", "ℵ": "\\aleph", "′": "'", "″": "''",
}
RELATIONS = set("=<>≤≥≠≈≡∼≅∝∈⊂⊃→⇒⇔")
#: The letters of the Symbol character set at the places of Latin capitals and small letters.
SYMBOL_LETTERS = dict(zip("ABGDEZHQIKLMNXOPRSTUFCYWabgdezhqiklmnxoprstufcywJVjv", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρστυφχψωϑςϕϖ", strict=True))
#: Further characters of the Symbol set.
SYMBOL_SIGNS = dict(zip(
    (163, 165, 171, 172, 174, 177, 179, 180, 181, 182, 184, 185, 186, 187, 188, 194, 193, 192, 197, 196, 198, 199, 200, 201, 204, 206, 207, 209, 213, 214, 215, 216, 217, 218, 219, 222, 229, 242, 34, 36, 39, 64, 94, 126),
    "≤∞↔←→±≥×∝∂÷≠≡≈…ℜℑℵ⊕⊗∅∩∪⊃⊂∈∉∇∏√⋅¬∧∨⇔⇒∑∫∀∃∋≅⊥∼", strict=True,
))
FN_FACE, TEXT_FACE, VECTOR_FACE = 2, 1, 7


@dataclass
class Node:
    """One record: its tag, numbers and parts."""

    tag: int
    code: int = 0
    face: int = 0
    variation: int = 0
    parts: list = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    rows: int = 0
    cols: int = 0


class Reader:
    """Cursor over the records of one equation."""

    def __init__(self, data: bytes, raw: bool = False):
        self.data, self.at, self.inline = data, 0, 0
        if raw:
            self.at, self.version, self.platform = 4, 5, 1
            return
        self.version, self.platform = self.byte(), 1
        if self.version in (1, 101):
            self.platform = int(self.version == 101)
        elif 2 <= self.version <= 5:
            self.platform = self.byte()
            self.at += 3
            if self.version == 5:
                while self.byte():
                    pass
                self.inline = self.byte()
        else:
            raise ValueError(f"version {self.version} is not known")

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("the equation is cut")
        self.at += 1
        return self.data[self.at - 1]

    def word(self) -> int:
        return self.byte() | self.byte() << 8

    def nudge(self) -> None:
        if (self.byte(), self.byte()) == (128, 128):
            self.at += 4

    def objects(self, depth: int = 0, most: int = 0) -> list[Node]:
        if depth > MAX_DEPTH:
            raise ValueError("the equation is nested too deeply")
        out: list[Node] = []
        while self.at < len(self.data) and not (most and len(out) >= most):
            first = self.byte()
            tag, bits = (first, 0) if self.version == 5 else (first & 15, first >> 4)
            if tag in (0, 0xFF):
                break
            if self.version == 5 and tag in (LINE, CHAR, TMPL, PILE, MATRIX, EMBELL):
                bits = self.byte()
            if (node := self.record(tag, bits, depth)) is not None:
                out.append(node)
        return out

    def record(self, tag: int, bits: int, depth: int) -> Node | None:
        five = self.version == 5
        if bits & 8 and tag in (LINE, CHAR, TMPL, PILE, MATRIX, EMBELL):
            self.nudge()
        if tag == LINE:
            if bits & 4:
                self.byte()
            if bits & 2:
                self.ruler()
            return Node(LINE, parts=[] if bits & 1 else self.objects(depth + 1))
        if tag == CHAR:
            return self.char(bits, depth)
        if tag == TMPL:
            selector, variation = self.byte(), self.byte()
            if five and variation & 128:
                variation = variation & 127 | self.byte() << 8
            self.byte()
            return Node(TMPL, code=selector, variation=variation, parts=self.objects(depth + 1))
        if tag == PILE:
            align, _ = self.byte(), self.byte()
            if bits & 2:
                self.ruler()
            return Node(PILE, code=align, parts=self.objects(depth + 1))
        if tag == MATRIX:
            upright, across, _ = self.byte(), self.byte(), self.byte()
            rows, cols = self.byte(), self.byte()
            self.at += (rows + 4) // 4 + (cols + 4) // 4
            return Node(MATRIX, code=across, variation=upright, rows=rows, cols=cols, parts=self.objects(depth + 1))
        if tag == EMBELL:
            return Node(EMBELL, code=self.byte())
        if tag == RULER:
            self.ruler()
        elif tag == FONT:
            self.at += 2
            while self.byte():
                pass
        elif tag == SIZE:
            kind = self.byte()
            self.at += {101: 2, 100: 3}.get(kind, 1)
        elif tag == 16:
            self.at += 7
        elif tag == 17:
            self.byte()
            while self.byte():
                pass
        elif tag == 18:
            self.byte()
            for _ in range(2):
                self.nibbles(self.byte())
            for _ in range(self.byte()):
                if self.byte():
                    self.byte()
        elif tag == 19:
            while self.byte():
                pass
        elif tag == 15:
            self.byte()
        elif tag >= 100:
            size = self.word()
            self.at += size
        return None

    def nibbles(self, count: int) -> None:
        """Skip ``count`` lengths written as nibbles that end with 15."""
        left = count
        while left > 0:
            b = self.byte()
            left -= (b >> 4 == 15) + (b & 15 == 15)

    def ruler(self) -> None:
        for _ in range(self.byte()):
            self.at += 3

    def char(self, bits: int, depth: int) -> Node:
        node = Node(CHAR, face=(self.byte() - 128) & 255)
        if self.version < 5:
            node.code = self.byte()
            if self.platform == 1:
                node.code |= self.byte() << 8
            marked = bits & 2
        else:
            if not bits & 32:
                node.code = self.word()
            if bits & 4:
                position = self.byte()
                node.code = node.code or position
            if bits & 16:
                self.word()
            marked = bits & 1
        if marked:
            node.marks = [x.code for x in self.objects(depth + 1) if x.tag == EMBELL]
        return node


def read_characters(lines: list[str]) -> dict[tuple[int, int, str], str]:
    """A character table from lines ``typeface.code=latex`` or ``typeface.codem=latex`` (``t`` for text); the first of equal keys wins."""
    out: dict[tuple[int, int, str], str] = {}
    for line in lines:
        if m := re.match(r"(\d+)\.(\d+)([mt]?)=(.*)", line):
            out.setdefault((int(m[1]), int(m[2]), m[3]), m[4])
    return out


def named(c: str) -> str | None:
    """LaTeX of a character by its Unicode name or the short table, or nothing."""
    name = unicodedata.name(c, "")
    if name.startswith("GREEK ") and ("LETTER " in name or name.endswith(" SYMBOL")) and " WITH " not in name:
        word = name.split("LETTER ")[1] if "LETTER " in name else "VAR" + name.split()[1]
        word = {"LAMDA": "lambda", "FINAL SIGMA": "varsigma", "VARPHI": "varphi"}.get(word, word.lower())
        return f"\\{word.capitalize() if 'CAPITAL' in name else word} "
    if c in SYMBOLS:
        return SYMBOLS[c] + (" " if SYMBOLS[c].startswith("\\") else "")
    return None


def char_latex(node: Node, characters: dict | None = None) -> str:
    """LaTeX of one character: from the given table, by its name, or by its code where the typeface allows it."""
    face = node.face + 128
    _, looked_up, by_code = TYPEFACES.get(face, OTHER_TYPEFACE)
    out = None
    if looked_up and characters:
        out = next((characters[k] for k in ((face, node.code, "m"), (face, node.code, "")) if k in characters), None)
    if out is None:
        c = chr(node.code) if 0 < node.code < 0xD800 else "?"
        if face in (132, 133, 134) and node.code < 256:  # places of the Symbol set
            c = SYMBOL_LETTERS.get(c, c) if face < 134 or c.isalpha() and c.isascii() else SYMBOL_SIGNS.get(node.code, c)
        out = named(c) or ("\\" + c if c in "#$%&_{}" else c if by_code or c != chr(node.code or 63) or ord(c) >= 128 else "")
    if node.face == VECTOR_FACE:
        out = f"\\mathbf{{{out.strip()}}}"
    for mark in node.marks:
        out = EMBELLS.get(mark, ("%", "%"))[0].replace("%", out.strip())
    return out


class Renderer:
    """LaTeX of the records of one equation."""

    def __init__(self, version: int, characters: dict | None = None):
        self.five, self.characters = version >= 5, characters

    def render(self, nodes: list[Node]) -> str:
        """A list of records; runs of function and text characters stay together."""
        out, k = [], 0
        while k < len(nodes):
            n = nodes[k]
            if n.tag == CHAR and n.face in (FN_FACE, TEXT_FACE) and not n.marks:
                end = k
                while end < len(nodes) and nodes[end].tag == CHAR and nodes[end].face == n.face and not nodes[end].marks:
                    end += 1
                out.append(self.word(nodes[k:end]))
                k = end
                continue
            out.append(self.node(n))
            k += 1
        return "".join(out)

    def word(self, nodes: list[Node]) -> str:
        word = "".join(chr(x.code) if x.code else "" for x in nodes)
        if nodes[0].face == TEXT_FACE:
            return f"\\text{{{word}}}"
        if word in FUNCTIONS:
            return FUNCTIONS[word]
        return f"\\mathrm{{{word}}}" if word.isalpha() else "".join(char_latex(x, self.characters) for x in nodes)

    def node(self, n: Node) -> str:
        if n.tag == CHAR:
            return char_latex(n, self.characters)
        if n.tag == LINE:
            return self.render(n.parts)
        if n.tag == PILE:
            return self.pile(n)
        if n.tag == MATRIX:
            return self.matrix(n)
        return self.template(n) if n.tag == TMPL else ""

    def matrix(self, n: Node) -> str:
        cells = [self.node(p) for p in n.parts if p.tag in (LINE, PILE)]
        wide = max(1, n.cols)
        rows = [" & ".join(cells[i : i + wide]) for i in range(0, len(cells), wide)]
        column = {1: "l", 2: "c", 3: "r"}.get(n.code, "c")
        upright = {0: "[t]", 2: "[b]"}.get(n.variation, "")
        return f"\\begin{{array}}{upright}{{{column * wide}}}\n" + " \\\\\n".join(rows) + "\n\\end{array}"

    def pile(self, n: Node) -> str:
        lines = [p for p in n.parts if p.tag == LINE and p.parts]
        if n.code == 4 and lines:
            rows = []
            for p in lines:
                at = relation_at(p)
                show = self.render
                rows.append(f"{show(p.parts)} & & " if at is None else f"{show(p.parts[:at])} & {show(p.parts[at : at + 1]).strip()} & {show(p.parts[at + 1 :])}")
            return " \\\\\n".join(rows)
        kind = {1: "l", 2: "c", 3: "r"}.get(n.code, "l")
        return f"\\begin{{array}}{{{kind}}}\n" + " \\\\\n".join(self.render(p.parts) for p in lines) + "\n\\end{array}"

    def slot(self, n: Node, target: str) -> str:
        """A part of a template: a line, or a pile in the form of the slot's target."""
        if n.tag != PILE:
            return self.render(n.parts)
        begin, line_end, end = PILES[target]
        return begin + line_end.join(self.render(p.parts) for p in n.parts if p.tag == LINE and p.parts) + end

    def template(self, n: Node) -> str:
        slots = [p for p in n.parts if p.tag in (LINE, PILE)]

        def fill(m: re.Match) -> str:
            k = int(m[2]) - 1
            if not m[1]:
                return self.slot(slots[k], "math") if k < len(slots) else ""
            text = self.slot(slots[k], "line") if k < len(slots) else ""
            return f"{m[1]}{{{text}}}" if text else ""

        form = TEMPLATES.get((self.five, n.code, n.variation))
        if form is None:  # not in the tables: the parts as they are
            return "".join(f"{{{self.slot(p, 'math')}}}" for p in slots if p.parts)
        return SLOT.sub(fill, form)


def slot_target(form: str, slot: int) -> str:
    """What a pile becomes in a slot of a template: ``math``, ``line`` or nothing if the template lacks the slot."""
    return next(("line" if m[1] else "math" for m in SLOT.finditer(form) if int(m[2]) == slot), "")


def relation_at(line: Node) -> int | None:
    """Position of the first relation of a line."""
    for i, x in enumerate(line.parts):
        if x.tag == CHAR and (x.code in RELATION_CODES.get(x.face + 128, ()) or chr(x.code) in RELATIONS):
            return i
    return None


def to_latex(data: bytes, raw: bool = False, characters: dict | None = None) -> dict:
    """Columns of ``SCHEMA`` but ``eqn_id`` for one equation."""
    out = {"mtef_version": None, "latex_start": None, "latex": None, "latex_end": None, "error": None}
    try:
        r = Reader(data, raw)
        out["mtef_version"] = r.version
        nodes = r.objects()
        aligned = any(n.tag == PILE and n.code == 4 for n in nodes)
        body = Renderer(r.version, characters).render(nodes).strip()
        if body:
            start, end = ("\\begin{eqnarray*}\n", "\n\\end{eqnarray*}") if aligned else ("$", "$") if r.inline else ("\\[", "\\]")
            out |= {"latex_start": start, "latex": body, "latex_end": end}
    except (ValueError, IndexError) as x:
        out["error"] = str(x)
    return out


def stream_body(content: bytes) -> bytes:
    """The records of an ``Equation Native`` stream: what follows its header, whose length is its first number."""
    size = int.from_bytes(content[:2], "little")
    return content[size:] if 2 <= size <= len(content) else content


def embedded_equations(objects: DataFrame, key: str = "obj_id", content: str = "data") -> DataFrame:
    """Rows of ``SCHEMA`` for the equations in compound files, one of each object; others give an ``error``."""
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = next((e for e in list_entries(data or b"") if e["name"] == "Equation Native" and e["content"]), None)
                none = {"mtef_version": None, "latex_start": None, "latex": None, "latex_end": None, "error": "no equation in the object"}
                out.append((to_latex(stream_body(found["content"])) if found else none) | {"eqn_id": i})
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], type=f.type) for f in schema], schema=schema)

    return objects.select(F.col(key).cast("long").alias("eqn_id"), F.col(content).alias("data")).mapInArrow(run, SCHEMA)


def equations(rows: DataFrame, key: str = "eqn_id", content: str = "data", raw: bool = False, characters: dict | None = None) -> DataFrame:
    """Rows of ``SCHEMA`` for every equation; raw ones have four bytes before the records and no header.  ``characters`` is a table
    of :func:`read_characters`."""
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [to_latex(d or b"", raw, characters) | {"eqn_id": i} for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], type=f.type) for f in schema], schema=schema)

    return rows.select(F.col(key).cast("long").alias("eqn_id"), F.col(content).alias("data")).mapInArrow(run, SCHEMA)
