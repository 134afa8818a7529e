"""Whole documents as LaTeX, each in the task that parses it."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame

from ..functions.text import LATEX_SPECIALS
from ..operators.lookups import HEADINGS
from ..operators.state import Machine, parsed
from .options import EQUATION, PARAGRAPH, TABLE, TEXT, Options

#: Relative sizes by half points, the first that is not smaller.
SIZES = ((10, "\\tiny"), (14, "\\scriptsize"), (16, "\\footnotesize"), (20, "\\small"), (24, ""), (28, "\\large"), (34, "\\Large"), (40, "\\LARGE"), (50, "\\huge"), (32767, "\\Huge"))
ENVIRONMENTS = {"center": "center", "right": "flushright"}
WRAPS = (("bold", "\\textbf{"), ("italic", "\\textit{"), ("underline", "\\underline{"), ("small_caps", "\\textsc{"), ("caps", "\\MakeUppercase{"))
ESCAPES = str.maketrans(dict(LATEX_SPECIALS))
TWIPS_PER_POINT = 20


class Writer:
    """LaTeX of one parsed document."""

    def __init__(self, machine: Machine, options: Options, headings: tuple = HEADINGS):
        self.m, self.o, self.packages = machine, options, {"hyperref": None}
        self.headings = {name: (begin, end) for name, begin, end in headings}
        self.form, self.color, self.size = (options.text & TEXT[x] for x in ("form", "color", "size"))

    def run(self, r: dict) -> str:
        """A run: its text escaped and wrapped by its formatting, outermost last."""
        o = self.o
        if r["raw"] is not None:
            return r["raw"] if o.equation & EQUATION["latex"] or not r["raw"].startswith("$") else ""
        if r["picture"] is not None:
            if not o.pictures:
                return ""
            self.packages["graphicx"] = None
            return f"\\includegraphics{{picture-{r['picture']}.{self.m.pictures[r['picture']]['kind'] or 'bin'}}}"
        out = r["text"]
        if not out.isalnum():
            out = out.translate(ESCAPES).replace("\t", " " if o.text & TEXT["no_tab"] else "\\quad{}")
        if self.form:
            for name, begin in WRAPS:
                out = f"{begin}{out}}}" if r[name] else out
            if r["script"]:
                out = f"\\text{'super' if r['script'] > 0 else 'sub'}script{{{out}}}"
        if self.color and 0 < r["color"] < len(self.m.colors) - 1 and any(rgb := self.m.colors[r["color"]]) and len(rgb) == 3:
            self.packages["xcolor"] = None
            out = f"\\textcolor[RGB]{{{rgb[0]},{rgb[1]},{rgb[2]}}}{{{out}}}"
        if self.size:
            size = next((name for most, name in SIZES if r["size"] <= most), "")
            out = f"{{{size} {out}}}" if size else out
        if r["target"] is not None and o.links:
            out = f"\\href{{{r['target']}}}{{{out}}}"
        return f"\\footnote{{{out}}}" if r["kind"] == "footnote" else out

    def paragraph(self, runs: list[dict]) -> str:
        o, first = self.o, runs[0]
        out = "".join(map(self.run, runs))
        style = self.m.styles.get(first["style"], {}).get("name", "").lower()
        if o.paragraph & PARAGRAPH["style"] and style in self.headings:
            begin, end = self.headings[style]
            return f"{begin}{out}{end}"
        align = max(r["align"] for r in runs)
        if o.paragraph & PARAGRAPH["align"] and align in ENVIRONMENTS:
            out = f"\\begin{{{ENVIRONMENTS[align]}}}\n{out}\n\\end{{{ENVIRONMENTS[align]}}}"
        if o.paragraph & PARAGRAPH["indent"] and (first["left_indent"] or first["first_indent"]):
            points = lambda twips: f"{twips / TWIPS_PER_POINT:g}pt"
            out = f"{{\\leftskip={points(first['left_indent'])}\\parindent={points(first['first_indent'])} {out}\\par}}"
        if o.paragraph & PARAGRAPH["space"]:
            above, below = first["space_before"], first["space_after"]
            out = (f"\\vspace{{{above / TWIPS_PER_POINT:g}pt}}\n" if above else "") + out + (f"\n\\vspace{{{below / TWIPS_PER_POINT:g}pt}}" if below else "")
        return out

    def table(self, tab: int, runs: list[dict]) -> str:
        """A ``tabular`` whose columns are the distinct right edges; wider cells are spans, those that go on from above are empty."""
        cells = [c for c in self.cells if c["tab"] == tab]
        text = {}
        for k, own in groupby(runs, key=itemgetter("tab_row", "tab_cell")):
            own = list(own)
            text[k] = self.run(own[0]) if len(own) == 1 else " ".join(x for x in ("".join(map(self.run, g)) for _, g in groupby(own, key=itemgetter("par"))) if x)
        align = {(r["tab_row"], r["tab_cell"]): r["align"] for r in runs}
        rows = [list(g) for _, g in groupby(cells, key=lambda c: c["tab_row"])]
        wide = max((sum(c["col_span"] for c in row) for row in rows), default=1)
        line = "|" if self.o.table & TABLE["borders"] else ""
        out = []
        for row in rows:
            shown = []
            for c in row:
                key = (c["tab_row"], c["tab_cell"])
                t = "" if c["merged"] or c["vertical_merged"] else text.get(key, "")
                side = {"center": "c", "right": "r"}.get(align.get(key), "l") if self.o.table & TABLE["alignment"] else "l"
                shown.append(f"\\multicolumn{{{c['col_span']}}}{{{line}{side}{line}}}{{{t}}}" if c["col_span"] > 1 or side != "l" else t)
            out.append(" & ".join(shown) + " \\\\\n")
        rule = "\\hline\n" if line else ""
        return f"\\begin{{tabular}}{{{line}{('l' + line) * wide}}}\n{rule}" + rule.join(out) + rule + "\\end{tabular}"

    def body(self) -> str:
        runs = [r for r in self.m.rows if r["kind"] in ("body", "footnote")]
        self.cells = self.m.tables() if any(r["tab"] is not None for r in runs) else []
        closed = {c["tab"] for c in self.cells}
        place, last = [], None
        for r in runs:  # notes stay in the table or paragraph that they are in
            last = r["tab"] if r["kind"] == "body" and r["tab"] in closed else None if r["kind"] == "body" else last
            place.append(last)
        out = []
        for (tab, _), own in groupby(zip(place, runs, strict=True), key=lambda x: (x[0], None if x[0] is not None else x[1]["par"])):
            own = [r for _, r in own]
            out.append((self.table(tab, self.in_cells(own)) if tab is not None else self.paragraph(own)) + "\n\n")
        return "".join(out)

    @staticmethod
    def in_cells(runs: list[dict]) -> list[dict]:
        """Runs of a table; a note belongs to the cell before it."""
        out, at = [], (0, 0)
        for r in runs:
            at = (r["tab_row"], r["tab_cell"]) if r["tab_row"] is not None else at
            out.append(r if r["tab_row"] is not None else r | {"tab_row": at[0], "tab_cell": at[1]})
        return out

    def preamble(self) -> str:
        """What stands before the body: first texts, class, encoding, packages, own definitions and the user's text, each if given."""
        o = self.o
        parts = [o.first_text, o.second_text, f"\\documentclass{{{o.document_class}}}", "\\usepackage[utf8]{inputenc}", *(f"\\usepackage{{{p}}}" for p in self.packages), o.definitions, o.user_text]
        return "".join(f"{p}\n" for p in parts if p)

    def document(self) -> str:
        body = self.body()
        return body if self.o.fragment else f"{self.preamble()}\\begin{{document}}\n{body}\\end{{document}}\n"


def to_latex(docs: DataFrame, options: Options | None = None, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``doc_id``, ``latex``, ``error``: one row a document, also if it has nothing in its body."""
    options = options or Options()
    return parsed(docs, key, content, "doc_id long, latex string, error string", lambda m: [{"latex": Writer(m, options).document(), "error": m.error}])
