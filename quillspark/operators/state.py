"""Group-scoped formatting state: the one true stack machine, run per document in Arrow batches.

Braces save and restore the character and paragraph state.  The machine also reads the font, colour and style tables, rows and cells
of tables, pictures, embedded objects, bookmarks and fields; it skips ignorable and non-text destinations, honours raw binary
runs, Unicode stand-ins and the font's character set, and gives one row per run of equal formatting.  A document is parsed once
for everything.  A broken document gives an ``error``, never a failed job; of a pair of Unicode escapes one character is made, of a
lone half U+FFFD.  Every row is a document of its own, also if ids repeat.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bytes_of
from ..joins import dealt
from .fields import equation_latex
from .mtef import SYMBOL_LETTERS, SYMBOL_SIGNS
from .ole import MAGIC
from .tokens import CHARACTERS

SCHEMA = (
    "doc_id long, par int, run int, kind string, text string, bold boolean, italic boolean, underline boolean, small_caps boolean, caps boolean, strike boolean, "
    "script int, size int, color int, font int, align string, style int, left_indent int, first_indent int, space_before int, space_after int, in_table boolean, target string, "
    "tab int, tab_row int, tab_cell int, picture int, raw string, error string"
)
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}]+)|\\", re.S)
#: Destinations whose content is no running text.
HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "objdata", "generator", "nonshppict", "bkmkstart", "bkmkend", "listtable", "listoverridetable", "revtbl", "themedata", "datastore", "xmlnstbl", "rsidtbl", "fldinst", "objclass"}
SIDE = {"footnote": "footnote", "header": "header", "headerl": "header", "headerr": "header", "headerf": "header", "footer": "footer", "footerl": "footer", "footerr": "footer", "footerf": "footer"}
#: Fixed values from the RTF specification: font character sets and their codecs.
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
ALIGN = {"ql": "left", "qr": "right", "qj": "justify", "qc": "center"}
TOGGLES = {"b": "bold", "i": "italic", "ul": "underline", "uldb": "underline", "scaps": "small_caps", "caps": "caps", "strike": "strike"}
PLAIN = {"bold": False, "italic": False, "underline": False, "small_caps": False, "caps": False, "strike": False, "script": 0, "size": 24, "color": 0}
PARD = {"align": "left", "style": 0, "left_indent": 0, "first_indent": 0, "space_before": 0, "space_after": 0, "in_table": False}
MEASURES = {"li": "left_indent", "fi": "first_indent", "sb": "space_before", "sa": "space_after", "s": "style"}
RUN_FIELDS = (*PLAIN, "font", *PARD)
#: Words that name a picture's format, and words that measure it.
PICTURE_KINDS = {"pngblip": "png", "jpegblip": "jpeg", "emfblip": "emf", "wmetafile": "wmf", "macpict": "pict", "dibitmap": "dib", "wbitmap": "bmp"}
PICTURE_SIZES = {"picw": "width", "pich": "height", "picwgoal": "goal_width", "pichgoal": "goal_height", "picscalex": "scale_x", "picscaley": "scale_y"}
#: What tells runs apart, but for their place.
_LOOK = itemgetter(*RUN_FIELDS, "kind", "target")
_FRESH = PLAIN | PARD | {"font": 0, "hidden": None, "kind": "body", "uc": 1, "target": None, "field": False}
_NO_PLACE = (None, None, None)
#: Rows of output that are held at once before they are handed on.
ROWS_AT_ONCE = 10_000
MERGES = {"clmgf": "merge_first", "clmrg": "merged", "clvmgf": "vertical_first", "clvmrg": "vertical_merged"}


class Machine:
    """State of one document while its tokens go by."""

    def __init__(self, data: bytes):
        self.data = data
        self.state = _FRESH.copy()
        self.stack: list[dict] = []
        self.fonts: dict[int, dict] = {}
        self.colors: list[list] = []
        self.styles: dict[int, dict] = {}
        self.codec, self.default_font = "cp1252", 0
        self.rows: list[dict] = []
        self.last: tuple | None = None  # look and place of the last run, if text may join it
        self.par, self.skip, self.raw = 0, 0, bytearray()
        self.field: list[str] = []
        self.error: str | None = None
        self.half: int | None = None
        self.pictures: list[dict] = []
        self.objects: list[dict] = []
        self.bookmark: list[str] = []
        self.edges: list[dict] = []
        self.merge: set[str] = set()
        self.table_rows: list[dict] = []
        self.tab, self.tab_row, self.tab_cell, self.in_tab = -1, 0, 0, False

    def font_codec(self) -> str:
        return self.fonts.get(self.state["font"], {}).get("codec", self.codec)

    def place(self) -> tuple:
        """Table, row and cell of now; entering a table begins a new one."""
        s = self.state
        if s["kind"] == "body" and s["in_table"] != self.in_tab:
            self.in_tab = s["in_table"]
            if self.in_tab:
                self.tab, self.tab_row, self.tab_cell = self.tab + 1, 0, 0
        return (self.tab, self.tab_row, self.tab_cell) if s["in_table"] else _NO_PLACE

    def new_run(self, place: tuple, text: str) -> dict:
        """A run with the state of now (and what else it holds) as its columns."""
        run = self.state.copy()
        run["par"], run["picture"], run["raw"], run["text"] = self.par, None, None, text
        run["tab"], run["tab_row"], run["tab_cell"] = place
        self.rows.append(run)
        return run

    def put(self, text: str, keep: bool = False) -> None:
        """Add text with the state of now to the current run, or open one."""
        if self.half is not None:
            self.half = None
            self.put("\ufffd", keep)
        if self.raw and not keep:
            self.flush()
        if not text:
            return
        if self.state["hidden"]:
            self.hidden_text(text)
            return
        place = self.place()
        look = (place, self.par, _LOOK(self.state))
        if look == self.last:
            self.rows[-1]["text"] += text
        else:
            self.new_run(place, text)
            self.last = look

    def put_whole(self, **what: object) -> None:
        """A run of its own for a picture or for what is LaTeX already."""
        self.put("")
        self.new_run(self.place(), "").update(what)
        self.last = None

    def code_unit(self, n: int) -> None:
        """A Unicode escape; two halves of a pair make one character."""
        n = n + 65536 if n < 0 else n
        if 0xDC00 <= n <= 0xDFFF and self.half is not None:
            n, self.half = 0x10000 + ((self.half - 0xD800) << 10) + (n - 0xDC00), None
        if 0xD800 <= n <= 0xDBFF:
            self.put("")
            self.half = n
        else:
            self.put(chr(n) if 0 <= n < 0xD800 or 0xE000 <= n < 0x110000 else "\ufffd")

    def flush(self) -> None:
        raw, self.raw = bytes(self.raw), bytearray()
        self.put(raw.decode(self.font_codec(), "replace"), keep=True)

    def hidden_text(self, text: str) -> None:
        where = self.state["hidden"]
        if where == "fonttbl":
            self.fonts.setdefault(self.state["font"], {}).setdefault("name", "")
            self.fonts[self.state["font"]]["name"] += text.rstrip(";")
        elif where == "colortbl":
            for _ in range(text.count(";")):  # each ends a colour and begins the next
                self.colors += [[]] if self.colors else [[], []]
        elif where == "stylesheet":
            style = self.styles.setdefault(self.state["style"], {"name": ""})
            style["name"] += text.rstrip(";")
        elif where == "fldinst":
            self.field.append(text)
        elif where == "bkmkstart":
            self.bookmark.append(text)
        elif where == "pict" and self.pictures:
            self.pictures[-1]["hex"].append(text)
        elif where == "objdata" and self.objects:
            self.objects[-1]["hex"].append(text)
        elif where == "objclass" and self.objects:
            self.objects[-1]["class"] += text

    def binary(self, data: bytes) -> None:
        """A raw run: bytes of the picture or object it stands in."""
        where = {"pict": self.pictures, "objdata": self.objects}.get(self.state["hidden"])
        if where:
            where[-1]["hex"].append(data.hex())

    def end_field(self) -> None:
        """What a field without a link becomes by its instruction."""
        text = "".join(self.field)
        self.field = []
        if (latex := equation_latex(text)) is not None:
            self.put_whole(raw=f"${latex}$")
        elif m := re.search(r"PAGEREF\s+([A-Za-z0-9_]+)", text, re.I):
            self.put_whole(raw=f"\\pageref{{{m[1]}}}")
        elif m := re.search(r"SYMBOL\s+(\d+)", text, re.I):
            n = int(m[1])
            c = SYMBOL_LETTERS.get(chr(n), SYMBOL_SIGNS.get(n, "")) if n < 256 and re.search("Symbol\\b.*Symbol", text, re.I | re.S) else ""
            self.put(c or (chr(n) if n < 0xD800 else "\ufffd"))

    def close_group(self, before: dict) -> None:
        """The state goes back to ``before``; what the closed group held is complete."""
        after, self.state = self.state, before
        if after["hidden"] == "bkmkstart" != before["hidden"]:
            name, self.bookmark = "".join(self.bookmark).strip(), []
            if name and not before["hidden"]:
                self.put_whole(raw=f"\\label{{{name}}}")
        elif after["hidden"] == "pict" != before["hidden"] and not before["hidden"]:
            self.put_whole(picture=len(self.pictures) - 1)
        if after["field"] and not before["field"] and not before["hidden"]:
            self.end_field()

    def word(self, word: str, n: int | None) -> None:
        s = self.state
        if s["hidden"] == "nonshppict":
            return
        if (simple := SIMPLE.get(word)) is not None:
            simple(self, s, n)
        elif word in HIDDEN:
            s["hidden"] = word
            if word == "fldinst":
                self.field = []
            elif word == "pict":
                self.pictures.append({"kind": None, "hex": []})
            elif word == "objdata":
                self.objects.append({"class": "", "hex": []} if not self.objects or self.objects[-1]["hex"] else self.objects.pop())
            elif word == "objclass":
                self.objects.append({"class": "", "hex": []})
            elif word == "object":
                self.put("")
        elif word == "result" and s["hidden"] == "object":
            s["hidden"] = None
        elif s["hidden"] == "pict" and word in PICTURE_KINDS:
            self.pictures[-1]["kind"] = PICTURE_KINDS[word]
        elif s["hidden"] == "pict" and word in PICTURE_SIZES:
            self.pictures[-1][PICTURE_SIZES[word]] = n
        elif word in SIDE:
            s["kind"] = SIDE[word]
        elif word == "field":
            self.field, s["field"] = [], True
        elif word == "fldrslt":
            instruction = "".join(self.field)
            m = re.search(r'HYPERLINK\s+(?:\\l\s+)?"?([^"\s]+)', instruction)
            s["target"] = m.group(1) if m else None
            if re.match(r"\s*(EQ|PAGEREF|SYMBOL)\b", instruction, re.I):
                s["hidden"] = "fldrslt"  # the instruction says more
            else:
                self.field = []
        elif s["hidden"] == "colortbl" and word in ("red", "green", "blue"):
            if not self.colors:
                self.colors.append([])
            self.colors[-1].append(n or 0)
        elif word == "fcharset" and s["hidden"] == "fonttbl":
            self.fonts.setdefault(s["font"], {})["codec"] = CHARSETS.get(n or 0, self.codec)
        elif word in ("f", "deff"):
            s["font"] = n or 0
        elif word == "sbasedon":
            self.styles.setdefault(s["style"], {"name": ""})["based_on"] = n
        elif word == "ulnone":
            s["underline"] = False
        elif word in ("super", "sub", "nosupersub"):
            s["script"] = {"super": 1, "sub": -1}.get(word, 0) if n != 0 else 0
        elif word == "fs":
            s["size"] = 24 if n is None else n
        elif word == "cf":
            s["color"] = n or 0
        elif word == "uc":
            s["uc"] = 1 if n is None else n
        elif word == "u" and n is not None:
            self.code_unit(n)
            self.skip = s["uc"]
        elif word == "ansicpg" and n:
            try:
                "".encode(f"cp{n}")
                self.codec = f"cp{n}"
            except LookupError:
                pass
        elif word in ("mac", "pc", "pca"):
            self.codec = {"mac": "mac_roman", "pc": "cp437", "pca": "cp850"}[word]
        elif word == "par":
            self.put("")
            if not s["hidden"]:
                self.par += s["kind"] == "body"
        elif word in CHARACTERS:
            self.put(CHARACTERS[word])

    def begin_row(self, s: dict, n: int | None) -> None:
        self.edges, self.merge = [], set()

    def add_edge(self, s: dict, n: int | None) -> None:
        edge = {"right": n or 0}
        if self.merge:
            edge |= dict.fromkeys(self.merge, True)
            self.merge = set()
        self.edges.append(edge)

    def end_cell(self, s: dict, n: int | None) -> None:
        self.put("")
        self.place()
        self.tab_cell += 1

    def end_row(self, s: dict, n: int | None) -> None:
        self.put("")
        if self.tab >= 0:
            self.table_rows.append({"tab": self.tab, "tab_row": self.tab_row, "cells": self.tab_cell, "edges": list(self.edges)})
        self.tab_row, self.tab_cell = self.tab_row + 1, 0

    def run(self) -> Machine:
        at, n, seen_rtf, star = 0, len(self.data), False, False
        data, match = self.data, _TOKEN.match
        while at < n:
            m = match(data, at)
            at = m.end()
            word, param, hexed, symbol, brace, text = m.groups()
            if (word or brace or symbol) and self.raw:
                self.flush()
            if brace:
                self.skip = 0
                if brace == b"{":
                    self.stack.append(self.state.copy())
                elif self.stack:
                    self.put("")
                    self.close_group(self.stack.pop())
                    if not self.stack:
                        rest = self.data[at:].strip(b"\r\n\0 ")
                        self.error = self.error or ("text after the last group" if rest else None)
                        break
                else:
                    self.error = "closing brace without a group"
                    break
            elif not self.stack:
                if (text or b"").strip():
                    self.error = "text before the first group"
                    break
            elif word and seen_rtf and not star and (simple := _SIMPLE_BYTES.get(word)) is not None:
                if self.state["hidden"] != "nonshppict":
                    simple(self, self.state, int(param) if param else None)
            elif word:
                w, k = word.decode("ascii"), int(param) if param else None
                if not seen_rtf:
                    if w != "rtf" or k not in (None, 1):
                        self.error = "no version word"
                        break
                    seen_rtf = True
                if w == "bin":
                    end = min(n, at + max(0, k or 0))
                    self.binary(self.data[at:end])
                    at = end
                elif star and w not in SIDE and w not in HIDDEN and w not in ("ud", "shppict"):
                    self.state["hidden"] = "unknown"
                else:
                    self.word(w, k)
            elif hexed:
                if self.skip:
                    self.skip -= 1
                else:
                    self.raw += bytes([int(hexed, 16)])
            elif symbol:
                c = symbol.decode("latin-1")
                if c in "\r\n":
                    self.word("par", None)
                elif c != "*":
                    self.put({"~": "\u00a0", "_": "\u2011", "-": "\u00ad"}.get(c, c if c in "{}\\" else ""))
            elif text:
                plain = text.translate(None, b"\r\n")
                if self.skip:
                    cut = min(self.skip, len(plain))
                    self.skip -= cut
                    plain = plain[cut:]
                if plain and not seen_rtf:
                    self.error = "no version word"
                    break
                self.raw += plain
            star = symbol == b"*"
        self.flush()
        self.put("")
        if not self.error and (self.stack or not seen_rtf):
            self.error = "a group is not closed" if self.stack else "no version word"
        return self

    def tables(self) -> list[dict]:
        """Cells of all tables: place, right edge, columns it spans, whether it goes on from the cell above, text."""
        text: dict[tuple, str] = {}
        for r in self.rows:
            if r["tab"] is not None and r["kind"] == "body":
                key = (r["tab"], r["tab_row"], r["tab_cell"])
                text[key] = text.get(key, "") + r["text"]
        bounds: dict[int, list[int]] = {}
        for row in self.table_rows:
            bounds.setdefault(row["tab"], []).extend(e["right"] for e in row["edges"])
        order = {t: {x: k for k, x in enumerate(sorted(set(b)))} for t, b in bounds.items()}
        out = []
        for row in self.table_rows:
            before = -1
            for k in range(max(row["cells"], len(row["edges"]))):
                edge = row["edges"][k] if k < len(row["edges"]) else {}
                at = order[row["tab"]].get(edge.get("right"))
                out.append({"tab": row["tab"], "tab_row": row["tab_row"], "tab_cell": k, "right_edge": edge.get("right"), "col_span": 1 if at is None else max(1, at - before), "merged": edge.get("merged", False),
                            "vertical_merged": edge.get("vertical_merged", False), "text": text.get((row["tab"], row["tab_row"], k), "")})
                before = before if at is None else at
        return out


def _setter(name: str, value: Callable[[int | None], object]) -> Callable[[Machine, dict, int | None], None]:
    def put(m: Machine, s: dict, n: int | None) -> None:
        s[name] = value(n)

    return put


#: Words that do the same whatever the state, but within the stand-in for old readers; the other words are read by :meth:`Machine.word`.
SIMPLE: dict[str, Callable[[Machine, dict, int | None], None]] = {
    "trowd": Machine.begin_row, "cellx": Machine.add_edge, "cell": Machine.end_cell, "row": Machine.end_row,
    "plain": lambda m, s, n: s.update(PLAIN), "pard": lambda m, s, n: s.update(PARD), "intbl": _setter("in_table", lambda n: True),
    **{word: lambda m, s, n, name=name: m.merge.add(name) for word, name in MERGES.items()},
    **{word: _setter(name, lambda n: n or 0) for word, name in MEASURES.items()},
    **{word: _setter(name, lambda n: n != 0) for word, name in TOGGLES.items()},
    **{word: _setter("align", lambda n, side=side: side) for word, side in ALIGN.items()},
}
_SIMPLE_BYTES = {word.encode(): put for word, put in SIMPLE.items()}


def hex_bytes(parts: list[str]) -> bytes:
    """Bytes of hex digits with anything else between them; a last single digit is dropped."""
    joined = "".join(parts)
    try:
        return bytes.fromhex(joined)
    except ValueError:  # parted within a byte, or with other characters
        digits = re.sub("[^0-9a-fA-F]", "", joined)
        return bytes.fromhex(digits[: len(digits) & ~1])


def parsed(docs: DataFrame, key: str, content: str, schema: str, rows_of) -> DataFrame:
    """``doc_id`` and the rows that ``rows_of`` makes of every document's machine; documents kept as text may hold any character."""
    from ..arrow import arrow_schema

    arrow = arrow_schema(schema)

    def batch_of(ids: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids if f.name == "doc_id" else [r.get(f.name) for r in rows], type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = rows_of(Machine(bytes_of(data.as_py())).run())
                ids += [doc_id] * len(made)
                rows += made
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch_of(ids, rows)
                    ids, rows = [], []
            yield batch_of(ids, rows)

    return dealt(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(content).alias("rtf"))).mapInArrow(run, schema)


def formatted_runs(docs: DataFrame, key: str = "doc_id", content: str = "rtf", resolve: bool = False) -> DataFrame:
    """Rows of ``SCHEMA`` for every run of every document; a document without text gives one row.

    resolve: with ``font_name``, ``style_name``, ``r``, ``g``, ``b`` of the document's own tables, nulls for defaults."""
    more = ", font_name string, style_name string, r int, g int, b int" if resolve else ""

    def rows_of(m: Machine) -> list[dict]:
        rows = m.rows or [{"par": 0, "text": "", "kind": "body"}]
        out = [r | {"run": k, "error": m.error} for k, r in enumerate(rows)]
        if resolve:
            for r in out:
                rgb = m.colors[r["color"]] if 0 <= r.get("color", -1) < len(m.colors) - 1 else []
                r |= dict(zip("rgb", rgb if len(rgb) == 3 else (None,) * 3, strict=True))
                r |= {"font_name": m.fonts.get(r.get("font"), {}).get("name"), "style_name": m.styles.get(r.get("style"), {}).get("name")}
        return out

    return parsed(docs, key, content, SCHEMA + more, rows_of)


def document_tables(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``doc_id``, ``kind`` (font, color, style), ``num``, ``name``, ``based_on``, ``r``, ``g``, ``b`` of every document."""

    def rows_of(m: Machine) -> list[dict]:
        rows = [{"kind": "font", "num": k, "name": f.get("name")} for k, f in sorted(m.fonts.items())]
        rows += [{"kind": "color", "num": k} | (dict(zip("rgb", c, strict=True)) if len(c) == 3 else {}) for k, c in enumerate(m.colors[:-1] or [])]
        return rows + [{"kind": "style", "num": k, "name": s["name"], "based_on": s.get("based_on")} for k, s in sorted(m.styles.items())]

    return parsed(docs, key, content, "doc_id long, kind string, num int, name string, based_on int, r int, g int, b int", rows_of)


def style_ancestors(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``doc_id``, ``num``, ``ancestor``, ``depth`` of the styles of every document; a cycle ends where it would repeat."""

    def rows_of(m: Machine) -> list[dict]:
        out = []
        for num in m.styles:
            at, seen = num, []
            while at in m.styles and at not in seen:
                out.append({"num": num, "ancestor": at, "depth": len(seen)})
                seen.append(at)
                at = m.styles[at].get("based_on")
        return out

    return parsed(docs, key, content, "doc_id long, num int, ancestor int, depth int", rows_of)


def document_cells(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """Cells of all tables of every document, as :meth:`Machine.tables` gives them."""
    kinds = "doc_id long, tab int, tab_row int, tab_cell int, right_edge int, col_span int, merged boolean, vertical_merged boolean, text string"
    return parsed(docs, key, content, kinds, lambda m: m.tables())


def pictures(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``doc_id``, ``num``, ``kind``, sizes and ``content`` (bytes) of the pictures of every document, in order."""
    sizes = ", ".join(f"{x} int" for x in PICTURE_SIZES.values())

    def rows_of(m: Machine) -> list[dict]:
        return [p | {"num": k, "content": hex_bytes(p["hex"])} for k, p in enumerate(m.pictures)]

    return parsed(docs, key, content, f"doc_id long, num int, kind string, {sizes}, content binary", rows_of)


def embedded_objects(docs: DataFrame, key: str = "doc_id", content: str = "rtf") -> DataFrame:
    """``doc_id``, ``num``, ``class``, ``data`` of the embedded objects of every document: the compound file within, or all bytes."""

    def rows_of(m: Machine) -> list[dict]:
        out = []
        for k, o in enumerate(m.objects):
            data = hex_bytes(o["hex"])
            at = data.find(MAGIC)
            out.append({"num": k, "class": o["class"].strip(), "data": data[at:] if at >= 0 else data})
        return out

    return parsed(docs, key, content, "doc_id long, num int, class string, data binary", rows_of)
